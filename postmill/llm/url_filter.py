"""URL filters: host and path rules, and gradient-boosted trees on lexical features for urls that no rule fits.

All is in DataFrame operations and Spark's own tree learner; nothing runs in Python on the executors. The urls that a rule
decides are the labelled ones. The trees are fitted on a bounded sample of them, the ``SAMPLE`` least by a hash of the
url; suffix statistics are over all rows, those of labels for a labelled row from the half it isn't in. The fitted trees become one SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, unpacked, whole

#: Rows that the trees are fitted on at most, and what they are grown to.
SAMPLE, TREES, DEPTH = 5_000, 12, 3


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The fixed rules of op3.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: list[Rule]) -> Column:
    """The fitting rule of the longest name, of equally long ones the first: its index, else null."""
    out = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: (len(rules[k].name), -k)):  # the last to be wrapped is asked first
        rule = rules[k]
        own = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        out = F.when(own, F.lit(k)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last two labels of the host: enough for names such as example.net."""
    return F.substring_index(host, ".", -2)


def entropy_of(text: Column) -> Column:
    """Shannon entropy of the characters, in bits, from how often each occurs: codes below 128, all others as one."""
    clean = F.regexp_replace(text, r"[^\x00-\x7F]", "\u0080")
    counts = F.transform(F.array_distinct(F.split(clean, "(?s)(?<=.)(?=.)")), lambda c: (F.length(clean) - F.length(F.replace(clean, c, F.lit("")))).cast("double"))
    total = F.greatest(F.length(clean), F.lit(1)).cast("double")
    return F.aggregate(counts, F.lit(0.0), lambda s, n: s - F.when(n > 0, n / total * F.log2(n / total)).otherwise(0.0))


def features(url: Column) -> dict[str, Column]:
    """Of the url: lengths, depth, digit ratio, entropy and parameter counts. A null url counts as empty."""
    url = F.coalesce(url, F.lit(""))
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    digits = F.length(url) - F.length(F.regexp_replace(url, "[0-9]+", ""))
    return {
        "url_length": F.length(url), "host_length": F.length(F.col("host")), "path_length": F.length(F.col("path")), "query_length": F.length(query),
        "depth": F.size(F.filter(F.split(F.col("path"), "/"), lambda x: x != "")), "labels": F.size(F.split(F.col("host"), r"\.")),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)), "entropy": entropy_of(url), "host_entropy": entropy_of(F.col("host")),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")), "hyphens": F.length(F.col("host")) - F.length(F.replace(F.col("host"), F.lit("-"), F.lit(""))),
        "fragment": F.contains(url, F.lit("#")).cast("int"), "secure": F.startswith(url, F.lit("https:")).cast("int"),
    }


#: Of a suffix over all rows: urls, mean url length, and the share blocked of the labelled, drawn towards a half.
SUFFIX = ["suffix_urls", "suffix_length", "suffix_blocked"]


def suffix_stats(base: DataFrame) -> DataFrame:
    """``_own_suffix, suffix_urls, suffix_length`` and, of each half of the labelled rows, how many there are and how many are blocked."""
    halves = [(F.count(F.when(F.col("_half") == k, F.col("_label"))).alias(f"_many{k}"), F.coalesce(F.sum(F.when(F.col("_half") == k, F.col("_label"))), F.lit(0.0)).alias(f"_blocked{k}")) for k in (0, 1)]
    return base.groupBy(F.col("_suffix").alias("_own_suffix")).agg(F.count("*").cast("double").alias("suffix_urls"), F.coalesce(F.avg(F.length("_url")), F.lit(0.0)).alias("suffix_length"), *halves[0], *halves[1])


def suffix_blocked() -> Column:
    """A labelled row's from the half that it isn't in, so that its own label has no part; the others' from both."""
    use = [F.when(F.col("_label").isNull() | (F.col("_half") != k), 1).otherwise(0) for k in (0, 1)]
    total = lambda c: F.col(f"{c}0") * use[0] + F.col(f"{c}1") * use[1]
    return (total("_blocked") + 50) / (total("_many") + 100)


def _tree(node, names: list[str]) -> Column:
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(names[split.featureIndex()]) <= F.lit(float(split.threshold())), _tree(node.leftChild(), names)).otherwise(_tree(node.rightChild(), names))


def boosted(rows: DataFrame, names: list[str], sample: int, seed: int = 17) -> Column:
    """Whether a row of ``rows`` (label, order, features) would be labelled 1; with one label or none, that label or 0."""
    # the rows that are least by hash: taken from each partition first, so no more than the sample moves
    bounded = stash(rows.select("label", *names).orderBy("order", "label").limit(sample), "url-sample")
    seen = {r.label for r in bounded.select("label").distinct().collect()}
    if len(seen) < 2:
        return F.lit(bool(seen and seen.pop()))
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=seed, featuresCol="features", labelCol="label")
    data = VectorAssembler(inputCols=names, outputCol="features").transform(bounded).coalesce(2)
    model = learner.fit(data)
    trees = model._java_obj.trees()
    margin = F.lit(0.0)
    for tree, weight in zip(trees, model.treeWeights):
        margin = margin + _tree(tree.rootNode(), names) * F.lit(float(weight))
    return margin > 0


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Adds ``host, path, rule, verdict, learned`` to each row of ``pages`` (url, ...); ``learned`` is what the trees say, also where a rule decides.

    A null url, or one without ``://``, has empty host and path; no rule fits an empty host. Without labelled rows of both kinds
    the trees can't be fitted: all else gets the one known verdict, or allow. Rows that repeat are judged alike. An empty table gives an
    empty result; urls are read whole, whatever their length. Input columns with the names of the added ones are replaced.
    """
    plain = pages.drop("host", "path", "rule", "verdict", "learned")
    url = F.col("_url")
    base = plain.select(whole(plain), F.col("url").alias("_url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumns({"_rule": fitting(rules), "_suffix": suffix_of(F.col("host")), "_half": F.pmod(F.xxhash64(url, F.lit("half")), F.lit(2))})
    verdict = F.get(F.array(*[F.lit(r.verdict) for r in rules]), F.col("_rule"))
    base = base.withColumn("_label", (verdict == "block").cast("double"))
    stats = stash(suffix_stats(base), "url-suffixes")  # stored: Spark knows its size, and broadcasts it only if small
    made = {f"_{k}": v.cast("double") for k, v in features(url).items()}
    names = [*made, *SUFFIX]
    rows = base.join(stats, F.col("_suffix") == F.col("_own_suffix")).withColumns({**made, "suffix_blocked": suffix_blocked()})
    labelled = rows.where("_rule is not null").withColumns({"label": F.col("_label"), "order": F.xxhash64(url)})
    learned = F.when(boosted(labelled, names, sample), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(*unpacked(plain.columns), "host", "path", F.get(F.array(*[F.lit(r.name) for r in rules]), F.col("_rule")).alias("rule"), F.coalesce(verdict, learned).alias("verdict"), learned.alias("learned"))


def op3_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "learned")


def brute_force(url: str | None, rules: list[Rule] = RULES) -> tuple[str, str, str | None, str | None]:
    """host, path, rule and the rule's verdict."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut].translate(str.maketrans(UPPER, LOWER)), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict
