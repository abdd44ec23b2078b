"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets the key ``-ln(u) / w``: u a hash of its id, w its quality weight. A source's complete
epochs come first; what is left of its target is drawn in key order up to the word budget. Keys are
not sorted over a whole source: they are summed in equal hash buckets, a running sum over the buckets finds
the one in which the budget ends, and only that bucket's documents are sorted. A source of any share of the
rows is therefore spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash, unpacked, whole

#: Rows of a source that share a bucket of keys.
BUCKET_ROWS = 5_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Between 0.25 and 1.25: the share of letters among the code points."""
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))
    return F.lit(0.25) + F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def draw_of(doc_id: Column, seed: str) -> Column:
    """Uniform in (0, 1), a function of id and seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sums: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``source, source_size, n_rows`` to ``source, source_size, n_rows, epochs, rest, target``: water-filling in one sorted pass.

    Sorted by cap over weight, the sources that stop at their cap come first, so running sums tell the
    level of all others. The windows over all sources sort one narrow row a source in one task: some millions of sources are well within its memory.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    every = Window.partitionBy()
    up = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * F.lit(float(cap))
    s = sums.withColumn("weight", weight).withColumn("fill", limit / F.col("weight"))
    spent, gone = F.coalesce(F.sum(limit).over(up), F.lit(0.0)), F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    level = (F.sum("source_size").over(every) - spent) / (F.sum("weight").over(every) - gone)
    s = s.withColumn("level", level).withColumn("full", F.col("fill") <= F.col("level"))
    s = s.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    # of those not full, the first has the level at which all full ones are taken out; later ones have a lower one
    target = F.when(F.col("full"), limit).otherwise(F.col("weight") * F.col("level"))
    epochs = F.when(F.col("full"), F.lit(int(cap))).otherwise(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))))
    s = s.withColumn("target", target).withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long"))
    rest = F.when(F.col("full") & F.lit(float(cap) == int(cap)), F.lit(0.0)).otherwise(F.col("target") - F.col("epochs") * F.col("source_size"))
    return s.select("source", "source_size", "n_rows", "epochs", rest.alias("rest"), "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, seed: str = "mix", keep: list[str] | None = None, quality: Column | None = None) -> DataFrame:
    """Adds ``size, source_size, target, taken`` to each row of ``docs`` (doc_id, text, source, ...).

    ``quality`` is a document's weight, above 0, of its columns; by default the share of letters in the text stands in for a quality label.
    Null text has size 0; null sources are one source, which sorts last; an empty table gives an empty result;
    rows that repeat a doc_id are drawn together; input columns with the names of the added ones are replaced.
    A source's taken words differ from its target by less than its largest boundary document. ``keep`` names the input columns to
    return (default all): they are stored with sizes and keys, so texts are read and counted once.
    """
    plain = docs.drop("size", "source_size", "target", "taken")
    keep = plain.columns if keep is None else list(keep)
    key = -F.ln(draw_of(F.col("doc_id"), seed)) / (quality_of(F.col("text")) if quality is None else quality)
    narrow = stash(plain.select(whole(plain.select(*keep)), "doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("key")), "mix-keys")
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goals = stash(targets(sums, weights, cap), "mix-targets").withColumnRenamed("source", "goal_source")
    same = F.col("source").eqNullSafe(F.col("goal_source"))

    buckets = F.ceil(F.col("n_rows") / BUCKET_ROWS)
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), buckets - 1)
    keyed = narrow.join(goals.where("rest > 0"), same).withColumn("bucket", bucket)
    upto = Window.partitionBy("goal_source").orderBy("bucket")
    edge = (
        keyed.groupBy("goal_source", "bucket")
        .agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        .withColumn("upto", F.sum("words").over(upto))
        .where("upto - words <= rest and rest < upto")
        .select(F.col("goal_source").alias("edge_source"), F.col("bucket").alias("edge_bucket"), (F.col("upto") - F.col("words")).alias("before"))
    )
    inside = keyed.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("bucket") == F.col("edge_bucket")))
    inside = inside.groupBy("goal_source", "key", "doc_id").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("goal_source").orderBy("key", "doc_id")))
    near = F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size"))  # the document at the edge comes if that is nearer
    cut = inside.groupBy("goal_source").agg(
        F.max(F.when(near, F.struct("key", "doc_id"))).alias("last"), F.min(F.struct("key", "doc_id")).alias("first")
    )
    cut = cut.withColumnRenamed("goal_source", "cut_source")
    # one row a source, stored so that Spark knows its size and broadcasts it only if that is small
    goals = stash(goals.join(cut, F.col("goal_source").eqNullSafe(F.col("cut_source")), "left"), "mix-plan")

    here = F.struct("key", "doc_id")
    # with no cut in a source that has words left to take, rounding made the budget the whole source
    extra = F.when(F.col("rest") <= 0, False).when(F.col("first").isNull(), True).when(F.col("last").isNull(), here < F.col("first")).otherwise(here <= F.col("last"))
    taken = F.col("size") * (F.col("epochs") + extra.cast("long"))
    return narrow.join(goals, same).select(*unpacked(keep), "size", "source_size", "target", taken.alias("taken"))


def op4_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, keep=["doc_id"])


#: The same rows by plain windows over whole sources.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (0.25 + coalesce((length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')))::DOUBLE / nullif(length(text), 0), 0.0)) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS fill,
    (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
  FROM s WINDOW up AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, fill <= level AS filled,
    CASE WHEN fill <= level THEN 3.0::DOUBLE * source_size ELSE weight * max(CASE WHEN fill > level THEN level END) OVER () END AS target
  FROM f),
e AS (
  SELECT *, CASE WHEN filled THEN 3 ELSE coalesce(floor(target / nullif(source_size, 0)), 0) END::BIGINT AS epochs FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
    CASE WHEN filled THEN 0 ELSE target - epochs * source_size END AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
