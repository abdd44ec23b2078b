"""Each operator against its brute-force version, and on nulls, empty texts, ties, repeated rows, empty tables and clashing names."""

import re
import zlib
from functools import reduce
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import chat, decontamination, html_text, language_id, merkle, mixing, neardup, ngram_lm, simhash, substring_dedup, url_filter
from postmill.llm.components import components
from postmill.llm.registry import QUERIES, SQL

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(f"w{k}" for k in range(30_000))
DOCS = [
    (1, " ".join(LOREM * 3), "en", "a"), (2, " ".join(LOREM * 3), "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "One", "de", "b"), (6, "one two", "de", "c"), (7, "x " * 45 + " ".join(LOREM), "fr", "c"),
    (8, "Q: " + " ".join(LOREM[:22]) + " and no more", "fr", "a"), (9, LONG, "en", "a"), (10, "12 34 !?", "en", None), (11, "a\n\nb c d\tE\u00a0f \u00c9t\u00e9", "fr", "b"), (12, " ".join(LOREM[::-1]), "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")


def pairs():
    return [(d, t) for d, t, _, _ in DOCS]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_simhash(spark, docs):
    assert rows(simhash.simhash_groups(docs)) == sorted(simhash.brute_force(pairs()), key=str)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
    again = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3")).withColumn("fp", F.lit("clash"))
    assert [r[2] for r in rows(simhash.simhash_groups(again))] == [1, 1, 1, 1]


def test_links_of_crowds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 20)
    rng, base = np.random.default_rng(5), 0x1234_5678_9ABC_DEF
    prints = sorted({base ^ reduce(lambda x, k: x ^ 1 << int(k), rng.integers(0, 20, int(rng.integers(0, 5))), 0) for _ in range(150)})
    found = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()}
    assert found == {(x, y) for x in prints for y in prints if x < y and (x ^ y).bit_count() <= 2}


@pytest.mark.parametrize("alone", [0, 1 << 20])
def test_components(spark, monkeypatch, alone):
    monkeypatch.setattr("postmill.llm.components.ONE_TASK", alone)
    edges = [(k, k + 1) for k in range(20)] + [(100, 101), (101, 105), (50, 50), (101, 100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(1, 21)}, 101: 100, 105: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    words = [f"w{k}" for k in range(120)]
    near = words.copy()
    near[60] = "changed"
    far = words[:60] + [f"v{k}" for k in range(60)]
    table = [(5, " ".join(words)), (3, " ".join(near).upper()), (8, " ".join(far)), (9, " ".join(far)), (1, ""), (2, None), (4, "one"), (None, "one"), (6, "one")]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert found == {5: 3, 3: 3, 8: 8, 9: 8, 1: 1, 2: 1, 4: 4, 6: 4}
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_of_a_template(spark):
    rng, words = np.random.default_rng(3), lambda name, n: [f"{name}{k}" for k in range(n)]
    shared, table = words("template", 80), []
    for k in range(40):  # members alike at about 0.7; every other one is copied at 0.8 or a little more
        text = shared + words(f"own{k}x", 16)
        table.append((2 * k, " ".join(text)))
        if k % 2:
            text[int(rng.integers(10, 70))] = "changed"
            text += words(f"more{k}x", 5 + k % 3)
        table.append((2 * k + 1, " ".join(text)))
    for k in range(30):  # short texts, of which 4 of 5 shingles are shared, or 3 of 4
        text = words(f"short{k}x", 8)
        table += [(200 + 2 * k, " ".join(text)), (201 + 2 * k, " ".join([*text, "end"] if k % 3 else [*text[1:], "end"]))]
    wanted = neardup.brute_force(table)
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert found == wanted and len(set(wanted.values())) > 40


def test_lm(spark, docs):
    train = {d for d, _ in pairs() if zlib.crc32(str(d).encode()) % 7 != 2}
    marked = docs.withColumn("held_out", ngram_lm.held_out(F.col("doc_id"))).withColumn("score", F.lit("clash"))
    model = ngram_lm.train(marked.where("not held_out"), span=1000)
    wanted = ngram_lm.brute_force(pairs(), train)
    found = ngram_lm.score(marked, model, ["doc_id", "held_out"]).collect()
    assert len(found) == len(DOCS) and {r.doc_id for r in found if not r.held_out} == train
    for r in found:
        assert tuple(r)[2:5] == wanted[r.doc_id][:3] and np.allclose(tuple(r)[5:], wanted[r.doc_id][3:])
    # a model's probabilities over all known words and one unknown sum to one, after any word
    reader = ngram_lm.Reader(model)
    known = sorted({w for d, t in pairs() if d in train for w in (t or "").lower().encode().split()})
    if model.words < 40_000:
        for before in (b"alpha", b"never seen"):
            h = np.array([ngram_lm.xxhash.xxh3_64_intdigest(x) for w in [*known, b"\n", b"unseen"] for x in (before, w)], np.uint64)
            p = ngram_lm.probabilities(model, reader, h, np.full(len(h) // 2, 2))[1][1::2]
            assert abs(p.sum() - 1) < 1e-9
    empty = ngram_lm.train(docs.limit(0))
    assert {r.score for r in ngram_lm.score(docs, empty, ["doc_id"]).collect()} == {0.0}


def test_lm_of_null_ids_and_repeats(spark):
    table = [(1, "a b a"), (1, "a b a"), (None, "a c"), (None, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumn("held_out", ngram_lm.held_out(F.col("doc_id")))
    found = ngram_lm.score(docs, ngram_lm.train(docs), ["doc_id", "held_out"]).collect()
    plain = ngram_lm.brute_force(list(enumerate(t for _, t in table)), set(range(4)))
    assert sorted((tuple(r)[2:5], round(r.score, 9)) for r in found) == sorted((x[:3], round(x[4], 9)) for x in plain.values()) and not any(r.held_out for r in found if r.doc_id is None)
    assert ngram_lm.score(docs.limit(0), ngram_lm.train(docs), ["doc_id"]).count() == 0


def test_held_files_are_let_go(tmp_path):
    from postmill.llm import common

    for k in range(6):
        common.put_file(f"file://{tmp_path}/{k}", bytes([k]) * 10)
    files = common.Held(files=3)
    assert [bytes(files.get(f"file://{tmp_path}/{k}", bytes))[:1] for k in (0, 1, 2, 3, 1, 4, 5, 0)] == [bytes([k]) for k in (0, 1, 2, 3, 1, 4, 5, 0)]
    assert list(files.own) == [f"file://{tmp_path}/{k}" for k in (4, 5, 0)] and files.get(f"file://{tmp_path}/none", bytes, True) == b""
    with pytest.raises(FileNotFoundError):
        files.get(f"file://{tmp_path}/lost", bytes)


def test_packing():
    for x in (np.empty(0, np.uint64), np.array([0, 1, 2**63], np.uint64)):
        assert (ngram_lm.unpack(ngram_lm.pack(x)) == x).all()
    gap = np.array([0, 1, 7, 300, 70_000, 2])
    assert (substring_dedup.unriced(*substring_dedup.riced(gap)) == gap).all()
    h = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    for n in (1, 2, 3, 7, 20, 40):
        wanted = [sum(int(h[i + k]) * pow(int(substring_dedup._PLAIN), n - 1 - k, 2**64) for k in range(n)) % 2**64 for i in range(41 - n)]
        assert [int(x) for x in substring_dedup.rolled(h, n, substring_dedup._PLAIN)] == wanted


URLS = [None, "", "x", "http://A.org", "http://ORG/", "https://a.com/fr/?q://", "://", "http://b.example.org/en/1\n?x", "http://myexample.org/es/", "http://example.org/es/x#y", "http://u.com/de/1", "http://v.com/fr/2?a=1&b=2"]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    for r in url_filter.filter_urls(pages).collect():
        host, path, rule, verdict = url_filter.brute_force(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    alone = url_filter.filter_urls(spark.createDataFrame([("http://x.net/",)], "url string"))
    assert alone.first().verdict == "allow" and url_filter.filter_urls(pages.limit(0)).count() == 0


def test_mixing(spark, docs):
    con = duckdb.connect()
    table = docs.toPandas()
    con.register("documents", table)
    wanted = sorted((tuple(r) for r in con.execute(mixing.OP4_SQL).fetchall()), key=str)
    clash = docs.withColumns({"size": F.lit("x"), "target": F.lit(1)})
    found = rows(mixing.mix_sources(clash).select("doc_id", "size", "source_size", "target", "taken"))
    assert [r[0] for r in found] == [r[0] for r in wanted]
    for a, b in zip(found, wanted):
        assert a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) < 1e-6 and a[4] <= 3 * a[1]
    assert abs(sum(r[3] for r in {r[2:4]: r for r in found}.values()) - sum(r[1] for r in found)) < 1e-6
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_targets_stop_at_the_cap(spark):
    sums = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1, 1), (None, 989, 1)], "source string, source_size long, n_rows long")
    found = {r.source: r.target for r in mixing.targets(sums, (5, 2, 1), 3).collect()}
    assert found["a"] == 30 and found["c"] == 3 and abs(sum(found.values()) - 2000) < 1e-9
    assert abs(found["b"] * 5 - found[None] * 2) < 1e-6


def test_decontamination(spark, docs):
    items = [(1, " ".join(LOREM[2:14])), (2, "one"), (3, None), (4, "-"), (5, "x x x x x x x x x x x"), (2, "two"), (10, " ".join(LOREM[:10]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (4 << 20, 60):
        found = decontamination.decontaminate(docs.withColumn("n_hit", F.lit("clash")), benchmark, keep=["doc_id"], part_bytes=size)
        digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
        out = found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"), digest, F.col("n_hit") > 0)
        assert rows(out) == sorted(decontamination.brute_force(pairs(), items), key=str)
    assert decontamination.decontaminate(docs.limit(0), benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_decontamination_reads_documents_twice(spark, docs, part_bytes):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    items = [(k, " ".join(LOREM[k : k + 12])) for k in range(12)]
    counted = docs.select("doc_id", "text").mapInArrow(count, "doc_id long, text string")
    decontamination.decontaminate(counted, spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes).write.format("noop").mode("overwrite").save()
    assert read.value == 2 * len(DOCS)


def test_substrings_of_many_files(spark, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BITS", 12)
    assert substring_dedup._size(30_000)[0] > 30
    found = substring_dedup.dedup_substrings(docs.unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(19).cast("long"))), keep=["doc_id"], as_digest=True)
    assert rows(found) == sorted(substring_dedup.brute_force([*pairs(), (19, LONG)]), key=str)


def test_substrings(spark, docs):
    found = substring_dedup.dedup_substrings(docs.withColumn("kept", F.lit("clash")), keep=["doc_id"], as_digest=True)
    assert rows(found) == sorted(substring_dedup.brute_force(pairs()), key=str)
    again = docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    own = substring_dedup.brute_force([pairs()[0]])[0][2]  # the rows of id 1 are one document; that of no id keeps all
    assert rows(substring_dedup.dedup_substrings(again.select("doc_id", "text")).select("doc_id", "n_removed")) == [(1, own), (1, own), (None, 0)]
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_languages(spark):
    said = {"en": "the cat and the dog are in the house of my friend", "de": "der hund und die katze sind in dem haus von meinem freund", "fr": "le chien et le chat sont dans la maison de mon ami"}
    table = [(k, f"{said[lang]} {k}", lang) for k, lang in enumerate([*said] * 10)] + [(100, None, "en"), (101, "12 ?!", "de"), (102, "die katze " * 2000, None), (103, "w" * 500, "en")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    found = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    assert all(found[k].lang_pred == lang for k, _, lang in table[:30]) and found[102].lang_pred == "de"
    assert {found[100].lang_pred, found[101].lang_pred} == {"und"} and all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in language_id.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify_languages(docs.limit(0)).count() == 0


def test_languages_of_odd_texts(spark, monkeypatch):
    odd = ["q" * 47, "\u1681" * 16, "w" * 5000, "\u16a0\u16a1" * 400, "x\u00b2", "\u0130stanbul"]
    table = [(1, "the cat and the dog are in the house", "en"), (2, "die katze und der hund sind in dem haus", "de"), (3, "the end", "en"), (3, "the end", "en")]
    table += [(10 + k, t, None) for k, t in enumerate(odd)] + [(30 + k, t, None) for k, t in enumerate(["\u00bd \u00b2", "\u2460 \u2167 12", "", "_ - _"])]
    long = [(50 + k, "le chien et le chat sont dans la maison de mon ami " * (40 + k), "fr") for k in range(9)]
    monkeypatch.setattr(language_id.sample, "__defaults__", (250, 1000))
    docs = spark.createDataFrame(table + long, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    assert all(0 < found[10 + k].score <= 1 and found[10 + k].lang_pred in ("de", "en", "fr") for k in range(len(odd)))
    assert all((found[30 + k].lang_pred, found[30 + k].score) == ("und", 0) for k in range(4)) and {found[50 + k].lang_pred for k in range(9)} == {"fr"}


def test_language_sample_is_bounded(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.when(F.col("id") < 3000, "en").when(F.col("id") < 4990, "de").otherwise("fr").alias("lang"))
    found = language_id.sample(docs, 50)
    assert {lang: sum(x == lang for _, x in found) for lang in ("en", "de", "fr")} == {"en": 50, "de": 50, "fr": 10}


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    found = language_id.identify_languages(docs, ["doc_id", "held_out", "lang"]).where("held_out and lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).alias("right")).collect()
    assert len(found) > 150 and sum(r.right for r in found) > 0.97 * len(found)


def test_forward_sums_all_segmentations():
    model = language_id.fit([("the cat the dog", "en"), ("der hund die katze", "de")])
    kinds = {p for p in language_id.vocabulary(language_id.VOCABULARY) if 0 < len(p) <= language_id.PIECE and p == p.lower() and re.fullmatch(rb" ?[a-z\x80-\xff]*", p)} | {bytes([b]) for b in range(256)}
    number = {p: k for k, p in enumerate(sorted(kinds))}

    def every(w):
        return sum((model.p[number[w[:k]]] * every(w[k:]) for k in range(1, len(w) + 1) if w[:k] in number), np.zeros(2)) if w else np.ones(2)

    for w in (b" the", b" katze", " étés".encode(), b" qzx"):
        assert np.allclose(np.log(every(w)), model.log_probabilities([w])[0])
    assert np.allclose(model.p.sum(0), 1)
    text = "the dog and die katze"
    total = sum(np.log(every(w)) for w in language_id.words(text))
    assert np.allclose(total, model.log_probabilities(language_id.words(text)).sum(0))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><script>var t="</p>";</script><!-- <p>no</p> -->
<div id="cookie-notice">We use cookies for the best of all the experience on our site and you agree to that by using it.</div><div class=content><h2>Title here</h2>
<p>This is the first  paragraph of the article &amp; it has many of the usual words that are in the <b>English</b> language, so it is good.<p>Short one.</p>
<p>This is the second paragraph of the article and it has many of the usual words that are in the English language.</p></div>
<div class="comments"><p>This is the comment of a reader that has many of the usual words that are in the English language, so it is bad.</p></div>
<form><label>Name of the person</label></form><aside>More of this and that to read on the side of the page of the site</aside><footer>&copy; 2020 the company</footer></body></html>"""


def test_html(spark):
    table = [(1, PAGE), (2, None), (3, ""), (4, "just text"), (5, "<p>a<p>b</p><script>x<y"), (6, "a < b &lt; c"), (7, "<div><!-- never ends <p>x")]
    pages = spark.createDataFrame(table, "page_id long, html string").withColumn("text", F.lit(1))
    found = {r.page_id: r for r in html_text.extract_text(pages, ["page_id"]).collect()}
    assert found[1].text == (
        "Title here This is the first paragraph of the article & it has many of the usual words that are in the English language, so it is good. Short one. "
        "This is the second paragraph of the article and it has many of the usual words that are in the English language."
    )
    assert [found[k].text for k in range(2, 8)] == ["", "", "just text", "a b", "a < b < c", ""] and all(r.n_chars == len(r.text) for r in found.values())
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_html_of_odd_markup():
    prose = "This is the first paragraph of the article and it has many of the usual words that are in the language."
    kept = {
        f'<article><svg width="1"/><p>{prose}</p></article>': prose, f'<script>var a="<!--";</script><p>{prose}</p>': prose, f"<!-- <script> --><p>{prose}</p><!-- </script> -->": prose,
        f"<article><p>{prose}</p><button>Go<p>{prose}</p></article>": f"{prose} Go {prose}", f"<article><p>{prose}</p><button>Go</button><p>{prose}</p></article>": f"{prose} {prose}",
        f'<article><div class="related-work"><p>{prose}</p></div><div class="teaser"><a href=x>{prose}</a></div><p>© in a sentence: {prose}</p></article>': f"{prose} © in a sentence: {prose}",
        f'<article><p>{prose}</p></article><div class="related-work"><p>{prose}</p></div>': prose, f'<article><p>{prose}</p><div class="comments"><p>{prose}</p></div></article>': prose,
        f"<p>{prose}</p><SCRIPT>never ends <p>{prose}</p>": prose, f"<p title='>'>{prose}</p><!--> <p>{prose}</p>": f"{prose} {prose}", f"<article><p>{prose}</p><svg><title>x</title></svg><math><mi>x</mi></math></article>": prose,
    }
    assert {page: html_text.main_text(page) for page in kept} == kept
    for unit in ("<script/>", "<button>", "<div class='a'>", "<!--", "<a href='", "&amp;<", "<p><b>"):  # long malformed pages take time in proportion
        assert html_text.main_text(unit * 40_000) is not None
    assert html_text.main_text(f"<article>{f'<p>{prose}</p>' * 5000}</article>") == " ".join([prose] * 5000)


class Article(HTMLParser):
    """Another reading of pages that mark their article: what the standard library's parser says is in it."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.inside, self.skip = [], 0, 0
        self.feed(page)
        self.close()
        self.text = " ".join("".join(self.parts).split())

    def handle_starttag(self, tag, attrs):
        self.inside += tag in ("article", "main")
        self.skip += tag in ("script", "style", "nav", "form", "aside", "footer")
        self.handle_data(" " if tag in ("p", "br", "h1", "h2", "div", "li") else "")

    def handle_endtag(self, tag):
        self.handle_data(" " if tag in ("p", "h1", "h2", "div", "li") else "")
        self.inside -= tag in ("article", "main")
        self.skip -= tag in ("script", "style", "nav", "form", "aside", "footer")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(data)


def test_html_of_all_pages():
    pages = duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert len(pages) == 250 and all(html_text.main_text(page) == Article(page).text for (page,) in pages)


def test_html_of_other_languages():
    russian = "Сегодня утром жители города вышли на улицы, чтобы встретить весну и посмотреть на большой праздник у реки."
    polish = "Dzisiaj rano mieszkańcy miasta wyszli na ulice, żeby powitać wiosnę oraz zobaczyć wielkie święto nad rzeką."
    chinese = "今天早上城里的居民走上街头迎接春天，观看河边举行的盛大节日活动。" * 3
    for text in (russian, polish, chinese):
        page = f"<nav><a href=x>{text}</a></nav><div><h2>{text[:20]}</h2><p>{text[:30]}</p><p>{text}</p></div><ul><li><a href=y>{text}</a></ul><footer>{text}</footer>"
        assert html_text.main_text(page) == f"{text[:20].strip()} {text[:30].strip()} {text}"
    # a table between paragraphs in a covered language, and a paragraph in another script below an English one
    english = "This is the first paragraph of the article and it has many of the usual words that are in the language."
    table = "Length 20 cm, width 30 cm, height 40 cm, weight 5 kg, colour green, material oak, price 100 dollars"
    assert html_text.main_text(f"<p>{english}</p><table><tr><td>{table}</td></tr></table><p>{english}</p>") == f"{english} {table} {english}"
    assert html_text.main_text(f"<p>{english * 5}</p><nav>x</nav><p>{russian}</p><nav>x</nav>") == f"{english * 5} {russian}"


def test_merkle(spark, docs):
    assert rows(merkle.compare_with_next(docs.select("doc_id", "text"))) == sorted(merkle.brute_force(pairs()), key=str)
    one = merkle.compare_with_next(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0 and merkle.compare_with_next(docs.limit(0)).count() == 0
    tied = merkle.compare_with_next(docs.where("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long")))
    assert tied.count() == 3
    assert merkle.fingerprint(b"a\nb") != merkle.fingerprint(b"a\n\nb") and merkle.fingerprint(b"") != merkle.fingerprint(b"\n")


def test_merkle_trees():
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(f"{LOREM[k % 24]}{k}" for k in rng.integers(0, 100_000, n)).encode()
    near = lambda a, b: merkle.likeness(merkle.tree(a), merkle.tree(b))
    a, b = prose(130_000), prose(130_000)
    assert len(a) > 1_000_000 and near(a, b) < 0.02 and near(a, b"x" + a) > 0.9 and near(a, a[:500_000] + b"y" + a[500_000:]) > 0.99
    assert 0.3 < near(a, a[: len(a) // 2] + b[len(b) // 2 :]) < 0.7 and near(a, a) == 1
    paragraphs = [prose(100) for _ in range(12)]
    whole = b"\n".join(paragraphs)
    assert near(whole, b"\n".join(reversed(paragraphs))) > 0.98 and near(whole, whole.replace(b"\n", b"\n\n")) > 0.98  # moved or regrouped
    for text in (b"", b"\n", b"one", a, whole, whole.replace(b"\n", b"\n\n"), "é\n\n \n".encode() * 300, b"a" * 5000):
        assert merkle.decode(merkle.fingerprint(text)) == merkle.tree(text)
    # sections of four paragraphs: the branches are the edited ones, as a comparison of all pieces has it
    sections = [[prose(int(rng.integers(1, 60))) for _ in range(4)] for _ in range(9)]
    text = lambda x: b"\n\n".join(b"\n".join(p) for p in x)
    for s, p in ((0, 0), (4, 2), (8, 3)):
        edited = [list(x) for x in sections]
        edited[s][p] += b" more"
        found = merkle.branches(merkle.decode(merkle.fingerprint(text(sections))), merkle.tree(text(edited)))
        assert len(found) == 1 and (*found[0][0], found[0][1])[:2] == (s, p)
    edited = sections[:3] + [[b"new"] * 4] + sections[3:]
    assert merkle.branches(merkle.tree(text(sections)), merkle.tree(text(edited))) == [((), 3, 0, 1)]
    assert merkle.branches(merkle.tree(text(edited)), merkle.tree(text(sections))) == [((), 3, 1, 0)] and merkle.branches(merkle.tree(a), merkle.tree(a)) == []


def test_chat(spark):
    table = [
        (1, 0, "user", "How do I install the new printer driver?\nIt fails with code 5."), (1, 1, "assistant", "Please run the installer as an administrator. Then reboot the machine."),
        (1, 2, "user", "> Please run the installer as an administrator.\nDone, but still failing."), (1, 3, "assistant", "Bob wrote:\n> > How do I install the new  PRINTER driver?\n> Please run the installer as an administrator. Then reboot the machine.\n\nTry again now."),
        (1, 4, "user", ">It fails with code 5.\nThis is about code five."), (1, 5, "user", "no quote"), (1, 6, "assistant", "> never said this before at all\nhm"), (2, None, None, None), (2, 0, "user", ""), (None, 1, "user", "> x"), (3, 1, "user", "same"), (3, 1, "user", "same"),
    ]
    messages = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("linked", F.lit("clash"))
    found = chat.format_chats(messages).collect()
    one = {r.turn: r for r in found if r.conv_id == 1}
    assert [one[k].own_text for k in range(7)] == [table[0][3], table[1][3], "Done, but still failing.", "Try again now.", "This is about code five.", "no quote", "hm"]
    assert [(one[k].reply_to, one[k].linked, one[k].max_level) for k in range(7)] == [(None, False, 0), (0, False, 0), (1, True, 1), (1, True, 2), (0, True, 1), (4, False, 0), (5, False, 1)]
    assert sorted(one, key=lambda k: one[k].reply_order) == [0, 4, 5, 6, 1, 3, 2] and one[3].n_linked == 2 and one[5].formatted == "<|user|>\nno quote"
    assert len(found) == len(table) and chat.format_chats(messages.limit(0)).count() == 0
    plain = chat.format_chats(messages.where("not text like '%>%'"))
    assert [r.reply_order for r in plain.where("conv_id = 1").orderBy("turn").collect()] == [1, 2, 3]


def test_short_quotations(spark):
    said = ["Shall I send it?", "Yes, please.", "Which colour?", "好的。", "> Yes, please.\nSent.", "> 好的。\nGood.", "No. Wait.\nOK", "> ok\nFine", "> No.\nWhy?", "> Maybe\nSo", "> Never did I say this\n> OK\nhm"]
    table = [(1, k, "user", t) for k, t in enumerate(said)]
    found = {r.turn: r for r in chat.format_chats(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).collect()}
    assert [(found[k].reply_to, found[k].linked, found[k].n_linked) for k in range(4, 11)] == [(1, True, 1), (3, True, 1), (5, False, 0), (6, True, 1), (6, True, 1), (8, False, 0), (9, False, 0)]


def test_long_conversations(spark):
    """Turns of one conversation over many ranges, against a plain walk."""
    table = []
    for k in range(300):
        quote = f"> The statement of message number {k * 7 % 50} here.\n" if k % 3 == 0 and k > 60 else ""
        table.append((1, k, "user", f"{quote}The statement of message number {k} here."))
    table += [(None, k % 4, None, "same") for k in range(40)]
    messages = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(7)
    found = chat.format_chats(messages).collect()
    one = {r.turn: r for r in found if r.conv_id == 1}
    replies = {k: (k * 7 % 50 if k % 3 == 0 and k > 60 else k - 1 if k else None) for k in range(300)}
    assert {k: r.reply_to for k, r in one.items()} == replies and all(one[k].linked == (k % 3 == 0 and k > 60) for k in one)
    path, last = {}, None
    for k in range(300):
        if replies[k] is not None and replies[k] != k - 1:
            last = (*path[replies[k]][:-1], replies[k], k)
        path[k] = (*(last or ()), k)
    assert [k for k, _ in sorted(path.items(), key=lambda x: x[1])] == sorted(one, key=lambda k: one[k].reply_order)
    assert sorted(r.reply_order for r in found if r.conv_id is None) == list(range(1, 41)) and sorted(r.reply_order for r in one.values()) == list(range(1, 301))


TURNS = [(1, 0, "user", "How do I install it?"), (1, 1, "assistant", "Run the installer first."), (1, None, "user", "x"), (1, 2, "user", "> Run the installer first.\nDone."), (1, 3, "user", "> How do I install it?\nAgain.")]
APPLIED = {
    "urls": (url_filter, lambda s: s.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string"), url_filter.filter_urls),
    "mixing": (mixing, None, mixing.mix_sources), "substrings": (substring_dedup, None, substring_dedup.dedup_substrings), "languages": (language_id, None, language_id.identify_languages),
    "decontamination": (decontamination, None, lambda d: decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, " ".join(LOREM[2:14])), (2, "one")], "item_id long, text string"))),
    "html": (html_text, lambda s: s.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string"), html_text.extract_text), "chats": (chat, lambda s: s.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"), chat.format_chats),
}


@pytest.mark.parametrize("name", APPLIED)
def test_clashing_columns(spark, docs, name):
    """Whatever name a module uses may also be that of an input column: it stays as it is, or is replaced by an added column of that name."""
    module, make, apply = APPLIED[name]
    rows_in = make(spark) if make else docs
    names = {x for x in re.findall(r"[\"' .]([a-z_][a-z_0-9]*)[\"']", Path(module.__file__).read_text()) if x not in rows_in.columns}
    plain = apply(rows_in)
    added = [c for c in plain.columns if c not in rows_in.columns]
    clash = apply(rows_in.withColumns({c: F.lit("clash") for c in sorted(names)}))
    assert len(names) > 3 and rows(clash.select(plain.columns)) == rows(plain)
    kept = [c for c in names if c not in added]
    assert kept and {tuple(r) for r in clash.select(kept).distinct().collect()} == {("clash",) * len(kept)}


def test_url_trees_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = url_filter.filter_urls(pages.select("page_id", "url"), sample=500).withColumn("draw", F.xxhash64("url")).orderBy("draw").collect()
    labelled = [r for r in found if r.rule]
    right = [r.learned == r.verdict for r in labelled[500:]]
    most = max(sum(r.verdict == v for r in labelled[500:]) for v in ("allow", "block")) / len(right)
    print("held-out", len(right), sum(right) / len(right), "commonest", most)
    assert len(right) > 300 and sum(right) / len(right) >= most - 0.02
    assert all(r.verdict == r.learned for r in found if not r.rule)


def test_registry():
    assert {f"op{k}" for k in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and set(SQL) <= set(QUERIES)
