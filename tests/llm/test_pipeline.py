"""The stages on a small table, against what each must keep."""

import corpus_pipeline
from postmill.llm import neardup
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    words = [f"{'the and of to in'.split()[k % 5]} word{k}" for k in range(60)]
    text, passage = " ".join(words), " ".join(f"passage{k}" for k in range(55))
    docs = [(1, text + " tail", "en"), (2, text, "en"), (3, "12 34", "en"), (4, " ".join(f"four{k}" for k in range(40)) + " " + passage, "en"), (5, " ".join(f"five{k}" for k in range(40)) + " " + passage, "en"), (6, "the text of the item " + " ".join(f"item{k}" for k in range(12)), "en"), (7, None, "en"), (8, "der hund und die katze", "de")]
    table = spark.createDataFrame([(d, t, lang, f"s{d % 2}", len(t or "")) for d, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, now = {}, table
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = {r.doc_id: r.text for r in now.collect()}
        assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == table.columns
    assert set(kept["language_id"]) == {1, 2, 4, 5, 6, 8} and set(kept["near_dedup"]) == {1, 4, 5, 6, 8}
    assert kept["substring_dedup"] == {**{k: kept["near_dedup"][k] for k in (1, 4, 6, 8)}, 5: " ".join(f"five{k}" for k in range(40))}
    assert set(kept["decontamination"]) == {1, 4, 5, 8} and set(kept["mixing"]) <= {1, 4, 5, 8}
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.sort_array(F.collect_list("doc_id"))).first()[0] == sorted(kept["mixing"])


NAMES = ["lang_pred", "score", "n_words", "n_removed", "kept", "n_hit", "item_ids", "hit_spans", "_gone", "_doc", "_places", "_row", "key", "component_id", "digest", "node", "root", "size_", "_own_kept"]


def test_stages_of_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, and extra columns of all names that the stages use: these stay as they are."""
    english = "the cat and the dog are in the house of my friend and they have all that is good for them"
    docs = [(1, english, "en", "a"), (1, english, "en", "a"), (None, english, "en", None), (None, None, None, None), (2, "", "en", "b"), (3, english + " too", "en", "b"), (4, " ".join(f"item{k}" for k in range(12)), "en", "a")]
    table = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in NAMES})
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, empty = table, table.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        if name != "mixing":
            assert now.columns == table.columns and {tuple(r) for r in now.select(NAMES).distinct().collect()} == {("clash",) * len(NAMES)}, name
    assert sorted((r.doc_id is None, r.doc_id) for r in now.collect()) == [(False, 1), (False, 1), (True, None)]


def test_near_duplicates_of_all_documents(spark):
    """Every link of the brute-force version is found: a recall of 1."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    wanted = neardup.brute_force([tuple(r) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == wanted and len(set(wanted.values())) < len(wanted)


def test_pivots_link_before_the_set_join(spark, monkeypatch):
    """The pipeline's near-duplicates come from SimHash pivots first; what they link is verified, and the set join finds what they don't."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words, "tail"]), " ".join(words[:365]), " ".join(f"x{k}" for k in range(50)), " ".join(f"x{k}" for k in range(50)) + " ", "", None]
    docs, found, own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], neardup.pivot_pairs
    monkeypatch.setattr(neardup, "pivot_pairs", lambda *of: found.append(own(*of)) or found[-1])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {d for d, root in neardup.brute_force(list(enumerate(texts))).items() if d == root} == {0, 3, 5}
    assert len(found) == 1
    pairs = {tuple(r) for r in neardup.pivot_pairs(docs, docs.select(F.col("doc_id").alias("node")), 5, neardup.new_dir(spark, "pairs")).collect()}
    assert {(0, 1), (3, 4), (5, 6)} <= pairs and (0, 3) not in pairs


def test_near_dedup_shuffles_few_bytes(spark, monkeypatch):
    """Where nothing is broadcast, no text is shuffled for its fingerprint, and of the sets only those that later rounds may compare are kept; the result stays."""
    texts = [" ".join(f"{'abcdef'[k % 6]}{i}" for i in range(80)) + (f" tail{k}" if k > 5 else "") for k in range(18)] + [" ".join(f"only{k} w{i}" for i in range(40)) for k in range(40)] + [None]
    docs, plans, own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {}, neardup.stash
    explained = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
    monkeypatch.setattr(neardup, "stash", lambda df, name, home=None: plans.setdefault(name, []).append(explained(df._jdf.queryExecution(), "formatted")) or own(df, name, home))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == neardup.brute_force(list(enumerate(texts))) and len(set(found.values())) == 47
    shuffled = [line for part in plans["prints"][0].split("\n\n") if ") Exchange" in part for line in part.split("\n") if line.startswith("Input")]
    assert shuffled and not any("text#" in line for line in shuffled)
    assert len(plans["open-sets"]) == 1 and not any("/sets-" in plan for plan in plans["near"][1:])
