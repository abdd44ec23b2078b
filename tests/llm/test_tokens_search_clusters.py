"""Token counts, ranked search and centroid clustering against brute force, and on odd tables."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from postmill.llm import dual_tree, lexical_search, token_counts
from postmill.llm.common import ALNUM

ODD = ["", "a", " ", "  x  y ", "aaaa" * 50, "\n\n a▁ b▁▁c", "日本語 テキスト" * 20, "é́\x00\x00b <s> </s> <unk> <|endoftext|> x", "   " * 40, "İstanbul ﬁn\tx\r\n", None]


@pytest.mark.parametrize("file", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_of_parts(file):
    """Texts cut at any length give the counts of the library for whole texts."""
    path = public_tokenizers.path(file)
    with open(path, "rb") as f:
        model = (token_counts.Words if file.endswith(".json") else token_counts.Pieces)(f.read())
    draw = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(draw.choice("ab \n▁é日<0x>A.'s") for _ in range(300)) for _ in range(60)] + ["a" * 100_000]
    whole = [model.lengths([t])[0] if t else 0 for t in texts]
    for part in (1, 2, 7, 50, 1000, 1 << 16):
        assert token_counts.lengths(iter(texts), model, part, 100).tolist() == whole
    cuts = list(token_counts._parts("word " * 4000, 100, model.cut))
    assert "".join(cuts) == "word " * 4000 and max(map(len, cuts)) < 110


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [(k, t) for k, t in enumerate(ODD)] + [(1, "a"), (None, "two words"), (50, "word " * 20_000)]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("batch", F.lit(1))
    found = token_counts.count_tokens(docs, path, part_chars=64)
    assert found.columns == ["doc_id", "text", "batch", "n_bytes", "n_tokens"]
    assert sorted((r.text or "", r.n_bytes, r.n_tokens) for r in found.collect()) == sorted((t or "", len((t or "").encode()), len(model.encode(t or ""))) for _, t in table)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from postmill.llm.registry import QUERIES

    wanted = {r.doc_id: len(model.encode(r.text)) for r in whole.select("doc_id", "text").collect()}
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()} == {d: (n, n > 4096) for d, n in wanted.items()}


def ranked(docs, items, k):
    """Every document of every item, by the formula."""
    own = [(d, (t or "").encode().translate(ALNUM).split()) for d, t in docs]
    counts = [(d, len(w), Counter(w)) for d, w in own if w]
    n, total = len(counts), sum(x[1] for x in counts)
    df = Counter(w for _, _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, long, c in counts:
            m = 100 - 75 + 75 * long * n // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in (text or "").encode().translate(ALNUM).split() if c[w]), math.inf if d is None else d))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return out


@pytest.mark.parametrize("block,sent", [(128, 4 << 20), (2, 1 << 9)])
def test_ranked_search(spark, monkeypatch, block, sent):
    """Also with many small shards and blocks: copies, ties, repeats, null ids and texts, long texts."""
    monkeypatch.setattr(lexical_search, "slices", lambda batches, column, f=lexical_search.slices: f(batches, column, sent))
    monkeypatch.setattr(lexical_search, "BLOCKS", 2)
    monkeypatch.setattr(lexical_search, "PIECE", 50)
    draw = random.Random(4)
    words = [f"w{k}" for k in range(300)] + ["É", "é", "Straße", "日本"]
    text = lambda n: " ".join(draw.choice(words[: draw.choice([5, 40, 304])]) for _ in range(n))
    docs = [(k, text(draw.randrange(1, 120))) for k in range(300)] + [(1000 + k, "w1 w2 copy") for k in range(150)] + [(7, "w1 W2 copy"), (None, "w1-w2,copy"), (None, None), (3000, ""), (3001, "!? --"), (3002, text(30_000))]
    draw.shuffle(docs)
    items = [(k, text(draw.randrange(1, 40))) for k in range(12)] + [(12, "w1 w2 copy w1"), (12, "w1 w2 copy w1"), (None, "É"), (14, None), (15, ""), (16, "absent"), (17, text(3000))]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("rank", "_item", "term", "many", "weight", "block")}), 10, block)
    assert found.columns == ["item_id", "_item", "term", "many", "weight", "block", "doc_id", "score", "rank"] and {tuple(r) for r in found.select("_item", "term", "many", "weight", "block").distinct().collect()} == {("clash",) * 5}
    assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == sorted(ranked(docs, items, 10), key=str)


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a"), (2, "z")], "item_id long, text string")
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == [(1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 8 * 100)), 1)]
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0 and lexical_search.search(docs.where("doc_id = 2"), items).count() == 0


def test_bounds_spare_documents():
    """Of a shard's documents only those whose bound reaches the kth are scored exactly, and the exact scores lie between the bounds."""
    draw = random.Random(2)
    texts = [" ".join(draw.choice([f"w{k}" for k in range(60)]) for _ in range(draw.randrange(5, 90))).encode() for _ in range(2000)]
    hashes, ends, docs, tf, n = lexical_search.postings(texts)
    m = lexical_search.lengths(n, len(n), int(n.sum()))
    exact = lexical_search.impacts(tf, m[docs])
    upward = -(-exact // lexical_search.STEP)
    assert upward.max() < 256 and (upward * lexical_search.STEP >= exact).all() and ((upward - 1) * lexical_search.STEP < exact).all()
    row = {"terms": hashes.tobytes(), "ends": lexical_search.packed(ends), "docs": lexical_search.packed(docs), "impacts": upward.astype(np.uint8).tobytes(), "tf": lexical_search.packed(tf), "m": lexical_search.packed(m), "ids": list(range(2000))}
    asked = np.sort(np.array([lexical_search.xxhash.xxh3_64_intdigest(w) for w in (b"w3", b"w7", b"w9", b"w11")], np.uint64).view(np.int64))
    block = lexical_search.Block(memoryview(np.stack([asked, np.zeros(4, np.int64), np.full(4, 1000)]).tobytes()))
    (_, found, scores), = lexical_search.Shard(row).search(block, 10, np.zeros(1, np.int64))
    assert 10 <= len(found) < 200 and sorted(scores)[-1] > 0


def plain(rows, k, rounds, size, seed="2:"):
    """Lloyd's rounds with Python's own numbers."""
    import hashlib

    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in hashed[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=str), centroids


@pytest.mark.parametrize("block", [7, 2048])
def test_clusters(spark, block):
    """Copies, ties, negative and large components, vectors to leave out; with blocks of any size."""
    rng = np.random.default_rng(3)
    near = [(k, (rng.integers(-3, 4, 3) * 2.5 + rng.normal(0, 0.01, 3)).tolist()) for k in range(150)]
    table = near + [(200 + k, [1.0, 1.0, -1.0]) for k in range(60)] + [(300, [0.0, 0.0, 0.0]), (301, [1.0, 0.0, 0.0]), (302, [0.5, 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (303, [2.0e5, -2.0e5, 1.0]), (303, [2.0e5, -2.0e5, 1.0])]
    table += [(400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 2.0]), (404, [float("nan"), 0.0, 0.0]), (405, [float("inf"), 0.0, 0.0]), (406, [1.0] * 4)]
    vectors = spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in table], "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("v", "a", "h", "cluster")})
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    for k, rounds in ((1, 1), (9, 4), (500, 2)):
        found, centroids = dual_tree.cluster(vectors, k, rounds, 3, block=block)
        wanted, means = plain(rows, k, rounds, 3)
        assert centroids.tolist() == means and sorted((tuple(r) for r in found.collect()), key=str) == wanted
    found, centroids = dual_tree.cluster(vectors.where("vec_id = 400"), 3, 2, 3)
    assert found.count() == 0 and len(centroids) == 0


def test_pruning_and_trees():
    """Cover trees hold what they promise, and walking two of them spares nearly all distances where vectors lie in groups."""
    rng = np.random.default_rng(8)
    middles = rng.integers(-4000, 4000, (60, 16))
    points = np.unique(np.repeat(middles, 30, 0) + rng.integers(-20, 21, (1800, 16)), axis=0)
    tree, order = dual_tree.grow(points)
    points = points[order]
    for k in range(len(tree.point)):
        own, d = points[tree.lo[k] : tree.hi[k]], np.sqrt(dual_tree.squares(points[tree.lo[k] : tree.hi[k]], points[tree.point[k] : tree.point[k] + 1]))
        assert len(own) and d.max() <= tree.radius[k] and (tree.many[k] > 0) == (len(own) > 1)
        if tree.many[k]:
            kids = np.arange(tree.first[k], tree.first[k] + tree.many[k])
            centers = points[tree.point[kids]]
            gaps = np.sqrt(dual_tree.squares(centers, centers))[np.triu_indices(len(kids), 1)]
            assert tree.point[kids[0]] == tree.point[k] and (tree.radius[kids] <= tree.radius[k] / 2).all() and (gaps > tree.radius[k] / 2).all() and tree.lo[kids[0]] == tree.lo[k] and tree.hi[kids[-1]] == tree.hi[k]
    to, found = dual_tree.nearest(tree, points, dual_tree.Centroids(middles))
    assert (to == dual_tree.squares(points, middles).argmin(1)).all() and found < 0.1 * len(points) * len(middles)
    far = np.array([[1 << 26, -(1 << 26)], [-(1 << 26), 1 << 26]])
    assert dual_tree.squares(far, far).tolist() == [[0, 2 << 54], [2 << 54, 0]]
