"""Toxicity by held-out accuracy; near-duplicate links against brute force; the pipeline on a small table."""

import os
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quarry.llm import embedding, simhash, toxicity

SF = "/root/testdata/sf0.01"


def components(n, adjacent):
    label = np.arange(n)
    while True:
        new = np.array([label[adjacent(i)].min() for i in range(n)])
        if (new == label).all():
            return label
        label = new


def test_toxicity(spark):
    rng = random.Random(3)
    bad = "grumpf zlorb vexxik".split()
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.4 else "".join(rng.choice(["on", "ti", "er", "an", "re", "st"]) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for w in bad * 2:
                text.insert(rng.randrange(len(text)), w)
        docs.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, "en"), (1001, "", "en")]
    got = toxicity.classify(spark.createDataFrame(docs, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id >= 1000}) == 1


def test_simhash(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(60)] for _ in range(40)]
    texts = [None, "", "one", "ONE", "one two three"]
    for w in base:
        for _ in range(rng.randint(1, 6)):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    got = {r.doc_id: r for r in simhash.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    prints = []
    for t in texts:
        w = (t or "").lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    fp = np.array(prints, np.uint64)
    want = components(len(fp), lambda i: np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4))
    assert [got[i].component_id for i in range(len(texts))] == want.tolist()


@pytest.mark.parametrize("rows", [10, 10**5, 10**7, 10**10])
def test_plan_is_complete(rows):
    sample = np.random.default_rng(2).integers(0, 1 << 63, 2000, np.uint64)
    groups = simhash.plan(sample, rows)
    bits = [b for g, _ in groups for b in g]
    assert len(bits) == len(set(bits)) and sum(t + 1 for _, t in groups) == simhash.RADIUS + 1


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre}
    while len(prints) < 120:
        prints.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fp = sorted(prints)
    df = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "little"))) for i, v in enumerate(fp)], "node long, fp binary")
    from quarry.llm.graph import components as linked

    got = {r.node: r.component for r in linked(simhash.links(df)).collect()}
    u = np.array(fp, np.uint64)
    want = components(len(u), lambda i: np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4))
    assert [got.get(i, i) for i in range(len(u))] == want.tolist()


@pytest.mark.parametrize("block", [500, 3])
def test_keep_one_by_exact_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "ALIKE_ROWS", block)
    rng = random.Random(8)
    texts = [None, "", " ", "one two", "ONE  two", "x " * 300 + "a b c d e f", "x " * 300 + "g h i j k l"]
    for k in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for n in [0, *rng.sample(range(1, 14), 5)]:
            v = list(base)
            for at in rng.sample(range(400), n):
                v[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    jaccard = np.array([[len(x & y) / len(x | y) if x | y else 1.0 for y in sets] for x in sets])
    want = components(len(texts), lambda i: np.flatnonzero(jaccard[i] >= 0.8))
    got = {r.doc_id: r.component_id for r in simhash.alike(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    label = np.array([got[i] for i in range(len(texts))])
    # nothing is linked that brute force does not connect
    assert all(want[i] == want[label[i]] for i in range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 0.8 <= jaccard[i, j] < 1]
    assert len(pairs) > 250 and sum(label[i] == label[j] for i, j in pairs) >= 0.97 * len(pairs)
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()} == set(label.tolist())


def test_keep_one_of_repeated_ids(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(100)) for c in "xyz")
    # id 5 stands for a copy of 2's text and for a text of its own, twice; the group of z has one row with an id
    rows = [(2, x, "a"), (5, x, "b"), (5, y, "c"), (5, y, "c"), (7, y + " more", "d"), (None, z, "e"), (9, z, "f"), (None, None, "g"), (None, None, "g"), (8, z + " more", "h")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.source, r.doc_id, r.text) for r in got if r.doc_id is not None) == [("a", 2, x), ("c", 5, y), ("h", 8, z + " more")]
    assert sorted(r.source for r in got if r.doc_id is None) == ["e", "g", "g"]


@pytest.mark.parametrize("rows", [1 << 19, 1 << 22, 1 << 26])
def test_recall_of_lanes_in_large_tables(spark, monkeypatch, rows):
    rng = np.random.default_rng(7)
    u = rng.integers(0, 1 << 63, (300, 8), np.uint64)
    for k in range(0, 300, 2):
        flip = rng.random((8, 64)) < 0.14
        u[k + 1] = u[k] ^ (flip.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    df = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(u)], "node long, fp binary")
    monkeypatch.setattr(type(df), "count", lambda self: rows)
    monkeypatch.setattr(simhash, "TASK_ROWS", 1 << 30)
    found = {(min(r), max(r)) for r in simhash.links(df, 512, 8).collect()}
    # 512 bits: whatever meets is linked
    assert len({p for p in found if p[0] % 2 == 0 and p[1] == p[0] + 1}) >= 0.88 * 150


@pytest.mark.parametrize("lists,block", [(2000, 4000), (20, 7)])
def test_embedding(spark, monkeypatch, lists, block):
    monkeypatch.setattr(embedding, "ROWS_PER_LIST", lists)
    monkeypatch.setattr(embedding, "BLOCK_ROWS", block)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16) * rng.choice([0, 0.1, 0.18])], int(i % 2)) for i in range(240)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [1.0, None] * 8, 1), (505, [], 1), (506, [float("inf")] * 16, 1)]
    got = {r.vec_id: r for r in embedding.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    v = np.array([np.array(r[1], np.float32) for r in rows[:240]], np.float64)
    v /= np.sqrt((v * v).sum(1))[:, None]
    label = np.array([r[2] for r in rows[:240]])
    near = (v @ v.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, True)
    want = components(240, lambda i: np.flatnonzero(near[i]))
    assert near.sum() > 1000
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(240)] == [(int(near[i].sum()) - 1, want[i], bool(want[i] == i)) for i in range(240)]
    assert all((got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True) for r in rows[240:])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = {i for i, t in labels.items() if t == 0}
    assert len(clean & kept[0]) >= 0.98 * len(clean) and len(kept[0] - clean) < 1000 - len(clean)
    assert kept[1] == kept[0] and kept[2] < kept[1] and kept[3] <= kept[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept[3]
    assert packed.agg({"length": "sum"}).first()[0] == sum(len((r.text or "").encode().split()) for r in docs.collect())
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
