"""Long repetitive texts, hot keys, clashing columns, empty tables, and the operators that SQL cannot express against simulations of their own."""

import random
import subprocess
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import anchors, embedding, graph, lines, mixing, packing, pii, simhash, suffix, toxicity
from quarry.plans import session

LONG = """
import resource, pyarrow as pa, pyarrow.compute as pc
from quarry.llm import anchors, fmindex, suffix
def run(search, docs):
    packed = pa.Table.from_batches([anchors._packed({0: docs})])
    by = lambda t, c: [t.filter(pc.equal(t[c], v)) for v in sorted(set(t[c].to_pylist()))]
    marks = pa.concat_tables([search._mark(m) for m in by(search._distinct(8, 40)(packed), "bucket")])
    found = pa.concat_tables([search._answer(s) for s in by(search._send(8, 40)(packed, marks), "shard")])
    return search._remove(packed, found).to_pylist()
"""


@pytest.mark.parametrize("code", [
    "r = run(fmindex.WordRepeats(), [(1, b'x ' * 5_000_000)])[0]; assert r['n_removed'] == 5_000_000",
    "a, b = run(suffix.SuffixRepeats(), [(1, b'z' * 10_000_000), (2, b'a' + b'z' * 1000)]); assert a['n_removed'] == 0 and b['n_removed'] == 1000",
])
def test_long_repetitive_text(code):
    told = subprocess.run([sys.executable, "-c", LONG + code + "\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"], capture_output=True, text=True, check=True)
    assert int(told.stdout) < 1_500_000


@pytest.mark.parametrize("chunk,hot", [(97, 500), (1 << 19, 2), (64, 2)])
def test_suffix_dedup_of_hot_windows(spark, monkeypatch, chunk, hot):
    monkeypatch.setattr(anchors, "CHUNK", chunk)
    monkeypatch.setattr(anchors, "HOT", hot)
    rng = random.Random(5)
    parts = ["ab" * 60, "z" * 120, "".join(rng.choice("abc") for _ in range(90)), "".join(rng.choice("xyz") for _ in range(70)), "é" * 40]
    rows = [(i // 2 if i % 7 else None, "".join(rng.choice(parts) + rng.choice(["", "-", str(i)]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    first, last = {}, 1 << 62
    for i, t in sorted(rows, key=lambda r: last if r[0] is None else r[0]):
        b = t.encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], last if i is None else i)
    want = []
    for i, t in rows:
        b, gone = t.encode(), set()
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < (last if i is None else i):
                gone |= set(range(s, s + 50))
        want.append((str(i), bytes(c for k, c in enumerate(b) if k not in gone)))
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == sorted(want)


def test_pii_of_many_matches(spark):
    n = 20_000
    df = spark.createDataFrame([(1, " ".join(f"1.2.{i % 256}.{i // 256}" for i in range(n)))], "doc_id long, text string")
    pii.report(df).collect()
    start = time.perf_counter()
    r = pii.report(df).first()
    assert (r.n_ip, r.n_spans) == (n, n) and time.perf_counter() - start < 3
    ends = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",")]
    assert all(a[1] + 1 == b[0] for a, b in zip(ends, ends[1:]))


def test_pii_context_on_both_sides(spark):
    texts = ["SSN: 212-09-9999, 218-09-9998", "212-09-9999 (SSN)", "212-09-9999 " + "x" * 40 + " SSN", "212-09-9999", "tax 212-09-9999\n\n218-09-9998"]
    got = {r.doc_id: r.n_spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 2, 1: 1, 2: 0, 3: 0, 4: 2}


def test_mask_of_many_and_overlapping_spans(spark):
    many = "é😀 " + " ".join(f"x{i} 1.2.{i % 256}.{i // 256} " + "😀" * (i % 7) for i in range(20_000))
    # a mail address within the password that begins before it, a span at each end, no span, a long stretch without any
    texts = [many, "password=abc a@b.cc password=x.y@e.fg", "a@b.cc", "none", "a@b.cc" + "\n" * 5000 + "+1 234 567 8901", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for r, t in zip(pii.report(df).orderBy("doc_id").collect(), texts):
        out, at, t = [], 0, t or ""
        for kind, a, b in (s.split(":") for s in r.spans.split(",") if s):
            if int(a) >= at:
                out.append(t[at : int(a)] + f"<{kind}>")
            at = max(at, int(b))
        want.append("".join(out) + t[at:])
    start = time.perf_counter()
    assert [r.text for r in pii.mask(df).orderBy("doc_id").collect()] == want and time.perf_counter() - start < 10


@pytest.mark.parametrize("n", [1, 63, 64, 65, 4096, 9000])
def test_running_sums(spark, n):
    x = [(7 * i) % 11 for i in range(n)]
    got = spark.createDataFrame([(x,)], "x array<int>").select(pii.before_each(F.col("x")).alias("s")).first().s
    assert got == [sum(x[:i]) for i in range(n)] if n < 5000 else got == [0, *np.cumsum(x)[:-1].tolist()]


CLASH = "doc_id long, text string, source string, copies int, finish string, _size int, size int, _n int, n int, _row int, _key string, _gone int, gone int, _kept int, kept int, doc int, whole int, key int, n_dropped int, pass int, again int"


def clashing(spark, texts):
    names = [c.split()[0] for c in CLASH.split(", ")]
    return spark.createDataFrame([(i, t, "a", *[str(k) if k in (1, 7) else k for k in range(len(names) - 3)]) for i, t in enumerate(texts)], CLASH)


def test_clashing_columns(spark):
    df = clashing(spark, ["one two three", None, "", *(f"The same line\nown {chr(97 + i)} text" for i in range(24))])
    values = lambda d: {r.doc_id: tuple(r[c] for c in df.columns if c not in ("text", "n_dropped")) for r in d.collect()}
    for got in (mixing.mix(df), simhash.keep_one(df)):
        assert got.columns == df.columns and values(got).items() <= values(df).items()
    got = lines.drop_recurring(df)
    assert sorted(got.columns) == sorted(df.columns) and values(got) == values(df) and {r.n_dropped for r in got.where("doc_id > 2").collect()} == {1}


def test_nothing_and_all_null(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify(none, labels).count() == 0 and embedding.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("one_task", [5_000_000, 0])
def test_components_of_stars_and_chains(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    edges = [(0, i) for i in range(500, 900)] + [(i, i + 1) for i in range(100, 140)] + [(139, 700), (5, 5), (50, 51), (51, 50)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in [*range(500, 900), *range(100, 141)]} | {51: 50}
    assert got == want


def queue(rows, weights=(1, 2, 3), passes=3):
    """Weighted fair queueing by going through the queue: rows (doc_id, source, size, key); the copies that fit before the first one beyond the budget."""
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(passes * sizes[s] for s in full)
        target = {s: passes * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > passes * sizes[s]}
        if not over:
            break
        full |= over
    served, waiting = defaultdict(int), []
    for i, s, n, key in sorted(rows, key=lambda r: (r[3], r[0])):
        served[s] += n
        if n:
            waiting += [((served[s] + p * sizes[s]) / target[s], key, i, n) for p in range(passes)]
    taken, done = Counter(), 0
    for _, _, i, n in sorted(waiting):
        if done + n > total:
            break
        done += n
        taken[i] += n
    return taken


def test_mixing_is_a_queue(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 3, 20, 400 if i % 97 == 0 else 7]), rng.choice(["hot", "hot", "hot", "b", "c", "é", None])) for i in range(1500)]
    got = mixing.quotas(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = queue([(r.doc_id, r.source, r.size, r.key) for r in got])
    assert {r.doc_id: r.taken for r in got if r.taken} == dict(want)


def best_fit(sizes, caps, opening):
    """The same rules, looked up bin by bin."""
    top, left, bins, out = max(caps), sum(sizes), [], []
    pieces = sorted(((min(top, n - at), i, at) for i, n in enumerate(sizes) for at in range(0, n, top)), key=lambda p: (-p[0], p[1], p[2]))
    for n, i, at in pieces:
        left -= n
        fits = [(cap - used, b) for b, (cap, used) in enumerate(bins) if cap - used >= n]
        if fits:
            b = min(fits)[1]
        else:
            cost = lambda c: max(0, c - n - left) + opening * (n + min(left, c - n)) / c * (top / c)
            b = len(bins)
            bins.append((min((c for c in caps if c >= n), key=lambda c: (cost(c), c)), 0))
        out.append((i, at, n, b, bins[b][1]))
        bins[b] = bins[b][0], bins[b][1] + n
    return out, [min(c for c in caps if c >= used) for _, used in bins]


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, rng.randint(1, 20), rng.randint(1, 200)]) for _ in range(rng.randint(0, 120))]
    caps, opening = rng.choice([((16, 32, 64), 4), ((50,), 1), ((8, 100), 16)])
    assert packing.pack(sizes, caps, opening) == best_fit(sizes, caps, opening)


def test_packing_deals_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 50)
    df = spark.createDataFrame([(None, "a b c")] * 2030 + [(7, "a b c")] * 3 + [(8, None)] * 120, "doc_id long, text string")
    got = packing.pack_documents(df, (16, 64), shard_rows=100).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == {(None, 0, 0, 3): 2030, (7, 0, 0, 3): 3, (8, 0, 0, 0): 120}
    assert max(Counter(r.bin_id >> 32 for r in got if r.length).values()) <= 400
    held = Counter()
    for r in got:
        held[r.bin_id, r.capacity] += r.length
    assert all(n <= c for (b, c), n in held.items() if b >= 0)


@pytest.mark.parametrize("most,salts", [(500_000, 32), (0, 3)])
def test_lines_by_brute_force(spark, monkeypatch, most, salts):
    monkeypatch.setattr(lines, "BROADCAST_LEAVES", most)
    monkeypatch.setattr(lines, "SALTS", salts)
    rng = random.Random(12)
    pool = ["To be continued", "Page 1 of 9", "a b c d", "a b c e", "a b x d", " a\tb c  d ", "Les.", "", " ", "7", "q r 5 t", "q r 6 t"]
    rows = [(i if i % 9 else None, None if i == 3 else "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own{i} {rng.choice('uvw')} z" for _ in range(rng.randint(0, 9)))) for i in range(160)] + [(1000, "To be continued")] * 5
    least = 20
    masked = lambda x: tuple("<*>" if any(c in "0123456789" for c in w) else w for w in x.split())
    leaf = lambda ts: (len(ts), ts[:3])
    texts = {t for _, t in rows if t is not None}
    seen, has = defaultdict(set), defaultdict(set)
    for t in texts:
        for ts in map(masked, t.split("\n")):
            if ts:
                has[leaf(ts), ts].add(t)
                for k, w in enumerate(ts):
                    seen[leaf(ts), k, w].add(t)
    usual = lambda ts, k: ts[k] != "<*>" and len(seen[leaf(ts), k, ts[k]]) >= least
    form = lambda ts: (leaf(ts), tuple(w if usual(ts, k) else "<*>" for k, w in enumerate(ts)))

    def good(ts):
        same, digits = sum(usual(ts, k) for k in range(len(ts))), ts.count("<*>")
        return len(ts) > digits and same / (len(ts) - digits) >= 0.6 and same >= digits

    support = defaultdict(set)
    for (_, ts), held in has.items():
        if good(ts):
            support[form(ts)] |= held
    drop = lambda x: bool(masked(x)) and good(masked(x)) and len(support[form(masked(x))]) >= least
    want = sorted((str(i), str(None if t is None else "\n".join(x for x in t.split("\n") if not drop(x)))) for i, t in rows)
    got = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == want and sum(r.n_dropped for r in got) > 100


def test_vectors_in_lists_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(embedding, "MOST_CENTROIDS", 6)
    monkeypatch.setattr(embedding, "ROWS_PER_LIST", 40)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 24))
    v[600:] = v[:600] + rng.normal(size=(600, 24)) * rng.uniform(0, 0.2, 600)[:, None]
    v = v.astype(np.float32).astype(np.float64)
    label = rng.integers(0, 2, 1200)
    label[600:] = label[:600]
    u = v / np.sqrt((v * v).sum(1))[:, None]
    near = (u @ u.T >= 0.98) & (label[:, None] == label)
    q = embedding.Quantiser(v[:500], 30)
    assert len(q.first) == 6 and len(q.second) == 5
    got = {r.vec_id: r for r in embedding.cluster(spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label))], "vec_id long, embedding array<float>, label int")).collect()}
    want, found = near.sum(1) - 1, np.array([got[i].n_links for i in range(1200)])
    assert want.sum() > 400 and (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context._jsc

            @staticmethod
            def getCheckpointDir():
                return Context._jsc

            @staticmethod
            def isEmpty():
                return True

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


@pytest.mark.parametrize("rows", [10**4, 10**6, 10**8, 10**10])
def test_lanes_meet_at_every_size(rows):
    """Pairs that differ in 15 % of their bits, as texts 0.8 alike do, meet with the planned chance however many rows the plan is for."""
    rng = np.random.default_rng(4)
    plans = simhash._alike_plans(rng.integers(0, 1 << 63, (2000, simhash.ALIKE_LANES), np.uint64), rows)
    met = np.zeros(4000, bool)
    for groups in plans:
        differ = rng.random((4000, 64)) < 0.15
        assert len({b for bits, _ in groups for b in bits}) == sum(len(bits) for bits, _ in groups)
        for bits, t in groups:
            met |= differ[:, bits].sum(1) <= t
    assert met.mean() >= 0.95
