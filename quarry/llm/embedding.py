"""Near-duplicate vectors by product quantisation.

A coarse quantiser of two levels deals unit vectors to inverted lists: a list is a label, a centroid and, in large tables, a centroid of what the
first one leaves over, so that lists grow in number and not in size. A vector is stored in its list as the codes of
its residual in SUBSPACES subspaces and the length of what the codes leave out. A query meets the lists it probes through a
table of distances for each subspace; what the summed table entries and the stored length can't rule out is compared by exact cosine in double
precision. That test only rules out what can't be a link.

The probes are sufficient up to a stated chance. If two vectors are in different cells of a level, each is at least as far from the other as from the plane between the two
centroids, and a list is probed if its plane is nearer than a reach. The widest reach that can matter is the distance of two vectors that are exactly ``least`` alike, but in many
dimensions hardly a pair lies straight across a plane, and that reach probes nearly all lists. So the reach of each level is measured: pairs
``least`` alike, in random directions, are made of the sample, and the reach is such that no more than MISSED of them is lost, with a quarter added. Pairs more alike are closer and lost less often. A
table of one list is searched completely.

Equal vectors of a label are one row of the search. A task returns the number of links of each of its vectors and a spanning
forest, never the pairs. The quantiser is fitted on a bounded sample and indexes every row.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, link with nothing;
vectors of different lengths don't link; equal rows link with each other; a null vec_id keeps its row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import blocks, components, forest, union

LEAST = 0.98
SUBSPACES = 8
CODES = 16
#: Bounds: rows the quantiser is fitted on, centroids of a level, indexed rows of a block, rows of a task.
SAMPLE_ROWS = 20_000
MOST_CENTROIDS = 1024
ROWS_PER_LIST = 1000
BLOCK_ROWS = 4000
TASK_ROWS = 20_000
SLACK = 1e-6
#: Share of pairs exactly ``least`` alike that a level's reach may lose, and how many such pairs it is measured on.
MISSED = 0.0002
TRIAL_ROWS = 16_384


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        full = n > 0
        c[full] = total[full] / n[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def _apart(c: np.ndarray) -> np.ndarray:
    """Distances of centroids."""
    size = (c * c).sum(1)
    return np.sqrt((size[:, None] - 2 * c @ c.T + size).clip(0))


class Quantiser:
    """Centroids of two levels and residual codebooks for vectors of one length. A cell is a number: first * seconds + second."""

    def __init__(self, sample: np.ndarray, lists: int, least: float = LEAST):
        x = unit(sample)
        self.first = kmeans(x, max(1, min(MOST_CENTROIDS, lists)))
        at = nearest(x, self.first)
        self.second = np.zeros((1, x.shape[1])) if lists <= MOST_CENTROIDS else kmeans(x - self.first[at], min(MOST_CENTROIDS, -(-lists // MOST_CENTROIDS)), seed=7)
        self.apart = [_apart(self.first), _apart(self.second)]
        rest = x - self.centre(self.cells(x))
        self.cuts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        self.books = [kmeans(rest[:, c], CODES, seed=6) for c in self.cuts]
        self.reach = self._measured(np.resize(x, (TRIAL_ROWS, x.shape[1])), least)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a = nearest(x, self.first)
        return a * len(self.second) + nearest(x - self.first[a], self.second)

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.first[cell // len(self.second)] + self.second[cell % len(self.second)]

    @staticmethod
    def _planes(x: np.ndarray, c: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """How far each vector is from the plane between its own centroid and each other one; 0 for its own."""
        d = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).clip(0)
        own = d.argmin(1)
        gap = 2 * apart[own]
        return np.where(gap > 0, (d - d[np.arange(len(x)), own][:, None]) / np.where(gap > 0, gap, 1), 0.0)

    def _measured(self, x: np.ndarray, least: float) -> list[float]:
        """For each level how near a plane a vector has to be for the cell behind it to be probed."""
        rng = np.random.default_rng(8)
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(1)[:, None] * x
        y = least * x + np.sqrt(1 - least * least) * side / np.sqrt((side * side).sum(1))[:, None]
        widest, out = float(np.sqrt(2 - 2 * least)), []
        rest_x, rest_y = x, y
        for c, apart in zip((self.first, self.second), self.apart):
            # the second level is entered by the cell that the other vector is in
            there = nearest(rest_y, c)
            across = self._planes(rest_x, c, apart)[np.arange(len(x)), there]
            out.append(min(widest, 1.25 * float(np.quantile(across, 1 - MISSED))))
            rest_x, rest_y = rest_x - c[there], rest_y - c[there]
        return out

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far the coded vectors are from the true ones."""
        rest = x - self.centre(cell)
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books)], 1)
        left = rest.copy()
        for m, (c, b) in enumerate(zip(self.cuts, self.books)):
            left[:, c] -= b[codes[:, m]]
        return codes.astype(np.uint8), np.sqrt((left * left).sum(1))

    def probes(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for the lists after a row's own that it is to be compared with: of a pair in two lists the vector in the lower one asks."""
        who, a = np.nonzero(self._planes(x, self.first, self.apart[0]) <= self.reach[0])
        if len(self.second) == 1:
            far = a
        else:
            out = []
            for i in range(0, len(who), 4096):
                w, f = who[i : i + 4096], a[i : i + 4096]
                r, b = np.nonzero(self._planes(x[w] - self.first[f], self.second, self.apart[1]) <= self.reach[1])
                out.append((w[r], f[r] * len(self.second) + b))
            who, far = (np.concatenate(o) for o in zip(*out)) if out else (who, a)
        after = far > cell[who]
        return who[after], far[after]

    def tables(self, q: np.ndarray, of: int) -> list[np.ndarray]:
        """For each subspace the squared distances of the queries' residuals in list ``of`` to each codeword."""
        rest = q - self.centre(np.array([of]))
        return [((rest[:, c][:, None] - b[None]) ** 2).sum(2) for c, b in zip(self.cuts, self.books)]


INDEX = "label int, dim int, list int, own boolean, cls long, n long, vector binary, codes binary, err double"


def _indexer(bound):
    def run(batches):
        quantisers = bound.value
        for batch in batches:
            single, double = np.float32, np.float64
            label, cls, n, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "cls", "n", "dim"))
            vectors = batch.column("embedding").to_pylist()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                q = quantisers[int(dim)]
                raw = np.array([vectors[i] for i in rows], single if pa.types.is_float32(batch.schema.field("embedding").type.value_type) else double)
                for i in range(0, len(rows), 2048):
                    some, x = rows[i : i + 2048], unit(raw[i : i + 2048])
                    at = q.cells(x)
                    codes, err = q.encode(x, at)
                    yield _listed(label[some], dim, at, True, cls[some], n[some], raw[i : i + 2048], codes, err)
                    who, where = q.probes(x, at)
                    if len(who):
                        yield _listed(label[some][who], dim, where, False, cls[some][who], n[some][who], raw[i : i + 2048][who], None, None)

    return run


def _listed(label, dim, at, own, cls, n, raw, codes, err) -> pa.RecordBatch:
    k = len(cls)
    vector = [r.tobytes() for r in np.ascontiguousarray(raw)]
    return pa.record_batch({
        "label": pa.array(label, pa.int32()), "dim": pa.array(np.full(k, dim), pa.int32()), "list": pa.array(at, pa.int32()), "own": pa.array(np.full(k, own)),
        "cls": pa.array(cls, pa.int64()), "n": pa.array(n, pa.int64()), "vector": pa.array(vector, pa.binary()),
        "codes": pa.array([c.tobytes() for c in codes] if codes is not None else [None] * k, pa.binary()), "err": pa.array(err if err is not None else [None] * k, pa.float64()),
    })


def _linker(bound, least: float, reach: float):
    def run(table: pa.Table) -> pa.Table:
        quantisers = bound.value
        table = table.sort_by([(c, "ascending") for c in ("dim", "label", "list", "block", "cls")])
        key = np.stack([table.column(c).to_numpy() for c in ("dim", "label", "list", "block")], 1)
        role, own, cls, n = (table.column(c).to_numpy() for c in ("role", "own", "cls", "n"))
        vectors, codes = table.column("vector").to_pylist(), table.column("codes").to_pylist()
        err = table.column("err").to_numpy()
        ids, node = np.unique(cls, return_inverse=True)
        parent, links = np.arange(len(ids)), np.zeros(len(ids))
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        for a, b in zip(start, np.r_[start[1:], len(cls)]):
            rows = np.arange(a, b)
            stored, asking = rows[role[a:b] != 1], rows[role[a:b] != 2]
            if len(rows) < 2 or not len(stored):
                continue
            dim, _, of, _ = (int(v) for v in key[a])
            q = quantisers[dim]
            read = lambda rows: np.frombuffer(b"".join(vectors[i] for i in rows), kind).reshape(len(rows), dim).astype(np.float64)
            kind = np.float32 if len(vectors[stored[0]]) == 4 * dim else np.float64
            s = read(stored)
            code = np.frombuffer(b"".join(codes[i] for i in stored), np.uint8).reshape(len(stored), -1)
            norm = np.sqrt((s * s).sum(1))
            step = max(1, 2_000_000 // len(stored))
            for i in range(0, len(asking), step):
                some = asking[i : i + step]
                v = read(some)
                length = np.sqrt((v * v).sum(1))
                d = np.zeros((len(some), len(stored)))
                for m, t in enumerate(q.tables(v / length[:, None], of)):
                    d += t[:, code[:, m]]
                maybe = np.sqrt(d) <= reach + err[stored] + SLACK
                # two vectors of one list meet once
                maybe &= ~(own[some][:, None] & (cls[some][:, None] <= cls[stored][None]))
                p, x = np.nonzero(maybe)
                for j in range(0, len(p), 200_000):
                    pj, xj = p[j : j + 200_000], x[j : j + 200_000]
                    hit = (v[pj] * s[xj]).sum(1) / (length[pj] * norm[xj]) >= least
                    u, w = node[some[pj[hit]]], node[stored[xj[hit]]]
                    links += np.bincount(u, n[stored[xj[hit]]], len(ids)) + np.bincount(w, n[some[pj[hit]]], len(ids))
                    parent = union(parent, u, w)
        child, root = forest(ids, parent)
        some = np.flatnonzero(links)
        none = np.zeros(len(child), np.int64)
        return pa.table({"a": np.r_[ids[some], child], "b": np.r_[ids[some], root], "n": np.r_[links[some].astype(np.int64), none]})

    return run


def search(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """(label, dim, embedding, cls, n), cut, to (a, b, n): n > 0 is a part of the number of links of a; n = 0 a link of a spanning forest."""
    spark = classes.sparkSession
    reach = float(np.sqrt(2 - 2 * least))
    counts = classes.groupBy("dim").count().collect()  # one row for each length of a vector
    quantisers = {}
    for dim, rows in counts:
        sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("cls")).limit(SAMPLE_ROWS).select("embedding").collect()
        quantisers[dim] = Quantiser(np.array([r.embedding for r in sample], np.float64), max(1, rows // ROWS_PER_LIST), least)
    total = sum(r["count"] for r in counts)
    bound = spark.sparkContext.broadcast(quantisers)  # at most 2 * MOST_CENTROIDS centroids with their distances and CODES codewords a length
    listed = classes.select("label", "cls", "n", "dim", "embedding").mapInArrow(_indexer(bound), INDEX)
    dealt = blocks(listed, ["label", "dim", "list"], "cls", BLOCK_ROWS)
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("label", "dim", "list", "block"), F.lit(max(12, total * 8 // TASK_ROWS))))
    return dealt.groupBy("task").applyInArrow(_linker(bound, least, reach), "a long, b long, n long")


def cluster(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    parts = F.transform(F.col("embedding").cast("array<double>"), lambda x: x)
    finite = F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists(parts, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"), "embedding", usable.alias("usable"))
    good = rows.where("usable")
    classes = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")).withColumn("cls", F.monotonically_increasing_id()))
    found = cut(search(classes, least))
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("others"))
    of = components(found.where("n = 0").select("a", "b"))
    roots = classes.join(of, classes["cls"] == of["node"], "left").join(counts, F.col("cls") == F.col("a"), "left")
    roots = roots.select("label", "embedding", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("root"))
    least_id = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    marked = good.select("vec_id", "label", "embedding").join(roots.join(least_id, "root").select("label", "embedding", "n_links", "component_id"), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return marked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
