"""SimHash near-duplicates, found by the generalised pigeonhole principle.

A fingerprint's bits are set by majority over the 64-bit hashes of a text's word shingles. To link all fingerprints at most ``radius`` bits
apart, the 64 positions are cut into groups of correlated bits, and each group g gets a threshold t(g) such that the sum of t(g) + 1 is
radius + 1: two fingerprints within the radius agree to within t(g) bits in at least one group. The groups and thresholds are chosen by
dynamic programming on candidate counts estimated from a bounded sample of fingerprints; any choice finds every link. Each fingerprint is
indexed under its value in each group and probes the values within the threshold; candidates are verified on all bits.

Texts that share only most of their shingles differ in a share of their bits (at a Jaccard similarity of 0.8, 15 %), beyond what
thresholds on 64 bits can find at any size. For them (``alike``) fingerprints are made of the distinct shingles and have several lanes of 64
bits. Thresholds that find every pair within so wide a radius would need hundreds of probes, so they are planned for a chance: the same dynamic
programming gives the groups of all lanes unequal thresholds of the least estimated cost (probes and candidates) with which texts
that are 0.8 alike meet with a chance of 1 - ALIKE_MISSED or more, in a table of any size. With more rows it chooses wider groups and higher thresholds. Pairs that meet and
differ in at most ALIKE_RADIUS bits, which refuses one in a thousand at 0.8, only say
which texts to look at: texts that they connect are compared with each other by the Jaccard similarity of their shingles, which decides.

Copies share a fingerprint (in ``alike`` a set of shingles) and are one row of the search. A task links the fingerprints of its values and
returns a spanning forest, never the pairs. Texts connected by candidates are compared block by block; those already linked aren't compared again.

Defined results: a null or blank text has fingerprint 0 and is linked like any other; fewer words than a shingle make one shingle; equal rows keep a
row each; a null doc_id keeps its row and its group but can't name one; an empty table gives an empty result; other columns are
ignored by ``fingerprints`` and kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .anchors import mixed
from .graph import EDGES, blocks, components, forest, union

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Bounds: fingerprints looked at to plan the groups, indexed rows of a block, probe rows of a task.
SAMPLE_ROWS = 4000
BLOCK_ROWS = 20_000
TASK_ROWS = 200_000
#: For texts that share most of their shingles: words in a shingle, least Jaccard similarity, lanes, bits that candidates may differ in (at 0.8 it
#: is 78 of 512 on average with a deviation of 8: a share of ALIKE_BITS), groups that a lane may be cut into, most flips that a group may be probed with, chance to miss a
#: pair that is just alike enough.
ALIKE_SHINGLE = 5
ALIKE = 0.8
ALIKE_LANES = 8
ALIKE_RADIUS = 104
ALIKE_BITS = 0.15
ALIKE_GROUPS = (2, 3, 4, 5, 6)
ALIKE_FLIPS = 2
ALIKE_MISSED = 0.04
#: What a row that is sent costs, in comparisons of two fingerprints.
ROW_COST = 100
#: Texts of a block that is compared with another one, shingles that are sent to a task (8 bytes each).
ALIKE_ROWS = 500
ALIKE_TASK_SHINGLES = 2_000_000


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(text: str | None, width: int = SHINGLE, lanes: int = 1) -> bytes:
    """Eight bytes for each lane, little-endian."""
    return _fingerprint(shingle_hashes(text, width), lanes)


def _fingerprint(h: np.ndarray, lanes: int) -> bytes:
    if not len(h):
        return bytes(8 * lanes)
    return b"".join(_majority(h if lane == 0 else mixed(h + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))) for lane in range(lanes))


def _majority(h: np.ndarray) -> bytes:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # counts of a block fit into a byte
        ones += np.unpackbits(h[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def _hash_batches(width: int, lanes: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.drop_columns(["text"]).append_column("fp", pa.array([fingerprint(t.as_py(), width, lanes) for t in texts], pa.binary()))

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE, lanes: int = 1) -> DataFrame:
    """(doc_id, fp)."""
    return docs.select("doc_id", "text").mapInArrow(_hash_batches(width, lanes), "doc_id long, fp binary")


Plan = list[tuple[list[int], int]]  #: groups: bit positions, threshold


def plan(sample: np.ndarray, rows: int, radius: int = RADIUS) -> Plan:
    """Groups of correlated bits and thresholds of least estimated cost for ``rows`` distinct fingerprints."""
    bits = (sample[:, None].astype(np.uint64) >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    ones = bits.mean(0) if len(sample) else np.full(64, 0.5)
    differ = 2 * ones * (1 - ones)
    spread = bits - ones
    size = np.sqrt((spread**2).sum(0)) + 1e-9
    near = np.abs(spread.T @ spread / np.outer(size, size)) if len(sample) else np.eye(64)
    k = len(sample) // 2 * 2
    pairs = bits[:k:2], bits[1:k:2]
    best: tuple[float, Plan] | None = None
    for m in range(2, radius + 2):
        groups = _grouped(near, differ, m)
        cost = np.full((m, radius + 1), np.inf)
        for g, group in enumerate(groups):
            share = _within(differ[group], radius)
            apart = (pairs[0][:, group] != pairs[1][:, group]).sum(1) if k else np.empty(0)
            for t in range(radius + 1):
                probes = sum(comb(len(group), d) for d in range(t + 1))
                seen = max(share[t], (apart <= t).mean() if k >= 1000 else 0.0)
                cost[g, t] = rows * probes * 1.0 + rows * rows / 2 * seen * 0.05
        # least[j]: the cheapest way to give the groups so far thresholds with sum of t + 1 equal to j; a group may get none
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for g in range(m):
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for j, (c, ts) in least.items():
                for t in range(-1, radius + 1 - j):
                    d = c + (cost[g, t] if t >= 0 else 0.0), (*ts, t)
                    if j + t + 1 not in new or d < new[j + t + 1]:
                        new[j + t + 1] = d
            least = new
        c, ts = least[radius + 1]
        if best is None or c < best[0]:
            best = c, [(sorted(g), t) for g, t in zip(groups, ts) if t >= 0]
    return best[1]


def _grouped(near: np.ndarray, differ: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size: each takes in turn the free bit most correlated with it."""
    free = set(range(64))
    groups: list[list[int]] = []
    for _ in range(m):
        first = min(free, key=lambda b: (near[b, [x for g in groups for x in g]].sum() if groups else -differ[b], b))
        groups.append([first])
        free.discard(first)
    while free:
        for g in groups:
            if free:
                b = max(free, key=lambda b: (near[b, g].mean(), -b))
                g.append(b)
                free.discard(b)
    return groups


def _within(p: np.ndarray, radius: int) -> np.ndarray:
    """Chance that at most 0, 1, ... radius independent bits differ."""
    at = np.zeros(radius + 1)
    at[0] = 1.0
    for x in p:
        at[1:] = at[1:] * (1 - x) + at[:-1] * x
        at[0] *= 1 - x
    return np.cumsum(at)


def _correlated(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a lane's bits the correlations, and how often two fingerprints differ in each."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    ones = bits.mean(0) if len(bits) else np.full(64, 0.5)
    spread = bits - ones
    size = np.sqrt((spread**2).sum(0)) + 1e-9
    return np.abs(spread.T @ spread / np.outer(size, size)) if len(bits) else np.eye(64), 2 * ones * (1 - ones)


def _alike_plans(samples: np.ndarray, rows: int) -> list[Plan]:
    """For each lane groups of correlated bits and thresholds, of least estimated cost for ``rows`` fingerprints among those with which a pair that is just alike
    enough is missed by all groups with a chance of ALIKE_MISSED at most. Groups are taken to miss independently of each other."""
    unit = 0.02
    need = int(np.ceil(-np.log(ALIKE_MISSED) / unit))
    lanes = [_correlated(samples[:, lane]) for lane in range(samples.shape[1])]
    best: tuple[float, list[Plan]] | None = None
    for m in ALIKE_GROUPS:
        groups = [(lane, sorted(g), differ[g]) for lane, (near, differ) in enumerate(lanes) for g in _grouped(near, differ, m)]
        # least[j]: the cheapest thresholds of the groups so far whose chances to miss multiply to exp(-j * unit) or less; -1 for a group that isn't used
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for _, bits, differ in groups:
            meets, seen = _within(np.full(len(bits), ALIKE_BITS), ALIKE_FLIPS), _within(differ, ALIKE_FLIPS)
            ways = [(0, 0.0, -1)]
            for t in range(ALIKE_FLIPS + 1):
                sent = 1 + sum(comb(len(bits), d) for d in range(1, t + 1)) / 2
                ways.append((int(-np.log1p(-meets[t]) / unit), ROW_COST * rows * sent + rows * rows / 2 * seen[t], t))
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for j, (cost, ts) in least.items():
                for gain, more, t in ways:
                    k = min(need, j + gain)
                    if k not in new or cost + more < new[k][0]:
                        new[k] = cost + more, (*ts, t)
            least = new
        if need in least and (best is None or least[need][0] < best[0]):
            plans: list[Plan] = [[] for _ in lanes]
            for (lane, bits, _), t in zip(groups, least[need][1]):
                if t >= 0:
                    plans[lane].append((bits, t))
            best = least[need][0], plans
    return best[1]


def _prober(plans: list[Plan]):
    """Rows of (node, fp) to rows of (part, value, own, node, fp): one that is indexed for each group of each lane, one for each other value
    to probe."""
    groups = [(lane, bits, [np.array([sum(1 << b for b in f) for f in combinations(range(len(bits)), d)], np.uint64) for d in range(1, t + 1)]) for lane, plan in enumerate(plans) for bits, t in plan]

    def run(batches):
        for batch in batches:
            node, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            words = _words(fp.to_pylist(), len(plans))
            for g, (lane, bits, flips) in enumerate(groups):
                value = np.zeros(len(node), np.uint64)
                for i, b in enumerate(bits):
                    value |= ((words[:, lane] >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
                yield _rows(g, value, True, node, fp)
                for f in (f for fs in flips for f in fs):
                    other = value ^ f
                    # of two values the lower one probes the higher one
                    up = np.flatnonzero(other > value)
                    if len(up):
                        yield _rows(g, other[up], False, node[up], fp.take(pa.array(up)))

    return run


def _words(fp: list[bytes], lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(fp), np.uint64).reshape(-1, lanes)


def _rows(g: int, value: np.ndarray, own: bool, node: np.ndarray, fp: pa.Array) -> pa.RecordBatch:
    n = len(node)
    return pa.record_batch({"part": pa.array(np.full(n, g, np.int32)), "value": pa.array(value.view(np.int64)), "own": pa.array(np.full(n, own)), "node": pa.array(node), "fp": fp})


def _linker(radius: int, lanes: int):
    def run(table: pa.Table) -> pa.Table:
        part, value, block, role, node = (table.column(c).to_numpy() for c in ("part", "value", "block", "role", "node"))
        order = np.lexsort((node, role == 1, block, value, part))
        part, value, block, role, node = part[order], value[order], block[order], role[order], node[order]
        u = _words(table.column("fp").to_pylist(), lanes)[order]
        new = np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (block[1:] != block[:-1])]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(node)]
        ids, at_id = np.unique(node, return_inverse=True)
        parent = np.arange(len(ids))
        # indexed rows come first in their bucket, and meet all rows after them
        many = end[np.cumsum(new) - 1] - np.arange(len(node)) - 1
        many[role == 1] = 0
        todo = np.flatnonzero(many > 0)
        upto = np.cumsum(many[todo])
        at = 0
        while at < len(todo):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 1_000_000 // lanes, "right")))
            each = many[todo[at:stop]]
            left = np.repeat(todo[at:stop], each)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
            hit = np.bitwise_count(u[left] ^ u[right]).sum(1, dtype=np.int64) <= radius
            if hit.any():
                parent = union(parent, at_id[left[hit]], at_id[right[hit]])
            at = stop
        a, b = forest(ids, parent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links(distinct: DataFrame, radius: int = RADIUS, lanes: int = 1) -> DataFrame:
    """(node, fp), each fp once, to links (a, b) of nodes, whose components are those of all pairs at most ``radius`` bits apart."""
    rows = distinct.count()
    sample = _words([bytes(r.fp) for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE_ROWS).select("fp").collect()], lanes)
    plans = [plan(sample[:, 0], rows, radius)] if lanes == 1 else _alike_plans(sample, rows)
    probes = distinct.select("node", "fp").mapInArrow(_prober(plans), "part int, value long, own boolean, node long, fp binary")
    dealt = blocks(probes, ["part", "value"], "node", BLOCK_ROWS)
    per_row = sum(1 + sum(comb(len(bits), d) for d in range(1, t + 1)) / 2 for p in plans for bits, t in p)
    tasks = max(12, int(rows * per_row) // TASK_ROWS)
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("part", "value", "block"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(_linker(radius, lanes), EDGES)


def cluster(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, lanes: int = 1) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of all documents reachable by links)."""
    marked = cut(fingerprints(docs, width, lanes))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    of = components(links(distinct, radius, lanes)).withColumnRenamed("node", "linked")
    named = distinct.join(of, F.col("node") == F.col("linked"), "left").select("fp", "first", F.coalesce("component", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _set_batches(width: int, lanes: int):
    """Rows with a text to rows with a fingerprint of its distinct shingles, their digest and their number."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column(batch.schema.get_field_index("text"))]
            fp, digest = [_fingerprint(h, lanes) for h in sets], [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            made = {"fp": pa.array(fp, pa.binary()), "digest": pa.array(digest, pa.binary()), "size": pa.array([len(h) for h in sets], pa.int64())}
            yield pa.record_batch({**{c: batch.column(c) for c in ("doc_id", "row")}, **made})

    return run


def _shingle_batches(width: int):
    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.drop_columns(["text"]).append_column("shingles", pa.array(sets, pa.binary()))

    return run


def _comparer(least: float):
    """Texts of pairs of blocks to links of texts at least ``least`` alike; of pairs that other links connect some are left out."""

    def run(table: pa.Table) -> pa.Table:
        group, low, high, mine, node = (table.column(c).to_numpy() for c in ("component", "low", "high", "mine", "node"))
        order = np.lexsort((node, mine, high, low, group))
        group, low, high, mine, node = group[order], low[order], high[order], mine[order], node[order]
        # views of the table's own memory
        raw = [x.as_buffer() for x in table.column("shingles")]
        sets = [np.frombuffer(raw[k], np.uint64) for k in order]
        size = np.array([len(x) for x in sets], np.int64)
        root = np.arange(len(node))
        a, b = [], []
        start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(node) else []
        for s, e in zip(start, [*start[1:], len(node)]):
            # a block meets itself, or another block that stands after it
            split = s + int((mine[s:e] == low[s]).sum()) if low[s] != high[s] else e
            # shingles are numbered within the pair of blocks
            at = np.r_[0, np.cumsum(size[s:e])]
            values, ids = np.unique(np.concatenate(sets[s:e]), return_inverse=True)
            marked = np.zeros(len(values), bool)
            for i in range(s, split):
                others = np.arange(i + 1 if low[s] == high[s] else split, e)
                small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
                others = others[(root[others] != root[i]) & (small >= least * large - 1)]
                if not len(others):
                    continue
                marked[ids[at[i - s] : at[i - s + 1]]] = True
                for j in others:
                    if root[j] != root[i]:
                        shared = np.count_nonzero(marked[ids[at[j - s] : at[j - s + 1]]])
                        every = size[i] + size[j] - shared
                        if every and shared / every >= least:
                            a.append(node[i])
                            b.append(node[j])
                            here = root[s:e]
                            here[here == root[j]] = root[i]
                marked[ids[at[i - s] : at[i - s + 1]]] = False
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _compared(docs: DataFrame, nodes: DataFrame, loose: DataFrame, width: int, least: float) -> DataFrame:
    """Links (a, b) of nodes at least ``least`` alike, whose components are those of all such pairs within the components ``loose``."""
    held = cut(loose.select("node", "component").unionByName(loose.select(F.col("component").alias("node"), "component").distinct()))
    large = held.groupBy("component").count().where(F.col("count") > ALIKE_ROWS).select("component", F.ceil(F.col("count") / ALIKE_ROWS).cast("int").alias("n"))
    held = held.join(large, "component", "left").join(nodes.select("node", "row", "size"), "node").select("node", "component", "row", "size", F.coalesce("n", F.lit(1)).alias("n"))
    # a text is sent once for each block of its group
    tasks = max(12, (held.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0) // ALIKE_TASK_SHINGLES)
    texts = docs.select(_row().alias("row"), "text").join(held.drop("size"), "row").drop("row").dropDuplicates(["node"])
    sets = texts.select("node", "component", "n", "text").mapInArrow(_shingle_batches(width), "node long, component long, n int, shingles binary")
    sets = sets.withColumn("mine", F.pmod(F.xxhash64("node"), "n").cast("int"))
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    return pairs.withColumn("task", F.pmod(F.xxhash64("component", "low", "high"), F.lit(tasks))).select("task", "component", "low", "high", "mine", "node", "shingles").groupBy("task").applyInArrow(_comparer(least), EDGES)


def _groups(docs: DataFrame, width: int, least: float, radius: int, lanes: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, fp, digest) of all rows, and (digest, root, first): the groups of texts at least ``least`` alike, where first is the smallest (doc_id, row) of a
    digest's rows that have a doc_id."""
    rows = docs.select("doc_id", _row().alias("row"), "text")
    marked = cut(rows.mapInArrow(_set_batches(width, lanes), "doc_id long, row long, fp binary, digest binary, size long"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row")))
    nodes = cut(marked.groupBy("digest", "fp").agg(first.alias("first"), F.min("row").alias("row"), F.max("size").alias("size")).withColumn("node", F.monotonically_increasing_id()))
    loose = components(links(nodes, radius, lanes))
    of = components(_compared(docs, nodes, loose, width, least)).withColumnRenamed("node", "linked")
    named = nodes.join(of, F.col("node") == F.col("linked"), "left").select("digest", "first", F.coalesce("component", "node").alias("root"))
    return marked, named


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def alike(docs: DataFrame, width: int = ALIKE_SHINGLE, least: float = ALIKE, radius: int = ALIKE_RADIUS, lanes: int = ALIKE_LANES) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of all documents reachable by links of texts at least ``least`` alike)."""
    marked, named = _groups(docs, width, least, radius, lanes)
    named = named.join(named.groupBy("root").agg(F.min("first.doc_id").alias("component_id")), "root")
    return marked.join(named.select("digest", "component_id"), "digest").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = ALIKE_SHINGLE, least: float = ALIKE, radius: int = ALIKE_RADIUS, lanes: int = ALIKE_LANES) -> DataFrame:
    """Of each group the document with the smallest doc_id, with all its columns; of different texts of that id in one group the one with the smaller hash,
    of rows equal in id and text one. A doc_id that several groups have is judged in each of them; rows without a doc_id stay."""
    _, named = _groups(docs, width, least, radius, lanes)
    kept = named.groupBy("root").agg(F.min("first").alias("first")).where("first is not null").select("first.*").alias("k")
    # the documents travel as one column, so that none of theirs can clash
    rows = docs.select("doc_id", _row().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).alias("d")
    same = (F.col("d.doc_id") == F.col("k.doc_id")) & (F.col("d.row") == F.col("k.row"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "row"]).select("doc.*").unionByName(docs.where("doc_id is null"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return cluster(docs).select("doc_id", F.lower(F.concat(*[F.substring(F.hex("fp"), i, 2) for i in range(15, 0, -2)])).alias("fingerprint"), "component_id")
