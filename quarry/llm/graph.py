"""Connected components and bounded blocks, for the operators that link similar rows.

Links reach the driver in no form but their number and a checksum. Links of a partition are first reduced to a spanning forest;
then rounds of large-star and small-star follow, as aggregations and joins that combine before they shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

EDGES = "a long, b long"
ONE_TASK = 5_000_000


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The forest ``parent`` (each entry an index no greater than its own) after linking a[i] with b[i]."""
    while True:
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        a, b = a[open_], b[open_]
        high, low = np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_]
        parent = parent.copy()
        np.minimum.at(parent, high, low)


def forest(ids: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node that isn't a root."""
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return ids[child], ids[parent[child]]


def _forests(batches):
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= 500_000:
            yield _forest_of(held)
            held = []
    if held:
        yield _forest_of(held)


def _forest_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = forest(ids, union(np.arange(len(ids)), where[: len(a)], where[len(a) :]))
    return pa.record_batch({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long links to (node, component): for every linked node but the roots, the smallest node reachable from it.

    The centre of a star may stand in a third of the links. Beyond ONE_TASK links the aggregated side of each join is written first: both sides are then plain
    shuffles, of which Spark splits what is skewed; below, a centre has no more links than a task may have."""
    e = edges.where("a <> b").mapInArrow(_forests, EDGES)
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = e.count()
    while n:
        held = cut if n > ONE_TASK else lambda df: df
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = held(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = held(large.groupBy("a").agg(F.min("b").alias("m")))
        new = cut(large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        # the links of two rounds, each once, are the same if they are as many and none is new
        before, n = n, new.count()
        done = n == before and not new.join(e, ["a", "b"], "left_anti").take(1)
        e = new
        if done:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def blocks(rows: DataFrame, keys: list[str], uid: str, most: int) -> DataFrame:
    """Deal the rows of every key to blocks of about ``most`` indexed rows.

    ``rows`` has the keys, ``own`` (true for rows that the key indexes, false for rows that only probe it) and ``uid``. The result has two more
    columns: block, and role: 0 is indexed and probes, 1 only probes, 2 is only indexed. Every row meets every indexed row of its key once; where a
    key has one block nothing is copied.
    """
    large = rows.where("own").groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("_n"))
    dealt = rows.join(large, keys, "left")
    every = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("role")))
    mine = F.array(F.struct(F.pmod(F.xxhash64(uid), F.col("_n")).cast("int").alias("block"), F.lit(2).alias("role")))
    one = F.array(F.struct(F.lit(0).alias("block"), F.when(F.col("own"), 0).otherwise(1).alias("role")))
    where = F.when(F.col("_n").isNull(), one).when(F.col("own"), F.concat(mine, every)).otherwise(every)
    return dealt.withColumn("_at", F.explode(where)).select("*", "_at.block", "_at.role").drop("_at", "_n")
