"""Best-fit packing into sequences of several permitted lengths.

Documents are dealt by hash to shards of bounded size; equal rows are counted first and dealt by COPIES, so that no number of them makes a shard large. In a shard, documents longer than the largest length are cut into full
sequences and a rest; all pieces are then placed, longest first, into the open bin with the least room that holds them. Where no
open bin holds a piece, the bin that opens has the length of least cost: the padding that would be left, a fixed price for
another sequence, and for lengths with room to spare the credit of what the shard's shorter pieces still have to fill it with. At the end
each bin is reduced to the least permitted length that holds its contents.

Defined results: a null or blank text has no words and gets one row with bin_id -1, length 0 and capacity 0; equal rows are packed like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_count

CAPACITIES = (512, 1024, 2048, 4096)
#: What another sequence costs, in tokens.
OPENING = 16
SHARD_ROWS = 20_000
#: Up to so many equal rows go to a shard together.
COPIES = 1000
SCHEMA = "doc_id long, piece long, start long, length long, bin_id long, capacity long, position long"


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """((item, start, length, bin, position) for each piece, the final capacity of each bin)."""
    caps = sorted(capacities)
    top = caps[-1]
    pieces = [(min(top, n - at), i, at) for i, n in enumerate(sizes) for at in range(0, n, top)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    left = sum(p[0] for p in pieces)
    room: list[tuple[int, int]] = []  # (free, bin) of the open bins
    used, opened, out = [], [], []
    for n, i, at in pieces:
        left -= n
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            # padding that is sure to be left where the shorter pieces can't fill the bin, plus the price per token of opening it
            cap = min((c for c in caps if c >= n), key=lambda c: (max(0, c - n - left) + opening * (n + min(left, c - n)) / c * (top / c), c))
            free, b = cap, len(used)
            used.append(0)
            opened.append(cap)
        out.append((i, at, n, b, used[b]))
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return out, [next(c for c in caps if c >= u) for u in used]


def _packer(capacities: tuple[int, ...], opening: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py() if table.num_rows else 0
        t = table.sort_by([("size", "descending"), ("doc_id", "ascending")])
        ids, sizes = ([x for x, n in zip(t.column(c).to_pylist(), t.column("copies").to_pylist()) for _ in range(n)] for c in ("doc_id", "size"))
        placed, caps = pack(sizes, capacities, opening)
        count: dict[int, int] = {}
        rows: list[tuple] = []
        for i, at, n, b, position in sorted(placed):
            piece = count[i] = count.get(i, -1) + 1
            rows.append((ids[i], piece, at, n, (shard << 32) + b, caps[b], position))
        rows += [(ids[i], 0, 0, 0, -1, 0, 0) for i, n in enumerate(sizes) if n == 0]
        columns = list(zip(*rows)) if rows else [()] * 7
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns)})

    return run


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start and length in words, bin_id, the bin's capacity, position in the bin."""
    slim = docs.select("doc_id", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    shards = max(1, -(-docs.count() // shard_rows))
    equal = slim.groupBy("doc_id", "size", "key").agg(F.count("*").alias("n"))
    dealt = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    dealt = dealt.select("doc_id", "size", F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("lot") * COPIES).alias("copies"), F.pmod(F.xxhash64("key", "lot"), F.lit(shards)).cast("long").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(_packer(tuple(capacities), opening), SCHEMA)


def utilisation(packed: DataFrame) -> DataFrame:
    """Words and capacity over all bins, one row: sequences, words, capacity."""
    bins = packed.where("bin_id >= 0").groupBy("bin_id").agg(F.sum("length").alias("n"), F.max("capacity").alias("c"))
    return bins.agg(F.count("*").alias("sequences"), F.sum("n").alias("words"), F.sum("c").alias("capacity"))
