"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow with a target, each shuffled document a packet. The virtual finish time of a document is
the running size of its source up to and with it, divided by the source's target; a second or third pass over
a source goes on where the pass before ended. Documents are taken in the order of their finish times until the total budget
is used up.

Everything is computed on rows without text. Running sums are two-level: the order key is cut into ranges whose sums are
aggregated first, so that a source of any size is dealt out over all tasks.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sources whose sizes are all 0
have target 0 and are taken 0 times; documents of size 0 finish with the one before them; equal rows are mixed like any other rows; an
empty table gives an empty result. Other columns are ignored by ``quotas``; ``mix`` keeps the documents' columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Ranges of the shuffle key of each source, and of the virtual finish time.
RANGES = 4096
MAX_PASSES = 3


def _ranges(key: Column) -> Column:
    """Which of RANGES equal ranges of 64 bits the key falls into."""
    return (F.shiftright(key, 52) + RANGES // 2).cast("int")


def _source_order(sizes: DataFrame) -> DataFrame:
    """Number the sources by code point, null last. One row per source goes through this window."""
    w = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    return sizes.withColumn("rank", F.row_number().over(w))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the total shared by weight, no target above ``passes`` times its
    source's size; what is over is shared again until none is above. Only single sums reach the driver."""
    ranked = _source_order(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = cut(ranked.withColumn("most", (passes * F.col("source_size")).cast("double")))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("most") <= level * F.col("weight")
        used, weight = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        step = max(0.0, total - (used or 0.0)) / weight if weight else level
        if step <= level:
            break
        level = step
    return ranked.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def quotas(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = MAX_PASSES, seed: int = 17) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, finish (of its first pass), copies, taken, key (the
    shuffled order)."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"))
    slim = cut(slim.withColumn("range", _ranges(F.col("key"))))
    parts = slim.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    shares = cut(targets(parts.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, passes))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    parts = parts.alias("p").join(shares.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.source", "range", "before", "source_size", "target")
    within = Window.partitionBy("d.source", "d.range").orderBy("key", "doc_id")
    queued = (
        slim.alias("d")
        .join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range")))
        .select("doc_id", "d.source", "key", "size", "source_size", "target", (F.col("before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).alias("upto"), F.row_number().over(within).alias("tie"))
    )
    queued = cut(queued)
    limit = _last_taken(queued, passes)
    return queued.select("doc_id", "source", "size", "source_size", "target", _finish(0).alias("finish"), _copies(limit, passes).cast("long").alias("copies"), "key").withColumn("taken", F.col("size") * F.col("copies"))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", F.col("text"))


def _finish(p: int) -> Column:
    return (F.col("upto") + F.lit(p) * F.col("source_size")).cast("double") / F.when(F.col("target") > 0, F.col("target"))


def _order(p: int) -> list[Column]:
    """A document's place in the queue: its finish time, then by names that make it the only one."""
    return [_finish(p), F.col("key"), F.col("doc_id"), F.col("tie")]


def _last_taken(queued: DataFrame, passes: int):
    """The place in the queue of the last document that the budget reaches: (finish, key, doc_id, tie), or None.

    The queue is cut into ranges of the finish time; one sum for each range comes to the driver, then the running sum of the one
    range that the budget ends in.
    """
    budget = queued.agg(F.sum("size")).first()[0] or 0
    rows = F.explode(F.array(*[F.struct(_finish(p).alias("finish"), F.lit(p).alias("pass")) for p in range(passes)])).alias("q")
    queue = queued.where((F.col("target") > 0) & (F.col("size") > 0)).select("key", "doc_id", "tie", "size", rows).select("q.finish", "key", "doc_id", "tie", "size")
    # a source's last document may finish after 1; no more ranges than twice RANGES, the last of them open
    slot = F.least(F.floor(F.col("finish") * RANGES), F.lit(2 * RANGES)).cast("int")
    queue = queue.withColumn("slot", slot)
    done, last = 0, None
    for s, n in sorted((r.slot, r.n) for r in queue.groupBy("slot").agg(F.sum("size").alias("n")).collect()):
        if done + n > budget:
            w = Window.partitionBy("slot").orderBy("finish", "key", "doc_id", "tie")
            here = queue.where(F.col("slot") == s).withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(done))
            found = here.where(F.col("upto") <= budget).orderBy(F.desc("upto"), F.desc("finish"), F.desc("key")).limit(1).collect()
            return _place(found[0]) if found else (float(s) / RANGES, -(2**63), None, 0)
        done, last = done + n, s
    return (float("inf"), 0, None, 0) if last is not None else None


def _place(row) -> tuple:
    return row.finish, row.key, row.doc_id, row.tie


def _copies(limit, passes: int) -> Column:
    """How many passes of a document stand in the queue up to the limit."""
    if limit is None:
        return F.lit(0)
    finish, key, doc_id, tie = limit
    n = F.lit(0)
    for p in range(passes):
        f = _finish(p)
        same = (F.col("key") < key) | ((F.col("key") == key) & (F.coalesce(F.col("doc_id"), F.lit(-(2**63))) <= F.lit(-(2**63) if doc_id is None else doc_id)) & (F.col("tie") <= tie))
        n = n + F.when((f < F.lit(finish)) | ((f == F.lit(finish)) & same), 1).otherwise(0)
    return n


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = MAX_PASSES, seed: int = 17) -> DataFrame:
    """The mixed stream: the rows of ``docs``, each as often as it is taken, in the range-sorted order of their finish times. Rows of
    size 0 hold no words to weigh and stay as they are."""
    one = Window.partitionBy("doc_id", "source", "key")
    taken = quotas(docs, weights, passes, seed).withColumn("n", F.row_number().over(one.orderBy("finish", "copies")))
    taken = taken.select("doc_id", "source", "key", "n", "size", "copies", "finish", (F.col("source_size") / F.col("target")).alias("again")).alias("t")
    # the documents travel as one column, so that none of theirs can clash; rows that share id, text and source are matched by number
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "source", _key(seed).alias("key"))
    rows = rows.withColumn("n", F.row_number().over(one.orderBy(F.xxhash64("doc")))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.key") == F.col("t.key")) & (F.col("d.n") == F.col("t.n"))
    kept = rows.join(taken, same).select("doc", "d.doc_id", "finish", "again", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int").alias("copies"))
    kept = kept.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return kept.orderBy(F.col("finish") + F.col("pass") * F.col("again"), "doc_id").select("doc.*")
