"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of an enhanced suffix array.

``anchors`` brings the stretches that may repeat together. A shard sorts the suffixes that begin at its anchors and takes the common prefixes of
neighbours; a scan with a stack turns these into the tree of intervals: each is a set of suffixes that agree for a number of bytes,
nested in one that agrees for fewer. To the left of the anchors the same is done with the reversed text. A repeat of ``width`` bytes
around an anchor is an interval and, inside it, a class of equal left extensions; where the extensions of an interval differ it
falls apart into several repeats, and where they agree the repeat goes on to the left. All occurrences of each repeat are known, so the
first of them, by doc_id, stays, and the others go.

Defined results: texts are UTF-8 bytes, a null text is empty; a document shorter than ``width`` keeps everything; rows with equal doc_ids never remove
each other's bytes; a null doc_id counts as larger than any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Anchored, Repeats, Settled, Units, anchored

WIDTH = 50
GRAM = 20


def interval_tree(lcp: list[int], least: int = 1) -> list[tuple[int, int, int, int]]:
    """The intervals of an enhanced suffix array, by one scan with a stack: (depth, depth of the enclosing one, left, right), for depths from ``least``
    on. lcp[i] is the common prefix of suffixes i and i + 1."""
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (depth, left)
    for i, n in enumerate(lcp):
        left = i
        if n < least:
            n = 0
        while stack and stack[-1][0] > n:
            depth, left = stack.pop()
            out.append((depth, max(n, stack[-1][0] if stack else 0), left, i))
        if n and (not stack or stack[-1][0] < n):
            stack.append((n, left))
    while stack:
        depth, left = stack.pop()
        out.append((depth, stack[-1][0] if stack else 0, left, len(lcp)))
    return out


def _sorted_contexts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows and the common prefixes of neighbours in that order."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    lcp = np.empty(max(0, n - 1), np.int64)
    for i in range(0, n - 1, 1 << 17):
        some = rows[order[i : i + (1 << 17) + 1]]
        differ = some[1:] != some[:-1]
        lcp[i : i + len(differ)] = np.where(differ.any(1), differ.argmax(1), width)
    return order, lcp


def repeat_classes(left: np.ndarray, right: np.ndarray, valid_from: np.ndarray, valid_to: np.ndarray, width: int):
    """For each offset o of an anchor in its window: (o, items, class of each item), of all classes with two items or more.

    left has the bytes before each anchor, nearest first, right those from it on; an item's windows have offsets valid_from to valid_to.
    """
    order, lcp = _sorted_contexts(right)
    back, lcs = _sorted_contexts(left)
    reach = left.shape[1]
    tree = np.array(interval_tree(lcp.tolist(), width - reach), np.int64).reshape(-1, 4)
    for o in range(reach + 1):
        need = width - o
        # the widest intervals that agree for ``need`` bytes
        some = tree[(tree[:, 0] >= need) & (tree[:, 1] < need)]
        if not len(some):
            continue
        size = some[:, 3] - some[:, 2] + 1
        interval = np.repeat(np.arange(len(some)), size)
        place = np.repeat(some[:, 2] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        item = order[place]
        ok = (valid_from[item] <= o) & (o <= valid_to[item])
        item, interval = item[ok], interval[ok]
        if len(item) < 2:
            continue
        # left extensions of o bytes
        extension = np.empty(len(back), np.int64)
        extension[back] = np.r_[0, np.cumsum(lcs < o)] if o else 0
        yield o, item, interval * (len(back) + 1) + extension[item]


class SuffixRepeats(Repeats):
    width, gram = WIDTH, GRAM
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, ends array<long>"

    def __init__(self, width: int = WIDTH, gram: int = GRAM, texts: bool = False):
        self.width, self.gram, self.texts = width, gram, texts
        self.values = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
        if not texts:
            self.result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def load(self, ids: list, texts: list[bytes]) -> Anchored:
        joint = np.frombuffer(b"".join(texts), np.uint8)
        a = anchored(ids, Units(joint, self.values), np.array([len(t) for t in texts], np.int64), self.width, self.gram)
        a.bytes = joint
        return a

    @property
    def reach(self) -> int:
        return self.width - self.gram

    def payload(self, a, at, first, last):
        around = self.reach + self.width
        buffer = np.concatenate([np.zeros(self.reach, np.uint8), a.bytes, np.zeros(self.width, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(buffer, around)[at]
        # bytes outside the stretch's windows are blanked, as they can't matter and then cost nothing
        place = np.arange(around) - self.reach
        return np.where((place >= (first - at)[:, None]) & (place < (last + self.width - at)[:, None]), rows, 0).astype(np.uint8)

    def packed(self, payload, rows):
        return payload[rows].tobytes()

    def settle(self, a, doc, group):
        ids = np.array([np.iinfo(np.int64).max if i is None else i for i in a.ids], np.int64)[doc]
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids)
        own = ids == least[group]
        # of a content's windows in the document (or rows) of least id the first one is sent, and the others share its fate
        mine = np.flatnonzero(own)
        _, one, of = np.unique(group[mine], return_index=True, return_inverse=True)
        rest = np.ones(len(mine), bool)
        rest[one] = False
        return Settled(mine[one], np.ones(len(one)), np.flatnonzero(~own), mine[rest], mine[one][of[rest]])

    def solve(self, seen, data):
        n = len(seen["first"])
        rows = np.frombuffer(b"".join(data), np.uint8).reshape(n, self.reach + self.width)
        most = seen["offset"].astype(np.int64)
        least = most - (seen["last"] - seen["first"])
        gone = np.zeros((n, self.reach + 1), bool)
        for o, item, kind in repeat_classes(rows[:, : self.reach][:, ::-1], rows[:, self.reach :], least, most, self.width):
            ids = seen["id"][item]
            order = np.lexsort((ids, kind))
            new = np.r_[True, kind[order][1:] != kind[order][:-1]]
            first_id = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            removed = item[order][ids[order] > first_id]
            gone[removed, most[removed] - o] = True
        return gone

    def apply(self, ids, texts, spans):
        out = []
        for t, (starts, ends) in zip(texts, spans):
            pieces, at = [], 0
            for b, e in zip(starts.tolist(), ends.tolist()):
                pieces.append(t[at:b])
                at = e
            kept = b"".join([*pieces, t[at:]])
            out.append((len(t), len(t) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept, starts, ends))
        n, gone, runs, digest, kept, starts, ends = zip(*out) if out else ((),) * 7
        table = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if self.texts:
            table |= {"kept": pa.array(kept, pa.binary()), "starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64()))}
        return pa.table(table)


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, the kept bytes, the removed spans (starts and ends in bytes) and their numbers."""
    return SuffixRepeats(width, gram, texts=True).run(docs.select("doc_id", "text"))


def report(docs: DataFrame) -> DataFrame:
    return SuffixRepeats().run(docs.select("doc_id", "text"))
