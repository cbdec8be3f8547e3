"""Substring dedup by a compressed FM-index for each shard.

``anchors`` brings the stretches that may repeat together. A shard's index holds its stretches as strings of symbols; a symbol is a run of STEP words,
and the strings of a stretch are its STEP phases, so that a window of ``width`` words is ``width / STEP`` symbols that follow each other in one
string. The Burrows-Wheeler transform of the strings is kept as a wavelet matrix of packed bits with counts for each 64 of them. The stretches are then
streamed against the index: all windows search backward at once, each step narrows a window's interval by one symbol, and a window
leaves the search when its interval holds one occurrence only; the number of steps is its matching statistic. Windows
that reach their full length with two occurrences or more are reported, and overlapping ones make up the intervals.

Defined results: words are what stands between blanks, unchanged; a null or blank text has none; texts shorter than a window keep everything;
repeated rows repeat each other's windows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .anchors import Anchored, Repeats, Settled, Units, anchored, gram_hashes, mixed

WIDTH = 35
GRAM = 10
STEP = 7
#: Bytes of a symbol's hash that are sent.
SYMBOL_BYTES = 6


class WaveletMatrix:
    """A sequence of numbers below 2 ** levels; rank by bits packed to 64 with running counts."""

    def __init__(self, values: np.ndarray, levels: int):
        self.size, self.levels = len(values), levels
        self.words, self.counts, self.zeros = [], [], []
        at = values.astype(np.uint32)
        for level in range(levels - 1, -1, -1):
            bit = (at >> np.uint32(level)) & np.uint32(1)
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            word = np.zeros((self.size >> 6) + 1, np.uint64)
            word.view(np.uint8)[: len(packed)] = packed
            self.words.append(word)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(word).astype(np.int64))[:-1]])
            one = bit.astype(bool)
            self.zeros.append(int(self.size - one.sum()))
            at = np.concatenate([at[~one], at[one]])

    def ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.counts[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, value: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each value stands before each of the places."""
        held = [np.zeros(len(value), np.int64), *places]
        for k in range(self.levels):
            one = ((value >> (self.levels - 1 - k)) & 1).astype(bool)
            for j, i in enumerate(held):
                up = self.ones(k, i)
                held[j] = np.where(one, self.zeros[k] + up, i - up)
        return [i - held[0] for i in held[1:]]


class FMIndex:
    """Of strings given as symbols (from 1 on) with the number of the next symbol in the string, or -1, and a weight for each symbol's place."""

    def __init__(self, symbols: np.ndarray, following: np.ndarray, weight: np.ndarray):
        n = len(symbols)
        self.most = int(symbols.max(initial=0))
        rank, ahead = symbols.astype(np.int64), following
        # suffixes sorted by their first 8 symbols: more than any pattern has
        for k in range(3):
            nxt = np.where(ahead >= 0, rank[ahead] if n else 0, 0)
            key = rank * (int(nxt.max(initial=0)) + 1) + nxt
            if k == 2:
                order = np.argsort(key, kind="stable")
            else:
                rank = np.unique(key, return_inverse=True)[1] + 1
                ahead = np.where(ahead >= 0, following[ahead] if k == 0 else ahead[ahead], -1) if n else ahead
        before = np.zeros(n, np.int64)
        linked = following >= 0
        before[following[linked]] = symbols[linked]
        self.begin = np.r_[0, np.cumsum(np.bincount(symbols, minlength=self.most + 1))]
        # suffixes of one symbol come first among those that begin with it; the empty suffix before which they stand isn't stored
        self.single = np.bincount(symbols[~linked], minlength=self.most + 1)
        self.matrix = WaveletMatrix(before[order], max(1, self.most.bit_length()))
        self.upto = np.r_[0, np.cumsum(weight[order])]

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.begin[symbol], self.begin[symbol + 1]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.matrix.rank(symbol, low, high)
        base = self.begin[symbol] + self.single[symbol]
        return base + a, base + b

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.upto[high] - self.upto[low]

    def statistics(self, patterns: np.ndarray, least: int = 2) -> np.ndarray:
        """For each row of symbols the length of its longest end that occurs ``least`` times or more."""
        length = np.zeros(len(patterns), np.int64)
        live = np.arange(len(patterns))
        low, high = self.start(patterns[:, -1])
        for j in range(patterns.shape[1] - 1, -1, -1):
            if j < patterns.shape[1] - 1:
                low, high = self.step(patterns[live, j], low, high)
            enough = self.occurrences(low, high) >= least
            live, low, high = live[enough], low[enough], high[enough]
            length[live] += 1
            if not len(live):
                break
        return length


class WordRepeats(Repeats):
    width, gram = WIDTH, GRAM

    def __init__(self, width: int = WIDTH, gram: int = GRAM, step: int = STEP, texts: bool = False):
        if width % step or width // step > 8:
            raise ValueError("a window has to be at most 8 whole steps")
        self.width, self.gram, self.by, self.texts = width, gram, step, texts
        self.result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, starts array<long>, ends array<long>" if texts else "")

    def load(self, ids: list, texts: list[bytes]) -> Anchored:
        digest = xxhash.xxh64_intdigest
        hashes, sizes = [], []
        for t in texts:
            words = t.split()
            sizes.append(len(words))
            hashes.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        return anchored(ids, Units(np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.array(sizes, np.int64), self.width, self.gram)

    @property
    def beyond(self) -> int:
        """How many symbols begin in a window after its first."""
        return self.width - self.by

    def payload(self, a, at, first, last):
        return mixed(gram_hashes(a.units[:], self.by)), first.astype(np.int64), last.astype(np.int64)

    def packed(self, payload, rows):
        symbols, first, last = payload
        many = last[rows] - first[rows] + 1 + self.beyond
        place = np.repeat(first[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.ascontiguousarray(symbols[place].view(np.uint8).reshape(-1, 8)[:, :SYMBOL_BYTES]).tobytes()

    def settle(self, a, doc, group):
        n = np.bincount(group)
        _, one = np.unique(group, return_index=True)
        none = np.empty(0, np.int64)
        return Settled(one, np.minimum(n[group[one]], 2), np.flatnonzero(n[group] >= 2), none, none)

    def solve(self, seen, data):
        windows = seen["last"] - seen["first"] + 1
        many = windows + self.beyond
        raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, SYMBOL_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :SYMBOL_BYTES] = raw
        symbol = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)[1] + 1
        ends = np.cumsum(many)
        end_of = np.repeat(ends, many)
        place = np.arange(len(symbol))
        following = np.where(place + self.by < end_of, place + self.by, -1)
        index = FMIndex(symbol, following, np.repeat(seen["weight"], many).astype(np.int64))
        window = np.repeat(ends - many - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        steps = self.width // self.by
        found = np.concatenate([index.statistics(symbol[window[i : i + 500_000, None] + self.by * np.arange(steps)]) for i in range(0, len(window), 500_000)])
        gone = np.zeros((len(windows), int(windows.max())), bool)
        gone[np.repeat(np.arange(len(windows)), windows), np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)] = found == steps
        return gone

    def apply(self, ids, texts, spans):
        out = []
        for t, (starts, ends) in zip(texts, spans):
            words = t.split()
            if len(starts):
                kept, at = [], 0
                for b, e in zip(starts.tolist(), ends.tolist()):
                    kept += words[at:b]
                    at = e
                kept += words[at:]
            else:
                kept = words
            line = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), line.decode() if self.texts else None, starts, ends))
        n, gone, digest, kept, starts, ends = zip(*out) if out else ((),) * 6
        table = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if self.texts:
            table |= {"kept": pa.array(kept, pa.string()), "starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64()))}
        return pa.table(table)


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """doc_id, the kept words, the removed intervals (starts and ends in words) and their numbers."""
    return WordRepeats(width, gram, step, texts=True).run(docs.select("doc_id", "text"))


def report(docs: DataFrame) -> DataFrame:
    return WordRepeats().run(docs.select("doc_id", "text"))
