"""Routing for repeats: which stretches of which documents have to meet in one task.

A document is a row of units (bytes or words), a window a run of ``width`` of them. Of the ``width - gram + 1`` runs of ``gram`` units
inside a window the one with the smallest hash, the leftmost of equals, is the window's anchor: it depends on the window's content
alone, so equal windows have equal anchors at the same offset. Consecutive windows share anchors; there is one anchor for every few units.

The steps, all in one job over parts of the documents of about PART_BYTES each:

1. each part sends the distinct hashes of its anchors with their numbers, to as many bits as the number of anchors needs;
2. hashes found twice or more are marked, very frequent ones (in one part or over all) are marked as hot. Two hashes with equal bits are
   marked too often, which costs a message and no result;
3. each part sends for each marked anchor the stretch of its windows to the shard that the hash names. For hot anchors it sends single
   windows, each distinct one once, to the shard that the window's content names; so no anchor, however frequent, makes a large shard. What
   the part's other windows of that content need to know follows from the answer to the one that is sent;
4. each shard builds its index over the stretches it got and answers with spans to remove;
5. each part applies the spans to its documents.

The documents are shuffled once, compressed, and that exchange serves steps 1, 3 and 5. A part tells a bucket or shard everything in one row, so there
are never more rows than anchors, and parts and shards are large enough that there are far fewer. A document is never cut into parts; it is worked on in stretches of CHUNK
units, so that a long one needs memory for its text, its anchors and one stretch. Groups hold bounded amounts of text; nothing reaches the driver but
the total number of bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a part, of a bucket of hashes and of a shard of stretches.
PART_BYTES, BUCKET_BYTES, SHARD_BYTES = 4_000_000, 48_000_000, 8_000_000
LEAST_PARTS = 48
#: An anchor found more often than this is hot.
HOT = 500
#: Windows looked at together; positions in it fit into 24 bits.
CHUNK = 1 << 19
#: Text that a task gathers before it sends it on, compressed, to the parts.
FLUSH_BYTES = 32_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all runs of n units, put together from runs of powers of two."""
    count = max(0, len(h) - n + 1)
    out, at, level, size = np.zeros(count, np.uint64), n, h, 1
    while count:
        if n & size:  # from the end of the run to its front
            at -= size
            out += level[at : at + count] * _power(n - at - size)
        size *= 2
        if size > n:
            break
        level = level[: -(size // 2)] * _power(size // 2) + level[size // 2 :]
    return out


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def anchors_of_windows(g: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes, of at most 2 ** 24, the position of its smallest, the leftmost of equals."""
    n = len(g)
    if n < w:
        return np.empty(0, np.int64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    np.bitwise_and(g, ~np.uint64(0xFFFFFF), out=padded[:n])
    padded[:n] |= np.arange(n, dtype=np.uint64)
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


class Units:
    """A row of hashes; given as codes and a table of the codes' hashes it is looked up where it is read."""

    def __init__(self, codes: np.ndarray, table: np.ndarray | None = None):
        self.codes, self.table = codes, table

    def __len__(self) -> int:
        return len(self.codes)

    def __getitem__(self, at) -> np.ndarray:
        return self.codes[at] if self.table is None else self.table[self.codes[at]]


@dataclass
class Anchored:
    """The documents of a part, sorted, as one row of units, and the anchors of their windows: anchor i stands at ``at[i]`` and serves the windows
    that start from ``first[i]`` to ``last[i]``; all positions are in the joint row."""

    ids: list
    units: Units
    begins: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray


def anchored(ids: list, units: Units, sizes: np.ndarray, width: int, gram: int) -> Anchored:
    ends = np.cumsum(sizes)
    begins = ends - sizes
    place = np.int32 if len(units) < 2**31 else np.int64
    found: list[tuple[np.ndarray, ...]] = [(np.empty(0, place), np.empty(0, place), np.empty(0, place), np.empty(0, np.uint64))]
    for a in range(0, len(units) - width + 1, CHUNK):
        b = min(a + CHUNK, len(units) - width + 1)
        g = mixed(gram_hashes(units[a : b + width - 1], gram))
        p, starts = anchors_of_windows(g, width - gram + 1), np.arange(a, b)
        inside = np.flatnonzero(starts + width <= ends[np.searchsorted(ends, starts, "right")])
        p, starts = p[inside], starts[inside]
        if not len(p):
            continue
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)])
        stop = np.r_[new[1:], len(p)] - 1
        # smallest hashes are small; scrambled once more they deal out evenly
        found.append(((p[new] + a).astype(place), starts[new].astype(place), starts[stop].astype(place), mixed(g[p[new]])))
    at, first, last, keys = (np.concatenate(c) for c in zip(*found))
    # an anchor whose windows go on beyond a chunk is one
    on = np.flatnonzero((at[1:] == at[:-1]) & (first[1:] == last[:-1] + 1)) if len(at) else np.empty(0, np.int64)
    if len(on):
        last[on] = last[on + 1]
        keep = np.ones(len(at), bool)
        keep[on + 1] = False
        at, first, last, keys = at[keep], first[keep], last[keep], keys[keep]
    return Anchored(ids, units, begins, ends, at, first, last, keys)


PACKED = "part int, ids binary, none binary, sizes binary, data binary"


def _pack(batches):
    """(doc_id, text, part) to the documents of each part, compressed together."""
    held: dict[int, list[tuple[int | None, bytes]]] = {}
    size = 0
    for batch in batches:
        for i, t, p in zip(*(batch.column(k).to_pylist() for k in range(3))):
            text = (t or "").encode()
            held.setdefault(p, []).append((i, text))
            size += len(text) + 50
            if size >= FLUSH_BYTES:
                yield _packed(held)
                held, size = {}, 0
    if held:
        yield _packed(held)


def _packed(held: dict[int, list[tuple[int | None, bytes]]]) -> pa.RecordBatch:
    small = zstandard.ZstdCompressor(level=3).compress
    columns = [
        (p, np.array([i or 0 for i, _ in docs], np.int64).tobytes(), np.array([i is None for i, _ in docs], np.uint8).tobytes(), np.array([len(t) for _, t in docs], np.int64).tobytes(), small(b"".join(t for _, t in docs)))
        for p, docs in held.items()
    ]
    part, *rest = zip(*columns)
    return pa.record_batch([pa.array(part, pa.int32()), *(pa.array(c, pa.binary()) for c in rest)], names=[c.split()[0] for c in PACKED.split(", ")])


def documents(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a part, sorted, so that each step numbers its rows alike; a null id comes last."""
    whole = zstandard.ZstdDecompressor().decompress
    docs: list[tuple[bool, int, bytes]] = []
    for r in table.to_pylist():
        ids, none, ends = np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["none"], np.uint8).tolist(), np.cumsum(np.frombuffer(r["sizes"], np.int64)).tolist()
        data = whole(r["data"])
        docs += [(bool(n), i, data[a:b]) for n, i, a, b in zip(none, ids, [0, *ends], ends)]
    docs.sort()
    return [None if n else i for n, i, _ in docs], [t for _, _, t in docs]


class Repeats:
    """What differs between the searches. A subclass says what units are, what a shard is sent and how it finds repeats."""

    width: int
    gram: int
    result: str  #: schema of the rows of step 5

    def load(self, ids: list, texts: list[bytes]) -> Anchored:
        raise NotImplementedError

    def payload(self, a: Anchored, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes] | np.ndarray:
        """What a shard gets of the windows ``first`` to ``last`` of each anchor; sliceable by row, see ``packed``."""
        raise NotImplementedError

    def packed(self, payload, rows: np.ndarray) -> bytes:
        raise NotImplementedError

    def settle(self, a: Anchored, doc: np.ndarray, group: np.ndarray) -> Settled:
        """What becomes of hot windows, given the number of their document and of their content."""
        raise NotImplementedError

    def solve(self, seen: dict[str, np.ndarray], data: list[bytes]) -> np.ndarray:
        """For each stretch and each of its windows from the first on, whether it is to be removed: (stretches, width) booleans."""
        raise NotImplementedError

    def apply(self, ids: list, texts: list[bytes], spans: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        raise NotImplementedError

    # the steps

    def _distinct(self, buckets: int, bits: int):
        def run(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            keys, n = np.unique(self.load(*documents(table)).keys >> np.uint64(64 - bits), return_counts=True)
            cut = _bucket_cuts(keys, buckets, bits)
            full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
            small = zstandard.ZstdCompressor(level=3).compress
            return pa.table({
                "bucket": pa.array(full, pa.int32()), "part": pa.array([part] * len(full), pa.int32()),
                "keys": pa.array([squeezed(keys[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
                "counts": pa.array([small(n[cut[b] : cut[b + 1]].astype(np.uint32).tobytes()) for b in full], pa.binary()),
            })

        return run

    @staticmethod
    def _mark(table: pa.Table) -> pa.Table:
        whole = zstandard.ZstdDecompressor().decompress
        held = [unsqueezed(k).view(np.uint64) for k in table.column("keys").to_pylist()]
        keys, n = np.concatenate(held), np.frombuffer(b"".join(map(whole, table.column("counts").to_pylist())), np.uint32)
        _, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, n)[where]
        code = ((total >= 2).astype(np.uint8) + (total > HOT)).astype(np.uint8)
        ends = np.cumsum([len(k) for k in held])
        small = zstandard.ZstdCompressor(level=1).compress
        codes = [small(code[e - len(k) : e].tobytes()) for k, e in zip(held, ends)]
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "codes": pa.array(codes, pa.binary())})

    def _send(self, shards: int, bits: int):
        def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
            if not docs.num_rows:
                return _sent([])
            part = docs.column("part")[0].as_py()
            a = self.load(*documents(docs))
            whole = zstandard.ZstdDecompressor().decompress
            codes = np.frombuffer(b"".join(map(whole, marks.sort_by("bucket").column("codes").to_pylist())), np.uint8)
            _, where = np.unique(a.keys >> np.uint64(64 - bits), return_inverse=True)
            code = codes[where] if len(where) else where
            warm, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
            del where, code
            rows = [(a.at[warm], a.first[warm], a.last[warm], np.ones(len(warm), np.uint8), np.zeros(len(warm), np.uint8), a.keys[warm])]
            out = []
            if len(hot):
                many = a.last[hot] - a.first[hot] + 1
                start = np.repeat(a.first[hot] - (np.cumsum(many) - many).astype(a.first.dtype), many) + np.arange(many.sum(), dtype=a.first.dtype)
                at = np.repeat(a.at[hot], many)
                content = _window_hashes(a.units, start, self.width)
                _, group = np.unique(content, return_inverse=True)
                of = np.searchsorted(a.ends, start, "right")
                s = self.settle(a, of, group)
                del group
                rows.append((at[s.sent], start[s.sent], start[s.sent], s.weight.astype(np.uint8), np.isin(s.sent, s.names).astype(np.uint8), content[s.sent]))
                place = lambda w: _place(of[w], start[w] - a.begins[of[w]])
                if len(s.gone):
                    out.append(_packed_spans(part, of[s.gone], start[s.gone] - a.begins[of[s.gone]], start[s.gone] - a.begins[of[s.gone]] + self.width) | {"shard": part % shards, "kind": SPANS})
                if len(s.tied):
                    out.append({"shard": part % shards, "part": part, "kind": TIED, "rows": squeezed(place(s.tied)), "starts": squeezed(place(s.names))})
            at, first, last, weight, named, key = (np.concatenate(c) for c in zip(*rows))
            shard = ((mixed(key) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((first, shard))
            at, first, last, weight, named, shard = at[order], first[order], last[order], weight[order], named[order], shard[order]
            data = self.payload(a, at, first, last)
            doc = np.searchsorted(a.ends, first, "right")
            ids = np.array([np.iinfo(np.int64).max if i is None else i for i in a.ids], np.int64)
            begin = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.empty(0, np.int64)
            small = zstandard.ZstdCompressor(level=5).compress
            for b, e in zip(begin, np.r_[begin[1:], len(shard)]):
                r = np.arange(b, e)
                flags = last[r] - first[r], at[r] - first[r], weight[r], named[r]
                seen = [squeezed(_place(doc[r], first[r] - a.begins[doc[r]])), squeezed(ids[doc[r]]), small(b"".join(c.astype(np.uint8).tobytes() for c in flags))]
                out.append({"shard": int(shard[b]), "part": part, "kind": STRETCHES, "many": len(r), "rows": seen[0], "starts": seen[1], "ends": seen[2], "data": small(self.packed(data, r))})
            return _sent(out)

        return run

    def _answer(self, table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        known = table.filter(pa.array([k != STRETCHES for k in kinds])).to_pylist()
        asked = table.filter(pa.array([k == STRETCHES for k in kinds])).to_pylist()
        out = [{k: r[k] for k in ("part", "kind", "rows", "starts", "ends")} for r in known]
        if asked:
            whole = zstandard.ZstdDecompressor().decompress
            seen = _columns(asked)
            part = np.repeat([r["part"] for r in asked], [r["many"] for r in asked])
            gone = self.solve(seen, [whole(r["data"]) for r in asked])
            edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            who, b = np.nonzero(edge == 1)
            _, e = np.nonzero(edge == -1)
            start, end = seen["first"][who] + b, seen["first"][who] + e - 1 + self.width
            for p in np.unique(part[who]):
                m = part[who] == p
                out.append(_packed_spans(int(p), seen["row"][who[m]], start[m], end[m]) | {"kind": SPANS})
            named = np.flatnonzero((seen["named"] == 1) & gone[:, 0])
            for p in np.unique(part[named]):
                m = named[part[named] == p]
                out.append({"part": int(p), "kind": NAMED, "rows": squeezed(np.sort(_place(seen["row"][m], seen["first"][m])))})
        return pa.table({"part": pa.array([r["part"] for r in out], pa.int32()), "kind": pa.array([r["kind"] for r in out], pa.int32()), **{k: pa.array([r.get(k) for r in out], pa.binary()) for k in ("rows", "starts", "ends")}})

    def _remove(self, docs: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts = documents(docs)
        told = found.to_pylist()
        get = lambda kind, c: np.concatenate([np.empty(0, np.int64), *(unsqueezed(r[c]) for r in told if r["kind"] == kind)])
        rows, starts, ends = (get(SPANS, c) for c in ("rows", "starts", "ends"))
        more = get(TIED, "rows")[np.isin(get(TIED, "starts"), get(NAMED, "rows"))]
        if len(more):
            rows, starts, ends = np.r_[rows, more >> 40], np.r_[starts, more & MOST_PLACE], np.r_[ends, (more & MOST_PLACE) + self.width]
        order = np.lexsort((starts, rows))
        rows, starts, ends = rows[order], starts[order], ends[order]
        cut = np.searchsorted(rows, np.arange(len(ids) + 1))
        return self.apply(ids, texts, [merged(starts[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]]) for i in range(len(ids))])

    def run(self, docs: DataFrame) -> DataFrame:
        """Rows of ``result`` for (doc_id, text)."""
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        count = lambda text: max(LEAST_PARTS, -(-size // text))
        parts, buckets, shards = count(PART_BYTES), count(BUCKET_BYTES), count(SHARD_BYTES)
        # one anchor in 128 is marked for an equal hash by chance
        bits = min(64, max(32, (size // 8).bit_length() + 7))
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")).mapInArrow(_pack, PACKED)
        marks = docs.groupBy("part").applyInArrow(self._distinct(buckets, bits), "bucket int, part int, keys binary, counts binary")
        marks = marks.groupBy("bucket").applyInArrow(self._mark, "part int, bucket int, codes binary")
        sent = docs.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(self._send(shards, bits), SENT)
        spans = sent.groupBy("shard").applyInArrow(lambda t: self._answer(t), "part int, kind int, rows binary, starts binary, ends binary")
        return docs.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(lambda d, f: self._remove(d, f), self.result)


@dataclass
class Settled:
    """Of hot windows, by index: which are sent and with what weight, which are removed by what the part itself knows, and which (``tied``) are
    removed if and only if the sent window ``names`` is."""

    sent: np.ndarray
    weight: np.ndarray
    gone: np.ndarray
    tied: np.ndarray
    names: np.ndarray


#: Kinds of rows: stretches for a shard; spans to remove; windows sent that are to be removed; windows that depend on them.
STRETCHES, SPANS, NAMED, TIED = range(4)
SENT = "shard int, part int, kind int, many int, rows binary, starts binary, ends binary, data binary"
MOST_PLACE = (1 << 40) - 1


def _place(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A document's number in its part and a place in it as one number."""
    return (row.astype(np.int64) << 40) | start.astype(np.int64)


def _columns(asked: list[dict]) -> dict[str, np.ndarray]:
    """What is told of each stretch: its document's number in the part, its first and last window, the place of the anchor in the first window, the
    weight, whether other windows depend on it, the document's id."""
    whole = zstandard.ZstdDecompressor().decompress
    place = np.concatenate([unsqueezed(r["rows"]) for r in asked])
    flags = np.concatenate([np.frombuffer(whole(r["ends"]), np.uint8).reshape(4, -1) for r in asked], axis=1)
    seen = {"row": place >> 40, "first": place & MOST_PLACE, "id": np.concatenate([unsqueezed(r["starts"]) for r in asked]), "offset": flags[1], "weight": flags[2], "named": flags[3]}
    return seen | {"last": seen["first"] + flags[0]}


def _sent(out: list[dict]) -> pa.Table:
    types = {n: pa.int32() if t == "int" else pa.binary() for n, t in (c.split() for c in SENT.split(", "))}
    return pa.table({n: pa.array([r.get(n) for r in out], t) for n, t in types.items()})


def _packed_spans(part: int, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict:
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order].astype(np.int64), starts[order].astype(np.int64), ends[order].astype(np.int64)
    # spans of a document that meet are sent as one
    high = np.maximum.accumulate((rows << 40) + ends)
    new = np.flatnonzero(np.r_[True, (rows[1:] << 40) + starts[1:] > high[:-1]]) if len(rows) else np.empty(0, np.int64)
    last = np.r_[new[1:], len(rows)] - 1
    return {"part": part, "rows": squeezed(rows[new]), "starts": squeezed(starts[new]), "ends": squeezed(high[last] - (rows[new] << 40))}


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans as maximal runs: spans that overlap or touch are one."""
    if not len(starts):
        return starts, ends
    high = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.r_[True, starts[1:] > high[:-1]])
    return starts[new], high[np.r_[new[1:], len(starts)] - 1]


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits as their differences, all first bytes, then all second bytes, and so on, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.diff(values.view(np.uint64) if values.dtype == np.int64 else values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64).view(np.int64)


def _bucket_cuts(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's range begins in sorted keys of so many bits."""
    top = min(bits, 32)
    return np.searchsorted(((keys >> np.uint64(bits - top)) * np.uint64(buckets)) >> np.uint64(top), np.arange(buckets + 1, dtype=np.uint64))


def _window_hashes(units: Units, starts: np.ndarray, width: int) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), CHUNK):
        some, g = starts[i : i + CHUNK], np.zeros(len(starts[i : i + CHUNK]), np.uint64)
        for j in range(width):
            g = g * BASE + units[some + j]
        out[i : i + CHUNK] = mixed(g)
    return out
