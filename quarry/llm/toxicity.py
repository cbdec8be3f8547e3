"""Toxicity by compression distance: windows are compressed with a dictionary of toxic and one of ordinary text.

Training takes a bounded sample of labelled rows. Both dictionaries are trained by zstandard: the ordinary one on windows of ordinary documents, the toxic one on
the passages of toxic documents that set them apart, as they stand there (words that begin like what is found in far more toxic than ordinary
documents). The toxic content is laid before the same ordinary content, at the same distances: a window of ordinary text has the same length
under both, a window of toxic text is shorter under the toxic one. Every window begins with LEAD, on which both dictionaries end: a window
without any other match would be stored raw, and so would one whose only match is a short one, which then couldn't be seen. The score of a document is a logistic function of how
many windows pass each length threshold; it is fitted by folds, so that no row is measured with a dictionary that has
seen it, and moved so that score 0.7 is the point of best balance of precision and recall over the training rows, where precision counts double.

Defined results: a null or blank text has no window and scores as a text without toxic windows; rows whose label is null, or whose doc_id
is null, are not used in training; a doc_id with several labels is toxic if one of them is; with no sample of either class every score is
0.0; equal texts score alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a window; windows follow each other, so that each word is in one of them.
WINDOW = 4
#: What each window begins with.
LEAD = b"=-=-#=-=-#=-=-#=-=-#=-=-"
#: Lengths of the word beginnings that are counted as evidence.
BEGINNINGS = range(4, 10)
MARKS = b".,;:!?\"'()|"
LEVEL = 10
#: Bounds of the training sample: rows of each class, bytes of a text (longer ones aren't trained on), windows of an ordinary document.
SAMPLE_ROWS = 3000
SAMPLE_TEXT_BYTES = 50_000
SAMPLE_WINDOWS = 8
#: Sizes that the dictionaries are trained to.
ORDINARY_BYTES = 4000
TOXIC_BYTES = 3000
#: Bytes a window must save under the toxic dictionary, for each feature.
SAVINGS = (1, 2, 3, 5)
DECISION = 0.7
#: How much recall weighs against precision where the decision is placed.
BETA = 0.5


def windows(words: list[bytes]) -> list[bytes]:
    return [LEAD + b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _units(words: list[bytes]) -> set[bytes]:
    """What evidence is counted on: words without punctuation, and beginnings of words."""
    bare = {w.strip(MARKS) for w in words}
    return bare | {w[:n] + b"~" for w in bare for n in BEGINNINGS if len(w) > n}


def _distinct(docs: list[list[bytes]]) -> list[list[bytes]]:
    """One document for each least hash of five words: near copies of a document nearly always share it."""
    return list({min(zlib.crc32(b" ".join(ws[i : i + 5])) for i in range(max(1, len(ws) - 4))): ws for ws in docs}.values())


def _evidence(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Words and word beginnings in at least 2 % of the toxic documents, at least 12 times as common there, and found twice in each half of them (once, or
    not at all, where the sample is so small that nothing else is left): what is in few documents by chance is in one half. A
    beginning is left out where one of its continuations is nearly as frequent."""
    halves, o = [Counter(), Counter()], Counter()
    for i, words in enumerate(toxic):
        halves[i % 2].update(_units(words))
    for words in ordinary:
        o.update(_units(words))
    t = halves[0] + halves[1]
    least = max(3.0, 0.02 * len(toxic))
    told = {u for u, n in t.items() if len(u) > 2 and n >= least and (n / (len(toxic) + 1)) > 12 * (o[u] + 0.5) / (len(ordinary) + 1)}
    found = next((f for f in ({u for u in told if min(halves[0][u], halves[1][u]) >= k} for k in (2, 1)) if f), told)
    count: dict[bytes, int] = {}
    for u in found:
        count[u.rstrip(b"~")] = max(t[u], count.get(u.rstrip(b"~"), 0))
    return {u for u, n in count.items() if not any(v != u and v.startswith(u) and 1.3 * m >= n for v, m in count.items())}


def _passages(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """The words of toxic documents that begin like the evidence, each as it stands there and as often. Copies of a document are counted once, or what
    is rare in it would seem frequent."""
    toxic = _distinct(toxic)
    told = _evidence(toxic, ordinary)
    most = max(map(len, told), default=0)
    return [b" " + w + b" " for ws in toxic for w in ws if any(b[:n] in told for b in [w.strip(MARKS)] for n in range(3, min(len(b), most) + 1))]


@dataclass
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    @classmethod
    def train(cls, toxic: list[list[bytes]], ordinary: list[list[bytes]], seed: int = 11) -> Dictionaries:
        rng = random.Random(seed)
        plain = [w[len(LEAD) :] for ws in map(windows, ordinary) for w in rng.sample(ws, min(len(ws), SAMPLE_WINDOWS))]
        rng.shuffle(plain)
        common, told = cls._trained(plain, ORDINARY_BYTES), _passages(toxic, ordinary)
        rng.shuffle(told)
        return cls(common, (cls._trained(told, TOXIC_BYTES) + b" " if told else b"") + common)

    @staticmethod
    def _trained(samples: list[bytes], size: int) -> bytes:
        if len(samples) >= 64:
            try:
                return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
            except zstandard.ZstdError:  # too little or too uniform text to train on
                pass
        return b"".join(samples)[-size:] or b" the "

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False))
        return made[0], made[1]


def features(words: list[bytes], ordinary, toxic) -> np.ndarray:
    """Of a document: 1, then for each threshold how many windows save that much (log) and their share, then the greatest saving."""
    saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(words)] or [0])
    counts = [(saved >= s).sum() for s in SAVINGS]
    return np.array([1.0, *np.log1p(counts), *(np.sqrt(c / len(saved)) for c in counts), min(12, max(0, saved.max())) / 4])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    dictionaries: Dictionaries
    weights: np.ndarray

    @classmethod
    def train(cls, rows: list[tuple[str | None, int]]) -> Model | None:
        """rows: (text, 1 for toxic or 0)."""
        docs = [(split(t), y) for t, y in sorted(rows, key=lambda r: (r[1], r[0] or ""))]
        toxic, ordinary = [w for w, y in docs if y], [w for w, y in docs if not y]
        if not toxic or not ordinary:
            return None
        x, y = [], []
        for fold in (0, 1):  # each half is measured with dictionaries of the other
            d = Dictionaries.train(toxic[1 - fold :: 2] or toxic, ordinary[1 - fold :: 2] or ordinary)
            o, t = (c.compress for c in d.compressors())
            for of, label in ((toxic[fold::2], 1), (ordinary[fold::2], 0)):
                x += [features(w, o, t) for w in of]
                y += [label] * len(of)
        a, b = np.array(x), np.array(y, float)
        w = _fit(a, b)
        w[0] += np.log(DECISION / (1 - DECISION)) - cls._threshold(a @ w, b)
        return cls(Dictionaries.train(toxic, ordinary), w)

    @staticmethod
    def _threshold(z: np.ndarray, y: np.ndarray) -> float:
        """The log-odds above which precision and recall are best balanced, halfway to the next lower value; above all of them where they don't differ."""
        order = np.argsort(-z, kind="stable")
        z, hit = z[order], np.cumsum(y[order])
        f = hit / (np.arange(1, len(z) + 1) + BETA**2 * y.sum())
        ends = np.flatnonzero(z[1:] < z[:-1])
        if not len(ends):
            return float(z[0]) + 1.0
        k = ends[np.argmax(f[ends])]
        return float(z[k] + z[k + 1]) / 2

    def scorer(self):
        o, t = (c.compress for c in self.dictionaries.compressors())
        return lambda text: float(1 / (1 + np.exp(-np.clip(features(split(text), o, t) @ self.weights, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, training=None) -> list[tuple[str | None, int]]:
    """At most ``rows`` labelled texts of each class, chosen by hash of doc_id, from the rows that ``training`` (a condition) allows; of these the
    texts of at most SAMPLE_TEXT_BYTES, so that what reaches the driver has a bound in bytes."""
    known = labels.where("doc_id is not null and toxic is not null").where(training if training is not None else F.lit(True))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(rows))
    # at most 2 * rows ids: a size with a bound
    short = docs.select("doc_id", "text").where(F.col("text").isNull() | (F.octet_length("text") <= SAMPLE_TEXT_BYTES))
    return [(r.text, r.toxic) for r in short.join(F.broadcast(chosen), "doc_id").select("text", "toxic").collect()]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, training=None) -> Model | None:
    return Model.train(sample(docs, labels, rows, training))


def with_score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """``docs`` with one more column, the score of its text, 0 to 1."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    bound = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 7 kB each

    def score(batches):
        of = bound.value.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.append_column(column, pa.array([of(t.as_py()) for t in texts], pa.float64()))

    return docs.mapInArrow(score, docs.withColumn(column, F.lit(None).cast("double")).schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, with training on rows that aren't held out."""
    model = train(docs, labels, training=~held_out())
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))
