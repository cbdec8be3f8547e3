"""Quality rules: a threshold table compiled into one projection, without user functions.

``measures`` gives the numbers of a text, ``RULES`` the table of thresholds, ``verdict`` compiles the table into one boolean
expression, ``assess`` is the projection. A document fails the base if it has under 20 words or over 30 % repeated words.

Defined results: a null or blank text has no words, fails the base and all ratios count as 0; ties and equal rows are judged alike; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, word_array

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of the corpus's languages.
STOP_WORDS = "the of and to in is a that der die das und in zu le la les de et que un el los y en".split()


@dataclass(frozen=True)
class Rule:
    """Fails when ``measure`` is below ``least`` or above ``most``, each as a share of ``per`` (a measure too) if that is given."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


#: The production thresholds.
RULES = (
    Rule("few words", "n_words", least=20),
    Rule("many words", "n_words", most=200_000),
    Rule("short words", "word_chars", "n_words", least=2.0),
    Rule("long words", "word_chars", "n_words", most=14.0),
    Rule("symbols", "n_symbols", "n_words", most=0.5),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=0.3),
    Rule("repeated words", "n_repeat_words", "n_words", most=0.3),
    Rule("stop words", "n_stop_words", "n_words", least=0.01),
)


def _repeat_words(words: Column, n: int) -> Column:
    """Words inside windows of n words that the text has twice or more. Windows are known by 64-bit hashes, compared within one text
    only; sorted positions of the repeated ones give the union of their spans."""
    count = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), count - n + 1), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(count <= n, F.lit(0)).otherwise(_covered(hashes, n)).cast("long")


def _covered(hashes: Column, n: int) -> Column:
    """Positions covered by windows whose hash the array holds twice or more."""

    def of(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
        starts = lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"]))
        spans = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, starts), spans))

    return let(hashes, of)


def measures(text: Column) -> Column:
    """A struct of a text's numbers."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n")

    def of(words: Column) -> Column:
        filled = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            F.size(filled).cast("long").alias("n_lines"),
            (F.size(filled) - F.size(F.array_distinct(filled))).cast("long").alias("n_dup_lines"),
            _repeat_words(words, WINDOW).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return let(word_array(text), of)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table fails."""
    kept = F.lit(True)
    for r in rules:
        v = m[r.measure].cast("double")
        if r.per:
            v = F.when(m[r.per] > 0, v / m[r.per]).otherwise(F.lit(0.0))
        if r.least is not None:
            kept = kept & (v >= F.lit(float(r.least)))
        if r.most is not None:
            kept = kept & (v <= F.lit(float(r.most)))
    return kept


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, kept."""
    found = docs.select("doc_id", measures(F.col("text")).alias("m"))
    m = F.col("m")
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return found.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"), "m.n_lines", "m.n_stop_words")
