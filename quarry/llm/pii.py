"""Personal data: regular expressions propose, checksums confirm, context words adjust.

Base kinds, always reported when they match and pass their check: email, ip, card (Luhn), phone. The method adds kinds that need more
evidence: iban (mod 97), secret (keys and passwords) and ssn. A proposal of these has a score by kind, to which a passed checksum
and a context word within CONTEXT characters before or after it add; it is reported from THRESHOLD on.

Everything is built from SQL functions. Positions come from the text's pieces between matches: a match starts after all
gaps and matches before it, by running sums over chunks of CHUNK of them, so that a text of many matches costs as much for each of them as a
text of few. Positions count code points, ends are exclusive.

Defined results: a null or empty text has no spans; equal rows give equal results; spans of different kinds may overlap; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

CONTEXT = 40
#: Numbers that are summed up together; three levels of chunks, the last one of any size, hold a quarter of a million chunks' sums at a small cost.
CHUNK = 64
#: Code points of the pieces that a text is masked by.
PIECE = 1024
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: str | None = None  #: name of a validator
    score: float = 1.0
    checked: float = 0.0  #: what a passed check adds; with None as score's base the check is a must
    context: str | None = None  #: a pattern of words that add ``near``
    near: float = 0.3
    needs: str | None = None  #: texts without a match of it hold none of this kind


#: A match of the base begins where a run begins or the match before it ended: the same matches as without these assertions, in linear time.
LOCAL, HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++", needs="@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", check="ip", needs=r"\.[0-9]"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+", check="card"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", check="phone", needs=r"\+"),
)
ADDED = (
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", check="iban", score=0.1, checked=0.6, context=r"(?i)iban|account|konto|compte|cuenta", near=0.2),
    Kind("secret", r"\bAKIA[A-Z0-9]{16}\b|(?<=password=)[^\x20\x09-\x0D]{6,}|(?<=api_key=)[^\x20\x09-\x0D]{8,}", score=0.7),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", score=0.4, context=r"(?i)ssn|social security|tax", near=0.3),
)
KINDS = BASE + ADDED


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of a string pass Luhn's check: from the right, every second digit doubled, digit sums divisible by 10."""
    ds = F.filter(F.split(F.reverse(_digits(s)), ""), lambda x: x != "")
    worth = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an IBAN's remainder is 1: first four characters moved to the end, letters as 10 to 35."""
    bare = F.regexp_replace(s, r"\x20", "")
    turned = F.concat(F.substring(bare, 5, 1000), F.substring(bare, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), step) == 1


def _part() -> str:
    return r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


CHECKS = {
    "ip": lambda s: s.rlike(rf"^(?:{_part()}\.){{3}}{_part()}$"),
    "card": lambda s: F.length(_digits(s)).between(12, 19) & luhn(s),
    "phone": lambda s: F.length(_digits(s)).between(9, 15),
    "iban": mod97,
}


def _running(x: Column, base: Column, join) -> Column:
    """base, then base with all numbers before it joined to it, for each number of an array of at most CHUNK."""
    zero = F.struct(base.alias("sum"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(x, zero, lambda a, n: F.struct(join(a["sum"], n).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")), lambda a: a["out"])


def before_each(x: Column, levels: int = 3, join=lambda a, n: a + n) -> Column:
    """For each number of an array of ints that aren't negative, which isn't empty, the sum of those before it, or what else ``join`` makes of them, from 0."""

    def of(x: Column) -> Column:
        # slice() would copy the whole array for each chunk
        chunks = F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(CHUNK)), lambda k: F.transform(F.sequence(k, F.least(k + CHUNK, F.size(x)) - 1), lambda i: F.get(x, i)))
        return let(chunks, joined)

    def joined(cs: Column) -> Column:
        sums = F.transform(cs, lambda c: F.aggregate(c, F.lit(0), join))
        return F.flatten(F.zip_with(cs, before_each(sums, levels - 1, join), lambda c, base: _running(c, base, join)))

    return let(x, of) if levels else _running(x, F.lit(0), join)


def _near(found: Column, gaps: Column, i: Column) -> Column:
    """The text within CONTEXT characters of match i. Matches that need context have ten characters or more, so that a few neighbours suffice."""
    m = lambda k: F.coalesce(F.get(found, i + k), F.lit(""))
    g = lambda k, side: side(F.coalesce(F.get(gaps, i + k), F.lit("")), F.lit(CONTEXT))
    ahead = F.concat(*[x for k in range(-4, 0) for x in (g(k, F.right), m(k))], g(0, F.right))
    after = F.concat(g(1, F.left), *[x for k in range(1, 5) for x in (m(k), g(k + 1, F.left))])
    return F.concat(F.right(ahead, F.lit(CONTEXT)), F.lit("\n"), F.left(after, F.lit(CONTEXT)))


def _matches(text: Column, kind: Kind, order: int) -> Column:
    """The confirmed spans of one kind in a text that isn't null: an array of (start, order, end, kind)."""
    found = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(1))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    passed = CHECKS[kind.check] if kind.check else lambda m: F.lit(True)

    def good(m: Column, near) -> Column:
        if kind in BASE:
            return passed(m)
        score = F.lit(kind.score) + F.when(passed(m), F.lit(kind.checked)).otherwise(0.0)
        return score + (F.when(near.rlike(kind.context), F.lit(kind.near)).otherwise(0.0) if kind.context else F.lit(0.0)) >= THRESHOLD

    def placed(both: Column) -> Column:
        ms, gaps = both["m"], both["g"]
        # a match begins after the gaps and matches before it and its own gap
        lengths = F.transform(ms, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
        starts = F.zip_with(before_each(lengths), F.transform(ms, lambda m, i: F.length(F.get(gaps, i))), lambda a, b: a + b)
        spans = F.zip_with(ms, starts, lambda m, at: F.struct(at.alias("start"), F.lit(order).alias("order"), (at + F.length(m)).alias("end"), F.lit(kind.name).alias("kind"), m.alias("m")))
        if kind.context:
            kept = F.filter(spans, lambda x, i: good(x["m"], _near(ms, gaps, i)))
        else:
            kept = F.filter(spans, lambda x: good(x["m"], None))
        return F.transform(kept, lambda x: x.dropFields("m"))

    def some(ms: Column) -> Column:
        both = F.struct(ms.alias("m"), F.split(text, kind.pattern, -1).alias("g"))
        return F.when(F.size(ms) == 0, none).otherwise(let(both, placed))

    # texts without what the kind needs aren't searched, texts without a match aren't split
    return F.when(text.rlike(kind.needs or kind.pattern), let(found, some)).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, text and an array of spans for each kind, under the kind's name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", *[_matches(F.col("text"), k, i).alias(k.name) for i, k in enumerate(kinds)])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans, all spans and their number."""
    base = F.concat(*[F.col(k.name) for k in BASE])
    every = F.concat(*[F.col(k.name) for k in KINDS])
    return find(docs).select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
    )


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points of a text from start to end, from its pieces of PIECE: substring() of the text would count from its beginning for each span."""
    first = F.floor(start / PIECE).cast("int")
    some = F.transform(F.sequence(first, F.floor((end - 1) / PIECE).cast("int")), lambda i: F.get(pieces, i))
    return F.when(end > start, F.substring(F.array_join(some, ""), start - first * PIECE + 1, end - start)).otherwise("")


def mask(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by <kind>; where spans overlap the first one is named."""
    every = F.array_sort(F.concat(*[F.col(k.name) for k in KINDS]))
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % PIECE), F.lit(0))

    def of(x: Column) -> Column:
        # up to where the spans before each one reach
        reached = before_each(F.transform(x["spans"], lambda s: s["end"]), join=lambda a, n: F.greatest(a, n))
        spans = F.zip_with(x["spans"], reached, lambda s, r: F.struct(r.alias("from"), s["start"].alias("start"), s["kind"].alias("kind")))
        named = F.transform(F.filter(spans, lambda s: s["start"] >= s["from"]), lambda s: F.concat(_between(x["pieces"], s["from"], s["start"]), F.lit("<"), s["kind"], F.lit(">")))
        rest = _between(x["pieces"], F.array_max(F.transform(x["spans"], lambda s: s["end"])), F.length("text"))
        return F.concat(F.array_join(named, ""), rest)

    masked = F.when(F.size(every) == 0, F.col("text")).otherwise(let(F.struct(every.alias("spans"), pieces.alias("pieces")), of))
    return find(docs).select("doc_id", masked.alias("text"))
