"""Text expressions: tokens, fingerprint, snippet, highlight. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
SNIPPET_WIDTH = 30
ELLIPSIS = "…"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def equal_runs(tokens: Column) -> Column:
    """The distinct tokens in order, each as often as it occurs, with a space after each occurrence."""
    return F.regexp_extract_all(F.concat(F.array_join(F.sort_array(tokens), " "), F.lit(" ")), F.lit(rf"({TOKEN} )\1*+"), F.lit(0))


def token_count(text: Column) -> Column:
    """How many tokens ``tokenize`` gives, without making them."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN)).cast("long")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def content_digest(text: Column) -> Column:
    return F.sha1(collapse(F.coalesce(text, F.lit(""))))


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def make_snippet(text: Column, terms: Column, width: int = SNIPPET_WIDTH) -> Column:
    """The passage of ``width`` tokens with the most distinct terms, then most hits, the earliest of equals; the opening where no term occurs."""
    half = width // 2
    whole = F.coalesce(text, F.lit(""))
    pieces = F.regexp_extract_all(whole, F.lit("([A-Za-z0-9]+)([^A-Za-z0-9]*)"), F.lit(0))

    def of(ps: Column) -> Column:
        n = F.size(ps)

        def with_tokens(ts: Column) -> Column:
            at = lambda h: F.greatest(F.lit(0), h - half)
            window = lambda s: F.slice(ts, s + 1, F.lit(width))
            worth = lambda s: 100 * F.size(F.array_intersect(window(s), terms)) + F.size(F.filter(window(s), lambda t: F.array_contains(terms, t)))
            hits = F.filter(F.transform(ts, lambda t, i: F.when(F.array_contains(terms, t), i)), lambda i: i.isNotNull())
            best = F.array_max(F.transform(hits, lambda h: F.struct(worth(at(h)).alias("worth"), (-at(h)).alias("back"))))
            return let(F.coalesce(-best["back"], F.lit(0)), passage)

        def passage(start: Column) -> Column:
            end = F.least(start + width, n)
            body = F.concat(F.array_join(F.slice(ps, start + 1, end - start - 1), ""), F.regexp_extract(F.get(ps, end - 1), "^[A-Za-z0-9]+", 0))
            return F.concat(F.when(start > 0, F.lit(ELLIPSIS + " ")).otherwise(""), collapse(body), F.when(end < n, F.lit(" " + ELLIPSIS)).otherwise(""))

        tokens = F.transform(ps, lambda p: F.lower(F.regexp_extract(p, "^[A-Za-z0-9]+", 0)))
        return F.when(n == 0, F.lit("")).otherwise(let(tokens, with_tokens))

    return let(pieces, of)


def highlight(snippet: Column, terms: Column) -> Column:
    """The snippet as segments (text, match); neighbours that match alike are one segment, and the segments put together are the snippet."""
    pieces = F.regexp_extract_all(F.coalesce(snippet, F.lit("")), F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    marked = F.transform(pieces, lambda p: F.struct(p.alias("text"), F.array_contains(terms, F.lower(p)).alias("match")))
    none = F.array().cast("array<struct<text:string,match:boolean>>")

    def fold(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(F.concat(last["text"], x["text"]).alias("text"), x["match"].alias("match"))
        return F.when((F.size(done) > 0) & (last["match"] == x["match"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(marked, none, fold)
