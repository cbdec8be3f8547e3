"""Line dedup by a log-template tree.

A line's tokens are what stands between blanks; tokens with a digit are variable. The tree has a fixed depth: the number of tokens, then
the first DEPTH tokens, or all that a shorter line has, variable ones as <*>. Under a leaf, a token stays in the template at its position if at least ``least`` texts have it there,
and is variable (<*>) otherwise. A template recurs if at least ``least`` texts have it and of its positions without a digit at least
CONSTANT are constant, and no fewer than those with a digit; lines whose template recurs are dropped wherever they stand.

Copies of a text count as one text, so that a document isn't taken for boilerplate because it was copied. The tree doesn't depend on the order of
the lines, and is built from aggregations: leaves are counted first, on hashes, and only lines of leaves that can hold a recurring template are looked at
again. Lines are pre-aggregated to distinct ones (forms). What ``least`` texts share in full needs no further counting: each token of such a form is usual, and
its template recurs. So texts are joined only to rarer forms, of which each has fewer than ``least``; where a form or leaf of a third of the lines
has to be met, its rows are dealt to SALTS tasks.

A row is known by its doc_id and a 64-bit hash of its text, a form by 64-bit hashes of its leaf and of its tokens together, a template likewise.

Defined results: a null text has no lines and stays null; blank lines reach no leaf and stay; an empty text stays
empty; equal rows lose the same lines; a document that loses all lines keeps its row with an empty text; other columns are
kept by ``drop_recurring``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, let

DEPTH = 3
LEAST = 20
CONSTANT = 0.6
ANY = "<*>"
SALTS = 32
#: Up to so many leaves (8 bytes each) are broadcast; more are joined.
BROADCAST_LEAVES = 500_000
BLANK = r"^[\x20\x09-\x0D]*$"


def _tokens(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), BLANKS)


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(ANY)).otherwise(t))


def _leaf(line: Column) -> Column:
    """The leaf of a line, as a hash; null for blank lines. The line is matched for its first tokens, and its tokens are counted."""
    first = F.regexp_extract(line, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,%d})" % (DEPTH - 1), 1)
    return F.when(first != "", F.xxhash64(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")), _masked(F.split(first, BLANKS))))


def _salted(left: DataFrame, small: DataFrame, on: list[str], by: str) -> DataFrame:
    """left joined to a side that has each key once. Any key may stand in a third of the rows of left: they are dealt to SALTS tasks by ``by``,
    and the other side is sent to all of them."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(by, F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def recurring(docs: DataFrame, least: int = LEAST, constant: float = CONSTANT) -> DataFrame:
    """(doc_id, whole, place): the lines to drop, by doc_id and hash of the row's text and by number in the text from 0."""
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("whole"), F.split("text", "\n").alias("lines"))
    # one row for each leaf of a text, without the text
    leaves = lines.select("whole", F.explode(F.array_distinct(F.transform("lines", _leaf))).alias("leaf")).where("leaf is not null")
    leaves = cut(leaves.distinct().groupBy("leaf").count().where(F.col("count") >= least).select("leaf"))
    placed = lines.select("doc_id", "whole", F.explode(F.filter(F.transform("lines", lambda x, i: F.struct(_leaf(x).alias("leaf"), i.alias("place"), x.alias("line"))), lambda x: x["leaf"].isNotNull())).alias("x"))
    placed = placed.select("doc_id", "whole", "x.leaf", "x.place", "x.line")
    placed = placed.join(F.broadcast(leaves), "leaf") if leaves.count() <= BROADCAST_LEAVES else _salted(placed, leaves, ["leaf"], "whole")
    placed = cut(placed.select("doc_id", "whole", "leaf", "place", _masked(_tokens(F.col("line"))).alias("tokens")).withColumn("form", F.xxhash64("tokens")))
    texts = placed.select("leaf", "form", "whole").distinct()
    forms = placed.groupBy("leaf", "form").agg(F.first("tokens").alias("tokens")).join(texts.groupBy("leaf", "form").agg(F.count("*").alias("texts")), ["leaf", "form"])
    forms = cut(forms.withColumn("often", F.col("texts") >= least))
    # texts of the forms that fewer than ``least`` have
    few = cut(_salted(texts, forms.where("not often").select("leaf", "form"), ["leaf", "form"], "whole"))
    # which tokens ``least`` texts have at a position
    spread = forms.select("leaf", "form", "often", F.posexplode("tokens").alias("at", "token"))
    by_form = spread.where(F.col("often") & (F.col("token") != ANY)).select("leaf", "at", "token").distinct()
    by_text = spread.where(~F.col("often") & (F.col("token") != ANY)).join(few, ["leaf", "form"]).select("leaf", "at", "token", "whole").distinct().groupBy("leaf", "at", "token").count()
    usual = by_form.unionByName(by_text.where(F.col("count") >= least).select("leaf", "at", "token")).distinct().withColumn("usual", F.lit(True))
    general = spread.join(usual, ["leaf", "at", "token"], "left").withColumn("part", F.when(F.col("usual"), F.col("token")).otherwise(F.lit(ANY)))
    judged = F.when(F.col("usual"), 1.0).when(F.col("token") != ANY, 0.0)
    general = general.groupBy("leaf", "form", "often").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"), F.avg(judged).alias("share"), F.count(F.col("usual")).alias("same"), F.count(F.when(F.col("token") == ANY, 1)).alias("digits"))
    general = cut(general.where((F.col("share") >= constant) & (F.col("same") >= F.col("digits"))).select("leaf", "form", "often", F.xxhash64(F.transform("parts", lambda p: p["part"])).alias("template")))
    # a template recurs by one of its forms, or by the texts of the rarer ones
    support = few.join(general.where("not often").select("leaf", "form", "template"), ["leaf", "form"]).select("leaf", "template", "whole").distinct().groupBy("leaf", "template").count()
    found = general.where("often").select("leaf", "template").distinct().unionByName(support.where(F.col("count") >= least).select("leaf", "template")).distinct()
    return _salted(placed.select("doc_id", "whole", "leaf", "form", "place"), general.join(found, ["leaf", "template"]).select("leaf", "form"), ["leaf", "form"], "whole").select("doc_id", "whole", "place")


def _without(text: Column, gone: Column) -> Column:
    """The lines of a text but those at the sorted places, put together from the runs between them."""

    def of(x: Column) -> Column:
        runs = F.transform(x["ends"], lambda e, k: F.struct((F.coalesce(F.get(x["ends"], k - 1), F.lit(-1)) + 1).alias("from"), e.alias("to")))
        runs = F.filter(runs, lambda r: r["from"] < r["to"])
        # slice() would copy all lines for each run
        return F.array_join(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(r["from"], r["to"] - 1), lambda i: F.get(x["lines"], i)))), "\n")

    return let(let(F.split(text, "\n"), lambda lines: F.struct(lines.alias("lines"), F.concat(gone, F.array(F.size(lines))).alias("ends"))), of)


def drop_recurring(docs: DataFrame, least: int = LEAST, constant: float = CONSTANT) -> DataFrame:
    """``docs`` with the recurring lines cut out of the texts, and one more column, n_dropped, which takes the place of one of that name."""
    gone = recurring(docs, least, constant).groupBy("doc_id", "whole").agg(F.array_sort(F.collect_set("place")).alias("gone")).alias("g")
    # the documents travel as one column, so that none of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", F.xxhash64("text").alias("whole")).alias("d")
    rows = rows.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.whole") == F.col("g.whole")), "left").select("doc", "gone")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(_without(F.col("doc.text"), F.col("gone")))
    kept = [text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c != "n_dropped"]
    return rows.select(*kept, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of lines that aren't blank, how many were dropped, the digest of the text that is kept."""
    n = F.size(F.filter(F.split(F.coalesce("before", F.lit("")), "\n"), lambda x: ~x.rlike(BLANK)))
    kept = drop_recurring(docs.select("doc_id", "text", F.col("text").alias("before")))
    return kept.select("doc_id", n.cast("long").alias("n_lines"), "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
