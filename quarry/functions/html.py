"""HTML to title, text and links, by regular expressions that run inside the JVM."""

from __future__ import annotations

from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, tokenize
from .urls import normalize_url, resolve

BREAK = "\u0001"
#: A tag: quoted values of attributes may hold >; without closing quotes it ends at the next >.
TAG = r"""(?s)<(?:[A-Za-z/!?][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|[A-Za-z/!?][^>]*+>)"""
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


#: The standard's names (with their semicolon) and characters, as the standard library has them: one line for each, between line feeds. A text for each code point
#: from A to z that a name can begin with, so that a name is looked for among those of its letter only.
NAMED = ["\n" + "".join(f"{n}\t{c}\n" for n, c in sorted(entities.html5.items()) if n.endswith(";") and "\n" not in c and ord(n[0]) == first) for first in range(ord("A"), ord("z") + 1)]


def _named(name: Column) -> Column:
    """The characters of a name, null if there is none."""
    lines = F.get(F.array(*map(F.lit, NAMED)), F.ascii(name) - ord("A"))
    at = F.position(F.concat(F.lit("\n"), name, F.lit("\t")), lines)
    return F.when(at > 0, F.substring_index(F.substring(lines, at + F.length(name) + 2, F.lit(8)), "\n", 1))


def _character(ref: Column) -> Column:
    """What a reference stands for; one that stands for nothing is left as it is. Numbers from 128 to 159 are meant in Windows-1252."""
    number = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "^&#[xX](.*);", 1), 16, 10)).otherwise(F.regexp_extract(ref, "^&#([0-9]+);", 1)).cast("int")
    wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    coded = F.when(number.between(128, 159), F.substring(F.lit(bytes(range(128, 160)).decode("cp1252", "replace")), number - 127, F.lit(1))).when((number > 0) & ~number.between(0xD800, 0xDFFF) & (number <= 0x10FFFF), wide).otherwise(F.lit("\ufffd"))
    return F.when(ref.startswith("&#"), coded).otherwise(F.coalesce(_named(F.substring(ref, 2, 40)), ref))


def _replaced(text: Column, pattern: str, by) -> Column:
    """The text with ``by(match)`` in place of every match of a pattern without groups."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.when(m.isNull(), F.lit("")).otherwise(by(m)))), "")


def decode(text: Column) -> Column:
    """Character references, numbers and names with their semicolon, as what they stand for."""
    return let(text, lambda t: F.when(t.contains("&"), _replaced(t, REFERENCE, _character)).otherwise(t))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _pieces(html: Column) -> Column:
    """Text nodes, stripped, without empty ones."""
    nodes = F.split(F.regexp_replace(html, TAG, BREAK), BREAK)
    return F.filter(F.transform(nodes, lambda n: strip(decode(n))), lambda n: n != "")


def _bare(html: Column) -> Column:
    # character data is text, whatever it looks like
    plain = lambda m: F.concat(F.lit(BREAK), F.replace(F.replace(F.regexp_extract(m, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(BREAK))
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", BREAK)
    html = let(html, lambda h: F.when(h.contains("<![CDATA["), _replaced(h, r"(?s)<!\[CDATA\[.*?\]\]>", plain)).otherwise(h))
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", BREAK)


def title(html: Column) -> Column:
    """The title if the page has one that isn't empty, else the first heading, else nothing."""
    inner = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    heading = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    return F.coalesce(F.when(inner != "", strip(decode(inner))).otherwise(F.array_join(_pieces(heading), "")), F.lit(""))


def visible_text(html: Column) -> Column:
    """All text but scripts, styles and comments; the title is part of it."""
    return F.array_join(_pieces(_bare(html)), " ")


def quoted_links(html: Column) -> Column:
    """The values of the anchors' href attributes as they are written, in order; values of other attributes are passed over."""
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
    return F.regexp_extract_all(_bare(html), F.lit(rf"""(?is)<a(?=\s)(?:\s++(?!href[\s=])[^\s=>"']++(?:\s*+=\s*+{value})?)*+\s++href\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)"""), F.lit(1))


def links(html: Column, url: Column) -> Column:
    """Where the page's anchors lead, resolved and canonical, each once, in order."""
    hrefs = F.transform(quoted_links(html), lambda q: strip(decode(F.regexp_replace(q, r"""^["']|["']$""", ""))))
    return F.array_distinct(F.filter(F.transform(hrefs, lambda h: normalize_url(resolve(url, h))), lambda u: u != ""))


def parse(html: Column, url: Column) -> Column:
    """A struct of url, title, text, tokens, links."""
    return let(visible_text(html), lambda text: F.struct(url.alias("url"), title(html).alias("title"), text.alias("text"), tokenize(text).alias("tokens"), links(html, url).alias("links")))
