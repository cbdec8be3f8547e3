"""The engine's registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import html, text, urls
from quarry.operators import crawl, evaluate, graph, index, ranking
from quarry.operators.suggest import suggest
from quarry.plans.engine import Engine
from quarry.plans.session import cut, pieces, spread
from quarry.sources import corpus

WORDS = {"q1": "en the", "q2": "ente tionen", "q3": "the estion the", "q4": "NDAT!"}
DIGITS = 6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def _index(spark: SparkSession, sf_dir: str, terms: DataFrame):
    """The index of the documents as far as the queries' terms need it, made once for all that follows."""
    return ranking.narrowed(index.build(_docs(spark, sf_dir)), terms)


def _authority(docs: DataFrame) -> DataFrame:
    """A made-up authority for documents, which have no links."""
    return docs.select("doc_id", ((F.col("doc_id") * 7919 % 1009 + 1) / 1010.0).alias("score"))


TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
BASE = f"""toks as (select doc_id, unnest({TOKENS}) as term from documents),
postings as (select term, doc_id, count(*)::bigint as tf from toks group by 1, 2),
lens as (select doc_id, len({TOKENS})::bigint as length from documents),
df as (select term, count(*)::bigint as df from postings group by 1),
stats as (select count(*)::bigint as n_docs, coalesce(avg(length), 0)::double as avgdl from lens),
q(query_id, query) as (values {", ".join(f"('{k}', '{v}')" for k, v in WORDS.items())}),
qt as (select query_id, term, count(*)::bigint as qtf from (select query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as term from q) group by 1, 2),
authority as (select doc_id, ((doc_id * 7919) % 1009 + 1) / 1010.0::double as a from documents)"""
TFIDF = "sum(qtf * (tf::double / length * ln(n_docs::double / df)))"
BM25 = "sum(qtf * (ln(1::double + (n_docs - df + 0.5::double) / (df + 0.5::double)) * tf * ({k1}::double + 1) / (tf + {k1}::double * (1 - {b}::double + {b}::double * case when avgdl = 0 then 1 else length / avgdl end))))"


def _scored(name: str, score: str) -> str:
    return f"{name} as (select query_id, doc_id, {score} as s from postings join qt using (term) join df using (term) join lens using (doc_id) cross join stats group by 1, 2)"


def _bm25(k1: float = 1.5, b: float = 0.75) -> str:
    return BM25.format(k1=k1, b=b)


def _top(source: str, limit: int | None, score: str = "s") -> str:
    return f"(select query_id, doc_id, round({score}, {DIGITS}) as score, row_number() over (partition by query_id order by round({score}, {DIGITS}) desc, doc_id)::bigint as rank from {source})" + (f" where rank <= {limit}" if limit else "")


def _blended(source: str, weight: float) -> str:
    m = f"max({{}}) over (partition by query_id)"
    part = lambda c: f"case when {m.format(c)} = 0 then 0 else {c} / {m.format(c)} end"
    return f"(select query_id, doc_id, {1 - weight}::double * ({part('s')}) + {weight}::double * ({part('a')}) as s from {source} join authority using (doc_id))"


@query(f"select doc_id, len({TOKENS})::bigint as n_tokens, len(list_distinct({TOKENS}))::bigint as n_terms from documents")
def tokenize_counts(spark, sf_dir):
    tokens = text.tokenize(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_terms"))


@query(f"with {BASE} select query_id, term, qtf from qt")
def query_terms(spark, sf_dir):
    return ranking.query_terms(spark, WORDS)


@query(f"with {BASE} select term, doc_id, tf from postings")
def postings(spark, sf_dir):
    return index.postings(_docs(spark, sf_dir))


@query(f"with {BASE} select term, df from df")
def doc_freq(spark, sf_dir):
    return index.document_frequency(index.postings(_docs(spark, sf_dir)))


@query(f"with {BASE} select n_docs, round(avgdl, 6) as avgdl, (select count(*) from df)::bigint as n_terms from stats")
def corpus_stats(spark, sf_dir):
    i = index.build(_docs(spark, sf_dir))
    return i.stats.crossJoin(F.broadcast(i.terms.agg(F.count("*").alias("n_terms")))).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms")  # one row


@query(f"with {BASE} select distinct query_id, doc_id from postings join qt using (term)")
def retrieve_or(spark, sf_dir):
    return ranking.retrieve(index.postings(_docs(spark, sf_dir)), ranking.query_terms(spark, WORDS))


@query(f"with {BASE} select term, df, round(ln(n_docs::double / df), {DIGITS}) as idf from df cross join stats")
def idf_classic(spark, sf_dir):
    i = index.build(_docs(spark, sf_dir))
    return i.terms.crossJoin(F.broadcast(i.stats)).select("term", "df", F.round(ranking.classic_idf(F.col("n_docs").cast("double"), F.col("df")), DIGITS).alias("idf"))


@query(f"with {BASE} select term, df, round(ln(1::double + (n_docs - df + 0.5::double) / (df + 0.5::double)), {DIGITS}) as idf from df cross join stats")
def idf_bm25(spark, sf_dir):
    i = index.build(_docs(spark, sf_dir))
    return i.terms.crossJoin(F.broadcast(i.stats)).select("term", "df", F.round(ranking.bm25_idf(F.col("n_docs").cast("double"), F.col("df")), DIGITS).alias("idf"))


@query(f"with {BASE}, {_scored('t', TFIDF)} select query_id, doc_id, score, rank from {_top('t', 10)}")
def tfidf_topk(spark, sf_dir):
    terms = ranking.query_terms(spark, WORDS)
    return ranking.search(_index(spark, sf_dir, terms), terms, method="tfidf", digits=DIGITS)


@query(f"with {BASE}, {_scored('t', _bm25())} select query_id, doc_id, score, rank from {_top('t', 10)}")
def bm25_topk(spark, sf_dir):
    terms = ranking.query_terms(spark, WORDS)
    return ranking.search(_index(spark, sf_dir, terms), terms, digits=DIGITS)


@query(f"with {BASE}, {_scored('t', _bm25())} select query_id, doc_id, round(s, {DIGITS}) as relevance from t where query_id = 'q3'")
def bm25_repeated_term(spark, sf_dir):
    terms = ranking.query_terms(spark, {"q3": WORDS["q3"]})
    found = ranking.relevance(_index(spark, sf_dir, terms), terms)
    return found.withColumn("relevance", F.round("relevance", DIGITS))


VARIANTS = ((1.2, 0.75), (1.5, 0.0), (1.5, 1.0), (2.0, 0.5))


@query(
    f"with {BASE}, "
    + ", ".join(_scored(f"t{n}", _bm25(k1, b)) for n, (k1, b) in enumerate(VARIANTS))
    + " "
    + " union all ".join(f"select {k1}::double as k1, {b}::double as b, query_id, doc_id, score, rank from {_top(f't{n}', 5)}" for n, (k1, b) in enumerate(VARIANTS))
)
def bm25_k1_b_variants(spark, sf_dir):
    terms = ranking.query_terms(spark, WORDS)
    i = _index(spark, sf_dir, terms)
    out = None
    for k1, b in VARIANTS:
        rows = ranking.search(i, terms, limit=5, k1=k1, b=b, digits=DIGITS).select(F.lit(k1).alias("k1"), F.lit(b).alias("b"), "query_id", "doc_id", "score", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"with {BASE}, {_scored('t', TFIDF)}, {_scored('m', _bm25())} select a.query_id, a.rank, a.doc_id as tfidf_doc, b.doc_id as bm25_doc, a.doc_id <> b.doc_id as moved from (select * from {_top('t', 5)}) a join (select * from {_top('m', 5)}) b on a.query_id = b.query_id and a.rank = b.rank")
def scorer_comparison(spark, sf_dir):
    return ranking.compare(index.build(_docs(spark, sf_dir)), ranking.query_terms(spark, WORDS), digits=DIGITS)


@query(f"with {BASE}, {_scored('t', _bm25())} select query_id, doc_id, score, rank from {_top(_blended('t', 0.2), 10)}")
def blended_search(spark, sf_dir):
    terms = ranking.query_terms(spark, WORDS)
    return ranking.search(_index(spark, sf_dir, terms), terms, _authority(_docs(spark, sf_dir)), digits=DIGITS)


@query(
    f"with {BASE}, {_scored('t', _bm25())} "
    + " union all ".join(f"select {float(w)}::double as weight, query_id, doc_id, score, rank from {_top(_blended('t', w), 10)}" for w in (0, 1))
)
def weight_zero_one(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    terms = ranking.query_terms(spark, WORDS)
    i = ranking.narrowed(index.build(docs), terms)
    rows = [ranking.search(i, terms, _authority(docs), weight=w, digits=DIGITS).withColumn("weight", F.lit(w)) for w in (0.0, 1.0)]
    return rows[0].unionByName(rows[1])


SNIPPET_SQL = """with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+[^A-Za-z0-9]*') as ps, ['ente', 'the'] as terms from documents),
t as (select *, list_transform(ps, lambda p: lower(regexp_extract(p, '^[A-Za-z0-9]+'))) as ts, len(ps) as n from d),
h as (select *, list_transform(list_filter(range(n), lambda i: list_contains(terms, ts[i + 1])), lambda i: greatest(0, i - 15)) as starts from t),
s as (select *, list_transform(starts, lambda s: 100 * len(list_intersect(list_distinct(ts[s + 1:s + 30]), terms)) + len(list_filter(ts[s + 1:s + 30], lambda x: list_contains(terms, x)))) as worth from h),
b as (select *, case when len(starts) = 0 then 0 else starts[list_position(worth, list_max(worth))] end as start from s),
e as (select *, least(start + 30, n) as stop from b)
select doc_id, case when n = 0 then '' else (case when start > 0 then '… ' else '' end)
 || trim(regexp_replace(array_to_string(ps[start + 1:stop - 1], '') || regexp_extract(ps[stop], '^[A-Za-z0-9]+'), '[\\s\\p{Z}]+', ' ', 'g')) || (case when stop < n then ' …' else '' end) end as snippet from e"""


@query(SNIPPET_SQL)
def snippet(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.make_snippet(F.col("text"), F.array(F.lit("ente"), F.lit("the"))).alias("snippet"))


@query(f"""with sn as ({SNIPPET_SQL}),
p as (select doc_id, unnest(regexp_extract_all(snippet, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) as piece, generate_subscripts(regexp_extract_all(snippet, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), 1) as i from sn),
m as (select *, list_contains(['ente', 'the'], lower(piece)) as match from p),
c as (select *, case when match is distinct from lag(match) over (partition by doc_id order by i) then 1 else 0 end as new from m),
g as (select *, sum(new) over (partition by doc_id order by i) as seg from c)
select doc_id, (seg - 1)::bigint as at, string_agg(piece, '' order by i) as segment, bool_or(match) as match from g group by doc_id, seg""")
def highlight(spark, sf_dir):
    terms = F.array(F.lit("ente"), F.lit("the"))
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.highlight(text.make_snippet(F.col("text"), terms), terms)).alias("at", "s"))
    return rows.select("doc_id", F.col("at").cast("long").alias("at"), F.col("s.text").alias("segment"), F.col("s.match").alias("match"))


@query(f"""with {BASE}, c as (select term, doc_id, round({_bm25().removeprefix('sum(qtf * ').removesuffix(')')}, {DIGITS}) as score from postings join df using (term) join lens using (doc_id) cross join stats
 where length(term) >= 4 and not regexp_matches(term, '^[0-9]+$') and df between 2 and greatest(2, n_docs // 2)),
b as (select term, doc_id, score from (select *, row_number() over (partition by term order by score desc, doc_id) as spot from c) where spot = 1)
select term, doc_id, score from (select *, row_number() over (partition by doc_id order by score desc, term) as spot from b) where spot = 1 order by score desc, term limit 20""")
def suggest_queries(spark, sf_dir):
    return suggest(index.build(_docs(spark, sf_dir)), 20, DIGITS)


# pages

#: The references that the SQL decodes, &amp; last; the tables hold no others.
ENTITIES = {"quot": '"', "apos": "'", "#39": "'", "lt": "<", "gt": ">", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "amp": "&"}
ENTITY_SQL = "{}"
for _name, _char in ENTITIES.items():
    ENTITY_SQL = f"replace({ENTITY_SQL}, '&{_name};', '{_char.replace(chr(39), chr(39) * 2)}')"
STRIP_SQL = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
BARE_SQL = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', chr(1), 'g'), '(?is)<(script|style)\\b.*?</(script|style)\\s*>', chr(1), 'g')"


def _pieces_sql(h: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({h}, '(?s)<[^>]*>', chr(1), 'g'), chr(1)), lambda x: {STRIP_SQL.format(ENTITY_SQL.format('x'))}), lambda x: x <> '')"


TEXT_SQL = f"array_to_string({_pieces_sql(BARE_SQL)}, ' ')"
TITLE_SQL = f"case when regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) <> '' then {STRIP_SQL.format(ENTITY_SQL.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title' + chr(92) + 'b[^>]*>(.*?)</title' + chr(92) + 's*>' + chr(39) + ', 1)'))} else array_to_string({_pieces_sql('regexp_extract(html, ' + chr(39) + '(?is)<h1' + chr(92) + 'b[^>]*>(.*?)</h1' + chr(92) + 's*>' + chr(39) + ', 1)')}, '') end"
NORMAL = r"""(with p as (select regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) as sch, regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) as net,
 regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) as path, regexp_extract({u}, '^[^?#]*\?([^#]*)', 1) as qs),
 n as (select lower(sch) as sch, path, case lower(sch) when 'http' then regexp_replace(lower(net), ':80$', '') when 'https' then regexp_replace(lower(net), ':443$', '') else lower(net) end as net,
 list_filter(list_transform(list_filter(string_split(qs, '&'), lambda x: x <> ''), lambda x: [url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), url_decode(replace(regexp_extract(x, '^[^=]*=?(.*)$', 1), '+', ' '))]),
 lambda kv: not regexp_matches(lower(kv[1]), '^(utm_|fbclid|gclid|msclkid|mc_cid|mc_eid)')) as kvs from p)
 select (case when sch <> '' then sch || ':' else '' end) || (case when net <> '' then '//' || net else '' end) || (case when path = '' and net <> '' then '/' else path end)
 || (case when len(kvs) > 0 then '?' || array_to_string(list_transform(kvs, lambda kv: replace(url_encode(kv[1]), '%20', '+') || '=' || replace(url_encode(kv[2]), '%20', '+')), '&') else '' end) from n)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_read(spark, sf_dir, "pages"))


@query(f"select page_id, {TITLE_SQL} as title, sha1({TEXT_SQL}) as text_sha1, len(regexp_extract_all(lower({TEXT_SQL}), '[a-z0-9]+'))::bigint as n_tokens from pages")
def parse_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.parse(F.col("html"), F.col("url")).alias("p")).select("page_id", "p.title", F.sha1("p.text").alias("text_sha1"), F.size("p.tokens").cast("long").alias("n_tokens"))


@query(f"select page_id, {NORMAL.format(u='url')} as url from pages")
def normalize_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.normalize_url(F.col("url")).alias("url"))


HREFS = f"""list_transform(regexp_extract_all({BARE_SQL}, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)', 1), lambda x: {STRIP_SQL.format(ENTITY_SQL.format("regexp_replace(x, '^[" + chr(34) + chr(39) * 2 + "]|[" + chr(34) + chr(39) * 2 + "]$', '', 'g')"))})"""
ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"


@query(f"""with h as (select page_id, url, unnest({HREFS}) as href, generate_subscripts({HREFS}, 1) as i from pages),
r as (select page_id, i, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') then href when href = '' then url when href[1] = '/' then {ROOT} || href when href[1] = '#' then regexp_extract(url, '^[^#]*') || href
 when href[1] = '?' then regexp_extract(url, '^[^?#]*') || href else {ROOT} || coalesce(nullif(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '^(.*/)', 1), ''), '/') || href end as target from h),
n as (select page_id, i, {NORMAL.format(u='target')} as link from r)
select page_id, link, min(i)::bigint as at from n where link <> '' group by 1, 2""")
def page_links(spark, sf_dir):
    """``at`` is the place among all anchors of the page of the first one that leads there."""
    rows = _pages(spark, sf_dir)
    every = rows.select("page_id", "url", F.posexplode(html.quoted_links(F.col("html"))).alias("at", "quoted"))
    href = html.strip(html.decode(F.regexp_replace("quoted", r"""^["']|["']$""", "")))
    found = every.select("page_id", "at", urls.normalize_url(urls.resolve(F.col("url"), href)).alias("link")).groupBy("page_id", "link").agg((F.min("at") + 1).cast("long").alias("at"))
    # the links that parsing reports are the same ones
    parsed = rows.select("page_id", F.explode(html.links(F.col("html"), F.col("url"))).alias("link"))
    return found.join(parsed, ["page_id", "link"])


SLUG_STEM = r"substr(regexp_replace(regexp_replace(regexp_replace(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?([^?#]*)', 1), '^/+|/+$', '', 'g'), '[^\p{{L}}\p{{N}}._-]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"


@query(f"select page_id, regexp_replace(case when s = '' then 'index' else s end, '\\.html$', '') || '-' || substr(sha1(url), 1, 6) || '.html' as filename from (select page_id, url, {SLUG_STEM.format(u='url')} as s from pages)")
def slugify(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.slugify(F.col("url")).alias("filename"))


DIGEST_SQL = "sha1(trim(regexp_replace({}, '[\\s\\p{{Z}}]+', ' ', 'g')))"


@query(f"select doc_id, {DIGEST_SQL.format('text')} as digest from documents")
def content_digest(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.content_digest(F.col("text")).alias("digest"))


@query(f"select min(doc_id) as doc_id, {DIGEST_SQL.format('text')} as digest from documents group by 2")
def dedupe_documents(spark, sf_dir):
    return crawl.first_of_content(_docs(spark, sf_dir), "doc_id").select("doc_id", "digest")


@query(f"select min(page_id) as page_id, {DIGEST_SQL.format(TEXT_SQL)} as digest from pages group by 2")
def dedupe_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", html.visible_text(F.col("html")).alias("text"))
    return crawl.first_of_content(pages, "page_id").select("page_id", "digest")


@query(f"""with d as (select page_id, {NORMAL.format(u='url')} as url, {TITLE_SQL} as title, len(regexp_extract_all(lower({TEXT_SQL}), '[a-z0-9]+'))::bigint as length from pages)
select row_number() over (order by url, page_id)::bigint - 1 as doc_id, url, title, length, round(1.0::double / (select count(*) from pages), 4) as authority from d""")
def stats_pages(spark, sf_dir):
    """None of the pages links to another one in the table, so that authority is even."""
    pages = _pages(spark, sf_dir).select(F.concat(urls.normalize_url(F.col("url")), F.lit("\u0001"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("filename"), "html", urls.normalize_url(F.col("url")).alias("url"))
    docs = corpus.parse_pages(pages)
    ranks = graph.pagerank(docs, graph.link_graph(docs))
    return docs.join(ranks, "doc_id").select("doc_id", "url", "title", "length", F.round("score", 4).alias("authority"))


@query(r"select page_id, case when regexp_matches(url, '(?i)^https?://') then url end as url, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) as host from pages")
def url_parts(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.followable(F.col("url")).alias("url"), urls.host(F.col("url")).alias("host"))


@query("select page_id from pages where octet_length(encode(html)) <= 2000000")
def fetch_filter(spark, sf_dir):
    """All pages, as responses that were found and are HTML."""
    heads = _pages(spark, sf_dir).withColumn("status", F.lit(200)).withColumn("content_type", F.lit("Text/HTML; charset=utf-8"))
    return crawl.usable(heads).select("page_id")


# the graph of parts that follow each other in an order

GRAPH_SQL = """edges as (select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey),
nodes as (select p_partkey as id from part)"""


def _item_pieces(spark: SparkSession, sf_dir: str) -> int:
    return pieces(spark, _read(spark, sf_dir, "lineitem").count())


def _part_docs(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Parts as documents: the url is the key, the links lead to the next parts of their orders. ``parts``: to how many partitions items are dealt, if there are many."""
    by = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    keys = ["l_orderkey", "l_linenumber"]
    pairs = by(items, *keys).join(by(after, *keys), keys).select("l_partkey", "next")
    out = by(pairs, "l_partkey").groupBy("l_partkey").agg(F.collect_set(F.col("next").cast("string")).alias("links"))
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"))
    return parts.join(out, F.col("doc_id") == F.col("l_partkey"), "left").select("doc_id", F.col("doc_id").cast("string").alias("url"), F.coalesce("links", F.array().cast("array<string>")).alias("links"))


@query(f"with {GRAPH_SQL} select src, dst from edges")
def link_graph(spark, sf_dir):
    return graph.link_graph(_part_docs(spark, sf_dir))


@query(f"with {GRAPH_SQL} select id as doc_id, count(dst)::bigint as n_inbound from nodes left join edges on id = dst group by 1")
def inbound_counts(spark, sf_dir):
    docs = _part_docs(spark, sf_dir)
    return graph.inbound(docs, graph.link_graph(docs))


@query(f"""with recursive {GRAPH_SQL},
deg as (select src, count(*) as out from edges group by 1),
n as (select count(*)::double as n from nodes),
pr(it, id, r, delta) as (
 select 0, id, 1 / n, 1::double from nodes, n
 union all
 select it, id, nr, delta from (select p.it + 1 as it, p.id, b.base + coalesce(c.given, 0) as nr, sum(abs(b.base + coalesce(c.given, 0) - p.r)) over () as delta, p.delta as was from pr p
 left join (select e.dst, sum(0.85::double * q.r / d.out) as given from pr q join edges e on e.src = q.id join deg d on d.src = q.id group by 1) c on c.dst = p.id
 cross join (select 0.15::double / max(n.n) + 0.85::double * coalesce(sum(case when d.src is null then q.r end), 0) / max(n.n) as base from pr q left join deg d on d.src = q.id cross join n) b
 where p.it < 100 and p.delta >= 1e-6::double))
select id as doc_id, round(r, 9) as score from pr where it = (select max(it) from pr)""")
def pagerank(spark, sf_dir):
    parts = _item_pieces(spark, sf_dir)
    docs = cut(_part_docs(spark, sf_dir, parts))
    return graph.pagerank(docs, graph.link_graph(docs, parts)).select("doc_id", F.round("score", 9).alias("score"))


# evaluation: documents of good quality count as relevant to every query

def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return spark.createDataFrame([(k,) for k in WORDS], "query_id string").crossJoin(good)  # four queries


JUDGED = "judged as (select query_id, doc_id from q cross join (select distinct doc_id from labels where quality = 1))"


@query(f"""with {BASE}, {JUDGED}, {_scored('t', _bm25())}, f as (select query_id, min(rank) as hit from {_top('t', None)} join judged using (query_id, doc_id) group by 1)
select count(*)::bigint as n_queries, round(avg(case when hit = 1 then 1.0 else 0.0 end), 9)::double as p_at_1, round(avg(case when hit <= 10 then 1.0::double / hit else 0 end), 9)::double as mrr from (select distinct query_id from judged) left join f using (query_id)""")
def eval_p1_mrr(spark, sf_dir):
    terms = ranking.query_terms(spark, WORDS)
    scores = ranking.blend(ranking.relevance(_index(spark, sf_dir, terms), terms), None)
    found = evaluate.evaluate(scores, _judged(spark, sf_dir), digits=DIGITS)
    return found.select("n_queries", F.round("p_at_1", 9).alias("p_at_1"), F.round("mrr", 9).alias("mrr"))


SWEEP_SQL = f"""with {BASE}, {JUDGED}, {_scored('t', TFIDF)}, {_scored('m', _bm25())},
both_ as (select 'tfidf' as method, * from t union all select 'bm25', * from m),
nrm as (select method, query_id, doc_id, case when max(s) over w = 0 then 0 else s / max(s) over w end as r, case when max(a) over w = 0 then 0 else a / max(a) over w end as a from both_ join authority using (doc_id) window w as (partition by method, query_id)),
rk as (select method, weight, query_id, doc_id, row_number() over (partition by method, weight, query_id order by round((1 - weight) * r + weight * a, {DIGITS}) desc, doc_id) as rank from nrm cross join (select unnest({list(evaluate.SWEEP)}::double[]) as weight)),
f as (select method, weight, query_id, min(rank) as hit from rk join judged using (query_id, doc_id) group by 1, 2, 3),
every_ as (select * from (select distinct method, weight from rk) cross join (select distinct query_id from judged))
select method, weight, count(*)::bigint as n_queries, round(avg(case when hit = 1 then 1.0 else 0.0 end), 9)::double as p_at_1, round(avg(case when hit <= 10 then 1.0::double / hit else 0 end), 9)::double as mrr from every_ left join f using (method, weight, query_id) group by 1, 2"""


@query(SWEEP_SQL)
def weight_sweep(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = evaluate.sweep(index.build(docs), ranking.query_terms(spark, WORDS), _authority(docs), _judged(spark, sf_dir), digits=DIGITS)
    return rows.select("method", "weight", "n_queries", F.round("p_at_1", 9).alias("p_at_1"), F.round("mrr", 9).alias("mrr"))


@query(f"select * from ({SWEEP_SQL}) order by p_at_1 desc, mrr desc, weight, method limit 1")
def best_config(spark, sf_dir):
    return weight_sweep(spark, sf_dir).orderBy(F.desc("p_at_1"), F.desc("mrr"), "weight", "method").limit(1)


@query(f"""with recursive web as (select page_id as id, 'https://site.example/p/' || page_id as url, {DIGEST_SQL.format(TEXT_SQL)} as digest, [2 * page_id + 1, 2 * page_id + 2, 3 * page_id] as links from pages),
walks(depth, id, path) as (select 0, 0::bigint, [0::bigint] union all
 select w.depth + 1, t.id, min(list_append(w.path, place)) from (select walks.depth, walks.id as src, walks.path, unnest(web.links) as dst, unnest(range(1, 4)) as place from walks join web on web.id = walks.id) w join web t on t.id = w.dst where w.dst <> w.src group by 1, 2),
first_ as (select id, min({{'d': depth, 'p': path}}) as at from walks group by 1),
kept as (select min(f.at) as at, w.digest from first_ f join web w on w.id = f.id group by 2)
select url, regexp_replace({SLUG_STEM.format(u='url')}, '\\.html$', '') || '-' || substr(sha1(url), 1, 6) || '.html' as filename, w.digest, row_number() over (order by k.at)::bigint - 1 as seq
 from kept k join first_ f on f.at = k.at join web w on w.id = f.id order by k.at limit 100""")
def crawl_bfs(spark, sf_dir):
    """Pages as a made-up web on one host: page i links to pages 2i + 1, 2i + 2 and 3i; the content is the page's own."""
    pages = _pages(spark, sf_dir)
    at = lambda i: F.concat(F.lit("https://site.example/p/"), i.cast("string"))
    i = F.col("page_id")
    stored = pages.select(at(i).alias("url"), "html", F.array(at(2 * i + 1), at(2 * i + 2), at(3 * i)).alias("links"))
    web = crawl.at_hand(stored, lambda found: found.select("url", html.visible_text(F.col("html")).alias("text"), "links"))
    return crawl.crawl(spark, web, ["https://site.example/p/0"], max_pages=100)


@query()
def search_response(spark, sf_dir):
    """The JSON answer to one query."""
    docs = _docs(spark, sf_dir)
    return Engine(index.build(docs), _authority(docs)).search_json("ente tionen")


@query(f"with {BASE} select term, count(*)::bigint as n, sum(tf)::bigint as total from postings group by 1")
def postings_export(spark, sf_dir):
    """The nested index, measured: entries and sum of each term's map."""
    nested = corpus.export_postings(index.build(_docs(spark, sf_dir)))
    return nested.select("term", F.size("postings").cast("long").alias("n"), F.aggregate(F.map_values("postings"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
