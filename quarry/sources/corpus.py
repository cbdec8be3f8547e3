"""Sources and sinks: HTML folders, manifests, the index, judgments, responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.html import parse
from quarry.functions.urls import followable, host
from quarry.operators.crawl import usable
from quarry.operators.index import Index, build, corpus_stats, document_frequency, with_ids

MANIFEST, MANIFEST_ROWS = "manifest.json", "manifest"
LEAST_DELAY = 1.0


def html_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, html) of the folder's *.html files, not of folders in it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.decode("content", "UTF-8").alias("html"))


def manifest(spark: SparkSession, folder: str, name: str = MANIFEST) -> DataFrame:
    """(filename, url) of a manifest in one JSON object, or of one that ``append_manifest`` wrote; none where there is no manifest. The last of several URLs of a file counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder)
    one = files.select(F.explode(F.from_json(F.decode("content", "UTF-8"), "map<string,string>")).alias("filename", "url"), F.lit(0).cast("long").alias("seq"))
    lines = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(folder)
    lines = lines.where(F.col("path").contains(f"/{MANIFEST_ROWS}/")).select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    rows = lines.select(F.from_json("line", "filename string, url string, seq long").alias("r")).select("r.filename", "r.url", F.coalesce("r.seq", F.lit(0)).alias("seq"))
    return one.unionByName(rows).groupBy("filename").agg(F.max_by("url", "seq").alias("url"))


def append_manifest(pages: DataFrame, folder: str, fresh: bool = False) -> None:
    """Add (filename, url, seq) to the folder's manifest, a JSON row for each page in files of their own, sorted by file name; ``fresh`` drops what is there. What is
    written so far stays readable if a later part is lost."""
    pages.select("filename", "url", "seq").orderBy("filename").write.mode("overwrite" if fresh else "append").json(f"{folder}/{MANIFEST_ROWS}")


def parse_pages(pages: DataFrame) -> DataFrame:
    """(filename, html, url) to documents numbered by file name; a missing or empty url is the file name."""
    url = F.coalesce(F.when(F.col("url") != "", F.col("url")), F.col("filename"))
    parsed = pages.select("filename", parse(F.col("html"), url).alias("p"))
    parsed = parsed.select("filename", "p.url", "p.title", "p.text", F.size("p.tokens").cast("long").alias("length"), "p.links")
    return with_ids(parsed, "filename").select("doc_id", "url", "title", "text", "length", "links")


def read_corpus(spark: SparkSession, folder: str) -> Index:
    return build(parse_pages(html_folder(spark, folder).join(manifest(spark, folder), "filename", "left")))


def save_index(index: Index, path: str) -> None:
    """As Parquet, overwritten; postings sorted by term, so that a query's terms skip most row groups."""
    index.documents.write.mode("overwrite").parquet(f"{path}/documents")
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str) -> Index:
    docs = spark.read.schema("doc_id long, url string, title string, text string, length long, links array<string>").parquet(f"{path}/documents")
    posted = spark.read.schema("term string, doc_id long, tf long").parquet(f"{path}/postings")
    sizes = docs.select("doc_id", "length")
    return Index(docs, posted, document_frequency(posted), sizes, corpus_stats(sizes))


def import_json(spark: SparkSession, path: str) -> Index:
    """An index in one JSON file, {documents: {id: document}, index: {term: {id: tf}}}."""
    schema = "documents map<string,struct<url:string,title:string,text:string,length:bigint,links:array<string>>>, index map<string,map<string,bigint>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    docs = whole.select(F.explode("j.documents").alias("id", "d")).select(F.col("id").cast("long").alias("doc_id"), "d.*")
    posted = whole.select(F.explode("j.index").alias("term", "of")).select("term", F.explode("of").alias("id", "tf")).select("term", F.col("id").cast("long").alias("doc_id"), "tf")
    sizes = docs.select("doc_id", "length")
    return Index(docs, posted, document_frequency(posted), sizes, corpus_stats(sizes))


def export_postings(index: Index) -> DataFrame:
    """(term, postings): the nested form of the index, a map from doc_id to tf for each term. Postings are shuffled once and sorted; where the term changes a map ends, so that
    no list is built of rows."""
    rows = (index.postings if index.whole is None else index.whole).select("term", "doc_id", "tf")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.repartition("term").sortWithinPartitions("term", "doc_id").mapInArrow(_maps, f"term string, postings map<{kind},bigint>")


def _maps(batches):
    """Batches of (term, doc_id, tf), sorted, to (term, map); of a term that goes on in the next batch its rows are held."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def maps(rows, ends):
        terms, ids, counts = (rows.column(c).combine_chunks() for c in ("term", "doc_id", "tf"))
        starts = np.concatenate([[0], ends[:-1]])
        return pa.RecordBatch.from_arrays([terms.take(pa.array(starts)), pa.MapArray.from_arrays(pa.array([0, *ends], pa.int32()), ids[: ends[-1]], counts[: ends[-1]])], ["term", "postings"])

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch.column("term")
        if held and held[0].column("term")[0] == terms[0] == terms[-1]:
            held.append(batch)
            continue
        rows = pa.Table.from_batches([*held, batch])
        ends = pc.run_end_encode(rows.column("term").combine_chunks()).run_ends.to_numpy()
        if len(ends) > 1:
            yield maps(rows, ends[:-1])
        held = rows.slice(ends[-2] if len(ends) > 1 else 0).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield maps(rows, np.array([rows.num_rows]))


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query, url) of a JSON file {queries: {query: [url]}}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "queries map<string,array<string>>").alias("j"))
    return whole.select(F.explode("j.queries").alias("query", "urls")).select("query", F.explode("urls").alias("url"))


def append_pages(pages: DataFrame, path: str, fresh: bool = False) -> None:
    """Add pages to the stored ones; ``fresh`` drops what is there."""
    pages.write.mode("overwrite" if fresh else "append").parquet(path)


def stored_pages(spark: SparkSession, path: str, schema: str = "url string, filename string, digest string, seq long") -> DataFrame:
    """What earlier crawls stored, without rows that a later one stored again: for ``crawl(stored=...)``. None where nothing is stored."""
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.dropDuplicates(["digest"])


def stored_files(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Stored pages whose file (filename) still exists, see ``html_folder``."""
    return pages.join(files.select("filename"), "filename", "left_semi")


def robots_rules(text: str, agent: str = "quarry") -> tuple[list[tuple[str, bool]], float | None]:
    """((prefix, allow) of the group of a robots.txt that is for the agent, or else of the group for all; the declared delay). A group's agents stand on lines that follow
    each other; the longest name that the agent begins with wins; an empty disallow rule forbids nothing."""
    groups: list[tuple[list[str], list[tuple[str, bool]], list[float]]] = []
    opened = False
    for line in text.splitlines():
        field, found, value = (x.strip() for x in line.split("#", 1)[0].partition(":"))
        field = field.lower()
        if not found:
            continue
        if field == "user-agent":
            if not opened:
                groups.append(([], [], []))
            groups[-1][0].append(value.lower())
            opened = True
        elif groups:
            opened = False
            if field in ("allow", "disallow") and value:
                groups[-1][1].append((value, field == "allow"))
            elif field == "crawl-delay":
                try:
                    groups[-1][2].append(float(value))
                except ValueError:  # not a number: nothing is declared
                    pass
    name = max((a for names, *_ in groups for a in names if a != "*" and agent.lower().startswith(a)), key=len, default="*")
    mine = [g for g in groups if name in g[0]]
    return [r for _, rules, _ in mine for r in rules], max((d for *_, delays in mine for d in delays), default=None)


def rules_table(texts: DataFrame, agent: str = "quarry") -> DataFrame:
    """(host, robots) to (host, prefix, allow, delay), for ``crawl.allowed``."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for host, text in zip(batch["host"], batch["robots"]):
                rules, delay = robots_rules(text or "", agent)
                rows += [(host, prefix, allow, delay) for prefix, allow in rules]
            yield pd.DataFrame(rows, columns=["host", "prefix", "allow", "delay"])

    return texts.select("host", "robots").mapInPandas(run, "host string, prefix string, allow boolean, delay double")


def pause(declared: float | None) -> float:
    """Seconds between two requests to a host."""
    return max(declared or 0.0, LEAST_DELAY)


def fetch(urls: DataFrame, agent: str = "quarry", timeout: int = 10, wait: Callable[[float | None], float] = pause) -> DataFrame:
    """(url) to (url, status, content_type, html) over HTTP; failures and what robots.txt forbids have status 0. A host's URLs go to one task, which reads its robots.txt once
    (a failure to read it allows all) and waits between two requests to it, as long as the host declares. A task has one opener."""

    def run(batches):
        import re
        import time
        import urllib.parse
        import urllib.request

        import pandas as pd

        opener = urllib.request.build_opener()
        opener.addheaders = [("User-Agent", agent)]
        robots: dict[str, tuple[list[tuple[str, bool]], float | None]] = {}
        last: dict[str, float] = {}

        def read(url: str, root: str) -> tuple[int, str, str]:
            if root in last:
                time.sleep(max(0.0, last[root] + wait(robots.get(root, ([], None))[1]) - time.monotonic()))
            try:
                with opener.open(url, timeout=timeout) as r:
                    return r.status, r.headers.get("Content-Type", ""), r.read(2_000_001).decode(r.headers.get_content_charset() or "utf-8", "replace")
            except (OSError, ValueError, LookupError):
                return 0, "", ""
            finally:
                last[root] = time.monotonic()

        def may(path: str, rules: list[tuple[str, bool]]) -> bool:
            parts = lambda p: ".*".join(map(re.escape, p.removesuffix("$").split("*"))) + ("$" if p.endswith("$") else "")
            return max(((len(p), allow) for p, allow in rules if re.match(parts(p), path)), default=(0, True))[1]

        def get(url: str) -> tuple:
            at = urllib.parse.urlsplit(url)
            root = f"{at.scheme}://{at.netloc}"
            if root not in robots:
                status, _, text = read(f"{root}/robots.txt", root)
                robots[root] = robots_rules(text if status == 200 else "", agent)
            path = (at.path or "/") + (f"?{at.query}" if at.query else "")
            return (url, *(read(url, root) if may(path, robots[root][0]) else (0, "", "")))

        for batch in batches:
            yield pd.DataFrame([get(u) for u in batch["url"]], columns=["url", "status", "content_type", "html"])

    return urls.select("url").repartition(host(F.col("url"))).mapInPandas(run, "url string, status int, content_type string, html string")


def fetched(agent: str = "quarry", timeout: int = 10, wait: Callable[[float | None], float] = pause) -> Callable[[DataFrame], DataFrame]:
    """For ``crawl.crawl``: (url) to (url, text, links, html) of the responses that count as pages."""

    def get(urls: DataFrame) -> DataFrame:
        pages = usable(fetch(urls, agent, timeout, wait)).select("url", "html", parse(F.col("html"), F.col("url")).alias("p"))
        return pages.select("url", "p.text", F.transform("p.links", followable).alias("links"), "html")

    return get
