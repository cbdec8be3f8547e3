"""The engine over a corpus of its own, against formulas written out here."""

import http.server
import io
import json
import math
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import crawl, evaluate, graph, index, ranking
from quarry.operators.suggest import suggest
from quarry.plans.engine import Engine
from quarry.plans.service import application
from quarry.sources import corpus

#: name: (title, paragraph, names that it links to)
GARDEN = {
    "compost.html": ("Compost", "Worms turn kitchen scraps into soil. Warm heaps make soil fast; worms like warm heaps.", ["soil.html", "tools.html", "soil.html"]),
    "kale.html": ("Kale", "Kale stands frost. Pick outer leaves first.", ["soil.html", "nowhere.html"]),
    "rain.html": ("Rain barrels", "Rain fills barrels, barrels water kale when soil is dry.", ["kale.html", "rain.html"]),
    "soil.html": ("Soil", "Test soil each spring: sand drains, clay holds water.", []),
    "tools.html": ("Tools", "A fork lifts compost and soil.", ["compost.html"]),
}


def page(title, body, targets):
    anchors = "".join(f'<li><a href="{t}">{t.removesuffix(".html")}</a></li>' for t in targets)
    return f"<html><head><title>{title}</title><style>p {{ color: green }}</style></head><body><p>{body}</p><ul>{anchors}</ul><script>var soil = 7;</script></body></html>"


def words(name):
    title, body, targets = GARDEN[name]
    text = " ".join([title, body, *(t.removesuffix(".html") for t in targets)]).lower()
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).split()


NAMES = sorted(GARDEN)
TF = [Counter(words(n)) for n in NAMES]
SIZE = [sum(c.values()) for c in TF]
DF = Counter(t for c in TF for t in c)
EDGES = {(i, NAMES.index(t)) for i, n in enumerate(NAMES) for t in GARDEN[n][2] if t in GARDEN and t != n}


def bm25(query, k1=1.5, b=0.75):
    n, mean, out = len(TF), sum(SIZE) / len(SIZE), {}
    for t in query:
        for i, c in enumerate(TF):
            if c[t]:
                weight = math.log(1 + (n - DF[t] + 0.5) / (DF[t] + 0.5))
                out[i] = out.get(i, 0) + weight * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * SIZE[i] / mean))
    return out


def tfidf(query):
    out = {}
    for t in query:
        for i, c in enumerate(TF):
            if c[t]:
                out[i] = out.get(i, 0) + c[t] / SIZE[i] * math.log(len(TF) / DF[t])
    return out


def authority_of(n, edges, damping=0.85, tolerance=1e-6):
    score, out = [1 / n] * n, Counter(a for a, _ in edges)
    for _ in range(100):
        lost = sum(score[i] for i in range(n) if not out[i])
        new = [(1 - damping) / n + damping * lost / n + damping * sum(score[a] / out[a] for a, b in edges if b == i) for i in range(n)]
        moved, score = sum(abs(x - y) for x, y in zip(new, score)), new
        if moved < tolerance:
            break
    return score


def blended(relevance, authority, weight=0.2):
    part = lambda of: {i: of[i] / max(of[j] for j in relevance) if max(of[j] for j in relevance) else 0.0 for i in relevance}
    r, a = part(relevance), part(authority)
    return {i: (1 - weight) * r[i] + weight * a[i] for i in relevance}


def order(scores):
    return sorted(scores, key=lambda i: (-scores[i], i))


@pytest.fixture(scope="module")
def garden(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("garden")
    for name, of in GARDEN.items():
        (folder / name).write_text(page(*of))
    i = corpus.read_corpus(spark, str(folder))
    i.documents = i.documents.cache()
    return i


@pytest.fixture(scope="module")
def authority(garden):
    return graph.pagerank(garden.documents, graph.link_graph(garden.documents)).cache()


def scores(spark, i, q, method="bm25", authority=None):
    rows = ranking.search(i, ranking.query_terms(spark, {"q": q}), authority, None, method).collect()
    return {r.doc_id: r.score for r in sorted(rows, key=lambda r: r.rank)}


def test_build(garden):
    rows = {r.doc_id: r for r in garden.documents.collect()}
    assert [(rows[i].url, rows[i].length) for i in range(len(NAMES))] == list(zip(NAMES, SIZE))
    assert rows[1].text == "Kale Kale stands frost. Pick outer leaves first. soil nowhere" and rows[0].links == ["soil.html", "tools.html"]
    assert {(r.term, r.doc_id): r.tf for r in garden.postings.collect()} == {(t, i): n for i, c in enumerate(TF) for t, n in c.items()}
    assert {r.term: r.df for r in garden.terms.collect()} == DF
    assert garden.stats.first() == (len(NAMES), pytest.approx(sum(SIZE) / len(SIZE)))


@pytest.mark.parametrize("query", ["soil", "warm soil", "kale water", "worms", "soil Soil kale"])
def test_scores(spark, garden, authority, query):
    tokens = query.lower().split()
    for method, formula in (("bm25", bm25), ("tfidf", tfidf)):
        want, got = formula(tokens), scores(spark, garden, query, method)
        assert got == pytest.approx(want) and list(got) == order({i: round(s, 12) for i, s in want.items()})
    want = blended(bm25(tokens), authority_of(len(NAMES), EDGES))
    got = scores(spark, garden, query, authority=authority)
    assert got == pytest.approx(want, abs=1e-6) and list(got) == order(want)


def test_no_hits_and_wrong_method(spark, garden):
    assert scores(spark, garden, "zucchini") == {}
    with pytest.raises(ValueError):
        ranking.relevance(garden, ranking.query_terms(spark, {"q": "a"}), "other")


def test_no_window_over_candidates(spark, garden, authority):
    terms = ranking.query_terms(spark, {"q": "soil"})
    plan = ranking.blend(ranking.relevance(garden, terms), authority)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_pagerank(authority):
    assert [r.score for r in authority.orderBy("doc_id").collect()] == pytest.approx(authority_of(len(NAMES), EDGES), abs=1e-7)


@pytest.mark.parametrize("edges,n,damping", [([(2, 0)], 3, 0.85), ([(0, 4), (1, 4), (3, 4), (4, 2)], 5, 0.85), ([], 4, 0.85), ([(1, 0), (0, 2)], 3, 1.0), ([(0, 1), (1, 3)], 4, 0.0), ([(0, 1), (1, 0)], 2, 0.5)])
def test_pagerank_small(spark, edges, n, damping):
    got = graph.pagerank(spark.createDataFrame([(i,) for i in range(n)], "doc_id long"), spark.createDataFrame(edges, "src long, dst long"), damping).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx(authority_of(n, edges, damping), abs=1e-7) and sum(r.score for r in got) == pytest.approx(1)


def test_pagerank_deals_edges_by_number(spark, monkeypatch):
    """Edges are made once, and dealt to more partitions than the session's where a task would get too many."""
    from quarry.plans import session

    monkeypatch.setattr(session, "TASK_ROWS", 1)
    assert session.pieces(spark, 9) == 9 and session.pieces(spark, 0) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    edges = [(0, 4), (1, 4), (3, 4), (4, 2), (2, 0), (2, 1)]
    rows = spark.createDataFrame(edges, "src long, dst long").mapInPandas(count, "src long, dst long")
    got = graph.pagerank(spark.range(5).withColumnRenamed("id", "doc_id"), rows).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx(authority_of(5, edges), abs=1e-7) and made.value == len(edges)


def test_pagerank_of_nothing(spark):
    assert graph.pagerank(spark.createDataFrame([], "doc_id long"), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_scorers_may_disagree(spark):
    """A long page that is about the word, a short one that names it once: by share of words the short one wins, with saturation the long one."""
    sizes = {0: 900, 1: 40} | {i: 260 for i in range(2, 30)}
    posted = spark.createDataFrame([("orchid", 0, 20), ("orchid", 1, 1)], "term string, doc_id long, tf long")
    lengths = spark.createDataFrame(list(sizes.items()), "doc_id long, length long")
    i = index.Index(lengths, posted, index.document_frequency(posted), lengths, index.corpus_stats(lengths))
    mean = sum(sizes.values()) / 30
    weight = math.log(1 + (30 - 2 + 0.5) / 2.5)
    want = {d: weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * sizes[d] / mean)) for d, tf in ((0, 20), (1, 1))}
    assert scores(spark, i, "orchid") == pytest.approx(want) and want[0] > want[1]
    got = scores(spark, i, "orchid", "tfidf")
    assert got == pytest.approx({0: 20 / 900 * math.log(15), 1: 1 / 40 * math.log(15)}) and list(got) == [1, 0]


def test_suggest(garden):
    most = max(2, len(NAMES) // 2)
    best = {}
    for t in DF:
        if len(t) >= 4 and not t.isdigit() and 2 <= DF[t] <= most:
            s = bm25([t])
            best[t] = (order(s)[0], max(s.values()))
    want, used = [], set()
    for t in sorted(best, key=lambda t: (-best[t][1], t)):
        if best[t][0] not in used:
            used.add(best[t][0])
            want.append((t, best[t][0], pytest.approx(best[t][1])))
    got = [tuple(r) for r in suggest(garden, 0).collect()]
    assert want and got == want and [tuple(r) for r in suggest(garden, 1).collect()] == want[:1]


def test_suggest_counts_tokens_once(spark):
    """Postings are made once and shuffled by term only; rows that share an id are counted together."""
    docs = spark.createDataFrame([(1, "moss fern moss"), (2, "fern"), (3, None), (4, "Moss")], "doc_id long, text string")
    plan = suggest(index.build(docs), 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Join Inner, (term" not in plan
    assert sorted(map(tuple, index.postings(docs).collect())) == [("fern", 1, 1), ("fern", 2, 1), ("moss", 1, 2), ("moss", 4, 1)]
    twice = docs.unionByName(spark.createDataFrame([(2, "fern moss"), (None, "fern"), (None, "fern")], docs.schema))
    assert sorted(map(tuple, index.postings(twice).collect()), key=str) == [("fern", 1, 1), ("fern", 2, 2), ("fern", None, 2), ("moss", 1, 2), ("moss", 2, 1), ("moss", 4, 1)]


def test_only_the_terms_of_queries_are_counted(spark, garden):
    """The semi-join with the queries' terms stands below the aggregation of postings."""
    docs = spark.createDataFrame([(1, "moss fern"), (2, "fern")], "doc_id long, text string")
    plan = ranking.retrieve(index.build(docs).postings, ranking.query_terms(spark, {"q": "fern"}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [term#") < plan.index("LeftSemi") < plan.index("Generate explode")


def test_export(spark, garden, tmp_path):
    """A map for each term, whatever the batches; the postings are shuffled once."""
    want = {t: {i: c[t] for i, c in enumerate(TF) if c[t]} for t in DF}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in ("1", "2", "3", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = [(r.term, r.postings) for r in corpus.export_postings(garden).collect()]
        assert len(got) == len(DF) and dict(got) == want and all(list(p) == sorted(p) for _, p in got)
    docs = spark.createDataFrame([(1, "moss fern"), (2, "fern")], "doc_id long, text string")
    assert corpus.export_postings(index.build(docs))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_repeated_term_reads_what_is_narrowed(spark, tmp_path):
    """Scores are made of the postings and lengths that were written once, not of the texts again."""
    from quarry.plans.queries import QUERIES

    spark.createDataFrame([(1, "the estion the"), (2, "fern")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["bm25_repeated_term"](spark, str(tmp_path))
    assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString().lower() and [r.doc_id for r in found.collect()] == [1]


def test_save_and_load(spark, garden, tmp_path):
    corpus.save_index(garden, str(tmp_path))
    assert scores(spark, corpus.load_index(spark, str(tmp_path)), "soil kale") == pytest.approx(bm25(["soil", "kale"]))
    whole = {"documents": {r.doc_id: {k: v for k, v in r.asDict().items() if k != "doc_id"} for r in garden.documents.collect()}, "index": {}}
    for r in garden.postings.collect():
        whole["index"].setdefault(r.term, {})[r.doc_id] = r.tf
    (tmp_path / "index.json").write_text(json.dumps(whole))
    assert scores(spark, corpus.import_json(spark, str(tmp_path / "index.json")), "soil kale") == pytest.approx(bm25(["soil", "kale"]))


def test_engine(spark, garden, authority):
    e = Engine(garden, authority)
    answer = json.loads(e.search_json("Dry KALE", 2).first().response)
    want = blended(bm25(["dry", "kale"]), authority_of(len(NAMES), EDGES))
    assert [answer[k] for k in ("query", "tokens", "method", "count")] == ["Dry KALE", ["dry", "kale"], "bm25", 2]
    assert [r["id"] for r in answer["results"]] == order(want)[:2]
    assert all(s["match"] == (s["text"].lower() in ("dry", "kale")) for r in answer["results"] for s in r["snippet"] if s["text"].strip())
    assert json.loads(e.search_json("—").first().response) == {"query": "—", "tokens": [], "count": 0, "results": []}
    ranks = authority_of(len(NAMES), EDGES)
    assert e.stats().first() == (len(NAMES), len(DF))
    assert [(r.id, r.authority) for r in e.pages().collect()] == [(i, round(ranks[i], 4)) for i in order(dict(enumerate(ranks)))]
    stats = json.loads(e.stats_json(3, 2).first().response)
    assert (stats["documents"], stats["terms"]) == (len(NAMES), len(DF)) and stats["suggestions"] == [r.term for r in suggest(garden, 3).collect()]
    assert [p["url"] for p in stats["pages"]] == [NAMES[i] for i in order(dict(enumerate(ranks)))[:2]]
    for bad in (0, 51):
        with pytest.raises(ValueError):
            e.search("kale", bad)


def test_service(garden, authority):
    app, told = application(Engine(garden, authority)), []

    def ask(path, query=""):
        body = app({"PATH_INFO": path, "QUERY_STRING": query, "wsgi.input": io.BytesIO()}, lambda status, headers: told.append(status))
        return told[-1][:3], json.loads(b"".join(body))

    status, answer = ask("/api/search", "q=kale&limit=1&method=tfidf")
    assert status == "200" and answer["method"] == "tfidf" and answer["count"] == 1
    assert ask("/api/stats")[1]["documents"] == len(NAMES)
    assert [ask("/api/search", q)[0] for q in ("", "q=kale&limit=0", "q=kale&limit=x", "q=kale&method=y")] == ["422"] * 4 and ask("/other")[0] == "404"


def test_evaluation(spark, garden, authority):
    judged = spark.createDataFrame([("soil", "tools.html"), ("kale", "rain.html"), ("kale", "soil.html"), ("frost", "gone.html")], "query string, url string")
    found, skipped = evaluate.matched(judged, garden.documents)
    assert [r.query_id for r in skipped.collect()] == ["frost"]
    terms = ranking.terms_of(found.select("query_id", F.col("query_id").alias("query")).distinct())
    ranks, good = authority_of(len(NAMES), EDGES), {"soil": {4}, "kale": {2, 3}}

    def told(method, weight):
        at = [min((k + 1 for k, i in enumerate(order(blended(method([q]), ranks, weight))) if i in ids), default=math.inf) for q, ids in good.items()]
        return sum(k == 1 for k in at) / len(at), sum(1 / k for k in at if k <= 10) / len(at)

    m = evaluate.evaluate(ranking.blend(ranking.relevance(garden, terms), authority), found).first()
    assert (m.n_queries, m.p_at_1, m.mrr) == (2, *map(pytest.approx, told(bm25, 0.2)))
    rows = evaluate.sweep(garden, terms, authority, found, (0.0, 0.3, 1.0)).collect()
    want = {(k, w): told(f, w) for k, f in (("bm25", bm25), ("tfidf", tfidf)) for w in (0.0, 0.3, 1.0)}
    assert {(r.method, r.weight): (r.p_at_1, r.mrr) for r in rows} == {k: pytest.approx(v) for k, v in want.items()}
    assert [(r.method, r.weight) for r in rows] == sorted(want, key=lambda k: (-round(want[k][0], 9), -round(want[k][1], 9), k[1], k[0]))


def test_usable(spark):
    heads = [(0, 200, "text/html", "x"), (1, 404, "text/html", "x"), (2, 200, "image/png", "x"), (3, 200, "Application/XHTML+xml", "x" * 2_000_000), (4, 200, "text/html", "x" * 2_000_001), (5, None, None, None)]
    assert [r.i for r in crawl.usable(spark.createDataFrame(heads, "i int, status int, content_type string, html string")).collect()] == [0, 3]


def test_crawl(spark):
    root = "http://garden.example/"
    web = [
        (root, "gate", [root + "beds", root + "shed", "http://market.example/", "mailto:gardener@garden.example"]), (root + "beds", "rows", [root + "pond"]), (root + "shed", "\nrows ", [root + "well", root]),
        (root + "pond", "water", []), (root + "well", "deep water", [root + "lost"]), ("http://market.example/", "stalls", []),
    ]
    pages = spark.createDataFrame(web, "url string, text string, links array<string>")
    run = lambda **k: [r.url.removeprefix(root) for r in crawl.crawl(spark, pages, ["HTTP://Garden.example"], **k).orderBy("seq").collect()]
    assert run() == ["", "beds", "pond", "well"]
    assert run(max_pages=2) == ["", "beds"] and run(max_pages=0) == []
    assert run(same_host_only=False) == ["", "beds", "http://market.example/", "pond", "well"]
    rules = spark.createDataFrame([("garden.example", "/b*s$", False), ("garden.example", "/w", True)], "host string, prefix string, allow boolean")
    assert run(rules=rules) == ["", "shed", "well"]
    stored = spark.createDataFrame([("water",)], "text string").select(crawl.content_digest(F.col("text")).alias("digest"))
    assert run(stored=stored) == ["", "beds", "well"]


def test_crawl_parses_what_it_fetches(spark, tmp_path, monkeypatch):
    """A page that no link leads to is never parsed."""
    from quarry.functions import html
    from quarry.plans.queries import QUERIES

    spark.createDataFrame([(i, f"u{i}", f"words of {i}") for i in range(4)] + [(50, "u50", "unasked")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(html, "visible_text", lambda h: F.when(h == "unasked", F.raise_error(F.lit("parsed"))).otherwise(h))
    assert [r.url[-1] for r in QUERIES["crawl_bfs"](spark, str(tmp_path)).orderBy("seq").collect()] == ["0", "1", "2", "3"]


def test_with_ids_makes_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = index.with_ids(spark.range(1000).selectExpr("1000 - id as key").mapInPandas(count, "key long"), "key")
    assert {r.key: r.doc_id for r in rows.collect()} == {i + 1: i for i in range(1000)} and made.value == 1000


def test_pages_are_read_once(spark):
    """Each page is made and parsed once, though the ranges of the file names are sampled."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    pages = spark.range(50).selectExpr("concat('p', lpad(50 - id, 3, '0'), '.html') as filename", "concat('<p>w', id, '</p>') as html", "'' as url").mapInPandas(count, "filename string, html string, url string")
    rows = corpus.parse_pages(pages).collect()
    assert {r.doc_id: (r.url, r.text, r.length) for r in rows} == {i: (f"p{i + 1:03}.html", f"w{49 - i}", 1) for i in range(50)} and made.value == 50


def test_all_names(spark):
    """All names of character references, each looked for among those of its first letter only."""
    from html import entities

    from quarry.functions import html

    assert len(html.NAMED) == 58 and max(map(len, html.NAMED)) < 3000
    want = {n: c for n, c in entities.html5.items() if n.endswith(";") and "\n" not in c} | {"nosuchname;": "&nosuchname;"}
    assert {r.n: r.c for r in spark.createDataFrame([(n,) for n in want], "n string").select("n", html.decode(F.concat(F.lit("&"), "n")).alias("c")).collect()} == want


def test_rules(spark):
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private # not here\nAllow: /private/open\nCrawl-delay: 3\nDisallow:\n\nUser-agent: Quarry\nUser-agent: friend\nDisallow: /tmp\nCrawl-delay: soon\n"
    assert corpus.robots_rules(text, "somebody") == ([("/private", False), ("/private/open", True)], 3.0)
    assert corpus.robots_rules(text, "quarry/1.0") == ([("/tmp", False)], None) and corpus.robots_rules("") == ([], None)
    assert [corpus.pause(d) for d in (None, 0.2, 3.0)] == [1.0, 1.0, 3.0]
    rules = corpus.rules_table(spark.createDataFrame([("h.example", text), ("g.example", None)], "host string, robots string"), "x")
    urls = spark.createDataFrame([(f"http://{h}.example{p}",) for h in "hg" for p in ("/", "/private/x", "/private/open/y")], "url string")
    assert sorted(r.url for r in crawl.allowed(urls, rules).collect()) == sorted(f"http://{h}.example{p}" for h, p in [("g", "/"), ("g", "/private/x"), ("g", "/private/open/y"), ("h", "/"), ("h", "/private/open/y")])


@pytest.fixture()
def site():
    """A small web of its own on this machine, which counts what is asked for."""
    asked: list[str] = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            pages = {"/": '<title>Front</title><a href="/one">1</a><a href="/two?utm_source=x">2</a><a href="/hidden/x">3</a><a href="/pic">4</a>', "/one": "<p>caf&eacute;</p><a href='/'>on</a>", "/two": "<p>café</p><a href='/three'>on</a>", "/three": "<p>last</p>", "/pic": "no page"}
            body = {"/robots.txt": "User-agent: *\nDisallow: /hidden\nCrawl-delay: 0.01"}.get(self.path, pages.get(self.path))
            self.send_response(200 if body is not None else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8" if self.path in pages and self.path != "/pic" else "text/plain")
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_live_crawl(spark, site, tmp_path):
    root, asked = site
    found = crawl.crawled(spark, corpus.fetched(wait=lambda declared: declared or 0.0), [root])
    rows = {r.url.removeprefix(root): r for r in found.collect()}
    # /two has the text of /one, and its links are followed; what is forbidden or no page isn't there
    assert {k: r.seq for k, r in rows.items()} == {"/": 0, "/one": 1, "/three": 2} and "/hidden/x" not in asked and "/two" in asked
    assert rows["/one"].text == "café on"
    corpus.append_pages(found.select("url", "filename", "digest", "seq", "html"), str(tmp_path / "pages"), fresh=True)
    stored = corpus.stored_pages(spark, str(tmp_path / "pages"))
    assert stored.count() == 3 and corpus.stored_pages(spark, str(tmp_path / "none")).count() == 0
    assert crawl.crawl(spark, corpus.fetched(wait=lambda d: 0.0), [root], stored=stored).count() == 0
    corpus.append_manifest(found, str(tmp_path), fresh=True)
    corpus.append_manifest(found.where("seq = 0").select("filename", F.lit("http://new.example/").alias("url"), F.lit(9).cast("long").alias("seq")), str(tmp_path))
    told = {r.filename: r.url for r in corpus.manifest(spark, str(tmp_path)).collect()}
    assert told == {r.filename: r.url if r.seq else "http://new.example/" for r in rows.values()}
    files = spark.createDataFrame([(rows["/one"].filename, "")], "filename string, html string")
    assert [r.url for r in corpus.stored_files(stored, files).collect()] == [root + "/one"]


def test_stream(spark, tmp_path):
    from quarry.streaming.ingest import ingest

    rows = [(7, "http://garden.example/x?utm_m=1", "<p>mulch</p>"), (8, "http://garden.example/y", "<div> mulch\n</div>"), (9, "http://garden.example/z", "<p>straw</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["mulch", "straw"]
