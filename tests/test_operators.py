import math

import pytest
from pyspark.sql import functions as F

from orevein.operators import crawl, index, pagerank, retrieval, snippets, suggest
from orevein.operators.keyed import heavy_keys, keyed_stats
from orevein.operators.orphans import NO_PERIOD, orphan_keys, orphan_references, orphan_report
from orevein.plans.engine import SearchEngine, TtlCache
from orevein.sources import files
from orevein.streaming.ingest import index_stream

DOCS = "doc_id long, url string, title string, description string, document_size long, page_rank double"


def _tf_fixture(spark):
    docs = spark.createDataFrame([(1, "https://example.com", "AI Guide", "d", 100, 0.2), (2, "https://example2.com", "Tech Blog", "d", 50, 0.1), (3, "https://example3.com", "ML Intro", None, 200, None)], DOCS)
    post = spark.createDataFrame(
        [(1, "machine", 5, "title"), (1, "machine", 10, "title"), (1, "learning", 11, "body"), (2, "machine", 3, "body"), (2, "learning", 4, "header"), (3, "machine", 7, "body")], "doc_id long, word string, position int, section string"
    )
    idf = spark.createDataFrame([("machine", math.log(1000 / 51)), ("learning", math.log(1000 / 21))], "word string, idf double")
    return docs, post, idf


def test_tf_idf(spark):
    docs, post, idf = _tf_fixture(spark)
    got = {r["doc_id"]: r["tf_idf"] for r in retrieval.keyword_rank(["machine", "learning"], post, docs, idf).collect()}
    assert got == pytest.approx({1: 0.1576, 2: 0.1754, 3: 0.0149}, abs=1e-3)
    assert retrieval.keyword_rank([], post, docs, idf).count() == 0


def test_phrases(spark):
    docs, _, idf = _tf_fixture(spark)
    post = spark.createDataFrame([(1, "a", 1, "body"), (1, "b", 2, "body"), (1, "a", 9, "body"), (2, "a", 1, "title"), (2, "b", 2, "body"), (3, "a", 4, "body"), (3, "a", 5, "body"), (3, "b", 6, "body")], "doc_id long, word string, position int, section string")
    found = lambda terms: sorted(r[0] for r in retrieval.phrase_documents(terms, post).collect())
    assert found(["a", "b"]) == [1, 3] and found(["a", "a", "b"]) == [3] and found(["b", "a"]) == [] and found(["a", "the"]) == [] and found([]) == []
    ranked = lambda phrases, ops: sorted(r["doc_id"] for r in retrieval.boolean_rank(phrases, ops, post, docs, idf).collect())
    assert ranked([["a", "b"], ["a", "a"]], [retrieval.AND]) == [3]
    assert ranked([["a", "b"], ["a", "a"]], [retrieval.NOT]) == [1]
    assert ranked([["a", "a"], ["a"]], [retrieval.OR]) == [1, 2, 3]
    assert ranked([["a"], ["a", "b"], ["a", "a"]], [retrieval.AND, retrieval.NOT]) == [1]
    assert ranked([], []) == []


def test_pages_of_results(spark):
    ranked = spark.range(23).select(F.col("id").alias("doc_id"), F.lit(1.0).alias("final_score"))
    assert [r["doc_id"] for r in retrieval.result_page(ranked, 3, 10).orderBy("place").collect()] == [20, 21, 22]
    assert retrieval.result_page(ranked, 4, 10).count() == 0
    assert retrieval.totals(ranked, 10).collect()[0].asDict() == {"total_documents": 23, "total_pages": 3}
    with pytest.raises(ValueError):
        retrieval.result_page(ranked, 0)


def test_snippets(spark):
    post = spark.createDataFrame([(1, f"w{i}", i, "body") for i in range(60)], "doc_id long, word string, position int, section string")
    results = spark.createDataFrame([(1, "about"), (2, "about"), (3, None)], "doc_id long, description string")
    hits = post.where(F.col("word").isin("w3", "w5", "w50"))
    got = {r["doc_id"]: r["snippet"] for r in snippets.snippets(results, hits, post, ["w3", "w50"]).collect()}
    words = [f"<b>w{i}</b>" if i in (3, 50) else f"w{i}" for i in [*range(21), *range(35, 60)]]
    assert got == {1: " ".join(words) + " ...", 2: "about", 3: ""}
    parts = spark.createDataFrame([("a <b>b</b> c",)], "s string").select(snippets.spans("s").alias("p")).first()["p"]
    assert [(p["text"], p["bold"]) for p in parts] == [("a ", False), ("b", True), (" c", False)]


def _ranks(spark, nodes, edges):
    n = spark.createDataFrame([(i,) for i in nodes], "id long")
    e = spark.createDataFrame(edges, "source long, target long")
    return {r["id"]: r["page_rank"] for r in pagerank.pagerank(n, e).collect()}


def test_pagerank(spark):
    assert _ranks(spark, [1, 2, 3], [(1, 2), (2, 3), (3, 1)]) == pytest.approx({1: 1 / 3, 2: 1 / 3, 3: 1 / 3}, abs=1e-9)
    two = _ranks(spark, [1, 2], [(1, 2), (1, 99)])
    assert two[2] > two[1] and sum(two.values()) == pytest.approx(1)
    five = _ranks(spark, range(1, 6), [(1, 2), (1, 3), (1, 4), (2, 3), (3, 1), (3, 4), (5, 1), (5, 3)])
    assert five == pytest.approx({1: 0.23032, 2: 0.14009, 3: 0.29099, 4: 0.26376, 5: 0.07484}, abs=1e-5)
    assert _ranks(spark, [], []) == {}


def test_suggestions(spark):
    history = spark.createDataFrame([("Spark sql", 3, 1000), ("spark", 1, 2000), ("pyspark spark", 9, 500), ("other", 50, 9000), (" ", 99, 1)], "term string, count long, last_used long")
    got = [r["term"] for r in suggest.suggestions(history, "spark").collect()]
    assert got == ["spark", "Spark sql", "pyspark spark"]
    assert [r["term"] for r in suggest.suggestions(history, "").collect()][0] == "other"
    cut = history.select("term", suggest.highlight(F.col("term"), "sql").alias("h")).where("term = 'Spark sql'").first()["h"]
    assert (cut["before"], cut["hit"], cut["after"]) == ("Spark ", "sql", "")
    assert suggest.pager(5, 10) == [1, "...", 4, 5, 6, "...", 10] and suggest.pager(1, 0) == [] and suggest.pager(3, 4) == [1, 2, 3, 4]


def test_index_from_pages(spark):
    pages = spark.createDataFrame([(1, "<title>The Big Test</title><h1>Head</h1><p>Some text, some more</p>"), (2, None)], "doc_id long, html string")
    corpus = index.corpus_from_pages(pages)
    rows = index.build_postings(corpus, ["the", "more"]).orderBy("doc_id", "position").collect()
    assert [(r["word"], r["position"], r["section"]) for r in rows] == [("big", 0, "title"), ("test", 1, "title"), ("head", 2, "header"), ("some", 3, "body"), ("text", 4, "body"), ("some", 5, "body")]
    assert corpus.where("error is not null").select("doc_id").first()[0] == 2


def test_vocabulary_and_updates(spark):
    post = spark.createDataFrame([(1, "running", 0, "title"), (1, "running", 1, "body"), (2, "running", 0, "body"), (2, "flies", 1, "body")], "doc_id long, word string, position int, section string")
    docs = spark.createDataFrame([(1, "u1", "t"), (2, "u2", None), (3, "u3", "x")], "doc_id long, url string, title string")
    rows = {r["word"]: r for r in index.vocabulary(post, docs).collect()}
    assert (rows["running"]["word_count"], rows["running"]["df"], rows["running"]["stem"]) == (3, 2, "run")
    assert rows["flies"]["idf"] == pytest.approx(math.log(3 / 1 + 1), abs=1e-9)
    grouped = index.positions_by_section(index.grouped_postings(post)).where("doc_id = 1").first()
    assert grouped["positions_by_section"] == {"title": [0], "body": [1]}
    new = index.updated(docs, spark.createDataFrame([(2, "now")], "doc_id long, title string"), "doc_id")
    assert {r["doc_id"]: r["title"] for r in new.collect()} == {1: "t", 2: "now", 3: "x"}
    assert index.inserted(docs, spark.createDataFrame([(4, "u4", "y")], docs.schema)).count() == 4
    with pytest.raises(Exception, match="url exists"):
        index.inserted(docs, spark.createDataFrame([(4, "u1", "y")], docs.schema)).collect()


def test_crawl(spark):
    frontier = spark.createDataFrame([("U", "http://example.com", 0), ("V", "http://seen.com", 0)], "status string, url string, depth int")
    new = spark.createDataFrame([("http://EXAMPLE.com/", 0), ("http://b.com", 1), (None, 1), ("not a url", 1), ("http://b.com", 1)], "url string, depth int")
    after = crawl.offer(frontier, new)
    assert sorted((r["status"], r["url"]) for r in after.collect()) == [("U", "http://b.com"), ("U", "http://example.com"), ("V", "http://seen.com")]
    assert crawl.offer(frontier, new, cap=1).count() == 2
    polled = crawl.visit(after, spark.createDataFrame([("http://b.com",)], "url string"))
    assert polled.where("status = 'V'").count() == 2
    log = frontier.withColumn("ord", F.monotonically_increasing_id())
    grown = crawl.offer(log, new)
    taken, rest = crawl.poll(grown, 1)
    assert [r["url"] for r in taken.collect()] == ["http://example.com"] and [r["url"] for r in crawl.poll(rest, 5)[0].collect()] == ["http://b.com"]
    assert crawl.poll(crawl.poll(rest, 5)[1], 5)[0].count() == 0
    assert crawl.seeded(log, new).count() == 2 and crawl.seeded(log.where("1 = 0"), new).count() == 2 and crawl.offer(log, new, cap=None).count() == 3
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (1, 3)], "source long, target long")
    got = {r["id"]: r["depth"] for r in crawl.waves(spark.createDataFrame([(1,)], "id long"), edges, 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    links = spark.createDataFrame([(1, 9, i, f"http://a.b/{'x' * (40 - i)}") for i in range(30)] + [(1, 9, 99, "javascript:x")], "doc_id long, depth int, ord int, href string")
    chosen = crawl.choose_links(links).orderBy("place").collect()
    assert len(chosen) == 25 and chosen[0]["url"] == "http://a.b/" + "x" * 11
    pages = spark.createDataFrame([("u2", 1, "same"), ("u1", 1, "same"), ("u0", 2, "same"), ("u3", 0, "other")], "url string, depth int, text string")
    assert sorted(r["url"] for r in crawl.distinct_content(pages).collect()) == ["u1", "u3"]


def _page(title, *links, text=""):
    return f"<title>{title}</title><h1>{title}</h1><p>{text or title} text</p>" + "".join(f'<a href="{x}">x</a>' for x in links)


def test_crawl_over_stored_pages(spark):
    pages = [
        ("http://a.example/", _page("Home", "one", "/two?utm_source=x", "/private/p", "/gone", "/old", "mailto:m@a.example", "http://b.example/z")),
        ("http://a.example/one", _page("One", "deep/three", "/")),
        ("http://a.example/two", _page("One", "deep/three", "/")),
        ("http://b.example/z", _page("Z", text="zz")),
        ("http://a.example/deep/three", _page("Three", "four")),
        ("http://a.example/deep/four", _page("Four")),
        ("http://a.example/private/p", _page("P")),
        ("http://a.example/old", _page("Old")),
    ]
    store = spark.createDataFrame(pages, "url string, html string")
    docs = spark.createDataFrame([("http://a.example/old", None)], "url string, document_hash string")
    rules = spark.createDataFrame([("http://a.example", "disallow", "^/private/.*")], "base string, kind string, pattern string")
    seeds = spark.createDataFrame([("http://A.example/", 0), (None, 0), ("nonsense", 0)], "url string, depth int")
    got = {r["url"]: (r["depth"], r["status"]) for r in crawl.crawl(seeds, store, docs, rules, max_depth=2).collect()}
    assert got == {
        "http://a.example": (0, "saved"), "http://a.example/one": (1, "saved"), "http://a.example/two": (1, "duplicate"), "http://a.example/private/p": (1, "disallowed"),
        "http://a.example/gone": (1, "missing"), "http://a.example/old": (1, "stored"), "http://b.example/z": (1, "saved"), "http://a.example/deep/three": (2, "saved"),
    }
    few = crawl.crawl(seeds, store, docs, rules, max_depth=9, max_pages=2)
    assert few.where("status = 'saved'").count() == 3 and few.agg(F.max("depth")).first()[0] == 1
    new = crawl.stored_documents(few, "/data/html/")
    assert sorted(r["title"] for r in new.collect()) == ["Home", "One", "Z"] and new.where("file_path like '/data/html/%.html'").count() == 3
    assert crawl.crawl(seeds.where("1 = 0"), store, docs, rules).count() == 0


def test_skewed_joins_and_numbers(spark, monkeypatch):
    from orevein.operators import skew

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)] + [(9000 + i, None) for i in range(50)], "id long, key string")
    facts = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i + 2) for i in range(0, 50, 2)], "key string, fact int")
    plain = sorted(map(tuple, rows.join(facts, "key", "left").collect()), key=str)
    for bound in (1 << 40, 0):
        assert sorted(map(tuple, skew.facts_join(rows, facts, "key", broadcast_bytes=bound).collect()), key=str) == plain
        assert skew.facts_join(rows, facts, "key", "inner", bound).count() == rows.join(facts, "key").count()
    got = skew.numbered(rows.where("key is not null"), "id", "n").orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(3000)) and skew.numbered(rows.where("1 = 0"), "id").count() == 0


def test_write_back(spark):
    docs = spark.createDataFrame([(1, "http://a.example/p", "old", None, None, None, 0.0, 0), (2, "http://a.example/q", "t", "d", None, None, None, 0)], "doc_id long, url string, title string, description string, crawl_time timestamp_ntz, index_time timestamp_ntz, page_rank double, document_size long")
    pages = spark.createDataFrame([(1, _page("Running Home", "/x", "y", "", "javascript:z", "/x"))], "doc_id long, html string")
    corpus = index.corpus_from_pages(pages)
    post = index.build_postings(corpus)
    after = {r["doc_id"]: r for r in index.described(index.sized(docs, post), corpus).collect()}
    assert after[1]["document_size"] == post.count() and after[1]["index_time"] is not None and after[1]["title"] == "Running Home"
    assert after[2]["document_size"] == 0 and after[2]["index_time"] is None and after[2]["title"] == "t"
    ranks = spark.createDataFrame([(1, 0.7)], "id long, page_rank double")
    assert {r["doc_id"]: r["page_rank"] for r in index.ranked(docs, ranks).collect()} == {1: 0.7, 2: None}
    assert sorted(r["target_url"] for r in index.link_rows(corpus, docs).collect()) == ["http://a.example/p", "http://a.example/x", "http://a.example/y"]
    new = index.inserted(docs, docs.where("1 = 0").drop("crawl_time").unionByName(spark.createDataFrame([(3, "u", "t", "d", None, None, 0)], docs.drop("crawl_time").schema)))
    assert new.where("doc_id = 3 and crawl_time is not null").count() == 1
    words = spark.createDataFrame([(5, "home", 10, 1.5, "home")], "word_id long, word string, word_count long, idf double, stem string")
    grown = {r["word"]: (r["word_id"], r["word_count"], r["idf"], r["stem"]) for r in index.upserted_vocabulary(words, index.word_counts(post)).collect()}
    assert grown["home"][:3] == (5, 13, 1.5) and grown["running"] == (6, 3, 0.0, "run") and grown["text"][0] == 7
    coded = index.coded_postings(post, index.upserted_vocabulary(words, index.word_counts(post)))
    assert coded.count() == post.count()


def test_full_text_prefilter(spark):
    corpus = spark.createDataFrame([(1, "Big", "Small", [(0, "p", "page-search here")]), (2, None, None, None), (3, "research", "", [])], "doc_id long, title string, description string, elements array<struct<ord:int,tag:string,text:string>>")
    text = index.full_text(corpus)
    assert {r["doc_id"]: r["content"] for r in text.collect()} == {1: "Big Smallpage-search here", 2: " ", 3: "research "}
    found = lambda *terms: sorted(r[0] for r in retrieval.full_text_match(text, list(terms)).collect())
    assert found("search") == [1] and found("SEARCH", "research") == [1, 3] and found("") == [] and found("sear") == []
    post = spark.createDataFrame([(1, "search", 0, "body"), (3, "search", 0, "body")], "doc_id long, word string, position int, section string")
    assert [r["doc_id"] for r in retrieval.candidates(post, retrieval.full_text_match(text, ["search"])).collect()] == [1]


def test_files(spark, tmp_path):
    (tmp_path / "seeds").write_text("http://example.com 0\nhttp://example.org 0\nbroken\n")
    assert files.seeds(spark, str(tmp_path / "seeds")).count() == 2
    (tmp_path / "log").write_text("U_http://example.com 0\nV_http://second.com 1\nnonsense\nU_not a url 2\n")
    log = files.frontier_log(spark, str(tmp_path / "log"))
    assert sorted((r["status"], r["url"], r["depth"]) for r in log.collect()) == [("U", "http://example.com", 0), ("V", "http://second.com", 1)]
    pages = tmp_path / "stored"
    pages.mkdir()
    (pages / "a.html").write_text("<p>one\ntwo</p>")
    (pages / "b.html").write_text("")
    assert sorted((r["file_path"][-6:], r["html"]) for r in files.page_files(spark, str(pages)).collect()) == [("a.html", "<p>one\ntwo</p>")]
    files.write_frontier(log, str(tmp_path / "out"))
    assert files.frontier_log(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "stop").write_text("the\n\n a \n")
    assert files.stop_words(spark, str(tmp_path / "stop")) == ["a", "the"]
    with pytest.raises(Exception):
        files.stop_words(spark, str(tmp_path / "none"))
    files.write_pages(spark.createDataFrame([("http://example.com/page", "<html><body>Test Page</body></html>")], "url string, html string"), str(tmp_path / "pages"))
    row = spark.read.parquet(str(tmp_path / "pages")).first()
    assert row["html"] == "<html><body>Test Page</body></html>" and row["file_path"].endswith(".html")


def test_engine(spark, data):
    engine = SearchEngine.over(spark, data)
    first = engine.search("page search", per_page=5)
    again = engine.search("page search", page=2, per_page=5)
    assert len(first.results) == 5 and first.total_documents > 5 and first.total_pages == -(-first.total_documents // 5)
    assert [r["place"] for r in again.results] == [6, 7, 8, 9, 10]
    assert {r["doc_id"] for r in first.results}.isdisjoint(r["doc_id"] for r in again.results)
    assert engine.search("").results == [] and engine.search("page search", page=9999).results == []
    assert len(engine.cache.kept) == 2
    assert SearchEngine.over(spark, data, match="stem").rank("pages").count() >= engine.rank("pages").count()
    # the vocabulary's stems are not all Porter's: a word always finds itself
    assert SearchEngine.over(spark, data, match="stem").rank("query archive").count() >= engine.rank("query archive").count() > 0
    text = index.full_text(index.corpus_from_documents(spark.read.parquet(f"{data}/documents.parquet")))
    assert SearchEngine.over(spark, data, full_text=text).rank("kitchen storm").count() > 0
    with pytest.raises(ValueError):
        engine.search("page search", page=0)


def test_cache():
    now = [0.0]
    cache = TtlCache(2, 10, lambda: now[0])
    assert [cache.get(k, lambda k=k: k * 2) for k in (1, 2, 3)] == [2, 4, 6] and list(cache.kept) == [2, 3]
    now[0] = 11
    assert cache.get(3, lambda: "new") == "new"


def test_stream(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "title", "description", "text")
    for part in range(2):
        docs.where(F.col("doc_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        index_stream(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    whole = index.build_postings(index.corpus_from_documents(docs))
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id", "word", "position", "section").exceptAll(whole).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == whole.count()


def test_keyed_stats(spark):
    rows = [("a", 1, 5, "x")] * 3 + [("a", 2, 1, "y"), ("b", 1, None, "x"), (None, 1, 2, None), ("a", None, 0, "x")]
    frame = spark.createDataFrame(rows, "k string, d long, p int, s string").withColumn("_key", F.lit(1)).withColumn("_n", F.lit(2))
    got = {r["k"]: tuple(r)[1:] for r in keyed_stats(frame, "k", distinct="d", first="p", by=F.col("s"), groups=("x", "y")).collect()}
    assert got == {"a": (5, 2, 0, 1), "b": (1, 1, None, None), None: (1, 1, None, None)}
    assert {r["k"]: r["n_rows"] for r in keyed_stats(frame, "k").collect()} == {"a": 5, "b": 1, None: 1}
    assert [r["k"] for r in heavy_keys(frame, "k", 0.5).collect()] == ["a"]
    assert keyed_stats(frame.where("1 = 0"), "k").count() == 0 and heavy_keys(frame.where("1 = 0"), "k").count() == 0


def test_containers():
    import random

    import numpy as np

    from orevein.operators import orphans

    random.seed(2)
    for places in ([], [0], [orphans.RANGE - 1], range(orphans.RANGE), range(100, 9000), [*range(5), 77, *range(20000, 20003)], random.sample(range(orphans.RANGE), 900), random.sample(range(orphans.RANGE), 15000)):
        bits = np.zeros(orphans.RANGE, bool)
        bits[list(places)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        small = orphans.compress(packed)
        assert (orphans.expand(small) == bits).all() and len(small) <= len(packed) + 1
    assert {orphans.compress(np.packbits(np.isin(np.arange(orphans.RANGE), p), bitorder="little").tobytes())[0] for p in ([3, 9], range(5000), range(0, orphans.RANGE, 2))} == {0, 1, 2}


def test_orphans_against_brute_force(spark):
    import random

    random.seed(4)
    refs = [(random.choice("st"), f"k{random.randrange(60)}", 24000 + random.randrange(5)) for _ in range(400)] + [("s", None, 24001), ("s", "k1", NO_PERIOD)]
    parents = [(random.choice("st"), f"k{random.randrange(60)}", 24000 + random.randrange(7)) for _ in range(80)] + [("s", None, 24000), ("t", "k2", None)]
    r = spark.createDataFrame([(i, *x, "extra") for i, x in enumerate(refs)], "id int, field string, key string, period int, bits string")
    p = spark.createDataFrame(parents, "field string, key string, since int")
    there = {(f, k): min(s for g, q, s in parents if (g, q) == (f, k) and s is not None) for f, k, s in parents if s is not None}
    true = {i for i, (f, k, m) in enumerate(refs) if k is not None and not there.get((f, k), 1 << 30) <= m}
    assert {x["id"] for x in orphan_references(r, p).collect()} == true
    report = orphan_report(r, p).collect()
    assert sum(x["n_orphans"] for x in report) == len(true)
    assert orphan_keys(r.where("1 = 0"), p).count() == 0
    assert {x["id"] for x in orphan_references(r, p.where("1 = 0")).collect()} == {i for i, x in enumerate(refs) if x[1] is not None}


def test_runs_over_stored_tables(spark, data, tmp_path, capsys):
    import json
    import shutil

    from orevein.__main__ import main

    out = str(tmp_path / "out")
    main(["index", "--data", data, "--out", out])
    read = lambda name, base=out: spark.read.parquet(f"{base}/{name}.parquet")
    before, after = read("documents", data), read("documents")
    assert after.count() == before.count() and after.where("index_time is null").count() < before.where("index_time is null").count()
    fresh = before.where("index_time is null").select("doc_id").join(after.where("index_time is not null"), "doc_id")
    sizes = {r["document_id"]: r["count"] for r in read("document_words").groupBy("document_id").count().collect()}
    assert all(sizes[r["doc_id"]] == r["document_size"] for r in fresh.collect())
    assert read("words").groupBy("word").count().where("count > 1").count() == 0 and read("words").groupBy("word_id").count().where("count > 1").count() == 0
    assert read("links").count() >= read("links", data).count()
    main(["page-rank", "--data", data, "--out", str(tmp_path / "ranked")])
    assert read("documents", str(tmp_path / "ranked")).where("page_rank > 0").count() == before.count()
    main(["search", "--data", data, "--query", "page search"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["total_documents"] > 0
    page = read("pages", data).where("url is not null").first()
    (tmp_path / "seeds").write_text(f"{page['url']} 0\n")
    shutil.copytree(data, tmp_path / "new")
    (tmp_path / "new" / "documents.parquet").unlink()
    before.where("1 = 0").write.parquet(str(tmp_path / "new" / "documents.parquet"))
    main(["crawl", "--data", str(tmp_path / "new"), "--out", out, "--seeds", str(tmp_path / "seeds"), "--depth", "1"])
    assert read("crawled").where("status = 'saved'").count() == read("found").count() >= 1
