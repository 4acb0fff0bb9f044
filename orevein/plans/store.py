"""Queries of crawling, indexing end to end, write-back, files and the search page, over whole tables, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import robots
from ..functions.text import content_hash
from ..functions.urls import url_host
from ..operators import crawl, index, pagerank, retrieval, suggest
from ..operators.snippets import spans
from ..session import cut, shared_dir
from ..sources import files
from ..sources.html import read_page
from ..sources.tables import load
from .engine import SearchEngine
from .query import parse
from .reference import _BUILT, _EDGES, _HASH, _KEYWORD_TOKENS, _PLAIN, KEYWORDS, ORACLE as REFERENCE, RULES, _built, _edges
from .sql import normalize_sql, sql_list, tokens_sql

QUERIES, ORACLE = {}, {}
# Fixed value: the stamp that the queries write, so that their results are the same at any time.
STAMP = "2024-01-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orevein-{name}-{uuid.uuid4().hex}"


# --- Crawl --------------------------------------------------------------------------------------------------------------------------
# The rules of the crawl, as patterns.
PATTERNS = (("allow", "^/.*/k.*"), ("disallow", "^/.*/kl.*"), ("disallow", r"^/t.*-1$"), ("disallow", "^/b.*"))
_FIRST_MONTH = "date_trunc('month', crawl_time) = (SELECT date_trunc('month', min(crawl_time)) FROM documents)"


def _gates(wave: str, earlier: str) -> str:
    return f"""looked_{wave} AS (
  SELECT url, CASE WHEN url IN (SELECT url FROM known) THEN 'stored' WHEN NOT coalesce(b.no = 0, true) THEN 'disallowed' WHEN html IS NULL THEN 'missing' ELSE 'saved' END AS status, html
  FROM wave_{wave} LEFT JOIN store USING (url) LEFT JOIN (
    SELECT url, max({{'n': length(pattern), 'no': CASE kind WHEN 'disallow' THEN 1 ELSE 0 END}}) AS b
    FROM (SELECT url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM wave_{wave}) JOIN rules ON regexp_full_match(path, pattern) GROUP BY 1) USING (url)),
done_{wave} AS (
  SELECT url, CASE WHEN status = 'saved' AND (html IN (SELECT html FROM {earlier}) OR url <> min(url) FILTER (status = 'saved') OVER (PARTITION BY html)) THEN 'duplicate' ELSE status END AS status, html FROM looked_{wave})"""


_CRAWL = f"""WITH rules(kind, pattern) AS (VALUES {", ".join(f"('{k}', '{p}')" for k, p in PATTERNS)}),
known AS (SELECT DISTINCT {normalize_sql("url")} AS url FROM documents WHERE lang = 'de'),
store AS (SELECT {normalize_sql("url")} AS url, min(html) AS html FROM pages GROUP BY 1 HAVING {normalize_sql("url")} IS NOT NULL),
wave_0 AS (SELECT DISTINCT {normalize_sql("url")} AS url FROM documents WHERE {_FIRST_MONTH} AND {normalize_sql("url")} IS NOT NULL),
nothing AS (SELECT html FROM store WHERE false), {_gates("0", "nothing")},
saved_0 AS (SELECT url, html FROM done_0 WHERE status = 'saved'),
found AS (SELECT url AS page, unnest(h) AS href, generate_subscripts(h, 1) AS ord FROM (
  SELECT url, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a\\s+href="([^"]*)"', 1) AS h FROM saved_0)),
whole AS (SELECT page, ord, CASE WHEN starts_with(href, '/') THEN regexp_extract(page, '^[a-z]+://[^/?#]*') || href ELSE href END AS href FROM found),
links AS (SELECT page, {normalize_sql("href")} AS url, min(ord) AS ord FROM whole GROUP BY 1, 2 HAVING {normalize_sql("href")} IS NOT NULL),
chosen AS (SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY page ORDER BY length(url), ord) AS place FROM links) WHERE place <= 300),
wave_1 AS (SELECT DISTINCT url FROM chosen WHERE url NOT IN (SELECT url FROM wave_0)), {_gates("1", "saved_0")}
SELECT url, 0 AS depth, status, CASE WHEN html IS NOT NULL AND status IN ('saved', 'duplicate') THEN {_HASH.format("html")} END AS content_hash FROM done_0
UNION ALL SELECT url, 1, status, CASE WHEN html IS NOT NULL AND status IN ('saved', 'duplicate') THEN {_HASH.format("html")} END FROM done_1"""


@query(_CRAWL)
def crawl_gated(spark, base):
    """A crawl of two waves over the stored pages, from the documents of the first month; what is in German counts as stored already."""
    docs = load(spark, base, "documents")
    first = docs.select(F.date_trunc("month", F.min("crawl_time")).alias("t")).scalar()
    seeds = docs.where(F.date_trunc("month", "crawl_time") == first).select("url", F.lit(0).alias("depth"))
    pages = load(spark, base, "pages").select("url", "html")
    hosts = docs.select(url_host(F.col("url")).alias("base")).unionByName(load(spark, base, "links").select(url_host(F.col("target_url")).alias("base"))).where("base <> ''").distinct()
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern")) for k, p in PATTERNS])
    rules = hosts.select("base", F.explode(each).alias("r")).select("base", "r.kind", "r.pattern")
    known = docs.where("lang = 'de'").select("url", F.lit(None).cast("string").alias("document_hash"))
    return crawl.crawl(seeds, pages, known, rules, max_depth=1, max_pages=None).drop("html")


@query(f"""WITH {_EDGES}, seeds AS (SELECT doc_id AS id FROM documents WHERE {_FIRST_MONTH}),
fresh AS (SELECT DISTINCT target AS id FROM edges WHERE source IN (SELECT id FROM seeds) AND target NOT IN (SELECT id FROM seeds) ORDER BY id LIMIT 5)
SELECT id, 0 AS depth FROM seeds UNION ALL SELECT id, 1 FROM fresh""")
def crawl_capped(spark, base):
    """Waves that stop when five pages more than the seeds are there."""
    docs = load(spark, base, "documents")
    first = docs.select(F.date_trunc("month", F.min("crawl_time")).alias("t")).scalar()
    seeds = docs.where(F.date_trunc("month", "crawl_time") == first).select(F.col("doc_id").alias("id"))
    return crawl.waves(seeds, _edges(spark, base), 3, seeds.count() + 5)


_PENDING = f"""log AS (SELECT CASE WHEN index_time IS NULL THEN 'U' ELSE 'V' END AS status, {normalize_sql("url")} AS url, CAST(doc_id % 3 AS INTEGER) AS depth, doc_id
  FROM documents WHERE {normalize_sql("url")} IS NOT NULL)"""


def _frontier(spark: SparkSession, base: str) -> DataFrame:
    """A frontier file of the documents, in the order of their ids: those without index_time are pending."""
    docs = load(spark, base, "documents").where("url is not null")
    path = _folder(spark, "frontier")
    status = F.when(F.col("index_time").isNull(), "U").otherwise("V")
    files.write_frontier(docs.select(status.alias("status"), "url", (F.col("doc_id") % 3).cast("int").alias("depth"), F.col("doc_id").alias("ord")), path)
    return files.frontier_log(spark, path)


@query(f"WITH {_PENDING} SELECT status, url, depth FROM log")
def frontier_replayed(spark, base):
    return _frontier(spark, base).drop("ord")


@query(f"WITH {_PENDING} SELECT 'U' AS status, url, depth, row_number() OVER (ORDER BY doc_id)::INTEGER AS place FROM log WHERE status = 'U' ORDER BY doc_id LIMIT 20")
def frontier_polled(spark, base):
    """The 20 entries that have been pending longest, in their order."""
    from pyspark.sql import Window

    taken, _ = crawl.poll(_frontier(spark, base), 20)
    return taken.select("status", "url", "depth", F.row_number().over(Window.orderBy("ord")).alias("place"))


@query(f"""WITH {_PENDING}, offered AS (SELECT DISTINCT {normalize_sql("target_url")} AS url, 1 AS depth FROM links WHERE {normalize_sql("target_url")} IS NOT NULL),
fresh AS (SELECT * FROM offered WHERE (url, depth) NOT IN (SELECT (url, depth) FROM log WHERE status = 'U')) SELECT status, url, depth FROM log UNION ALL SELECT 'U', url, depth FROM fresh""")
def frontier_offered(spark, base):
    new = load(spark, base, "links").select(F.col("target_url").alias("url"), F.lit(1).alias("depth"))
    return crawl.offer(_frontier(spark, base), new, cap=None).drop("ord")


@query(f"SELECT DISTINCT 'U' AS status, {normalize_sql('url')} AS url, 0 AS depth FROM documents WHERE {normalize_sql('url')} IS NOT NULL")
def frontier_seeded(spark, base):
    """A seed file of all documents' addresses, offered to an empty frontier."""
    path = _folder(spark, "seeds")
    load(spark, base, "documents").where("url is not null and url not like '% %'").select(F.concat("url", F.lit(" 0"))).write.text(path)
    empty = spark.createDataFrame([], "status string, url string, depth int")
    return crawl.seeded(empty, files.seeds(spark, path), cap=None)


# --- Index and write-back -----------------------------------------------------------------------------------------------------------
def _page_corpus(spark: SparkSession, base: str) -> DataFrame:
    """Stored pages under the ids of their documents."""
    docs = load(spark, base, "documents").select("doc_id", "file_path")
    return index.corpus_from_pages(load(spark, base, "pages").select("file_path", "html").join(docs, "file_path").select("doc_id", "html"))


_TITLE = f"""coalesce(nullif({_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ''), {_PLAIN.format("regexp_extract(html, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)")})"""


@query(f"SELECT d.doc_id, CASE WHEN p.file_path IS NULL THEN d.title ELSE {_TITLE} END AS title, p.file_path IS NOT NULL AS on_page FROM documents d LEFT JOIN pages p USING (file_path)")
def index_described(spark, base):
    """Documents with the titles that their stored pages have."""
    docs = load(spark, base, "documents").select("doc_id", "title", "description")
    corpus = cut(_page_corpus(spark, base).select("doc_id", "title", "description", "error"), "corpus")
    return index.described(docs, corpus).join(corpus.select("doc_id", F.lit(True).alias("on_page")), "doc_id", "left").select("doc_id", "title", F.coalesce("on_page", F.lit(False)).alias("on_page"))


@query(f"""WITH {_BUILT}, fresh AS (SELECT doc_id, count(*) AS n FROM built JOIN documents USING (doc_id) WHERE index_time IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n, document_size) AS document_size, CASE WHEN n IS NOT NULL THEN TIMESTAMP '{STAMP}' ELSE index_time END AS index_time FROM documents d LEFT JOIN fresh USING (doc_id)""")
def size_written(spark, base):
    """The documents that were not indexed yet with their sizes and the stamp of the run."""
    docs = load(spark, base, "documents")
    fresh = index.build_postings(index.corpus_from_documents(index.unindexed(docs)))
    return index.sized(docs.select("doc_id", "document_size", "index_time"), fresh, F.lit(STAMP).cast("timestamp_ntz"))


_PAGERANK = REFERENCE["pagerank_documents"]


@query(f"SELECT documents.doc_id, p.page_rank AS page_rank FROM documents JOIN ({_PAGERANK}) p ON p.id = documents.doc_id")
def rank_written(spark, base):
    """Documents with the ranks of the link graph in place of the stored ones."""
    docs = load(spark, base, "documents").select("doc_id", "page_rank")
    ranks = pagerank.pagerank(docs.select(F.col("doc_id").alias("id")), _edges(spark, base))
    return index.ranked(docs, ranks).select("doc_id", F.round("page_rank", 9).alias("page_rank"))


@query(f"""WITH {_BUILT}, fresh AS (SELECT word, count(*) AS n FROM built JOIN documents USING (doc_id) WHERE index_time IS NULL GROUP BY 1)
SELECT word_id, word, CAST(word_count + coalesce(n, 0) AS BIGINT) AS word_count, idf FROM words LEFT JOIN fresh USING (word)
UNION ALL SELECT (SELECT max(word_id) FROM words) + row_number() OVER (ORDER BY encode(word)), word, n, 0.0 FROM fresh WHERE word NOT IN (SELECT word FROM words)""")
def vocabulary_upsert(spark, base):
    fresh = index.build_postings(index.corpus_from_documents(index.unindexed(load(spark, base, "documents"))))
    return index.upserted_vocabulary(load(spark, base, "words"), index.word_counts(fresh)).drop("stem")


@query(f"""WITH {_BUILT}, fresh AS (SELECT built.* FROM built JOIN documents USING (doc_id) WHERE index_time IS NULL)
SELECT doc_id AS document_id, word_id, position AS word_position, section FROM fresh JOIN words USING (word)""")
def postings_coded(spark, base):
    """Postings of the documents that were not indexed yet as rows of the stored table."""
    fresh = index.build_postings(index.corpus_from_documents(index.unindexed(load(spark, base, "documents"))))
    return index.coded_postings(fresh, load(spark, base, "words"))


@query(f"""SELECT documents.url, documents.title FROM documents WHERE url IS NOT NULL
UNION ALL SELECT url, 'found' FROM (SELECT DISTINCT {normalize_sql("target_url")} AS url FROM links) WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM documents WHERE url IS NOT NULL)""")
def documents_inserted(spark, base):
    """Link targets that no document has yet, put in as new documents."""
    from ..functions.urls import normalize

    docs = load(spark, base, "documents").where("url is not null").select("url", "title")
    targets = load(spark, base, "links").select(normalize(F.col("target_url")).alias("url")).where("url is not null").distinct()
    return index.inserted(docs, targets.join(docs.select("url"), "url", "left_anti").withColumn("title", F.lit("found")))


@query(f"""WITH found AS (SELECT doc_id, d.url AS page, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a\\s+href="([^"]*)"', 1)) AS href
  FROM pages JOIN documents d USING (file_path) WHERE d.url IS NOT NULL),
whole AS (SELECT doc_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(page, '^[A-Za-z]+://[^/?#]*') || href ELSE href END AS href FROM found)
SELECT DISTINCT doc_id AS source_document_id, {normalize_sql("href")} AS target_url FROM whole WHERE {normalize_sql("href")} IS NOT NULL""")
def links_inserted(spark, base):
    """Link rows of all stored pages."""
    return index.link_rows(_page_corpus(spark, base), load(spark, base, "documents").select("doc_id", "url").where("url is not null"))


@query("SELECT target_url, coalesce(doc_id, -1) AS doc_id FROM (SELECT DISTINCT target_url FROM links WHERE target_url IS NOT NULL) LEFT JOIN (SELECT url AS target_url, max(doc_id) AS doc_id FROM documents GROUP BY 1) USING (target_url)")
def lookup_ids(spark, base):
    """The document of every link target, -1 where there is none."""
    docs = load(spark, base, "documents").where("url is not null").groupBy(F.col("url").alias("target_url")).agg(F.max("doc_id").alias("doc_id"))
    links = load(spark, base, "links").where("target_url is not null").select("target_url").distinct()
    return links.join(docs, "target_url", "left").select("target_url", F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"))


# --- Full-text prefilter ------------------------------------------------------------------------------------------------------------
_CONTENT = "concat(coalesce(title, ''), ' ', coalesce(description, ''), replace(coalesce(text, ''), chr(10), ' '))"
_MATCH = f"regexp_matches(lower({_CONTENT}), '(^|[^\\p{{L}}\\p{{N}}])(" + "|".join(_KEYWORD_TOKENS) + ")($|[^\\p{L}\\p{N}])')"


def _full_text(spark: SparkSession, base: str) -> DataFrame:
    return index.full_text(index.corpus_from_documents(load(spark, base, "documents")))


@query(f"SELECT doc_id, {_HASH.format(_CONTENT)} AS content_hash FROM documents")
def full_text_stored(spark, base):
    return _full_text(spark, base).select("doc_id", content_hash(F.col("content")).alias("content_hash"))


@query(f"SELECT doc_id FROM documents WHERE {_MATCH}")
def full_text_match(spark, base):
    return retrieval.full_text_match(_full_text(spark, base), list(_KEYWORD_TOKENS))


@query(REFERENCE["keyword_all"].replace("SELECT * FROM ranked", f"SELECT * FROM ranked WHERE doc_id IN (SELECT doc_id FROM documents WHERE {_MATCH})"))
def keyword_prefiltered(spark, base):
    """The keyword query with postings of the prefilter's candidates only."""
    return SearchEngine.over(spark, base, full_text=_full_text(spark, base)).rank(KEYWORDS)


# --- Files and pages ----------------------------------------------------------------------------------------------------------------
@query(f"SELECT {_HASH.format(normalize_sql('url'))} AS file_key, md5(html) AS html_md5 FROM pages WHERE url IS NOT NULL")
def pages_stored(spark, base):
    """Raw pages written to the page store and read back, with the names of their files."""
    path = _folder(spark, "pages")
    files.write_pages(load(spark, base, "pages").where("url is not null").select("url", "html"), path)
    stored = spark.read.parquet(path)
    return stored.where(F.col("file_path").endswith(F.concat(F.lit("/"), "file_key", F.lit(".html")))).select("file_key", F.md5("html").alias("html_md5"))


@query("SELECT page_id, md5(rtrim(html, chr(10))) AS html_md5 FROM pages")
def page_files_scanned(spark, base):
    """Every page written to a file of its own, and the files scanned."""
    path = _folder(spark, "files")
    load(spark, base, "pages").select("page_id", F.rtrim("html", F.lit("\n")).alias("html")).repartition("page_id").write.partitionBy("page_id").text(path)
    rows = files.page_files(spark, f"{path}/page_id=*")
    return rows.select(F.regexp_extract("file_path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), F.md5(F.rtrim("html", F.lit("\n"))).alias("html_md5"))


@query("SELECT word FROM words WHERE idf > 0 AND idf < 1.5")
def stop_words_scanned(spark, base):
    """The most frequent words as a stop-word file, with blanks and empty lines, and the file read."""
    path = _folder(spark, "stop")
    load(spark, base, "words").where("idf > 0 and idf < 1.5").select(F.concat(F.lit(" "), "word", F.lit(" \n"))).write.text(path)
    return spark.createDataFrame([(w,) for w in files.stop_words(spark, path)], "word string")


_META = "regexp_extract(html, '<meta\\s+name=\"description\"\\s+content=\"([^\"]*)\"', 1)"


@query(f"SELECT page_id, CASE WHEN regexp_matches(html, '<meta\\s+name=\"description\"') THEN {_PLAIN.format(_META)} ELSE {_PLAIN.format("regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1)")} END AS description FROM pages")
def html_description(spark, base):
    found = load(spark, base, "pages").select("page_id", read_page("html")["description"].alias("description"))
    return found.withColumn("description", F.trim(F.regexp_replace("description", r"[\s\xa0]+", " ")))


@query(f"""SELECT page_id, text FROM (SELECT page_id, {_PLAIN.format("x")} AS text FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) AS x FROM pages)) WHERE text <> ''""")
def html_headers(spark, base):
    """The texts of all elements that are tagged as headers."""
    elements = index.corpus_from_pages(load(spark, base, "pages"), "page_id").select("doc_id", F.explode("elements").alias("e"))
    return elements.where(F.col("e.tag").rlike("^h[1-6]$")).select(F.col("doc_id").alias("page_id"), F.col("e.text").alias("text"))


@query("SELECT page_id, url IS NULL AS failed FROM pages")
def pages_failed(spark, base):
    """Pages without an address are read as missing ones: they get an error, the others come out."""
    pages = load(spark, base, "pages").select("page_id", F.when(F.col("url").isNotNull(), F.col("html")).alias("html"))
    return index.corpus_from_pages(pages, "page_id").select(F.col("doc_id").alias("page_id"), F.col("error").isNotNull().alias("failed"))


_GROUPED = REFERENCE["postings_grouped"]


@query(f"SELECT doc_id, word_id, '{{' || string_agg('\"' || section || '\":[' || positions || ']', ',' ORDER BY section) || '}}' AS positions FROM ({_GROUPED}) GROUP BY 1, 2")
def section_maps(spark, base):
    """The positions of every word in a document as a map by section."""
    from ..functions.text import clean_section

    rows = load(spark, base, "document_words").select(F.col("document_id").alias("doc_id"), F.col("word_id").alias("word"), clean_section(F.col("section")).alias("section"), F.col("word_position").alias("position")).distinct()
    maps = index.positions_by_section(index.grouped_postings(rows))
    return maps.select("doc_id", F.col("word").alias("word_id"), F.to_json("positions_by_section").alias("positions"))


# --- The search page ----------------------------------------------------------------------------------------------------------------
@query(f"SELECT query_id, array_to_string({tokens_sql('query_text')}, ',') AS key FROM queries")
def cache_keys(spark, base):
    """The key under which the ranking of each keyword query is kept; queries are a stated set."""
    rows = load(spark, base, "queries").collect()
    return spark.createDataFrame([(r["query_id"], ",".join(parse(f"  {r['query_text'].upper()} ").cache_key()[0])) for r in rows], "query_id long, key string")


@query(REFERENCE["snippet_page"].replace("SELECT page.*, coalesce(s, description, '') AS snippet FROM", "SELECT place, doc_id, url, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(nullif(s, ''), description, '') AS description FROM"))
def search_endpoint(spark, base):
    """The first page as the search endpoint gives it, read twice: the second time from the kept ranking."""
    engine = SearchEngine.over(spark, base)
    engine.search(KEYWORDS)
    rows = engine.search(KEYWORDS.upper()).results
    return spark.createDataFrame([(r["place"], r["doc_id"], r["url"], r["title"], r["description"]) for r in rows], "place int, doc_id long, url string, title string, description string")


@query("SELECT word, substr(word, 1, instr(word, 'li') - 1) AS before, 'li' AS hit, substr(word, instr(word, 'li') + 2) AS after FROM words WHERE contains(word, 'li')")
def suggestion_marked(spark, base):
    rows = load(spark, base, "words").where(F.col("word").contains("li")).select("word", suggest.highlight(F.col("word"), "LI").alias("h"))
    return rows.select("word", "h.before", "h.hit", "h.after")


@query("""SELECT doc_id, text, bold FROM (
  SELECT doc_id, x AS text, false AS bold FROM (SELECT doc_id, unnest(string_split(title, 'e')) AS x FROM documents) WHERE x <> ''
  UNION ALL SELECT doc_id, 'e', true FROM (SELECT doc_id, unnest(range(length(title) - length(replace(title, 'e', '')))) FROM documents))""")
def snippet_spans(spark, base):
    """Plain and bold parts of titles in which a letter is marked as hits are."""
    marked = load(spark, base, "documents").select("doc_id", F.replace("title", F.lit("e"), F.lit("<b>e</b>")).alias("s"))
    return marked.select("doc_id", F.explode(spans("s")).alias("p")).select("doc_id", "p.text", "p.bold")


@query("""WITH pages AS (SELECT p, t FROM range(1, 13) a(p), range(1, 13) b(t) WHERE p <= t),
shown AS (SELECT DISTINCT p, t, n FROM (SELECT p, t, unnest([1, t, p - 1, p, p + 1]) AS n FROM pages) WHERE n BETWEEN 1 AND t),
gaps AS (SELECT p, t, n, n - lag(n) OVER (PARTITION BY p, t ORDER BY n) AS gap FROM shown),
parts AS (SELECT p, t, n AS spot, CAST(n AS VARCHAR) AS label FROM gaps
  UNION ALL SELECT p, t, n - 0.5, CASE WHEN gap = 2 THEN CAST(n - 1 AS VARCHAR) ELSE '...' END FROM gaps WHERE gap >= 2)
SELECT CAST(p AS INTEGER) AS page, CAST(t AS INTEGER) AS total, string_agg(label, ' ' ORDER BY spot) AS labels FROM parts GROUP BY 1, 2""")
def pager_labels(spark, base):
    return spark.createDataFrame([(p, t, " ".join(map(str, suggest.pager(p, t)))) for t in range(1, 13) for p in range(1, t + 1)], "page int, total int, labels string")
