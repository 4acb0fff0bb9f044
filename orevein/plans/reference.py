"""Queries of the search engine's own operators, over whole tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import robots, urls
from ..functions.text import clean_section, content_hash
from ..operators import crawl, index, pagerank, retrieval, suggest
from ..operators.snippets import snippets
from ..sources.html import read_page
from ..sources.tables import load
from .engine import SearchEngine
from .query import parse
from .sql import normalize_sql, sql_list, tokens_sql

KEYWORDS = "kitchen contract storm"
PHRASE, PHRASE3, STOPPED = '"search index"', '"page search link"', '"list of page"'
BOOLEANS = {"bool_and": '"page search" AND "link list"', "bool_or": '"page search" OR "query index"', "bool_not": '"page search" NOT "link list"', "bool_three": '"page search" AND "list index" OR "query link"'}
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# The postings as the retrieval queries see them, and sections cleaned, in SQL.
_SECTION = "CASE WHEN trim(coalesce({0}, '')) = '' THEN 'body' ELSE lower(trim({0})) END"
_POSTINGS = f"""postings AS (
  SELECT document_id AS doc_id, word, word_position AS position, min({_SECTION.format("section")}) AS section
  FROM document_words JOIN words USING (word_id) GROUP BY 1, 2, 3)"""
_WEIGHT = "CASE section WHEN 'title' THEN 2.0 WHEN 'header' THEN 1.5 ELSE 1.0 END::DOUBLE"


def _postings_of(words) -> str:
    return _POSTINGS.replace("FROM document_words JOIN words USING (word_id)", f"FROM document_words JOIN (SELECT word_id, word FROM words WHERE word IN ({sql_list(words)})) USING (word_id)")


def _blend(tf: str) -> str:
    return f"""SELECT doc_id, url, title, description, tf_idf, round(0.7::DOUBLE * tf_idf + 0.3::DOUBLE * coalesce(page_rank, 0), 12) AS final_score
      FROM ({tf}) JOIN documents USING (doc_id)"""


def _tf(source: str, missing: str) -> str:
    return f"""SELECT doc_id, round(total / document_size, 9) AS tf_idf FROM (
      SELECT doc_id, sum(weight * coalesce(idf, {missing})) AS total FROM (
        SELECT doc_id, word, sum({_WEIGHT}) AS weight FROM {source} GROUP BY 1, 2) JOIN words USING (word) GROUP BY 1)
      JOIN documents USING (doc_id) WHERE document_size > 0"""


def _keyword_sql(words) -> str:
    return f"WITH {_postings_of(words)}, ranked AS ({_blend(_tf('postings', '0.0'))})"


def _boolean_sql(text: str) -> str:
    q = parse(text)
    phrases = q.phrase_words()
    ctes = [_postings_of(sorted({w for p in phrases for w in p}))]
    for i, p in enumerate(phrases):
        joins = " ".join(f"JOIN postings p{j} ON p{j}.doc_id = p0.doc_id AND p{j}.section = p0.section AND p{j}.position = p0.position + {j} AND p{j}.word = '{w}'" for j, w in enumerate(p) if j)
        ctes.append(f"found{i} AS (SELECT DISTINCT p0.doc_id FROM postings p0 {joins} WHERE p0.word = '{p[0]}')")
        ctes.append(f"hits{i} AS (SELECT * FROM postings WHERE word IN ({sql_list(p)}) AND doc_id IN (SELECT doc_id FROM found{i}))")
        ctes.append(f"scores{i} AS ({_tf(f'hits{i}', '1.0')})")
    kept = "SELECT doc_id FROM scores0"
    for i, op in enumerate(q.operators, 1):
        kept = f"({kept}) {('INTERSECT', 'INTERSECT', 'UNION', 'EXCEPT')[op]} (SELECT doc_id FROM scores{i})"
    every = " UNION ALL ".join(f"SELECT doc_id, tf_idf, {i} AS i FROM scores{i}" for i in range(len(phrases)))
    first = f"SELECT doc_id, min_by(tf_idf, i) AS tf_idf FROM ({every}) WHERE doc_id IN ({kept}) GROUP BY 1"
    return f"WITH {', '.join(ctes)}, ranked AS ({_blend(first)})"


_PLACED = "SELECT *, row_number() OVER (ORDER BY final_score DESC, doc_id)::INTEGER AS place FROM ranked"

# --- Building the index -------------------------------------------------------------------------------------------------------------
_BUILT = f"""tagged AS (
  SELECT doc_id, list_concat(
    list_transform({tokens_sql("coalesce(title, '')")}, lambda w: {{'word': w, 'section': 'title'}}),
    flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda line, i:
      list_transform({tokens_sql("line")}, lambda w: {{'word': w, 'section': CASE WHEN i = 1 THEN 'header' ELSE 'body' END}})))) AS t FROM documents),
built AS (SELECT doc_id, x.word AS word, CAST(i - 1 AS INTEGER) AS position, x.section AS section
  FROM (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM tagged))"""


def _built(spark: SparkSession, base: str) -> DataFrame:
    return index.build_postings(index.corpus_from_documents(load(spark, base, "documents")))


@query(f"WITH {_BUILT} SELECT * FROM built")
def tokenize_positions(spark, base):
    return _built(spark, base)


@query(f"WITH {_BUILT} SELECT word, count(*) AS word_count FROM built GROUP BY 1")
def word_counts(spark, base):
    return index.word_counts(_built(spark, base))


@query(f"WITH {_BUILT} SELECT doc_id, count(*) AS document_size FROM built GROUP BY 1")
def document_size(spark, base):
    return index.document_sizes(_built(spark, base))


@query(f"WITH {_BUILT} SELECT word, df, round(ln((SELECT count(*) FROM documents) / df + 1), 9) AS idf FROM (SELECT word, count(DISTINCT doc_id) AS df FROM built GROUP BY 1)")
def doc_frequency_idf(spark, base):
    return index.with_idf(index.document_frequency(_built(spark, base)), load(spark, base, "documents"))


@query("SELECT word_id, df, round(ln((SELECT count(*) FROM documents) / df + 1), 9) AS idf FROM (SELECT word_id, count(DISTINCT document_id) AS df FROM document_words GROUP BY 1)")
def stored_idf(spark, base):
    rows = load(spark, base, "document_words").select("word_id", F.col("document_id").alias("doc_id"))
    return index.with_idf(index.document_frequency(rows, "word_id"), load(spark, base, "documents"))


@query(f"""SELECT document_id AS doc_id, word_id, section, string_agg(CAST(word_position AS VARCHAR), ',' ORDER BY word_position) AS positions FROM (
  SELECT DISTINCT document_id, word_id, {_SECTION.format("section")} AS section, word_position FROM document_words) GROUP BY 1, 2, 3""")
def postings_grouped(spark, base):
    rows = load(spark, base, "document_words").select(F.col("document_id").alias("doc_id"), F.col("word_id").alias("word"), clean_section(F.col("section")).alias("section"), F.col("word_position").alias("position")).distinct()
    return index.grouped_postings(rows).select("doc_id", F.col("word").alias("word_id"), "section", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("SELECT word, word_count FROM words WHERE word IN ('page', 'search', 'kitchen', 'storm')")
def collection_frequency(spark, base):
    return load(spark, base, "words").where(F.col("word").isin("page", "search", "kitchen", "storm")).select("word", "word_count")


@query("SELECT doc_id, url, title, word, word_position AS position, section FROM document_words JOIN words USING (word_id) JOIN documents ON document_id = doc_id")
def full_index_scan(spark, base):
    return index.full_scan(*(load(spark, base, t) for t in ("documents", "document_words", "words")))


@query("SELECT doc_id, url, crawl_time FROM documents WHERE index_time IS NULL")
def unindexed_docs(spark, base):
    return index.unindexed(load(spark, base, "documents")).select("doc_id", "url", "crawl_time")


@query(f"""WITH {_BUILT}, fresh AS (SELECT word, count(*) AS word_count FROM built JOIN documents USING (doc_id) WHERE index_time IS NULL GROUP BY 1)
SELECT word, CAST(sum(word_count) AS BIGINT) AS word_count FROM (SELECT word, word_count FROM words UNION ALL SELECT * FROM fresh) GROUP BY 1""")
def incremental_merge(spark, base):
    fresh = index.build_postings(index.corpus_from_documents(index.unindexed(load(spark, base, "documents"))))
    return index.merge_vocabulary(load(spark, base, "words"), index.word_counts(fresh))


@query()
def stem_vocabulary(spark, base):
    from ..functions.porter import stem_udf

    return load(spark, base, "words").select("word", stem_udf("word").alias("stem"))


@query("SELECT doc_id, document_size, coalesce(n, 0) AS postings FROM documents LEFT JOIN (SELECT document_id, count(*) AS n FROM document_words GROUP BY 1) ON document_id = doc_id")
def stored_sizes(spark, base):
    rows = load(spark, base, "document_words").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    docs = load(spark, base, "documents")
    return docs.join(rows, docs["doc_id"] == rows["document_id"], "left").select("doc_id", "document_size", F.coalesce("n", F.lit(0)).alias("postings"))


@query("SELECT url, count(*) AS n FROM documents WHERE url IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_urls(spark, base):
    return index.duplicate_urls(load(spark, base, "documents"))


@query("SELECT doc_id, CASE WHEN r.doc_id IS NULL THEN title ELSE 'removed' END AS title FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM removed_documents) r USING (doc_id)")
def metadata_update(spark, base):
    docs, gone = load(spark, base, "documents"), load(spark, base, "removed_documents")
    return index.updated(docs.select("doc_id", "title"), gone.select("doc_id", F.lit("removed").alias("title")).distinct(), "doc_id")


# --- Retrieval ----------------------------------------------------------------------------------------------------------------------
_KEYWORD_TOKENS = parse(KEYWORDS).tokens


@query(f"{_keyword_sql(_KEYWORD_TOKENS)} SELECT * FROM ({_PLACED}) WHERE place <= 10")
def keyword_search(spark, base):
    return retrieval.result_page(SearchEngine.over(spark, base).rank(KEYWORDS))


@query(f"{_keyword_sql(_KEYWORD_TOKENS)} SELECT * FROM ({_PLACED}) WHERE place BETWEEN 11 AND 20")
def keyword_page2(spark, base):
    return retrieval.result_page(SearchEngine.over(spark, base).rank(KEYWORDS), page=2)


@query(f"{_keyword_sql(_KEYWORD_TOKENS)} SELECT * FROM ranked")
def keyword_all(spark, base):
    return SearchEngine.over(spark, base).rank(KEYWORDS)


@query(f"{_keyword_sql(_KEYWORD_TOKENS)} SELECT count(*) AS total_documents, CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages FROM ranked")
def page_count(spark, base):
    return retrieval.totals(SearchEngine.over(spark, base).rank(KEYWORDS))


def _register_phrases() -> None:
    for name, text in {"phrase_search": PHRASE, "phrase_3terms": PHRASE3, "phrase_stopword_empty": STOPPED, **BOOLEANS}.items():
        QUERIES[name] = lambda spark, base, text=text: SearchEngine.over(spark, base).rank(text)
        ORACLE[name] = f"{_boolean_sql(text)} SELECT * FROM ranked"


_register_phrases()


STEMMED = "query archive cookies storms"


@query(f"""WITH wanted AS (SELECT word_id, word, idf FROM words WHERE stem IN (SELECT stem FROM words WHERE word IN ({sql_list(STEMMED.split())}))), postings AS (
  SELECT document_id AS doc_id, word, word_position AS position, min({_SECTION.format("section")}) AS section FROM document_words JOIN wanted USING (word_id) GROUP BY 1, 2, 3),
  ranked AS ({_blend(_tf("postings", "0.0"))}) SELECT * FROM ranked""")
def keyword_stem(spark, base):
    """Words with the stems that the vocabulary has for the query's words, whichever stemmer made them."""
    return SearchEngine.over(spark, base, match="stem").rank(STEMMED)


@query(f"""{_keyword_sql(_KEYWORD_TOKENS)}, page AS (SELECT * FROM ({_PLACED}) WHERE place <= 10),
hits AS (SELECT doc_id, word, min(position) AS first FROM postings SEMI JOIN page USING (doc_id) GROUP BY 1, 2),
near AS (
  SELECT document_id AS doc_id, word, word_position AS position FROM document_words JOIN words USING (word_id)
  WHERE document_id IN (SELECT doc_id FROM page) GROUP BY 1, 2, 3),
shown AS (SELECT DISTINCT near.doc_id, near.position, near.word FROM near JOIN hits ON near.doc_id = hits.doc_id AND near.position BETWEEN greatest(first - 15, 0) AND first + 15),
made AS (SELECT doc_id, string_agg(CASE WHEN word IN ({sql_list(_KEYWORD_TOKENS)}) THEN '<b>' || word || '</b>' ELSE word END, ' ' ORDER BY position, word) || ' ...' AS s FROM shown GROUP BY 1)
SELECT page.*, coalesce(s, description, '') AS snippet FROM page LEFT JOIN made USING (doc_id)""")
def snippet_page(spark, base):
    return SearchEngine.over(spark, base).page(KEYWORDS)


@query("SELECT coalesce(max(doc_id), -1) AS doc_id FROM documents WHERE url = 'https://nowhere.example/none'")
def lookup_missing_url(spark, base):
    return load(spark, base, "documents").where(F.col("url") == "https://nowhere.example/none").agg(F.coalesce(F.max("doc_id"), F.lit(-1)).cast("long").alias("doc_id"))


@query("SELECT link_id, target_url, target_url IN (SELECT url FROM documents WHERE url IS NOT NULL) AS crawled FROM (SELECT DISTINCT link_id, target_url FROM links WHERE target_url IS NOT NULL)")
def crawled_targets(spark, base):
    links, docs = load(spark, base, "links").where("target_url is not null").select("link_id", "target_url").distinct(), load(spark, base, "documents")
    known = docs.where("url is not null").select(F.col("url").alias("_url")).distinct()
    return links.join(known, links["target_url"] == known["_url"], "left").select("link_id", "target_url", F.col("_url").isNotNull().alias("crawled"))


# --- Links and PageRank -------------------------------------------------------------------------------------------------------------
_EDGES = "edges AS (SELECT source_document_id AS source, doc_id AS target FROM (SELECT DISTINCT source_document_id, target_url FROM links WHERE source_document_id IS NOT NULL) JOIN documents ON target_url = url)"


def _edges(spark: SparkSession, base: str) -> DataFrame:
    links = load(spark, base, "links").where("source_document_id is not null").select("source_document_id", "target_url").distinct()
    return pagerank.resolve_links(links, load(spark, base, "documents"))


@query(f"WITH {_EDGES} SELECT * FROM edges")
def resolve_links(spark, base):
    return _edges(spark, base)


@query(f"WITH {_EDGES} SELECT doc_id AS id, coalesce(n, 0) AS out_degree FROM documents LEFT JOIN (SELECT source AS s, count(*) AS n FROM edges GROUP BY 1) ON s = doc_id")
def out_degree(spark, base):
    return pagerank.out_degrees(load(spark, base, "documents").select(F.col("doc_id").alias("id")), _edges(spark, base))


@query(f"WITH {_EDGES} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT source FROM edges)")
def dangling_nodes(spark, base):
    return pagerank.out_degrees(load(spark, base, "documents").select(F.col("doc_id").alias("id")), _edges(spark, base)).where("out_degree = 0").select("id")


@query(f"""WITH RECURSIVE {_EDGES}, nodes AS (SELECT DISTINCT doc_id AS id FROM documents), size AS (SELECT count(*) AS n FROM nodes),
known AS (SELECT source, target FROM edges WHERE source IN (SELECT id FROM nodes)), degree AS (SELECT source AS id, count(*) AS d FROM known GROUP BY 1),
pr(k, id, r) AS (
  SELECT 0, id, 1.0::DOUBLE / n FROM nodes, size
  UNION ALL
  SELECT k + 1, id, 0.15 / n + 0.85 * (coalesce(g, 0) + loose / n) FROM (
    SELECT nodes.id AS id, m.k AS k, m.loose AS loose, n, gifts.g AS g FROM nodes, size,
      (SELECT max(k) AS k, sum(CASE WHEN d IS NULL THEN r ELSE 0 END) AS loose FROM pr LEFT JOIN degree USING (id)) m
    LEFT JOIN (SELECT target, sum(r / d) AS g FROM pr JOIN degree USING (id) JOIN known ON source = id GROUP BY 1) gifts ON gifts.target = nodes.id)
  WHERE k < 100),
moved AS (SELECT a.k, max(abs(b.r - a.r)) AS d FROM pr a JOIN pr b ON b.k = a.k + 1 AND b.id = a.id GROUP BY 1)
SELECT id, round(r, 9) AS page_rank FROM pr WHERE k = (SELECT coalesce(min(k), 100) FROM moved WHERE d < 1e-5)""")
def pagerank_documents(spark, base):
    nodes = load(spark, base, "documents").select(F.col("doc_id").alias("id"))
    return pagerank.pagerank(nodes, _edges(spark, base)).select("id", F.round("page_rank", 9).alias("page_rank"))


@query(f"""WITH RECURSIVE {_EDGES}, seeds AS (SELECT doc_id AS id FROM documents WHERE date_trunc('month', crawl_time) = (SELECT date_trunc('month', min(crawl_time)) FROM documents)),
w(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT target, depth + 1 FROM w JOIN edges ON source = id WHERE depth < 3)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")
def crawl_waves(spark, base):
    docs = load(spark, base, "documents")
    first = docs.select(F.date_trunc("month", F.min("crawl_time")).alias("t")).scalar()
    return crawl.waves(docs.where(F.date_trunc("month", "crawl_time") == first).select(F.col("doc_id").alias("id")), _edges(spark, base))


# --- Urls, robots, pages ------------------------------------------------------------------------------------------------------------
@query(f"SELECT DISTINCT target_url, {normalize_sql('target_url')} AS normal FROM links WHERE target_url IS NOT NULL")
def normalize_url(spark, base):
    return load(spark, base, "links").where("target_url is not null").select("target_url").distinct().withColumn("normal", urls.normalize(F.col("target_url")))


@query("SELECT DISTINCT target_url, regexp_matches(target_url, '^[a-zA-Z][a-zA-Z0-9+-.]*://') AS is_absolute FROM links WHERE target_url IS NOT NULL")
def is_absolute(spark, base):
    return load(spark, base, "links").where("target_url is not null").select("target_url").distinct().withColumn("is_absolute", urls.is_absolute(F.col("target_url")))


_HASH = "rtrim(translate(to_base64(unhex(sha256({0}))), '+/', '-_'), '=')"


@query(f"SELECT doc_id, {_HASH.format(normalize_sql('url'))} AS file_key FROM documents WHERE url IS NOT NULL")
def url_file_key(spark, base):
    return load(spark, base, "documents").where("url is not null").select("doc_id", urls.file_key(F.col("url")).alias("file_key"))


@query(f"SELECT doc_id, {_HASH.format('text')} AS content_hash, {_HASH.format('text')} = document_hash AS same FROM documents")
def content_hashes(spark, base):
    return load(spark, base, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"), (content_hash(F.col("text")) == F.col("document_hash")).alias("same"))


@query(f"SELECT {_HASH.format('text')} AS content_hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(spark, base):
    docs = load(spark, base, "documents").where("text is not null").select("doc_id", "text")
    return crawl.distinct_content(docs, order=("doc_id",)).select("content_hash", "doc_id")


# Rules for the robots queries.
RULES = (("allow", "/*/k"), ("disallow", "/*/kl"), ("disallow", "/*?id=*&page=8"), ("disallow", "/t*-1$"), ("allow", "/b*/*-2"), ("disallow", "/b"), ("disallow", "/*.html"))
# What those rules must become.
RULE_PATTERNS = ("^/.*/k.*", "^/.*/kl.*", r"^/.*\?id=.*&page=8.*", "^/t.*-1$", "^/b.*/.*-2.*", "^/b.*", r"^/.*\.html.*")
_RULE_ROWS = ", ".join(f"('{k}', '{p}')" for (k, _), p in zip(RULES, RULE_PATTERNS, strict=True))


@query("SELECT kind, rule, pattern FROM (VALUES " + ", ".join(f"('{k}', '{r}', '{p}')" for (k, r), p in zip(RULES, RULE_PATTERNS, strict=True)) + ") t(kind, rule, pattern)")
def robots_rules(spark, base):
    return spark.createDataFrame(list(RULES), "kind string, rule string").withColumn("pattern", robots.rule_regex(F.col("rule")))


@query(f"""WITH rules(kind, pattern) AS (VALUES {_RULE_ROWS}),
seen AS (SELECT DISTINCT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS path FROM documents WHERE url IS NOT NULL),
best AS (SELECT url, max({{'n': length(pattern), 'no': CASE kind WHEN 'disallow' THEN 1 ELSE 0 END}}) AS b FROM seen JOIN rules ON regexp_full_match(path, pattern) GROUP BY 1)
SELECT documents.doc_id, url, coalesce(b.no = 0, true) AS allowed FROM documents LEFT JOIN best USING (url) WHERE url IS NOT NULL""")
def robots_allowed(spark, base):
    docs = load(spark, base, "documents").where("url is not null").select("doc_id", "url")
    bases = docs.select(urls.url_host(F.col("url")).alias("base")).distinct()
    files = bases.withColumn("body", F.lit("user-agent: *\n" + "\n".join(f"{k}: {r}" for k, r in RULES)))
    rules = robots.parse_robots(files).select("base", "kind", robots.rule_regex(F.col("rule")).alias("pattern"))
    return robots.allowed(docs, rules)


_PLAIN = "replace(replace(replace(trim(regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g')), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"


@query(f"SELECT page_id, coalesce(nullif({_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ''), {_PLAIN.format("regexp_extract(html, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)")}) AS title FROM pages")
def html_title(spark, base):
    return load(spark, base, "pages").select("page_id", read_page("html")["title"].alias("title"))


@query()
def html_sections(spark, base):
    """Elements of all pages with their sections."""
    elements = index.corpus_from_pages(load(spark, base, "pages"), "page_id").select("doc_id", F.explode("elements").alias("e"))
    return elements.select(F.col("doc_id").alias("page_id"), "e.ord", "e.tag", F.when(F.col("e.tag").rlike("^h[1-6]$"), "header").otherwise("body").alias("section"), "e.text")


@query()
def page_postings(spark, base):
    """Postings of all stored pages."""
    return index.build_postings(index.corpus_from_pages(load(spark, base, "pages"), "page_id"))


@query(f"""WITH found AS (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS ord FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a\\s+href="([^"]*)"', 1) AS h FROM pages)),
full_urls AS (SELECT page_id, ord, 'https://host.example' || href AS href FROM found WHERE starts_with(href, '/')
  UNION ALL SELECT page_id, ord, href FROM found WHERE NOT starts_with(href, '/')),
known AS (SELECT page_id, min(ord) AS ord, {normalize_sql("href")} AS url FROM full_urls GROUP BY page_id, 3 HAVING url IS NOT NULL)
SELECT page_id, url, place FROM (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY length(url), ord)::INTEGER AS place FROM known) WHERE place <= 50""")
def links_topk_by_length(spark, base):
    """The links that a crawl at depth 3 follows from each page, the shortest first."""
    pages = load(spark, base, "pages").select(F.col("page_id").alias("doc_id"), F.lit(3).alias("depth"), F.posexplode(read_page("html")["links"]).alias("ord", "href"))
    absolute = pages.withColumn("href", F.when(F.col("href").startswith("/"), F.concat(F.lit("https://host.example"), "href")).otherwise(F.col("href")))
    return crawl.choose_links(absolute).withColumnRenamed("doc_id", "page_id")


@query("SELECT d AS depth, CASE d WHEN 0 THEN 300 WHEN 1 THEN 150 WHEN 2 THEN 75 WHEN 3 THEN 50 ELSE 25 END AS links FROM generate_series(0, 5) t(d)")
def per_depth_limit(spark, base):
    return spark.range(6).select(F.col("id").alias("depth"), urls.link_limit(F.col("id")).alias("links"))


# --- Suggestions --------------------------------------------------------------------------------------------------------------------
_HISTORY = "history AS (SELECT word AS term, count(*) AS n, max(epoch_us(crawl_time) // 1000) AS used FROM document_words JOIN words USING (word_id) JOIN documents ON document_id = doc_id GROUP BY 1)"


def _history(spark: SparkSession, base: str) -> DataFrame:
    rows = load(spark, base, "document_words").groupBy("document_id", "word_id").agg(F.count(F.lit(1)).alias("n"))
    docs = load(spark, base, "documents").select("doc_id", F.unix_millis(F.col("crawl_time").cast("timestamp")).alias("t"))
    named = rows.join(docs, rows["document_id"] == docs["doc_id"]).join(load(spark, base, "words").select("word_id", "word"), "word_id")
    return named.groupBy(F.col("word").alias("term")).agg(F.sum("n").alias("count"), F.max("t").alias("last_used"))


@query(f"""WITH {_HISTORY}, rated AS (SELECT term, n, used, instr(term, 'li') - 1 AS spot, (length(term) - length(replace(term, 'li', ''))) // 2 AS hits FROM history WHERE contains(term, 'li'))
SELECT term, round((CASE WHEN term = 'li' THEN 100 WHEN starts_with(term, 'li') THEN 75 ELSE 50 + CASE WHEN spot <= 3 THEN 10 ELSE 0 END END + CASE WHEN hits > 1 THEN 5 * hits ELSE 0 END) * 1000 + 100 * ln(n + 1) + used / 1e6, 6) AS score
FROM rated ORDER BY score DESC, term LIMIT 5""")
def suggestions_typed(spark, base):
    return suggest.suggestions(_history(spark, base), "li")


@query(f"WITH {_HISTORY} SELECT term, CAST(used + n * 10000 AS DOUBLE) AS score FROM history ORDER BY score DESC, term LIMIT 5")
def suggestions_blank(spark, base):
    return suggest.suggestions(_history(spark, base), "").select("term", F.col("score").cast("double").alias("score"))
