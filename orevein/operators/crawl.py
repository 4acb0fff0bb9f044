"""Crawling over stored pages: frontier log, gates, link choice, breadth-first waves and the crawl made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import robots
from ..functions.text import content_hash
from ..functions.urls import file_key, is_absolute, link_limit, normalize, resolve
from ..session import cut, release
from ..sources.html import read_page
from .skew import numbered

FRONTIER_CAP = 50_000


def offer(frontier: DataFrame, new: DataFrame, cap: int | None = FRONTIER_CAP) -> DataFrame:
    """The frontier ``(status, url, depth, ord)`` with those of ``new`` ``(url, depth)`` that are not pending yet, by normal form, at its end.

    Nulls and addresses without a normal form are refused, as is what goes beyond ``cap`` pending entries (a bound that the crawl sets; with
    None there is none). ``ord``, the place in the log, may be missing; new entries come behind, in the order of depth and url.
    """
    pending = frontier.where("status = 'U'")
    fresh = new.select(normalize(F.col("url")).alias("url"), F.col("depth").cast("int").alias("depth")).where("url is not null").distinct()
    fresh = fresh.join(pending.select("url", "depth"), ["url", "depth"], "left_anti")
    if cap is not None:
        fresh = fresh.orderBy("depth", "url").limit(max(0, cap - pending.count()))
    fresh = fresh.select(F.lit("U").alias("status"), "url", "depth")
    if "ord" not in frontier.columns:
        return frontier.unionByName(fresh)
    last = frontier.select(F.coalesce(F.max("ord"), F.lit(-1)).alias("last")).scalar()
    key = F.struct("depth", "url")
    return frontier.unionByName(numbered(fresh.withColumn("_key", key), "_key", "ord").drop("_key").withColumn("ord", F.col("ord") + 1 + last))


def seeded(frontier: DataFrame, seeds: DataFrame, cap: int | None = FRONTIER_CAP) -> DataFrame:
    """Seeds ``(url, depth)`` are offered only if the frontier was empty, as when a crawl starts anew; else it goes on as it is."""
    return offer(frontier, seeds, cap) if frontier.isEmpty() else frontier


def visit(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    """The frontier with the given urls marked visited."""
    taken = urls.select("url").distinct().withColumn("_taken", F.lit(True))
    rest = [c for c in frontier.columns if c not in ("status", "url")]
    return frontier.join(taken, "url", "left").select(F.when(F.col("_taken") & (F.col("status") == "U"), "V").otherwise(F.col("status")).alias("status"), "url", *rest)


def poll(frontier: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` entries that have been pending longest, and the frontier with them marked visited (first in, first out, by ``ord``)."""
    taken = frontier.where("status = 'U'").orderBy("ord").limit(n)
    places = taken.select("ord", F.lit(True).alias("_taken"))
    after = frontier.join(places, "ord", "left").select(F.when(F.col("_taken"), "V").otherwise(F.col("status")).alias("status"), "url", "depth", "ord")
    return taken, after


def distinct_content(pages: DataFrame, text: str = "text", order: tuple[str, ...] = ("depth", "url")) -> DataFrame:
    """One page for each content, the first by ``order``; copies combine on the map side, whatever their number."""
    hashed = pages.withColumn("content_hash", content_hash(F.col(text)))
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("_first"))
    same = hashed.join(first, "content_hash").where(F.struct(*order).eqNullSafe(F.col("_first")))
    return same.drop("_first")


def choose_links(links: DataFrame, keep_depth: bool = False) -> DataFrame:
    """``(doc_id, url, place)``: for each page its different normalised absolute links, the shortest first, up to the limit of its depth.

    ``links``: ``(doc_id, depth, ord, href)`` with absolute addresses. Ties keep the page's order. The limit is the crawl's own rule.
    """
    known = links.select("doc_id", "depth", "ord", normalize(F.col("href")).alias("url")).where(F.col("url").isNotNull() & is_absolute(F.col("url")))
    first = known.groupBy("doc_id", "depth", "url").agg(F.min("ord").alias("ord"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("url"), "ord")))
    return placed.where(F.col("place") <= link_limit(F.col("depth"))).select("doc_id", "url", "place", *(["depth"] if keep_depth else []))


def waves(seeds: DataFrame, edges: DataFrame, max_depth: int = 3, max_pages: int | None = None) -> DataFrame:
    """``(id, depth)``: nodes reached from ``seeds`` ``(id)`` over ``edges`` ``(source, target)`` within ``max_depth`` steps, by least depth.

    A wave joins the frontier with the edges and leaves out what was seen; each wave is written to the shared folder.
    """
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "wave")
    wave = seen
    for depth in range(1, max_depth + 1):
        reached = edges.join(wave.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        fresh = reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        if max_pages is not None:
            fresh = fresh.orderBy("id").limit(max(0, max_pages - seen.count()))
        wave = cut(fresh, "wave")
        if wave.isEmpty():
            break
        seen = seen.unionByName(wave)
    return seen


def crawl(seeds: DataFrame, pages: DataFrame, documents: DataFrame, rules: DataFrame, max_depth: int = 3, max_pages: int | None = FRONTIER_CAP) -> DataFrame:
    """``(url, depth, status, html, content_hash)``: every address that a breadth-first crawl from ``seeds`` ``(url, depth)`` looks at, once.

    Fetching reads ``pages`` ``(url, html)``, the store of fetched pages (a live fetcher is any table of that form). The gates, in order, give
    the status: ``stored`` (``documents`` has the address already), ``disallowed`` (by ``rules``, ``(base, kind, pattern)``), ``missing`` (no
    such page), ``duplicate`` (its content is that of a document or of an earlier page; among pages of a wave the least address is the
    earlier one), else ``saved``. Links of saved pages above ``max_depth`` are resolved against the page's address, brought to normal form and chosen by
    ``choose_links``; what was not seen yet is the next wave. Once ``max_pages`` pages are saved no further wave starts, so the bound is met
    to within a wave, as in a crawl whose threads look at it between pages.

    Each wave is one round of joins and is written to the shared folder. Addresses without a normal form are refused. Of several pages with an
    address, the one with the least html counts.
    """
    store = pages.select(normalize(F.col("url")).alias("url"), "html").where("url is not null and html is not null").groupBy("url").agg(F.min("html").alias("html"))
    known = documents.select(normalize(F.col("url")).alias("url")).where("url is not null").distinct().withColumn("_stored", F.lit(True))
    hashes = documents.select(F.col("document_hash").alias("content_hash")).where("content_hash is not null").distinct()
    wave = seeds.select(normalize(F.col("url")).alias("url"), F.col("depth").cast("int").alias("depth")).where("url is not null").groupBy("url").agg(F.min("depth").alias("depth"))
    parts: list[DataFrame] = []
    while True:
        gated = robots.allowed(wave.join(known, "url", "left"), rules).join(store, "url", "left")
        status = F.when(F.col("_stored"), "stored").when(~F.col("allowed"), "disallowed").when(F.col("html").isNull(), "missing").otherwise("saved")
        looked = cut(gated.select("url", "depth", status.alias("status"), "html", F.when(status == "saved", content_hash(F.col("html"))).alias("content_hash")), "looked")
        seen = hashes
        for part in parts:
            seen = seen.unionByName(part.where("status = 'saved'").select("content_hash"))
        first = looked.where("status = 'saved'").groupBy("content_hash").agg(F.min("url").alias("_first")).join(seen, "content_hash", "left_anti").select(F.col("_first").alias("url"), F.lit(True).alias("_new"))
        done = looked.join(first, "url", "left").select("url", "depth", F.when((F.col("status") == "saved") & F.col("_new").isNull(), "duplicate").otherwise(F.col("status")).alias("status"), "html", "content_hash")
        parts.append(cut(done, "wave"))
        release(looked)
        saved = parts[-1].where(F.col("status") == "saved")
        if max_pages is not None and sum(p.where("status = 'saved'").count() for p in parts) >= max_pages:
            break
        links = saved.where(F.col("depth") < max_depth).select("url", "depth", F.posexplode(read_page("html")["links"]).alias("ord", "href"))
        chosen = choose_links(links.select(F.col("url").alias("doc_id"), "depth", "ord", resolve(F.col("url"), F.col("href")).alias("href")), keep_depth=True)
        fresh = chosen.groupBy("url").agg((F.min("depth") + 1).alias("depth"))
        for part in parts:
            fresh = fresh.join(part.select("url"), "url", "left_anti")
        wave = cut(fresh, "next")
        if wave.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stored_documents(crawled: DataFrame, folder: str) -> DataFrame:
    """What a crawl saved as new rows of the documents' table: url, title and description of the page, file path, content hash; ids and times
    are given by the store."""
    saved = crawled.where("status = 'saved'").withColumn("_page", read_page("html"))
    return saved.select("url", "_page.title", "_page.description", F.concat(F.lit(folder.rstrip("/") + "/"), file_key(F.col("url")), F.lit(".html")).alias("file_path"), F.col("content_hash").alias("document_hash"))
