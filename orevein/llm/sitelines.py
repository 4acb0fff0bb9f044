"""Lines that stand in many documents of one source (problem 7), and texts without them.

The lines of a source form a graph: a node is a line (all that agree in its key), an edge joins lines that follow each other, both
weighted by the documents that show them. Nodes and edges of high support stay, connected components of what stays are the
boilerplate blocks (a line that no edge of support joins to another is a block of one). Occurrences of a block in a document, runs of lines
that are members of the same block, are matched against the table of blocks and deleted.

Scale. A line travels as a 64-bit hash of its key; a false match needs a collision with one of the few kept lines of the same
source. Texts are split and hashed once, to a table. Documents are folded to their different lines before anything is shuffled, and
counting combines on the map side, so a source with a third of all documents sends one count per line and partition. A kept line stands
in at least a tenth of its source's documents, so a source keeps at most ten times as many lines as its documents have on average:
that bound allows one row per source with all of its blocks. It is joined with the documents by broadcast where it is small, else by source
with hot sources salted (``operators.skew``). Marking a document's lines takes its lines times the block lines of its source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import facts_join
from ..session import cut, spread

MIN_DOCUMENTS, MIN_SHARE = 5, 0.1
#: White space other than the line feed, which ends a line.
SPACE = r"[\t\r\x0b\f\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order: lower case, white space trimmed and collapsed, digit runs as one 0; blank lines are empty."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(text), SPACE, " "), r"\p{Nd}+", "0")
    return F.transform(F.split(whole, "\n"), lambda k: F.trim(k))


def line_hashes(text: Column) -> Column:
    """Hashes of a text's line keys, null for blank lines."""
    return F.transform(line_keys(text), lambda k: F.when(k != "", F.xxhash64(k)))


def hashed_lines(documents: DataFrame, *extra: str) -> DataFrame:
    """``(doc_id, source, *extra, lines, h)``: every document with its lines and their hashes; null texts have null arrays."""
    rows = spread(documents.select("doc_id", "source", *extra, "text"))
    return rows.select("doc_id", "source", *extra, F.split("text", "\n").alias("lines"), line_hashes(F.col("text")).alias("h"))


def _sizes(hashed: DataFrame) -> DataFrame:
    return hashed.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("size"))


def _supported(items: DataFrame, sizes: DataFrame, keys: list[str], min_documents: int, min_share: float) -> DataFrame:
    counts = items.groupBy("source", *keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents)
    return counts.join(sizes, "source").where(F.col("n") >= F.col("size") * min_share)


def line_nodes(hashed: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(source, line, n)``: the graph's nodes of high support, with the documents that show them."""
    lines = hashed.where("source is not null").select("source", F.explode(F.array_distinct(F.filter("h", lambda x: x.isNotNull()))).alias("line"))
    return _supported(lines, _sizes(hashed), ["line"], min_documents, min_share).select("source", "line", "n")


def line_edges(hashed: DataFrame, nodes: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(source, a, b, n)``: edges of high support between nodes that follow each other with at most blank lines between."""
    kept = nodes.groupBy("source").agg(F.collect_list("line").alias("kept"))
    # nodes are a table, so the size that decides on the broadcast is that of its files
    full = facts_join(hashed.select("doc_id", "source", F.filter("h", lambda x: x.isNotNull()).alias("h")), kept, "source", "inner")
    marked = full.select("source", F.transform("h", lambda x: F.when(F.array_contains("kept", x), x)).alias("m"))
    steps = F.zip_with("m", F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = marked.select("source", F.explode(F.array_distinct(F.filter(steps, lambda p: p["a"].isNotNull() & p["b"].isNotNull()))).alias("p"))
    return _supported(pairs.select("source", "p.a", "p.b"), _sizes(hashed), ["a", "b"], min_documents, min_share).select("source", "a", "b", "n")


def _components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Connected components of each source's graph, named by their least line."""
    for frame in batches:
        blocks = []
        for lines, edges in zip(frame["lines"], frame["edges"], strict=True):
            parent = {int(k): int(k) for k in lines}

            def root(x: int, parent=parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for edge in edges if edges is not None else []:
                a, b = root(int(edge["a"])), root(int(edge["b"]))
                parent[max(a, b)] = min(a, b)
            blocks.append([{"line": int(k), "block": root(int(k))} for k in lines])
        yield pd.DataFrame({"source": frame["source"], "members": blocks})


MEMBERS = "source string, members array<struct<line:long,block:long>>"


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(source, members)``: one row per source with its lines and the block each belongs to."""
    per_node = nodes.groupBy("source").agg(F.collect_list("line").alias("lines"))
    per_edge = edges.groupBy("source").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    return per_node.join(per_edge, "source", "left").mapInPandas(_components, MEMBERS)


def boilerplate_blocks(hashed: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(source, members)``: the blocks of all sources, as a table in the shared folder. ``hashed`` is read twice: give a table."""
    nodes = cut(line_nodes(hashed, min_documents, min_share), "nodes")
    return cut(components(nodes, line_edges(hashed, nodes, min_documents, min_share)), "blocks")


def matched(hashed: DataFrame, blocks: DataFrame) -> DataFrame:
    """``hashed`` with ``b``: for each line the block it belongs to in its document's source, null elsewhere (null for no lines at all)."""
    joined = facts_join(hashed, blocks, "source")
    none = F.array().cast("array<bigint>")
    member = F.coalesce(F.transform("members", lambda m: m["line"]), none)
    block = F.coalesce(F.transform("members", lambda m: m["block"]), none)
    marked = joined.withColumn("_member", member).withColumn("_block", block)
    return marked.select(*hashed.columns, F.transform("h", lambda x: F.get("_block", F.array_position("_member", x).cast("int") - 1)).alias("b"))


def occurrences(hashed: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(doc_id, source, line_no, block, run)``: every line that is part of an occurrence of a block; ``run`` is the line at which its occurrence, the
    run of lines of one block with at most blank lines between, begins."""
    lines = matched(hashed, blocks).select("doc_id", "source", "h", "b", F.sequence(F.lit(0), F.size("h") - 1).alias("no")).where(F.exists("b", lambda x: x.isNotNull()))
    kept = F.filter(F.arrays_zip("no", "h", "b"), lambda x: x["h"].isNotNull())
    # a run goes on while the line before it, blank ones aside, is of the same block
    start = F.struct(F.lit(-1).cast("bigint").alias("block"), F.lit(-1).alias("run"), F.array().cast("array<struct<line_no:int,block:bigint,run:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        run = F.when(x["b"].eqNullSafe(state["block"]) & x["b"].isNotNull(), state["run"]).otherwise(x["no"])
        one = F.array(F.struct(x["no"].alias("line_no"), x["b"].alias("block"), run.alias("run")))
        return F.struct(x["b"].alias("block"), run.alias("run"), F.when(x["b"].isNotNull(), F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return lines.select("doc_id", "source", F.inline(F.aggregate(kept, start, step, lambda s: s["out"])))


def boilerplate_lines(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(doc_id, line_no, block)``: the lines (split at line feeds, numbered from 0) of all documents that belong to a block.

    Documents without a source are no one's, and null or blank texts have no such lines. Each row of ``documents`` counts as a
    document. An empty table gives no rows; columns other than doc_id, source and text are not read.
    """
    hashed = cut(hashed_lines(documents).drop("lines"), "lines")
    found = matched(hashed, boilerplate_blocks(hashed, min_documents, min_share))
    return found.select("doc_id", F.posexplode("b").alias("line_no", "block")).where("block is not null")


def residual_lines(documents: DataFrame, *extra: str, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``documents`` as ``(doc_id, *extra, lines, keys)``: the text's lines, trimmed, without blank ones and those of high support in the source, and the hashes of
    those lines."""
    hashed = cut(hashed_lines(documents, *extra), "lines")
    nodes = line_nodes(hashed.select("source", "h"), min_documents, min_share)
    kept = cut(nodes.groupBy("source").agg(F.collect_list("line").alias("kept")), "kept")
    none = F.array().cast("array<bigint>")
    left = F.filter(F.arrays_zip("lines", "h"), lambda p: p["h"].isNotNull() & ~F.array_contains(F.coalesce("kept", none), p["h"]))
    rows = facts_join(hashed, kept, "source").select("doc_id", *extra, left.alias("left"))
    return rows.select("doc_id", *extra, F.transform("left", lambda p: F.trim(F.regexp_replace(p["lines"], SPACE, " "))).alias("lines"), F.transform("left", lambda p: p["h"]).alias("keys"))


def without_boilerplate(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(doc_id, text, n_removed)``: every document without the occurrences of its source's blocks; all other lines stay exactly as they are."""
    hashed = cut(hashed_lines(documents), "lines")
    found = matched(hashed, boilerplate_blocks(hashed.select("doc_id", "source", "h"), min_documents, min_share))
    stay = F.filter(F.arrays_zip("lines", "b"), lambda p: p["b"].isNull())
    return found.select("doc_id", F.array_join(F.transform(stay, lambda p: p["lines"]), "\n").alias("text"), F.coalesce(F.size("lines") - F.size(stay), F.lit(0)).alias("n_removed"))
