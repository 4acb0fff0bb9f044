"""Link graph and PageRank."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut, release

DAMPING, THRESHOLD, MAX_ROUNDS = 0.85, 1e-5, 100
#: Rounds that run as one plan.
BATCH = 8


def resolve_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """``(source, target)``: links whose target is the url of a document; others are dropped, links of a page to itself stay."""
    return links.join(documents.select("doc_id", "url"), links["target_url"] == documents["url"]).select(F.col("source_document_id").alias("source"), F.col("doc_id").alias("target"))


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, out_degree)`` of all nodes; dangling ones have 0. Repeated edges count as often."""
    degrees = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(degrees, nodes["id"] == degrees["source"], "left").select("id", F.coalesce("n", F.lit(0)).alias("out_degree"))


def _walk(start: DataFrame, graph: DataFrame, rounds: int, damping: float) -> DataFrame:
    """``start`` ``(id, v0)`` with ``v1`` and so on: what each node is given by its links, round after round, in one plan.

    A node sends itself what it has so far and every target its gift, and the sums are grouped by id: one exchange a round, in which gifts combine on
    the map side. The graph stays where it is, partitioned as the sums are.
    """
    # written as SQL text: a column object for each term would take longer to make than the plan to run
    state = start
    for j in range(rounds):
        kept = [f"v{i}" for i in range(j + 1)]
        itself = ", ".join(f"'{v}', {v}" for v in kept)
        none = ", ".join(f"'{v}', CAST(NULL AS DOUBLE)" for v in kept)
        sent = f"transform(coalesce(targets, array()), t -> named_struct('id', t.target, {none}, 'gift', t.n * {damping!r}D * v{j} / degree))"
        rows = state.join(graph, "id").selectExpr(f"inline(concat(array(named_struct('id', id, {itself}, 'gift', 0.0D)), {sent}))")
        state = rows.groupBy("id").agg(F.expr(f"sum(gift) AS v{j + 1}"), *[F.expr(f"max({v}) AS {v}") for v in kept])
    return state


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(id, page_rank)`` by power iteration from 1/n, the mass of dangling nodes spread over all.

    Stops when no rank moves by ``threshold`` and then gives the ranks of the round before, or after ``max_rounds``. Edges from or to unknown
    nodes are left out, ids are integers. Jobs run when this is called.

    A round adds to what links give the same number for every node, which hangs on the dangling mass of the round before. Both parts are
    linear, so ``BATCH`` rounds of gifts run as one plan without those numbers, once from the ranks and, in the first batch, from ones; the masses are
    observed while the batch is written, the numbers follow from them, and any round's ranks are sums over the two tables. So the driver takes part, and a
    table ends the lineage, once a batch. The graph is moved once: a row per node with its links (no more than its page holds)
    stays on the executors, and what an executor loses is made again from its table in the shared folder.
    """
    nodes = nodes.select(F.col("id").cast("long").alias("id")).distinct()
    spark = nodes.sparkSession
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("page_rank"))
    known = edges.join(nodes, edges["source"] == nodes["id"], "left_semi").join(nodes, edges["target"] == nodes["id"], "left_semi").select(F.col("source").cast("long").alias("id"), F.col("target").cast("long").alias("target"))
    links = known.groupBy("id", "target").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.collect_list(F.struct("target", "n")).alias("targets"), F.sum("n").alias("degree"))
    stored = cut(nodes.join(links, "id", "left"), "graph")
    graph = stored.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").persist(StorageLevel.MEMORY_AND_DISK)
    columns = [f"v{j}" for j in range(BATCH + 1)]

    def batch(start: DataFrame) -> tuple[DataFrame, list[float]]:
        """The table of a batch, and the mass of dangling nodes in each of its rounds."""
        seen = Observation()
        walked = _walk(start, graph, BATCH, damping).join(graph.selectExpr("id", "degree IS NULL AS loose"), "id")
        table = cut(walked.observe(seen, *[F.expr(f"coalesce(sum(IF(loose, {v}, 0.0D)), 0.0D) AS {v}") for v in columns]).select("id", *columns), "ranks")
        got = seen.get
        return table, [got[v] for v in columns]

    def rank(j: int, added: list[float]) -> str:
        """Ranks after round ``j`` of a batch; ``w``: what ones become in as many rounds."""
        return " + ".join([f"v{j}", *(f"{added[j - 1 - i]!r}D * w{i}" for i in range(j))])

    try:
        table, masses = batch(graph.select("id", F.lit(1.0 / n).alias("v0")))
        # the first batch starts from ones, divided by n
        ones, of_ones = table.selectExpr("id", *[f"v{j} * {float(n)!r}D AS w{j}" for j in range(BATCH + 1)]), [m * n for m in masses]
        first = table
        done = 0
        while True:
            added: list[float] = []
            for j in range(BATCH):
                loose = masses[j] + sum(added[j - 1 - i] * of_ones[i] for i in range(j))
                added.append((1 - damping) / n + damping * loose / n)
            both = table.join(ones, "id")
            ranks = both.selectExpr("id", *[f"{rank(j, added)} AS r{j}" for j in range(BATCH + 1)])
            moves = ranks.selectExpr(*[f"max(abs(r{j + 1} - r{j}))" for j in range(BATCH)]).first()
            for j in range(BATCH):
                if moves[j] < threshold or done + j == max_rounds:
                    return ranks.selectExpr("id", f"r{j} AS page_rank")
            done += BATCH
            old = table
            table, masses = batch(ranks.selectExpr("id", f"r{BATCH} AS v0"))
            if old is not first:
                release(old)
    finally:
        graph.unpersist()
        release(stored)
