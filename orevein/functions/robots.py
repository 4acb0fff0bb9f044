"""Robots rules: parsing, pattern translation and the allow decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import facts_join
from .urls import url_host, url_path

#: The crawler's own name in robots files; give the one in use.
AGENT = "orevein"


def rule_regex(rule: Column) -> Column:
    """A rule as an anchored pattern: ``*`` matches anything, ``$`` ends the path, all else is literal and open at the end."""
    escaped = F.regexp_replace(rule, r"([\\.\[\](){}+?^|])", r"\\$1")
    wild = F.replace(escaped, F.lit("*"), F.lit(".*"))
    closed = F.when(wild.endswith("$") | wild.endswith(".*"), wild).otherwise(F.concat(wild, F.lit(".*")))
    return F.concat(F.lit("^"), closed)


def parse_robots(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """``(base, body)`` to ``(base, kind, rule)`` of the groups for ``*`` or ``agent``.

    The latest user-agent line decides; comments at the end of a line belong to the rule. A fold over the lines keeps the order.
    """
    agent = agent.lower()
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    field = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    value = lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
    empty = F.array().cast("array<struct<kind:string,rule:string>>")
    start = F.struct(F.lit(False).alias("on"), empty.alias("rules"))

    def step(state: Column, x: Column) -> Column:
        is_agent = field(x) == "user-agent"
        applies = F.lower(value(x)).isin("*", agent)
        take = state["on"] & field(x).isin("allow", "disallow")
        one = F.array(F.struct(field(x).alias("kind"), value(x).alias("rule")))
        return F.struct(
            F.when(is_agent, applies).otherwise(state["on"]).alias("on"),
            F.when(take, F.concat(state["rules"], one)).otherwise(state["rules"]).alias("rules"),
        )

    folded = F.aggregate(lines, start, step, lambda s: s["rules"])
    return files.select("base", F.explode(folded).alias("r")).select("base", "r.kind", "r.rule")


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with a column ``allowed``.

    ``rules``: ``(base, kind, pattern)``. The longest matching pattern decides, a tie forbids, no match allows. A host's rules are folded to one
    row; a host with a third of all pages is joined with it by broadcast or salt, and each page decides for itself.
    """
    keyed = urls.withColumn("_base", url_host(F.col(url))).withColumn("_path", url_path(F.col(url)))
    folded = rules.where("base is not null").groupBy(F.col("base").alias("_base")).agg(F.collect_set(F.struct("kind", "pattern")).alias("_rules"))
    joined = facts_join(keyed, folded, "_base")
    # Catalyst has no lambda form of rlike with a pattern per element but in SQL text
    hits = F.expr("filter(_rules, r -> _path rlike concat('^(?:', r.pattern, ')$'))")
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), (r["kind"] == "disallow").cast("int").alias("no"))))
    return joined.withColumn("_no", best["no"]).withColumn("allowed", F.coalesce(F.col("_no") == 0, F.lit(True))).select(*urls.columns, "allowed")
