"""Reorganise the entity graph: communities, change detection, summaries, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bookloom import settings as S
from bookloom.operators import catalog as ct
from bookloom.operators import communities as cm
from bookloom.operators.graph_query import Graph
from bookloom.session import cut

PREVIOUS = "cid string, members_hash string, summary string"


def refresh(
    g: Graph, previous: DataFrame | None = None, summarise=None, assigned: DataFrame | None = None
) -> DataFrame:
    """Communities with summaries: ``cid, entity_count, members_hash, members, summary, made``.

    Communities whose member set is unchanged keep their summary; the others get a new one from
    ``summarise(df with members, snippets) -> df with summary`` (default: a template). ``made`` marks
    new summaries.
    """
    spark = g.entities.sparkSession
    found = assigned if assigned is not None else cut(cm.detect(g))
    old = previous if previous is not None else spark.createDataFrame([], PREVIOUS)
    current = cm.carry_summaries(cm.members_hash(found.select("cid", "node")), old)
    ranks = found.select("cid", "node", "rnk")
    current = current.join(cm.top_members(ranks), "cid")
    stale = current.filter("stale")
    snippets = cm.evidence_snippets(ranks.join(stale.select("cid"), "cid", "left_semi"), g.mentions, g.chunks).groupBy("cid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "snippet"))), lambda x: x["snippet"]).alias("snippets")
    )
    asked = stale.drop("summary").join(snippets, "cid", "left")
    made = (summarise(asked) if summarise else asked.withColumn("summary", cm.template_summary(F.col("members")))).withColumn(
        "summary", F.substring(F.trim("summary"), 1, 400)
    )
    cols = ["cid", "entity_count", "members_hash", "members", "summary"]
    return (
        current.filter("not stale").select(*cols, F.lit(False).alias("made"))
        .unionByName(made.select(*cols, F.lit(True).alias("made")))
    )


def run(
    g: Graph, documents: DataFrame, jobs: DataFrame, runs: DataFrame, previous: DataFrame | None, now: Column,
    policy: str = "debounced", min_docs: int = 3, trigger: str = "auto", summarise=None,
) -> tuple[DataFrame | None, DataFrame]:
    """One debounced run: ``(communities or None, log row)``.

    The log row says whether it ran, and community counts before and after.
    """
    state = cut(ct.documents_since(documents, jobs, runs))
    due = state.select(ct.should_run(F.lit(policy), F.col("docs_since"), F.col("last_run"), now, min_docs).alias("due")).first()["due"]
    before = (previous if previous is not None else g.entities.sparkSession.createDataFrame([], PREVIOUS)).agg(F.count_distinct("cid").alias("communities_before"))
    base = state.select(now.alias("run_at"), F.lit(trigger).alias("triggered_by"), "docs_since").crossJoin(F.broadcast(before))  # one row each
    if not due:
        return None, base.select("run_at", "triggered_by", "docs_since", "communities_before", F.col("communities_before").alias("communities_after"), F.lit(0).cast("long").alias("summaries_made"), F.lit(False).alias("ran"))
    fresh = cut(refresh(g, previous, summarise))
    after = fresh.agg(F.count(F.lit(1)).alias("communities_after"), F.count_if("made").alias("summaries_made"))
    log = base.crossJoin(F.broadcast(after)).withColumn("ran", F.lit(True))
    return fresh, log


def top_summaries(communities: DataFrame, budget: int = S.GLOBAL_BUDGET) -> DataFrame:
    """The largest communities that have a summary, numbered."""
    top = communities.filter("summary is not null").orderBy(F.desc("entity_count"), "cid").limit(max(1, budget))
    return top.select("cid", "summary", "entity_count", "members")
