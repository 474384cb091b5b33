"""Questions to the entity graph: neighbourhoods, paths, exports, cross-library findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from bookloom import settings as S
from bookloom.functions.entities import canonical
from bookloom.session import cut, stored


@dataclass(frozen=True)
class Graph:
    """The node and edge tables of one library.

    A table may also be given as a function that opens it, called when a question first needs the table.
    """

    documents: DataFrame | Callable[[], DataFrame]  # doc_id, title, corpus
    chunks: DataFrame | Callable[[], DataFrame]  # chunk_id, doc_id, corpus, chunk_index, text
    entities: DataFrame | Callable[[], DataFrame]  # canonical, name, type
    aliases: DataFrame | Callable[[], DataFrame]  # name, canonical
    mentions: DataFrame | Callable[[], DataFrame]  # chunk_id, doc_id, corpus, canonical
    doc_mentions: DataFrame | Callable[[], DataFrame]  # doc_id, canonical
    relations: DataFrame | Callable[[], DataFrame]  # src, dst, type, weight, evidence
    images: DataFrame | Callable[[], DataFrame] | None = None  # image_id, doc_id, caption
    depicts: DataFrame | Callable[[], DataFrame] | None = None  # image_id, canonical

    def __getattribute__(self, name: str):
        value = super().__getattribute__(name)
        if name in Graph.__dataclass_fields__ and callable(value):
            value = value()
            object.__setattr__(self, name, value)
        return value


def _first(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rnk") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def degrees(g: Graph) -> DataFrame:
    """Number of edges of any kind at each entity: ``(canonical, degree)``."""
    ends = [
        g.mentions.select("canonical"),
        g.doc_mentions.select("canonical"),
        g.relations.select(F.col("src").alias("canonical")),
        g.relations.filter("src <> dst").select(F.col("dst").alias("canonical")),
        g.aliases.select("canonical"),
    ]
    if g.depicts is not None:
        ends.append(g.depicts.select("canonical"))
    all_ends = ends[0]
    for e in ends[1:]:
        all_ends = all_ends.unionByName(e)
    return all_ends.groupBy("canonical").agg(F.count(F.lit(1)).alias("degree"))


def ranked_entities(g: Graph) -> DataFrame:
    """Entities with their degree (0 for isolated ones)."""
    return g.entities.join(degrees(g), "canonical", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def node_counts(g: Graph) -> DataFrame:
    tables = {
        "Document": g.documents, "Chunk": g.chunks, "Entity": g.entities, "Alias": g.aliases, "Image": g.images,
    }
    rows = None
    for label, table in tables.items():
        if table is None:
            continue
        one = table.agg(F.count(F.lit(1)).alias("count")).select(F.lit(label).alias("label"), "count").filter("count > 0")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def top_entities(g: Graph, n: int = 10) -> DataFrame:
    return ranked_entities(g).orderBy(F.desc("degree"), "canonical").limit(n)


def entity_corpora(g: Graph) -> DataFrame:
    """``(canonical, corpus)`` pairs over chunk and document mentions, distinct."""
    docs = g.documents.select("doc_id", "corpus")
    return g.mentions.select("canonical", "corpus").unionByName(
        g.doc_mentions.join(docs, "doc_id").select("canonical", "corpus")
    ).distinct()


def entity_counts(g: Graph, approximate: bool = False) -> DataFrame:
    """Distinct entities per corpus."""
    count = F.approx_count_distinct("canonical") if approximate else F.count(F.lit(1))
    return entity_corpora(g).groupBy("corpus").agg(count.alias("entity_count"))


def _grams(c: Column, n: int) -> Column:
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))))


def search_entities(g: Graph, needles: DataFrame, limit: int = 12) -> DataFrame:
    """Case-insensitive containment in name or merge key, highest degree first.

    ``needles(qid, q)``; blank needles find nothing. Names are indexed
    by their short character runs; a needle meets only the names holding its rarest run, and the
    containment test decides.
    """
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    asked = needles.withColumn("q", F.lower(F.trim("q"))).filter("q <> ''")
    width = F.least(F.length("q"), F.lit(3))
    runs = asked.select(
        "qid", "q",
        F.explode(F.when(width == 1, _grams(F.col("q"), 1)).when(width == 2, _grams(F.col("q"), 2)).otherwise(_grams(F.col("q"), 3))).alias("gram"),
    )
    low = g.entities.select("canonical", "name", F.lower("name").alias("low"))
    index = low.select(
        "canonical", "name",
        F.explode(
            F.array_distinct(F.flatten(F.array(*[_grams(F.col(c), n) for c in ("low", "canonical") for n in (1, 2, 3)])))
        ).alias("gram"),
    )
    common = index.join(runs.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = _first(runs.join(common, "gram"), ["qid"], [F.asc("df"), F.asc("gram")], 1).select("qid", "q", "gram")
    # a needle with a run no name holds finds nothing; it may still meet names by another run, and
    # then the containment test turns them all away
    found = (
        rarest.join(index, "gram")
        .filter(F.lower("name").contains(F.col("q")) | F.col("canonical").contains(F.col("q")))
        .select("qid", "canonical")
        .join(ranked_entities(g), "canonical")
    )
    return _first(found, ["qid"], [F.desc("degree"), F.asc("canonical")], limit)


# ── neighbourhoods ──────────────────────────────────────────────────────────────────────────────


def _pairs(g: Graph) -> DataFrame:
    """Undirected neighbour pairs in both directions; ``parallel`` when several relations join them."""
    rel = g.relations.filter("src <> dst")
    both = rel.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
        rel.select(F.col("dst").alias("u"), F.col("src").alias("v"))
    )
    return both.groupBy("u", "v").agg((F.count(F.lit(1)) > 1).alias("parallel"))


def within_reach(edges: DataFrame, lists: DataFrame, limit: int) -> DataFrame:
    """``edges(m, w)`` with the sorted ``ids`` of ``w``, each list only up to the ``limit + 1``-th distinct first id around ``m``.

    One ``w`` left out, ``limit`` distinct ids up to there remain, so no later id is among the first ``limit`` of ``m``; of an id
    that is kept, every ``w`` that has it is kept.
    """
    headed = stored(edges.join(lists.select("w", F.col("ids")[0].alias("head")), "w"), "headed")
    firsts = _first(headed.select("m", "head").distinct(), ["m"], [F.asc("head")], limit + 1)
    last = firsts.groupBy("m").agg(F.max(F.when(F.col("rnk") == limit + 1, F.col("head"))).alias("last"))
    kept = headed.join(last, "m").filter("last is null or head <= last").drop("head")
    return kept.join(lists, "w").select("m", "w", F.filter("ids", lambda c: F.col("last").isNull() | (c <= F.col("last"))).alias("ids"))


def neighbor_chunks(
    g: Graph, starts: DataFrame, hops: int = 2, limit: int = S.GRAPH_LIMIT, include_self: bool = False
) -> DataFrame:
    """Chunks near the entities a question names: ``(qid, chunk_id)``.

    ``starts(qid, name)``; names are matched by merge key. One branch returns the first ``limit``
    chunks (by id) mentioning entities one or two relations away (``hops=1``: the named entities
    themselves); the other returns the first ``limit`` chunks of documents the named entities are
    linked to as a whole. The union is distinct.

    Only the first ``limit`` chunks can ever be returned, so each entity contributes its first
    ``limit`` ids and each middle entity passes on a bounded list: a hub with a third of all
    relations costs its edges once and never its edges squared. Of the lists around a middle entity only ids up to
    its ``limit + 1``-th distinct first id can be among the answers, so the rest is never laid out. A walk that returns to its start over
    the one relation it came by does not count; the bounded lists keep, per middle entity, enough
    other origins to answer with any one origin left out.
    """
    named = starts.select("qid", canonical(F.col("name")).alias("s")).filter("s <> ''").distinct()
    keys = named.select("s").distinct()
    mentioned = g.mentions.select("canonical", "chunk_id")
    if hops < 2:
        mentioned = mentioned.join(keys.withColumnRenamed("s", "canonical"), "canonical", "left_semi")
    place = F.dense_rank().over(Window.partitionBy("canonical").orderBy("chunk_id"))  # repeated rows share a place
    own = cut(mentioned.withColumn("rnk", place).filter(F.col("rnk") <= limit).select("canonical", "chunk_id").distinct())

    direct = keys.join(own, keys.s == own.canonical).select("s", "chunk_id")
    if hops < 2:
        reached = direct
    else:
        pairs = stored(_pairs(g), "pairs")
        first_hop = pairs.join(keys, pairs.u == keys.s, "left_semi").select(F.col("u").alias("s"), F.col("v").alias("m"), "parallel")
        middles = first_hop.select("m").distinct()
        near = first_hop.join(own, first_hop.m == own.canonical).select("s", "chunk_id")

        lists = own.groupBy(F.col("canonical").alias("w")).agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
        second = pairs.join(middles, pairs.u == middles.m, "left_semi").select(F.col("u").alias("m"), F.col("v").alias("w"))
        via = (
            within_reach(second, lists, limit)
            .select("m", F.xxhash64("w").alias("w"), F.explode("ids").alias("chunk_id"))
            .groupBy("m", "chunk_id")
            .agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
            .select("m", "chunk_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(0)).alias("origin"))
        )
        per_origin = stored(_first(via, ["m", "origin"], [F.asc("chunk_id")], limit).drop("rnk"), "per-origin")
        heads = _first(
            per_origin.groupBy("m", "origin").agg(F.min("chunk_id").alias("head")),
            ["m"], [F.asc("head")], limit + 1,
        ).select("m", "origin")
        kept = per_origin.join(heads, ["m", "origin"], "left_semi")
        far = (
            first_hop.join(kept, "m")
            .filter((F.col("origin") != F.xxhash64("s")) | F.col("parallel"))
            .select("s", "chunk_id")
        )
        reached = near.unionByName(far)
        if include_self:
            reached = reached.unionByName(direct)

    linked = g.doc_mentions.join(keys, g.doc_mentions.canonical == keys.s).select("s", "doc_id")
    by_document = linked.join(g.chunks.select("doc_id", "chunk_id"), "doc_id").select("s", "chunk_id")

    def branch(found: DataFrame) -> DataFrame:
        per_start = _first(found.distinct(), ["s"], [F.asc("chunk_id")], limit).drop("rnk")
        asked = named.join(per_start, "s").select("qid", "chunk_id").distinct()
        return _first(asked, ["qid"], [F.asc("chunk_id")], limit).drop("rnk")

    return branch(reached).unionByName(branch(by_document)).distinct()


def all_edges(g: Graph) -> DataFrame:
    """Every edge of the graph in both directions, ``(u, v, kind)``, over prefixed node ids."""
    doc, chunk, ent, ali, img = ("D:", "C:", "E:", "A:", "I:")
    edge = lambda df, a, ap, b, bp, kind: df.select(
        F.concat(F.lit(ap), F.col(a)).alias("u"), F.concat(F.lit(bp), F.col(b)).alias("v"), F.lit(kind).alias("kind")
    )
    parts = [
        edge(g.chunks, "doc_id", doc, "chunk_id", chunk, "CONTAINS"),
        edge(g.mentions, "chunk_id", chunk, "canonical", ent, "MENTIONS"),
        edge(g.doc_mentions, "canonical", ent, "doc_id", doc, "MENTIONED_IN"),
        edge(
            g.relations.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")),
            "src", ent, "dst", ent, "RELATED_TO",
        ),
        edge(g.aliases, "name", ali, "canonical", ent, "ALIAS_OF"),
    ]
    if g.depicts is not None:
        parts.append(edge(g.depicts, "image_id", img, "canonical", ent, "DEPICTS"))
        parts.append(edge(g.images, "image_id", img, "doc_id", doc, "BELONGS_TO"))
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    one = one.distinct()
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "kind"))


def node_labels(g: Graph) -> DataFrame:
    """``(node, label, value)``: what a node is and how it is shown."""
    label = lambda df, key, p, name, value: df.select(
        F.concat(F.lit(p), F.col(key)).alias("node"), F.lit(name).alias("label"), value.alias("value")
    )
    rows = (
        label(g.documents, "doc_id", "D:", "Document", F.col("title"))
        .unionByName(label(g.chunks, "chunk_id", "C:", "Chunk", F.substring("text", 1, 2000)))
        .unionByName(label(g.entities, "canonical", "E:", "Entity", F.col("name")))
        .unionByName(label(g.aliases, "name", "A:", "Alias", F.col("name")))
    )
    if g.images is not None:
        rows = rows.unionByName(label(g.images, "image_id", "I:", "Image", F.substring("caption", 1, S.IMAGE_NAME_CHARS)))
    return rows


def explore(g: Graph, starts: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """Nodes within ``depth`` steps of an entity: ``(qid, node, depth)``, nearest first.

    ``starts(qid, name)``. A question that already has ``limit`` nodes stops growing, because deeper
    nodes rank after all of them.
    """
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    edges = all_edges(g).select("u", "v").distinct()
    origin = starts.select("qid", F.concat(F.lit("E:"), canonical(F.col("name"))).alias("node")).distinct()
    seen = cut(origin.withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        full = seen.filter("depth > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)
        front = seen.filter(F.col("depth") == level - 1).join(full, "qid", "left_anti")
        fresh = (
            front.join(edges, front.node == edges.u)
            .select("qid", F.col("v").alias("node"))
            .distinct()
            .join(seen, ["qid", "node"], "left_anti")
            .withColumn("depth", F.lit(level))
        )
        seen = cut(seen.unionByName(fresh)) if level < depth else seen.unionByName(fresh)
    return _first(seen.filter("depth > 0"), ["qid"], [F.asc("depth"), F.asc("node")], limit)


def _meet(ends: DataFrame, edges: DataFrame, max_hops: int) -> tuple[DataFrame, DataFrame]:
    """Search from both ends: ``(reached, met)``.

    ``ends(qid, side, node)`` holds a row of side ``s`` and one of side ``t`` per pair. In every round a pair takes one step, on the
    side whose outermost nodes have fewer edges, and stops where the outermost nodes of both sides meet or no node is new.
    ``reached(qid, side, node, level, degree)`` holds a node once per pair and side, ``met(qid, hops)`` the pairs with a path.
    """
    degree = stored(edges.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "degrees")
    reached = stored(ends.withColumn("level", F.lit(0)).join(degree, "node").select("qid", "side", "node", "level", "degree"), "reached")
    both = reached.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    going, met = both.select("qid"), None
    for hops in range(1, max_hops + 1):
        last = reached.groupBy("qid", "side").agg(F.max("level").alias("level"))
        outer = reached.join(last, ["qid", "side", "level"], "left_semi").join(F.broadcast(going), "qid", "left_semi")
        cost = outer.groupBy("qid", "side").agg(F.sum("degree").alias("cost"))
        turn = cost.groupBy("qid").agg(F.max_by("side", F.struct(-F.col("cost"), F.col("side"))).alias("side"))
        moving = stored(outer.join(turn, ["qid", "side"], "left_semi").select("qid", "side", "level", F.col("node").alias("at")), "moving")
        fresh = stored(
            edges.select("u", "v").join(moving, F.col("u") == F.col("at"))
            .select("qid", "side", F.col("v").alias("node"), (F.col("level") + 1).alias("level"))
            .distinct()
            .join(reached.select("qid", "side", "node"), ["qid", "side", "node"], "left_anti")
            .join(degree, "node")
            .select("qid", "side", "node", "level", "degree"),
            "reached",
        )
        other = outer.select("qid", "node", F.col("side").alias("across"))
        hit = stored(fresh.join(other, ["qid", "node"]).filter("side <> across").select("qid").distinct().withColumn("hops", F.lit(hops)), "met")
        met = hit if met is None else met.unionByName(hit)
        reached = reached.unionByName(fresh)
        going = stored(fresh.select("qid").distinct().join(hit, "qid", "left_anti"), "going")
        if going.isEmpty():
            break
    return reached, met


def _ways(reached: DataFrame, met: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """Nodes from which every step down leads to the source: ``(qid, node, level)``, level counted from the source.

    All nodes of the source's side are of that kind. On the target's side those are that lead to a node both sides have reached.
    """
    found = reached.join(met, "qid")
    ahead = found.filter("side = 's'").select("qid", "node", "level")
    behind = found.filter("side = 't'").select("qid", "node", (F.col("hops") - F.col("level")).alias("level"))
    ways = ahead
    now = stored(behind.join(ahead, ["qid", "node", "level"], "left_semi"), "ways")
    for _ in range(1, max_hops + 1):
        near = now.select("qid", F.col("node").alias("at"), (F.col("level") + 1).alias("level"))
        nearer = edges.select("u", "v").join(near, F.col("u") == F.col("at")).select("qid", F.col("v").alias("node"), "level").distinct()
        now = stored(behind.join(nearer, ["qid", "node", "level"], "left_semi"), "ways")
        if now.isEmpty():
            break
        ways = ways.unionByName(now)
    return ways


def shortest_paths(g: Graph, ends: DataFrame, max_hops: int = 6, max_paths: int = 3) -> DataFrame:
    """Shortest paths between entity pairs over any edges: ``(qid, path_no, hops, nodes, kinds)``.

    ``ends(qid, source, target)``. The search runs from both ends, see :func:`_meet`; a pair keeps nodes with their distance, not
    steps or path arrays. The walk back keeps ``max_paths`` open paths per pair, smallest node ids from the target on; every step
    leads back to the source, so cutting early returns the same paths as cutting at the end.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be 1 or more")
    edges = stored(all_edges(g), "edges")
    asked = stored(
        ends.select(
            "qid",
            F.concat(F.lit("E:"), canonical(F.col("source"))).alias("source"),
            F.concat(F.lit("E:"), canonical(F.col("target"))).alias("target"),
        ).filter("source <> target"),
        "asked",
    )
    sides = asked.select("qid", F.lit("s").alias("side"), F.col("source").alias("node")).unionByName(
        asked.select("qid", F.lit("t").alias("side"), F.col("target").alias("node"))
    )
    reached, met = _meet(sides, edges, max_hops)
    ways = _ways(reached, met, edges, max_hops).select("qid", F.col("node").alias("prev"), F.col("level").alias("to"))

    none = F.array().cast("array<string>")
    walk = asked.join(met, "qid").select(
        "qid", F.col("target").alias("at"), F.col("hops").alias("level"), F.array("target").alias("nodes"), none.alias("kinds"), "hops",
    )
    order = [F.asc("nodes"), F.asc("kinds")]
    done: DataFrame | None = None
    for _ in range(max_hops):
        grown = (
            edges.join(walk, F.col("u") == F.col("at"))
            .select("qid", F.col("v").alias("prev"), (F.col("level") - 1).alias("to"), "nodes", "kinds", "kind", "hops")
            .join(ways, ["qid", "prev", "to"])
            .select(
                "qid", F.col("prev").alias("at"), F.col("to").alias("level"), F.concat("nodes", F.array("prev")).alias("nodes"),
                F.concat("kinds", F.array("kind")).alias("kinds"), "hops",
            )
        )
        grown = stored(_first(grown, ["qid"], order, max_paths).drop("rnk"), "walk")
        ended = grown.filter("level = 0")
        done = ended if done is None else done.unionByName(ended)
        walk = grown.filter("level > 0")
        if walk.isEmpty():
            break
    return _first(done, ["qid"], order, max_paths, "path_no").select(
        "qid", "path_no", "hops", F.reverse("nodes").alias("nodes"), F.reverse("kinds").alias("kinds")
    )


def journeys(g: Graph, ends: DataFrame, max_hops: int = 8) -> DataFrame:
    """One shortest path per pair with a label, a name and the corpora of every stop.

    Outcome ``same`` for equal names, ``none`` without a path within ``max_hops``, else
    ``path``; ``stops`` is an array of (label, name, corpora), ``kinds`` the edges between them.
    """
    same = F.lower(F.trim("source")) == F.lower(F.trim("target"))
    paths = shortest_paths(g, ends.filter(~same), max_hops, 1)
    corpora = entity_corpora(g).groupBy("canonical").agg(F.array_sort(F.collect_set("corpus")).alias("corpora"))
    stops = (
        paths.select("qid", F.posexplode("nodes").alias("at", "node"))
        .join(node_labels(g), "node", "left")
        .withColumn("canonical", F.when(F.col("label") == "Entity", F.expr("substring(node, 3)")))
        .join(corpora, "canonical", "left")
        .groupBy("qid")
        .agg(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct("at", "label", F.col("value").alias("name"), F.coalesce("corpora", F.array().cast("array<string>")).alias("corpora"))
                    )
                ),
                lambda x: F.struct(x["label"].alias("label"), x["name"].alias("name"), x["corpora"].alias("corpora")),
            ).alias("stops")
        )
    )
    return (
        ends.join(paths.select("qid", "hops", "kinds"), "qid", "left")
        .join(stops, "qid", "left")
        .withColumn("outcome", F.when(same, "same").when(F.col("hops").isNull(), "none").otherwise("path"))
    )


# ── exports ─────────────────────────────────────────────────────────────────────────────────────


def _related_among(g: Graph, members: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest relation between each pair of members of the same key, ``source < target`` by name.

    Only relations with both ends among the members are grouped.
    """
    held = members.select("canonical").distinct()
    inside = g.relations.filter("src <> dst").join(held.toDF("src"), "src", "left_semi").join(held.toDF("dst"), "dst", "left_semi")
    rel = inside.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "type", "weight")
    best = rel.groupBy("a", "b").agg(F.max_by(F.struct("weight", "type"), F.struct("weight", "type")).alias("r"))
    m = members.select(*keys, "canonical", "name")
    one = best.join(m.withColumnRenamed("canonical", "a").withColumnRenamed("name", "na"), "a")
    two = one.join(m.withColumnRenamed("canonical", "b").withColumnRenamed("name", "nb"), [*keys, "b"] if keys else ["b"])
    return two.select(
        *keys, F.least("na", "nb").alias("source"), F.greatest("na", "nb").alias("target"),
        F.col("r.type").alias("label"), F.col("r.weight").alias("weight"),
        F.col("a"), F.col("b"),
    )


def _document_links(g: Graph, members: DataFrame) -> DataFrame:
    """``(doc_id, canonical, weight)`` of the members: mentions per document, 1 for document-level links."""
    held = members.select("canonical").distinct()
    return (
        g.mentions.join(held, "canonical", "left_semi").groupBy("doc_id", "canonical").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .unionByName(g.doc_mentions.join(held, "canonical", "left_semi").select("doc_id", "canonical", F.lit(1.0).alias("weight")))
    )


def vault_entities(g: Graph, node_limit: int = 150) -> DataFrame:
    """The best-connected entities of every corpus: ``(corpus, canonical, name, type, degree)``."""
    held = entity_corpora(g).join(ranked_entities(g), "canonical")
    return _first(held, ["corpus"], [F.desc("degree"), F.asc("canonical")], node_limit)


def vault_graph(g: Graph, node_limit: int = 150, edge_limit: int = 400) -> tuple[DataFrame, DataFrame]:
    """Bounded graph of every corpus at once: ``(nodes, edges)``.

    Entity relations come first, then document mentions, then image links, up to ``edge_limit``. The entities shown are stored,
    so edges meet a small table of known size before they are grouped or moved.
    """
    ents = stored(vault_entities(g, node_limit).filter("degree > 0"), "vault-entities")
    nodes = ents.select("corpus", F.col("name").alias("id"), F.lit("Entity").alias("label"), "name", "type", "degree")
    docs = g.documents.select(
        "corpus", F.col("doc_id").alias("id"), F.lit("Document").alias("label"), F.col("title").alias("name"),
        F.lit("Document").alias("type"), F.lit(1).cast("long").alias("degree"),
    )
    nodes = nodes.unionByName(docs)
    related = _first(
        _related_among(g, ents, ["corpus"]), ["corpus"], [F.desc("weight"), F.asc("source"), F.asc("target")], edge_limit
    ).select("corpus", "source", "target", F.lit("RELATED").alias("kind"), "label", F.round("weight", 3).alias("weight"), F.lit(0).alias("tier"))
    links = _document_links(g, ents).join(g.documents.select("doc_id", "corpus"), "doc_id").join(
        ents.select("corpus", "canonical", "name"), ["corpus", "canonical"]
    ).select("corpus", F.col("doc_id").alias("source"), F.col("name").alias("target"), F.lit("MENTIONS").alias("kind"), F.lit("mentions").alias("label"), "weight", F.lit(1).alias("tier"))
    edges = related.unionByName(links)
    if g.images is not None and g.depicts is not None:
        pictures = g.images.join(g.documents.select("doc_id", "corpus"), "doc_id")
        nodes = nodes.unionByName(
            pictures.select(
                "corpus", F.col("image_id").alias("id"), F.lit("Image").alias("label"),
                F.substring(F.when(F.coalesce("caption", F.lit("")) == "", "image").otherwise(F.col("caption")), 1, S.IMAGE_NAME_CHARS).alias("name"), F.lit("Image").alias("type"),
                F.lit(1).cast("long").alias("degree"),
            )
        )
        edges = edges.unionByName(
            g.depicts.join(pictures.select("image_id", "corpus"), "image_id").join(
                ents.select("corpus", "canonical", F.col("name").alias("shown")), ["corpus", "canonical"]
            ).select("corpus", F.col("image_id").alias("source"), F.col("shown").alias("target"), F.lit("DEPICTS").alias("kind"), F.lit("depicts").alias("label"), F.lit(1.0).alias("weight"), F.lit(2).alias("tier"))
        )
    edges = _first(edges, ["corpus"], [F.asc("tier"), F.desc("weight"), F.asc("source"), F.asc("target")], edge_limit)
    return nodes, edges.drop("tier", "rnk")


def corpora_sets(g: Graph) -> DataFrame:
    """Distinct corpora of each entity as a sorted array; its length is at most the number of corpora."""
    return entity_corpora(g).groupBy("canonical").agg(F.array_sort(F.collect_list("corpus")).alias("corpora"))


def library_graph(g: Graph, node_limit: int = 260, edge_limit: int = 700) -> tuple[DataFrame, DataFrame]:
    """One bounded graph over all corpora; relations between disjoint corpora are marked ``cross``."""
    top = stored(ranked_entities(g).filter("degree > 0").orderBy(F.desc("degree"), "canonical").limit(node_limit), "library-entities")
    ents = top.join(corpora_sets(g), "canonical", "left").withColumn(
        "corpora", F.coalesce("corpora", F.array().cast("array<string>"))
    )
    nodes = ents.select(F.col("name").alias("id"), F.lit("Entity").alias("label"), "name", "type", "degree", "corpora").unionByName(
        g.documents.select(
            F.col("doc_id").alias("id"), F.lit("Document").alias("label"), F.col("title").alias("name"),
            F.lit("Document").alias("type"), F.lit(1).cast("long").alias("degree"), F.array("corpus").alias("corpora"),
        )
    )
    if g.images is not None:
        held = g.images.join(g.documents.select("doc_id", "corpus"), "doc_id")
        shown = F.when(F.coalesce("caption", F.lit("")) == "", "image").otherwise(F.col("caption"))
        nodes = nodes.unionByName(held.select(
            F.col("image_id").alias("id"), F.lit("Image").alias("label"), F.substring(shown, 1, S.IMAGE_NAME_CHARS).alias("name"),
            F.lit("Image").alias("type"), F.lit(1).cast("long").alias("degree"), F.array("corpus").alias("corpora"),
        ))
    rel = _related_among(g, top, [])
    sets = ents.select("canonical", "corpora")
    flagged = (
        rel.join(sets.toDF("a", "ca"), "a").join(sets.toDF("b", "cb"), "b")
        .withColumn("cross", (F.size("ca") > 0) & (F.size("cb") > 0) & ~F.arrays_overlap("ca", "cb"))
    )
    related = flagged.orderBy(F.desc("weight"), "source", "target").limit(edge_limit).select(
        "source", "target", F.lit("RELATED").alias("kind"), "label", F.round("weight", 3).alias("weight"), "cross", F.lit(0).alias("tier")
    )
    links = _document_links(g, top).join(top.select("canonical", "name"), "canonical").select(
        F.col("doc_id").alias("source"), F.col("name").alias("target"), F.lit("MENTIONS").alias("kind"),
        F.lit("mentions").alias("label"), "weight", F.lit(False).alias("cross"), F.lit(1).alias("tier"),
    )
    edges = related.unionByName(links).orderBy("tier", F.desc("weight"), "source", "target").limit(edge_limit)
    return nodes, edges.drop("tier")


def surprises_shared(g: Graph, n: int = 8) -> DataFrame:
    """Entities living in two or more corpora, best connected first."""
    spread = entity_corpora(g).groupBy("canonical").agg(F.count(F.lit(1)).alias("n_corpora")).filter("n_corpora > 1")
    top = ranked_entities(g).join(spread, "canonical").orderBy(F.desc("degree"), "canonical").limit(n)
    return top.join(corpora_sets(g), "canonical").select("canonical", "name", "type", "degree", "corpora")


def surprises_bridge(g: Graph, n: int = 8) -> DataFrame:
    """Relations whose two ends share no corpus, heaviest first; one row per unordered pair and type."""
    docs = g.mentions.select("canonical", "corpus").distinct()
    sets = docs.groupBy("canonical").agg(F.array_sort(F.collect_list("corpus")).alias("corpora"))
    pairs = (
        g.relations.filter("src <> dst")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "type")
        .agg(F.max("weight").alias("weight"))
    )
    found = (
        pairs.join(sets.toDF("a", "ca"), "a").join(sets.toDF("b", "cb"), "b")
        .filter(~F.arrays_overlap("ca", "cb"))
        .orderBy(F.desc("weight"), "a", "b", "type").limit(n)
    )
    names = g.entities.select("canonical", "name")
    return (
        found.join(names.toDF("a", "source"), "a").join(names.toDF("b", "target"), "b")
        .select("a", "b", "source", "target", "type", "weight", F.col("ca")[0].alias("vault_a"), F.col("cb")[0].alias("vault_b"))
    )


def surprise_cards(g: Graph, limit: int = 6) -> DataFrame:
    """Shared concepts, then bridges, cut to ``limit``, with a template sentence each."""
    shared = surprises_shared(g).select(
        F.lit(0).alias("tier"), F.col("degree").cast("double").alias("strength"), F.lit("shared").alias("kind"),
        F.col("canonical").alias("key"), shared_sentence(F.col("name"), F.col("corpora")).alias("insight"),
    )
    bridge = surprises_bridge(g).select(
        F.lit(1).alias("tier"), F.col("weight").alias("strength"), F.lit("bridge").alias("kind"),
        F.concat_ws("|", "a", "b").alias("key"),
        bridge_sentence(F.col("vault_a"), F.col("source"), F.col("vault_b"), F.col("target")).alias("insight"),
    )
    return shared.unionByName(bridge).orderBy("tier", F.desc("strength"), "key").limit(max(1, int(limit))).drop("tier")


def shared_sentence(name: Column, corpora: Column) -> Column:
    return F.format_string("%s is found in each of these libraries: %s.", name, F.array_join(corpora, ", "))


def bridge_sentence(vault_a: Column, source: Column, vault_b: Column, target: Column) -> Column:
    return F.format_string(
        "In %s there is %s; it is related to what %s holds on %s.",
        F.coalesce(vault_a, F.lit("one library")), source, F.coalesce(vault_b, F.lit("a second library")), target,
    )


def journey_sentence(source: Column, target: Column, outcome: Column, names: Column) -> Column:
    """Template narration of a journey."""
    first, last = names[0], F.element_at(names, -1)
    middle = F.array_join(F.slice(names, F.lit(2), F.greatest(F.size(names) - 2, F.lit(0))), ", ")
    return (
        F.when(outcome == "same", F.lit("Both ends are one entity."))
        .when(outcome == "none", F.format_string("The graph holds no way from '%s' to '%s'.", source, target))
        .when(F.size(names) < 2, F.format_string("'%s' and '%s' name one node.", source, target))
        .when(F.size(names) == 2, F.format_string("One edge leads from '%s' to '%s'.", first, last))
        .otherwise(F.format_string("From '%s' to '%s' the shortest way passes %s.", first, last, middle))
    )


def sweep_orphans(g: Graph) -> Graph:
    """Drop what lost its document: chunks, images, then aliases without entity, then edgeless entities.

    Edges of dropped nodes go with them.
    """
    docs = g.documents.select("doc_id")
    chunks = g.chunks.join(docs, "doc_id", "left_semi")
    mentions = g.mentions.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    doc_mentions = g.doc_mentions.join(docs, "doc_id", "left_semi")
    images = depicts = None
    if g.images is not None:
        images = g.images.join(docs, "doc_id", "left_semi")
        depicts = g.depicts.join(images.select("image_id"), "image_id", "left_semi")
    aliases = g.aliases.join(g.entities.select("canonical"), "canonical", "left_semi").select("name", "canonical")
    left = replace(g, chunks=chunks, mentions=mentions, doc_mentions=doc_mentions, images=images, depicts=depicts, aliases=aliases)
    return replace(left, entities=g.entities.join(degrees(left).select("canonical"), "canonical", "left_semi"))
