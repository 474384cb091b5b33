"""Graph queries: entities, mentions, relations, neighbourhoods, paths, exports, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bookloom.operators import communities as cm
from bookloom.operators import graph_build as gb
from bookloom.operators import graph_query as gq
from bookloom.sources import sample
from bookloom.sources.library import open_sample
from bookloom.workload import query
from bookloom.workload import sql as s


def _graph(spark, folder) -> gq.Graph:
    return open_sample(spark, folder).graph


def _whole(spark, folder):
    """The library with a graph without limits."""
    return open_sample(spark, folder).limited(gb.Limits())


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query(s.with_(s.WHOLE) + "SELECT doc_id, pos, canonical, name FROM doc_entities")
def document_entities(spark, folder):
    return _long(_whole(spark, folder).doc_entities, "pos").select("doc_id", "pos", "canonical", "name")


@query(s.with_(s.ENTITIES) + """
SELECT e.canonical, e.name, e.type, (SELECT string_agg(a.name, '|' ORDER BY a.name) FROM aliases a WHERE a.canonical = e.canonical) AS aliases FROM entities e""")
def entity_canonical(spark, folder):
    lib = open_sample(spark, folder)
    spelled = lib.aliases.groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("aliases"))
    return lib.entities.join(spelled, "canonical", "left").select("canonical", "name", "type", "aliases")


@query(s.with_(s.WHOLE) + "SELECT chunk_id, canonical FROM mentions UNION ALL SELECT doc_id, canonical FROM doc_mentions")
def mentions(spark, folder):
    g = _whole(spark, folder)
    return g.mentions.select("chunk_id", "canonical").unionByName(g.doc_mentions.select(F.col("doc_id").alias("chunk_id"), "canonical"))


@query(s.with_(s.WHOLE) + "SELECT src, dst, weight, evidence FROM relations")
def cooccurrence(spark, folder):
    """Every pair of entities of a chunk."""
    return _whole(spark, folder).relations.select("src", "dst", "weight", "evidence")


@query(s.with_(s.ENTITIES) + "SELECT src, dst, weight, evidence FROM relations")
def cooccurrence_limited(spark, folder):
    """The relations of the graph built to the standard limits, on which the other graph queries work."""
    return _graph(spark, folder).relations.select("src", "dst", "weight", "evidence")


@query(s.with_(s.WHOLE) + """
SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS total, max(weight) AS heaviest FROM relations WHERE src <> dst GROUP BY ALL""")
def edge_weights(spark, folder):
    return cm.edge_totals(_whole(spark, folder).relations)


@query(s.with_(s.GRAPH) + """
SELECT 'Document' AS label, count(*) AS n FROM docs UNION ALL SELECT 'Chunk', count(*) FROM chunks UNION ALL SELECT 'Entity', count(*) FROM entities
UNION ALL SELECT 'Alias', count(*) FROM aliases UNION ALL SELECT 'Image', count(*) FROM pics""")
def graph_stats(spark, folder):
    return gq.node_counts(_graph(spark, folder)).withColumnRenamed("count", "n")


@query(s.with_(s.GRAPH) + "SELECT canonical, name, degree FROM ent ORDER BY degree DESC, canonical LIMIT 10")
def top_entities(spark, folder):
    return gq.top_entities(_graph(spark, folder)).select("canonical", "name", "degree")


@query(s.with_(s.GRAPH) + "SELECT corpus, count(*) AS entity_count FROM ent_corpora GROUP BY corpus")
def entity_counts(spark, folder):
    return gq.entity_counts(_graph(spark, folder))


@query(s.with_(s.GRAPH, s.QUESTIONS) + f"""
, needles AS (SELECT qid, lower({s.word_list('question')}[1]) AS q FROM questions)
SELECT n.qid, e.canonical, e.degree, row_number() OVER (PARTITION BY n.qid ORDER BY e.degree DESC, e.canonical) AS rnk
FROM needles n JOIN ent e ON contains(lower(e.name), n.q) OR contains(e.canonical, n.q) QUALIFY rnk <= 12""")
def entity_search(spark, folder):
    q = sample.questions(spark, folder).select("qid", F.split("question", r"\s+")[0].alias("q"))
    return _long(gq.search_entities(_graph(spark, folder), q), "rnk").select("qid", "canonical", "degree", "rnk")


@query(s.with_(s.GRAPH, s.QUESTIONS, s.NEIGHBORS) + """
, direct AS (SELECT qid, chunk_id FROM (SELECT DISTINCT st.qid, m.chunk_id FROM starts st JOIN mentions m ON m.canonical = st.s)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY chunk_id) <= 10)
SELECT qid, chunk_id FROM direct UNION SELECT qid, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS r FROM near_b QUALIFY r <= 10)""")
def direct_chunks(spark, folder):
    from bookloom.plans.retrieve import question_entities

    return gq.neighbor_chunks(_graph(spark, folder), question_entities(sample.questions(spark, folder)), hops=1)


_EDGES = """
e1 AS (SELECT 'D:' || doc_id AS u, 'C:' || chunk_id AS v, 'CONTAINS' AS kind FROM chunks
  UNION SELECT 'C:' || chunk_id, 'E:' || canonical, 'MENTIONS' FROM mentions
  UNION SELECT 'E:' || canonical, 'D:' || doc_id, 'MENTIONED_IN' FROM doc_mentions
  UNION SELECT 'E:' || src, 'E:' || dst, 'RELATED_TO' FROM relations WHERE src <> dst
  UNION SELECT 'A:' || name, 'E:' || canonical, 'ALIAS_OF' FROM aliases
  UNION SELECT 'I:' || image_id, 'E:' || canonical, 'DEPICTS' FROM depicts
  UNION SELECT 'I:' || image_id, 'D:' || doc_id, 'BELONGS_TO' FROM pics),
edges AS MATERIALIZED (SELECT u, v, kind FROM e1 UNION SELECT v, u, kind FROM e1)"""

_TOP = """
held AS MATERIALIZED (SELECT c.corpus, e.canonical, e.name, e.degree, row_number() OVER (PARTITION BY c.corpus ORDER BY e.degree DESC, e.canonical) AS rnk
  FROM ent_corpora c JOIN ent e ON e.canonical = c.canonical)"""

# The two ends of each path question: the best and the least connected entity of a corpus.
_ENDS = """
tail AS (SELECT c.corpus, e.name, row_number() OVER (PARTITION BY c.corpus ORDER BY e.degree, e.canonical) AS r FROM ent_corpora c JOIN ent e ON e.canonical = c.canonical),
pairs AS MATERIALIZED (SELECT h.corpus AS qid, h.name AS source, t.name AS target, 'E:' || h.canonical AS s_id, 'E:' || e.canonical AS t_id
  FROM held h JOIN tail t ON t.corpus = h.corpus AND t.r = 1 JOIN ent e ON e.name = t.name WHERE h.rnk = 1)"""


def _ends(g: gq.Graph) -> DataFrame:
    held = gq.entity_corpora(g).join(gq.ranked_entities(g), "canonical")
    top = gq._first(held, ["corpus"], [F.desc("degree"), F.asc("canonical")], 1).select(F.col("corpus").alias("qid"), F.col("name").alias("source"))
    low = gq._first(held, ["corpus"], [F.asc("degree"), F.asc("canonical")], 1).select(F.col("corpus").alias("qid"), F.col("name").alias("target"))
    return top.join(low, "qid")


@query(s.with_(s.GRAPH, _EDGES, _TOP, _ENDS, """
hop(qid, node, d) AS (SELECT qid, t_id, 0 FROM pairs UNION SELECT h.qid, e.v, h.d + 1 FROM hop h JOIN edges e ON e.u = h.node WHERE h.d < 2)""", recursive=True) + """
, near AS (SELECT qid, node, min(d) AS depth FROM hop GROUP BY ALL)
SELECT qid, node, depth, row_number() OVER (PARTITION BY qid ORDER BY depth, node) AS rnk FROM near WHERE depth > 0 QUALIFY rnk <= 50""")
def explore_khop(spark, folder):
    g = _graph(spark, folder)
    starts = _ends(g).select("qid", F.col("target").alias("name"))
    return _long(gq.explore(g, starts, 2, 50), "rnk", "depth").select("qid", "node", "depth", "rnk")


_BFS = ("""
hop(qid, node, d) AS (SELECT qid, s_id, 0 FROM pairs UNION SELECT h.qid, e.v, h.d + 1 FROM hop h JOIN edges e ON e.u = h.node WHERE h.d < 8)""", """
dist AS MATERIALIZED (SELECT qid, node, min(d) AS d FROM hop GROUP BY ALL)""", """
goal AS MATERIALIZED (SELECT p.qid, p.s_id, p.t_id, d.d AS hops FROM pairs p JOIN dist d ON d.qid = p.qid AND d.node = p.t_id WHERE p.s_id <> p.t_id)""", """
back(qid, node, d, trail, kinds) AS (SELECT qid, t_id, hops, [t_id], []::VARCHAR[] FROM goal UNION ALL
  SELECT b.qid, e.v, b.d - 1, list_append(b.trail, e.v), list_append(b.kinds, e.kind) FROM back b JOIN edges e ON e.u = b.node
  JOIN dist p ON p.qid = b.qid AND p.node = e.v AND p.d = b.d - 1)""")


@query(s.with_(s.GRAPH, _EDGES, _TOP, _ENDS, *_BFS, recursive=True) + """
SELECT g.qid, row_number() OVER (PARTITION BY g.qid ORDER BY b.trail, b.kinds) AS path_no, g.hops, array_to_string(list_reverse(b.trail), ' > ') AS nodes,
  array_to_string(list_reverse(b.kinds), ' > ') AS kinds FROM goal g JOIN back b ON b.qid = g.qid AND b.d = 0 WHERE g.hops <= 6 QUALIFY path_no <= 3""")
def shortest_paths(spark, folder):
    g = _graph(spark, folder)
    p = gq.shortest_paths(g, _ends(g), 6, 3)
    return _long(p, "path_no", "hops").select("qid", "path_no", "hops", F.array_join("nodes", " > ").alias("nodes"), F.array_join("kinds", " > ").alias("kinds"))


@query(s.with_(s.GRAPH, _EDGES, _TOP, _ENDS, *_BFS, """
one AS (SELECT g.qid, list_reverse(b.trail) AS t FROM goal g JOIN back b ON b.qid = g.qid AND b.d = 0 QUALIFY row_number() OVER (PARTITION BY g.qid ORDER BY b.trail, b.kinds) = 1)""", """
stop AS (SELECT o.qid, i, node, coalesce(e.name, substr(g.caption, 1, 60), CASE WHEN starts_with(node, 'A:') THEN substr(node, 3) ELSE 'doc-' || substr(node, 3) END) AS name, (SELECT string_agg(corpus, ',' ORDER BY corpus) FROM ent_corpora ec WHERE 'E:' || ec.canonical = node) AS corpora
  FROM (SELECT qid, unnest(t) AS node, generate_subscripts(t, 1) AS i FROM one) o LEFT JOIN ent e ON 'E:' || e.canonical = o.node LEFT JOIN pics g ON 'I:' || g.image_id = o.node)""", recursive=True) + """
SELECT p.qid, CASE WHEN lower(p.source) = lower(p.target) THEN 'same' WHEN max(s.i) IS NULL THEN 'none' ELSE 'path' END AS outcome,
  string_agg(CASE WHEN starts_with(s.node, 'C:') THEN 'chunk' ELSE s.name END || '=' || coalesce(s.corpora, ''), ' > ' ORDER BY s.i) AS stops
FROM pairs p LEFT JOIN stop s ON s.qid = p.qid GROUP BY p.qid, p.source, p.target""")
def journey(spark, folder):
    g = _graph(spark, folder)
    j = gq.journeys(g, _ends(g), 8)
    name = lambda x: F.when(x["label"] == "Chunk", F.lit("chunk")).otherwise(x["name"])
    stops = F.transform("stops", lambda x: F.concat(name(x), F.lit("="), F.array_join(x["corpora"], ",")))
    return j.select("qid", "outcome", F.array_join(stops, " > ").alias("stops"))


@query(s.with_(s.GRAPH, _TOP) + """
SELECT corpus, name AS id, 'Entity' AS label, name, degree FROM held WHERE rnk <= 150 AND degree > 0
UNION ALL SELECT corpus, doc_id, 'Document', title, 1 FROM docs
UNION ALL SELECT corpus, image_id, 'Image', substr(coalesce(nullif(caption, ''), 'image'), 1, 60), 1 FROM pics""")
def vault_graph_nodes(spark, folder):
    nodes, _ = gq.vault_graph(_graph(spark, folder))
    return nodes.select("corpus", "id", "label", "name", "degree")


_RELATED = """
und AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS weight FROM relations WHERE src <> dst GROUP BY ALL),
links AS MATERIALIZED (SELECT doc_id, canonical, CAST(count(*) AS DOUBLE) AS weight FROM mentions GROUP BY ALL UNION ALL SELECT doc_id, canonical, 1.0 FROM doc_mentions)"""


@query(s.with_(s.GRAPH, _TOP, _RELATED, """
k AS MATERIALIZED (SELECT * FROM held WHERE rnk <= 150 AND degree > 0),
rel AS (SELECT x.corpus, least(x.name, y.name) AS source, greatest(x.name, y.name) AS target, 'RELATED' AS kind, weight, 0 AS tier
  FROM und u JOIN k x ON x.canonical = u.a JOIN k y ON y.canonical = u.b AND y.corpus = x.corpus),
men AS (SELECT d.corpus, l.doc_id, k.name, 'MENTIONS', l.weight, 1 FROM links l JOIN docs d ON d.doc_id = l.doc_id JOIN k ON k.corpus = d.corpus AND k.canonical = l.canonical),
pic AS (SELECT p.corpus, p.image_id, k.name, 'DEPICTS', 1.0, 2 FROM depicts x JOIN pics p ON p.image_id = x.image_id JOIN k ON k.corpus = p.corpus AND k.canonical = x.canonical)""") + """
SELECT corpus, source, target, kind, weight FROM (SELECT * FROM rel UNION ALL SELECT * FROM men UNION ALL SELECT * FROM pic)
QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY tier, weight DESC, source, target) <= 400""")
def vault_graph_edges(spark, folder):
    _, edges = gq.vault_graph(_graph(spark, folder))
    return edges.select("corpus", "source", "target", "kind", "weight")


@query(s.with_(s.GRAPH) + """
, t AS (SELECT * FROM ent WHERE degree > 0 ORDER BY degree DESC, canonical LIMIT 260)
SELECT name AS id, 'Entity' AS label, degree, coalesce((SELECT string_agg(corpus, ',' ORDER BY corpus) FROM ent_corpora c WHERE c.canonical = t.canonical), '') AS corpora FROM t
UNION ALL SELECT doc_id, 'Document', 1, corpus FROM docs UNION ALL SELECT image_id, 'Image', 1, corpus FROM pics""")
def library_graph_nodes(spark, folder):
    nodes, _ = gq.library_graph(_graph(spark, folder))
    return nodes.select("id", "label", "degree", F.array_join("corpora", ",").alias("corpora"))


@query(s.with_(s.GRAPH, _RELATED, """
t AS MATERIALIZED (SELECT * FROM ent WHERE degree > 0 ORDER BY degree DESC, canonical LIMIT 260),
rel AS (SELECT least(x.name, y.name) AS source, greatest(x.name, y.name) AS target, 'RELATED' AS kind, weight,
  NOT EXISTS (SELECT 1 FROM ent_corpora p JOIN ent_corpora q ON p.corpus = q.corpus WHERE p.canonical = u.a AND q.canonical = u.b) AS crosses, 0 AS tier
  FROM und u JOIN t x ON x.canonical = u.a JOIN t y ON y.canonical = u.b),
men AS (SELECT l.doc_id, t.name, 'MENTIONS', l.weight, false, 1 FROM links l JOIN t ON t.canonical = l.canonical)""") + """
SELECT source, target, kind, weight, crosses FROM (SELECT * FROM rel UNION ALL SELECT * FROM men) ORDER BY tier, weight DESC, source, target LIMIT 700""")
def library_graph_edges(spark, folder):
    _, edges = gq.library_graph(_graph(spark, folder))
    return edges.select("source", "target", "kind", "weight", F.col("cross").alias("crosses"))


@query(s.with_(s.GRAPH) + """
SELECT canonical, name, degree, (SELECT string_agg(corpus, ',' ORDER BY corpus) FROM ent_corpora c WHERE c.canonical = e.canonical) AS corpora FROM ent e
WHERE (SELECT count(*) FROM ent_corpora c WHERE c.canonical = e.canonical) > 1 ORDER BY degree DESC, canonical LIMIT 8""")
def surprise_shared(spark, folder):
    return gq.surprises_shared(_graph(spark, folder)).select("canonical", "name", "degree", F.array_join("corpora", ",").alias("corpora"))


# Typed relations as a model would return them: each document relates its first entity to the first entity of the next document.
_TYPED = """
firsts AS (SELECT seq, canonical FROM doc_entities WHERE pos = 1),
typed AS (SELECT a.canonical AS src, b.canonical AS dst, CAST(count(*) AS DOUBLE) AS weight FROM firsts a JOIN firsts b ON b.seq = a.seq + 1 AND a.canonical <> b.canonical GROUP BY ALL)"""


def _typed_graph(spark, folder) -> gq.Graph:
    from dataclasses import replace

    lib = open_sample(spark, folder)
    f = lib.doc_entities.filter("pos = 1").join(lib.documents.select("doc_id", "seq"), "doc_id").select("seq", "doc_id", "canonical")
    nxt = f.select((F.col("seq") - 1).alias("seq"), F.col("canonical").alias("dst"))
    obs = f.join(nxt, "seq").filter("canonical <> dst").select(
        F.col("canonical").alias("src"), "dst", F.lit("FOLLOWED_BY").alias("type"), F.col("seq").alias("at"), F.col("doc_id").alias("evidence"))
    return replace(lib.graph, relations=gb.merge_relations(obs))


@query(s.with_(s.GRAPH, _TYPED, """
m AS MATERIALIZED (SELECT DISTINCT canonical, corpus FROM mentions),
p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS weight FROM typed GROUP BY ALL)""") + """
SELECT a, b, weight, (SELECT min(corpus) FROM m WHERE canonical = a) AS vault_a, (SELECT min(corpus) FROM m WHERE canonical = b) AS vault_b FROM p
WHERE EXISTS (SELECT 1 FROM m WHERE canonical = a) AND EXISTS (SELECT 1 FROM m WHERE canonical = b)
  AND NOT EXISTS (SELECT 1 FROM m x JOIN m y ON x.corpus = y.corpus WHERE x.canonical = a AND y.canonical = b) ORDER BY weight DESC, a, b LIMIT 8""")
def surprise_bridge(spark, folder):
    return gq.surprises_bridge(_typed_graph(spark, folder)).select("a", "b", "weight", "vault_a", "vault_b")


@query()
def surprise_cards(spark, folder):
    return gq.surprise_cards(_typed_graph(spark, folder), 12)


@query(s.with_(s.PASSAGES, s.IMAGES) + "SELECT image_id, canonical, name FROM depicts")
def image_entities(spark, folder):
    return open_sample(spark, folder).depicts.select("image_id", "canonical", "name")


@query(s.with_(s.PASSAGES, s.IMAGES, f"""
types(i, mime) AS (VALUES (0, 'image/png'), (1, 'image/jpeg'), (2, 'image/jpeg'), (3, 'image/webp'), (4, 'image/gif')),
unit AS (SELECT image_id, CAST({s.embedding('content')} AS DOUBLE[]) AS v FROM images)""") + """
SELECT g.image_id, doc_id, corpus, mime, md5(caption) AS caption_md5, tags, CAST(len(v) AS BIGINT) AS dims, round(v[1], 6) AS v0, round(list_sum(v), 5) AS v_sum
FROM images g JOIN types ON i = vec_id % 5 JOIN unit u ON u.image_id = g.image_id""")
def image_ingest(spark, folder):
    """Image files to rows: media type, caption and tags from the reply of the model, vector from the bytes."""
    img = open_sample(spark, folder).images
    v = F.col("vector").cast("array<double>")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return img.select("image_id", "doc_id", "corpus", "mime", F.md5("caption").alias("caption_md5"), F.array_join("tags", ",").alias("tags"),
                      F.size(v).cast("long").alias("dims"), F.round(v[0], 6).alias("v0"), F.round(total, 5).alias("v_sum"))


@query("""
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, count(*) AS n FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
WHERE e.vec_id % 17 = 0 OR (e.vec_id % 3 = 0 AND coalesce(string_split(d.text, chr(10))[1], '') = '') GROUP BY ALL""")
def image_quarantine(spark, folder):
    """Files that cannot become images are listed; all others went on."""
    return open_sample(spark, folder).image_errors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(s.with_(s.GRAPH) + """
, gone AS (SELECT doc_id FROM docs WHERE corpus IN ('src1', 'src7')),
d AS MATERIALIZED (SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM gone)),
c AS (SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM d)),
m AS MATERIALIZED (SELECT * FROM mentions WHERE doc_id IN (SELECT doc_id FROM d)),
al AS (SELECT * FROM aliases),
pi AS MATERIALIZED (SELECT * FROM pics WHERE doc_id IN (SELECT doc_id FROM d)),
dp AS MATERIALIZED (SELECT * FROM depicts WHERE image_id IN (SELECT image_id FROM pi)),
e AS (SELECT canonical FROM entities WHERE canonical IN (SELECT canonical FROM m) OR canonical IN (SELECT src FROM relations) OR canonical IN (SELECT dst FROM relations)
  OR canonical IN (SELECT canonical FROM al) OR canonical IN (SELECT canonical FROM doc_mentions WHERE doc_id IN (SELECT doc_id FROM d))
  OR canonical IN (SELECT canonical FROM dp))
SELECT 'images' AS part, count(*) AS n FROM pi UNION ALL SELECT 'depicts', count(*) FROM dp UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'mentions', count(*) FROM m UNION ALL SELECT 'aliases', count(*) FROM al UNION ALL SELECT 'entities', count(*) FROM e""")
def orphan_sweep(spark, folder):
    from dataclasses import replace

    g = _graph(spark, folder)
    left = gq.sweep_orphans(replace(g, documents=g.documents.filter(~F.col("corpus").isin("src1", "src7"))))
    out = None
    for part in ("images", "depicts", "chunks", "mentions", "aliases", "entities"):
        one = getattr(left, part).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(s.with_(s.ENTITIES) + f"""
, raw AS (SELECT DISTINCT doc_id, seq, pos, upper(name) || '.' AS name FROM doc_entities UNION SELECT doc_id, seq, pos + 500, name FROM doc_entities),
k AS (SELECT *, {s.canonical('name')} AS canonical FROM raw),
e AS (SELECT canonical, arg_min(name, seq * 1000 + pos) AS name FROM k GROUP BY canonical)
SELECT e.canonical, e.name, count(DISTINCT k.name) - 1 AS n_aliases, count(DISTINCT k.doc_id) AS n_docs FROM e JOIN k ON k.canonical = e.canonical GROUP BY ALL""")
def legacy_collapse(spark, folder):
    """Two raw spellings of every document entity collapse onto one entity."""
    lib = open_sample(spark, folder)
    d = lib.doc_entities.join(lib.documents.select("doc_id", "seq"), "doc_id")
    raw = d.select("doc_id", F.concat(F.upper("name"), F.lit(".")).alias("name"), (F.col("seq") * 1000 + F.col("pos")).alias("seq")).unionByName(
        d.select("doc_id", "name", (F.col("seq") * 1000 + F.col("pos") + 500).alias("seq")))
    edges = raw.select("doc_id", "name").distinct()
    none = spark.createDataFrame([], "src string, dst string, type string, weight double")
    out = gb.collapse_legacy(raw.select("name", F.lit("Concept").alias("type"), "seq"), edges.withColumnRenamed("doc_id", "chunk_id"), edges, none)
    n_alias = out["aliases"].groupBy("canonical").agg(F.count(F.lit(1)).alias("n_aliases"))
    n_docs = out["doc_mentions"].groupBy("canonical").agg(F.count(F.lit(1)).alias("n_docs"))
    return out["entities"].join(n_alias, "canonical", "left").join(n_docs, "canonical").select(
        "canonical", "name", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"), "n_docs")


@query(s.with_(s.ENTITIES) + f"""
, step AS (SELECT a.name AS x, b.name AS y FROM doc_entities a JOIN doc_entities b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1),
raw AS (SELECT upper(x) || '.' AS src, y AS dst FROM step UNION ALL SELECT x, upper(y) || '.' FROM step),
k AS (SELECT {s.canonical('src')} AS src, {s.canonical('dst')} AS dst FROM raw)
SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM k WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL""")
def legacy_relations(spark, folder):
    """Relations between raw spellings are re-pointed to the entities they collapse onto, and merged."""
    lib = open_sample(spark, folder)
    d = lib.doc_entities.select("doc_id", "pos", "name")
    step = d.withColumn("next", F.lead("name").over(Window.partitionBy("doc_id").orderBy("pos"))).filter("next is not null")  # positions have no gaps
    loud = lambda c: F.concat(F.upper(c), F.lit("."))
    spelled = F.array(F.struct(loud("name").alias("src"), F.col("next").alias("dst")), F.struct(F.col("name").alias("src"), loud("next").alias("dst")))
    raw = step.select(F.explode(spelled).alias("r")).select("r.src", "r.dst")
    names = d.select(F.explode(F.array(F.col("name"), loud("name"))).alias("name")).distinct().select("name", F.lit("Concept").alias("type"), F.lit(0).alias("seq"))
    none = d.limit(0).select("doc_id", "name")
    edges = raw.select("src", "dst", F.lit("RELATED_TO").alias("type"), F.lit(1.0).alias("weight"))
    return gb.collapse_legacy(names, none, none, edges)["relations"].select("src", "dst", "weight")


# ── communities ─────────────────────────────────────────────────────────────────────────────────


# Label propagation written out by rounds: every row of the recursion is a node's label in a round.
_LPA = ("""
und AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM relations WHERE src <> dst GROUP BY ALL),
links AS MATERIALIZED (SELECT a AS u, b AS v, w FROM und UNION ALL SELECT b, a, w FROM und)""", """
st(r, node, label) AS (
  SELECT 0, canonical, canonical FROM entities
  UNION ALL (
    WITH votes AS (SELECT u, label, sum(w) AS w FROM (SELECT l.u, s.label, l.w FROM links l JOIN st s ON s.node = l.v UNION ALL SELECT node, label, 1.0 FROM st) GROUP BY ALL),
    best AS (SELECT u, label AS best FROM votes QUALIFY row_number() OVER (PARTITION BY u ORDER BY w DESC, label) = 1),
    wish AS (SELECT s.r, s.node, s.label, b.best FROM st s JOIN best b ON b.u = s.node),
    held AS (SELECT DISTINCT l.u FROM links l JOIN wish x ON x.node = l.u JOIN wish y ON y.node = l.v
      WHERE l.v < l.u AND x.best <> x.label AND y.best <> y.label AND (y.best = x.label OR x.best = y.label))
    SELECT r + 1, node, CASE WHEN node IN (SELECT u FROM held) THEN label ELSE best END FROM wish WHERE EXISTS (SELECT 1 FROM wish WHERE best <> label)))""", """
settled AS MATERIALIZED (SELECT node, label FROM st WHERE r = (SELECT max(r) FROM st)),
lpa AS MATERIALIZED (SELECT s.node, 'c' || (h.k - 1) AS cid FROM settled s
  JOIN (SELECT label, row_number() OVER (ORDER BY min(node)) AS k FROM settled GROUP BY label) h ON h.label = s.label),
lpa_degree AS (SELECT u AS node, count(*) AS degree FROM links GROUP BY u),
lpa_ranks AS MATERIALIZED (SELECT l.node, l.cid, coalesce(d.degree, 0) AS degree, row_number() OVER (PARTITION BY l.cid ORDER BY coalesce(d.degree, 0) DESC, l.node) AS rnk
  FROM lpa l LEFT JOIN lpa_degree d ON d.node = l.node)""")


@query(s.with_(s.ENTITIES, *_LPA, recursive=True) + "SELECT node, cid, degree, rnk FROM lpa_ranks")
def lpa_communities(spark, folder):
    return _long(cm.detect(_graph(spark, folder)), "rnk").select("node", "cid", "degree", "rnk")


@query()
def modularity_communities(spark, folder):
    g = _graph(spark, folder)
    return cm.louvain(g.entities.select(F.col("canonical").alias("node")), cm.edge_weights(g.relations, "max"), levels=1)


# Communities that SQL can state: an entity belongs to its first corpus.
_HOME = """
home AS MATERIALIZED (SELECT canonical AS node, min(corpus) AS cid FROM ent_corpora GROUP BY canonical),
und AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM relations WHERE src <> dst),
nbr AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM und UNION ALL SELECT b FROM und) GROUP BY node),
ranks AS MATERIALIZED (SELECT h.cid, h.node, coalesce(n.degree, 0) AS degree, row_number() OVER (PARTITION BY cid ORDER BY coalesce(n.degree, 0) DESC, h.node) AS rnk
  FROM home h LEFT JOIN nbr n ON n.node = h.node)"""


def _home(g: gq.Graph) -> DataFrame:
    return gq.entity_corpora(g).groupBy(F.col("canonical").alias("node")).agg(F.min("corpus").alias("cid"))


def _home_ranks(g: gq.Graph) -> DataFrame:
    return cm.community_ranks(_home(g), cm.edge_weights(g.relations))


@query(s.with_(s.GRAPH, _HOME) + "SELECT cid, node, degree, rnk FROM ranks")
def community_rank(spark, folder):
    return _home_ranks(_graph(spark, folder)).select("cid", "node", "degree", "rnk")


@query(s.with_(s.GRAPH, _HOME) + """
SELECT cid, count(*) AS entity_count, sha256(count(*) || ':' || bit_xor(h) || ':' || sum(h)) AS members_hash
FROM (SELECT cid, CAST('0x' || substr(md5(node), 1, 15) AS BIGINT) AS h FROM home) GROUP BY cid""")
def members_hash(spark, folder):
    return cm.members_hash(_home(_graph(spark, folder)))


@query(s.with_(s.GRAPH, _HOME) + f"""
, hd AS (SELECT cid, node FROM ranks WHERE rnk <= 3)
SELECT h.cid, row_number() OVER (PARTITION BY h.cid ORDER BY h.node, m.chunk_index, m.chunk_id) AS n, h.node AS canonical, m.chunk_id,
  substr(trim(c.text), 1, 220) AS snippet FROM hd h JOIN mentions m ON m.canonical = h.node JOIN chunks c ON c.chunk_id = m.chunk_id
QUALIFY n <= 3 * (SELECT count(*) FROM hd x WHERE x.cid = h.cid)""")
def evidence_snippets(spark, folder):
    g = _graph(spark, folder)
    return _long(cm.evidence_snippets(_home_ranks(g), g.mentions, g.chunks), "n")
