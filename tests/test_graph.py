import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bookloom.operators import communities as cm
from bookloom.operators import graph_build as gb
from bookloom.operators import graph_query as gq


def graph(spark, relations, mentions=(), doc_mentions=(), docs=(("d1", "T", "x"),), names=()):
    rel = spark.createDataFrame([(a, b, "RELATED_TO", float(w), "e") for a, b, w in relations], "src string, dst string, type string, weight double, evidence string")
    nodes = sorted({n for r in relations for n in r[:2]} | {m[1] for m in mentions} | {m[1] for m in doc_mentions} | set(names))
    ents = spark.createDataFrame([(n, n.title(), "Concept") for n in nodes], "canonical string, name string, type string")
    d = spark.createDataFrame(list(docs), "doc_id string, title string, corpus string")
    m = spark.createDataFrame([(c, c.split("#")[0], e) for c, e in mentions], "chunk_id string, doc_id string, canonical string").join(d.select("doc_id", "corpus"), "doc_id", "left")
    chunks = m.select("chunk_id", "doc_id", "corpus").distinct().withColumn("chunk_index", F.lit(0)).withColumn("text", F.col("chunk_id"))
    return gq.Graph(d, chunks, ents, spark.createDataFrame([], "name string, canonical string"), m,
                    spark.createDataFrame([(a, b) for a, b in doc_mentions], "doc_id string, canonical string"), rel)


def test_entity_merge_and_aliases(spark):
    e = spark.createDataFrame([("d1", 1, "neo4j", "Neo4j", None), ("d2", 1, "neo4j", "neo4j", "Tech"), ("d2", 2, "neo4j", "NEO4J", "X")], "doc_id string, pos int, canonical string, name string, type string")
    docs = spark.createDataFrame([("d1", 1), ("d2", 2)], "doc_id string, seq long")
    ents = gb.merge_entities(e, docs)
    assert ents.collect()[0].asDict() == {"canonical": "neo4j", "name": "Neo4j", "type": "Tech"}
    assert {r.name for r in gb.alias_names(e, ents).collect()} == {"neo4j", "NEO4J"}


def test_library_graph(spark, tiny):
    g = tiny.graph
    assert {"gandhi", "nehru", "delhi", "patel"} <= {r.canonical for r in g.entities.collect()}
    shared = {r.canonical: r.corpora for r in gq.surprises_shared(g).collect()}
    assert shared["patel"] == ["past", "tech"] and shared["delhi"] == ["past", "tech"]
    ends = spark.createDataFrame([("1", "Gandhi", "Bose"), ("2", "Gandhi", "gandhi "), ("3", "Gandhi", "Nobody")], "qid string, source string, target string")
    j = {r.qid: r for r in gq.journeys(g, ends).collect()}
    assert j["1"].outcome == "path" and [s.name for s in j["1"].stops][0] == "Gandhi" and j["1"].stops[-1].name == "Bose"
    assert j["2"].outcome == "same" and j["3"].outcome == "none"
    found = gq.search_entities(g, spark.createDataFrame([("a", "NEHR"), ("b", " "), ("c", "zz"), ("d", "e")], "qid string, q string")).collect()
    assert {r.canonical for r in found if r.qid == "a"} == {"nehru"} and not [r for r in found if r.qid in "bc"]
    assert {r.canonical for r in found if r.qid == "d"} >= {"nehru", "delhi", "patel"}
    nodes, edges = gq.vault_graph(g)
    assert {r.label for r in nodes.collect()} == {"Entity", "Document"} and {r.kind for r in edges.collect()} == {"RELATED", "MENTIONS"}


def test_direct_chunks_build_no_other_table(spark, tiny):
    from bookloom.sources.library import Library

    lib = Library(spark, tiny.uploaded)
    asked = spark.createDataFrame([("1", "Patel")], "qid string, name string")
    found = gq.neighbor_chunks(lib.graph, asked, hops=1)
    assert {r.chunk_id for r in found.collect()} == {"d2#000000", "d3#000000"}
    assert set(lib._store._paths) == {"documents", "passages", "doc_entities", "chunk_entities", "doc_mentions"}
    assert "embedding" not in lib.passages.columns
    same = {r.item_id: r.vector for r in lib.items.collect()}
    assert {r.chunk_id: r.embedding for r in lib.chunks.collect()} == same and len(same[next(iter(same))]) == 64


def test_lists_are_laid_out_as_far_as_they_can_count(spark):
    edges = spark.createDataFrame([("m", f"w{i:02d}") for i in range(30)] + [("few", "w29")], "m string, w string")
    lists = spark.createDataFrame([(f"w{i:02d}", [f"{i // 2:02d}", f"{i // 2:02d}x", f"{i + 20}"]) for i in range(30)], "w string, ids array<string>")
    got = {(r.m, r.w): r.ids for r in gq.within_reach(edges, lists, 2).collect()}
    assert got == {("few", "w29"): ["14", "14x", "49"]} | {
        ("m", f"w{i:02d}"): [x for x in (f"{i // 2:02d}", f"{i // 2:02d}x") if x <= "02"] for i in range(6)}


def test_legacy_relations_join_names_only(spark):
    from bookloom.workload.graph import legacy_relations

    df = legacy_relations(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().analyzed().toString().count("Join Inner") == 2  # either end with its name; steps need no join
    assert df.count() == df.select("src", "dst").distinct().count() > 0


def test_repeated_mentions_share_a_place(spark):
    g = graph(spark, [], [(f"d1#{i:02d}", "x") for i in range(12) for _ in range(5)])
    asked = spark.createDataFrame([("1", "X")], "qid string, name string")
    assert sorted(r.chunk_id for r in gq.neighbor_chunks(g, asked, hops=1).collect()) == [f"d1#{i:02d}" for i in range(10)]


def test_model_extracts(spark):
    reply = spark.createDataFrame(
        [("d", 0, [("Neo4j", "Tech"), ("neo4j.", "Other"), (" ", "X"), ("Bolt", None)], [("Neo4j", "Bolt", "USES"), ("Neo4j", "neo4j", "SELF"), ("Neo4j", "Lost", "X")])],
        "doc_id string, window_no int, entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,type:string>>")
    ents, rels = gb.model_extracts(reply)
    merged = gb.merge_extracts(ents)
    assert {(r.canonical, r.name, r.type) for r in merged.collect()} == {("neo4j", "Neo4j", "Tech"), ("bolt", "Bolt", "Concept")}
    typed = gb.merge_typed_relations(rels, merged).collect()
    assert [(r.src, r.dst, r.type) for r in typed] == [("neo4j", "bolt", "USES")]


def test_neighbor_chunks_match_brute_force(spark):
    rng = random.Random(3)
    names = [f"e{i:02d}" for i in range(14)]
    for trial in range(3):
        rel = {(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(16)) if a != b}
        men = {(f"d1#{rng.randint(0, 60):03d}", rng.choice(names)) for _ in range(45)} | {(f"d1#9{i:02d}", "e00") for i in range(15)} | {(f"d1#0{i:02d}", "e01") for i in range(12)}
        g = graph(spark, [(a, b, 1) for a, b in rel], sorted(men), names=names)
        got = defaultdict(set)
        for r in gq.neighbor_chunks(g, spark.createDataFrame([(n, n) for n in names], "qid string, name string"), limit=4).collect():
            got[r.qid].add(r.chunk_id)
        arcs = [(i, a, b) for i, (a, b) in enumerate(sorted(rel))]
        arcs += [(i, b, a) for i, a, b in arcs]
        for s in names:
            reach = {b for _, a, b in arcs if a == s} | {b2 for i, a, b in arcs if a == s for j, a2, b2 in arcs if a2 == b and j != i}
            assert got[s] == set(sorted({c for c, e in men if e in reach})[:4]), (trial, s)


def test_shortest_paths_match_breadth_first_search(spark):
    rng = random.Random(9)
    names = [f"n{i}" for i in range(16)]
    rel = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(22)})
    g = graph(spark, [(a, b, 1) for a, b in rel], names=names)
    around = defaultdict(set)
    for a, b in rel:
        around[a].add(b)
        around[b].add(a)

    def paths(s, t):
        level, seen = [[s]], {s}
        while level:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            level = [p + [v] for p in level for v in sorted(around[p[-1]]) if v not in seen]
            seen |= {p[-1] for p in level}
        return []

    ends = [(f"{a}-{b}", a, b) for a, b in (("n0", "n5"), ("n1", "n9"), ("n2", "n14"), ("n3", "n15"))]
    got = gq.shortest_paths(g, spark.createDataFrame(ends, "qid string, source string, target string"), 6, 2).collect()
    for qid, a, b in ends:
        want = sorted((list(reversed(p)) for p in paths(a, b) if len(p) <= 7))[:2]
        have = [[n[2:] for n in reversed(r.nodes)] for r in sorted(got, key=lambda r: r.path_no) if r.qid == qid]
        assert have == want, qid


def test_path_search_leaves_the_rest_of_the_graph_alone(spark):
    """From the end with few edges the way is short; neither the hub's neighbours nor what lies behind them is walked through."""
    far = [("hub", f"a{i:03d}", 1) for i in range(60)] + [(f"a{i:03d}", f"b{i:03d}{j}", 1) for i in range(60) for j in range(3)]
    g = graph(spark, [("t", "m", 1), ("m", "hub", 1), *far])
    ends = spark.createDataFrame([("q", "hub", "t"), ("none", "hub", "gone")], "qid string, source string, target string")
    assert [(r.qid, r.nodes, r.kinds) for r in gq.shortest_paths(g, ends, 6, 3).collect()] == [("q", ["E:hub", "E:m", "E:t"], ["RELATED_TO"] * 2)]
    sides = spark.createDataFrame([("q", "s", "E:hub"), ("q", "t", "E:t")], "qid string, side string, node string")
    reached, met = gq._meet(sides, gq.all_edges(g), 6)
    assert reached.count() == 4 and [r.hops for r in met.collect()] == [2]


def test_chunk_relations_combine_in_hash_aggregates(spark, capsys):
    """Pairs are combined without sorting them, to the rows of the general merge; a later document never gives the evidence."""
    rng = random.Random(11)
    names = [f"e{i}" for i in range(7)]
    rows = [(f"d{s}#{c:06d}", f"d{s}", s, "x", c, [(p, n) for p, n in enumerate(sorted(rng.sample(names, 4), key=lambda n: rng.random()))])
            for s in (2**62, 3, 17) for c in range(4)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, seq long, corpus string, chunk_index int, mentioned array<struct<pos:int,canonical:string>>")
    for limit in (None, 3):
        got = gb.chunk_relations(chunks, limit)
        want = gb.merge_relations(gb.cooccurrences(chunks, limit))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    capsys.readouterr()
    got.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_edge_totals_group_once(spark, capsys):
    r = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 5.0), ("a", "a", 9.0), ("c", "b", 1.0)], "src string, dst string, weight double")
    assert {(x.a, x.b): (x.total, x.heaviest) for x in cm.edge_totals(r).collect()} == {("a", "b"): (7.0, 5.0), ("b", "c"): (1.0, 1.0)}
    capsys.readouterr()
    cm.edge_totals(r).explain()
    assert capsys.readouterr().out.count("Exchange hash") == 1


def random_graph(spark, seed, n=40, m=70):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(n)]
    weight = {tuple(sorted(rng.sample(nodes, 2))): float(rng.randint(1, 4)) for _ in range(m)}
    edges = [(a, b, w) for (a, b), w in weight.items()]
    return nodes, edges, spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(edges, "a string, b string, weight double")


@pytest.mark.parametrize("seed", [4, 5])
def test_label_propagation_ends_where_no_node_wants_to_move(spark, seed):
    nodes, edges, n, e = random_graph(spark, seed)
    label = {r.node: r.label for r in cm.label_propagation(n, e).collect()}
    comp = {r.node: r.comp for r in cm.components(n, e).collect()}
    assert set(label) == set(nodes) and all(comp[x] == comp[label[x]] for x in nodes)
    for x in nodes:
        votes = defaultdict(float, {label[x]: 1.0})
        for a, b, w in edges:
            if x in (a, b):
                votes[label[b if x == a else a]] += w
        assert min(votes, key=lambda k: (-votes[k], k)) == label[x]
    again = {r.node: r.label for r in cm.label_propagation(n.repartition(3), e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight").repartition(5)).collect()}
    assert again == label


def test_rounds_are_stored_as_columns(spark, monkeypatch):
    """Label propagation and ranks write no checkpoint: rows go to compressed files."""
    def refused(*args, **kwargs):
        raise AssertionError("checkpoint")

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", refused)
    n = spark.createDataFrame([(f"x{i}",) for i in range(4)], "node string")
    e = spark.createDataFrame([("x0", "x1", 1.0), ("x2", "x3", 1.0)], "a string, b string, weight double")
    got = {r.node: r.cid for r in cm.compact_ids(cm.label_propagation(n, e)).collect()}
    assert got == {"x0": "c0", "x1": "c0", "x2": "c1", "x3": "c1"}


def test_chains_stay_together(spark):
    n = spark.createDataFrame([(f"x{i}",) for i in range(6)], "node string")
    e = spark.createDataFrame([("x0", "x1", 1.0), ("x1", "x2", 1.0), ("x3", "x4", 1.0)], "a string, b string, weight double")
    got = {r.node: r.cid for r in cm.compact_ids(cm.label_propagation(n, e)).collect()}
    assert got == {"x0": "c0", "x1": "c0", "x2": "c0", "x3": "c1", "x4": "c1", "x5": "c2"}


def test_rounds_on_a_chain_in_name_order(spark, monkeypatch):
    """The dearest case: each node waits for the one before, so rounds follow the length of such a chain. They are not capped."""
    cuts = []
    monkeypatch.setattr(cm, "cut", lambda df, real=cm.cut: cuts.append(1) or real(df))
    n = spark.createDataFrame([(f"x{i:02d}",) for i in range(12)], "node string")
    e = spark.createDataFrame([(f"x{i:02d}", f"x{i + 1:02d}", 1.0) for i in range(11)], "a string, b string, weight double")
    assert {r.label for r in cm.label_propagation(n, e).collect()} == {"x00"}
    assert len(cuts) <= 14


def test_modularity_splits_two_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 1.0)]
    n = spark.createDataFrame([(f"{g}{i}",) for g in "ab" for i in range(5)], "node string")
    got = {r.node: r.label for r in cm.louvain(n, spark.createDataFrame(edges, "a string, b string, weight double"), levels=2).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]


def test_summaries_follow_members(spark):
    a = spark.createDataFrame([("c0", "x"), ("c0", "y"), ("c1", "z")], "cid string, node string")
    h = cm.members_hash(a)
    prev = h.select("cid", "members_hash", F.lit("kept").alias("summary")).filter("cid = 'c0'")
    renamed = cm.members_hash(a.replace({"c0": "c5"}, subset=["cid"]))
    got = {r.cid: (r.summary, r.stale) for r in cm.carry_summaries(renamed, prev).collect()}
    assert got == {"c5": ("kept", False), "c1": (None, True)}


def test_contradiction_edges_are_undirected(spark):
    known = gb.add_contradictions(spark.createDataFrame([("b", "a")], "a string, b string"), spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string"))
    assert known.count() == 2
    pairs = spark.createDataFrame([("b", "a"), ("a", "c")], "a string, b string")
    assert {(r.a, r.b): r.known for r in gb.known_contradiction(pairs, known).collect()} == {("b", "a"): True, ("a", "c"): False}




def _joined(plan):
    """Column names of all joins of a plan."""
    below = [n for i in range(plan.children().size()) for n in _joined(plan.children().apply(i))]
    own = [{plan.output().apply(i).name() for i in range(plan.output().size())}] if plan.nodeName() == "Join" else []
    return own + below


def test_image_files_meet_first_lines_only(spark, tmp_path):
    from bookloom.sources import sample

    texts = [(17, "void", "src1", "en"), (18, "Old Bridge\nbody", "src1", "en"), (19, "\nbody", "src2", None), (20, None, "src2", "de"), (21, 'One "line"', "src1", "fr")]
    spark.createDataFrame(texts, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n,) for n in (17, 18, 19, 20, 21, 99)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    files = sample.image_files(spark, str(tmp_path))
    assert {r.doc_id: r.content.decode() for r in files.collect()} == {
        "17": "", "18": "Old Bridge", "19": '{"caption": "", "tags": ["", "t4"]}', "20": '{"caption": "", "tags": ["de", "t0"]}', "21": 'One "line"',
    }
    joins = _joined(files._jdf.queryExecution().optimizedPlan())
    assert joins and all("text" not in names for names in joins)


def test_vault_edges_group_members_only(spark):
    """Relations of entities that are not shown do not reach the grouping."""
    shown = [("a", "b", 3), ("b", "a", 5), ("a", "c", 1)]
    tail = [("c", f"t{i}", 1) for i in range(40)]
    g = graph(spark, shown + tail, [("d1#0", n) for n in "aabbc"] + [("d1#0", f"t{i}") for i in range(40)])
    members = spark.createDataFrame([("x", n, n.upper()) for n in "abc"], "corpus string, canonical string, name string")
    related = gq._related_among(g, members, ["corpus"])
    assert {(r.source, r.target, r.weight) for r in related.collect()} == {("A", "B", 5.0), ("A", "C", 1.0)}
    links = {r.canonical: r.weight for r in gq._document_links(g, members).collect()}
    assert links == {"a": 2.0, "b": 2.0, "c": 1.0}
    _, edges = gq.vault_graph(g, node_limit=3)
    assert {(r.source, r.target, r.weight) for r in edges.filter("kind = 'RELATED'").collect()} == {("A", "B", 5.0), ("A", "C", 1.0)}
