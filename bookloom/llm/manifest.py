"""A Merkle manifest of a table: one digest per row, per source and for the whole, with a proof for every row.

``H`` of some values is the lower-case hex SHA-256 of the values put together; a value is ``-`` if null, else its UTF-8 byte
count, ``:`` and the value. A leaf is ``H`` of the row's fields; a node is the SHA-256 of its children's digests as hex text.

Leaves get their place in their source, written as digits to base three. A block holds the 3^7 leaves that agree in all higher
digits. Within it the lower digits are grouped away one after the other: each ``groupBy`` drops the lowest digit left and nests
its rows as an array of child structs, so seven groupings, which share the one shuffle by block, leave one row per block: its
digest and all its leaves in nested structs. Blocks are the leaves of the next tier, until each tree has one node. On the way
down a tier hands every block its siblings from above through the same ``groupBy``; each level of the nested struct is then a
``transform`` that adds the siblings to its children and flattens them, and an ``explode`` at the end emits the leaves with
their proofs. No step joins proofs, and no row holds more than one block: a source with a third of all rows is many blocks.
The subroots in order of their source make one more tree of the same kind.

Defined results: equal rows, and a repeated or null ``doc_id``, are leaves of their own; null ids come first, equal ids go in the
order of their leaf digests; a null source is a source of its own and differs from an empty one; very long texts are hashed
whole; an empty table gives no row; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bookloom.session import cut, ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
LEVELS = 7  # of a block: at most 3^7 = 2,187 leaves, some 0.5 MB
STEPS = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*values: Column) -> Column:
    """``H`` of the values of a row."""
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def source_key(source: Column) -> Column:
    """Sorts bytewise, null first, and is never null."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def folded(leaf: Column, steps: Column) -> Column:
    """The digest above ``leaf`` that the siblings of ``steps`` lead to, lowest level first."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def proof(steps: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda s: F.concat(s["left"], s["right"]))).cast("binary"), 256)


def _child(level: int) -> str:
    return "kids" if level else "leaf"


def rolled(nodes: DataFrame) -> DataFrame:
    """``tree, place, digest, nested`` of each block of ``nodes (tree, place, digest, leaf)``.

    ``place`` counts the nodes of a tree from 0. ``nested`` is an array over the children with their digests, in which each
    child holds its own children, down to the ``leaf`` of a node. The one node of a level, if it stands alone in its tree,
    goes up as it is.
    """
    digit = [F.expr(f"int(pmod(place div {FAN**i}, {FAN}))").alias(f"d{i}") for i in range(LEVELS)]
    rows = nodes.select("tree", F.expr(f"place div {FAN**LEVELS}").alias("block"), *digit, "digest", F.col("leaf").alias(_child(0)))
    rows = rows.repartition("tree", "block")
    for level in range(LEVELS):
        higher = [f"d{i}" for i in range(level + 1, LEVELS)]
        child = F.struct(F.col(f"d{level}").alias("at"), F.col("digest"), F.col(_child(level)).alias("below"))
        up = F.concat_ws("", F.transform("kids", lambda c: c["digest"]))
        # the first run of a tree is full unless it holds all nodes of its level
        alone = reduce(lambda x, y: x & y, [F.col(c) == 0 for c in ("block", *higher)]) & (F.size("kids") == 1)
        rows = rows.groupBy("tree", "block", *higher).agg(F.array_sort(F.collect_list(child)).alias("kids")).select(
            "tree", "block", *higher, F.when(alone, F.col("kids")[0]["digest"]).otherwise(F.sha2(up.cast("binary"), 256)).alias("digest"), "kids",
        )
    return rows.select("tree", F.col("block").alias("place"), "digest", F.col("kids").alias("nested"))


def _steps_below(kids: Column, above: Column) -> Column:
    """The children with the steps from each to the root: its siblings, then ``above``."""

    def one(child, i):
        left = F.concat_ws("", F.transform(F.filter(kids, lambda o: o["at"] < child["at"]), lambda o: o["digest"]))
        right = F.concat_ws("", F.transform(F.filter(kids, lambda o: o["at"] > child["at"]), lambda o: o["digest"]))
        return F.struct(child["below"].alias("below"), F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), above).alias("steps"))

    return F.transform(kids, one)


def unrolled(blocks: DataFrame) -> DataFrame:
    """``tree, tops, leaf, steps`` of every leaf of ``blocks (tree, place, nested, steps, tops)``."""
    # a step without siblings belongs to the one node of its level, which goes up as it is, or to a run of one, which is hashed
    rows, open_nodes = blocks, F.array(F.struct(F.col("nested").alias("below"), "steps", F.col("place").alias("run")))
    for _ in range(LEVELS):
        def down(node):
            first = (node["run"] == 0) & (F.size(node["below"]) == 1)
            child = node["below"][0]
            kids = F.transform(_steps_below(node["below"], node["steps"]), lambda c, i: F.struct(c["below"], c["steps"], (node["run"] * FAN + i).alias("run")))
            lone = F.array(F.struct(child["below"].alias("below"), node["steps"].alias("steps"), (node["run"] * FAN).alias("run")))
            return F.when(first, lone).otherwise(kids)

        rows = rows.withColumn("open", F.flatten(F.transform(open_nodes, down)))
        open_nodes = F.col("open")
    return rows.select("tree", "tops", F.explode("open").alias("n")).select("tree", "tops", F.col("n.below").alias("leaf"), F.col("n.steps").alias("steps"))


def climbed(nodes: DataFrame, over: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``tree, tops, leaf, steps`` of ``nodes (tree, place, digest, leaf)``: the siblings of each node on the way to its root, lowest
    level first. ``over`` continues above the trees: from ``tree, digest`` of each it gives ``tree, steps, tops``."""
    blocks = cut(rolled(nodes))
    if blocks.filter("place > 0").isEmpty():
        above = over(blocks.select("tree", "digest")).withColumn("place", F.lit(0).cast("long"))
    else:
        above = climbed(blocks.select("tree", "place", "digest", F.col("place").alias("leaf")), over).withColumnRenamed("leaf", "place")
    # one row per block from below, one from above
    nested = blocks.schema["nested"].dataType
    from_above = above.select("tree", "place", "steps", "tops", F.lit(None).cast(nested).alias("nested"))
    from_below = blocks.select("tree", "place", F.lit(None).cast(STEPS).alias("steps"), F.lit(None).cast("array<string>").alias("tops"), "nested")
    met = from_above.unionByName(from_below).groupBy("tree", "place").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("steps", "tops", "nested")])
    return unrolled(met)


def _root(tops: DataFrame) -> DataFrame:
    return tops.select("tree", F.array().cast(STEPS).alias("steps"), F.array("digest").alias("tops"))


def _over_sources(subroots: DataFrame) -> DataFrame:
    """One tree over the subroots: ``tops`` holds the subroot and the root."""
    order = ranked(subroots.withColumn("one", F.lit("")), ["one"], [F.col("tree")], "place")
    nodes = order.select(F.lit("").alias("tree"), (F.col("place") - 1).alias("place"), "digest", F.struct("tree", "digest").alias("leaf"))
    return climbed(nodes, _root).select(
        F.col("leaf.tree").alias("tree"), "steps", F.concat(F.array("leaf.digest"), F.col("tops")).alias("tops"),
    )


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row.

    ``tampered`` is the text as found later; the root is folded anew from it with the original siblings. Without it the
    originals are checked.
    """
    found = F.col("text") if tampered is None else tampered
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("tree"), digest(*[F.col(c) for c in FIELDS]).alias("digest"),
        F.when(~found.eqNullSafe(F.col("text")), digest(*[F.col(c) for c in FIELDS[:-1]], found)).alias("found"),
        F.monotonically_increasing_id().alias("row"),  # deals equal rows to many tasks
    )
    placed = ranked(leaves, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row")], "place")
    proved = climbed(
        placed.select("tree", (F.col("place") - 1).alias("place"), "digest", F.struct("doc_id", "digest", "found").alias("leaf")), _over_sources,
    )
    return proved.select(
        F.col("leaf.doc_id").alias("doc_id"), F.col("leaf.digest").alias("leaf"), F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"),
        proof(F.col("steps")).alias("proof_sha256"), folded(F.coalesce("leaf.found", "leaf.digest"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# The same by one recursive step per level, and each proof gathered from all levels. CRC-32 is spelled out bit by bit.
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"
_LEAF = f"sha256(concat({', '.join(_FIELD.format(c) for c in FIELDS)}))"
_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BITS}), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"


def _tree(name: str, leaves: str) -> str:
    """CTEs: all nodes of the trees over ``leaves (tree, place, digest)``, and the siblings of each place of a level."""
    return f"""{name}_nodes AS (SELECT tree, 0 AS level, place, digest, 1 AS last, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL SELECT tree, level + 1, place // {FAN}, sha256(string_agg(digest, '' ORDER BY place)), 1, CAST(ceil(any_value(n) / {FAN}.0) AS BIGINT)
  FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, place // {FAN}),
{name}_steps AS MATERIALIZED (SELECT a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS r
  FROM {name}_nodes a JOIN {name}_nodes b ON a.tree = b.tree AND a.level = b.level AND a.place // {FAN} = b.place // {FAN} WHERE a.n > 1 GROUP BY ALL),
{name}_top AS MATERIALIZED (SELECT tree, digest AS top FROM {name}_nodes WHERE n = 1)"""


def _fold(name: str, start: str) -> str:
    """CTEs: siblings and the digest folded from ``start (id, tree, place, cur, path)``."""
    return f"""{name}_walk AS (SELECT id, tree, place, 0 AS level, cur, path FROM {start}
  UNION ALL SELECT w.id, w.tree, w.place // {FAN}, w.level + 1, sha256(concat(s.l, cur, s.r)), concat(path, s.l, s.r)
  FROM {name}_walk w JOIN {name}_steps s ON w.tree = s.tree AND w.level = s.level AND w.place = s.place),
{name}_end AS MATERIALIZED (SELECT id, arg_max(cur, level) AS cur, arg_max(path, level) AS path FROM {name}_walk GROUP BY id)"""


ORACLE = f"""
WITH RECURSIVE rows AS MATERIALIZED (SELECT row_number() OVER () AS id, CASE WHEN source IS NULL THEN '' ELSE concat('=', source) END AS tree, doc_id, {_LEAF} AS digest,
  CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.replace(_FIELD.format('text'), _FIELD.format("replace(text, chr(10), '')"))} ELSE {_LEAF} END AS found FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place FROM rows),
{_tree('low', 'leaves')},
sources AS MATERIALIZED (SELECT '' AS tree, tree AS source, top AS digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM low_top),
{_tree('high', 'sources')},
low_start AS (SELECT id, tree, place, found AS cur, '' AS path FROM leaves),
{_fold('low', 'low_start')},
high_start AS MATERIALIZED (SELECT id, '' AS tree, s.place, e.cur, e.path FROM low_end e JOIN leaves USING (id) JOIN sources s ON s.source = leaves.tree),
{_fold('high', 'high_start')}
SELECT doc_id, l.digest AS leaf, t.top AS subroot, h.top AS root, sha256(e.path) AS proof_sha256, e.cur AS folded_root, e.cur = h.top AS verified
FROM leaves l JOIN low_top t USING (tree) CROSS JOIN high_top h JOIN high_end e USING (id)"""
