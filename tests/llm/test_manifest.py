import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bookloom.llm import manifest
from tests.llm.helpers import empty, odd_documents


def H(*values):
    out = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
    return hashlib.sha256(out.encode()).hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def proofs(nodes):
    """(top, steps of each node) of a tree over digests, built level by level."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(level)))
            steps[leaf].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], steps


def brute(rows, tamper=None):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, H(*r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: proofs([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in by_source}
    root, above = proofs([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, upper in zip(order, above, strict=True):
        for (_, _, leaf, r), steps in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            cur, steps = H(*r[:4], tamper(r[4]) if tamper and r[4] is not None else r[4]), steps + upper
            for left, right in steps:
                cur = sha(left + cur + right)
            out.append((r[0], leaf, trees[s][0], root, sha("".join(a + b for a, b in steps)), cur, cur == root))
    return sorted(out, key=str)


def got(df, tampered=None):
    return sorted((tuple(r) for r in manifest.manifest(df, tampered).collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [2])
def test_equals_a_tree_built_level_by_level(spark, monkeypatch, levels):
    """Sources of one to 100 rows, a third of them in one; blocks of 9 leaves, hence several tiers."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = []
    for s, n in enumerate([1, 2, 3, 4, 9, 10, 27, 28, 100]):
        rows += [(len(rows) * 17 % 1000, None if s == 3 else "" if s == 4 else "äx"[: s % 3] + str(s), "en", i, f"line {i}\nof {s}") for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    assert got(df) == brute(rows)
    found = got(df, cut)
    assert found == brute(rows, lambda t: t.replace("\n", ""))
    assert not any(r[-1] for r in found)


def test_odd_rows(spark):
    df = odd_documents(spark).withColumns({"tree": F.lit(1), "place": F.lit("x"), "steps": F.lit(2), "digest": F.lit(0)})
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(df) == brute(rows)
    assert got(empty(df)) == []
    one = df.filter("doc_id = 3")
    assert got(one)[0][1:4] == (H(3, "a", "en", 0, ""),) * 3


def test_repeated_rows_are_leaves(spark):
    rows = [(None, "a", None, None, f"t{i % 3}") for i in range(40)] + [(5, "a", "x", 1, "same")] * 30
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_any_change_shows(spark):
    rows = [(i, f"s{i % 2}", "en", 3, "abc") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = manifest.manifest(df, F.when(F.col("doc_id") == 7, "abd").otherwise(F.col("text"))).collect()
    assert {r["doc_id"] for r in out if not r["verified"]} == {7} and len({r["root"] for r in out}) == 1
