import re

from bookloom.llm import licenses
from tests.llm.helpers import empty, odd_documents


def grams(text):
    w = re.sub("[^a-z0-9\n]+", " ", "".join(c.lower() if c < "\x80" else c for c in text)).split()
    return {tuple(p) for p in zip(w, w[1:])}


def test_matches_brute_force(spark):
    body = licenses.TEMPLATES["MIT text"]
    texts = [
        "Intro\nReleased under the MIT License.\nmore", body, f"Copyright (c) 2020 X\n{body}", "Licensed under CC BY-NC 4.0.", "licensed UNDER cc by 4.0!!",
        "This work is licensed under the GNU General Public License, version 3.", "nothing to see", "Released under the MIT Licence terms", "\n\nReleased under the\n MIT License.\n",
    ]
    got = {(r["doc_id"], r["license"]): (round(r["dice"], 12), r["n_units"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        for unit in [*t.split("\n"), *([t] if "\n" in t else [])]:
            for name, template in licenses.TEMPLATES.items():
                a, b = grams(unit), grams(template)
                if a and 200 * len(a & b) >= 80 * (len(a) + len(b)):
                    d = round(2 * len(a & b) / (len(a) + len(b)), 12)
                    old = want.get((i, name), (0, 0))
                    want[i, name] = (max(old[0], d), old[1] + 1)
    assert got == want and len(want) >= 7


def test_size_bounds_lose_nothing(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate(range(2, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    template = {"t": " ".join(f"w{j}" for j in range(20))}
    got = {r["doc_id"] for r in licenses.scan(docs, template, 0.7).collect()}
    want = {i for i, t in rows if 200 * len(grams(t) & grams(template["t"])) >= 70 * (len(grams(t)) + len(grams(template["t"])))}
    assert got == want


def test_odd_rows_and_empty_tables(spark):
    assert licenses.scan(odd_documents(spark)).count() == 0
    assert licenses.scan(empty(odd_documents(spark))).count() == 0
