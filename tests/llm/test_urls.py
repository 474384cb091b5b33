import math
import re

import pytest
from pyspark.sql import functions as F

from bookloom.llm import urls
from tests.llm.helpers import SMALL, empty


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return "".join(c.lower() if c < "\x80" else c for c in host), path


def rule_for(host, path, rules=urls.RULES):
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: len(r[0] + r[1])) if fit else None


def letters(text):
    return re.findall(r"[^\W\d_]+", text)


def best_split(name, count, total):
    """All segmentations, by recursion over the last word."""
    table = {0: (0.0, [])}
    for end in range(1, len(name) + 1):
        found = []
        for start in range(max(0, end - urls.MAX_WORD), end):
            w = name[start:end]
            price = math.log(count[w] / total) if w in count else math.log(10 / total) - len(w) * math.log(10)
            found.append((table[start][0] + price, end - start, table[start][1] + [w]))
        score, _, words = max(found)
        table[end] = (score, words)
    return table[len(name)][1]


def brute(rows):
    model, count = urls.Bayes(), {}
    for _, _, html in rows:
        for w in letters(re.sub("<[^<>]*>", " ", html or "").lower()):
            if len(w) <= urls.MAX_WORD:
                count[w] = count.get(w, 0) + 1
    least = math.ceil(urls.EXAMPLE_SHARE * sum(count.values())) or 1
    for w in model.words:
        count[w] = max(count.get(w, 0), least)
    total, out = sum(count.values()), []
    for page, url, _ in rows:
        host, path = parts(url)
        rule, odds = rule_for(host, path), model.start
        for name in letters(f"{host} {path}".lower()):
            odds += sum(model.odds.get(w, 0) for w in (best_split(name, count, total) if len(name) <= urls.MAX_NAME else [name]))
        out.append((page, host, path, rule[0] + rule[1] if rule else None, rule[2] if rule else "block" if odds > 0 else "allow", odds / urls.UNIT))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in urls.judge(df).collect()), key=str)


SCHEMA = "page_id long, url string, html string"


def test_given_pages(spark):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    assert got(df) == brute(rows)


URLS = [
    "http://a.example.org/freebets/casinowin", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en", "https://example.com/en/", "https://x.example.com/en/a", "https://y.www.example.com/en/a",
    "https://notexample.com/en/", "http://net/es/", "http://a.net/fr/", "http://a.net/fr", "http://a.net", "a.net/es/", "", None, "://", "://?q", "x://h#f://g/p", "http://com", "http://com/", "http://h:80/p;a?b",
    "http://cheap-pills.example.org/?casino", "http://adult-x.example.net/en/1", "http://www.library.org/books", "http://thebestcasino.org/", "http://m\u00fcnchen.example.org/stra\u00dfe/\u00c4pfel", "http://" + "casino" * 20 + ".org/", "http://h.org/" + "viagra" * 3000,
    "http://h.org/a\nb/c", "http://user@casino.org:8/",
]


def test_rules_hosts_and_segmentation(spark):
    html = "<p>The best of the library: cheap books &amp; all pills of the world, <b title='casino'>win</b> or not</p>" * 30
    rows = [(i // 2 if i % 7 else None, u, html if i % 3 else None) for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = got(df)
    assert out == brute(rows)
    verdict = {r[1]: r[4] for r in out}
    assert verdict["thebestcasino.org"] == verdict["cheap-pills.example.org"] == verdict["a.example.org"] == verdict["adult-x.example.net"] == "block"
    assert verdict["www.library.org"] == "allow"


def test_words_of_a_name():
    count = {"free": 50, "bets": 5, "the": 900, "rapist": 1, "therapist": 20}
    known = lambda name: {(i, n): count[name[i : i + n]] for i in range(len(name)) for n in range(1, len(name) - i + 1) if name[i : i + n] in count}
    assert urls.viterbi("freebets", known("freebets"), 1000) == ["free", "bets"]
    assert urls.viterbi("therapist", known("therapist"), 1000) == ["therapist"]
    assert urls.viterbi("qqfree", known("qqfree"), 1000) == ["qq", "free"]


def test_bayes_equals_plain_formula():
    model = urls.Bayes([("a b a", True), ("b c", False)], expected=0.2, smoothing=0.5)
    t, f = 3 + 1.5, 2 + 1.5
    assert model.odds["a"] == round(urls.UNIT * (math.log(2.5 / t) - math.log(0.5 / f)))
    assert model.odds["c"] == round(urls.UNIT * (math.log(0.5 / t) - math.log(1.5 / f)))
    assert model.start == round(urls.UNIT * math.log(0.25))
    with pytest.raises(ValueError):
        urls.Bayes([("a", True)] * (urls.MAX_EXAMPLES + 1))


BAD = "buyviagra-online.org freecasino.net www.sportsbets24.org sex-cams.org pornvideos.org adultdating.net spamlinks.org popup-ads.net cheappills.org onlinecasinobonus.net"
GOOD = "citylibrary.org science-journal.net familyfarm.org m.worldnews.net localweather.org freesoftware.net adulteducation.org traintrack.net cheapflights.org chessclub.net"


def test_held_out_hosts(spark):
    """Hosts that are no examples, most of them words run together, over a plain English lexicon."""
    prose = "the family buys sports videos online and the local weather is good in the city for a cheap bonus of the world news by science"
    hosts = [(h, h in BAD.split()) for h in (BAD + " " + GOOD).split()]
    df = spark.createDataFrame([(i, f"http://{h}/en/1", prose) for i, (h, _) in enumerate(hosts)], SCHEMA)
    verdict = {r["host"]: r["verdict"] for r in urls.judge(df, rules=()).collect()}
    wrong = [h for h, bad in hosts if (verdict[h] == "block") != bad]
    assert len(wrong) <= 2, wrong


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://a.org/b", None)], SCHEMA).withColumns({"row": F.lit(1), "name": F.lit("x"), "host": F.lit("h"), "path": F.lit("p"), "word": F.lit(2), "weight": F.lit(9)})
    assert got(df) == [(1, "a.org", "/b", None, "allow", urls.Bayes().start / urls.UNIT)]
    assert got(empty(df)) == []
