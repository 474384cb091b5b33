"""URL filter: rules for hosts and paths, and for all other URLs naive Bayes over segmented words.

The runs of letters in a host and path are names. Each distinct name is split into words by a unigram Viterbi: word
probabilities are counts over the text of all pages plus the words of the examples; every substring of a name that may be a word
is looked up by an equi-join, so neither the lexicon nor the names have to fit one machine. Letters that make no known word are
one at the price 10 / (total * 10^length). A multinomial naive Bayes, trained on labelled example phrases, then adds up the
log-odds of the words of a URL; words that no example holds say nothing. Log-odds are whole millionths, so sums do not depend on
their order.

The examples are a parameter (EXAMPLES by default, at most MAX_EXAMPLES), and so are the share of blocked URLs expected before
any word is seen, and the rules. The trained model is therefore of bounded size.

Defined results: a URL that is null or has no ``://`` has an empty host and path, fits no rule and is allowed; of the rules that
fit, the one of the longest host and path wins, of equally long ones the first; equally likely segmentations prefer a longer last
word; names of more letters than a host name can hold (63) are one word; null or repeated ``page_id`` and repeated rows each get
their row; null HTML has no words; an empty table gives no row; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.joins import sized
from bookloom.session import cut, scratch_path

MAX_NAME = 63  # letters of a label in the domain name system
MAX_WORD = 24  # letters of a word
MAX_EXAMPLES = 100_000
EXAMPLE_SHARE = 1e-5  # of all words: the least weight in the lexicon of a word of the examples
SMOOTHING = 0.05
EXPECTED = 0.1  # share of blocked URLs before any word is seen
UNIT = 1_000_000

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

BLOCKED = """online casino; casino poker bonus; casino slots; win casino jackpot; win cash prizes; win free spins; free bets; sports bets; bets odds;
live betting; bingo lottery; roulette blackjack; slots jackpot; adult videos; adult cams; adult chat; adult dating; adult content; porn tube; porn videos;
sex cams; sex chat; x rated adult; x videos; adult x cams; xxx movies; nude girls; escort service; hentai; cheap pills; cheap meds; cheap viagra; viagra cialis pills;
pharmacy pills; diet pills; replica watches; cheap replica bags; payday loans; fast cash loans; ads server; ads track; banner ads; popup ads; ads click;
click track; track pixel; track clicks; adserver; affiliate clicks; spam farm; link farm; content farm; click farm; spam links; spam bots; buy backlinks;
free traffic bots; warez crack; keygen cracks; phishing; malware download; free gift cards; miracle cure; get rich quick; earn money fast; crypto giveaway"""

ALLOWED = """local news; world news today; economy politics; science journal; health clinic; city library; public school; university research;
free software; open source code; download manual; music review; film review; book shop; organic farm; farm garden; travel guide; train track; football team;
cup match win; history museum; weather report; cooking recipes; photo gallery; user forum; help center; support contact; about us; privacy policy;
product catalog; cheap flights; hotel booking; adult education; live concert; job offers; classified ads; video lectures; buy tickets; gift shop;
account login; credit union; bank loans; x ray; girls school; chess club; card games; traffic report; crypto research; discount store; quick start;
documentation; developer community; archive; content management; link collection; data pixel; service status; chat support; wiki pages"""

EXAMPLES = tuple((phrase.strip(), blocked) for text, blocked in ((BLOCKED, True), (ALLOWED, False)) for phrase in text.split(";"))

LETTERS = r"(\p{L}+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; and what follows that up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Host and path of the longest rule for the host or a domain above it whose path begins the path, and its verdict; else nulls."""
    name = verdict = F.lit(None).cast("string")
    for domain, prefix, says in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        name, verdict = F.when(fits, domain + prefix).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


class Bayes:
    """Multinomial naive Bayes over words: log-odds of being blocked, in millionths."""

    def __init__(self, examples: Sequence[tuple[str, bool]] = EXAMPLES, expected: float = EXPECTED, smoothing: float = SMOOTHING):
        if len(examples) > MAX_EXAMPLES:
            raise ValueError(f"{len(examples)} examples; at most {MAX_EXAMPLES}")
        count = {True: Counter(), False: Counter()}
        for phrase, blocked in examples:
            count[blocked].update(phrase.lower().split())
        self.words = sorted(count[True].keys() | count[False].keys())
        total = {side: sum(c.values()) + smoothing * len(self.words) for side, c in count.items()}
        chance = lambda side, w: math.log((count[side][w] + smoothing) / total[side])
        self.odds = {w: round(UNIT * (chance(True, w) - chance(False, w))) for w in self.words}
        self.start = round(UNIT * math.log(expected / (1 - expected)))


def lexicon(pages: DataFrame, model: Bayes) -> tuple[DataFrame, int]:
    """``word, n`` over the text of all pages and the words of the examples, and the sum of ``n``."""
    text = F.regexp_replace("html", "<[^<>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(1))).alias("word")).filter(F.length("word") <= MAX_WORD)
    counts = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = math.ceil(EXAMPLE_SHARE * total) or 1
    shown = pages.sparkSession.createDataFrame([(w, least) for w in model.words], "word string, n long")
    both = cut(counts.unionByName(shown).groupBy("word").agg(F.max("n").alias("n")))
    return both, both.agg(F.sum("n")).first()[0]


def viterbi(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words of ``name``; ``known`` holds the count of the word at a start and size."""
    best, last = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = []
        for size in range(1, min(end, MAX_WORD) + 1):
            n = known.get((end - size, size))
            price = math.log(n / total) if n else math.log(10 / total) - size * math.log(10)
            options.append((best[end - size] + price, size))
        score, size = max(options)
        best.append(score)
        last.append(size)
    words, end = [], len(name)
    while end:
        words.append(name[end - last[end] : end])
        end -= last[end]
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """``name, words`` of distinct ``names (name)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, spans in zip(batch.column("name").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                known = {(s["at"], s["size"]): s["n"] for s in spans}
                out.append(viterbi(name, known, total) if len(name) <= MAX_NAME else [name])
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    at = names.filter(F.length("name") <= MAX_NAME).select("name", F.explode(F.sequence(F.lit(0), F.length("name") - 1)).alias("at"))
    parts = at.select("name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("name") - F.col("at")))).alias("size"))
    spans = parts.withColumn("word", F.expr("substring(name, at + 1, size)")).join(words, "word").groupBy("name").agg(
        F.collect_list(F.struct("at", "size", "n")).alias("spans"),
    )
    none = F.array().cast(spans.schema["spans"].dataType)
    return names.join(spans, "name", "left").select("name", F.coalesce("spans", none).alias("spans")).mapInArrow(run, "name string, words array<string>")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, model: Bayes | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, log_odds`` of each page's URL."""
    model, spark = model or Bayes(), pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", "url", F.monotonically_increasing_id().alias("row")).select("row", "page_id", host.alias("host"), path.alias("path"))
    stored = scratch_path(spark, "urls")
    urls.write.parquet(stored)
    urls = spark.read.parquet(stored)
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit(LETTERS), F.lit(1))
    tokens = urls.select("row", F.explode(found).alias("name"))
    words, total = lexicon(pages.select("html"), model)
    split = segmented(tokens.select("name").distinct(), words, total)
    odds = F.create_map(*[F.lit(x) for w, v in model.odds.items() for x in (w, v)]) if model.odds else F.lit(None).cast("map<string,long>")
    weight = F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + F.coalesce(F.try_element_at(odds, w), F.lit(0)).cast("long"))
    telling = cut(split.select("name", weight.alias("weight")).filter("weight <> 0"))
    sums = tokens.join(sized(telling), "name").groupBy("row").agg(F.sum("weight").alias("weight"))
    scored = urls.join(sums, "row", "left").withColumn("log_odds", (F.lit(model.start) + F.coalesce("weight", F.lit(0))) / UNIT)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")
