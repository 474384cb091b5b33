"""Secret scans: fixed patterns plus character Markov models of random and ordinary strings.

Every expression here runs in the JVM. Defined results: null or empty text has no span; null ``doc_id``, repeated rows and
very long texts are scanned like any other row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.spans import SPAN, any_case, joined, located

# The patterns and shortest matches of the base kinds, in the order in which kinds are listed.
ASSIGN = "(" + any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
MIN_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
WIDTH = len(ALPHABET) + 1  # position 0: any other character


@dataclass(frozen=True)
class MarkovModel:
    """``llr[a * WIDTH + b]``: log-likelihood ratio, random over ordinary, of character b after a."""

    llr: tuple[float, ...]

    def score(self, token: Column) -> Column:
        """Mean log-likelihood ratio per transition; null for tokens shorter than two characters."""
        table = F.split(F.lit(",".join(f"{x:.4f}" for x in self.llr)), ",").cast("array<double>")
        code = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
        steps = F.sequence(F.lit(1), F.length(token) - 1)
        total = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(table, code(i) * WIDTH + code(i + 1)))
        return F.when(F.length(token) >= 2, total / (F.length(token) - 1))


def fit(samples: DataFrame, smoothing: float = 0.5) -> MarkovModel:
    """Two first-order models from labelled strings ``(value, random boolean)``.

    Transitions are counted by Spark; at most ``2 * WIDTH ** 2`` counts reach the driver. A class without samples keeps the
    uniform distribution.
    """
    pairs = samples.filter(F.length("value") >= 2).select(
        F.coalesce("random", F.lit(False)).alias("random"),
        F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.struct(
            F.instr(F.lit(ALPHABET), F.substring("value", i, F.lit(1))).alias("a"),
            F.instr(F.lit(ALPHABET), F.substring("value", i + 1, F.lit(1))).alias("b"),
        ))).alias("p"),
    )
    counts = {True: {}, False: {}}
    for r in pairs.groupBy("random", "p.a", "p.b").count().collect():
        counts[r["random"]][r["a"], r["b"]] = r["count"]
    totals = {c: [sum(counts[c].get((a, b), 0) for b in range(WIDTH)) for a in range(WIDTH)] for c in counts}

    def log_p(c, a, b):
        return math.log((counts[c].get((a, b), 0) + smoothing) / (totals[c][a] + smoothing * WIDTH))

    return MarkovModel(tuple(log_p(True, a, b) - log_p(False, a, b) for a in range(WIDTH) for b in range(WIDTH)))


def samples_from(docs: DataFrame, sample_docs: int = 150) -> DataFrame:
    """Labelled strings from about ``sample_docs`` documents chosen by hash (the documented bound of the fit).

    Ordinary: the words of these texts outside base spans, alone and joined as ``snake_case`` and ``camelCase`` identifiers.
    Random: the values of base spans, and digests of the words in hexadecimal and base 64.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    every = max(1, math.ceil(texts.count() / sample_docs))
    chosen = texts.filter(F.pmod(F.xxhash64(F.lit("markov"), "doc_id"), F.lit(every)) == 0)
    plain = chosen.select(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ").alias("text"))
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))
    pairs = plain.select(words.alias("w")).filter(F.size("w") >= 1).select(F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(F.get("w", i).alias("w"), F.coalesce(F.get("w", i + 1), F.lit("id")).alias("v")),
    )).alias("p")).select("p.*")
    digest = F.sha2("w", 256)
    drawn = pairs.select(F.explode(F.array(
        F.struct(F.col("w").alias("value"), F.lit(False).alias("random")),
        F.struct(F.concat_ws("_", F.lower("w"), F.lower("v")).alias("value"), F.lit(False).alias("random")),
        F.struct(F.concat("w", F.initcap("v")).alias("value"), F.lit(False).alias("random")),
        F.struct(F.substring(digest, 1, 40).alias("value"), F.lit(True).alias("random")),
        F.struct(F.base64(F.unhex(digest)).alias("value"), F.lit(True).alias("random")),
    )).alias("s")).select("s.*")
    secrets = chosen.select(F.explode(F.concat(
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )).alias("value")).filter(F.length("value") >= MIN_ASSIGNED).withColumn("random", F.lit(True))
    return drawn.unionByName(secrets)


def scan(docs: DataFrame, model: MarkovModel, min_mean: float = 1.0) -> DataFrame:
    """All spans of each row: ``doc_id, base, extra`` (arrays of kind, start, end, value; sorted by start, then kind).

    ``extra`` holds tokens of 20 or more characters that carry a digit, touch no base span, and whose mean log-likelihood
    ratio is ``min_mean`` or more.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    matched = rows.select(
        "doc_id", "text",
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)).alias("m_assign"),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)).alias("m_access"),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)).alias("m_hex"),
        F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("m_markov"),
    )
    long_enough = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_ASSIGNED
    odd = F.filter("m_markov", lambda t: t.rlike("[0-9]") & (model.score(t) >= min_mean))
    placed = matched.withColumn("any", F.size(odd) > 0).select(
        "doc_id",
        F.filter(located(F.col("text"), F.col("m_assign"), ASSIGN, "assign"), long_enough).alias("assign"),
        located(F.col("text"), F.col("m_access"), ACCESS, "access").alias("access"),
        located(F.col("text"), F.col("m_hex"), HEX, "hex").alias("hex"),
        F.when(F.col("any"), located(F.col("text"), F.col("m_markov"), TOKEN, "markov")).otherwise(F.array().cast(SPAN)).alias("tokens"),
    )
    order = lambda kinds: (lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    by_start = lambda c: F.transform(F.array_sort(F.transform(c, order(KINDS))), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
    ))
    base = placed.select("doc_id", by_start(F.concat("assign", "access", "hex")).alias("base"), "tokens")
    touches = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    extra = F.filter("tokens", lambda t: t["value"].rlike("[0-9]") & (model.score(t["value"]) >= min_mean) & ~touches(t))
    return base.select("doc_id", "base", extra.alias("extra"))


def all_spans(base: Column, extra: Column) -> Column:
    """Base and model spans as ``kind:start:end`` by start, then kind as listed."""
    keyed = F.transform(F.concat(base, extra), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"),
    ))
    return joined(F.array_sort(keyed))


def report(docs: DataFrame, sample_docs: int = 150, min_mean: float = 1.0) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans."""
    found = scan(docs, fit(samples_from(docs, sample_docs)), min_mean)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), all_spans(F.col("base"), F.col("extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, model: MarkovModel, mask: str = "[SECRET]", min_mean: float = 1.0) -> DataFrame:
    """``docs`` with each found secret replaced by ``mask``; rows and other columns stay, ``n_chars`` follows the text.

    The same patterns are replaced in place, so no positions and no join are needed. An assignment keeps its name.
    """
    text = F.coalesce("text", F.lit(""))
    tokens = F.array_distinct(F.filter(F.regexp_extract_all("_t", F.lit(TOKEN), F.lit(0)), lambda t: t.rlike("[0-9]") & (model.score(t) >= min_mean)))
    keep_name = "(" + any_case("password|passwd|secret|token|api_?key") + r""")(["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]{8,}"""
    masked = docs.withColumn("_t", F.regexp_replace(F.regexp_replace(F.regexp_replace(text, keep_name, f"$1$2{mask}"), ACCESS, mask), HEX, mask))
    masked = masked.withColumn("_s", tokens)
    clean = F.when(F.size("_s") == 0, F.col("_t")).otherwise(F.aggregate("_s", F.col("_t"), lambda acc, t: F.replace(acc, t, F.lit(mask))))
    out = masked.withColumn("text", F.when(F.col("text").isNotNull(), clean)).drop("_t", "_s")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
