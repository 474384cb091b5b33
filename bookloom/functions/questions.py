"""Question expressions: serving lane, intent, metadata hints, near-duplicate guard."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bookloom import settings as S
from bookloom.functions.text import WORD_END, WORD_START, collapse, let, strip

# Inputs answered without retrieval.
GREETINGS = (
    "hi", "hello", "hey", "yo", "howdy", "hiya", "hola", "hi there", "hello there", "how are you",
    "good morning", "good afternoon", "good evening", "good night", "thanks", "thank you", "thank u",
    "thx", "ty", "cheers", "appreciated", "ok", "okay", "k", "sure", "yep", "yeah", "yes", "no", "nope",
    "nah", "bye", "goodbye", "see you", "see ya", "later", "cya", "?", "!", ".", "...",
    "what?", "why?", "how?", "who?",
)

# Phrases asking for no retrieval.
NO_RETRIEVAL = (
    r"(no retrieval|without (searching|using) (the )?(corpus|library|vault|knowledge)"
    r"|don'?t (search|look up|retrieve|use (the )?(corpus|library))"
    r"|skip (the )?(search|retrieval))"
)

# Phrases asking for a comparison or a view over many sources.
MANY_SOURCES = (
    r"(compare|contrast|versus|vs\.?)",
    r"differences?",
    r"similarities?",
    r"relationship between",
    r"(link|connection) between",
    r"how does .+ (relate|compare) to",
    r"across (the )?(corpus|library|vault|sources)",
    r"summarize (the )?(library|corpus|vault|knowledge)",
    r"what does the (library|corpus|vault) (say|contain)",
    r"themes?",
)

# Phrases asking about the library as a whole.
WHOLE_LIBRARY = (
    r"(themes?|summarize (the )?(library|corpus|vault|knowledge)"
    r"|what does the (library|corpus|vault) (say|contain|cover)"
    r"|overview of (the )?(library|corpus|vault)"
    r"|big picture|main ideas)"
)

LANES = ("fast", "standard", "deep")


def _whole_words(pattern: str) -> str:
    return "(?i)" + WORD_START + pattern + WORD_END


def lane(question: Column, image: Column | None = None, mode: Column | None = None) -> Column:
    """Serving lane: an image is ``standard``, an explicit mode wins, then the ordered rules."""
    spaced = collapse(F.translate(question, "‘’“”", "''''"))

    def rules(text: Column) -> Column:
        plain = F.lower(strip(F.rtrim(text, F.lit("!?.,;"))))
        picked = (
            F.when(F.length(text) <= 2, "fast")
            .when(~text.contains(" ") & (F.length(text) <= 12), "fast")
            .when(plain.isin(*GREETINGS), "fast")
            .when(text.rlike(_whole_words(NO_RETRIEVAL)), "fast")
        )
        for pattern in MANY_SOURCES:
            picked = picked.when(text.rlike(_whole_words(pattern)), "deep")
        return picked.otherwise("standard")

    chosen = let(spaced, rules)
    if mode is not None:
        chosen = F.when(mode.isin(*LANES), mode).otherwise(chosen)
    if image is not None:
        chosen = F.when(image, F.lit("standard")).otherwise(chosen)
    return chosen


def asks_whole_library(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike(_whole_words(WHOLE_LIBRARY))


def year_range(question: Column) -> Column:
    """struct(date_from, date_to) of the first bare year from 1800 to 2099; null without one."""
    year = F.regexp_extract(F.coalesce(question, F.lit("")), WORD_START + "(1[89][0-9]{2}|20[0-9]{2})" + WORD_END, 1)
    return F.when(
        year != "",
        F.struct(F.concat(year, F.lit("-01-01")).alias("date_from"), F.concat(year, F.lit("-12-31")).alias("date_to")),
    )


def clean_metadata(raw: Column) -> Column:
    """Tidy a struct(tags, date_from, date_to, author) as a model returned it."""

    def day(value: Column) -> Column:
        return F.when(strip(value).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), strip(value))

    tags = F.filter(
        F.transform(F.coalesce(raw["tags"], F.array().cast("array<string>")), lambda t: F.lower(strip(t))),
        lambda t: t != "",
    )
    author = F.substring(strip(F.coalesce(raw["author"], F.lit(""))), 1, 128)
    return F.struct(
        F.slice(F.transform(tags, lambda t: F.substring(t, 1, 64)), 1, 5).alias("tags"),
        day(raw["date_from"]).alias("date_from"),
        day(raw["date_to"]).alias("date_to"),
        F.when(author != "", author).alias("author"),
    )


def lenient_json(text: Column, schema: str) -> Column:
    """Parse JSON; on failure once more without code fences; null when both fail."""
    bare = strip(F.regexp_replace(strip(text), r"(?m)^```(?:json)?|```$", ""))
    ok = {"mode": "PERMISSIVE"}
    first = F.try_parse_json(text)
    return F.when(first.isNotNull(), F.from_json(text, schema, ok)).when(
        F.try_parse_json(bare).isNotNull(), F.from_json(bare, schema, ok)
    )


def image_description(text: Column) -> Column:
    """struct(caption, tags) from a model reply; a reply that is no JSON is the caption itself."""
    parsed = F.from_json(text, "caption string, tags array<string>")
    is_json = F.try_parse_json(text).isNotNull() & strip(text).startswith("{")
    caption = F.substring(strip(F.coalesce(parsed["caption"], F.lit(""))), 1, S.CAPTION_CHARS)
    tags = F.filter(
        F.transform(F.coalesce(parsed["tags"], F.array().cast("array<string>")), strip), lambda t: t != ""
    )
    plain = F.struct(
        F.substring(strip(text), 1, S.CAPTION_CHARS).alias("caption"), F.array().cast("array<string>").alias("tags")
    )
    rich = F.struct(
        F.when(caption != "", caption).otherwise(F.substring(text, 1, S.CAPTION_CHARS)).alias("caption"),
        F.slice(F.transform(tags, lambda t: F.substring(t, 1, S.TAG_CHARS)), 1, S.IMAGE_TAGS).alias("tags"),
    )
    return F.when(is_json, rich).otherwise(plain)


def too_different(
    stored: Column,
    asked: Column,
    min_jaccard: float = S.CACHE_MIN_JACCARD,
    max_ratio: float = S.CACHE_MAX_RATIO,
) -> Column:
    """True when a cached answer must not serve ``asked`` although the vectors are close."""

    def tokens(c: Column) -> Column:
        return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))

    def names(c: Column) -> Column:
        found = F.regexp_extract_all(
            F.coalesce(c, F.lit("")), F.lit(WORD_START + "[A-Z][a-z]+" + WORD_END), F.lit(0)
        )
        return F.array_sort(F.array_distinct(found))

    def compare(pair: Column) -> Column:
        a, b, na, nb = pair["a"], pair["b"], pair["na"], pair["nb"]
        jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
        ratio = F.greatest(F.size(a), F.size(b)) / F.least(F.size(a), F.size(b))
        return (
            F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(True))
            .when(jaccard < min_jaccard, True)
            .when(ratio > max_ratio, True)
            .when((F.size(na) > 0) & (F.size(nb) > 0) & (na != nb), True)
            .otherwise(False)
        )

    return let(
        F.struct(
            tokens(stored).alias("a"), tokens(asked).alias("b"), names(stored).alias("na"), names(asked).alias("nb")
        ),
        compare,
    )
