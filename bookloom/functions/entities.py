"""Entity name and phrase expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bookloom import settings as S
from bookloom.functions.text import SPACE, WORD_END, WORD_START, collapse, strip

# Punctuation cut from the edges of a name.
EDGE_PUNCTUATION = ".,;:!?()[]{}'\"-–—"

# Words that are no phrase on their own.
NOT_A_PHRASE = ("i", "the", "a", "an", "we", "you", "they", "it", "he", "she", "this", "that", "and", "or")

# Words ignored in image captions.
NOT_IN_CAPTION = ("the", "a", "an", "this", "that", "image", "picture", "photo", "painting")

PHRASE = WORD_START + r"[A-Z][a-zA-Z]+(?:" + SPACE + r"+[A-Z][a-zA-Z]+){0,3}" + WORD_END
CAPTION_WORD = WORD_START + r"[A-Z][a-zA-Z]+" + WORD_END


def canonical(name: Column) -> Column:
    """Merge key of an entity name: edges trimmed, spaces collapsed, lower case."""
    trimmed = F.btrim(strip(F.coalesce(name, F.lit(""))), F.lit(EDGE_PUNCTUATION))
    return F.lower(F.regexp_replace(trimmed, SPACE + "+", " "))


def display(name: Column) -> Column:
    return F.substring(F.regexp_replace(strip(F.coalesce(name, F.lit(""))), SPACE + "+", " "), 1, 120)


def phrases(text: Column) -> Column:
    """Capitalised phrases of one to four words, in text order, with repeats."""
    found = F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0))
    return F.filter(found, lambda p: ~F.lower(p).isin(*NOT_A_PHRASE))


def caption_entities(caption: Column) -> Column:
    """Up to eight capitalised caption words."""
    found = F.regexp_extract_all(F.coalesce(caption, F.lit("")), F.lit(CAPTION_WORD), F.lit(0))
    return F.slice(F.filter(found, lambda w: ~F.lower(w).isin(*NOT_IN_CAPTION)), 1, 8)


def text_windows(text: Column, count: int = 3, chars: int = S.WINDOW_CHARS) -> Column:
    """``count`` evenly spaced windows of ``chars`` characters; the whole text when it is short."""
    n = F.length(text)
    step = F.greatest(F.floor((n - chars) / max(count - 1, 1)), F.lit(1))
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.least(i * step, n - chars).cast("int")
    )
    return F.when(n <= chars, F.array(text)).otherwise(
        F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(chars)))
    )
