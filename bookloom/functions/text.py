"""Text expressions. All run inside the JVM; nothing here ships rows to Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from bookloom import settings as S

# Every character that counts as white space, for trimming and as a regular-expression class.
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]"
# Word boundaries spelled out, so the meaning does not depend on the JDK.
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"

# Ends after which a line is glued on without a space.
LINE_ENDS = (".", "!", "?", ":", ";", '"')


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def clean(c: Column) -> Column:
    """CRLF to LF, runs of blanks and tabs to one space, outer white space removed."""
    return strip(F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " "))


def collapse(c: Column) -> Column:
    """All white-space runs to one space, outer white space removed."""
    return strip(F.regexp_replace(c, SPACE + "+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column) -> Column:
    """About four characters per token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def _reflow(p: Column) -> Column:
    """Join the hard-wrapped lines of one paragraph."""

    def glue(lines: Column) -> Column:
        head = F.transform(
            F.slice(lines, F.lit(1), F.size(lines) - 1),
            lambda x: F.when(F.right(x, F.lit(1)).isin(*LINE_ENDS), x).otherwise(F.concat(x, F.lit(" "))),
        )
        return F.concat(F.array_join(head, ""), F.element_at(lines, -1))

    def kept(raw: Column) -> Column:
        tail = F.filter(F.transform(F.slice(raw, F.lit(2), F.size(raw)), strip), lambda x: x != "")
        return F.concat(F.slice(raw, F.lit(1), F.lit(1)), tail)

    return F.when(
        p.contains("\n") & (F.length(p) < S.REFLOW_LIMIT),
        let(F.split(p, "\n"), lambda raw: let(kept(raw), glue)),
    ).otherwise(p)


def paragraphs(c: Column) -> Column:
    """Blank-line separated blocks, trimmed, hard line breaks joined."""
    blocks = F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")
    return F.transform(blocks, _reflow)


def sentences(c: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` followed by white space; blanks dropped."""
    parts = F.split(c, r"(?<=[.!?])" + SPACE + "+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def claims(c: Column) -> Column:
    """Sentences of more than three characters."""
    return F.filter(sentences(strip(c)), lambda s: F.length(s) > 3)


def citation_markers(c: Column) -> Column:
    """Distinct ``[n]`` markers (one to three digits) as integers."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(c, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda n: n.cast("int"))
    )


def title_default(question: Column) -> Column:
    return F.when(F.coalesce(question, F.lit("")) == "", "New conversation").otherwise(
        F.substring(question, 1, 80)
    )


def snippet(c: Column, chars: int) -> Column:
    return F.substring(c, 1, chars)


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def file_suffix(path: Column) -> Column:
    """Last extension with its dot, lower-cased, or an empty string."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)(\.[^.]+)$", 1))


def data_url(c: Column) -> Column:
    """``data:<mime>;base64,<payload>`` as struct(mime, bytes); null when it is not one."""
    pattern = r"(?s)^data:([^;]+);base64,(.+)$"
    return F.when(
        c.rlike(pattern),
        F.struct(
            F.regexp_extract(c, pattern, 1).alias("mime"),
            F.unbase64(F.regexp_extract(c, pattern, 2)).alias("bytes"),
        ),
    )
