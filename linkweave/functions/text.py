"""Text measures of one row: everything here runs inside the row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave import fixed

WORD = r"[\\p{L}\\p{N}_]+"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}', 0)"


def ascii_tokens_sql(text: str) -> str:
    """Tokens of ASCII letters, digits and underscore; a word with others is no token."""
    return f"filter({tokens_sql(text)}, t -> t rlike '^[a-z0-9_]+$')"


def collapsed_sql(text: str) -> str:
    return f"regexp_replace(lower({text}), '(?U)\\\\s+', ' ')"


def char_ngrams_sql(text: str, n: int) -> str:
    """All overlapping runs of ``n`` characters, in one pass over the text.

    Each match looks ahead at ``n`` characters and consumes one, so the next begins at the
    next whole character.
    """
    return f"regexp_extract_all({text}, '(?s)(?=(.{{{n}}})).', 1)"


def tokens(text: str) -> Column:
    return F.expr(tokens_sql(text))


def ascii_tokens(text: str) -> Column:
    return F.expr(ascii_tokens_sql(text))


def char_ngrams(text: str, low: int = 3, high: int = 5) -> Column:
    grams = ", ".join(char_ngrams_sql(collapsed_sql(text), n) for n in range(low, high + 1))
    return F.expr(f"concat({grams})")


def punctuation_per_hundred(text: str, mark: str) -> Column:
    t = F.col(text)
    count = F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))
    return count / F.greatest(F.length(t), F.lit(1)) * 100.0


def punctuation_map(text: str) -> Column:
    pairs = [x for p in fixed.PUNCTUATION for x in (F.lit(p), punctuation_per_hundred(text, p))]
    return F.create_map(*pairs)


def sentence_lengths_sql(text: str) -> str:
    """Word count of every sentence that holds more than white space."""
    parts = f"filter(split({text}, '[.!?]+'), s -> s rlike '(?U)\\\\S')"
    return f"transform({parts}, s -> size({tokens_sql('s')}))"


def mean_sql(values: str) -> str:
    total = f"aggregate({values}, 0D, (a, x) -> a + x)"
    return f"CASE WHEN size({values}) = 0 THEN 0D ELSE {total} / size({values}) END"


def deviation_sql(values: str, mean: str) -> str:
    """Population standard deviation around a mean that is already a column."""
    squares = f"aggregate({values}, 0D, (a, x) -> a + (x - {mean}) * (x - {mean}))"
    return f"CASE WHEN size({values}) = 0 THEN 0D ELSE sqrt({squares} / size({values})) END"


def identifiers(text: str, kind: str, pattern: str) -> Column:
    """Distinct identifiers of one kind; Unicode word boundaries as in the patterns' origin."""
    flags = "(?Ui)" if kind == "ONION_SERVICE" else "(?U)"
    group = 1 if kind in ("BTC_ADDRESS", "XMR_ADDRESS", "HANDLE") else 0
    found = F.regexp_extract_all(F.col(text), F.lit(flags + pattern), F.lit(group))
    if kind == "PGP_FINGERPRINT":
        found = F.transform(found, lambda v: F.upper(F.regexp_replace(v, r"(?U)\s", "")))
    return F.array_distinct(found)


def truncated(text: str, length: int) -> Column:
    """The first characters, marked with dots."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))
