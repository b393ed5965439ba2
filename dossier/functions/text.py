"""Text normalisation, tokens and counting, all as JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: every character Python counts as white space.
SPACE = (
    "[ \\t\\n\\u000b\\f\\r\\u001c-\\u001f\\u0085\\u00a0\\u1680"
    "\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
)
# The same characters one by one: trimming them needs no pattern.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(SPACE, c))
# Fixed value: word characters plus hyphen (letters, digits, underscore).
TOKEN = "[\\p{L}\\p{N}_\\-]+"
WORD_CHAR = "[\\p{L}\\p{N}_]"

# Characters whose case folding differs from lower-casing.
_FOLDS = {c: c.casefold() for c in "ςſµßŉǰﬀﬁﬂﬃﬄﬅﬆ"}


def strip(column: Column) -> Column:
    """Trim white space of any kind on both ends."""
    return F.btrim(column, F.lit(SPACES))


def collapse_space(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, f"{SPACE}+", " "))


def normalize_text(column: Column) -> Column:
    """One space between words, no line breaks, no outer space."""
    return collapse_space(column)


def html_to_text(column: Column) -> Column:
    """Visible text of a stored page: script and style dropped, tags become spaces."""
    bare = F.regexp_replace(column, r"(?is)<script[^>]*>.*?</script>", "")
    bare = F.regexp_replace(bare, r"(?is)<style[^>]*>.*?</style>", "")
    return collapse_space(F.regexp_replace(bare, r"<[^>]+>", " "))


def casefold(column: Column) -> Column:
    """Case folding for the Latin, Greek and Cyrillic ranges."""

    def fold(low: Column) -> Column:
        folded = low
        for char, target in _FOLDS.items():
            folded = F.replace(folded, F.lit(char), F.lit(target))
        return F.when(low.rlike("[" + "".join(_FOLDS) + "]"), folded).otherwise(low)

    return once(F.lower(column), fold)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))


def token_estimate(column: Column) -> Column:
    size = F.char_length(column)
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(size / 4).cast("int")))


def preview(column: Column, size: int = 280) -> Column:
    return F.substring(collapse_space(column), 1, size)


def occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    removed = F.octet_length(haystack) - F.octet_length(F.replace(haystack, needle, F.lit("")))
    return F.floor(removed / F.octet_length(needle)).cast("long")


def visible_chars(column: Column) -> Column:
    """Number of characters that are not white space."""
    return F.char_length(F.regexp_replace(F.coalesce(column, F.lit("")), f"{SPACE}+", ""))


def has_term(text: Column, term: Column) -> Column:
    """Whole-word, case-insensitive containment of a literal term."""
    quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(
        F.lit(f"(?iu)(?<!{WORD_CHAR})"), quoted, F.lit(f"(?!{WORD_CHAR})")
    )
    return F.regexp_like(text, pattern)


def entity_key(column: Column) -> Column:
    """NFKC, case fold, collapse white space (Arrow batch; Spark has no NFKC function)."""
    return _nfkc_casefold(column)


def computed_once(udf):
    """Keep the planner from repeating a batch function in filters it derives from its result."""
    return udf.asNondeterministic()


@computed_once
@F.pandas_udf(StringType())
def _nfkc_casefold(values):
    import unicodedata

    return values.map(
        lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split())
    )
