"""Text projections as pure Column expressions (no Python workers).

Whitespace rules follow Python's ``str.split``/``str.strip``/``\\s`` on
Unicode text, which is Java's ``(?U)\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "(?U)\\s+"
_EDGE_WS = "(?U)^\\s+|\\s+$"

# Fixed values that must equal the reference for equal results: the
# ellipsis appended on truncation and the sentence terminators.
ELLIPSIS = "..."
SENTENCE_END = ".!?"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Unicode-aware ``str.strip()``."""
    return F.regexp_replace(_c(c), _EDGE_WS, "")


def collapse_ws(c) -> Column:
    """Every whitespace run to one space, then strip."""
    return strip_ws(F.regexp_replace(_c(c), WS, " "))


def regex_text(html) -> Column:
    """Drop script/style bodies, tags to a space, collapse, strip.
    Entities stay encoded."""
    c = F.regexp_replace(_c(html), "(?isu)<script.*?</script>", "")
    c = F.regexp_replace(c, "(?isu)<style.*?</style>", "")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    return collapse_ws(c)


def strip_tags(html) -> Column:
    """Tags to the empty string, whitespace kept."""
    return F.regexp_replace(_c(html), "<[^>]+>", "")


def truncate(c, n: int, ellipsis: bool = True) -> Column:
    """Cut to ``n`` code points; content/selective append ``...``."""
    c = _c(c)
    cut = F.substring(c, 1, n)
    if ellipsis:
        cut = F.concat(cut, F.lit(ELLIPSIS))
    return F.when(F.length(c) > n, cut).otherwise(c)


def words(c) -> Column:
    """Whitespace tokens, like ``str.split()``."""
    return F.filter(F.split(strip_ws(c), WS), lambda x: x != "")


def word_count(c) -> Column:
    """Number of whitespace-separated tokens; empty or null gives 0."""
    return F.coalesce(F.size(words(c)), F.lit(0)).cast("int")


def char_count(c) -> Column:
    """C11: code points."""
    return F.coalesce(F.length(_c(c)), F.lit(0)).cast("int")


def preview(c, n: int = 200) -> Column:
    """C14: first ``n`` chars plus ``...`` when longer."""
    return truncate(c, n, ellipsis=True)


def min_words(blocks, n: int) -> Column:
    """Keep text blocks (array<string>) with at least ``n`` words."""
    return F.filter(_c(blocks), lambda b: F.size(F.filter(F.split(strip_ws(b), WS), lambda x: x != "")) >= n)


def content_analysis(c) -> Column:
    """Total words, distinct lower-cased words longer than 3, their
    ratio to 3 places (half-even like Python ``round``), and length."""
    w = words(c)
    total = F.size(w)
    uniq = F.size(F.array_distinct(F.filter(F.transform(w, F.lower), lambda x: F.length(x) > 3)))
    return F.struct(
        total.cast("int").alias("total_words"),
        uniq.cast("int").alias("unique_words"),
        F.bround(uniq / F.greatest(total, F.lit(1)), 3).alias("vocabulary_ratio"),
        F.length(_c(c)).cast("int").alias("content_length_after_deduplication"),
    )


# --- sentence and block splitting (E1, E2) ---------------------------------

# A sentence ends at a terminator once its stripped length exceeds 10;
# a trailing remainder without terminator is a sentence too.
_SENTENCE_RE = "(?s)\\s*(\\S.{9,}?[.!?]|\\S.*$)"


def sentences(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(_SENTENCE_RE), 1)


def dedup_sentences(c) -> Column:
    """Texts under 50 chars untouched; else first occurrence of each
    sentence (case-sensitive), joined by a space."""
    c = _c(c)
    return F.when(F.length(c) < 50, c).otherwise(F.array_join(F.array_distinct(sentences(c)), " "))


def _nonblank_stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip_ws), lambda x: x != "")


def split_blocks(c) -> Column:
    """Split on blank line; if at most one block, on newline; if still at
    most one, on ``.`` keeping only pieces longer than 20 chars."""
    c = _c(c)
    by_para = _nonblank_stripped(F.split(c, "\n\n"))
    by_line = _nonblank_stripped(F.split(c, "\n"))
    by_dot = F.filter(F.transform(F.split(c, "\\."), strip_ws), lambda x: (x != "") & (F.length(x) > 20))
    return F.when(F.size(by_para) > 1, by_para).when(F.size(by_line) > 1, by_line).otherwise(by_dot)


def norm_block(c) -> Column:
    """Lower-case, strip, collapse whitespace (the comparison form)."""
    return F.regexp_replace(strip_ws(F.lower(_c(c))), WS, " ")
