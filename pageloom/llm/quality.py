"""Host-level quality rules (native: DataFrame functions only).

Per-document counts decide base failures and four softer rules. Failures of
each soft rule are counted per host, the host's rate is shrunk towards the
corpus rate with a beta prior whose strength is fitted from the spread between
hosts (method of moments, weighted by documents), and the host verdicts are joined back: a document
that fails a soft rule is rejected when its host is an outlier for that rule.
A clean document is kept whatever its host's verdict.

Defined cases: a null or empty text has no words and fails the base rule; a
null host is a host of its own; repeated rows are separate documents and each
counts; extra columns pass through (columns named like an output are replaced);
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import SMALL_ROWS, keep

MIN_WORDS = 20            # base: fewer words fail
MAX_REPEAT_PCT = 30       # base: a larger share of words in repeated windows fails
WINDOW = 8                # words per window
SYMBOL_PCT = 10           # soft: symbols per 100 word characters
DUP_LINE_PCT = 30         # soft: repeated lines per 100 lines
WORD_CHARS = (2, 12)      # soft: mean characters per word outside this range
CAPS_PCT = 60             # soft: capital letters per 100 word characters
HOST_RATE = 0.5           # a host whose shrunk failure rate is at least this ...
HOST_ODDS = 4.0           # ... with odds at least this many times those of the other hosts is an outlier
MIN_STRENGTH = 4.0        # prior documents at least: one document never speaks for its host
MAX_STRENGTH = 1e6        # prior documents when hosts do not differ beyond chance
SPACES = " \t\n\u000b\f\r"
RULES = ("symbols", "dup_lines", "word_length", "capitals")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _chars_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("long")


def _window_hashes(words: Column, n: Column) -> Column:
    """The 64-bit hash of every window of words."""
    return F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts (long) to ``docs``; the text is read once."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    out = (docs.drop(*COUNTS)
           .withColumn("_words", words)
           .withColumn("n_words", F.size("_words").cast("long"))
           .withColumn("word_chars", _chars_without(t, SPACES))
           .withColumn("n_symbols", F.length(t).cast("long") - _chars_without(t, "#*$%&|<>"))
           .withColumn("_lines", lines)
           .withColumn("n_lines", F.size("_lines").cast("long"))
           .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
           .withColumn("n_capitals", (F.length(t) - F.length(F.translate(
               t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"))
           .withColumn("_h", _window_hashes(F.col("_words"), F.size("_words")))
           .drop("_words", "_lines"))
    return with_repeats(out)


def with_repeats(df: DataFrame) -> DataFrame:
    """Turn the window hashes ``_h`` into n_repeat_words, the words covered by
    windows found at least twice. Only texts with a repeated hash pay for
    sorting: (hash, position) pairs whose neighbour has the same hash stay,
    and the covered words are the union of these windows."""
    h = F.col("_h")
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_p", F.when(repeated, pairs)).drop("_h")
    p = F.col("_p")
    at = lambda i: F.get(p, i)["h"]
    same = lambda x, i: F.coalesce(at(i) == x["h"], F.lit(False))
    hits = F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn("_s", F.array_sort(F.transform(hits, lambda x: x["i"]))).drop("_p")
    s = F.col("_s")
    covered = F.aggregate(
        F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s")


def with_rules(counted: DataFrame) -> DataFrame:
    """Add base_failed and one boolean per soft rule."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return (counted
            .withColumn("base_failed", (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * words))
            .withColumn("fail_symbols", 100 * F.col("n_symbols") > SYMBOL_PCT * chars)
            .withColumn("fail_dup_lines", 100 * F.col("n_dup_lines") > DUP_LINE_PCT * F.col("n_lines"))
            .withColumn("fail_word_length", (chars < WORD_CHARS[0] * words) | (chars > WORD_CHARS[1] * words))
            .withColumn("fail_capitals", 100 * F.col("n_capitals") > CAPS_PCT * chars))


def host_verdicts(ruled: DataFrame, host: str = "source") -> DataFrame:
    """One row per host with its shrunk failure rate and verdict per rule.

    Prior by moments, every host weighted by its documents in the rate m and in the spread alike: with
    S = sum n (p - m)^2 over hosts, the correlation inside a host is
    rho = (S / (m (1 - m)) - sum (1 - n/N)) / (sum n (1 - n/N) - sum (1 - n/N))
    and the prior's strength 1 / rho - 1, within [MIN_STRENGTH, MAX_STRENGTH]; shrunk rate
    = (failures + m * strength) / (n + strength). A host is an outlier when its shrunk rate reaches HOST_RATE and
    its odds HOST_ODDS times those of all other hosts together, which a host of any size can reach.
    """
    counts = ruled.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"f_{r}") for r in RULES])
    prior = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * F.col("n").cast("double")).alias("n2"), *[
        c for r in RULES for c in (F.sum(f"f_{r}").alias(f"t_{r}"),
                                   F.sum(F.col(f"f_{r}") * F.col(f"f_{r}").cast("double") / F.col("n")).alias(f"q_{r}"))])
    both = counts.join(F.broadcast(prior))  # prior: one row
    cols = []
    for r in RULES:
        f, total, everyone, n = F.col(f"f_{r}"), F.col(f"t_{r}"), F.col("all"), F.col("n")
        m = total / everyone
        apart = F.col("hosts") - 1                          # sum (1 - n/N)
        spread = F.col(f"q_{r}") - total * m                # S
        rho = F.try_divide(F.try_divide(spread, m * (1 - m)) - apart, everyone - F.col("n2") / everyone - apart)
        s = F.when(rho > 0, F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), 1 / rho - 1))).otherwise(F.lit(MAX_STRENGTH))
        shrunk = (f + m * s) / (n + s)
        others = F.coalesce(F.try_divide(total - f, everyone - n), m)
        bad = (shrunk >= HOST_RATE) & (shrunk * (1 - others) >= HOST_ODDS * others * (1 - shrunk)) & (f > 0)
        cols += [shrunk.alias(f"rate_{r}"), bad.alias(f"bad_{r}")]
    return both.select("_host", "n", *cols)


def _ruled(docs: DataFrame, cols, text: str, host: str) -> DataFrame:
    """(row, host, counts, rules): the caller's columns are one struct, so their names never meet ours."""
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    packed = docs.select(row, F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{host}`").alias("host"))
    return with_rules(document_counts(packed, "text")).drop("text")


def _judged(ruled: DataFrame, bad: DataFrame) -> DataFrame:
    """``ruled`` with ``kept``. ``bad`` holds the outlier hosts; it is broadcast only when they are counted and few."""
    bad = keep(bad.filter(" or ".join(f"bad_{r}" for r in RULES)), "bad_hosts")
    if bad.count() <= SMALL_ROWS:
        bad = F.broadcast(bad)
    joined = ruled.join(bad, ruled["host"].eqNullSafe(bad["_host"]), "left").drop("_host")
    verdict = F.lit(False)
    for r in RULES:
        verdict = verdict | (F.col(f"fail_{r}") & F.coalesce(F.col(f"bad_{r}"), F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~verdict).drop(*[f"bad_{r}" for r in RULES])


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", carry: tuple = ()) -> DataFrame:
    """The ``carry`` columns (default: all of ``docs``; columns named like an output are replaced) with counts,
    base_failed, rule failures and ``kept``.

    The ruled rows are kept in the shared folder, so the texts are read once
    although they feed both the host rates and the result."""
    own = (*COUNTS, "base_failed", "kept", *[f"fail_{r}" for r in RULES])
    cols = [c for c in (carry or docs.columns) if c not in own]
    ruled = keep(_ruled(docs, cols, text, host), "quality")
    hosts = host_verdicts(ruled, "host").select("_host", *[f"bad_{r}" for r in RULES])
    return _judged(ruled, hosts).select("row.*", *own)


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents, all columns, that the rules keep.

    The counts are made twice, for the host rates and for the verdicts, so that no text is written in between."""
    ruled = _ruled(docs, docs.columns, text, host)
    hosts = host_verdicts(ruled, "host").select("_host", *[f"bad_{r}" for r in RULES])
    # a filter on the verdict stays above this number; pushed below the counts, it would repeat them in every condition
    ruled = ruled.withColumn("at", F.monotonically_increasing_id())
    return _judged(ruled, hosts).where("kept and at >= 0").select("row.*")


OUTPUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
