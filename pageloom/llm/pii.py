"""Personal data by bootstrapped contextual extraction (native: DataFrame
functions only).

Base entities (e-mail, IP address, card, phone) come from regular expressions
over the whole text; their positions are rebuilt from the text between the
matches. They seed the bootstrap: the words around a seed are lexical patterns
(previous word, previous two words, next word). Tokens of letters and digits, with single separators
inside or none, at least LEAST_CHARS long and with LEAST_DIGITS digits, are candidates of any shape, with the same kinds
of patterns; the graph's score, not the shape, decides.
Spark scores the bipartite graph of patterns and instances for a few rounds: a
pattern is as reliable as its distinct instances, shrunk by pseudo-instances,
and an unseen instance as its patterns' mean. Instances that enough reliable
patterns support are reported as spans of kind ``context``; an accepted
instance is reported wherever it occurs.

Defined cases: a null or empty text has no spans; a text may hold any number of
matches; repeated rows are separate documents (a row number of the stored table
tells them apart); null ids pass through; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
#: Possessive forms of the stated expressions. A match can only begin where a
#: run of its first class begins or where the last match ended (\G), so nothing
#: is tried twice; no form needs to give characters back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # a token of letters and digits, single separators inside, with a digit; one attempt per token
    CONTEXT: r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][-_/.])(?=[A-Za-z]*+(?:[-_/.][A-Za-z]++)*+[-_/.]?[0-9])[A-Za-z0-9]++(?:[-_/.][A-Za-z0-9]++)*+",
}
LEAST_CHARS, LEAST_DIGITS = 5, 3      # of a candidate
_RANK = {k: i for i, k in enumerate((*KINDS, CONTEXT))}
AROUND = 64               # characters of context read on either side
BLOCK = 64                # matches per block of the position sums
ROUNDS = 3
PSEUDO = 2.0              # pseudo-instances of confidence 0 per pattern
LEAST_INSTANCES = 5       # distinct instances a reliable pattern has ...
RELIABLE = 0.6            # ... and its least confidence
LEAST_PATTERNS = 2        # reliable patterns an unseen instance needs ...
ACCEPT = 0.6              # ... and its least confidence


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    once = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + once(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(x, r"\."), lambda p: (F.length(bare(p)) < 3) | (
            (F.length(bare(p)) == 3) & (bare(p) <= "255")))
    if kind == "card":
        d = _digits(x)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    if kind == CONTEXT:
        return (F.length(x) >= LEAST_CHARS) & (F.length(_digits(x)) >= LEAST_DIGITS)
    return F.lit(True)


def _guard(kind: str, text: Column) -> Column:
    """A cheap condition without which a text has no match."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(F.translate(x, "\n\t\r", "   ")), " "), lambda w: w != "")


def _last_end(spans: str, before: Column) -> Column:
    """The end of the last of these ordered spans that starts before a place; 0 without any. Found by halving."""
    a = F.col(spans)
    halve = lambda z, _: F.when(z["lo"] >= z["hi"], z).otherwise(F.when(
        F.get(a, ((z["lo"] + z["hi"]) / 2).cast("int"))["s"] < before,
        F.struct((((z["lo"] + z["hi"]) / 2).cast("int") + 1).alias("lo"), z["hi"].alias("hi"))).otherwise(
        F.struct(z["lo"].alias("lo"), ((z["lo"] + z["hi"]) / 2).cast("int").alias("hi"))))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(a) + 1)).cast("int") + 1)
    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(a).alias("hi")), halve, lambda z: z["lo"])
    return F.when(F.size(a) == 0, 0).otherwise(F.coalesce(F.get(a, at - 1)["e"], F.lit(0)))


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_row``, ``_base`` and ``_other``: arrays of (kind, rank, start, end,
    value, left words, right words) in order of position."""
    df = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    t = F.col("_t")
    kinds = list(PATTERNS)
    df = df.withColumns({f"_m_{k}": F.when(_guard(k, t), F.regexp_extract_all(t, F.lit(PATTERNS[k]), F.lit(0)))
                         for k in kinds})
    df = df.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(t, PATTERNS[k], -1)) for k in kinds})
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sizes = lambda k: lambda i: F.length(F.get(F.col(f"_g_{k}"), i)) + F.length(F.get(F.col(f"_m_{k}"), i))
    block = lambda k: lambda b: total(F.slice(F.col(f"_n_{k}"), b * BLOCK + 1, F.lit(BLOCK)))
    df = df.withColumns({f"_n_{k}": F.transform(F.sequence(F.lit(0), F.size(f"_g_{k}") - 2), sizes(k)) for k in kinds})
    df = df.withColumns({f"_b_{k}": F.transform(
        F.sequence(F.lit(0), ((F.size(f"_n_{k}") - 1) / BLOCK).cast("int")),
        block(k)) for k in kinds})
    df = df.withColumns({f"_b_{k}": F.aggregate(
        F.col(f"_b_{k}"), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))) for k in kinds})

    def found(k: str) -> Column:
        m, g, n, b = (F.col(f"_{x}_{k}") for x in "mgnb")

        def one(i):
            blk = (i / BLOCK).cast("int")
            start = F.get(b, blk) + total(F.slice(n, blk * BLOCK + 1, i % BLOCK)) + F.length(F.get(g, i))
            left = _words(F.substring(F.get(g, i), -AROUND, AROUND))
            return F.struct(
                F.lit(k).alias("kind"), F.lit(kinds.index(k)).alias("rank"), start.alias("s"),
                (start + F.length(F.get(m, i))).alias("e"), F.get(m, i).alias("value"),
                F.slice(left, F.greatest(F.size(left) - 1, F.lit(1)), F.lit(2)).alias("left"),
                F.slice(_words(F.substring(F.get(g, i + 1), 1, AROUND)), 1, 1).alias("right"))

        every = F.transform(F.sequence(F.lit(0), F.size(n) - 1), one)
        return F.coalesce(F.filter(every, lambda x: _valid(k, x["value"])), F.array().cast(_SPANS))

    df = df.withColumns({f"_s_{k}": found(k) for k in kinds})
    df = df.withColumn("_base", F.concat(*[F.col(f"_s_{k}") for k in KINDS]))
    # of a kind's spans, which stand apart in order, the last one that starts before a candidate's end reaches furthest
    apart = lambda x: reduce(lambda a, b: a & b, [_last_end(f"_s_{k}", x["e"]) <= x["s"] for k in KINDS])
    df = df.withColumn("_other", F.filter(F.col(f"_s_{CONTEXT}"), apart))
    gone = ["_t", *[f"_{x}_{k}" for x in "mgnbs" for k in kinds]]
    return df.withColumn("_row", F.monotonically_increasing_id()).drop(*gone)


_SPANS = "array<struct<kind:string,rank:int,s:int,e:int,value:string,left:array<string>,right:array<string>>>"


def _instance(x: Column) -> Column:
    return F.xxhash64(F.lower(x["value"]))


def _edges(rows: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, seed) of all base and candidate spans."""
    one = rows.select(F.explode(F.concat("_base", "_other")).alias("x")).select(
        _instance(F.col("x")).alias("instance"), (F.col("x.kind") != CONTEXT).alias("seed"),
        F.col("x.left").alias("l"), F.col("x.right").alias("r"))
    last = F.element_at("l", -1)
    patterns = F.array(
        F.when(F.size("l") >= 1, F.xxhash64(F.lit("l"), last)),
        F.when(F.size("l") >= 2, F.xxhash64(F.lit("ll"), F.get("l", F.lit(0)), last)),
        F.when(F.size("r") >= 1, F.xxhash64(F.lit("r"), F.get("r", F.lit(0)))))
    return one.select("instance", "seed", F.explode(F.array_compact(patterns)).alias("pattern")) \
        .groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def accepted_instances(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance) of the unseen identifiers that reliable patterns support."""
    edges = keep(_edges(rows), "pattern_instances")
    conf = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("conf", F.lit(0.0)))
    score = None
    for _ in range(rounds):
        now = edges.withColumn("conf", F.lit(0.0)) if score is None else edges.join(score, "instance", "left")
        patterns = keep(now.groupBy("pattern").agg(
            (F.sum(conf) / (F.count(F.lit(1)) + PSEUDO)).alias("trust"), F.count(F.lit(1)).alias("n"))
            .where(f"n >= {LEAST_INSTANCES}").select("pattern", "trust"), "patterns")
        score = keep(edges.where("not seed").join(patterns, "pattern").groupBy("instance").agg(
            F.avg("trust").alias("conf"), F.count_if(F.col("trust") >= RELIABLE).alias("reliable")), "instances")
        last, score = score, score.select("instance", "conf")
    return last.where(f"reliable >= {LEAST_PATTERNS} and conf >= {ACCEPT}").select("instance")


def find(extracted: DataFrame) -> DataFrame:
    """Extracted rows with ``_base`` and ``_found`` (base and contextual spans,
    sorted by start, then kind). The rows are stored once."""
    rows = keep(extracted, "pii")
    seen = rows.select("_row", F.explode("_other").alias("x")).withColumn("instance", _instance(F.col("x")))
    extra = seen.join(accepted_instances(rows), "instance").groupBy("_row").agg(F.collect_list("x").alias("_more"))
    # rows without a candidate need no join, so their texts are not shuffled
    bare = rows.where(F.size("_other") == 0).withColumn("_more", F.lit(None).cast(_SPANS))
    out = rows.where(F.size("_other") > 0).join(extra, "_row", "left").unionByName(bare).drop("_row", "_other")
    base = F.concat("_base", F.coalesce("_more", F.array().cast(_SPANS)))
    slim = F.transform(base, lambda x: F.struct(x["s"], x["rank"], x["e"], x["kind"]))
    return out.withColumn("_found", F.array_sort(slim)).drop("_more")


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts per kind, digest of base spans, all spans."""
    rows = extract(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    found = find(rows)
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("_found", lambda x: x["kind"] != CONTEXT)
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_digest(base), 256).alias("base_sha256"),
                        _digest(F.col("_found")).alias("spans"))


CUT = 4096                # characters per block of a text that is cut


def _cut(start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of the text whose blocks are ``blocks``: work in proportion to them, not to their place."""
    first, last = (start / CUT).cast("int"), ((end - 1) / CUT).cast("int")
    part = lambda k: F.substring(F.get(F.col("blocks"), k), F.greatest(start - k * CUT, F.lit(0)) + 1,
                                 F.least(end - k * CUT, F.lit(CUT)) - F.greatest(start - k * CUT, F.lit(0)))
    return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all columns, with every span replaced by ``[KIND]``; touching or overlapping
    spans are replaced from the first start on, each character once."""
    rest = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("no other column")).alias("row")   # names of the caller never meet ours
    found = find(extract(docs.select(row, F.col(f"`{text}`").cast("string").alias("text"))))
    size = F.length("text")
    blocks = F.when(F.size("_found") > 0, F.transform(
        F.sequence(F.lit(0), (size / CUT).cast("int")), lambda k: F.substring(F.col("text"), k * CUT + 1, F.lit(CUT))))
    of = lambda k: F.filter("_found", lambda x: x["kind"] == k)
    found = found.select("row", "text", "_found", blocks.alias("blocks"), *[of(k).alias(f"_f_{k}") for k in (*KINDS, CONTEXT)])
    # what is written up to a span ends with the furthest end of the spans before it, each kind's last one
    at = lambda x: F.greatest(*[_last_end(f"_f_{k}", x["s"] + F.when(F.lit(_RANK[k]) < x["rank"], 1).otherwise(0)) for k in _RANK])
    marks = F.transform("_found", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), at(x).alias("at")))
    found = found.withColumn("marks", F.filter(marks, lambda x: x["s"] >= x["at"]))
    parts = F.transform("marks", lambda x: F.concat(_cut(x["at"], x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    end = F.greatest(*[F.coalesce(F.get(F.col(f"_f_{k}"), F.size(f"_f_{k}") - 1)["e"], F.lit(0)) for k in _RANK])
    out = F.concat(F.array_join(parts, ""), _cut(end, size))
    out = found.withColumn("text", F.when(F.size("_found") > 0, out).otherwise(F.col("text")))
    return out.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
