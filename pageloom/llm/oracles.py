"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import quality as Q

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _without(chars: str) -> str:
    return f"length(translate(t, {chars}, ''))"


def _bad(rule: str) -> str:
    """Host verdict of one rule from counts (n, f_rule) and the sums over all hosts."""
    f, m = f"f_{rule}", f"(t_{rule} / a)"
    rho = (f"(((q_{rule} - t_{rule} * {m}) / nullif({m} * (1 - {m}), 0) - (hosts - 1)) "
           f"/ nullif(a - n2 / a - (hosts - 1), 0))")
    s = f"CASE WHEN {rho} > 0 THEN greatest({Q.MIN_STRENGTH}, least({Q.MAX_STRENGTH}, 1 / {rho} - 1)) ELSE {Q.MAX_STRENGTH} END"
    rate, rest = f"(({f} + {m} * ({s})) / (n + ({s})))", f"coalesce((t_{rule} - {f}) / nullif(a - n, 0), {m})"
    return f"({f} > 0 AND {rate} >= {Q.HOST_RATE} AND {rate} * (1 - {rest}) >= {Q.HOST_ODDS} * {rest} * (1 - {rate})) AS bad_{rule}"


OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format('t')} AS ws,
        list_filter(string_split(t, chr(10)), lambda x: translate(x, {_SPACES}, '') <> '') AS lines FROM d),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i : i + {Q.WINDOW - 1}]) AS c
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {Q.WINDOW - 2})) AS i FROM w)),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM win, (SELECT unnest(range({Q.WINDOW})) AS k) WHERE c > 1 GROUP BY rid),
c AS (SELECT rid, doc_id, source, len(ws)::BIGINT AS n_words, {_without(_SPACES)}::BIGINT AS word_chars,
        (length(t) - {_without("'#*$%&|<>'")})::BIGINT AS n_symbols, len(lines) AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        length(t) - {_without(f"'{_UPPER}'")} AS caps
      FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PCT} * n_words AS base_failed,
        100 * n_symbols > {Q.SYMBOL_PCT} * word_chars AS x_symbols, 100 * n_dup_lines > {Q.DUP_LINE_PCT} * n_lines AS x_dup_lines,
        word_chars < {Q.WORD_CHARS[0]} * n_words OR word_chars > {Q.WORD_CHARS[1]} * n_words AS x_word_length,
        100 * caps > {Q.CAPS_PCT} * word_chars AS x_capitals FROM c),
h AS (SELECT source AS host, count(*) AS n, {", ".join(f"sum(x_{x}::INT) AS f_{x}" for x in Q.RULES)} FROM r GROUP BY source),
p AS (SELECT sum(n)::DOUBLE AS a, count(*) AS hosts, sum(n * n::DOUBLE) AS n2,
        {", ".join(f"sum(f_{x})::DOUBLE AS t_{x}, sum(f_{x} * f_{x}::DOUBLE / n) AS q_{x}" for x in Q.RULES)} FROM h),
b AS (SELECT host, {", ".join(_bad(x) for x in Q.RULES)} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"(x_{x} AND bad_{x})" for x in Q.RULES)}) AS kept
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.host
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.c + b.c - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON r.other = e.x),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

#: Exact neighbours; the index probes all of a small table.
OP1 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)
        / (sqrt(list_inner_product(d.e, d.e)) * sqrt(list_inner_product(q.e, q.e))) AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM x)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES = {"op1_rabitq_neighbours": OP1, "op4_quality_rules": OP4, "op7_minhash_near_dedup": OP7}
