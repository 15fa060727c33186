"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from trajlake.llm.quality_rules import ALPHA, DELTA, RULES, WORTH

_GRID = ", ".join(f"('{rule}', {i}, {cut})" for rule, grid in RULES.items() for i, cut in enumerate(grid))
_ORDER = ", ".join(f"('{rule}', {i})" for i, rule in enumerate(RULES))
_BUDGET = f"({ALPHA} / {len(RULES)})"

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
 g AS (SELECT rid, u.i AS i, array_to_string(ws[u.i : u.i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) u(i) WHERE len(ws) >= 8),
 c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g),
 p AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM c WHERE n > 1),
 rep AS (SELECT rid, CAST(sum(least(8, i - coalesce(before, -8))) AS BIGINT) AS n_repeat_words FROM p GROUP BY rid),
 s AS (SELECT w.rid, doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.rid = w.rid),
 v AS (SELECT rid, doc_id, stratum, unnest([
  {{'rule': 'symbols_per_word', 'x': n_symbols / greatest(n_words, 1)}}, {{'rule': 'capital_share', 'x': n_capitals / greatest(word_chars, 1)}}, {{'rule': 'duplicate_line_share', 'x': n_dup_lines / greatest(n_lines, 1)}},
  {{'rule': 'repeated_word_share', 'x': n_repeat_words / greatest(n_words, 1)}}, {{'rule': 'long_words', 'x': word_chars / greatest(n_words, 1)}}, {{'rule': 'short_words', 'x': -(word_chars / greatest(n_words, 1))}}], recursive := true) FROM s),
 marks AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
 pts AS (SELECT stratum, gr.rule, step, cutoff, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND x > cutoff) AS k, count(*) FILTER (q = 0 AND x > cutoff) AS b
  FROM v JOIN marks ON marks.doc_id = v.doc_id JOIN (VALUES {_GRID}) gr(rule, step, cutoff) ON gr.rule = v.rule GROUP BY ALL),
 tail AS (SELECT *, CASE WHEN n = 0 OR k >= n * {_BUDGET} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
   lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_BUDGET}) + (n - j) * ln(1 - {_BUDGET})))) END AS p_value, (SELECT count(DISTINCT stratum) FROM pts) AS strata FROM pts),
 walk AS (SELECT *, bool_and(p_value <= {DELTA} / (strata * {len(RULES)})) OVER (PARTITION BY stratum, rule ORDER BY step ROWS UNBOUNDED PRECEDING) AS certified FROM tail),
 best AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY b - {WORTH} * k DESC, step) AS place FROM walk WHERE certified AND b > {WORTH} * k) WHERE place = 1),
 failed AS (SELECT rid, string_agg(v.rule, ',' ORDER BY o.place) AS rules_failed FROM v JOIN best ON best.stratum = v.stratum AND best.rule = v.rule JOIN (VALUES {_ORDER}) o(rule, place) ON o.rule = v.rule WHERE x > cutoff GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND rules_failed IS NULL AS kept, coalesce(rules_failed, '') AS rules_failed
FROM s LEFT JOIN failed ON failed.rid = s.rid"""

def _code_rounds(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Codebooks and codes of ``embeddings``, a group of tables for each round."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, (k - 1) // w AS part, (k - 1) % w AS place, floor(1024 * v[k])::BIGINT AS c
  FROM (SELECT vec_id, v, w, unnest(range(1, len(v) + 1)) AS k FROM kept)),
book0 AS MATERIALIZED (SELECT part, r.entry, place, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) r USING (vec_id))"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT vec_id, part, min(far) AS far, arg_min(entry, (far, entry)) AS entry
  FROM (SELECT x.vec_id, part, b.entry, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS far FROM x JOIN book{k} b USING (part, place) GROUP BY ALL) GROUP BY ALL)"""
        )
        if k < rounds:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (SELECT part, b.entry, place, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.c)::BIGINT AS c
  FROM book{k} b LEFT JOIN (SELECT part, n.entry, place, sum(x.c)::BIGINT AS s, count(*) AS n FROM near{k} n JOIN x USING (vec_id, part) GROUP BY ALL) m USING (part, entry, place))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
codes AS (SELECT vec_id, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)"""
    )


#: Turns of equal number come by the digest of role and text.  crc32 is not among DuckDB's functions: eight shifts for each
#: bit of a digit, written as a table of 256 values and a walk over the decimal digits.
PREFIX_TRIE = """
WITH RECURSIVE bits AS (SELECT range AS i, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT i, v FROM bits WHERE k = 8),
digits AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 4294967295::BIGINT AS c, 0 AS k FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, s, xor(c >> 8, v), k + 1 FROM digits JOIN crc ON i = xor(c, ascii(s[k + 1])) & 255 WHERE k < len(s)),
ids AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(c, 4294967295) % 6 AS h FROM digits WHERE k = len(s)),
raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS MATERIALIZED (SELECT conv_id, sha256(length(role) || ':' || role || text) AS content, length(text) AS n_chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS k FROM raw),
lead AS (SELECT ids.conv_id, ids.base, h, least(h, coalesce(n, 0)) AS n FROM ids LEFT JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY ALL) c ON c.conv_id = ids.base),
turns AS (SELECT l.conv_id, t.k AS depth, content, n_chars FROM lead l JOIN t ON t.conv_id = l.base AND t.k <= l.n
  UNION ALL SELECT l.conv_id, t.k - l.h + l.n, content, n_chars FROM lead l JOIN t ON t.conv_id = l.conv_id AND t.k > l.h),
paths AS (SELECT conv_id, depth, n_chars, string_agg(content, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path),
nodes AS MATERIALIZED (SELECT path, depth, left(path, greatest(0, len(path) - 64)) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(n_chars) AS n_chars FROM paths GROUP BY path, depth),
children AS MATERIALIZED (SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
steps AS (SELECT path, unnest(range(0, depth + 1)) AS d, (n_convs - 1) * n_chars AS saved, c.n IS NULL AS leaf FROM nodes LEFT JOIN children c ON c.above = nodes.path),
sums AS (SELECT left(path, 64 * d) AS path, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM steps GROUP BY ALL)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, CASE WHEN nodes.depth > 0 THEN p.conv_id END AS parent_conv_id, nodes.n_convs, coalesce(c.n, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN children c ON c.above = nodes.path LEFT JOIN nodes p ON p.path = nodes.above"""

ORACLE_SQL = {"op3_quality_rules": QUALITY_RULES,
    "op11_vector_codes": _code_rounds(),
    "op12_prefix_trie": PREFIX_TRIE,
}
