"""DuckDB SQL for the queries of this package that SQL can express, written apart from the Spark code."""

from __future__ import annotations

_FOLDED = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP3 = f"""
WITH dw AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS w FROM benchmark),
iwin AS (
  SELECT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
),
dwin AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM dw, (SELECT DISTINCT size FROM iwin) WHERE len(w) >= size)
),
hits AS (SELECT doc_id, i, dwin.size, item FROM dwin JOIN iwin ON dwin.g = iwin.g AND dwin.size = iwin.size),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids
  FROM hits GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN covered ON covered.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id
"""

# Votes of the quality rules: a condition, and what is believed of its share among good and bad documents.
_MERIT, _DEFECT = (0.7, 0.5), (0.005, 0.3)
_VOTES = [
    ("n_words >= 50", _MERIT),
    ("n_symbols = 0 AND n_dup_lines = 0", _MERIT),
    ("n_words < 10", _DEFECT),
    ("word_chars / words < 2 OR word_chars / words > 20", _DEFECT),
    ("n_symbols * 10 > words", _DEFECT),
    ("n_symbols * 20 > chars", _DEFECT),
    ("n_dup_lines > 1 AND n_dup_lines * 10 > 3 * greatest(n_lines, 1)", _DEFECT),
    ("100 * n_repeat_words > 20 * words", _DEFECT),
    ("n_upper * 2 > chars", _DEFECT),
    ("n_shouts * 5 > words", _DEFECT),
    ("n_digits * 3 > chars", _DEFECT),
]
_RULES = range(len(_VOTES))
_ODDS = "prior + " + " + ".join(f"CASE WHEN v{k} THEN yes{k} ELSE no{k} END" for k in _RULES)
_START = ", ".join(f"ln({g} / {b}::DOUBLE) AS yes{k}, ln({1 - g} / {1 - b}::DOUBLE) AS no{k}" for k, (_, (g, b)) in enumerate(_VOTES))
_NEXT = ", ".join(
    f"ln((g{k} + {g} * x) / (good + x)) - ln((a{k} - g{k} + {b} * x) / (bad + x)), "
    f"ln((good - g{k} + {1 - g} * x) / (good + x)) - ln((bad - a{k} + g{k} + {1 - b} * x) / (bad + x))"
    for k, (_, (g, b)) in enumerate(_VOTES)
)
_ROUNDS = 150

OP5 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)
),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT grams.doc_id, unnest(range(i, i + 5)) AS k FROM grams JOIN twice ON grams.doc_id = twice.doc_id AND grams.g = twice.g
  ) GROUP BY doc_id
),
c AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(l) AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper,
    len(regexp_extract_all(text, '[!?]{{2,}}')) AS n_shouts, len(regexp_extract_all(text, '\p{{Nd}}')) AS n_digits,
    greatest(len(w), 1) AS words, greatest(length(array_to_string(w, '')), 1) AS chars
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
),
v AS (SELECT *, {", ".join(f"({condition}) AS v{k}" for k, (condition, _) in enumerate(_VOTES))} FROM c),
p AS (SELECT {", ".join(f"v{k}" for k in _RULES)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
em AS (
  SELECT 0 AS r, ln(0.8 / 0.2::DOUBLE) AS prior, {_START}
  UNION ALL
  SELECT r + 1, ln((good + 0.8 * x) / (bad + 0.2 * x)), {_NEXT}
  FROM (
    SELECT r, sum(n * q) AS good, sum(n * (1 - q)) AS bad, 0.25 * sum(n) AS x,
      {", ".join(f"sum(CASE WHEN v{k} THEN n * q ELSE 0 END) AS g{k}, sum(CASE WHEN v{k} THEN n ELSE 0 END) AS a{k}" for k in _RULES)}
    FROM (SELECT r, p.*, 1 / (1 + exp(-({_ODDS}))) AS q FROM em, p WHERE r < {_ROUNDS}) GROUP BY r
  )
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND ({_ODDS}) >= 0 AS kept
FROM v, (SELECT * FROM em WHERE r = {_ROUNDS})
"""


def _whole(scale: int, condition: str = "true") -> str:
    """Vectors with finite components only, as whole numbers."""
    return f"""(
  SELECT vec_id, list_transform(v, lambda c: CAST(floor({scale} * c) AS BIGINT)) AS x
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND {condition}
)"""


OP12 = f"""
WITH v AS MATERIALIZED {_whole(64)}
SELECT q.vec_id AS query_id,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id AS vec_id, s AS score
FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id,
  LATERAL (SELECT CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS s)
WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20
"""


def _rounds(many: int) -> str:
    """Lloyd's rounds, one pair of tables after another: a{r} assigns by the centroids m{r - 1}, m{r} moves them."""
    out = []
    for r in range(1, many + 2):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, vec_id, x, best[2] AS cluster, best[1] AS distance FROM (
    SELECT rid, any_value(vec_id) AS vec_id, any_value(v.x) AS x,
      list_min(list([list_sum(list_transform(v.x, lambda e, i: (e - m.x[i]) * (e - m.x[i])))::BIGINT, m.cluster])) AS best
    FROM v, m{r - 1} AS m GROUP BY rid)
)""")
        if r <= many:
            out.append(f"""m{r} AS MATERIALIZED (
  SELECT m.cluster, coalesce(new.x, m.x) AS x FROM m{r - 1} AS m LEFT JOIN (
    SELECT cluster, list(CAST((total - ((total % many) + many) % many) / many AS BIGINT) ORDER BY pos) AS x FROM (
      SELECT cluster, pos, CAST(sum(e) AS BIGINT) AS total, count(*) AS many
      FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM a{r}) GROUP BY cluster, pos
    ) GROUP BY cluster) AS new ON new.cluster = m.cluster
)""")
    return ",\n".join(out)


OP13 = f"""
WITH v AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM {_whole(1024, "len(v) = 64")}),
m0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, vec_id, x) - 1 AS BIGINT) AS cluster, x
  FROM (SELECT *, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM v) ORDER BY h, vec_id, x LIMIT 8
),
{_rounds(10)}
SELECT vec_id, CAST(a11.cluster AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY a11.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m10.x, ',')) AS centroid_sha256
FROM a11 JOIN m10 ON a11.cluster = m10.cluster
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3, "op5_quality": OP5, "op12_topk": OP12, "op13_cluster": OP13}
