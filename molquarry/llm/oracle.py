"""SQL equivalents of the queries of this folder, for DuckDB over the same tables. They look at all pairs,
so they are for small tables only."""

from __future__ import annotations

from molquarry.llm import quality

FIELDS = ("ligand", "additive", "base", "aryl_halide")


def _value(field: str) -> str:
    trimmed = f"trim({field}, ' ' || chr(9))"
    return f"CASE WHEN {trimmed} NOT IN ('', 'NA', 'nan', 'ValueNotFound') THEN {trimmed} END AS {field}"


def _records(fields: tuple[str, ...]) -> str:
    """d: the records with their values; v: the distinct values of each field."""
    return (
        f"d AS (SELECT row_id, sheet_name, lower(trim(split_name, ' ' || chr(9))) AS s, {', '.join(map(_value, fields))} FROM dreher_dataset), "
        f"v AS (SELECT DISTINCT field, value FROM (SELECT unnest([{', '.join(repr(f) for f in fields)}]) AS field, unnest([{', '.join(fields)}]) AS value FROM d) WHERE value IS NOT NULL)"
    )


def _classes(fields: tuple[str, ...], links: str) -> str:
    """c: the class of each value by the closure of l (field, x, y); k: the records whose values are all present."""
    joins = " ".join(f"JOIN c c{i} ON c{i}.field = '{f}' AND c{i}.value = d.{f}" for i, f in enumerate(fields))
    picked = ", ".join(f"c{i}.class AS k{i}" for i in range(len(fields)))
    return (
        f"l AS ({links}), r AS (SELECT field, value AS x, value AS y FROM v UNION SELECT r.field, r.x, l.y FROM r JOIN l ON r.field = l.field AND r.y = l.x), "
        "c AS (SELECT field, x AS value, min(y) AS class FROM r GROUP BY field, x), "
        f"k AS (SELECT d.*, {picked} FROM d {joins})"
    )


NEAR = "SELECT a.field, a.value AS x, b.value AS y FROM v a JOIN v b ON a.field = b.field AND a.value <> b.value AND abs(length(a.value) - length(b.value)) <= 4 WHERE levenshtein(a.value, b.value) <= 4"
GRAMS = (
    "g AS (SELECT DISTINCT field, value, substr(value, i, 3) AS g FROM (SELECT field, value, unnest(range(1, greatest(1, length(value) - 1))) AS i FROM v)), "
    "n AS (SELECT field, value, count(*) AS n FROM g GROUP BY field, value), "
)
ALIKE = (
    "SELECT p.field, p.x, p.y FROM (SELECT a.field, a.value AS x, b.value AS y, count(*) AS k FROM g a JOIN g b ON a.field = b.field AND a.g = b.g AND a.value <> b.value GROUP BY a.field, a.value, b.value) p "
    "JOIN n s ON s.field = p.field AND s.value = p.x JOIN n t ON t.field = p.field AND t.value = p.y WHERE 3 * p.k >= s.n + t.n - p.k"
)
KEYS = {n: ", ".join(f"k{i}" for i in range(n)) for n in (2, 4)}

WORDS = r"""
WITH c AS (SELECT doc_id, l FROM (SELECT doc_id, trim(l, ' ' || chr(9) || chr(13)) AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL))
  WHERE l <> '' AND NOT regexp_full_match(l, '[0-9]+') AND NOT contains(l, '-->')),
e AS (SELECT doc_id, count(*) AS n_lines, sum((right(l, 1) IN ('.', '!', '?', '…'))::INT) AS ended_lines, sum(contains('-*•·–—‣▪●○◦►', left(l, 1))::INT) AS bullet_lines FROM c GROUP BY doc_id),
w AS (SELECT doc_id, unnest(regexp_extract_all(l, '[^ \t\r\n]+')) AS w FROM c),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(length(regexp_replace(w, '[\p{L}0-9]', '', 'g'))) AS symbol_chars,
  sum((regexp_replace(lower(w), '^[^\p{L}]+|[^\p{L}]+$', '', 'g') IN (SELECT word FROM common_words))::INT) AS common_words FROM w GROUP BY doc_id)
"""

SQL: dict[str, str] = {
    "p2_found": """
WITH u AS (SELECT vec_id, field_name, list_transform(vec, lambda v: v::DOUBLE) AS vec FROM component_vectors
  WHERE field_name IS NOT NULL AND len(vec) = 48 AND len(list_filter(vec, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(vec, lambda v: v <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.vec, b.vec), 7) AS cosine FROM u a JOIN u b ON a.field_name = b.field_name AND a.vec_id <> b.vec_id),
n AS (SELECT x, y, cosine FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY cosine DESC, y) AS place FROM p) WHERE place <= 5)
SELECT a.x AS vec_id_a, a.y AS vec_id_b FROM n a JOIN n b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y AND a.cosine >= 0.95
""",
    "p4_found": f"""
WITH RECURSIVE {_records(FIELDS)}, {_classes(FIELDS, NEAR)}
SELECT least(t.row_id, e.row_id) AS row_id_a, greatest(t.row_id, e.row_id) AS row_id_b FROM k t JOIN k e USING ({KEYS[4]}) WHERE t.s = 'train' AND e.s IN ('valid', 'test')
""",
    "p4_report": f"""
WITH RECURSIVE {_records(FIELDS)}, {_classes(FIELDS, NEAR)},
t AS (SELECT {KEYS[4]}, count(*) AS n FROM k WHERE s = 'train' GROUP BY ALL), x AS (SELECT DISTINCT {", ".join(FIELDS)}, true AS hit FROM k WHERE s = 'train')
SELECT s AS split, sheet_name, count(*) AS records, count(n) AS overlapping, count(hit) AS exact, coalesce(sum(n), 0)::BIGINT AS pairs
FROM (SELECT * FROM k WHERE s IN ('valid', 'test')) LEFT JOIN t USING ({KEYS[4]}) LEFT JOIN x USING ({", ".join(FIELDS)}) GROUP BY s, sheet_name
""",
    "p4_coverage": f"""
WITH RECURSIVE {_records(FIELDS)}, {_classes(FIELDS, NEAR)},
f AS (SELECT unnest([{", ".join(repr(f) for f in FIELDS)}]) AS field, unnest([{", ".join(FIELDS)}]) AS value, s FROM d),
h AS (SELECT DISTINCT field, value, length(value) AS n FROM f WHERE s IN ('valid', 'test') AND value IS NOT NULL), t AS (SELECT DISTINCT field, value, length(value) AS m FROM f WHERE s = 'train' AND value IS NOT NULL),
p AS (SELECT field, value, n, i, i * n // 5 AS low, (i + 1) * n // 5 - i * n // 5 AS size FROM h, range(5) x(i) WHERE n > 4),
e AS (SELECT DISTINCT p.field, p.value, i, size FROM p JOIN t ON t.field = p.field AND abs(m - n) <= 4, range(-4, 5) y(shift)
  WHERE abs(shift) <= i AND abs(m - n - shift) <= 4 - i AND low + shift >= 0 AND low + shift + size <= m AND substr(t.value, low + shift + 1, size) = substr(p.value, low + 1, size)),
z AS (SELECT h.field, h.value, n, CASE WHEN t.value IS NOT NULL THEN n ELSE coalesce(c, 0) END AS c FROM h LEFT JOIN t USING (field, value) LEFT JOIN (SELECT field, value, sum(size) AS c FROM e GROUP BY field, value) USING (field, value)),
o AS (SELECT {KEYS[4]}, count(*) AS copies FROM k WHERE s = 'train' GROUP BY ALL)
SELECT row_id, s AS split, sheet_name, ({" + ".join(f"z{i}.c" for i in range(4))}) / ({" + ".join(f"z{i}.n" for i in range(4))}) AS coverage, coalesce(copies, 0) AS copies
FROM (SELECT * FROM k WHERE s IN ('valid', 'test')) k LEFT JOIN o USING ({KEYS[4]}) {" ".join(f"JOIN z z{i} ON z{i}.field = '{f}' AND z{i}.value = k.{f}" for i, f in enumerate(FIELDS))}
""",
    "p5_found": f"""
WITH RECURSIVE {_records(FIELDS[:2])}, {_classes(FIELDS[:2], NEAR)}
SELECT min(row_id) AS entity_row_id FROM k WHERE s IS NOT NULL GROUP BY {KEYS[2]} HAVING count(DISTINCT s) > 1
""",
    "p6_found": f"""
WITH RECURSIVE {_records(FIELDS[:2])}, {GRAMS} {_classes(FIELDS[:2], ALIKE)}
SELECT cluster_row_id, row_id FROM (SELECT row_id, min(row_id) OVER w AS cluster_row_id, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY {KEYS[2]})) WHERE n > 1
""",
    "p5_linked": f"""
WITH RECURSIVE d AS (SELECT row_id, {", ".join(map(_value, FIELDS))} FROM dreher_dataset),
e AS (SELECT row_id, 'p' || ligand || '|' || additive AS p, 'q' || additive || '|' || aryl_halide AS q FROM d),
n AS (SELECT DISTINCT p, q FROM e WHERE p IS NOT NULL AND q IS NOT NULL), m AS (SELECT p AS x, q AS y FROM n UNION ALL SELECT q, p FROM n),
r AS (SELECT DISTINCT x, x AS y FROM m UNION SELECT r.x, m.y FROM r JOIN m ON r.y = m.x), c AS (SELECT x, min(y) AS class FROM r GROUP BY x)
SELECT row_id, min(row_id) OVER (PARTITION BY coalesce(class, p, q, 'r' || row_id)) AS first_row_id FROM e LEFT JOIN c ON c.x = coalesce(p, q)
""",
    "p9_quality": WORDS + rf"""
, q AS (SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n_lines, 0) AS n_lines, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(symbol_chars, 0)::BIGINT AS symbol_chars,
  coalesce(common_words, 0)::BIGINT AS common_words, coalesce(ended_lines, 0)::BIGINT AS ended_lines, coalesce(bullet_lines, 0)::BIGINT AS bullet_lines, word_chars / n_words AS mean_word_length, symbol_chars / word_chars AS symbol_ratio,
  common_words / n_words AS common_share, ended_lines / n_lines AS ended_share, bullet_lines / n_lines AS bullet_share FROM documents LEFT JOIN e USING (doc_id) LEFT JOIN s USING (doc_id)),
z AS (SELECT *, list_filter([CASE WHEN symbol_ratio > {quality.MAX_SYMBOLS} THEN 'symbols' END, CASE WHEN common_share < {quality.MIN_COMMON} THEN 'uncommon_words' END, CASE WHEN ended_share < {quality.MIN_ENDED} THEN 'unfinished_lines' END,
  CASE WHEN mean_word_length < {quality.WORD_LENGTHS[0]} OR mean_word_length > {quality.WORD_LENGTHS[1]} THEN 'word_length' END], lambda x: x IS NOT NULL) AS g FROM q)
SELECT * EXCLUDE (g), array_to_string(g, ',') AS signs, n_words >= {quality.MIN_WORDS} AND len(g) >= {quality.MIN_SIGNS} AS is_case FROM z
""",
    "p9_found": WORDS + """
SELECT doc_id FROM s JOIN e USING (doc_id) WHERE n_words >= 5
  AND (symbol_chars / word_chars > 0.22)::INT + (common_words / n_words < 0.15)::INT + (ended_lines / n_lines < 0.25)::INT + (word_chars / n_words < 2.8 OR word_chars / n_words > 8.0)::INT >= 2
""",
}
