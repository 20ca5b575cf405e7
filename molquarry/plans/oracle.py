"""SQL equivalents of the core queries, for DuckDB over the same tables."""

from __future__ import annotations

from molquarry.functions.tokens import PATTERN, VOCABULARY
from molquarry.operators.encoders import HEAVY_ATOM, WEIGHTS
from molquarry.plans.queries import PATTERNS, PRIORITIES

EVENTS = "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events)"
ORDERS = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)"
VALID = "{0} IS NOT NULL AND {0} NOT IN ('NA', 'nan', 'ValueNotFound')"


def h32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def bits(least: float = 0.15) -> str:
    return f"(SELECT vec_id, label, list_transform(embedding, lambda x: (x::DOUBLE > {least})::INT) AS bits FROM embeddings)"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _replace_count(pattern: str) -> str:
    return f"coalesce((length(smiles) - length(replace(smiles, '{pattern}', ''))) // {len(pattern)}, 0)"


YP = "(SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"
BINARY = "(SELECT (l_returnflag = 'R')::INT AS y, (l_discount > 0.05)::INT AS p FROM lineitem)"
CELLS = "(SELECT sum(y * p)::DOUBLE AS tp, sum(y * (1 - p))::DOUBLE AS fn, sum((1 - y) * p)::DOUBLE AS fp, sum((1 - y) * (1 - p))::DOUBLE AS tn FROM " + BINARY + ")"
LABELS = "(SELECT l_returnflag AS y, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p FROM lineitem)"
RATES = (
    "(SELECT label, sum((y = label AND p = label)::INT)::DOUBLE AS tp, sum((y = label AND p <> label)::INT)::DOUBLE AS fn, "
    "sum((y <> label AND p = label)::INT)::DOUBLE AS fp, sum((y <> label AND p <> label)::INT)::DOUBLE AS tn "
    f"FROM {LABELS}, (SELECT y AS label FROM {LABELS} UNION SELECT p FROM {LABELS}) GROUP BY label)"
)
ROC = "(SELECT value AS score, sum((event_type = 'purchase')::INT) AS pos, sum((event_type <> 'purchase')::INT) AS neg FROM events GROUP BY value)"
ROC_SUMS = f"(SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {ROC} WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"
FOLDS = f"(SELECT fold, avg(abs(value - 50.0)) AS mae, avg((value - 50.0) * (value - 50.0)) AS mse FROM (SELECT *, floor(row_id * 5 / (SELECT count(*) FROM events))::INT AS fold FROM {EVENTS}) GROUP BY fold)"
DUPS = "l_quantity, l_discount, l_returnflag, l_linestatus"
SIZES = f"(SELECT {DUPS}, count(*) AS size FROM lineitem GROUP BY {DUPS})"
SCORES = "(SELECT o_orderstatus AS member, o_orderpriority AS dataset, round(avg(o_totalprice) / 1000 - 150, 6) AS score FROM orders GROUP BY 1, 2)"
TOKENS = f"CASE WHEN smiles IS NOT NULL THEN regexp_extract_all(smiles, '{PATTERN}', 1) END"
ROOM = f"(SELECT max(len({TOKENS})) + 2 FROM lipophilicity)::BIGINT"
_ids = f"list_transform(t, lambda w: coalesce(list_position({_list(VOCABULARY)}, w) - 1, 2))"


def fitness(weighting: str) -> str:
    value, source = "score", SCORES
    if weighting.startswith("norm_max"):
        source = f"(SELECT *, max(score) OVER (PARTITION BY dataset) AS top FROM {SCORES})"
        value = "(score / CASE WHEN top > 0 THEN top ELSE 1.0 END)"
    elif weighting.startswith("norm_asList"):
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITIES.items())
        value = f"(score / CASE dataset {cases} END)"
    if weighting.endswith("_pow"):
        value = f"(sign({value}) * {value} * {value})"
    return f"SELECT member, round(avg({value}), 5) AS fitness FROM {source} GROUP BY member"


def fingerprint(column: str, n_bits: int, gram: int) -> str:
    g = f"list_transform(range(1, greatest(1, length(coalesce({column}, '')) - {gram - 2})), lambda i: ('0x' || substr(md5(substr({column}, i, {gram})), 1, 8))::BIGINT % {n_bits})"
    return f"array_to_string(list_transform(range({n_bits}), lambda b: list_contains({g}, b)::INT), '')"


REACTION_BITS = """
WITH r AS (SELECT row_id, concat_ws('.', aryl_halide, ligand) || '>' || concat_ws('.', base) || '>' || concat_ws('.', additive) AS x FROM dreher_dataset),
g AS (SELECT DISTINCT row_id, substr(x, i, 3) AS g FROM (SELECT row_id, x, unnest(range(1, greatest(1, length(x) - 1))) AS i FROM r)),
h AS (SELECT g, ('0x' || substr(md5(g), 1, 8))::BIGINT % 2048 AS b FROM (SELECT DISTINCT g FROM g)),
s AS (SELECT row_id, bitstring_agg(b::INT, 0, 2047)::VARCHAR AS bits FROM g JOIN h USING (g) GROUP BY row_id)
SELECT row_id, coalesce(bits, repeat('0', 2048)) AS bits FROM r LEFT JOIN s USING (row_id)
"""
_cases = " ".join(f"WHEN '{e.lower()}' THEN {w}::DOUBLE" for e, w in WEIGHTS.items())
_weight = rf"coalesce(list_sum(list_transform(regexp_extract_all(smiles, '{HEAVY_ATOM}', 1), lambda a: CASE lower(regexp_replace(a, '[\[0-9]', '', 'g')) {_cases} ELSE 0.0::DOUBLE END)), 0.0::DOUBLE)"

BRACKET = r"\[[0-9]*(?:[A-Z][a-z]?|[bcnops])@{0,2}(?:H[0-9]?)?(?:[+-][0-9]?)?\]"
ATOMS = rf"(?:{BRACKET}|Cl|Br|[BCNOPSFIbcnops]|[-=#:/\\.]|[()]|%[0-9][0-9]|[0-9])+"


def invalid(value: str, optional: bool) -> str:
    """Whether a field's trimmed value is missing (unless it may be) or no well-formed compound."""
    bare = f"regexp_replace({value}, '{BRACKET}', 'X', 'g')"
    turns = f"list_transform(string_split(regexp_replace({bare}, '[^()]', '', 'g'), ''), lambda c: CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)"
    depth = f"list_min(list_transform(range(1, len({turns}) + 1), lambda i: list_sum(({turns})[1:i])))"
    rings = f"regexp_extract_all({bare}, '%[0-9][0-9]|[0-9]')"
    even = f"len(list_filter({rings}, lambda x: len(list_filter({rings}, lambda y: y = x)) % 2 = 1)) = 0"
    sound = f"(regexp_full_match({value}, '{ATOMS}') AND NOT contains({bare}, '()') AND coalesce(list_sum({turns}), 0) = 0 AND coalesce({depth}, 0) >= 0 AND {even})"
    missing = f"{value} IN ('', 'NA', 'nan', 'ValueNotFound')"
    return f"(NOT {missing} AND NOT {sound})" if optional else f"({missing} OR NOT {sound})"


P1_LINES = f"""
WITH l AS (SELECT line_id, CASE WHEN ends_with(raw_line, chr(13)) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS x FROM dreher_raw WHERE line_no > 1),
q AS (SELECT line_id, x, regexp_full_match(x, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS quoted FROM l),
f AS (SELECT line_id, quoted, CASE WHEN quoted THEN regexp_extract_all(x || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1) ELSE [] END AS raw FROM q),
v AS (SELECT line_id, quoted, len(raw) AS n, list_transform(raw, lambda r: CASE WHEN starts_with(r, '"') THEN replace(r[2:-2], '""', '"') ELSE r END) AS u FROM f),
w AS (SELECT *, list_transform(u, lambda r: trim(r, ' ' || chr(9))) AS t FROM v),
r AS (SELECT line_id, u, t, CASE WHEN quoted IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN n <> 5 THEN 'columns' WHEN {" OR ".join(invalid(f"t[{i}]", i == 2) for i in (1, 2, 3, 4))} THEN 'value' END AS reason FROM w)
"""
P1_FOUND = P1_LINES + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL"
P1_LOADED = P1_LINES + r"""
SELECT line_id, t[1] AS ligand, CASE WHEN t[2] NOT IN ('', 'NA', 'nan', 'ValueNotFound') THEN t[2] END AS additive, t[3] AS base, t[4] AS aryl_halide,
  CASE WHEN regexp_full_match(replace(trim(u[5], ' '), ',', '.'), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN replace(trim(u[5], ' '), ',', '.')::DOUBLE END AS output_value
FROM r WHERE reason IS NULL
"""

DIVERSITY = """
WITH b AS (SELECT unnest([0, 1]) AS c, unnest([list_transform(embedding, lambda x: (x::DOUBLE > 0.15)::INT), list_transform(embedding, lambda x: (x::DOUBLE > 0.3)::INT)]) AS v FROM embeddings),
k AS (SELECT c, pos, x, count(*) AS k FROM (SELECT c, unnest(range(len(v))) AS pos, unnest(v) AS x FROM b) GROUP BY c, pos, x),
n AS (SELECT 2 * count(*) AS n FROM embeddings),
s AS (SELECT (sum(k * (k - 1)) + max(n))::BIGINT AS collisions, max(n)::DOUBLE AS n FROM k, n)
SELECT collisions, round(collisions / (n * n), 6) AS ratio, round(1 - abs(collisions / (n * n) - 0.5), 6) AS score FROM s
"""
STACK = """
WITH r AS (SELECT (l_discount > 0.05)::INT AS y, (l_quantity > 25)::INT AS p, l_quantity::DOUBLE AS s FROM lineitem),
c AS (SELECT sum(y * p)::DOUBLE AS tp, sum(y * (1 - p))::DOUBLE AS fn, sum((1 - y) * p)::DOUBLE AS fp, sum((1 - y) * (1 - p))::DOUBLE AS tn, count(*)::DOUBLE AS n,
  avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae, max(abs(y - p))::DOUBLE AS top, var_pop(y) AS vy, var_pop(y - p) AS ve FROM r),
q AS (SELECT s, sum(sum(y)) OVER w AS tp, sum(sum(1 - y)) OVER w AS fp, sum(y) AS pos, sum(1 - y) AS neg FROM r GROUP BY s WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
x AS (
SELECT unnest(['r2', 'mae', 'mse', 'max_error', 'explained_variance', 'accuracy', 'zero_one_loss', 'accuracy_count', 'hamming_loss', 'precision', 'recall', 'f1', 'jaccard', 'matthews', 'balanced_accuracy', 'specificity']) AS metric, NULL AS item,
  unnest([1 - mse / vy, mae, mse, top, 1 - ve / vy, (tp + tn) / n, 1 - (tp + tn) / n, tp + tn, (fp + fn) / n, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp / (tp + fp + fn),
    (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), (tp / (tp + fn) + tn / (tn + fp)) / 2, (tp / (tp + fn) + tn / (tn + fp)) / 2]) AS value FROM c
UNION ALL SELECT unnest(['recall_matrix', 'recall_matrix', 'specificity_matrix', 'specificity_matrix']), unnest(['1', '0', '1', '0']), unnest([tp / (tp + fn), tn / (tn + fp), tn / (tn + fp), tp / (tp + fn)]) FROM c
UNION ALL SELECT 'confusion_matrix', y || '/' || p, count(*)::DOUBLE FROM r GROUP BY y, p
UNION ALL SELECT 'roc_auc', NULL, sum(neg * (tp - pos / 2.0::DOUBLE))::DOUBLE / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) FROM q
UNION ALL SELECT 'roc_curve', printf('%.6f', s) || ':fpr', fp::DOUBLE / (SELECT sum(neg) FROM q)::DOUBLE FROM q
UNION ALL SELECT 'roc_curve', printf('%.6f', s) || ':tpr', tp::DOUBLE / (SELECT sum(pos) FROM q)::DOUBLE FROM q
UNION ALL SELECT 'roc_curve', unnest(['inf:fpr', 'inf:tpr']), 0.0::DOUBLE)
SELECT metric, item, round(value, 6) AS value FROM x
"""
NESTED = """
WITH r AS (SELECT l_orderkey AS k, l_extendedprice AS y, unnest([0, 1, 2, 3]) AS config, unnest([l_quantity::DOUBLE, l_tax::DOUBLE, l_quantity::DOUBLE, l_tax::DOUBLE]) AS x FROM lineitem),
h AS (SELECT r.*, o, i, (CASE WHEN o = 0 THEN k % 2 < 1 ELSE k % 2 >= 1 END) AS held, (CASE WHEN i = 0 THEN k % 4 < 2 ELSE k % 4 >= 2 END) AS tested FROM r, range(2) a(o), range(2) b(i)),
f AS (SELECT o, i, config, CASE WHEN config < 2 THEN regr_slope(y, x) ELSE sum(x * y) / sum(x * x) END AS b, CASE WHEN config < 2 THEN regr_intercept(y, x) ELSE 0 END AS a FROM h WHERE NOT held AND NOT tested GROUP BY o, i, config),
e AS (SELECT h.o, h.i, h.config, avg(abs(y - a - b * x)) AS mae FROM h JOIN f USING (o, i, config) WHERE NOT held AND tested GROUP BY h.o, h.i, h.config),
m AS (SELECT o, config, avg(mae) AS inner_mean FROM e GROUP BY o, config),
w AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY inner_mean, config) = 1 AS best FROM m),
g AS (SELECT o, config, CASE WHEN config < 2 THEN regr_slope(y, x) ELSE sum(x * y) / sum(x * x) END AS b, CASE WHEN config < 2 THEN regr_intercept(y, x) ELSE 0 END AS a FROM h WHERE i = 0 AND NOT held GROUP BY o, config),
t AS (SELECT h.o, h.config, avg(abs(y - a - b * x)) AS mae FROM h JOIN g USING (o, config) WHERE i = 0 AND held GROUP BY h.o, h.config)
SELECT o::INT AS outer, config::INT AS config, round(inner_mean, 4) AS inner_mean, CASE WHEN best THEN round(mae, 4) END AS outer_test, best FROM w JOIN t USING (o, config)
"""

SQL: dict[str, str] = {
    "p1_found": P1_FOUND,
    "p1_loaded": P1_LOADED,
    "table_shapes": "SELECT 'region' AS name, count(*) AS n_rows, 2 AS n_columns FROM region UNION ALL SELECT 'nation', count(*), 3 FROM nation UNION ALL SELECT 'part', count(*), 6 FROM part",
    "file_row_counts": "SELECT count(*) AS n_rows FROM dreher_raw",
    "null_sentinels": "SELECT row_id, " + ", ".join(f"CASE WHEN {VALID.format(c)} THEN {c} END AS {c}" for c in ("ligand", "additive", "base", "aryl_halide")) + " FROM dreher_dataset",
    "project_range": f"SELECT row_id, o_orderkey, o_totalprice FROM {ORDERS} WHERE row_id >= 100 AND row_id < 200",
    "gather_positions": "SELECT row_id, doc_id, lang, source FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents) WHERE row_id IN (0, 5, 17, 42, 99, 1000000)",
    "inverse_subset": f"SELECT row_id, event_id FROM {EVENTS} WHERE row_id % 7 <> 0",
    "sentinel_filter": f"SELECT row_id, smiles FROM toxicity WHERE {VALID.format('smiles')}",
    "dedupe_first": "SELECT min(row_id) AS row_id, arg_min(smiles, row_id) AS smiles FROM (SELECT row_id, coalesce(smiles, NULL) AS smiles, coalesce('v' || replace(smiles, '@', ''), 'null') AS k FROM lipophilicity) WHERE smiles IS NOT NULL GROUP BY k UNION ALL SELECT min(row_id), NULL FROM lipophilicity WHERE smiles IS NULL HAVING count(*) > 0",
    "dense_renumber": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ID, p_partkey, p_size FROM part WHERE p_size <= 25",
    "exact_sample": f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {h32(chr(39) + '42-' + chr(39) + ' || o_orderkey')}, o_orderkey LIMIT 1000",
    "feature_width": "SELECT max(len(embedding)) + 1 AS width FROM embeddings",
    "assemble_matrix": "SELECT vec_id, i - 1 AS pos, CASE WHEN i <= len(embedding) THEN embedding[i]::DOUBLE ELSE label::DOUBLE END AS x FROM embeddings, (SELECT unnest(range(1, 66)) AS i)",
    "overwrite_rows": "SELECT row_id, p_partkey, CASE WHEN row_id % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part)",
    "align_targets": f"SELECT row_id, p_partkey, o_totalprice FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part) JOIN {ORDERS} USING (row_id)",
    "lexsort_rank": "SELECT l_suppkey, l_partkey, l_linenumber, dense_rank() OVER (ORDER BY l_suppkey, l_partkey, l_linenumber) AS rank FROM lineitem",
    "topk_value": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50",
    "reorder_by_split": f"SELECT row_number() OVER (ORDER BY (role <> 'train')::INT, row_id) - 1 AS new_id, row_id, o_orderkey, role FROM (SELECT row_id, o_orderkey, CASE WHEN row_id >= 500 AND row_id < 900 THEN 'test' ELSE 'train' END AS role FROM {ORDERS})",
    "shuffle_order": f"SELECT p_partkey, row_number() OVER (ORDER BY {h32(chr(39) + '42-' + chr(39) + ' || p_partkey')}, p_partkey) - 1 AS row_id FROM part",
    "dup_summary": f"SELECT sum(size)::BIGINT AS counted_entries, coalesce(sum(size) FILTER (size >= 2), 0)::BIGINT AS counted_duplicates, coalesce(max(size) FILTER (size >= 2), 0) AS entry_most_duplicates FROM {SIZES}",
    "dup_distribution": f"SELECT size, count(*) AS groups FROM {SIZES} WHERE size >= 2 GROUP BY size",
    "dup_by_last_col": "SELECT l_linestatus, count(*) AS rows FROM (SELECT l_linestatus, count(*) OVER (PARTITION BY l_quantity, l_discount, l_returnflag) AS size FROM lineitem) WHERE size >= 2 GROUP BY l_linestatus",
    "value_domain": "SELECT l_returnflag AS value FROM lineitem UNION SELECT l_linestatus FROM lineitem",
    "column_relevance": "SELECT unnest(['l_orderkey', 'l_quantity', 'l_tax', 'l_returnflag', 'one']) AS column, unnest([min(l_orderkey) <> max(l_orderkey), min(l_quantity) <> max(l_quantity), min(l_tax) <> max(l_tax), min(l_returnflag) <> max(l_returnflag), false]) AS relevant FROM lineitem",
    "constant_positions": f"SELECT pos FROM (SELECT unnest(range(64))::INT AS pos, unnest(bits) AS x FROM {bits(0.3)}) GROUP BY pos HAVING min(x) = max(x)",
    "drop_constant_positions": f"WITH b AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(bits) AS x FROM {bits(0.3)}), k AS (SELECT pos FROM b GROUP BY pos HAVING min(x) < max(x)) SELECT vec_id, count(k.pos) AS width, coalesce(sum(x) FILTER (k.pos IS NOT NULL), 0)::BIGINT AS ones FROM b LEFT JOIN k USING (pos) GROUP BY vec_id",
    "split_all": "SELECT p_partkey, 'train' AS role FROM part UNION ALL SELECT p_partkey, 'test' FROM part",
    "split_range": f"SELECT row_id, event_id, CASE WHEN row_id >= 2000 AND row_id < 10000000 THEN 'test' ELSE 'train' END AS role FROM {EVENTS}",
    "split_shuffle": f"SELECT row_id, split, CASE WHEN row_number() OVER (PARTITION BY split ORDER BY {h32(chr(39) + '42-' + chr(39) + ' || split || ' + chr(39) + '-' + chr(39) + ' || row_id')}, row_id) <= ceil((SELECT count(*) FROM events) * (1 - 0.7::DOUBLE)) THEN 'test' ELSE 'train' END AS role FROM {EVENTS}, (SELECT unnest([0, 1]) AS split)",
    "split_kfold": f"SELECT row_id, event_id, floor(row_id * 5 / (SELECT count(*) FROM events))::INT AS fold FROM {EVENTS}",
    "split_nested_absolute": f"SELECT row_id, role, CASE WHEN role = 'train' THEN CASE WHEN p >= 50 AND p < 250 THEN 'test' ELSE 'train' END END AS inner_role FROM (SELECT row_id, role, row_number() OVER (PARTITION BY role ORDER BY row_id) - 1 AS p FROM (SELECT row_id, CASE WHEN row_id >= 100 AND row_id < 300 THEN 'test' ELSE 'train' END AS role FROM {EVENTS}))",
    "train_batches": f"SELECT row_id, batch_id FROM (SELECT row_id, ((row_number() OVER (ORDER BY row_id) - 1) // 128)::BIGINT AS batch_id FROM {EVENTS} WHERE row_id >= 500) WHERE batch_id >= 2",
    "metric_regression": f"SELECT round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS r2, round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) ** 2), 4) AS mse, round(max(abs(y - p)), 4) AS max_error, round(1 - var_pop(y - p) / var_pop(y), 4) AS explained_variance FROM {YP}",
    "metric_binary": f"SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(1 - (tp + tn) / (tp + tn + fp + fn), 6) AS zero_one_loss, round((fp + fn) / (tp + tn + fp + fn), 6) AS hamming_loss, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS jaccard, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS matthews FROM {CELLS}",
    "metric_specificity": f"SELECT round(avg(tn / (tn + fp)), 6) AS specificity, 'macro' AS average FROM {RATES} UNION ALL SELECT round(sum(tn) / sum(tn + fp), 6), 'micro' FROM {RATES}",
    "metric_balanced": f"SELECT round((avg(tn / (tn + fp)) + avg(tp / (tp + fn))) / 2, 6) AS balanced_accuracy FROM {RATES}",
    "recall_matrix": f"SELECT label, round(tp / (tp + fn), 6) AS recall FROM {RATES}",
    "specificity_matrix": f"SELECT label, round(tn / (tn + fp), 6) AS specificity FROM {RATES}",
    "confusion_matrix": f"SELECT y, sum((p = 'A')::INT)::BIGINT AS pred_A, sum((p = 'N')::INT)::BIGINT AS pred_N, sum((p = 'R')::INT)::BIGINT AS pred_R FROM {LABELS} GROUP BY y",
    "roc_auc": f"SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE))::DOUBLE / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS roc_auc FROM {ROC_SUMS}",
    "roc_curve": f"SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT round(score, 6) AS threshold, round(fp::DOUBLE / (SELECT sum(neg) FROM {ROC})::DOUBLE, 6) AS fpr, round(tp::DOUBLE / (SELECT sum(pos) FROM {ROC})::DOUBLE, 6) AS tpr FROM {ROC_SUMS}",
    "fold_average": f"SELECT 'fixed' AS config, round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse FROM {FOLDS}",
    "best_fold": f"SELECT fold, round(mae, 6) AS mae FROM {FOLDS} ORDER BY mae, fold LIMIT 1",
    "multi_hot": "WITH d AS (SELECT list_sort(list(v)) AS vs FROM (SELECT l_returnflag AS v FROM lineitem UNION SELECT l_linestatus FROM lineitem)) SELECT l_orderkey, l_linenumber, array_to_string(list_transform(vs, lambda v: (v = l_returnflag OR v = l_linestatus)::INT), '') AS code FROM lineitem, d",
    "random_vectors": f"SELECT event_type, i::INT AS pos, round(-1.0::DOUBLE + 2.0::DOUBLE * ({h32(chr(39) + '42-' + chr(39) + ' || event_type || ' + chr(39) + '-' + chr(39) + ' || i')} / 4294967296.0::DOUBLE), 9) AS x FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(8)) AS i)",
    "regex_tokenize": f"SELECT row_id, array_to_string({TOKENS}, ' ') AS tokens FROM lipophilicity",
    "token_ids_padded": f"SELECT row_id, array_to_string(list_resize(CASE WHEN t IS NULL THEN []::BIGINT[] ELSE list_concat(list_concat([3], {_ids}), [4]) END, {ROOM}, 0), ',') AS ids FROM (SELECT row_id, {TOKENS} AS t FROM lipophilicity)",
    "token_decode": f"SELECT row_id, array_to_string(list_transform(list_resize(CASE WHEN t IS NULL THEN []::BIGINT[] ELSE list_concat(list_concat([3], {_ids}), [4]) END, {ROOM}, 0), lambda i: {_list(VOCABULARY)}[i + 1]), ' ') AS words FROM (SELECT row_id, {TOKENS} AS t FROM lipophilicity)",
    "reaction_string": "SELECT row_id, concat_ws('.', aryl_halide, ligand) || '>' || concat_ws('.', base) || '>' || concat_ws('.', additive) AS reaction FROM dreher_dataset",
    "reaction_fingerprint": REACTION_BITS,
    "nonzero_indices_padded": f"SELECT vec_id, array_to_string(list_resize(list_filter(list_transform(range(1, 65), lambda i: CASE WHEN bits[i] <> 0 THEN i END), lambda i: i IS NOT NULL), 64, -1), ',') AS places FROM {bits()}",
    "pattern_counts": "SELECT row_id, array_to_string([" + ", ".join(_replace_count(p) for p in PATTERNS) + "], ',') AS counts FROM toxicity",
    "pattern_match": "SELECT row_id, array_to_string([" + ", ".join(f"least({_replace_count(p)}, 1)" for p in PATTERNS) + "], ',') AS bits FROM toxicity",
    "regex_pattern_counts": r"SELECT row_id, concat_ws(',', coalesce(len(regexp_extract_all(smiles, '\[[^\]]+\]')), 0), coalesce(len(regexp_extract_all(smiles, '%[0-9][0-9]')), 0), coalesce(len(regexp_extract_all(smiles, 'CCC')), 0)) AS counts FROM toxicity",
    "dictionary_lookup": "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "hashed_fingerprint": f"SELECT p_partkey, {fingerprint('p_name', 64, 3)} AS bits FROM part",
    "kernel_convert": r"SELECT row_id, len(list_filter(regexp_extract_all(smiles, '\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops]'), lambda t: t <> '[H]'))::INT AS atoms FROM toxicity WHERE " + VALID.format("smiles"),
    "descriptor_round": "SELECT o_orderkey, round(o_totalprice)::INT AS whole, round(o_totalprice, 1) AS tenths FROM orders",
    "genome_id": "SELECT p_brand, md5(string_agg(DISTINCT p_type, '' ORDER BY p_type DESC)) AS id FROM part GROUP BY p_brand",
    "genome_subset": "WITH c AS (SELECT DISTINCT p_brand, p_type FROM part), b AS (SELECT DISTINCT p_brand FROM c) SELECT a.p_brand, o.p_brand AS other FROM b a JOIN b o ON a.p_brand <> o.p_brand WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.p_brand = a.p_brand AND NOT EXISTS (SELECT 1 FROM c y WHERE y.p_brand = o.p_brand AND y.p_type = x.p_type))",
    "heavy_weight": f"SELECT row_id, round({_weight}, 3) AS weight FROM toxicity WHERE {VALID.format('smiles')}",
    "weight_filter": f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS ID, row_id, smiles FROM lipophilicity WHERE {VALID.format('smiles')} AND {_weight} <= 800",
    "diversity_fitness": f"WITH k AS (SELECT pos, x, count(*) AS k FROM (SELECT unnest(range(64)) AS pos, unnest(bits) AS x FROM {bits()}) GROUP BY pos, x), n AS (SELECT count(*) AS n FROM embeddings) SELECT (sum(k * (k - 1)) + max(n))::BIGINT AS collisions, round((sum(k * (k - 1)) + max(n))::DOUBLE / (max(n) * max(n))::DOUBLE, 6) AS diversity FROM k, n",
    "grid_expand": "SELECT (row_number() OVER (ORDER BY kind, trees, depth) - 1) AS combination, depth, trees, kind FROM (SELECT unnest([2, 4, 6])::BIGINT AS depth), (SELECT unnest([10, 50, 100])::BIGINT AS trees), (SELECT unnest(['a', 'b']) AS kind)",
    "diversity_score": DIVERSITY,
    "primitive_pool": f"WITH t AS (SELECT row_id, unnest({TOKENS}) AS w FROM lipophilicity WHERE {VALID.format('smiles')}), k AS (SELECT row_id, w, count(*) AS k FROM t GROUP BY row_id, w), n AS (SELECT count(*) AS n FROM lipophilicity WHERE {VALID.format('smiles')}), "
    "p AS (SELECT w AS primitive, CASE WHEN regexp_full_match(w, '\\[.+\\]|[A-Za-z]{1,2}') THEN 'atom' ELSE 'other' END AS kind, count(*) AS rows, CASE WHEN count(*) < max(n) THEN 0 ELSE min(k) END AS least, max(k) AS most FROM k, n GROUP BY w) "
    "SELECT primitive, kind, rows, least, most, least <> most AS relevant FROM p WHERE kind = 'atom' OR least <> most",
    "metric_stack_all": STACK,
    "split_nested_pairs": "SELECT event_id, o::INT AS outer, i::INT AS inner, CASE WHEN event_id % 2 = o THEN 'outer_test' WHEN (event_id // 2) % 3 = i THEN 'inner_test' ELSE 'train' END AS role FROM events, range(2) x(o), range(3) z(i)",
    "job_predict": "SELECT l_orderkey, l_extendedprice AS price, round(a + b * l_quantity, 3) AS guess FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem WHERE l_orderkey % 2 = 0)",
    "grid_nested_best": NESTED,
    "stream_window_count": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
} | {f"fitness_{w}": fitness(w) for w in ("average", "average_pow", "norm_max", "norm_max_pow", "norm_asList", "norm_asList_pow")}
