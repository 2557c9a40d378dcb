"""DuckDB oracle SQL for the registered queries.

Each statement restates the definition of the statistic in plain SQL over the
pre-registered views (not a transcript of the Spark plan).  Doubles pass
through ``R(...)``: 6 significant digits, the same arithmetic as
``tabsight.functions.columns.sig_round``."""

from __future__ import annotations


def R(x: str, digits: int = 6) -> str:
    k = f"({digits - 1} - floor(log10(abs(({x})::DOUBLE))))"
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN isnan(({x})::DOUBLE) OR isinf(({x})::DOUBLE) THEN ({x})::DOUBLE "
            f"WHEN abs(({x})::DOUBLE) < 1e-9 THEN 0.0::DOUBLE "
            f"WHEN {k} >= 0 THEN round(({x})::DOUBLE * pow(10.0, {k})) / pow(10.0, {k}) + 0.0 "
            f"ELSE round(({x})::DOUBLE / pow(10.0, -{k})) * pow(10.0, -{k}) + 0.0 END)")


def SPARK_TYPE(x: str) -> str:
    """Spark's simpleString of a DuckDB value's type."""
    return (f"(CASE typeof({x}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
            f"WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' "
            f"ELSE lower(typeof({x})) END)")


def US(ts: str) -> str:
    return f"epoch_us({ts})::DOUBLE"


EVENTS_NULLS = """events_n AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value,
         props
  FROM events)"""

LINEITEM_T = """lineitem_t AS (
  SELECT *, l_extendedprice * (1 - l_discount) AS l_netprice,
         CASE WHEN l_quantity - 100 * l_discount + (l_partkey % 7) > 20 THEN 1 ELSE 0 END AS target_bin,
         CASE WHEN l_quantity < 15 THEN 'low' WHEN l_quantity < 35 THEN 'mid' ELSE 'high' END AS target_cls,
         (3 * l_quantity - 20 * l_discount + (l_partkey % 7))::DOUBLE AS target_reg
  FROM lineitem)"""

PRED = LINEITEM_T + """, pred AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, target_bin::DOUBLE AS label,
         (l_quantity + (l_suppkey % 17) - 8) / 50.0 AS score,
         CASE WHEN (l_quantity + (l_suppkey % 17) - 8) / 50.0 > 0.5 THEN 1.0 ELSE 0.0 END AS prediction
  FROM lineitem_t)"""

EMB = """emb AS (
  SELECT vec_id, {cols}, label,
         CASE WHEN embedding[1] * embedding[1] + embedding[2] * embedding[2] > 0.022 THEN 1 ELSE 0 END AS ring,
         embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE AS radius2
  FROM embeddings)""".format(cols=", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(64)))

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
EVENTS_ALL = ["event_id", "ts", "user_id", "event_type", "value", "props"]

SQL: dict[str, str] = {}


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# ---- stage 1: profile -------------------------------------------------------
SQL["summary_numeric"] = _union([f"""
SELECT '{c}' AS column_name, {SPARK_TYPE(f'any_value({c})')} AS dtype, count({c}) AS count,
       {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS min,
       {R(f'quantile_cont({c}, 0.25)')} AS q25, {R(f'quantile_cont({c}, 0.5)')} AS q50,
       {R(f'quantile_cont({c}, 0.75)')} AS q75, {R(f'max({c})')} AS max,
       count(*) - count({c}) AS missing_count,
       {R(f'(count(*) - count({c})) * 100.0 / nullif(count(*), 0)')} AS missing_pct
FROM lineitem""" for c in LINEITEM_NUM])

SQL["summary_text"] = "WITH " + EVENTS_NULLS + ", " + ", ".join(f"""
vc_{c} AS (SELECT {c} AS value, count(*) AS cnt FROM events_n WHERE {c} IS NOT NULL GROUP BY {c}),
top_{c} AS (SELECT value, cnt FROM vc_{c} ORDER BY cnt DESC, value ASC LIMIT 1)""" for c in ("event_type", "props")) + "\n" + _union([f"""
SELECT '{c}' AS column_name, 'string' AS dtype, (SELECT count({c}) FROM events_n) AS count,
       (SELECT count(*) FROM vc_{c}) AS unique, (SELECT value FROM top_{c}) AS top,
       (SELECT cnt FROM top_{c}) AS freq,
       (SELECT count(*) - count({c}) FROM events_n) AS missing_count,
       {R(f'(SELECT (count(*) - count({c})) * 100.0 / count(*) FROM events_n)')} AS missing_pct""" for c in ("event_type", "props")])

SQL["summary_timestamp"] = f"""
SELECT 'l_shipdate' AS column_name, 'timestamp_ntz' AS dtype, count(l_shipdate) AS count,
       {R(f'avg({US("l_shipdate")})')} AS mean_us, {R(f'min({US("l_shipdate")})')} AS min_us,
       {R(f'quantile_cont({US("l_shipdate")}, 0.25)')} AS q25_us,
       {R(f'quantile_cont({US("l_shipdate")}, 0.5)')} AS q50_us,
       {R(f'quantile_cont({US("l_shipdate")}, 0.75)')} AS q75_us,
       {R(f'max({US("l_shipdate")})')} AS max_us, count(*) - count(l_shipdate) AS missing_count
FROM lineitem"""


def _txt(c: str) -> str:
    return f"CAST({c} AS VARCHAR)" if c != "ts" else f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


SQL["column_info"] = "WITH " + EVENTS_NULLS + "\n" + _union([f"""
SELECT '{c}' AS column_name, {SPARK_TYPE(f'any_value({c})')} AS dtype, count({c}) AS non_null,
       count(*) - count({c}) AS null_count,
       {R(f'round_even((count(*) - count({c})) * 100.0 / count(*), 2)')} AS null_pct,
       count(DISTINCT {c}) AS n_distinct,
       coalesce(min({_txt(c)}), 'NaN') AS sample_value
FROM events_n""" for c in EVENTS_ALL])

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SQL["quality_report"] = _union([f"""
SELECT '{c}' AS column_name, {SPARK_TYPE(f'any_value({c})')} AS dtype,
       count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct
FROM customer""" for c in CUSTOMER])

SQL["missing_by_column"] = "WITH " + EVENTS_NULLS + ", m AS (" + _union([
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count FROM events_n"
    for c in EVENTS_ALL]) + ")\nSELECT * FROM m WHERE missing_count > 0 ORDER BY missing_count DESC, column_name"

SQL["missing_cells"] = "WITH " + EVENTS_NULLS + f""", c AS (
  SELECT count(*) AS n, {' + '.join(f'(count(*) - count({c}))' for c in EVENTS_ALL)} AS miss FROM events_n)
SELECT miss::BIGINT AS missing_cells, (n * {len(EVENTS_ALL)})::BIGINT AS total_cells,
       {R(f'miss * 100.0 / nullif(n * {len(EVENTS_ALL)}, 0)')} AS missing_pct FROM c"""

SQL["table_shape"] = "SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem"

SQL["kind_counts"] = f"""
SELECT 'numeric' AS kind, 8::BIGINT AS n_columns,
       ({' + '.join(f'count({c})' for c in LINEITEM_NUM)})::BIGINT AS non_null_cells FROM lineitem
UNION ALL
SELECT 'text', 2::BIGINT, (count(l_returnflag) + count(l_linestatus))::BIGINT FROM lineitem
UNION ALL
SELECT 'datetime', 1::BIGINT, count(l_shipdate)::BIGINT FROM lineitem"""

SQL["duplicate_rows"] = """
WITH t AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0)
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n_distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n_duplicates
FROM t"""

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
SQL["distinct_counts"] = _union([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM orders" for c in ORDERS])

SQL["logical_bytes"] = """
SELECT 'doc_id' AS column_name, 'bigint' AS dtype, (8 * count(doc_id))::BIGINT AS bytes FROM documents
UNION ALL SELECT 'text', 'string', sum(strlen(text))::BIGINT FROM documents
UNION ALL SELECT 'lang', 'string', sum(strlen(lang))::BIGINT FROM documents
UNION ALL SELECT 'source', 'string', sum(strlen(source))::BIGINT FROM documents
UNION ALL SELECT 'n_chars', 'bigint', (8 * count(n_chars))::BIGINT FROM documents"""

SQL["value_counts"] = "WITH " + EVENTS_NULLS + """
SELECT event_type AS value, count(*) AS count FROM events_n WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY count DESC, value"""

SQL["value_shares"] = f"""
SELECT c_mktsegment AS value, count(*) AS count,
       {R('count(*) * 1.0 / sum(count(*)) OVER ()')} AS share
FROM customer GROUP BY c_mktsegment ORDER BY count DESC, value"""

SQL["skewness"] = _union([
    f"SELECT '{c}' AS column_name, {R(f'skewness({c})')} AS skewness FROM events"
    for c in ("event_id", "user_id", "value")])

SQL["preview"] = f"""
SELECT c_custkey, c_name, c_nationkey, {R('c_acctbal')} AS c_acctbal, c_mktsegment
FROM customer ORDER BY c_custkey LIMIT 10"""


# ---- stage 2: distributions, outliers, correlation, tests --------------------
SQL["histogram"] = "WITH " + EVENTS_NULLS + f""",
r AS (SELECT min(value) AS lo, max(value) AS hi FROM events_n),
c AS (SELECT least(coalesce(floor((value - lo) / nullif(hi - lo, 0) * 30) + 1, 1), 30)::INTEGER AS bin,
             count(*) AS count
      FROM events_n, r WHERE value IS NOT NULL GROUP BY 1)
SELECT g.i::INTEGER AS bin, {R('lo + (g.i - 1) * (hi - lo) / 30')} AS lower,
       {R('lo + g.i * (hi - lo) / 30')} AS upper, coalesce(c.count, 0) AS count
FROM range(1, 31) g(i) CROSS JOIN r LEFT JOIN c ON c.bin = g.i ORDER BY bin"""

_EV = f"event_id, ts, user_id, event_type, {R('value')} AS value, props"
_IQR = """q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"""
SQL["outliers_iqr"] = f"""WITH {_IQR}
SELECT {_EV} FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""
SQL["outliers_zscore"] = f"""WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events)
SELECT {_EV} FROM events, s WHERE abs(value - mu) / sd > 3"""
_MAD = """m AS (SELECT median(value) AS med FROM events),
d AS (SELECT median(abs(value - med)) AS mad FROM events, m)"""
SQL["outliers_mad"] = f"""WITH {_MAD}
SELECT {_EV} FROM events, m, d WHERE abs(0.6745 * (value - med) / mad) > 3.5"""
SQL["outlier_counts"] = f"""WITH {_IQR}, s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events), {_MAD}
SELECT 'IQR' AS method, count(*) AS n_outliers FROM events, q
  WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
UNION ALL SELECT 'Z-Score', count(*) FROM events, s WHERE abs(value - mu) / sd > 3
UNION ALL SELECT 'Modified Z-Score', count(*) FROM events, m, d WHERE abs(0.6745 * (value - med) / mad) > 3.5"""
SQL["outlier_total"] = "WITH " + EVENTS_NULLS + "\n" + _union([f"""
SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM events_n, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events_n)"""
    for c in ("event_id", "user_id", "value")])
SQL["box_stats"] = f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS med,
                 quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT {R('q1')} AS q1, {R('med')} AS median, {R('q3')} AS q3, {R('lf')} AS lower_fence, {R('uf')} AS upper_fence,
       {R('min(value) FILTER (WHERE value BETWEEN lf AND uf)')} AS lower_whisker,
       {R('max(value) FILTER (WHERE value BETWEEN lf AND uf)')} AS upper_whisker,
       count(*) FILTER (WHERE value < lf OR value > uf) AS n_outliers
FROM events, f GROUP BY q1, med, q3, lf, uf"""
SQL["outliers_cap_iqr"] = "WITH " + EVENTS_NULLS + f""",
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events_n)
SELECT event_id, {R('CASE WHEN value IS NULL THEN NULL WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) WHEN value > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE value END')} AS value
FROM events_n, q"""
SQL["outliers_remove_iqr"] = f"""WITH q1 AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
s1 AS (SELECT events.* FROM events, q1 WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),
q2 AS (SELECT quantile_cont(user_id, 0.25) AS a, quantile_cont(user_id, 0.75) AS b FROM s1),
s2 AS (SELECT s1.* FROM s1, q2 WHERE user_id BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))
SELECT {_EV} FROM s2"""

_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_netprice"]


def _corr_long(pred: str = "TRUE") -> str:
    parts = []
    for i, a in enumerate(_CORR):
        for j, b in enumerate(_CORR):
            parts.append(f"SELECT '{a}' AS col_x, '{b}' AS col_y, {i} AS i, {j} AS j, "
                         f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS corr FROM lineitem_t")
    return "WITH " + LINEITEM_T + ", cm AS (" + _union(parts) + ")\n"


SQL["correlation_matrix"] = _corr_long() + f"SELECT col_x, col_y, {R('corr')} AS corr FROM cm"
SQL["top_correlations"] = _corr_long() + f"""SELECT col_x, col_y, {R('corr')} AS corr FROM cm
WHERE i < j AND corr IS NOT NULL ORDER BY cm.corr DESC, i, j LIMIT 3"""
SQL["high_corr_pairs"] = _corr_long() + f"""SELECT col_x, col_y, {R('corr')} AS corr FROM cm
WHERE i < j AND abs(cm.corr) > 0.8 ORDER BY i, j"""

SQL["ttest_pooled"] = f"""WITH s AS (SELECT count(l_discount) AS na, count(l_tax) AS nb, avg(l_discount) AS ma,
       avg(l_tax) AS mb, var_samp(l_discount) AS va, var_samp(l_tax) AS vb FROM lineitem)
SELECT 'l_discount' AS col_a, 'l_tax' AS col_b, na AS n_a, nb AS n_b, {R('ma')} AS mean_a, {R('mb')} AS mean_b,
       {R('(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb))')} AS t_stat,
       (na + nb - 2)::BIGINT AS dof
FROM s"""

_EMB = [f"e{i}" for i in range(64)]
SQL["f_classif"] = "WITH " + EMB + "\n" + _union([f"""
SELECT '{c}' AS feature, {R(f'(sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))')} AS f_score
FROM (SELECT label, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM emb GROUP BY label) g,
     (SELECT avg({c}) AS gm FROM emb) t""" for c in _EMB])

SQL["f_regression"] = "WITH " + LINEITEM_T + "\n" + _union([f"""
SELECT '{c}' AS feature, {R(f'corr({c}, target_reg) ^ 2 / (1 - corr({c}, target_reg) ^ 2) * (count(*) - 2)')} AS f_score
FROM lineitem_t""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])

SQL["select_k_best"] = "WITH " + EMB + ", fs AS (" + _union([f"""
SELECT '{c}' AS feature, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score
FROM (SELECT label, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM emb GROUP BY label) g,
     (SELECT avg({c}) AS gm FROM emb) t""" for c in _EMB]) + f""")
SELECT feature, {R('f_score')} AS f_score FROM fs ORDER BY fs.f_score DESC, feature LIMIT 5"""


# ---- stage 3: rule reports ---------------------------------------------------
_NUM_E = ["event_id", "user_id", "value"]
_TXT_E = ["event_type", "props"]
_PAIRS = [(i, j) for i in range(3) for j in range(3) if i < j]
SQL["insights"] = "WITH " + EVENTS_NULLS + f""",
nl AS (SELECT count(*) AS n, {' + '.join(f'(count(*) - count({c}))' for c in EVENTS_ALL)} AS miss FROM events_n),
sk AS ({_union([f"SELECT '{c}' AS c, skewness({c}) AS s FROM events_n" for c in _NUM_E])}),
cm AS ({_union([f"SELECT '{_NUM_E[i]}' AS a, '{_NUM_E[j]}' AS b, {i} AS i, {j} AS j, corr({_NUM_E[i]}, {_NUM_E[j]}) AS r FROM events_n" for i, j in _PAIRS])}),
nd AS ({_union([f"SELECT '{c}' AS c, count(DISTINCT {c}) AS d, sum(strlen({c})) AS bytes FROM events_n" for c in _TXT_E])}),
ot AS (SELECT {' + '.join(f'''(SELECT count(*) FROM events_n, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events_n) WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))''' for c in _NUM_E)} AS total)
SELECT 1 AS rule_id, 'missing_values' AS rule, NULL::VARCHAR AS column_name, miss::DOUBLE AS value FROM nl WHERE miss > 0
UNION ALL SELECT 2, 'skewed', c, {R('s')} FROM sk WHERE abs(s) > 1
UNION ALL SELECT * FROM (SELECT 3, 'top_correlation', a || ',' || b, {R('r')} FROM cm WHERE r IS NOT NULL ORDER BY r DESC, i, j LIMIT 3)
UNION ALL SELECT 8, 'high_corr_pairs', NULL, count(*)::DOUBLE FROM cm WHERE abs(r) > 0.8 HAVING count(*) > 0
UNION ALL SELECT 4, 'few_categories', c, d::DOUBLE FROM nd WHERE d < 5
UNION ALL SELECT 7, 'high_cardinality', c, d::DOUBLE FROM nd, nl WHERE d > n * 0.8
UNION ALL SELECT 9, 'heavy_text', c, bytes::DOUBLE FROM nd WHERE bytes > 1000000
UNION ALL SELECT 5, 'high_missing', NULL, {R('miss * 100.0 / (n * 6)')} FROM nl WHERE miss * 100.0 / (n * 6) > 10
UNION ALL SELECT 5, 'no_missing', NULL, 0.0 FROM nl WHERE miss = 0
UNION ALL SELECT 6, 'outliers', NULL, total::DOUBLE FROM ot WHERE total > 0
UNION ALL SELECT 10, 'small_dataset', NULL, n::DOUBLE FROM nl WHERE n < 100
UNION ALL SELECT 10, 'large_dataset', NULL, n::DOUBLE FROM nl WHERE n > 100000"""

SQL["suggestions"] = f"""WITH lt AS (SELECT doc_id, quality, CAST(toxic AS VARCHAR) AS toxic FROM labels),
m AS (SELECT (count(*) - count(doc_id)) + (count(*) - count(quality)) + (count(*) - count(toxic)) AS miss FROM lt),
du AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lt)) AS dups FROM lt),
sh AS (SELECT count(DISTINCT toxic) AS d,
              (SELECT count(*) FROM lt WHERE toxic = (SELECT toxic FROM lt GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1)) * 1.0 / count(toxic) AS top
       FROM lt)
SELECT 1 AS rule_id, 'handle_missing' AS rule, NULL::VARCHAR AS column_name, miss::DOUBLE AS value FROM m WHERE miss > 0
UNION ALL SELECT 2, 'encode_categorical', NULL, 1.0
UNION ALL SELECT 3, 'remove_duplicates', NULL, dups::DOUBLE FROM du WHERE dups > 0
UNION ALL SELECT 4, 'scale_features', NULL, 2.0
UNION ALL SELECT 5, 'check_outliers', NULL, 2.0
UNION ALL SELECT 6, 'imbalanced', 'toxic', {R('top')} FROM sh WHERE d = 2 AND top > 0.8"""


# ---- stage 4: preprocessing --------------------------------------------------
SQL["impute_mean"] = "WITH " + EVENTS_NULLS + f"""
SELECT event_id, {R('coalesce(value, (SELECT avg(value) FROM events_n))')} AS value FROM events_n"""
SQL["impute_median"] = "WITH " + EVENTS_NULLS + f"""
SELECT event_id, {R('coalesce(value, (SELECT median(value) FROM events_n))')} AS value FROM events_n"""
SQL["impute_mode"] = "WITH " + EVENTS_NULLS + f"""
SELECT event_id,
  coalesce(event_type, (SELECT event_type FROM events_n WHERE event_type IS NOT NULL GROUP BY event_type
                        ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
  {R('coalesce(value, (SELECT value FROM events_n WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1))')} AS value
FROM events_n"""
SQL["impute_constant"] = "WITH " + EVENTS_NULLS + f"""
SELECT event_id, coalesce(event_type, '0') AS event_type, {R('coalesce(value, 0.0)')} AS value FROM events_n"""
SQL["label_encode"] = """
SELECT c_custkey,
       (dense_rank() OVER (ORDER BY c_name) - 1)::BIGINT AS c_name,
       (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS c_mktsegment
FROM customer"""
SQL["standard_scale"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {R('(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()')} AS l_quantity,
       {R('(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER ()')} AS l_extendedprice
FROM lineitem"""
SQL["minmax_scale"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {R('(l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ())')} AS l_quantity,
       {R('(l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ())')} AS l_extendedprice
FROM lineitem"""
SQL["preprocess"] = "WITH " + EVENTS_NULLS + """,
imp AS (SELECT event_id, coalesce(user_id::DOUBLE, (SELECT median(user_id) FROM events_n)) AS user_id,
               coalesce(value, (SELECT median(value) FROM events_n)) AS value FROM events_n),
sc AS (SELECT event_id, (user_id - avg(user_id) OVER ()) / stddev_pop(user_id) OVER () AS user_id,
              (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value FROM imp),
q AS (SELECT quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3,
             quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3 FROM sc)
""" + f"""SELECT event_id,
       {R('least(greatest(user_id, u1 - 1.5 * (u3 - u1)), u3 + 1.5 * (u3 - u1))')} AS user_id,
       {R('least(greatest(value, v1 - 1.5 * (v3 - v1)), v3 + 1.5 * (v3 - v1))')} AS value
FROM sc, q"""
SQL["prepare"] = "WITH " + EVENTS_NULLS + """,
d AS (SELECT event_id, user_id, value, props, event_type FROM events_n WHERE event_type IS NOT NULL),
f AS (SELECT event_id, user_id::DOUBLE AS user_id,
             coalesce(value, (SELECT median(value) FROM d)) AS value,
             coalesce(props, (SELECT props FROM d WHERE props IS NOT NULL GROUP BY props ORDER BY count(*) DESC, props LIMIT 1)) AS props,
             event_type FROM d)
""" + f"""SELECT event_id, {R('user_id')} AS user_id, {R('value')} AS value,
       (dense_rank() OVER (ORDER BY props) - 1)::BIGINT AS props,
       (dense_rank() OVER (ORDER BY event_type) - 1)::BIGINT AS event_type
FROM f"""
SQL["split"] = """
SELECT o_orderkey, o_custkey,
       ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7))::BIGINT % 100 < 20 AS is_test
FROM orders"""
SQL["stratified_split"] = "WITH " + LINEITEM_T + """,
h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, target_cls,
             concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem_t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, target_cls,
       row_number() OVER (PARTITION BY target_cls ORDER BY ('0x' || substr(md5(k), 1, 7))::BIGINT, k)
         <= ceil(0.2 * count(*) OVER (PARTITION BY target_cls)) AS is_test
FROM h"""
SQL["target_type"] = "WITH " + LINEITEM_T + """
SELECT 'target_bin' AS target, CASE WHEN count(DISTINCT target_bin) = 2 THEN 'binary' ELSE 'multiclass' END AS target_type,
       count(DISTINCT target_bin) AS n_distinct FROM lineitem_t
UNION ALL
SELECT 'target_reg', CASE WHEN bool_or(target_reg <> floor(target_reg)) THEN 'continuous'
                          WHEN count(DISTINCT target_reg) = 2 THEN 'binary' ELSE 'multiclass' END,
       count(DISTINCT target_reg) FROM lineitem_t
UNION ALL
SELECT 'target_cls', CASE WHEN count(DISTINCT target_cls) = 2 THEN 'binary' ELSE 'multiclass' END,
       count(DISTINCT target_cls) FROM lineitem_t"""
SQL["problem_type"] = "WITH " + LINEITEM_T + """
SELECT 'target_bin' AS target, CASE WHEN count(DISTINCT target_bin) < 10 THEN 'Classification' ELSE 'Regression' END AS problem_type,
       count(DISTINCT target_bin) AS n_distinct FROM lineitem_t
UNION ALL
SELECT 'target_reg', CASE WHEN count(DISTINCT target_reg) < 10 THEN 'Classification' ELSE 'Regression' END,
       count(DISTINCT target_reg) FROM lineitem_t
UNION ALL
SELECT 'target_cls', 'Classification', count(DISTINCT target_cls) FROM lineitem_t"""


# ---- stage 5: evaluation -----------------------------------------------------
CLS_PRED = LINEITEM_T + """, cp AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, target_cls AS label,
         CASE WHEN l_quantity + (l_suppkey % 5) - 2 < 15 THEN 'low'
              WHEN l_quantity + (l_suppkey % 5) - 2 < 35 THEN 'mid' ELSE 'high' END AS prediction
  FROM lineitem_t)"""
REG_PRED = LINEITEM_T + """, rp AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, target_reg AS label,
         (3 * l_quantity - 1)::DOUBLE AS prediction FROM lineitem_t)"""
PER_CLASS = """, cls AS (SELECT label AS c FROM cp UNION SELECT prediction FROM cp),
pc AS (SELECT c,
         (SELECT count(*) FROM cp WHERE label = c) AS support,
         (SELECT count(*) FROM cp WHERE prediction = c) AS n_pred,
         (SELECT count(*) FROM cp WHERE label = c AND prediction = c) AS tp
       FROM cls),
m AS (SELECT c, support, tp,
        coalesce(tp * 1.0 / nullif(n_pred, 0), 0) AS p, coalesce(tp * 1.0 / nullif(support, 0), 0) AS r
      FROM pc),
m2 AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM m)"""

SQL["metric_accuracy"] = "WITH " + PRED + f"""
SELECT {R('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM pred"""
SQL["metric_weighted_prf"] = "WITH " + CLS_PRED + PER_CLASS + f"""
SELECT {R('sum(p * support) / sum(support)')} AS precision, {R('sum(r * support) / sum(support)')} AS recall,
       {R('sum(f * support) / sum(support)')} AS f1 FROM m2"""
SQL["confusion_matrix"] = "WITH " + CLS_PRED + """, cls AS (SELECT label AS c FROM cp UNION SELECT prediction FROM cp)
SELECT a.c AS actual, b.c AS predicted,
       (SELECT count(*) FROM cp WHERE label = a.c AND prediction = b.c) AS count
FROM cls a, cls b"""
SQL["classification_report"] = "WITH " + CLS_PRED + PER_CLASS + f"""
SELECT c AS class, {R('p')} AS precision, {R('r')} AS recall, {R('f')} AS f1, support FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, {R('sum(tp) * 1.0 / sum(support)')}, sum(support)::BIGINT FROM m2
UNION ALL SELECT 'macro avg', {R('avg(p)')}, {R('avg(r)')}, {R('avg(f)')}, sum(support)::BIGINT FROM m2
UNION ALL SELECT 'weighted avg', {R('sum(p * support) / sum(support)')}, {R('sum(r * support) / sum(support)')},
          {R('sum(f * support) / sum(support)')}, sum(support)::BIGINT FROM m2"""
_ROC = "WITH " + PRED + """,
tot AS (SELECT sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS P, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS N FROM pred),
th AS (SELECT DISTINCT score AS t FROM pred),
pts AS (SELECT t,
          (SELECT count(*) FROM pred WHERE score >= t AND label = 1) AS tp,
          (SELECT count(*) FROM pred WHERE score >= t AND label <> 1) AS fp,
          (SELECT count(*) FROM pred WHERE score = t AND label = 1) AS pos,
          (SELECT count(*) FROM pred WHERE score = t AND label <> 1) AS neg
        FROM th)
"""
SQL["roc_curve"] = _ROC + f"""SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT {R('t')}, {R('fp * 1.0 / N')}, {R('tp * 1.0 / P')} FROM pts, tot"""
SQL["roc_auc"] = _ROC + f"""SELECT {R('sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(N))')} AS auc FROM pts, tot"""
SQL["pr_curve"] = _ROC + f"""SELECT {R('t')} AS threshold, {R('tp * 1.0 / (tp + fp)')} AS precision, {R('tp * 1.0 / P')} AS recall FROM pts, tot
UNION ALL SELECT NULL, 1.0, 0.0"""
SQL["regression_metrics"] = "WITH " + REG_PRED + f"""
SELECT {R('avg((label - prediction) ^ 2)')} AS mse, {R('sqrt(avg((label - prediction) ^ 2))')} AS rmse,
       {R('avg(abs(label - prediction))')} AS mae,
       {R('1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(*))')} AS r2, count(*) AS n FROM rp"""
SQL["residuals"] = "WITH " + REG_PRED + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('label')} AS actual, {R('prediction')} AS predicted,
       {R('label - prediction')} AS residual FROM rp"""
SQL["residual_histogram"] = "WITH " + REG_PRED + f""",
e AS (SELECT label - prediction AS x FROM rp),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM e),
c AS (SELECT least(coalesce(floor((x - lo) / nullif(hi - lo, 0) * 30) + 1, 1), 30)::INTEGER AS bin, count(*) AS count
      FROM e, r GROUP BY 1)
SELECT g.i::INTEGER AS bin, {R('lo + (g.i - 1) * (hi - lo) / 30')} AS lower, {R('lo + g.i * (hi - lo) / 30')} AS upper,
       coalesce(c.count, 0) AS count
FROM range(1, 31) g(i) CROSS JOIN r LEFT JOIN c ON c.bin = g.i"""


# ---- stage 6: models ---------------------------------------------------------
_E = [f"e{i}" for i in range(64)]
EMB_SPLIT = EMB + """,
s AS (SELECT *, ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 7))::BIGINT % 100 < 20 AS is_test FROM emb),
tr AS (SELECT * FROM s WHERE NOT is_test),
te AS (SELECT * FROM s WHERE is_test)"""

SQL["gaussian_nb"] = "WITH " + EMB_SPLIT + f""",
eps AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({c})' for c in _E)}) AS eps FROM tr),
cs AS (SELECT ring AS c, count(*) * 1.0 / (SELECT count(*) FROM tr) AS prior,
              {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) AS v_{c}' for c in _E)} FROM tr GROUP BY ring),
ll AS (SELECT te.vec_id, cs.c,
              ln(prior) - 0.5 * ({' + '.join(f'ln(2 * pi() * (v_{c} + eps))' for c in _E)})
              - ({' + '.join(f'(te.{c} - m_{c}) ^ 2 / (2 * (v_{c} + eps))' for c in _E)}) AS ll
       FROM te, cs, eps)
SELECT vec_id, c AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, c) AS r FROM ll) WHERE r = 1"""

_KNN = "WITH " + EMB_SPLIT + f""",
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _E)} FROM tr),
trs AS (SELECT vec_id AS tid, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in _E)}, ring, radius2 FROM tr, st),
tes AS (SELECT vec_id AS qid, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in _E)} FROM te, st),
dd AS (SELECT q.qid, t.tid, t.ring, t.radius2, {' + '.join(f'(q.{c} - t.{c}) ^ 2' for c in _E)} AS dist FROM tes q, trs t),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM dd) WHERE rn <= 5)
"""
SQL["knn_classify"] = _KNN + """, votes AS (SELECT qid, ring, count(*) AS n FROM nn GROUP BY qid, ring)
SELECT qid AS vec_id, ring AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, ring) AS r FROM votes) WHERE r = 1"""
SQL["knn_regress"] = _KNN + f"SELECT qid AS vec_id, {R('avg(radius2)')} AS prediction FROM nn GROUP BY qid"

SQL["linear"] = "WITH " + LINEITEM_T + f"""
SELECT 'intercept' AS term, {R('regr_intercept(target_reg, l_quantity)')} AS value FROM lineitem_t
UNION ALL SELECT 'l_quantity', {R('regr_slope(target_reg, l_quantity)')} FROM lineitem_t"""

_PCA = "WITH " + LINEITEM_T + """,
cv AS (SELECT var_samp(l_extendedprice) AS a, var_samp(l_netprice) AS c, covar_samp(l_extendedprice, l_netprice) AS b,
              avg(l_extendedprice) AS mx, avg(l_netprice) AS my FROM lineitem_t),
ev AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ^ 2 + b ^ 2) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ^ 2 + b ^ 2) AS l2 FROM cv),
v AS (SELECT *, b / sqrt(b ^ 2 + (l1 - a) ^ 2) AS v1x, (l1 - a) / sqrt(b ^ 2 + (l1 - a) ^ 2) AS v1y FROM ev),
w AS (SELECT *, CASE WHEN abs(v1x) >= abs(v1y) THEN sign(v1x) ELSE sign(v1y) END AS s1,
             -v1y AS v2x, v1x AS v2y FROM v),
w2 AS (SELECT *, CASE WHEN abs(v2x) >= abs(v2y) THEN sign(v2x) ELSE sign(v2y) END AS s2 FROM w)
"""
SQL["pca_loadings"] = _PCA + f"""SELECT 'PC1' AS component, 'l_extendedprice' AS feature, {R('s1 * v1x')} AS loading,
       {R('l1 / (l1 + l2)')} AS explained_variance_ratio FROM w2
UNION ALL SELECT 'PC1', 'l_netprice', {R('s1 * v1y')}, {R('l1 / (l1 + l2)')} FROM w2
UNION ALL SELECT 'PC2', 'l_extendedprice', {R('s2 * v2x')}, {R('l2 / (l1 + l2)')} FROM w2
UNION ALL SELECT 'PC2', 'l_netprice', {R('s2 * v2y')}, {R('l2 / (l1 + l2)')} FROM w2"""
SQL["pca_scores"] = _PCA + f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {R(R('(l_extendedprice - mx) * s1 * v1x + (l_netprice - my) * s1 * v1y', 4))} AS PC1,
       {R(R('(l_extendedprice - mx) * s2 * v2x + (l_netprice - my) * s2 * v2y', 4))} AS PC2
FROM lineitem_t, w2"""


# ---- stage 7: comparison tables ---------------------------------------------
def _rule_metrics(t: float, i: int) -> str:
    return f"""
SELECT {i} AS ordinal, 'Rule {t}' AS model,
  avg(CASE WHEN label = pr THEN 1.0 ELSE 0.0 END) AS accuracy,
  (SELECT sum(coalesce(tp * 1.0 / nullif(np, 0), 0) * sup) / sum(sup) FROM pc{i}) AS precision,
  (SELECT sum(coalesce(tp * 1.0 / nullif(sup, 0), 0) * sup) / sum(sup) FROM pc{i}) AS recall,
  (SELECT sum(coalesce(2 * (tp * 1.0 / nullif(np, 0)) * (tp * 1.0 / nullif(sup, 0))
        / nullif(tp * 1.0 / nullif(np, 0) + tp * 1.0 / nullif(sup, 0), 0), 0) * sup) / sum(sup) FROM pc{i}) AS f1,
  (SELECT avg(a) FROM fa{i}) AS cv_mean, (SELECT stddev_pop(a) FROM fa{i}) AS cv_std,
  (SELECT auc FROM au) AS roc_auc
FROM r{i}"""


def _rule_ctes() -> str:
    parts = []
    for i, t in enumerate((0.4, 0.5, 0.6)):
        parts.append(f"""r{i} AS (SELECT label, CASE WHEN score > {t} THEN 1.0 ELSE 0.0 END AS pr,
  ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 7))::BIGINT % 5 AS fold FROM pred),
cl{i} AS (SELECT label AS c FROM r{i} UNION SELECT pr FROM r{i}),
pc{i} AS (SELECT c, (SELECT count(*) FROM r{i} WHERE label = c) AS sup, (SELECT count(*) FROM r{i} WHERE pr = c) AS np,
                 (SELECT count(*) FROM r{i} WHERE label = c AND pr = c) AS tp FROM cl{i}),
fa{i} AS (SELECT fold, avg(CASE WHEN label = pr THEN 1.0 ELSE 0.0 END) AS a FROM r{i} GROUP BY fold)""")
    auc = """au AS (SELECT sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(N)) AS auc FROM
  (SELECT t, (SELECT count(*) FROM pred WHERE score >= t AND label = 1) AS tp,
          (SELECT count(*) FROM pred WHERE score = t AND label = 1) AS pos,
          (SELECT count(*) FROM pred WHERE score = t AND label <> 1) AS neg FROM (SELECT DISTINCT score AS t FROM pred)),
  (SELECT sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS P, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS N FROM pred))"""
    return "WITH " + PRED + ",\n" + ",\n".join(parts) + ",\n" + auc + ",\nmt AS (" + \
        _union([_rule_metrics(t, i) for i, t in enumerate((0.4, 0.5, 0.6))]) + ")\n"


SQL["metrics_table"] = _rule_ctes() + f"""SELECT model AS "Model", {R('accuracy')} AS "Accuracy", {R('precision')} AS "Precision",
  {R('recall')} AS "Recall", {R('f1')} AS "F1-Score", {R('cv_mean')} AS "CV Mean", {R('cv_std')} AS "CV Std",
  {R('roc_auc')} AS "ROC-AUC" FROM mt ORDER BY ordinal"""

_MCOLS = ["accuracy", "precision", "recall", "f1", "cv_mean", "cv_std", "roc_auc"]
SQL["metric_extremes"] = _rule_ctes() + ", lg AS (" + _union([
    f"SELECT ordinal, model, '{m}' AS metric, {m} AS value FROM mt" for m in _MCOLS]) + f""")
SELECT metric,
  (SELECT model FROM lg b WHERE b.metric = a.metric ORDER BY value DESC, ordinal LIMIT 1) AS max_model,
  {R('max(value)')} AS max_value,
  (SELECT model FROM lg b WHERE b.metric = a.metric ORDER BY value ASC, ordinal LIMIT 1) AS min_model,
  {R('min(value)')} AS min_value
FROM lg a WHERE value IS NOT NULL GROUP BY metric"""
SQL["recommend_model"] = _rule_ctes() + """SELECT
  (SELECT model FROM mt ORDER BY accuracy DESC, ordinal LIMIT 1) AS best_accuracy,
  (SELECT model FROM mt ORDER BY f1 DESC, ordinal LIMIT 1) AS best_f1,
  (SELECT model FROM mt ORDER BY cv_mean DESC, ordinal LIMIT 1) AS best_cv,
  (SELECT model FROM mt ORDER BY f1 DESC, ordinal LIMIT 1) AS recommended"""


# ---- stage 8: round trips equal their source ---------------------------------
SQL["read_csv"] = "WITH " + EVENTS_NULLS + f"\nSELECT event_id, ts, user_id, event_type, {R('value')} AS value, props FROM events_n"
SQL["read_json"] = SQL["read_csv"]
SQL["read_workbooks"] = f"SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, {R('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer"
SQL["write_predictions"] = SQL["gaussian_nb"]
SQL["save_model"] = SQL["gaussian_nb"]
SQL["load_model"] = SQL["knn_classify"]
SQL["register_model"] = """SELECT 'Logistic Regression' AS model_name, true AS is_classification
UNION ALL SELECT 'Naive Bayes', true"""


SQL["histograms"] = _union([f"""
SELECT * FROM (
  WITH r AS (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem),
  c AS (SELECT least(coalesce(floor(({c} - lo) / nullif(hi - lo, 0) * 30) + 1, 1), 30)::INTEGER AS bin, count(*) AS count
        FROM lineitem, r WHERE {c} IS NOT NULL GROUP BY 1)
  SELECT '{c}' AS column_name, g.i::INTEGER AS bin, {R('lo + (g.i - 1) * (hi - lo) / 30')} AS lower,
         {R('lo + g.i * (hi - lo) / 30')} AS upper, coalesce(c.count, 0) AS count
  FROM range(1, 31) g(i) CROSS JOIN r LEFT JOIN c ON c.bin = g.i)""" for c in ("l_quantity", "l_extendedprice", "l_discount")])


SQL["insights_small"] = f"""WITH t AS (SELECT concat_ws('|', l_returnflag, l_linestatus) AS flag, count(*) AS n_lines
           FROM lineitem GROUP BY l_returnflag, l_linestatus),
nl AS (SELECT count(*) AS n, (count(*) - count(flag)) + (count(*) - count(n_lines)) AS miss FROM t),
sk AS (SELECT 'n_lines' AS c, skewness(n_lines) AS s FROM t),
nd AS (SELECT 'flag' AS c, count(DISTINCT flag) AS d, sum(strlen(flag)) AS bytes FROM t),
ot AS (SELECT count(*) AS total FROM t,
         (SELECT quantile_cont(n_lines, 0.25) AS q1, quantile_cont(n_lines, 0.75) AS q3 FROM t)
       WHERE n_lines < q1 - 1.5 * (q3 - q1) OR n_lines > q3 + 1.5 * (q3 - q1))
SELECT 1 AS rule_id, 'missing_values' AS rule, NULL::VARCHAR AS column_name, miss::DOUBLE AS value FROM nl WHERE miss > 0
UNION ALL SELECT 2, 'skewed', c, {R('s')} FROM sk WHERE abs(s) > 1
UNION ALL SELECT 4, 'few_categories', c, d::DOUBLE FROM nd WHERE d < 5
UNION ALL SELECT 7, 'high_cardinality', c, d::DOUBLE FROM nd, nl WHERE d > n * 0.8
UNION ALL SELECT 9, 'heavy_text', c, bytes::DOUBLE FROM nd WHERE bytes > 1000000
UNION ALL SELECT 5, 'high_missing', NULL, {R('miss * 100.0 / (n * 2)')} FROM nl WHERE miss * 100.0 / (n * 2) > 10
UNION ALL SELECT 5, 'no_missing', NULL, 0.0 FROM nl WHERE miss = 0
UNION ALL SELECT 6, 'outliers', NULL, total::DOUBLE FROM ot WHERE total > 0
UNION ALL SELECT 10, 'small_dataset', NULL, n::DOUBLE FROM nl WHERE n < 100
UNION ALL SELECT 10, 'large_dataset', NULL, n::DOUBLE FROM nl WHERE n > 100000"""


# ---- planted parts: what sound models predict is known ------------------------
PART = """pp AS (
  SELECT p_partkey, p_size + 40.0 * (CASE WHEN p_size < 15 THEN 0 WHEN p_size < 35 THEN 1 ELSE 2 END) AS gap,
         CASE WHEN p_size < 15 THEN 0 ELSE 1 END AS bin,
         CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END AS cls,
         CASE WHEN p_size < 15 THEN 2.5::DOUBLE ELSE 10.0::DOUBLE END AS num,
         ('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 7))::BIGINT % 100 < 20 AS is_test
  FROM part)"""


def _exact(label: str) -> str:
    return f"WITH {PART} SELECT p_partkey, {label} AS actual, {label} AS prediction FROM pp WHERE is_test"


for _name, _label in (("logistic", "cls"), ("random_forest", "cls"), ("forest_regressor", "num"), ("decision_tree", "num"),
                      ("tree_classifier", "cls"), ("gbt", "bin"), ("gbt_regressor", "num"), ("gbt_classes", "cls"),
                      ("svm_rbf", "bin"), ("svm_classes", "cls"), ("svm_linear", "bin"), ("search_model", "cls"),
                      ("voting_classifier", "cls"), ("bagging", "cls"), ("boosting", "bin")):
    SQL[_name] = _exact(_label)
for _name in ("svr_rbf", "voting_regressor"):
    SQL[_name] = f"WITH {PART} SELECT count(*) AS n, true AS explains FROM pp WHERE is_test"

SQL["compare_models"] = """
SELECT 0 AS ordinal, 'Random Forest' AS model, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall,
       1.0::DOUBLE AS f1, 1.0::DOUBLE AS cv_mean, 0.0::DOUBLE AS cv_std, 1.0::DOUBLE AS roc_auc
UNION ALL SELECT 1, 'Logistic Regression', 1, 1, 1, 1, 1, 0, 1 UNION ALL SELECT 2, 'SVM', 1, 1, 1, 1, 1, 0, NULL"""
SQL["compare_regression"] = """
SELECT 0 AS ordinal, 'Random Forest' AS model, 0.0::DOUBLE AS mse, 0.0::DOUBLE AS mae, 1.0::DOUBLE AS r2, 0.0::DOUBLE AS rmse,
       1.0::DOUBLE AS cv_mean, 0.0::DOUBLE AS cv_std
UNION ALL SELECT 1, 'Decision Tree', 0, 0, 1, 0, 1, 0"""
SQL["comparison_points"] = """
SELECT model, 0.0::DOUBLE AS first_fpr, 1.0::DOUBLE AS best_tpr, 1.0::DOUBLE AS last_fpr, 1.0::DOUBLE AS last_tpr
FROM (VALUES ('Logistic Regression'), ('Decision Tree')) AS t(model)"""
SQL["cv_scores"] = "SELECT 'Logistic Regression' AS model, 1.0::DOUBLE AS cv_mean, 0.0::DOUBLE AS cv_std"
SQL["rfe"] = "SELECT 'gap' AS feature, 1 AS ranking"
SQL["grid_search"] = _union([
    f"SELECT '[(''C'', {c}), (''elastic_net'', {e})]' AS params, 1.0::DOUBLE AS mean_score, 0.0::DOUBLE AS std_score, "
    f"{'true' if (c, e) == (0.1, 1.0) else 'false'} AS best" for c in (0.1, 1.0, 10.0) for e in (1.0, 0.0)])
SQL["random_search"] = """SELECT 4::BIGINT AS n_drawn, 4::BIGINT AS n_different, 1::BIGINT AS n_best,
       1.0::DOUBLE AS least_score"""
SQL["quick_preview"] = "SELECT 'Accuracy' AS metric, 1.0::DOUBLE AS value UNION ALL SELECT 'R²', 1.0"
SQL["forest_importance"] = "SELECT 'gap' AS first, 1.0::DOUBLE AS total"
SQL["model_importance"] = "SELECT 'gap' AS feature, 3.0::DOUBLE AS importance UNION ALL SELECT 'noise', 2.0"
SQL["model_coefficients"] = "SELECT 'gap' AS feature, 3.0::DOUBLE AS value UNION ALL SELECT 'noise', -2.0"
SQL["recommend_regression"] = "WITH " + REG_PRED + """,
e AS (SELECT k, s, avg((label - prediction - s) ^ 2) AS mse FROM rp, (VALUES (0, 0.0), (1, -2.0), (2, 5.0)) AS v(k, s) GROUP BY k, s),
b AS (SELECT 'Shift ' || s::DOUBLE::VARCHAR AS m FROM e ORDER BY mse, k LIMIT 1)
SELECT m AS best_r2, m AS best_rmse, m AS best_cv, m AS recommended FROM b"""

SQL["correlation_wide"] = f"""
WITH l AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT 'e' || a.i AS col_x, 'e' || b.i AS col_y, CASE WHEN a.i = b.i THEN 1.0 ELSE {R('corr(a.x, b.x)')} END AS corr
FROM l a JOIN l b USING (vec_id) GROUP BY a.i, b.i"""
SQL["knn_rings"] = SQL["knn_classify"]


def _ttest(table: str, a: str, b: str) -> str:
    """The pooled test with its tail by Simpson's rule over 20,000 steps."""
    return f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, n_a, n_b, {R('mean_a')} AS mean_a, {R('mean_b')} AS mean_b, {R('t')} AS t_stat, dof,
       {R("1 - 2 * (abs(t) / 20000 / 3) * (SELECT sum((CASE WHEN g.i IN (0, 20000) THEN 1 WHEN g.i % 2 = 1 THEN 4 ELSE 2 END) "
          "* exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0) - 0.5 * ln(dof * pi()) "
          "- (dof + 1) / 2.0 * ln(1 + (abs(t) * g.i / 20000) ^ 2 / dof))) FROM range(0, 20001) AS g(i))")} AS p_value
FROM (SELECT *, (mean_a - mean_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / dof * (1.0 / n_a + 1.0 / n_b)) AS t FROM (
  SELECT count({a}) AS n_a, count({b}) AS n_b, avg({a}) AS mean_a, avg({b}) AS mean_b, var_samp({a}) AS v_a,
         var_samp({b}) AS v_b, count({a}) + count({b}) - 2 AS dof FROM {table}))"""


SQL["ttest_pvalue"] = "WITH ev AS (SELECT CASE WHEN event_id % 2 = 0 THEN value END AS even, " \
    "CASE WHEN event_id % 2 = 1 THEN value END AS odd FROM events)" + _union(
        [_ttest("lineitem", "l_discount", "l_tax"), _ttest("ev", "even", "odd")])

_LL = (f"ln(prior) - 0.5 * ({' + '.join(f'ln(2 * pi() * (v_{c} + eps))' for c in _E)}) "
       f"- ({' + '.join(f'(te.{c} - m_{c}) ^ 2 / (2 * (v_{c} + eps))' for c in _E)})")
_STATS = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _E)
_EPS = f"1e-9 * greatest({', '.join(f'var_pop({c})' for c in _E)})"
SQL["batch_predict"] = "WITH " + EMB_SPLIT + f""",
eps AS (SELECT {_EPS} AS eps FROM tr),
cs AS (SELECT ring AS c, count(*) * 1.0 / (SELECT count(*) FROM tr) AS prior, {_STATS} FROM tr GROUP BY ring),
ll AS (SELECT te.vec_id, cs.c, {_LL} AS ll FROM te, cs, eps),
pv AS (SELECT vec_id, max(ll) FILTER (WHERE c = 0) AS a, max(ll) FILTER (WHERE c = 1) AS b FROM ll GROUP BY vec_id)
SELECT vec_id, CASE WHEN b > a THEN 1 ELSE 0 END AS "Predictions", {R('1 / (1 + exp(b - a))')} AS "Probability_Class_0",
       {R('1 / (1 + exp(a - b))')} AS "Probability_Class_1" FROM pv"""
SQL["cv_folds"] = "WITH " + EMB + f""",
n AS (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 7))::BIGINT,
                                   CAST(vec_id AS VARCHAR)) AS r, count(*) OVER (PARTITION BY ring) AS m FROM emb),
s AS (SELECT *, (r > m // 5)::INT + (r > m * 2 // 5)::INT + (r > m * 3 // 5)::INT + (r > m * 4 // 5)::INT AS fold FROM n),
f AS (SELECT unnest(range(5)) AS f),
tr AS (SELECT s.*, f.f FROM s, f WHERE s.fold <> f.f),
eps AS (SELECT f, {_EPS} AS eps FROM tr GROUP BY f),
cs AS (SELECT f, ring AS c, count(*) * 1.0 / (SELECT count(*) FROM tr t WHERE t.f = tr.f) AS prior, {_STATS} FROM tr GROUP BY f, ring),
ll AS (SELECT te.vec_id, te.ring, cs.f, cs.c, {_LL} AS ll FROM s te JOIN cs ON te.fold = cs.f JOIN eps ON eps.f = cs.f),
pr AS (SELECT f, ring, c, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, c) AS k FROM ll),
sc AS (SELECT f, avg(CASE WHEN ring = c THEN 1.0 ELSE 0.0 END) AS score FROM pr WHERE k = 1 GROUP BY f)
SELECT 'Fold ' || (f + 1) AS fold, {R('score')} AS score FROM sc
UNION ALL SELECT 'mean', {R('avg(score)')} FROM sc UNION ALL SELECT 'std', {R('stddev_pop(score)')} FROM sc
UNION ALL SELECT 'max', {R('max(score)')} FROM sc"""
SQL["naive_bayes_table"] = """
WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS x, o_custkey // 5 AS y FROM orders),
eps AS (SELECT 1e-9 * var_pop(x) AS eps FROM o),
cs AS (SELECT y, count(*) * 1.0 / (SELECT count(*) FROM o) AS prior, avg(x) AS m, greatest(var_pop(x) + any_value(eps), 1e-300) AS v
       FROM o, eps GROUP BY y),
ll AS (SELECT o_orderkey, cs.y, ln(prior) - 0.5 * ln(2 * pi() * v) - (x - m) ^ 2 / (2 * v) AS ll FROM o, cs)
SELECT o_orderkey, y::BIGINT AS prediction FROM ll
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY ll DESC, y) = 1"""

SQL["impute_by_column"] = "WITH " + EVENTS_NULLS + f""",
m AS (SELECT quantile_cont(value, 0.5) AS med FROM events_n)
SELECT event_id, coalesce(event_type, 'none') AS event_type, {R('coalesce(value, med)')} AS value, user_id
FROM events_n, m WHERE user_id IS NOT NULL"""
SQL["impute_drop"] = "WITH " + EVENTS_NULLS + f"""
SELECT event_id, event_type, {R('value')} AS value FROM events_n WHERE event_type IS NOT NULL AND value IS NOT NULL"""
SQL["append_by_name"] = f"""
SELECT c_custkey AS key, c_name AS name, {R('c_acctbal')} AS balance, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, {R('s_acctbal')}, NULL, s_nationkey FROM supplier"""
