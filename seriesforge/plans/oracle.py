"""DuckDB SQL for every registered query, written independently of the Spark code.

Tables are the driver's views (``orders``, ``customer`` ...). Casts pin the result types to what
Spark produces: DuckDB sums integers as HUGEINT and returns BIGINT from ``year()``, so those are
cast to BIGINT / INTEGER; ``date_trunc`` of a timestamp is cast to DATE.
"""

from __future__ import annotations

from ..operators.forecast import ELASTIC_NET, REG_PARAM
from . import queries as q

L1 = REG_PARAM * ELASTIC_NET            # the same doubles the Spark expressions use
L2 = REG_PARAM * (1.0 - ELASTIC_NET)

ORDERS_MARKET = f"""
om AS (
  SELECT o.o_orderkey, o.o_orderdate, o.o_totalprice, o.o_orderstatus, o.o_orderpriority,
         c.c_mktsegment, r.r_name, r.r_name = '{q.HOME_REGION}' AS domestic
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"

MARKET_SERIES = f"""{ORDERS_MARKET},
intl AS (SELECT {MONTH} AS month, COUNT(*) AS international FROM om WHERE NOT domestic GROUP BY 1),
dom AS (SELECT {MONTH} AS month, COUNT(*) AS domestic FROM om WHERE domestic GROUP BY 1)"""

GOLD_ALL = f"""{MARKET_SERIES},
gold_all AS (
  SELECT COALESCE(intl.month, dom.month) AS month, intl.international, dom.domestic,
         intl.international + dom.domestic AS total
  FROM intl FULL OUTER JOIN dom ON intl.month = dom.month)"""

GOLD = f"""{GOLD_ALL},
gold AS (SELECT * FROM gold_all WHERE month < DATE '{q.GOLD_CUTOFF}')"""

YEARLY = f"""{GOLD},
yearly AS (
  SELECT CAST(year(month) AS INTEGER) AS year, CAST(SUM(international) AS BIGINT) AS international,
         CAST(SUM(domestic) AS BIGINT) AS domestic, CAST(SUM(total) AS BIGINT) AS total
  FROM gold GROUP BY 1)"""

YEARLY_ALL = f"""{GOLD_ALL},
yearly AS (
  SELECT CAST(year(month) AS INTEGER) AS year, CAST(SUM(international) AS BIGINT) AS international,
         CAST(SUM(domestic) AS BIGINT) AS domestic, CAST(SUM(total) AS BIGINT) AS total
  FROM gold_all GROUP BY 1)"""

ORDERS_SHIPMENTS = """
l AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS status, COUNT(*) AS orders
      FROM orders GROUP BY 1, 2),
r AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_linestatus AS status, COUNT(*) AS shipments
      FROM lineitem GROUP BY 1, 2),
j AS (SELECT COALESCE(l.month, r.month) AS month, COALESCE(l.status, r.status) AS status, l.orders, r.shipments
      FROM l FULL OUTER JOIN r ON l.month = r.month AND l.status = r.status)"""

SEGMENT_MONTHLY = f"""{ORDERS_MARKET},
seg AS (
  SELECT c_mktsegment, {MONTH} AS month, COUNT(*) AS n_orders,
         COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent
  FROM om GROUP BY 1, 2)"""


def _imputed(divisor: str) -> str:
    y = q.IMPUTE_YEAR
    return f"""WITH {SEGMENT_MONTHLY},
known AS (
  SELECT c_mktsegment, COUNT(DISTINCT month(month)) AS k, SUM(n_orders) AS s_orders, SUM(n_urgent) AS s_urgent
  FROM seg WHERE month BETWEEN DATE '{y}-01-01' AND DATE '{y}-12-31' GROUP BY 1),
cal AS (SELECT CAST(d AS DATE) AS month FROM generate_series(DATE '{y}-01-01', DATE '{y}-12-01', INTERVAL 1 MONTH) t(d)),
gaps AS (
  SELECT known.*, cal.month FROM known CROSS JOIN cal
  WHERE NOT EXISTS (SELECT 1 FROM seg WHERE seg.c_mktsegment = known.c_mktsegment AND seg.month = cal.month)),
imputed AS (
  SELECT c_mktsegment, month, CAST(s_orders // ({divisor}) AS BIGINT) AS n_orders,
         CAST(s_urgent // ({divisor}) AS BIGINT) AS n_urgent, CAST(NULL AS BIGINT) AS n_orders_reported,
         TRUE AS imputed
  FROM gaps WHERE ({divisor}) > 0),
series AS (
  SELECT c_mktsegment, month, n_orders, n_urgent, n_orders AS n_orders_reported, FALSE AS imputed FROM seg
  UNION ALL SELECT * FROM imputed)"""


REGION_YEARLY = f"""{ORDERS_MARKET},
ry AS (SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n_orders FROM om GROUP BY 1, 2)"""


def _fit(name: str, cutoff: int, src: str = "ry", y: str = "n_orders", key: str | None = "r_name") -> str:
    """Closed-form elastic-net fit of ``y`` on ``year`` (years <= cutoff) per ``key`` (or one
    global fit when ``key`` is None), as a CTE ``name``."""
    t = f"year <= {cutoff} AND {y} IS NOT NULL"
    k = f"{key}, " if key else ""
    group = "GROUP BY 1" if key else ""
    return f"""{name}_s AS (
  SELECT {k}MAX(year) AS last_year,
         COUNT(CASE WHEN {t} THEN year END) AS n,
         AVG(CASE WHEN {t} THEN CAST(year AS DOUBLE) END) AS xm,
         AVG(CASE WHEN {t} THEN CAST({y} AS DOUBLE) END) AS ym,
         STDDEV_POP(CASE WHEN {t} THEN CAST(year AS DOUBLE) END) AS sx,
         STDDEV_POP(CASE WHEN {t} THEN CAST({y} AS DOUBLE) END) AS sy,
         COVAR_POP(CASE WHEN {t} THEN CAST({y} AS DOUBLE) END, CASE WHEN {t} THEN CAST(year AS DOUBLE) END) AS c
  FROM {src} {group}),
{name}_k AS (
  SELECT {k}last_year, xm, ym,
         CASE WHEN n = 0 THEN NULL WHEN sx = 0 OR sy = 0 THEN 0.0
              ELSE sign(c) * (greatest(abs(c) / sx - {L1!r}, 0.0) / (sy + {L2!r})) * (sy / sx) END AS slope
  FROM {name}_s),
{name} AS (SELECT {k}last_year, slope, ym - slope * xm AS intercept FROM {name}_k)"""


def _rows_with_futures(fit: str) -> str:
    return f"""futures AS (
  SELECT {fit}.r_name, CAST(g AS INTEGER) AS year
  FROM {fit}, generate_series({fit}.last_year + 1, {q.HORIZON}) t(g) WHERE {fit}.last_year < {q.HORIZON}),
rows_ AS (SELECT r_name, year, n_orders FROM ry UNION ALL SELECT r_name, year, CAST(NULL AS BIGINT) FROM futures)"""


def _score(fit: str) -> str:
    return f"CAST(round({fit}.intercept + {fit}.slope * CAST(rows_.year AS DOUBLE), {q.SCORE_DIGITS}) AS DECIMAL(38,4))"


_GOLD_IMPUTED = f"""WITH {GOLD_ALL},
known AS (
  SELECT COUNT(DISTINCT month(month)) AS k, SUM(international) AS s_i, SUM(domestic) AS s_d, SUM(total) AS s_t
  FROM gold_all WHERE year(month) = {q.IMPUTE_YEAR}),
cal AS (SELECT CAST(d AS DATE) AS month
        FROM generate_series(DATE '{q.IMPUTE_YEAR}-01-01', DATE '{q.IMPUTE_YEAR}-12-01', INTERVAL 1 MONTH) t(d)),
imputed AS (
  SELECT cal.month, CAST(s_i // (12 - k) AS BIGINT) AS international, CAST(s_d // (12 - k) AS BIGINT) AS domestic,
         CAST(s_t // (12 - k) AS BIGINT) AS total, CAST(NULL AS BIGINT) AS total_reported, TRUE AS imputed
  FROM known CROSS JOIN cal
  WHERE k > 0 AND 12 - k > 0 AND cal.month NOT IN (SELECT month FROM gold_all WHERE month IS NOT NULL)),
gold_imp AS (
  SELECT month, international, domestic, total, total AS total_reported, FALSE AS imputed FROM gold_all
  UNION ALL SELECT * FROM imputed)"""

_SEASONAL = f"""{GOLD_ALL},
s AS (SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, COUNT(*) AS n
      FROM om GROUP BY 1, 2, 3),
l AS (SELECT r_name, year, quarter,
             CAST(SUM(n) OVER (PARTITION BY r_name) * SUM(n) OVER (PARTITION BY quarter) AS BIGINT) AS label FROM s)"""

ORACLE: dict[str, str] = {
    "combine_monthly": f"""WITH {GOLD}
SELECT month, international, domestic, total FROM gold ORDER BY month""",

    "outer_join_series": f"""WITH {ORDERS_SHIPMENTS}
SELECT month, status, orders, shipments, orders + shipments AS total FROM j""",

    "combine_before": f"""WITH {ORDERS_SHIPMENTS}
SELECT month, status, orders, shipments, COALESCE(orders, 0) + COALESCE(shipments, 0) AS total
FROM j WHERE month < DATE '{q.COMBINE_BEFORE}'""",

    "quoted_names": f"""WITH {ORDERS_MARKET},
ry AS (SELECT c_mktsegment AS r_name, CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n_orders
       FROM om WHERE o_totalprice IS NOT NULL AND c_mktsegment IS NOT NULL AND o_orderdate < DATE '{q.GOLD_CUTOFF}'
       GROUP BY 1, 2),
{_fit("fit", q.TRAIN_UNTIL)},
{_rows_with_futures("fit")}
SELECT rows_.r_name AS "Market Seg.%", rows_.year AS "Yr.", rows_.n_orders AS "No. %", {_score("fit")} AS "Pred. %"
FROM rows_ JOIN fit ON rows_.r_name = fit.r_name""",

    "monthly_rollup": f"""WITH {ORDERS_MARKET}
SELECT r_name, {MONTH} AS month, COUNT(*) AS n_orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue
FROM om GROUP BY 1, 2""",

    "quarterly_rollup": f"""WITH {GOLD}
SELECT CAST(year(month) AS VARCHAR) || '-Q' || CAST(quarter(month) AS VARCHAR) AS period,
       CAST(SUM(international) AS BIGINT) AS international, CAST(SUM(domestic) AS BIGINT) AS domestic,
       CAST(SUM(total) AS BIGINT) AS total
FROM gold GROUP BY 1 ORDER BY 1""",

    "yearly_rollup": f"""WITH {YEARLY}
SELECT * FROM yearly ORDER BY year""",

    "yearly_rollup_provenance": _imputed("12 - k") + """
SELECT c_mktsegment, CAST(year(month) AS INTEGER) AS year,
       CAST(SUM(n_orders_reported) AS BIGINT) AS n_orders_reported, CAST(SUM(n_orders) AS BIGINT) AS n_orders,
       CAST(SUM(n_urgent) AS BIGINT) AS n_urgent
FROM series GROUP BY 1, 2""",

    "global_sums": """SELECT COUNT(*) AS n_lines, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_quantity,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_price
FROM lineitem""",

    "column_bounds": """SELECT CAST(MIN(o_orderdate) AS DATE) AS min_value, CAST(MAX(o_orderdate) AS DATE) AS max_value
FROM orders""",

    "quality_not_null": """WITH raw AS (
  SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS month,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS value
  FROM orders)
SELECT month, COUNT(*) AS n_orders, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue
FROM raw WHERE month IS NOT NULL AND value IS NOT NULL GROUP BY 1""",

    "cutoff_filter": f"""SELECT {MONTH} AS month, COUNT(*) AS n_orders FROM orders
WHERE o_orderdate < DATE '{q.CUTOFF_DATE}' GROUP BY 1""",

    "range_filter": f"""SELECT {MONTH} AS month, COUNT(*) AS n_orders FROM orders
WHERE o_orderdate BETWEEN DATE '{q.RANGE_LOW}' AND DATE '{q.RANGE_HIGH}' GROUP BY 1""",

    "project_drop": """SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
FROM orders ORDER BY o_orderkey""",

    "case_known_range": f"""WITH {YEARLY_ALL}
SELECT year, total, CASE WHEN year <= {q.KNOWN_UNTIL} THEN total END AS known_total FROM yearly""",

    "train_test_split": f"""WITH {YEARLY_ALL}
SELECT 'train' AS split, COUNT(*) AS n_years, CAST(SUM(total) AS BIGINT) AS total FROM yearly WHERE year <= {q.SPLIT_YEAR}
UNION ALL
SELECT 'test' AS split, COUNT(*) AS n_years, CAST(SUM(total) AS BIGINT) AS total FROM yearly WHERE year > {q.SPLIT_YEAR}""",

    "sorted_series": f"""WITH {ORDERS_MARKET}
SELECT r_name, month, n_orders, row_number() OVER (ORDER BY r_name, month) AS position
FROM (SELECT r_name, {MONTH} AS month, COUNT(*) AS n_orders FROM om GROUP BY 1, 2)""",

    "latest_n": f"""WITH {GOLD_ALL}
SELECT month, international, domestic, total FROM gold_all ORDER BY month DESC LIMIT {q.LATEST_N}""",

    "union_missing_columns": f"""WITH {YEARLY_ALL},
last AS (SELECT MAX(year) AS last_year FROM yearly)
SELECT year, international, domestic, total FROM yearly
UNION ALL
SELECT CAST(g AS INTEGER) AS year, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
FROM last, generate_series(last.last_year + 1, {q.HORIZON}) t(g) WHERE last.last_year < {q.HORIZON}""",

    "future_years": f"""WITH {REGION_YEARLY},
last AS (SELECT r_name, MAX(year) AS last_year FROM ry GROUP BY 1)
SELECT r_name, CAST(g AS INTEGER) AS year
FROM last, generate_series(last.last_year + 1, {q.HORIZON}) t(g) WHERE last.last_year < {q.HORIZON}""",

    "calendar_gaps": f"""WITH {SEGMENT_MONTHLY},
keys AS (SELECT DISTINCT c_mktsegment FROM seg WHERE year(month) = {q.IMPUTE_YEAR}),
cal AS (SELECT CAST(d AS DATE) AS month
        FROM generate_series(DATE '{q.IMPUTE_YEAR}-01-01', DATE '{q.IMPUTE_YEAR}-12-01', INTERVAL 1 MONTH) t(d))
SELECT keys.c_mktsegment, cal.month FROM keys CROSS JOIN cal
WHERE NOT EXISTS (SELECT 1 FROM seg WHERE seg.c_mktsegment = keys.c_mktsegment AND seg.month = cal.month)""",

    "csv_month_ingest": f"""SELECT {MONTH} AS month, COUNT(*) AS orders FROM orders GROUP BY 1""",

    "csv_header_ingest": """WITH per_nation AS (
  SELECT c_nationkey, COUNT(*) AS customers,
         CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS balance
  FROM customer GROUP BY 1)
SELECT n.n_nationkey AS nation_key, n.n_name AS nation, COALESCE(p.customers, 0) AS customers, p.balance
FROM nation n LEFT JOIN per_nation p ON n.n_nationkey = p.c_nationkey""",

    "gold_roundtrip": f"""WITH {GOLD_ALL}
SELECT CAST(year(month) AS INTEGER) AS year, CAST(SUM(international) AS BIGINT) AS international,
       CAST(SUM(domestic) AS BIGINT) AS domestic, CAST(SUM(total + 1) AS BIGINT) AS total
FROM gold_all GROUP BY 1""",

    "chart_text_roundtrip": """WITH t AS (
  SELECT 'doc' AS kind, doc_id AS id, text, CAST(NULL AS TIMESTAMP) AS ts FROM documents
  UNION ALL
  SELECT 'turn', conv_id * 100000 + turn, '  "' || text || '"' || chr(13) || chr(10) || ' ', NULL FROM conversations
  UNION ALL SELECT 'event', event_id, event_type, CAST(ts AS TIMESTAMP) FROM events
  UNION ALL SELECT 'null', n_nationkey, NULL, NULL FROM nation
  UNION ALL SELECT 'empty', n_nationkey, '', NULL FROM nation
  UNION ALL SELECT 'marker', n_nationkey, repeat(chr(92), CAST(n_nationkey + 1 AS BIGINT)) || 'N', NULL FROM nation)
SELECT kind, CAST(id AS BIGINT) AS id, CAST(length(text) AS BIGINT) AS n, sha256(text) AS digest, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM t""",

    "forecast_gbt_global": f"""WITH {YEARLY_ALL}
SELECT year, total, CAST((SELECT MAX_BY(t.total, t.year) FROM yearly t
                          WHERE t.year <= LEAST(yearly.year, {q.GBT_TRAIN_UNTIL})) AS DECIMAL(38,4)) AS prediction
FROM yearly""",

    "chart_data_export": f"""WITH {GOLD_ALL},
q AS (SELECT CAST(year(month) AS VARCHAR) || '-Q' || CAST(quarter(month) AS VARCHAR) AS period,
             CAST(SUM(international) AS BIGINT) AS international, CAST(SUM(domestic) AS BIGINT) AS domestic,
             CAST(SUM(total) AS BIGINT) AS total
      FROM gold_all GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY period) AS position FROM q""",

    "rollup_grains": f"""WITH {ORDERS_MARKET},
m AS (SELECT r_name, {MONTH} AS month, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period,
             CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM om)
SELECT 'month' AS grain, r_name, month, CAST(NULL AS VARCHAR) AS period, CAST(NULL AS INTEGER) AS year, COUNT(*) AS n_orders,
       CAST(SUM(price) AS DECIMAL(38,2)) AS revenue FROM m GROUP BY 2, 3
UNION ALL SELECT 'quarter', r_name, NULL, period, NULL, COUNT(*), CAST(SUM(price) AS DECIMAL(38,2)) FROM m GROUP BY r_name, period
UNION ALL SELECT 'year', r_name, NULL, NULL, year, COUNT(*), CAST(SUM(price) AS DECIMAL(38,2)) FROM m GROUP BY r_name, year""",

    "csv_rejects": f"""WITH s AS (SELECT o_orderpriority, {MONTH} AS month, COUNT(*) AS orders FROM orders GROUP BY 1, 2),
t AS (SELECT *, orders % 10 AS digit, strftime(month, '%B %Y') AS good FROM s),
u AS (SELECT month, orders, digit,
             CASE WHEN digit IN (1, 3) THEN strftime(month, '%Y/%m') WHEN digit = 5 THEN '' ELSE good END AS m,
             CASE WHEN digit IN (2, 3) THEN 'n/a' WHEN digit = 7 THEN '' ELSE CAST(orders AS VARCHAR) END AS v FROM t)
SELECT 'row' AS kind, month, orders, CAST(NULL AS VARCHAR) AS line, CAST(NULL AS VARCHAR) AS reason, TRUE AS from_file
FROM u WHERE digit NOT IN (1, 2, 3, 5, 7)
UNION ALL
SELECT 'reject', NULL, NULL, CASE WHEN digit = 5 THEN ',' || v WHEN digit = 7 THEN m || ',' ELSE '"' || m || '","' || v || '"' END,
       CASE digit WHEN 1 THEN 'unparsable period' WHEN 2 THEN 'unparsable value' WHEN 3 THEN 'unparsable period and value'
                  WHEN 5 THEN 'period' ELSE 'value' END, TRUE
FROM u WHERE digit IN (1, 2, 3, 5, 7)
UNION ALL
SELECT 'reject', NULL, NULL, 'SOURCE: ' || o_orderpriority || ', months', 'unparsable period and value', TRUE
FROM (SELECT DISTINCT o_orderpriority FROM orders)""",

    "calendar_gaps_all": f"""WITH m AS (SELECT * FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
s AS (SELECT CAST(c_nationkey AS VARCHAR) || ' ' || o_orderpriority || ' ' || o_orderstatus AS series, {MONTH} AS month FROM m
      UNION SELECT c_mktsegment, {MONTH} FROM m),
b AS (SELECT series, MIN(month) AS lo, MAX(month) AS hi FROM s GROUP BY 1),
spine AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM b)
SELECT series, month FROM spine ANTI JOIN s USING (series, month)""",

    "forecast_elastic_net": f"""WITH {ORDERS_MARKET},
s AS (SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, COUNT(*) AS n_orders
      FROM om GROUP BY 1, 2, 3),
m AS (SELECT r_name, AVG(CAST(year AS DOUBLE)) AS m1, AVG(CAST(quarter AS DOUBLE)) AS m2, AVG(CAST(n_orders AS DOUBLE)) AS my,
             STDDEV_POP(CAST(year AS DOUBLE)) AS s1, STDDEV_POP(CAST(quarter AS DOUBLE)) AS s2, STDDEV_POP(CAST(n_orders AS DOUBLE)) AS sy,
             COVAR_POP(CAST(year AS DOUBLE), CAST(quarter AS DOUBLE)) AS c12,
             COVAR_POP(CAST(year AS DOUBLE), CAST(n_orders AS DOUBLE)) AS c1y, COVAR_POP(CAST(quarter AS DOUBLE), CAST(n_orders AS DOUBLE)) AS c2y
      FROM s WHERE year <= {q.QUARTER_TRAIN_UNTIL} GROUP BY 1),
k AS (SELECT *, c12 / (s1 * s2) AS r, c1y / (s1 * sy) AS b1, c2y / (s2 * sy) AS b2, 1 + {q.RIDGE!r} / sy AS d FROM m),
w AS (SELECT r_name, m1, m2, my, (b1 * d - r * b2) / (d * d - r * r) * sy / s1 AS w1, (b2 * d - r * b1) / (d * d - r * r) * sy / s2 AS w2 FROM k)
SELECT s.r_name, s.year, s.quarter, s.n_orders,
       CAST(round(my + w1 * (s.year - m1) + w2 * (s.quarter - m2), {q.SCORE_DIGITS}) AS DECIMAL(38,4)) AS prediction
FROM s JOIN w ON s.r_name = w.r_name""",

    "forecast_gbt_indexed": f"""WITH {_SEASONAL}
SELECT r_name, year, quarter, label, CAST(label AS DECIMAL(38,4)) AS prediction FROM l""",

    "score_saved_model": f"""WITH {_SEASONAL},
years AS (SELECT CAST(g AS INTEGER) AS year FROM generate_series({q.SCORE_YEARS[0]}, {q.SCORE_YEARS[1]}) t(g)),
t AS (SELECT CAST(year(month) AS INTEGER) AS year, CAST(SUM(total) AS BIGINT) AS total FROM gold_all GROUP BY 1)
SELECT 'total' AS model, CAST(NULL AS VARCHAR) AS r_name, year, CAST(NULL AS INTEGER) AS quarter,
       CAST((SELECT MAX_BY(total, t.year) FROM t WHERE t.year <= {q.GBT_TRAIN_UNTIL}) AS DECIMAL(38,4)) AS prediction, TRUE AS same
FROM years
UNION ALL
SELECT 'region', r_name, years.year, quarter, CAST(label AS DECIMAL(38,4)), TRUE
FROM years, (SELECT DISTINCT r_name, quarter, label FROM l) d""",

    "chart_descriptor": f"""WITH {YEARLY_ALL},
b AS (SELECT MIN(year) AS lo, MAX(year) AS hi FROM yearly)
SELECT v.position, v.key, v.header, '{q.CHART_SOURCE}' AS source, '{q.CHART_TITLE}' AS title,
       'Year ' || CAST(b.lo AS VARCHAR) || ' - ' || CAST(b.hi AS VARCHAR) AS xtitle,
       '{q.CHART_Y_TITLE}' AS ytitle, 'labels' AS xscale
FROM (VALUES (0, 'year', 'Year'), (1, 'international', 'International orders'),
             (2, 'domestic', 'Domestic orders'), (3, 'total', 'Orders')) v(position, key, header), b""",

    "impute_year": _imputed("12 - k") + """
SELECT * FROM series""",

    "impute_year_mean": _imputed("k") + """
SELECT * FROM series""",

    "forecast_linear": f"""WITH {REGION_YEARLY},
{_fit("fit", q.TRAIN_UNTIL)},
{_rows_with_futures("fit")}
SELECT rows_.r_name, rows_.year, rows_.n_orders, {_score("fit")} AS prediction
FROM rows_ JOIN fit ON rows_.r_name = fit.r_name""",

    "forecast_two_horizons": f"""WITH {REGION_YEARLY},
{_fit("fa", q.HORIZONS[0])},
{_fit("fb", q.HORIZONS[1])},
{_rows_with_futures("fa")}
SELECT rows_.r_name, rows_.year, rows_.n_orders,
       CASE WHEN rows_.year <= {q.KNOWN_UNTIL} THEN rows_.n_orders END AS known_{q.KNOWN_UNTIL},
       {_score("fa")} AS prediction_{q.HORIZONS[0]}, {_score("fb")} AS prediction_{q.HORIZONS[1]}
FROM rows_ JOIN fa ON rows_.r_name = fa.r_name JOIN fb ON rows_.r_name = fb.r_name""",

    "impute_gold_all": _GOLD_IMPUTED + """
SELECT * FROM gold_imp""",

    "forecast_imputed_horizons": _GOLD_IMPUTED + f""",
yi AS (
  SELECT CAST(year(month) AS INTEGER) AS year, CAST(SUM(total_reported) AS BIGINT) AS total_reported,
         CAST(SUM(total) AS BIGINT) AS total
  FROM gold_imp GROUP BY 1),
{_fit("fa", q.IMPUTED_HORIZONS[0], src="yi", y="total", key=None)},
{_fit("fb", q.IMPUTED_HORIZONS[1], src="yi", y="total", key=None)},
fut AS (SELECT CAST(g AS INTEGER) AS year FROM fa, generate_series(fa.last_year + 1, {q.HORIZON}) t(g)
        WHERE fa.last_year < {q.HORIZON}),
rows_ AS (SELECT year, total_reported, total FROM yi
          UNION ALL SELECT year, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM fut)
SELECT rows_.year, rows_.total_reported, rows_.total,
       {_score("fa")} AS prediction_{q.IMPUTED_HORIZONS[0]}, {_score("fb")} AS prediction_{q.IMPUTED_HORIZONS[1]},
       CASE WHEN rows_.year <= {q.KNOWN_UNTIL} THEN rows_.total END AS known_{q.KNOWN_UNTIL}
FROM rows_, fa, fb""",

    "chart_dashboard": f"""WITH {GOLD_ALL},
q AS (SELECT CAST(year(month) AS VARCHAR) || '-Q' || CAST(quarter(month) AS VARCHAR) AS period, SUM(total) AS total
      FROM gold_all GROUP BY 1),
y AS (SELECT year(month) AS year, SUM(total) AS total FROM gold_all GROUP BY 1)
SELECT 'month' AS chart, COUNT(*) AS n_rows, CAST(SUM(total) AS BIGINT) AS total FROM gold_all
UNION ALL SELECT 'quarter', COUNT(*), CAST(SUM(total) AS BIGINT) FROM q
UNION ALL SELECT 'year', COUNT(*), CAST(SUM(total) AS BIGINT) FROM y""",

    "rmse_by_key": f"""WITH {REGION_YEARLY},
{_fit("fit", q.RMSE_TRAIN_UNTIL)},
err AS (
  SELECT ry.r_name, CAST(ry.n_orders AS DOUBLE) - (fit.intercept + fit.slope * CAST(ry.year AS DOUBLE)) AS e
  FROM ry JOIN fit ON ry.r_name = fit.r_name
  WHERE ry.year > {q.RMSE_TRAIN_UNTIL})
SELECT r_name, CAST(round(sqrt(AVG(e * e)), {q.SCORE_DIGITS}) AS DECIMAL(38,4)) AS rmse, COUNT(e) AS n
FROM err GROUP BY 1""",
}
