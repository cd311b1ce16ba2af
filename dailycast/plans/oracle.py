"""Independent SQL (DuckDB dialect) for the registered queries.

The SQL restates each query's semantics from scratch on the raw test
tables; it shares no code with the Spark operators, only the contract
(column names, adapters, exact DECIMAL sums, 4-digit rounding of averages).
"""

from __future__ import annotations

# --- adapters (transaction-shaped rows) ------------------------------------

TX = {
    "retail": """tx AS (
  SELECT n.n_name AS Outlet,
         CAST(l.l_shipdate AS TIMESTAMP) AS Date,
         l.l_extendedprice AS "Total Sales Amount",
         CAST(round(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(18,2)), 2) AS DOUBLE)
           AS "Total Discount"
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)""",
    "events_type": """tx AS (
  SELECT event_type AS Outlet, date_trunc('day', ts) AS Date, value AS "Total Sales Amount",
         CAST(0 AS DOUBLE) AS "Total Discount"
  FROM events)""",
    "events_user": """tx AS (
  SELECT CAST(user_id AS VARCHAR) AS Outlet, date_trunc('day', ts) AS Date, value AS "Total Sales Amount",
         CAST(0 AS DOUBLE) AS "Total Discount"
  FROM events)""",
}

DAILY = """daily AS (
  SELECT Outlet, Date,
         CAST(coalesce(sum(CAST("Total Sales Amount" AS DECIMAL(28,8))), 0) AS DOUBLE) AS "Total Sales Amount",
         CAST(coalesce(sum(CAST("Total Discount" AS DECIMAL(28,8))), 0) AS DOUBLE) AS "Total Discount"
  FROM tx WHERE Outlet IS NOT NULL AND Date IS NOT NULL
  GROUP BY Outlet, Date)"""


def _ma(n: int, full: bool) -> str:
    frame = f"(PARTITION BY Outlet ORDER BY Date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    s = f'CAST(sum(CAST("Total Sales Amount" AS DECIMAL(28,8))) OVER {frame} AS DOUBLE)'
    c = f'count("Total Sales Amount") OVER {frame}'
    cond = f"{c} = {n}" if full else f"{c} > 0"
    return f"CASE WHEN {cond} THEN {s} / {c} END AS ma_{n}"


def calendar_sql(d: str = "Date", weekend: str = "4, 5, 6") -> str:
    return (f"CAST(dayofmonth({d}) AS INTEGER) AS day, CAST(isodow({d}) - 1 AS INTEGER) AS weekday, "
            f"CAST(week({d}) AS INTEGER) AS week, CAST(month({d}) AS INTEGER) AS month, "
            f"CAST(year({d}) AS INTEGER) AS year, CAST(isodow({d}) - 1 IN ({weekend}) AS INTEGER) AS is_weekend")


def feat_cte(name: str = "feat", source: str = "daily", full: bool = False, drop: bool = False,
             weekend: str = "4, 5, 6") -> str:
    w = "(PARTITION BY Outlet ORDER BY Date)"
    body = f"""SELECT Outlet, Date, "Total Sales Amount", "Total Discount", {calendar_sql('Date', weekend)},
         lag("Total Sales Amount", 1) OVER {w} AS lag_1,
         lag("Total Sales Amount", 7) OVER {w} AS lag_7,
         lag("Total Sales Amount", 14) OVER {w} AS lag_14,
         {_ma(7, full)}, {_ma(14, full)}
  FROM {source}"""
    if drop:
        inner = f"{name}_all AS (\n  {body})"
        return (inner + f""",
{name} AS (SELECT * FROM {name}_all
  WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL
    AND ma_7 IS NOT NULL AND ma_14 IS NOT NULL)""")
    return f"{name} AS (\n  {body})"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def features_sql(adapter: str, drop: bool = True, full: bool = False) -> str:
    """Prefix ``WITH tx, daily, feat`` for an adapter."""
    return with_ctes(TX[adapter], DAILY, feat_cte(full=full, drop=drop))


# --- registered query SQL ---------------------------------------------------

ORACLE_SQL: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE_SQL[name] = text


sql("daily_sales", with_ctes(TX["events_user"], DAILY) + "SELECT * FROM daily")
sql("daily_sales_retail", with_ctes(TX["retail"], DAILY) + "SELECT * FROM daily")
sql("prepare_features", features_sql("events_user", drop=True) + "SELECT * FROM feat")
sql("prepare_features_retail_keep_nulls", features_sql("retail", drop=False) + "SELECT * FROM feat")


# --- step 2 ----------------------------------------------------------------------

_RETAIL_COLS = 'Outlet, Date, "Total Sales Amount", "Total Discount"'
TX_EXACT_USER = """tx AS (
  SELECT CAST(user_id AS VARCHAR) AS Outlet, ts AS Date, value AS "Total Sales Amount",
         CAST(0 AS DOUBLE) AS "Total Discount"
  FROM events)"""

sql("scan_transactions", with_ctes(TX["retail"]) + f"SELECT {_RETAIL_COLS} FROM tx")
sql("drop_columns_if_present", with_ctes(TX["retail"]) + f"SELECT {_RETAIL_COLS} FROM tx")
sql("daily_sales_day_grain", with_ctes(TX["events_user"], DAILY) + "SELECT * FROM daily")
sql("daily_sales_exact_grain", with_ctes(TX_EXACT_USER, DAILY) + "SELECT * FROM daily")
sql("date_features", with_ctes(TX["retail"], DAILY) + f"SELECT *, {calendar_sql()} FROM daily")
sql("date_features_friday_weekend", with_ctes(TX["retail"], DAILY) + f"SELECT *, {calendar_sql('Date', '4')} FROM daily")
sql("lag_features_full_window", features_sql("events_user", drop=True, full=True) + "SELECT * FROM feat")


def _ma_excl(n: int) -> str:
    frame = f"(PARTITION BY Outlet ORDER BY Date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    s = f'CAST(sum(CAST("Total Sales Amount" AS DECIMAL(28,8))) OVER {frame} AS DOUBLE)'
    c = f'count("Total Sales Amount") OVER {frame}'
    return f"CASE WHEN {c} > 0 THEN {s} / {c} END AS ma_{n}"


sql("moving_average_exclude_current", with_ctes(TX["events_user"], DAILY) + f"""
SELECT *, lag("Total Sales Amount", 1) OVER w AS lag_1, lag("Total Sales Amount", 7) OVER w AS lag_7,
       lag("Total Sales Amount", 14) OVER w AS lag_14, {_ma_excl(7)}, {_ma_excl(14)}
FROM daily WINDOW w AS (PARTITION BY Outlet ORDER BY Date)""")
sql("select_features", features_sql("events_user") + """
SELECT Outlet, day, weekday, week, month, year, is_weekend, lag_1, lag_7, lag_14, ma_7, ma_14,
       "Total Sales Amount" FROM feat""")
sql("filter_by_period", features_sql("retail") +
    "SELECT * FROM feat WHERE Date >= TIMESTAMP '1998-06-01' AND Date < TIMESTAMP '1998-07-01'")
sql("filter_by_month_any_year", features_sql("retail") + "SELECT * FROM feat WHERE month(Date) = 12")
sql("filter_period_set", features_sql("retail") + """SELECT * FROM feat
WHERE (year(Date) = 1999 AND month(Date) IN (11, 12)) OR (year(Date) = 2000 AND month(Date) IN (1))""")
sql("daily_data_query", with_ctes(TX["retail"], DAILY) + """
SELECT Date AS date, Outlet AS outlet, "Total Sales Amount" AS sales FROM daily
WHERE Outlet = 'NATION_7' AND CAST(Date AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
sql("daily_data_date_range", with_ctes(TX["events_user"], DAILY) + """
SELECT Date AS date, Outlet AS outlet, "Total Sales Amount" AS sales FROM daily
WHERE CAST(Date AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
sql("drop_nulls", features_sql("retail", drop=True) + "SELECT * FROM feat")


def _summary_sql(adapter: str) -> str:
    return with_ctes(TX[adapter]) + """,
day_tot AS (
  SELECT CAST(Date AS DATE) AS d,
         CAST(sum(CAST("Total Sales Amount" AS DECIMAL(28,8))) AS DOUBLE) AS v
  FROM tx WHERE Outlet IS NOT NULL AND Date IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM tx) AS total_records,
       (SELECT min(Date) FROM tx) AS start,
       (SELECT max(Date) FROM tx) AS "end",
       (SELECT count(DISTINCT Outlet) FROM tx WHERE Date IS NOT NULL) AS outlets,
       round(avg(v), 4) AS average_sales, min(v) AS min_sales, max(v) AS max_sales,
       round(stddev_samp(v), 4) AS std_dev
FROM day_tot"""


sql("data_summary", _summary_sql("retail"))
sql("data_summary_events", _summary_sql("events_user"))
sql("outlet_count", with_ctes(TX["events_user"], DAILY) + "SELECT count(DISTINCT Outlet) AS outlets FROM daily")
sql("outlet_list", with_ctes(TX["retail"], DAILY) + "SELECT DISTINCT Outlet FROM daily")
sql("data_status", with_ctes(TX["retail"]) + """
SELECT min(Date) AS start, max(Date) AS "end", count(*) AS total_records,
       CAST(NULL AS TIMESTAMP) AS last_training FROM tx""")
sql("sort_daily_preview", with_ctes(TX["retail"], DAILY) + "SELECT * FROM daily ORDER BY Outlet, Date LIMIT 100")

# --- step 3 ----------------------------------------------------------------------

_CUT = "(SELECT quantile_cont(epoch_us(Date), 0.8) FROM feat)"
sql("split_cutoff", features_sql("retail") + f"""
SELECT {_CUT} AS cutoff_micros, make_timestamp(CAST(round({_CUT}) AS BIGINT)) AS cutoff""")
_SPLIT = f"CASE WHEN epoch_us(Date) < {_CUT} THEN 'train' ELSE 'test' END"
sql("time_split_report", features_sql("retail") + f"""
SELECT {_SPLIT} AS split, count(*) AS n_rows, min(Date) AS min_date, max(Date) AS max_date
FROM feat GROUP BY 1""")
sql("period_split_report", features_sql("retail") + """,
s AS (SELECT 'train' AS split, Date FROM feat WHERE year(Date) = 1999
      UNION ALL SELECT 'test' AS split, Date FROM feat WHERE year(Date) = 2000 AND month(Date) = 1)
SELECT split, count(*) AS n_rows, min(Date) AS min_date, max(Date) AS max_date FROM s GROUP BY split""")
sql("stratified_split", features_sql("events_user") + """,
r AS (SELECT Outlet, Date, "Total Sales Amount",
             row_number() OVER (PARTITION BY Outlet
               ORDER BY md5(Outlet || '|' || CAST(epoch_us(Date) AS VARCHAR) || '|' || '42'), Date) AS rk
      FROM feat),
n AS (SELECT Outlet, count(*) AS n, least(floor(count(*) * 0.2), count(*) - 1) AS free,
             count(*) * 0.2 - floor(count(*) * 0.2) AS part FROM feat GROUP BY Outlet),
q AS (SELECT Outlet, free + CASE WHEN free < n - 1
               AND row_number() OVER (ORDER BY free < n - 1 DESC, part DESC, Outlet)
                   <= ceil(sum(n) OVER () * 0.2) - sum(free) OVER () THEN 1 ELSE 0 END AS quota FROM n)
SELECT Outlet, Date, "Total Sales Amount", CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split
FROM r JOIN q USING (Outlet)""")
sql("named_period_3months", features_sql("retail") +
    "SELECT * FROM feat WHERE Date >= (SELECT max(Date) - INTERVAL 3 MONTH FROM feat)")
sql("named_period_month", features_sql("retail") +
    "SELECT * FROM feat WHERE Date >= TIMESTAMP '1998-06-01' AND Date < TIMESTAMP '1998-07-01'")
sql("encode_outlet", features_sql("retail") + f"""
SELECT Outlet, Date, {_SPLIT} AS split,
       CAST(dense_rank() OVER (ORDER BY Outlet) - 1 AS DOUBLE) AS Outlet_code FROM feat""")
sql("outlet_dictionary", features_sql("events_user") + """
SELECT Outlet, Date, CAST(dense_rank() OVER (ORDER BY Outlet) - 1 AS INTEGER) AS code FROM feat""")
sql("ordered_target_statistic", features_sql("retail") + """,
money AS (SELECT Outlet, Date, CAST("Total Sales Amount" AS DECIMAL(28, 8)) AS y FROM feat),
overall AS (SELECT CAST(sum(y) AS DOUBLE) / count(*) AS prior FROM money)
SELECT Outlet, Date,
       round((CAST(coalesce(sum(y) OVER earlier, 0) AS DOUBLE) + prior) / (count(*) OVER earlier + 1), 4) AS statistic
FROM money, overall
WINDOW earlier AS (PARTITION BY Outlet ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
_CUT_U = _CUT
sql("label_lookup", features_sql("events_user") + f""",
tr AS (SELECT DISTINCT Outlet FROM feat WHERE epoch_us(Date) < {_CUT}),
codes AS (SELECT Outlet, CAST(row_number() OVER (ORDER BY Outlet) - 1 AS DOUBLE) AS Outlet_code FROM tr)
SELECT f.Outlet, f.Date, c.Outlet_code FROM feat f JOIN codes c ON f.Outlet = c.Outlet
WHERE epoch_us(f.Date) >= {_CUT}""")

_BLEND_SQL = ("(((CAST(0.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(ma_7 AS DOUBLE)) "
              "+ CAST(0.3 AS DOUBLE) * CAST(lag_1 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * CAST(lag_14 AS DOUBLE))")
_TEST = features_sql("events_user") + f""",
test AS (SELECT "Total Sales Amount" AS y, lag_1 AS naive, lag_7 AS seasonal_naive, {_BLEND_SQL} AS blend, Outlet
         FROM feat WHERE epoch_us(Date) >= {_CUT})"""


def _metrics(p: str, digits: bool = True) -> str:
    r = (lambda x: f"round({x}, 4)") if digits else (lambda x: x)
    r2 = (f"CASE WHEN var_pop(y) * count(y) = 0 THEN CASE WHEN sum((y - {p}) * (y - {p})) = 0 THEN 1.0 ELSE 0.0 END "
          f"ELSE 1.0 - sum((y - {p}) * (y - {p})) / (var_pop(y) * count(y)) END")
    return (f"{r(f'avg(abs(y - {p}))')} AS MAE, {r(f'sqrt(avg((y - {p}) * (y - {p})))')} AS RMSE, "
            f"{r(r2)} AS r2, count(*) AS test_size")


sql("evaluate_baseline", _TEST + """
SELECT round(avg(abs(y - blend)), 4) AS mae, round(sqrt(avg((y - blend) * (y - blend))), 4) AS rmse,
       round(CASE WHEN var_pop(y) * count(y) = 0 THEN CASE WHEN sum((y - blend) * (y - blend)) = 0 THEN 1.0 ELSE 0.0 END
             ELSE 1.0 - sum((y - blend) * (y - blend)) / (var_pop(y) * count(y)) END, 4) AS r2,
       count(*) AS test_size
FROM test""")
sql("compare_models", _TEST + f""",
m AS (SELECT 'naive' AS Model, {_metrics('naive')} FROM test
      UNION ALL SELECT 'seasonal_naive', {_metrics('seasonal_naive')} FROM test
      UNION ALL SELECT 'blend', {_metrics('blend')} FROM test),
b AS (SELECT min(RMSE) AS best, count(*) FILTER (WHERE RMSE = (SELECT min(RMSE) FROM m)) AS nb FROM m)
SELECT m.*, CASE WHEN b.nb > 1 THEN 'similar'
                 ELSE (SELECT Model FROM m WHERE RMSE = b.best) END AS winner
FROM m, b""")
sql("error_reduction", _TEST + f""",
nb AS (SELECT {_metrics('naive', False)} FROM test),
bl AS (SELECT {_metrics('blend', False)} FROM test)
SELECT 'naive' AS base_model, 'blend' AS other_model,
       round((nb.MAE - bl.MAE) / nb.MAE * 100, 4) AS mae_reduction_pct,
       round((nb.RMSE - bl.RMSE) / nb.RMSE * 100, 4) AS rmse_reduction_pct,
       round(bl.r2 - nb.r2, 4) AS r2_improvement,
       CASE WHEN (nb.MAE - bl.MAE) / nb.MAE * 100 > 0 THEN 'blend' ELSE 'naive' END AS better_model
FROM nb, bl""")
sql("actual_vs_predicted", _TEST + """
SELECT Outlet, CAST(sum(CAST(y AS DECIMAL(28,8))) AS DOUBLE) AS "Actual Sales",
       round(sum(blend), 4) AS "Predicted Sales" FROM test GROUP BY Outlet""")


# --- step 4: recursive forecast (DuckDB recursive CTE) ---------------------------

_CAL = {
    "day": "dayofmonth({d})", "weekday": "(isodow({d}) - 1)", "week": "week({d})",
    "month": "month({d})", "year": "year({d})", "is_weekend": "CAST(isodow({d}) - 1 IN ({w}) AS INTEGER)",
}


def _linear_sql(terms, intercept, d: str, weekend: str) -> str:
    def ref(f):
        return _CAL[f].format(d=d, w=weekend) if f in _CAL else f
    out = f"CAST({float(intercept)!r} AS DOUBLE)"
    for w, f in terms:
        out = f"({out} + CAST({float(w)!r} AS DOUBLE) * CAST({ref(f)} AS DOUBLE))"
    return out


BLEND_TERMS = (((0.5, "ma_7"), (0.3, "lag_1"), (0.2, "lag_14")), 0.0)
WEEKLY_TERMS = (((0.6, "ma_14"), (0.4, "lag_7"), (2.5, "is_weekend")), 1.0)


def forecast_ctes(adapter: str, predictor, start: str, end: str, clamp: bool = True, drop: bool = False,
                  full: bool = False, anchor: tuple[str, str] | None = None, name: str = "fc",
                  weekend: str = "4, 5, 6", with_base: bool = True) -> list[str]:
    """CTEs ending in ``{name}(Outlet, Date, "Predicted Sales")``."""
    terms, intercept = predictor
    anchor_where = (f"Date >= TIMESTAMP '{anchor[0]}' AND Date < TIMESTAMP '{anchor[1]}'" if anchor else "TRUE")
    d0 = (f"greatest(a.Date + INTERVAL 1 DAY, TIMESTAMP '{start}')" if clamp else "a.Date + INTERVAL 1 DAY")
    p = name
    ctes = [TX[adapter], DAILY, feat_cte(full=full, drop=drop)] if with_base else []
    ctes += [
        f"{p}_last AS (SELECT Outlet, max(Date) AS md FROM feat WHERE {anchor_where} GROUP BY Outlet)",
        f"{p}_anchor AS (SELECT f.* FROM feat f JOIN {p}_last l ON f.Outlet = l.Outlet AND f.Date = l.md)",
        f"""{p}_hist AS (
  SELECT a.Outlet, count(*) AS n_hist, list(f."Total Sales Amount" ORDER BY f.Date) AS h
  FROM feat f JOIN {p}_anchor a ON f.Outlet = a.Outlet
  WHERE f.Date >= a.Date - INTERVAL 13 DAY AND f.Date <= a.Date GROUP BY a.Outlet)""",
        f"""{p}_st AS (
  SELECT a.Outlet, a.lag_1, a.lag_7, a.lag_14, a.ma_7, a.ma_14, h.h[-14:] AS h, {d0} AS d0
  FROM {p}_anchor a JOIN {p}_hist h ON a.Outlet = h.Outlet WHERE h.n_hist >= 7)""",
        f"""{p}_rc(Outlet, d, lag_1, lag_7, lag_14, ma_7, ma_14, h, y) AS (
  SELECT Outlet, d0, lag_1, lag_7, lag_14, ma_7, ma_14, h, {_linear_sql(terms, intercept, 'd0', weekend)}
  FROM {p}_st WHERE d0 <= TIMESTAMP '{end}'
  UNION ALL
  SELECT Outlet, d, lag_1, lag_7, lag_14, ma_7, ma_14, h, {_linear_sql(terms, intercept, 'd', weekend)}
  FROM (
    SELECT Outlet, d, lag_1, lag_7, lag_14,
           list_reduce(h[-7:], lambda a, x: a + x) / len(h[-7:]) AS ma_7,
           list_reduce(h, lambda a, x: a + x) / len(h) AS ma_14, h
    FROM (
      SELECT Outlet, d + INTERVAL 1 DAY AS d, y AS lag_1, lag_1 AS lag_7, lag_7 AS lag_14,
             list_concat(h, [y])[-14:] AS h
      FROM {p}_rc WHERE d + INTERVAL 1 DAY <= TIMESTAMP '{end}') s1) s2)""",
        f'{p} AS (SELECT Outlet, d AS Date, y AS "Predicted Sales" FROM {p}_rc)',
    ]
    return ctes


def forecast_sql(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


_FC_USER = forecast_ctes("events_user", BLEND_TERMS, "2024-01-31", "2024-02-29")
_FC_SCRIPT = forecast_ctes("events_user", WEEKLY_TERMS, "2024-02-01", "2024-02-29", clamp=False, drop=True,
                           full=True, anchor=("2024-01-01", "2024-02-01"))
_FC_RETAIL = forecast_ctes("retail", BLEND_TERMS, "2001-10-20", "2001-12-31", drop=True)

sql("last_row_per_outlet", features_sql("retail") + """,
lastd AS (SELECT Outlet, max(Date) AS md FROM feat GROUP BY Outlet)
SELECT f.* FROM feat f JOIN lastd l ON f.Outlet = l.Outlet AND f.Date = l.md""")
sql("recent_lookback", features_sql("retail") + """,
lastd AS (SELECT Outlet, max(Date) AS md FROM feat GROUP BY Outlet)
SELECT f.Outlet, f.Date, f."Total Sales Amount" FROM feat f JOIN lastd l ON f.Outlet = l.Outlet
WHERE f.Date >= l.md - INTERVAL 13 DAY AND f.Date <= l.md""")
sql("skipped_outlets", features_sql("retail") + """,
lastd AS (SELECT Outlet, max(Date) AS md FROM feat GROUP BY Outlet)
SELECT f.Outlet, count(*) AS days FROM feat f JOIN lastd l ON f.Outlet = l.Outlet
WHERE f.Date >= l.md - INTERVAL 13 DAY AND f.Date <= l.md GROUP BY f.Outlet HAVING count(*) < 7""")
sql("restrict_to_period_outlets", features_sql("retail") + """,
lastd AS (SELECT Outlet, max(Date) AS md FROM feat
          WHERE Date >= TIMESTAMP '2001-10-01' AND Date < TIMESTAMP '2001-11-01' GROUP BY Outlet)
SELECT f.* FROM feat f JOIN lastd l ON f.Outlet = l.Outlet AND f.Date = l.md""")
sql("date_spine", forecast_sql(*_FC_USER) + """
SELECT Outlet, unnest(generate_series(d0, TIMESTAMP '2024-02-29', INTERVAL 1 DAY)) AS Date
FROM fc_st WHERE d0 <= TIMESTAMP '2024-02-29'""")
sql("forecast_daily", forecast_sql(*_FC_USER) + "SELECT * FROM fc")
sql("forecast_daily_script", forecast_sql(*_FC_SCRIPT) + "SELECT * FROM fc")
sql("forecast_daily_retail", forecast_sql(*_FC_RETAIL) + "SELECT * FROM fc")
sql("monthly_forecast", forecast_sql(*_FC_USER) + """
SELECT Outlet, strftime(Date, '%Y-%m') AS Month, round(sum("Predicted Sales"), 4) AS "Predicted Monthly Sales"
FROM fc GROUP BY ALL""")
sql("api_monthly_summary", forecast_sql(*_FC_USER) + """
SELECT strftime(Date, '%Y-%m') AS month, Outlet AS outlet, round(sum("Predicted Sales"), 4) AS prediction
FROM fc GROUP BY ALL""")
sql("horizon_total", forecast_sql(*_FC_SCRIPT) + """
SELECT Outlet, round(sum("Predicted Sales"), 4) AS "Predicted February 2024 Sales" FROM fc GROUP BY Outlet""")
sql("daily_total_forecast", forecast_sql(*_FC_USER) + """
SELECT date_trunc('day', Date) AS date, round(sum("Predicted Sales"), 4) AS total_prediction FROM fc GROUP BY 1""")
sql("outlet_month_pivot", forecast_sql(*_FC_USER, """m AS (
  SELECT Outlet, strftime(Date, '%Y-%m') AS Month, round(sum("Predicted Sales"), 4) AS v FROM fc GROUP BY ALL)""")
    + """SELECT Outlet, max(v) FILTER (WHERE Month = '2024-01') AS "2024-01",
       max(v) FILTER (WHERE Month = '2024-02') AS "2024-02" FROM m GROUP BY Outlet""")
sql("stack_forecasts", forecast_sql(*_FC_USER, *forecast_ctes("events_user", WEEKLY_TERMS, "2024-01-31",
                                                             "2024-02-29", name="fw", with_base=False))
    + """SELECT *, 'blend' AS model FROM fc UNION ALL SELECT *, 'weekly' AS model FROM fw""")

sql("daily_sales_streaming", with_ctes(TX["events_user"], DAILY) + "SELECT * FROM daily")

_FULL_ROWS = """featd AS (SELECT * FROM feat WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL
  AND ma_7 IS NOT NULL AND ma_14 IS NOT NULL)"""
sql("write_outputs", forecast_sql(*_FC_USER, _FULL_ROWS, f"""test AS (
  SELECT "Total Sales Amount" AS y, lag_1 AS naive, {_BLEND_SQL} AS blend FROM featd
  WHERE epoch_us(Date) >= (SELECT quantile_cont(epoch_us(Date), 0.8) FROM featd))""",
    f"""m AS (SELECT 'naive' AS Model, {_metrics('naive', False)} FROM test
  UNION ALL SELECT 'blend', {_metrics('blend', False)} FROM test)""") + """
SELECT 'daily' AS output, Outlet AS name, strftime(Date, '%Y-%m-%d') AS period, round("Predicted Sales", 4) AS value FROM fc
UNION ALL SELECT 'monthly', Outlet, strftime(Date, '%Y-%m'), round(sum("Predicted Sales"), 4) FROM fc GROUP BY ALL
UNION ALL SELECT 'comparison', Model,
  CASE WHEN (SELECT count(DISTINCT RMSE) FROM m) = 1 THEN 'similar' ELSE (SELECT arg_min(Model, RMSE) FROM m) END,
  round(RMSE, 4) FROM m""")
sql("data_range_iso", with_ctes(TX["retail"]) + """
SELECT strftime(min(Date), '%Y-%m-%dT%H:%M:%S') AS start, strftime(max(Date), '%Y-%m-%dT%H:%M:%S') AS "end",
       count(*) AS total_records FROM tx""")
sql("prepare_features_exact_blocks", with_ctes(TX_EXACT_USER, DAILY, feat_cte(drop=True)) + "SELECT * FROM feat")
sql("stratified_split_buckets", ORACLE_SQL["stratified_split"])
sql("forecast_daily_fulldata", forecast_sql(*forecast_ctes("events_user", WEEKLY_TERMS, "2024-02-01", "2024-02-29",
                                                         clamp=False, drop=True, full=True)) + "SELECT * FROM fc")
sql("forecast_event_types", forecast_sql(*forecast_ctes("events_type", WEEKLY_TERMS, "2024-01-31", "2024-02-29"))
    + "SELECT * FROM fc")
sql("prepare_features_exact_auto", ORACLE_SQL["prepare_features_exact_blocks"])
sql("daily_sales_fractional", """
SELECT CAST(l_suppkey AS VARCHAR) AS Outlet, CAST(l_shipdate AS TIMESTAMP) AS Date,
       CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(28,8))) AS DOUBLE) AS "Total Sales Amount",
       CAST(0 AS DOUBLE) AS "Total Discount"
FROM lineitem GROUP BY ALL""")
_CUT_KEPT = "(SELECT quantile_cont(epoch_us(Date), 0.8) FROM feat WHERE year(Date) = 2024 AND month(Date) = 1)"
sql("training_job_rows", features_sql("events_user", drop=False) + f"""
SELECT 'xgboost_jan_2024_20240201_000000' AS model_name, 2024 AS year, 1 AS month,
       count(*) FILTER (WHERE year(Date) = 2024 AND month(Date) = 1 AND epoch_us(Date) >= {_CUT_KEPT}) AS test_size,
       min(Date) AS train_start, max(Date) AS train_end FROM feat""")
sql("forecast_job_keys", forecast_sql(*forecast_ctes("events_user", WEEKLY_TERMS, "2024-01-31", "2024-03-01")) + """
SELECT Outlet AS outlet, strftime(Date, '%Y-%m') AS month, count(*) AS n_days, CAST(0 AS BIGINT) AS n_null
FROM fc GROUP BY ALL""")
sql("predict_test_keys", features_sql("events_user") + f"""
SELECT Outlet, Date, false AS is_null FROM feat WHERE epoch_us(Date) >= {_CUT}""")
sql("feature_importance_total", """
SELECT CAST(12 AS BIGINT) AS n_features, CAST(1 AS DOUBLE) AS total FROM (SELECT count(*) FROM events)""")
sql("hyperparam_override", features_sql("events_user") + f"""
SELECT CAST(1000 AS BIGINT) AS n_trees, CAST(4 AS BIGINT) AS depth, CAST(0.1 AS DOUBLE) AS learning_rate,
       count(*) AS test_rows FROM feat WHERE epoch_us(Date) >= {_CUT}""")
