"""Every registered query: a plan over the driver's tables, and its SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dsl, factors, scalars
from ..operators import backtest, daily_check, eligibility, ingest, market, research
from ..scratch import shared_dir
from ..sources.driver import actions, fills, lifecycle, ticks
from ..sources.readers import invalid_bars, read_table
from ..streaming.kline import run_available, stream_kline
from . import sql
from .base import ORACLE_SQL, QUERIES, SPLIT, audited, daily, ic_of, labelled, panel, portfolio, predictions, query

# ---- sources and market

query("ohlcv_daily", sql.rounded([sql.TICKS, sql.DAILY_BARS], "SELECT * FROM daily", "open high low close"))(daily)
for _p in ("5m", "15m", "30m", "60m", "1d", "1w", "1mo"):
    query(f"kline_{_p}", sql.kline_sql(_p))(lambda s, d, p=_p: market.kline(ticks(s, d), p))
query("kline_pre_close_chain",
    sql.rounded([sql.TICKS, f"k AS ({sql.kline_sql('1d').replace('WITH RECURSIVE ', 'WITH ', 1)})".replace(sql.TICKS, "z AS (SELECT 1)")], """
  SELECT code, bucket, close, pre_close, close - pre_close AS change, close / nullif(pre_close, 0) * 100 - 100 AS pct_change, close / nullif(open, 0)
  * 100 - 100 AS intraday_pct_change
  FROM (SELECT *, last_value(CASE WHEN close <> 0 THEN close END IGNORE NULLS) OVER (PARTITION BY code ORDER BY bucket ROWS BETWEEN UNBOUNDED
  PRECEDING AND 1 PRECEDING) AS pre_close FROM k)""",
  "close pre_close change pct_change intraday_pct_change"))(
    lambda s, d: market.with_pre_close(market.kline(ticks(s, d), "1d")).select("code", "bucket", "close", "pre_close", "change", "pct_change",
    "intraday_pct_change"))
query("snapshot_at",
    sql.rounded([sql.TICKS], "SELECT code, seq, close, volume FROM ticks WHERE trade_time = (SELECT max(ts) FROM events) AND code <> '1'", "close"))(
    lambda s, d: market.snapshot(ticks(s, d).filter("code <> '1'"), ticks(s, d).agg(F.max("trade_time")).first()[0]).select("code", "seq", "close", "volume"))
query("raw_bar_filter_page",
    sql.rounded([sql.TICKS], "SELECT code, trade_time, seq, close, volume, (SELECT count(*) FROM ticks WHERE close BETWEEN 50 AND 300 AND volume >= "
    "10 AND hour(trade_time) BETWEEN 9 AND 15) AS total FROM ticks WHERE close BETWEEN 50 AND 300 AND volume >= 10 AND hour(trade_time) BETWEEN 9 AND "
    "15 ORDER BY trade_time, seq LIMIT 50 OFFSET 20", "close"))(
    lambda s, d: market.raw_page(ticks(s, d).select("code", "trade_time", "seq", "close", "volume"),
    [F.col("close").between(50, 300), F.col("volume") >= 10, F.hour("trade_time").between(9, 15)], ["trade_time", "seq"], 50, 20))
query("symbol_search", sql.rounded([sql.TICKS], "SELECT DISTINCT code FROM ticks WHERE contains(code, '7') ORDER BY code LIMIT 20"))(
    lambda s, d: market.search_symbols(ticks(s, d), " 7 ", 20))
query("monthly_inventory",
    sql.rounded([sql.TICKS], "SELECT year(trade_time)::INT AS year, month(trade_time)::INT AS month, count(*) AS n_rows, count(DISTINCT code) AS "
    "n_codes, min(trade_time) AS first_time, max(trade_time) AS last_time FROM ticks GROUP BY 1, 2"))(
    lambda s, d: market.inventory(ticks(s, d).withColumn("year", F.year("trade_time")).withColumn("month", F.month("trade_time")), "year", "month"))
query("symbol_inventory",
    sql.rounded([sql.TICKS], "SELECT code, count(*) AS n_rows, count(DISTINCT code) AS n_codes, min(trade_time) AS first_time, "
    "max(trade_time) AS last_time FROM ticks GROUP BY 1"))(
    lambda s, d: market.inventory(ticks(s, d), "code"))
_RAW = ("CASE o_orderkey % 4 WHEN 0 THEN lpad((o_orderkey * 7919 % 1000000)::VARCHAR, 6, '0') WHEN 1 THEN ' ' || lpad((o_orderkey * 104729 % "
    "1000000)::VARCHAR, 6, '0') || ' ' WHEN 2 THEN lower('sh' || o_orderkey) ELSE lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || '.bj' END")


def _raw_codes(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    six = lambda c: F.lpad(c.cast("string"), 6, "0")
    raw = F.when(k % 4 == 0, six(k * 7919 % 1000000)).when(k % 4 == 1, F.concat(F.lit(" "), six(k * 104729 % 1000000), F.lit(" "))).when(k % 4 == 2,
        F.concat(F.lit("sh"), k.cast("string"))).otherwise(F.concat(six(k % 1000000), F.lit(".bj")))
    return read_table(s, d, "orders").select("o_orderkey", raw.alias("raw"), "o_orderdate", "o_orderpriority", "o_totalprice")


_CODES = [f"r AS (SELECT o_orderkey, {_RAW} AS raw, o_orderdate, o_orderpriority, o_totalprice FROM orders)",
          "n AS (SELECT *, CASE WHEN regexp_full_match(upper(trim(raw)), '[569][0-9]{5}') THEN upper(trim(raw)) || '.SH' WHEN "
          "regexp_full_match(upper(trim(raw)), '[0-3][0-9]{5}') THEN upper(trim(raw)) || '.SZ' ELSE upper(trim(raw)) END AS code FROM r)"]
query("code_normalize", sql.rounded(_CODES, "SELECT o_orderkey, raw, code FROM n"))(lambda s, d: _raw_codes(s, d).select("o_orderkey", "raw",
    scalars.normalize_security_code(F.col("raw")).alias("code")))
query("board_classify", sql.rounded(_CODES, """SELECT o_orderkey, code, CASE WHEN regexp_matches(p, '^68[89]') THEN 'star' WHEN regexp_matches(p,
    '^30[01]') THEN 'chinext' WHEN regexp_matches(p, '^(430|920|83|87|88)') THEN 'bse'
  WHEN regexp_matches(p, '^(600|601|603|605|000|001|002|003)') THEN 'main' ELSE 'unknown' END AS board FROM (SELECT *, split_part(code, '.', 1) AS p
  FROM n)"""))(
    lambda s, d: _raw_codes(s, d).select("o_orderkey", scalars.normalize_security_code(F.col("raw")).alias("code")).withColumn("board",
    scalars.classify_board(F.col("code"))))
_DATES = ("CASE o_orderkey % 5 WHEN 0 THEN '99999999' WHEN 1 THEN '19700427' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN '20241332' "
    "ELSE strftime(o_orderdate, '%Y%m%d') END")
query("lifecycle_dates",
    sql.rounded([], f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (2, 4) THEN o_orderdate::DATE END AS life_date, upper(o_orderpriority) LIKE "
    f"'%ST%' AS warned FROM (SELECT *, {_DATES} AS t FROM orders)"))(
    lambda s, d: read_table(s, d, "orders").select("o_orderkey", scalars.normalize_lifecycle_date(
        F.when(F.col("o_orderkey") % 5 == 0, "99999999").when(F.col("o_orderkey") % 5 == 1, "19700427").when(F.col("o_orderkey") % 5 == 2,
        F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 5 == 3, "20241332").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))).alias("life_date"),
        scalars.is_risk_warned(F.col("o_orderpriority")).alias("warned")))
query("bar_contract_violations",
    sql.rounded(sql.CHECKS, "SELECT code, trade_date FROM bars WHERE high < greatest(open, close, low) OR low > least(open, close, "
    "high) OR volume < 0 OR least(open, high, low, close) <= 0"))(
    lambda s, d: invalid_bars(audited(s, d)).select("code", "trade_date"))

# ---- expression operators

_GAP = "where(volume > 20, close, divide(1, 0))"  # close with missing values
EXPRESSIONS: dict[str, dict[str, str]] = {
    "op_arith": {"a": "close + open", "b": "close - open * 2", "c": "high * low / 3"},
    "op_divide_zero": {"a": "close / (volume - volume)", "b": "close / volume"},
    "op_log_sign_abs_neg": {"a": "log(close - open)", "b": "sign(close - open)", "c": "absolute(open - close)", "e": "negative(close)"},
    "op_power_signed_power": {"a": "power(close - open, exponent=0.5)", "b": "power(close, exponent=2)",
    "c": "signed_power(close - open, exponent=0.5)", "e": "power(close - close, exponent=-1)"},
    "op_comparisons_missing_false": {f"c{i}": f"{f}({_GAP}, open)"
    for i, f in enumerate(("less_than", "less_equal", "greater_than", "greater_equal", "equal", "not_equal"))},
    "op_where": {"a": f"where({_GAP} > open, close, open)", "b": "where(close - open, 1, 2)"},
    "op_delay_delta_returns": {"a": "delay(close, periods=2)", "b": "delta(close, periods=3)", "c": "returns(close, periods=1)",
    "e": "delay(close, periods=0)"},
    "op_ts_sum_mean_min_max": {f: f"ts_{f}({_GAP}, window=5, min_periods=2)" for f in ("sum", "mean", "min", "max")},
    "op_ts_stddev_ddof0_ddof1": {"a": f"ts_stddev({_GAP}, window=5, min_periods=2)", "b": "ts_stddev(close, window=4, ddof=0)",
    "c": "ts_stddev(close, window=6, min_periods=3, ddof=2)"},
    "op_ts_argmax_argmin": {"a": f"ts_argmax({_GAP}, window=5, min_periods=1)", "b": "ts_argmin(close, window=5)"},
    "op_ts_rank": {"a": f"ts_rank({_GAP}, window=5, min_periods=2)", "b": "ts_rank(close, window=8)"},
    "op_ts_correlation": {"a": f"ts_correlation({_GAP}, volume, window=8, min_periods=4)"},
    "op_ts_covariance": {"a": f"ts_covariance({_GAP}, volume, window=8, min_periods=2)"},
    "op_cs_rank": {"a": "cs_rank(close)", "b": f"cs_rank({_GAP})"}, "op_cs_demean": {"a": f"cs_demean({_GAP})"},
    "op_cs_zscore": {"a": f"cs_zscore({_GAP})"}, "op_cs_scale": {"a": "cs_scale(close - open)"},
    "op_cs_winsorize": {"a": f"cs_winsorize({_GAP}, lower=0.1, upper=0.9)"},
    "expr_nested": {"a": "cs_rank(ts_stddev(delta(close, periods=1), window=5, min_periods=3))", "b": "ts_mean(cs_zscore(close), window=3) - cs_rank(close)"},
    "expr_alpha_001": {"a": factors.DAILY["alpha_001"]}, "expr_alpha_002": {"a": factors.DAILY["alpha_002"]},
}
# the SQL names a column max or min badly
EXPRESSIONS["op_ts_sum_mean_min_max"] = {f"v_{k}": v for k, v in EXPRESSIONS["op_ts_sum_mean_min_max"].items()}
for _n, _e in EXPRESSIONS.items():
    query(_n, sql.expression_sql(_e))(lambda s, d, e=_e: dsl.evaluate(daily(s, d), e).select("code", "trade_date", *e))
for _n, _f in sql.FACTOR_FAMILIES.items():
    query(_n, sql.family_sql(_n))(lambda s, d, f=_f, n=_n: factors.build((daily if n in sql.ON_TICKS else panel)(s, d), f).select("code", "trade_date", *f))
_GROUPS = {"factors_intraday_path": ["intraday_path_efficiency", "last_30m_return", "positive_bar_ratio", "close_to_vwap"],
    "factors_intraday_volume": ["last_30m_volume_ratio", "signed_volume_imbalance"], "factors_intraday_volatility": ["realized_vol", "downside_semivol"]}
for _n, _f in _GROUPS.items():
    query(_n, f"SELECT code, trade_date, {', '.join(_f)} FROM ({sql.INTRADAY_SQL})")(lambda s, d, f=_f: factors.intraday(ticks(s, d)).select("code",
        "trade_date", *f))

# ---- targets and metrics

for _k in ("inday", "close", "open"):
    query(f"targets_{_k}",
        sql.rounded([sql.TICKS, sql.DAILY_BARS, *sql.target_ctes(_k)],
        "SELECT code, feature_date, target_date, target_end_date, target_return FROM targets", "target_return"))(
        lambda s, d, k=_k: research.forward_targets(daily(s, d), k).select("code", "feature_date", "target_date", "target_end_date", "target_return"))
query("daily_ic", sql.rounded(sql.IC, "SELECT * FROM ic", "ic rank_ic"))(ic_of)
query("ic_summary",
    sql.rounded(sql.IC, "SELECT count(*) AS dates, count(ic) AS ic_dates, avg(ic) AS mean_ic, avg(rank_ic) AS mean_rank_ic, "
    "avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg((ic > 1e-12)::INT) AS ic_win_rate FROM ic", "mean_ic mean_rank_ic icir ic_win_rate"))(
    lambda s, d: research.ic_summary(ic_of(s, d)))
query("classification_metrics", sql.rounded(sql.LABELLED, """SELECT count(*) AS n, avg(hit) AS accuracy, (avg(hit) FILTER (label = 1) + avg(hit)
    FILTER (label = 0)) / 2 AS balanced_accuracy, avg((score - label) ** 2) AS brier,
  avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS log_loss FROM (SELECT *, ((score >= 0.5)::INT = label)::INT::DOUBLE AS hit,
  least(greatest(score, 1e-12), 1 - 1e-12) AS p FROM lab)""", "accuracy balanced_accuracy brier log_loss"))(
    lambda s, d: research.classification(labelled(s, d), "score", "label"))
query("auc_tie_aware", sql.rounded(sql.LABELLED, """SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) +
    1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc
  FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM lab)""", "auc"))(
  lambda s, d: research.auc(labelled(s, d), "score", "label"))
query("regression_metrics", sql.rounded(sql.LABELLED, f"""SELECT count(*) AS n, avg(abs(score - target_return)) AS mae, sqrt(avg((score -
    target_return) ** 2)) AS rmse, 1 - sum((score - target_return) ** 2) / (var_pop(target_return) * count(*)) AS r2,
  avg(((score > 0) = (target_return > 0))::INT) AS direction_accuracy, {sql.CORR.format('score', 'target_return')} AS ic FROM lab""",
  "mae rmse r2 direction_accuracy ic"))(
    lambda s, d: research.regression(labelled(s, d), "score", "target_return"))
query("accuracy_trend",
    sql.rounded([*sql.LABELLED, "a AS (SELECT target_date, count(*) AS samples, avg(((score >= 0.5)::INT = label)::INT) AS accuracy FROM lab GROUP BY 1)"],
      "SELECT *, accuracy - lag(accuracy) OVER (ORDER BY target_date) AS accuracy_change, avg(accuracy) OVER (ORDER BY target_date ROWS 19 PRECEDING) "
      "AS rolling_accuracy FROM a", "accuracy accuracy_change rolling_accuracy"))(
    lambda s, d: research.accuracy_trend(labelled(s, d), "score", "label"))
query("rolling_ic_20_60",
    sql.rounded(sql.IC,
    "SELECT *, " + ", ".join(f"CASE WHEN count({c}) OVER w{n} >= {m} THEN avg({c}) OVER w{n} END AS {c}_{n}" for n, m in ((20, 5), (60, 20))
    for c in ("ic", "rank_ic")) + " FROM ic WINDOW w20 AS (ORDER BY target_date ROWS 19 PRECEDING), w60 AS (ORDER BY target_date ROWS 59 PRECEDING)",
    "ic rank_ic ic_20 rank_ic_20 ic_60 rank_ic_60"))(
    lambda s, d: research.rolling_ic(ic_of(s, d)))

# ---- adjustment, universe, point in time

query("adjust_cumulative", sql.rounded(sql.CUMULATIVE, "SELECT * FROM cum", "hfq"))(lambda s, d: market.cumulative_factors(actions(s, d)))
query("adjust_hfq_asof", sql.rounded(sql.ASOF, "SELECT code, trade_date, open * hfq AS open, close * hfq AS close, volume, hfq AS factor FROM adj",
    "open close factor"))(
    lambda s, d: market.adjust(daily(s, d), actions(s, d), "hfq").select("code", "trade_date", "open", "close", "volume", "factor"))
query("adjust_qfq_anchor",
    sql.rounded([*sql.ASOF, f"anc AS (SELECT code, arg_max(hfq, ex_date) AS anchor FROM cum WHERE ex_date <= DATE '{SPLIT}' GROUP BY code)"],
    "SELECT adj.code, trade_date, close * (hfq / coalesce(anchor, 1)) AS close, hfq / coalesce(anchor, 1) AS factor FROM adj LEFT JOIN anc ON "
    "adj.code = anc.code", "close factor"))(
    lambda s, d: market.adjust(daily(s, d), actions(s, d), "qfq", SPLIT).select("code", "trade_date", "close", "factor"))
query("adjust_volume", sql.rounded(sql.ASOF, "SELECT code, trade_date, close * hfq AS close, volume / hfq AS volume FROM adj", "close volume"))(
    lambda s, d: market.adjust(daily(s, d), actions(s, d), "hfq", volume=True).select("code", "trade_date", "close", "volume"))
query("event_ratio_observed", sql.rounded([*sql.CHECKS, f"o AS (SELECT *, lag(close) OVER ({sql.W}) AS before FROM bars)"],
    "SELECT code, trade_date, CASE WHEN before > 0 AND pre_close > 0 THEN before / pre_close END AS observed FROM o", "observed"))(
    lambda s, d: market.observed_ratio(audited(s, d)).select("code", "trade_date", "observed"))
query("event_ratio_theoretical",
    sql.rounded([sql.TICKS], "SELECT seq, close / nullif((close - 0.1 + 0.05 * volume) / (1 + 0.1 + 0.2 + 0.05), 0) AS theoretical FROM ticks", "theoretical"))(
    lambda s, d: ticks(s, d).select("seq", market.theoretical_ratio(F.col("close"), F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.05),
    F.col("volume")).alias("theoretical")))
_LIFE = [sql.TICKS, sql.DAILY_BARS, sql.LIFE]
query("universe_as_of",
    sql.rounded(_LIFE, f"SELECT * FROM life WHERE open_date <= DATE '{SPLIT}' - 5 AND (expire_date IS NULL OR expire_date > DATE '{SPLIT}') AND board "
    f"IN ('main', 'star')"))(
    lambda s, d: market.universe_as_of(lifecycle(daily(s, d)), SPLIT, 5, ["main", "star"]))
query("universe_over_window",
    sql.rounded(_LIFE, f"SELECT * FROM life WHERE open_date <= DATE '{SPLIT}' AND (expire_date IS NULL OR expire_date >= DATE '2024-01-10')"))(
    lambda s, d: market.universe_over(lifecycle(daily(s, d)), dt.date(2024, 1, 10), SPLIT))


def _pit(s, d) -> DataFrame:
    o = read_table(s, d, "orders")
    reports = o.select(F.col("o_custkey").alias("code"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("report_date"),
        F.to_date("o_orderdate").alias("announce_date"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    days = o.select(F.col("o_custkey").alias("code"), F.date_add(F.to_date("o_orderdate"), 30).alias("trade_date")).distinct()
    return market.point_in_time(reports, days, ["value"])


query("finance_pit_asof",
    sql.rounded(["r AS (SELECT o_custkey AS code, date_trunc('quarter', o_orderdate)::DATE AS report_date, o_orderdate::DATE AS announce_date, "
    "o_orderkey AS seq, o_totalprice AS value FROM orders)",
      "days AS (SELECT DISTINCT o_custkey AS code, o_orderdate::DATE + 30 AS trade_date FROM orders)"], """SELECT d.code, d.trade_date::DATE AS
      trade_date, arg_max(r.report_date, (r.report_date, r.announce_date, r.seq)) AS report_date, arg_max(r.announce_date, (r.report_date,
      r.announce_date, r.seq)) AS announce_date,
      arg_max(r.value, (r.report_date, r.announce_date, r.seq)) AS value, count(r.code) > 0 AS has_finance FROM days d LEFT JOIN r ON r.code = d.code
      AND r.announce_date < d.trade_date GROUP BY 1, 2""", "value"))(_pit)

# ---- backtest

query("bt_top_n", sql.rounded(sql.PREDICTIONS, "SELECT target_date, code, score, target_return, place FROM ranked WHERE place <= 10", "score target_return"))(
    lambda s, d: backtest.top_n(predictions(s, d), 10).select("target_date", "code", "score", "target_return", "place"))
query("flagship_top_n", sql.rounded(sql.PORTFOLIO, "SELECT target_date, n_held, gross, net FROM port", "gross net"))(portfolio)
_BUCKETS = [*sql.PREDICTIONS, "h AS (SELECT *, least(10, size) AS held FROM ranked)", """bk AS (SELECT *, 'top' AS bucket FROM h WHERE place <= 10
    UNION ALL SELECT *, 'bottom' FROM h WHERE place > size - 10
  UNION ALL SELECT *, 'middle' FROM h WHERE place > (size - held) // 2 AND place <= (size - held) // 2 + held)"""]
query("bt_mid_bottom", sql.rounded(_BUCKETS, "SELECT target_date, bucket, count(*) AS n, avg(target_return) AS mean_return FROM bk GROUP BY 1, 2",
    "mean_return"))(
    lambda s, d: backtest.buckets(predictions(s, d), 10).groupBy("target_date", "bucket").agg(F.count(F.lit(1)).alias("n"),
    F.avg("target_return").alias("mean_return")))
query("bt_costs", sql.rounded(sql.PREDICTIONS, f"SELECT target_date, code, (1 + target_return) * {sql.COST} - 1 AS net FROM predictions", "net"))(
    lambda s, d: predictions(s, d).select("target_date", "code", backtest.net(F.col("target_return"), 0.0003, 0.001).alias("net")))
query("bt_daily_equity", sql.rounded(sql.PORTFOLIO, "SELECT * FROM curve", "gross net equity"))(lambda s, d: backtest.equity(portfolio(s, d)))
query("bt_metrics",
    sql.rounded(sql.PORTFOLIO, "SELECT count(*) AS days, product(1 + net) - 1 AS total_return, CASE WHEN product(1 + net) > 0 THEN pow(product(1 + "
    "net), 252.0 / count(*)) - 1 END AS annual_return, stddev_samp(net) * sqrt(252) AS annual_volatility, avg(net) / nullif(stddev_samp(net), "
    "0) * sqrt(252) AS sharpe FROM port", "total_return annual_volatility sharpe").replace("SELECT * REPLACE (",
    "SELECT * REPLACE (round(log10(annual_return + 1) + 1.23e-8, 6) + 0.0 AS annual_return, "))(
    lambda s, d: backtest.compound_metrics(portfolio(s, d)).withColumn("annual_return", F.log10(F.col("annual_return") + 1)))
query("bt_spreads",
    sql.rounded([*_BUCKETS, "sp AS (SELECT avg(target_return) FILTER (bucket = 'top') - avg(target_return) FILTER (bucket = 'bottom') AS x FROM bk "
    "GROUP BY target_date)"], "SELECT count(x) AS days, avg(x) * 252 AS annual_spread, stddev_samp(x) * sqrt(252) AS spread_volatility, "
    "avg(x) / nullif(stddev_samp(x), 0) * sqrt(252) AS spread_sharpe FROM sp", "annual_spread spread_volatility spread_sharpe"))(
    lambda s, d: backtest.spread_metrics(backtest.buckets(predictions(s, d), 10)))
query("bt_drawdown_curve", sql.rounded(sql.PORTFOLIO, "SELECT * FROM dd", "gross net equity peak drawdown"))(
    lambda s, d: backtest.drawdown(backtest.equity(portfolio(s, d))))
query("bt_slippage", sql.rounded([*sql.PORTFOLIO, "lv AS (SELECT unnest([0.0, 0.0005, 0.002])::DOUBLE AS slippage)"],
    "SELECT slippage, count(*) AS days, product((1 + gross) * (1 - slippage) * (1 - 0.0003) / ((1 + slippage) * (1 + 0.0003))) - 1 AS total_return "
    "FROM port, lv GROUP BY 1", "total_return"))(
    lambda s, d: backtest.slippage_sensitivity(portfolio(s, d), [0.0, 0.0005, 0.002], 0.0003))
query("bt_top_vs_rest", sql.rounded(sql.PREDICTIONS, """SELECT avg((target_return > 0)::INT) FILTER (place <= 10) AS top_hit_rate, avg((target_return
    > 0)::INT) FILTER (place > 10) AS rest_hit_rate, avg(target_return) FILTER (place <= 10) AS top_mean,
      avg(target_return) FILTER (place > 10) AS rest_mean, avg(target_return) FILTER (place <= 10) - avg(target_return) FILTER (place > 10) AS
      difference FROM ranked""", "top_hit_rate rest_hit_rate top_mean rest_mean difference"))(lambda s, d: backtest.top_vs_rest(predictions(s, d), 10))
query("bt_yearly_returns",
    sql.rounded(sql.PORTFOLIO, "SELECT year(target_date)::INT AS year, count(*) AS days, product(1 + net) - 1 AS total_return FROM port GROUP BY 1",
    "total_return"))(lambda s, d: backtest.yearly(portfolio(s, d)))

# ---- lives and expected bars


def _expected(s, d) -> tuple[DataFrame, DataFrame]:
    bars = daily(s, d)
    return daily_check.expected_bars(lifecycle(bars), bars), bars


_SPANS = ("SELECT code, min(trade_date) AS first_missing, max(trade_date) AS last_missing, count(*) AS days FROM (SELECT *, ordinal - row_number() "
    "OVER (PARTITION BY code ORDER BY ordinal) AS island FROM gone) GROUP BY code, island")
query("ingest_internal_gaps",
    sql.rounded(sql.EXPECTED,
    _SPANS.replace("FROM gone", "FROM gone JOIN (SELECT code, min(trade_date) AS lo, max(trade_date) AS hi FROM daily GROUP BY code) USING (code) "
    "WHERE trade_date > lo AND trade_date < hi")))(lambda s, d: daily_check.internal_gaps(*_expected(s, d)))


def _shifted(s, d) -> DataFrame:
    """Lifecycles that start late, end early or are unknown for some codes."""
    k = F.col("code").cast("long")
    life = lifecycle(daily(s, d)).filter(k % 10 != 0)
    return life.withColumn("open_date", F.date_add("open_date", F.when(k % 7 == 0, 3).otherwise(0))).withColumn("expire_date",
        F.when(k % 5 == 0, F.lit(SPLIT)).otherwise(F.col("expire_date")))


_SHIFT = [*_LIFE, f"sh AS (SELECT code, (open_date + CASE WHEN code::BIGINT % 7 = 0 THEN 3 ELSE 0 END)::DATE AS open_date, CASE WHEN code::BIGINT % 5 "
    f"= 0 THEN DATE '{SPLIT}' ELSE expire_date END AS expire_date, board FROM life WHERE code::BIGINT % 10 <> 0)"]

# ---- ingest


def _landing(s, d) -> DataFrame:
    k = F.col("volume")
    text = F.when(k % 29 == 0, None).when(k % 31 == 0, "2024011").when(k % 37 == 0, "20241332").otherwise(F.date_format("trade_date", "yyyyMMdd"))
    return daily(s, d).select("code", text.alias("trade_date"), F.when(k % 3 == 0, 0).otherwise(k).alias("volume"))


_LAND = [*_SHIFT, "ld AS (SELECT code, CASE WHEN volume % 29 = 0 THEN NULL WHEN volume % 31 = 0 THEN '2024011' WHEN volume % 37 = 0 THEN '20241332' "
    "ELSE strftime(trade_date, '%Y%m%d') END AS trade_date, CASE WHEN volume % 3 = 0 THEN 0 ELSE volume END AS volume FROM daily)",
         """cl AS (SELECT l.*, CASE WHEN length(l.trade_date) = 8 THEN try_strptime(l.trade_date, '%Y%m%d')::DATE END AS parsed_date, s.code AS
         known, s.open_date, s.expire_date FROM ld l LEFT JOIN sh s ON l.code = s.code)""",
         """rs AS (SELECT code, trade_date, volume, parsed_date, CASE WHEN trade_date IS NULL THEN 'trade_date_null' WHEN length(trade_date) <> 8
         THEN 'trade_date_bad_length' WHEN parsed_date IS NULL THEN 'trade_date_unparsable' WHEN known IS NULL THEN 'unknown_code'
         WHEN parsed_date < open_date AND volume = 0 THEN 'before_listing_padding' WHEN parsed_date < open_date THEN 'before_listing_with_data' WHEN
         parsed_date > expire_date THEN 'after_delisting' ELSE 'kept' END AS reason FROM cl)"""]
query("ingest_classify_rows", sql.rounded(_LAND, "SELECT * FROM rs"))(lambda s, d: ingest.classify(_landing(s, d), _shifted(s, d)))
query("ingest_reason_counts",
    sql.rounded(_LAND, f"SELECT r.reason, count(rs.reason) AS n FROM (SELECT unnest({ingest.REASONS}) AS reason) r LEFT JOIN rs ON rs.reason = "
    f"r.reason GROUP BY 1"))(lambda s, d: ingest.reason_counts(ingest.classify(_landing(s, d), _shifted(s, d))))
query("ingest_reason_samples",
    sql.rounded(_LAND, "SELECT * FROM rs WHERE reason <> 'kept' QUALIFY row_number() OVER (PARTITION BY reason ORDER BY md5(concat_ws('|', '1', code, "
    "trade_date)), code, trade_date, volume) <= 10"))(
    lambda s, d: ingest.reason_samples(ingest.classify(_landing(s, d), _shifted(s, d))))


def _errata(s, d) -> DataFrame:
    k = F.col("volume")
    return daily(s, d).filter(k % 12 == 0).select("code", "trade_date", F.when(k % 24 == 0, "close").otherwise("volume").alias("field"),
        F.when(k % 36 == 0, "n/a").otherwise((k * 2).cast("string")).alias("value"))


query("ingest_errata_override", sql.rounded([sql.TICKS, sql.DAILY_BARS], """SELECT code, trade_date, open, CASE WHEN volume % 24 = 0 AND volume % 36
    <> 0 THEN volume * 2 ELSE close END AS close,
      (CASE WHEN volume % 12 = 0 AND volume % 24 <> 0 AND volume % 36 <> 0 THEN volume * 2 ELSE volume END)::DOUBLE AS volume FROM daily""",
      "open close volume"))(
    lambda s, d: ingest.override(daily(s, d).select("code", "trade_date", "open", "close", F.col("volume").cast("double").alias("volume")),
    _errata(s, d), ("open", "close", "volume")))
query("ingest_price_correction",
    sql.rounded([*sql.CHECKS, "h AS (SELECT code, trade_date, open, close, low, high AS h0, greatest(open, close, low, high) AS high FROM bars)"],
      "SELECT code, trade_date, high, least(open, close, high, low) AS low, concat_ws(',', CASE WHEN high <> h0 THEN 'high' END, "
      "CASE WHEN least(open, close, high, low) <> low THEN 'low' END) AS corrected FROM h", "high low"))(
    lambda s, d: ingest.correct_prices(audited(s, d)).select("code", "trade_date", "high", "low", "corrected"))
query("ingest_missing_pairs",
    sql.rounded([sql.TICKS, sql.DAILY_BARS],
    "SELECT c.code, t.trade_date FROM (SELECT DISTINCT code FROM daily) c CROSS JOIN (SELECT DISTINCT trade_date FROM daily) t LEFT JOIN daily d ON "
    "d.code = c.code AND d.trade_date = t.trade_date WHERE d.code IS NULL"))(
    lambda s, d: ingest.missing_pairs((b := daily(s, d)).select("code").distinct(), b.select("trade_date").distinct(), b))
query("ingest_upsert_state", sql.rounded([], """SELECT o_orderkey AS name, o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS bytes
    FROM orders WHERE o_orderkey % 7 <> 0""", "bytes"))(
    lambda s, d: ingest.upsert((o := read_table(s, d, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_totalprice").alias("bytes"))),
    o.filter("name % 3 = 0").withColumn("bytes", F.col("bytes") * 2), ["name"], o.filter("name % 7 = 0").select("name")))
_SNAPSHOT = "CASE o_orderkey % 5 WHEN 3 THEN '20241332' WHEN 4 THEN '2024011' ELSE strftime(o_orderdate, '%Y%m%d') END"
query("ingest_calendar_accumulate",
    sql.rounded([], f"SELECT day AS trade_date, arg_max(o_orderpriority, o_orderkey) AS calendar_symbol FROM (SELECT *, CASE WHEN length(t) = 8 THEN "
    f"try_strptime(t, '%Y%m%d')::DATE END AS day FROM (SELECT *, {_SNAPSHOT} AS t FROM orders)) WHERE day IS NOT NULL GROUP BY 1"))(
    lambda s, d: ingest.accumulate_calendar(read_table(s, d,
    "orders").select(F.when(F.col("o_orderkey") % 5 == 3, "20241332").when(F.col("o_orderkey") % 5 == 4,
    "2024011").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("trade_date"), F.col("o_orderpriority").alias("calendar_symbol"),
    F.col("o_orderkey").alias("seq"))))
query("ingest_changed_partitions",
    sql.rounded([], "SELECT o_orderkey AS name, CASE o_orderkey % 5 WHEN 0 THEN 'removed' WHEN 1 THEN 'dirty' ELSE 'refreshed' END AS change FROM "
    "orders WHERE o_orderkey % 5 IN (0, 1, 2)"))(
    lambda s, d: ingest.changed_partitions(
        (o := read_table(s, d, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("bytes"),
        F.col("o_orderpriority").alias("sha256"))),
        o.filter("name % 5 <> 0").withColumn("sha256", F.when(F.col("name") % 5 == 1, "x").otherwise(F.col("sha256"))).withColumn("bytes",
        F.when(F.col("name") % 5 == 2, F.col("bytes") + 1).otherwise(F.col("bytes")))))

# ---- eligibility


def context(s, d) -> DataFrame:
    return research.forward_targets(daily(s, d), "inday").select("code", "trade_date", "open", "high", "low", "close", "volume", "target_date",
        "target_end_date", "target_return")


def _eligibility(s, d, missing: str = "allow") -> DataFrame:
    b = daily(s, d)
    w = Window.partitionBy("code").orderBy("trade_date")
    k = F.col("code").cast("long")
    ctx = b.select(
        F.col("trade_date").alias("execution_date"), "code", F.col("open").alias("execution_open"), F.col("close").alias("execution_close"),
        F.lag("close").over(w).alias("execution_pre_close"),
        F.when(F.pmod(k, F.lit(3)) == 0, "star").when(F.pmod(k, F.lit(3)) == 1, "main").otherwise("chinext").alias("execution_board"),
        (k % 4 == 0).alias("execution_is_st"),
        F.when(k % 9 == 0, 2).otherwise(100).alias("execution_sessions_since_listing"),
        (F.col("volume") % 13 == 0).alias("execution_has_corporate_action"), (F.col("volume") % 11 == 0).alias("execution_suspended"),
    ).filter(F.col("execution_pre_close") > 0)
    dataset = context(s, d).select("target_date", "target_end_date", "code", "target_return")
    return eligibility.mark_eligibility(dataset, ctx.filter("day(execution_date) <> 9"), list(eligibility.FILTERS), cutoff=SPLIT, missing=missing)


_ELIGIBLE = [
    sql.TICKS, sql.DAILY_BARS, *sql.target_ctes("inday"),
    f"""cx AS (SELECT * FROM (SELECT trade_date, code, open, close, lag(close) OVER ({sql.W}) AS pc, volume % 11 = 0 AS susp, volume % 13 = 0 OR
    (code::BIGINT % 9 = 0 AND code::BIGINT % 3 <> 1) AS free,
      CASE WHEN code::BIGINT % 3 = 1 AND code::BIGINT % 4 = 0 THEN 0.05 WHEN code::BIGINT % 3 = 1 THEN 0.1 ELSE 0.2 END::DOUBLE AS lim FROM daily)
      WHERE pc > 0 AND day(trade_date) <> 9)""",
    """sides AS (SELECT t.target_date, t.target_end_date, t.code, t.target_return, b.code IS NULL AS buy_lost, e.code IS NULL AS sell_lost,
      CASE WHEN b.susp THEN 'suspended_buy' WHEN NOT b.free AND b.open >= round_even(b.pc * (1 + b.lim) / 0.01 + 1e-9, 0) * 0.01 - 1e-6 THEN
      'limit_up_buy' END AS buy,
      CASE WHEN e.susp THEN 'suspended_sell' WHEN NOT e.free AND e.close <= round_even(e.pc * (1 - e.lim) / 0.01 + 1e-9, 0) * 0.01 + 1e-6 THEN
      'limit_down_sell' END AS sell
      FROM targets t LEFT JOIN cx b ON b.trade_date = t.target_date AND b.code = t.code LEFT JOIN cx e ON e.trade_date = t.target_end_date AND e.code
      = t.code)""",
    f"judged AS (SELECT *, target_end_date < DATE '{SPLIT}' AS j FROM sides)",
]
for _policy, _lost in (("allow", "NULL"), ("exclude", "'missing_context'")):
    query(f"eligibility_{'marks' if _policy == 'allow' else 'exclude'}",
        sql.rounded(
        [*_ELIGIBLE, f"rr AS (SELECT target_date, code, CASE WHEN j THEN concat_ws(';', 'buy:' || CASE WHEN buy_lost THEN {_lost} ELSE buy END, "
        f"'sell:' || CASE WHEN sell_lost THEN {_lost} ELSE sell END) ELSE '' END AS reason FROM judged)"], "SELECT *, reason = '' AS eligible FROM rr"))(
        lambda s, d, p=_policy: _eligibility(s, d, p).select("target_date", "code", "reason", "eligible"))
query("eligibility_statistics", sql.rounded(_ELIGIBLE, """SELECT 'limit_up_buy' AS filter, 'buy' AS side, count(*) AS candidate_count, count(*)
    FILTER (NOT buy_lost AND buy IS NOT NULL) AS blocked_count, count(*) FILTER (buy_lost) AS unknown_count FROM judged WHERE j
  UNION ALL SELECT 'limit_down_sell', 'sell', count(*), count(*) FILTER (NOT sell_lost AND sell IS NOT NULL), count(*) FILTER (sell_lost) FROM judged
  WHERE j"""))(lambda s, d: eligibility.statistics(_eligibility(s, d), list(eligibility.FILTERS)))

def _stream(s, d) -> DataFrame:
    source = s.readStream.schema(read_table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("long")
    bars = source.select(F.col("user_id").cast("string").alias("code"), F.col("ts").cast("timestamp").alias("trade_time"),
        F.col("event_id").alias("seq"), *(F.col("value").alias(c) for c in ("open", "high", "low", "close")), k.alias("volume"))
    return run_available(s, stream_kline(bars, "15m"), f"{shared_dir(s)}/barsmith/kline-{uuid.uuid4().hex}")


query("stream_kline", sql.kline_sql("15m"))(_stream)

# ---- queries of further modules register themselves

from . import backtest as _backtest  # noqa: E402, F401
from . import daily_check as _daily_check  # noqa: E402, F401
from . import experiment as _experiment  # noqa: E402, F401
from . import landing as _landing_queries  # noqa: E402, F401
from . import search as _search  # noqa: E402, F401
from . import self_check as _self_check  # noqa: E402, F401
from . import sources as _sources  # noqa: E402, F401
from . import store as _store  # noqa: E402, F401
