"""Queries of labels by period and of whole backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsl
from ..operators import backtest, research
from . import sql
from .base import SPLIT, daily, ic_of, labelled, portfolio, predictions, query

_AT = f"DATE '{SPLIT}'"

# ---- labels and periods

_RETURNS = "previous_close_to_close_return previous_open_to_close_return target_close_to_previous_close_return"
REPORT = ("rep AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS previous_close_to_close_return, close / nullif(open, "
    "0) - 1 AS previous_open_to_close_return, lead(close) OVER w / nullif(close, 0) - 1 AS target_close_to_previous_close_return FROM scored WINDOW w "
    "AS (PARTITION BY code ORDER BY trade_date))")
_SCORED = [sql.TICKS, sql.DAILY_BARS, *sql.expression_ctes("daily", {"score": sql.SCORE}, "scored")]
query("report_returns", sql.rounded([*_SCORED, REPORT], f"SELECT code, trade_date, {', '.join(_RETURNS.split())} FROM rep", _RETURNS))(
    lambda s, d: research.report_returns(daily(s, d)).select("code", "trade_date", *_RETURNS.split())
)
for _kind in ("inday", "close"):
    query("direction_dataset" if _kind == "inday" else "direction_dataset_close",
        sql.rounded([*_SCORED, REPORT, *sql.target_ctes(_kind, "rep")],
        f"SELECT feature_date, target_date, target_end_date, code, score, {', '.join(_RETURNS.split())}, target_return, (CASE WHEN target_return - "
        f"0.01 > 8 * 2.220446049250313e-16 THEN 1 ELSE 0 END)::INT AS label FROM targets", f"score target_return {_RETURNS}"))(
        lambda s, d, k=_kind: research.direction_dataset(dsl.evaluate(daily(s, d), {"score": sql.SCORE}), ["score"], k, 0.01).withColumn("label",
        F.col("label").cast("int"))
    )
query("period_ic_metrics",
    sql.rounded([*sql.IC, "e AS (SELECT samples, samples < 100 AS thin, CASE WHEN samples >= 100 THEN ic END AS ic, CASE WHEN samples >= 100 THEN "
    "rank_ic END AS rank_ic FROM ic)"], """SELECT count(*) AS dates, count(rank_ic) AS rank_ic_dates, count(*) FILTER (thin) AS thin_dates,
    sum(samples)::BIGINT AS samples,
  count(ic) AS ic_dates, avg(samples) AS mean_cross_section, avg(ic) AS mean_ic, avg(rank_ic) AS mean_rank_ic, avg(ic) / nullif(stddev_samp(ic), 0)
  AS icir, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rank_icir,
  avg((ic > 0)::INT) AS positive_ic_ratio, avg((rank_ic > 0)::INT) AS positive_rank_ic_ratio, sum(samples) / (SELECT count(*) FROM
  predictions)::DOUBLE AS coverage FROM e""",
  "mean_cross_section mean_ic mean_rank_ic icir rank_icir positive_ic_ratio positive_rank_ic_ratio coverage"))(
    lambda s, d: research.period_ic(ic_of(s, d), predictions(s, d).agg(F.count(F.lit(1)).alias("total")), 100)
)
query("period_summary",
    sql.rounded(sql.PREDICTIONS, f"SELECT target_date >= {_AT} AS holdout, count(*) AS samples, count(DISTINCT target_date) AS dates, "
    f"count(DISTINCT code) AS codes, min(target_date) AS first_date, max(target_date) AS last_date FROM predictions GROUP BY 1"))(
    lambda s, d: research.period_summary((p := predictions(s, d)).filter(F.col("target_date") < F.lit(SPLIT))).withColumn("holdout",
    F.lit(False)).unionByName(research.period_summary(p.filter(F.col("target_date") >= F.lit(SPLIT))).withColumn("holdout", F.lit(True)))
)
query("auc_concentrated", sql.rounded(sql.LABELLED, """SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1)
    + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc
  FROM (SELECT label, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2.0 AS r FROM (SELECT label, 0.5 + score / 1e9 AS sc FROM
  lab))""", "auc"))(
    lambda s, d: research.auc(labelled(s, d).withColumn("score", 0.5 + F.col("score") / 1e9), "score", "label")
)

# ---- backtests

query("bt_history_dedup",
    sql.rounded([*sql.PREDICTIONS, "u AS (SELECT * FROM predictions UNION ALL SELECT target_date, target_end_date, code, score / 2, "
    "target_return FROM predictions UNION ALL SELECT target_date, target_end_date, code, score, target_return + 1 FROM predictions WHERE code = '7')",
      "v AS (SELECT *, max(score) OVER (PARTITION BY target_date, code) AS best FROM u)",
      "h AS (SELECT target_date, code, max(score) AS score, min(target_return) AS target_return, count(DISTINCT target_return) AS n_returns FROM v "
      "WHERE score IS NOT DISTINCT FROM best GROUP BY 1, 2)"],
      "SELECT *, lag(target_return) OVER (PARTITION BY code ORDER BY target_date) AS previous_return FROM h", "score target_return previous_return"))(
    lambda s, d: backtest.dedup_history((p := predictions(s, d)).unionByName(p.withColumn("score", F.col("score") / 2)).unionByName(
    p.filter("code = '7'").withColumn("target_return", F.col("target_return") + 1)))
)
EPISODES = [
    *sql.PORTFOLIO,
    "i AS (SELECT *, row_number() OVER (ORDER BY target_date) AS idx, sum((drawdown >= 0)::INT) OVER (ORDER BY target_date) AS island, "
    "lag(target_date) OVER (ORDER BY target_date) AS previous, lead(target_date) OVER (ORDER BY target_date) AS following FROM dd)",
    """ep0 AS (SELECT first(previous ORDER BY idx) AS peak_date, min(target_date) AS start_date, arg_min(target_date, (drawdown, idx)) AS
    trough_date, last(following ORDER BY idx) AS recovery_date, min(drawdown) AS depth, count(*) AS days_under,
      arg_min(idx, (drawdown, idx)) - min(idx) + 1 AS decline_days, max(idx) - arg_min(idx, (drawdown, idx)) + 1 AS to_end FROM i WHERE drawdown < 0
      GROUP BY island)""",
    "ep AS (SELECT peak_date, start_date, trough_date, recovery_date, depth, days_under, decline_days, CASE WHEN recovery_date IS NOT NULL THEN "
    "to_end END AS recovery_days, days_under + (recovery_date IS NOT NULL)::INT AS total_days, recovery_date IS NOT NULL AS recovered FROM ep0)",
]
query("bt_drawdown_episodes", sql.rounded(EPISODES, "SELECT * FROM ep", "depth"))(lambda s, d: backtest.drawdown_episodes(backtest.equity(portfolio(s, d))))
query("bt_drawdown_metrics", sql.rounded(EPISODES, """SELECT (SELECT min(drawdown) FROM dd) AS max_drawdown, (SELECT arg_max(drawdown, target_date)
    FROM dd) AS current_drawdown, (SELECT avg(drawdown) FROM dd) AS average_drawdown,
  coalesce(arg_min(decline_days, (depth, start_date)), 0) AS max_drawdown_decline_days, arg_min(recovery_days, (depth, start_date)) AS
  max_drawdown_recovery_days, coalesce(arg_min(total_days, (depth, start_date)), 0) AS max_drawdown_total_days,
  coalesce(max(total_days), 0) AS longest_drawdown_days, count(*) AS episodes, log10((SELECT (pow(product(1 + net), 252.0 / count(*)) - 1) FROM port)
  / nullif(-(SELECT min(drawdown) FROM dd), 0) + 10) AS calmar FROM ep""",
  "max_drawdown current_drawdown average_drawdown calmar"))(
    lambda s, d: backtest.drawdown_metrics(backtest.equity(portfolio(s, d))).withColumn("calmar",
    F.log10(F.col("calmar") + 10)).withColumn("max_drawdown_recovery_days", F.col("max_drawdown_recovery_days"))
)
_NET = f"(1 + {{0}}) * {sql.COST} - 1"
TABLE = [
    *sql.PREDICTIONS,
    "h AS (SELECT *, least(10, size) AS held FROM ranked)",
    """g AS (SELECT target_date, count(*) FILTER (place <= 10) AS top_count, avg(target_return) FILTER (place <= 10) AS top_gross, count(*) AS
    universe_count, avg(target_return) AS universe_gross, count(*) FILTER (place > size - 10) AS bottom_count,
      avg(target_return) FILTER (place > size - 10) AS bottom_gross, count(*) FILTER (place > (size - held) // 2 AND place <= (size - held) // 2 +
      held) AS middle_count,
      avg(target_return) FILTER (place > (size - held) // 2 AND place <= (size - held) // 2 + held) AS middle_gross FROM h GROUP BY 1)""",
    "nt AS (SELECT *, " + ", ".join(f"{_NET.format(m + '_gross')} AS {m}_net" for m in ("top", "universe", "bottom", "middle")) + " FROM g)",
    "eq AS (SELECT *, " + ", ".join(f"product(1 + {m}_net) OVER (ORDER BY target_date) AS {m}_equity" for m in ("top", "universe", "bottom",
    "middle")) + " FROM nt)",
    "tab AS (SELECT *, " + ", ".join(f"{m}_equity / greatest(1.0, max({m}_equity) OVER (ORDER BY target_date)) - 1 AS {m}_drawdown" for m in ("top",
    "universe")) + ", top_gross - universe_gross AS top_minus_universe, top_gross - bottom_gross AS top_minus_bottom FROM eq)",
]
_DOUBLES = " ".join([f"{m}_{k}" for m in ("top", "universe", "bottom", "middle") for k in ("gross", "net", "equity")] + ["top_drawdown",
    "universe_drawdown", "top_minus_universe", "top_minus_bottom"])


def _table(s, d) -> DataFrame:
    return backtest.daily_table(predictions(s, d), 10, 0.0003, 0.001)


query("bt_daily_table", sql.rounded(TABLE, "SELECT * FROM tab", _DOUBLES))(_table)
_SPREADS = ", ".join(f"avg({x}) * 252 AS {x}_annual, stddev_samp({x}) * sqrt(252) AS {x}_volatility, avg({x}) / nullif(stddev_samp({x}), "
    f"0) * sqrt(252) AS {x}_sharpe, avg(({x} > 0)::INT) AS {x}_win_rate" for x in ("top_minus_universe", "top_minus_bottom"))
query("bt_benchmark_metrics",
    sql.rounded(TABLE, f"SELECT product(1 + universe_net) - 1 AS equal_weight_total_return, avg(universe_net) / nullif(stddev_samp(universe_net), "
    f"0) * sqrt(252) AS equal_weight_sharpe, {_SPREADS} FROM tab",
      "equal_weight_total_return equal_weight_sharpe "
      + " ".join(f"{x}_{k}" for x in ("top_minus_universe", "top_minus_bottom") for k in ("annual", "volatility", "sharpe", "win_rate"))))(
      lambda s, d: backtest.benchmark_metrics(_table(s, d)))
_DECILE = [
    *sql.PREDICTIONS,
    "q AS (SELECT *, row_number() OVER (PARTITION BY target_date ORDER BY score, code DESC) - 1 AS pos FROM ranked)",
    "e AS (SELECT *, (CASE WHEN size >= 10 THEN pos * 10 // size + 1 WHEN size = 1 THEN 10 ELSE round_even(pos * 9 / greatest(size - 1, 1)::DOUBLE, "
    "0) + 1 END)::INT AS decile FROM q)",
    "f AS (SELECT target_date, decile, avg(target_return) AS m, avg((target_return > 0)::INT) AS h, count(*) AS n FROM e GROUP BY 1, 2)",
]
query("bt_deciles", sql.rounded(_DECILE, "SELECT decile, count(*) AS days, sum(n)::BIGINT AS samples, avg(m) AS mean_return FROM f GROUP BY 1",
    "mean_return"))(lambda s, d: backtest.deciles(predictions(s, d)))
query("bt_decile_table",
    sql.rounded(_DECILE, "SELECT decile, sum(n)::BIGINT AS samples, count(*) AS days, avg(m) AS mean_return, avg(h) AS hit_rate, "
    "avg(m) * 252 AS annual_return FROM f GROUP BY 1", "mean_return hit_rate annual_return"))(lambda s, d: backtest.decile_table(predictions(s, d)))
query("bt_selections",
    sql.rounded([*sql.PREDICTIONS,
    "h AS (SELECT target_date, code, lag(target_return) OVER (PARTITION BY code ORDER BY target_date) AS previous_return FROM predictions)"],
    "SELECT r.target_date, r.code, score, target_return, place, previous_return FROM ranked r JOIN h ON h.target_date = r.target_date AND h.code = "
    "r.code WHERE place <= 10", "score target_return previous_return"))(
    lambda s, d: backtest.selections(predictions(s, d), 10, backtest.dedup_history(predictions(s, d))).select("target_date", "code", "score",
    "target_return", "place", "previous_return")
)
RANDOM = [
    *sql.PREDICTIONS,
    "dy AS (SELECT DISTINCT target_date, size FROM ranked)",
    """fl AS (SELECT s.sim, target_date, size, size - least(10, size) AS j, []::BIGINT[] AS chosen FROM dy, (SELECT unnest(range(1000)) AS sim) s
      UNION ALL SELECT sim, target_date, size, j + 1, list_append(chosen, CASE WHEN list_contains(chosen, t) THEN j + 1 ELSE t END)
      FROM (SELECT *, (('0x' || left(md5('42|' || sim || '|' || target_date || '|' || (j + 1)), 8))::BIGINT % (j + 1)) + 1 AS t FROM fl WHERE j < size))""",
    "dr AS (SELECT sim, target_date, unnest(chosen) AS place FROM fl WHERE j = size)",
    f"rd AS (SELECT sim, d.target_date, avg({_NET.format('target_return')}) AS net FROM dr d JOIN ranked r ON r.target_date = d.target_date AND "
    f"r.place = d.place GROUP BY 1, 2)",
    "rp AS (SELECT sim, product(1 + net) AS equity, count(*) AS days FROM rd GROUP BY 1)",
    "ra AS (SELECT pow(equity, 252.0 / days) - 1 AS a FROM rp WHERE equity > 0)",
    "own AS (SELECT pow(product(1 + net), 252.0 / count(*)) - 1 AS own FROM port)",
]
_PORT = f"port AS (SELECT target_date, (1 + avg(target_return)) * {sql.COST} - 1 AS net FROM ranked WHERE place <= 10 GROUP BY target_date)"


def _random(s, d) -> DataFrame:
    return backtest.random_portfolios(predictions(s, d), 10, 1000, 42, 0.0003, 0.001)


query("bt_random_portfolios", sql.rounded(RANDOM[:-2], "SELECT * FROM rp", "equity"))(_random)
_LOGS = ("random_p05", "random_median", "random_p95")
query("bt_random_baseline",
    sql.rounded([*RANDOM[:-1], _PORT, RANDOM[-1]],
    "SELECT count(*) AS simulations, log10(quantile_cont(a, 0.05) + 1) AS random_p05, log10(quantile_cont(a, 0.5) + 1) AS random_median, "
    "log10(quantile_cont(a, 0.95) + 1) AS random_p95, avg((a <= own)::INT) AS strategy_percentile FROM ra, own", " ".join([*_LOGS, "strategy_percentile"])))(
    lambda s, d: backtest.random_baseline(_random(s, d), backtest.compound_metrics(portfolio(s, d))).withColumns({c: F.log10(F.col(c) + 1) for c in _LOGS})
)
