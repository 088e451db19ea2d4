"""DuckDB SQL of the registered queries: an independent statement of each, from the same tables."""

from __future__ import annotations

from ..functions import dsl
from ..functions.factors import DAILY, INTRADAY

TICKS = """ticks AS (SELECT user_id::VARCHAR AS code, ts AS trade_time, ts::DATE AS trade_date, event_id AS seq, value AS open, value AS high, value
    AS low, value AS close,
  json_extract_string(props, '$.k')::BIGINT AS volume, value * json_extract_string(props, '$.k')::BIGINT AS amount FROM events)"""
DAILY_BARS = """daily AS (SELECT code, trade_date, arg_min(open, (trade_time, seq)) AS open, max(high) AS high, min(low) AS low, arg_max(close,
    (trade_time, seq)) AS close,
  sum(volume)::BIGINT AS volume FROM ticks GROUP BY code, trade_date)"""
FILLS = """fills AS (SELECT l_suppkey::VARCHAR AS code, l_shipdate AS trade_time, l_shipdate::DATE AS trade_date, l_orderkey * 10 + l_linenumber AS seq,
  l_extendedprice / l_quantity AS price, l_quantity AS volume FROM lineitem)"""
PANEL = """panel AS (SELECT code, trade_date, arg_min(price, (trade_time, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price,
    (trade_time, seq)) AS close,
  sum(volume) AS volume FROM fills GROUP BY code, trade_date)"""
ACTIONS = """actions AS (SELECT user_id::VARCHAR AS code, ts::DATE AS ex_date, 1 + json_extract_string(props, '$.k')::DOUBLE / 1000 AS
    adjustment_factor, event_id AS seq
  FROM events WHERE event_type = 'signup')"""
LIFE = """life AS (SELECT code, min(trade_date) AS open_date, CASE WHEN max(trade_date) < (SELECT max(trade_date) FROM daily) THEN max(trade_date)
    END AS expire_date,
  CASE code::BIGINT % 3 WHEN 0 THEN 'star' WHEN 1 THEN 'main' ELSE 'chinext' END AS board FROM daily GROUP BY code)"""
AUDITED = """bars AS (SELECT code, trade_date, open, CASE WHEN volume % 13 = 0 THEN low * 0.9 ELSE high END AS high, low, close, CASE WHEN volume %
    17 = 0 THEN 0 ELSE volume END AS volume,
  close * CASE WHEN volume % 19 = 0 THEN 0 ELSE volume END AS amount, CASE WHEN volume % 11 = 0 THEN 1 WHEN volume % 23 = 0 THEN 5 ELSE 0 END AS suspend_flag,
  CASE WHEN volume % 7 = 0 THEN 1.03 ELSE 1.0 END * lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS pre_close FROM daily)"""


def rounded(ctes: list[str], select: str, doubles: str = "") -> str:
    # the small shift keeps products of few decimals off rounding ties
    r = ", ".join(f"round({c} + 1.23e-8, 6) + 0.0 AS {c}" for c in doubles.split())
    return "WITH RECURSIVE " + ",\n".join([*ctes, f"result AS ({select})"]) + f"\nSELECT * {f'REPLACE ({r})' if r else ''} FROM result"


W = "PARTITION BY code ORDER BY trade_date"


def _fin(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


def _pairwise(op: str, a: str, b: str) -> str:
    return f"coalesce(({a}) {op} ({b}), false)"


def _element(n: dsl.Node, a: list[str]) -> str:
    p = dict(n.parameters)
    signs = {"add": "+", "subtract": "-", "multiply": "*"}
    compare = {"less_than": "<", "less_equal": "<=", "greater_than": ">", "greater_equal": ">=", "equal": "=", "not_equal": "<>"}
    name = n.operator
    if name in signs:
        return _fin(f"({a[0]} {signs[name]} {a[1]})")
    if name in compare:
        return _pairwise(compare[name], *a)
    if name == "divide":
        return _fin(f"({a[0]} / nullif({a[1]}, 0))")
    if name == "power":
        return f"(CASE WHEN isfinite(pow({a[0]}, {p['exponent']})) THEN pow({a[0]}, {p['exponent']}) END)"
    return {
        "negative": "(-{0})", "absolute": "abs({0})", "log": "(CASE WHEN {0} > 0 THEN ln({0}) END)", "sign": "sign({0})::DOUBLE",
        "signed_power": "(sign({0}) * pow(abs({0}), {e}))",
        "where": "(CASE WHEN coalesce(({0})::DOUBLE <> 0, false) THEN {1} ELSE {2} END)",
    }[name].format(*a, e=p.get("exponent"))


def _windowed(n: dsl.Node, a: list[str]) -> str:
    p, name, x = dict(n.parameters), n.operator, a[0]
    d = "PARTITION BY trade_date"
    if name in ("delay", "delta", "returns"):
        lag = x if p["periods"] == 0 else f"lag({x}, {p['periods']}) OVER ({W})"
        return {"delay": lag, "delta": f"{x} - {lag}", "returns": f"{x} / nullif({lag}, 0) - 1"}[name]
    if name.startswith("ts_"):
        w = f"({W} ROWS BETWEEN {p['window'] - 1} PRECEDING AND CURRENT ROW)"
        n_of = f"count({x}) OVER {w}"
        gate = lambda v, least=1: f"CASE WHEN {n_of} >= {max(p['min_periods'], least)} THEN {v} END"
        if name in ("ts_sum", "ts_mean", "ts_min", "ts_max"):
            return gate(f"{ {'ts_sum': 'sum', 'ts_mean': 'avg', 'ts_min': 'min', 'ts_max': 'max'}[name]}({x}) OVER {w}")
        if name == "ts_stddev":
            return (f"CASE WHEN {n_of} >= {p['min_periods']} AND {n_of} > {p['ddof']} THEN sqrt(var_pop({x}) OVER {w} * {n_of} / nullif({n_of} - "
                f"{p['ddof']}, 0)) END")
        if name in ("ts_argmax", "ts_argmin"):
            return gate(f"list_position(list({x}) OVER {w}, {name[-3:]}({x}) OVER {w})::DOUBLE")
        if name == "ts_rank":
            lists = f"list({x}) OVER {w}"
            return (f"CASE WHEN {x} IS NOT NULL THEN "
                f"{gate(f'(len(list_filter({lists}, lambda v: v < {x})) + (len(list_filter({lists}, lambda v: v = {x})) + 1) / 2.0) / {n_of}')} END")
        u, v = f"(CASE WHEN {a[1]} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {a[1]} END)"
        pairs = f"count({u}) OVER {w}"
        if name == "ts_covariance":
            return f"CASE WHEN {pairs} >= {max(2, p['min_periods'])} THEN covar_samp({u}, {v}) OVER {w} END"
        flat = " OR ".join(f"var_pop({z}) OVER {w} <= 1e-14 * avg({z} * {z}) OVER {w}" for z in (u, v))
        return (f"CASE WHEN {flat} THEN NULL WHEN {pairs} >= {p['min_periods']} THEN covar_pop({u}, {v}) OVER {w} / nullif(sqrt(var_pop({u}) OVER {w} "
            f"* var_pop({v}) OVER {w}), 0) END")
    return {
        "cs_rank": f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({d}, {x} IS NULL ORDER BY {x}) + (count(*) OVER ({d}, {x}) - 1) / 2.0) / count({x}) "
        f"OVER ({d}) END",
        "cs_demean": f"{x} - avg({x}) OVER ({d})",
        "cs_zscore": f"({x} - avg({x}) OVER ({d})) / nullif(stddev_pop({x}) OVER ({d}), 0)",
        "cs_scale": f"{x} / nullif(sum(abs({x})) OVER ({d}), 0)",
        "cs_winsorize": f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, quantile_cont({x}, {p.get('lower')}) OVER ({d})), quantile_cont({x}, "
        f"{p.get('upper')}) OVER ({d})) END",
    }[name]


def expression_ctes(base: str, expressions: dict[str, dsl.Node | str], out: str = "valued") -> list[str]:
    """CTEs ending in `out`: base's columns and one per expression; one CTE per node, children first."""
    nodes = {k: dsl.parse(v) if isinstance(v, str) else v for k, v in expressions.items()}
    names: dict[dsl.Node, str] = {}
    ctes, at = [], base

    def walk(n: dsl.Node) -> None:
        nonlocal at
        if n in names:
            return
        for x in n.inputs:
            walk(x)
        a = [names[x] for x in n.inputs]
        if n.operator == "column":
            names[n] = f"({n.param('name')})::DOUBLE"
        elif n.operator == "constant":
            names[n] = f"{n.param('value')!r}::DOUBLE"
        else:
            names[n] = f"x{len(names)}"
            text = _element(n, a) if dsl.OPERATORS[n.operator].scope == "element" else _windowed(n, a)
            after = f"{out}_{len(ctes)}"
            ctes.append(f"{after} AS (SELECT *, {text} AS {names[n]} FROM {at})")
            at = after

    for n in nodes.values():
        walk(n)
    return [*ctes, f"{out} AS (SELECT *, {', '.join(f'({names[n]})::DOUBLE AS {k}' for k, n in nodes.items())} FROM {at})"]


def expression_sql(expressions: dict[str, str], panel: bool = False) -> str:
    base = [FILLS, PANEL] if panel else [TICKS, DAILY_BARS]
    return rounded([*base, *expression_ctes("panel" if panel else "daily", expressions)],
        f"SELECT code, trade_date, {', '.join(expressions)} FROM valued", " ".join(expressions))


INTRADAY_SQL = rounded([TICKS, f"""b AS (SELECT *, lag(close) OVER up AS before, row_number() OVER down AS from_end, first_value(open) OVER up AS
    day_open FROM ticks
  WINDOW up AS (PARTITION BY code, trade_date ORDER BY trade_time, seq), down AS (PARTITION BY code, trade_date ORDER BY trade_time DESC, seq DESC))""",
  "r AS (SELECT *, close / nullif(before, 0) - 1 AS ret, close / nullif(coalesce(before, day_open), 0) - 1 AS move, abs(close - coalesce(before, "
  "day_open)) AS step FROM b)"],
  """SELECT code, trade_date, CASE WHEN count(*) > 2 THEN stddev_samp(ret) END AS realized_vol, sqrt(avg(least(move, 0) ** 2)) AS downside_semivol,
  (arg_max(close, (trade_time, seq)) - arg_min(open, (trade_time, seq))) / nullif(sum(step), 0) AS intraday_path_efficiency,
  arg_max(close, (trade_time, seq)) / arg_min(close, (trade_time, seq)) FILTER (from_end <= 6) - 1 AS last_30m_return,
  coalesce(sum(volume) FILTER (from_end <= 6), 0) / nullif(sum(volume), 0)::DOUBLE AS last_30m_volume_ratio, avg((ret > 0)::INT::DOUBLE) AS positive_bar_ratio,
  CASE WHEN sum(volume) > 0 THEN sum(sign(move) * volume) / sum(volume)::DOUBLE END AS signed_volume_imbalance,
  CASE WHEN sum(volume) > 0 THEN arg_max(close, (trade_time, seq)) / nullif(sum(close * volume) / sum(volume)::DOUBLE, 0) - 1 END AS close_to_vwap
  FROM r GROUP BY code, trade_date""", " ".join(INTRADAY))


def kline_sql(period: str) -> str:
    bucket = {"15m": "time_bucket(INTERVAL '15 minutes', trade_time)", "30m": "time_bucket(INTERVAL '30 minutes', trade_time)",
        "60m": "time_bucket(INTERVAL '60 minutes', trade_time)", "5m": "time_bucket(INTERVAL '5 minutes', trade_time)",
              "1d": "date_trunc('day', trade_time)", "1w": "date_trunc('week', trade_time)", "1mo": "date_trunc('month', trade_time)"}[period]
    return rounded([TICKS], f"""SELECT code, ({bucket})::TIMESTAMP AS bucket, arg_min(open, (trade_time, seq)) AS open, max(high) AS high, min(low)
    AS low, arg_max(close, (trade_time, seq)) AS close,
      sum(volume)::BIGINT AS volume FROM ticks GROUP BY 1, 2""", "open high low close")


def target_ctes(kind: str, base: str = "daily") -> list[str]:
    value = {"inday": "lead(close, 1) OVER w / nullif(lead(open, 1) OVER w, 0) - 1"}.get(kind,
        f"lead({kind}, 2) OVER w / nullif(lead({kind}, 1) OVER w, 0) - 1")
    end = 1 if kind == "inday" else 2
    return [f"""t AS (SELECT *, trade_date AS feature_date, lead(trade_date, 1) OVER w AS target_date, lead(trade_date, {end}) OVER w AS
    target_end_date, {value} AS target_return FROM {base} WINDOW w AS ({W}))""",
            "targets AS (SELECT * FROM t WHERE target_end_date IS NOT NULL AND target_return IS NOT NULL)"]


SCORE = "cs_rank(returns(close, periods=1))"
PREDICTIONS = [TICKS, DAILY_BARS, *expression_ctes("daily", {"score": SCORE}, "scored"), *target_ctes("inday", "scored"),
               "predictions AS (SELECT target_date, target_end_date, code, score, target_return FROM targets)",
               "ranked AS (SELECT *, row_number() OVER (PARTITION BY target_date ORDER BY score DESC, code) AS place, count(*) OVER (PARTITION BY "
               "target_date) AS size FROM predictions WHERE score IS NOT NULL)"]
COST = "(((1 - 0.001::DOUBLE) * (1 - 0.0003::DOUBLE)) / ((1 + 0.001::DOUBLE) * (1 + 0.0003::DOUBLE)))"
PORTFOLIO = [*PREDICTIONS, f"""port AS (SELECT target_date, count(*) AS n_held, avg(target_return) AS gross, (1 + avg(target_return)) * {COST} - 1 AS
    net FROM ranked WHERE place <= 10 GROUP BY target_date)""",
             "curve AS (SELECT *, product(1 + net) OVER (ORDER BY target_date) AS equity FROM port)",
             "dd AS (SELECT *, greatest(1.0, max(equity) OVER (ORDER BY target_date)) AS peak, equity / greatest(1.0, max(equity) OVER (ORDER BY "
             "target_date)) - 1 AS drawdown FROM curve)"]
CORR = "CASE WHEN count(*) >= 2 THEN covar_pop({0}, {1}) / nullif(sqrt(var_pop({0}) * var_pop({1})), 0) END"
IC = [*PREDICTIONS, """pairs AS (SELECT *, rank() OVER (PARTITION BY target_date ORDER BY score) + (count(*) OVER (PARTITION BY target_date, score) -
    1) / 2.0 AS rs,
  rank() OVER (PARTITION BY target_date ORDER BY target_return) + (count(*) OVER (PARTITION BY target_date, target_return) - 1) / 2.0 AS rt FROM
  predictions WHERE score IS NOT NULL AND target_return IS NOT NULL)""",
  f"ic AS (SELECT target_date, count(*) AS samples, {CORR.format('score', 'target_return')} AS ic, {CORR.format('rs', 'rt')} AS rank_ic FROM pairs "
  f"GROUP BY target_date)"]
LABELLED = [*PREDICTIONS, "lab AS (SELECT *, CASE WHEN target_return - 0.005 > 8 * 2.220446049250313e-16 THEN 1 ELSE 0 END AS label FROM predictions "
    "WHERE score IS NOT NULL)"]
CUMULATIVE = [ACTIONS, "cum AS (SELECT code, ex_date, exp(sum(s) OVER (PARTITION BY code ORDER BY ex_date)) AS hfq FROM (SELECT code, ex_date, "
    "sum(ln(adjustment_factor)) AS s FROM actions GROUP BY 1, 2))"]
ASOF = [TICKS, DAILY_BARS, *CUMULATIVE,
    "adj AS (SELECT d.*, coalesce(c.hfq, 1.0) AS hfq FROM daily d ASOF LEFT JOIN cum c ON d.code = c.code AND d.trade_date >= c.ex_date)"]
CHECKS = [TICKS, DAILY_BARS, AUDITED]
EXPECTED = [TICKS, DAILY_BARS, LIFE,
    "cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS ordinal FROM (SELECT DISTINCT trade_date FROM daily))",
            "expected AS (SELECT l.code, c.trade_date, c.ordinal FROM life l JOIN cal c ON c.trade_date >= l.open_date AND (l.expire_date IS NULL OR "
            "c.trade_date <= l.expire_date))",
            "gone AS (SELECT e.* FROM expected e LEFT JOIN daily d USING (code, trade_date) WHERE d.code IS NULL)"]
VIOLATION = {
    "DAILY_NULL_FIELD": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL OR amount IS NULL",
    "DAILY_NON_POSITIVE_PRICE": "least(open, high, low, close) <= 0",
    "DAILY_INVALID_OHLC": "high < greatest(open, close, low) OR low > least(open, close, high)",
    "DAILY_NEGATIVE_QUANTITY": "volume < 0 OR amount < 0", "DAILY_INVALID_SUSPEND_FLAG": "suspend_flag NOT IN (-1, 0, 1)",
    "DAILY_ACTIVE_ZERO_VOLUME": "coalesce(suspend_flag, 0) = 0 AND volume = 0",
    "DAILY_ACTIVE_ZERO_AMOUNT": "coalesce(suspend_flag, 0) = 0 AND amount = 0 AND volume > 0",
    "DAILY_SUSPENDED_WITH_TURNOVER": "coalesce(suspend_flag, 0) <> 0 AND (volume > 0 OR amount > 0)",
    "DAILY_VWAP_OUT_OF_RANGE": "coalesce(suspend_flag, 0) = 0 AND (amount / nullif(volume, 0) < low * 0.99 OR amount / nullif(volume, 0) > high * 1.01)",
}


def rules_sql(rules: dict[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT code, trade_date, '{level}' AS level, '{name}' AS issue_code, NULL::VARCHAR AS expected, "
        f"NULL::VARCHAR AS actual FROM bars WHERE {VIOLATION[name]}" for name, level in rules.items())
    return rounded(CHECKS, parts)


FACTOR_FAMILIES = {
    "factors_returns": ["return_1d", "return_5d", "return_10d", "return_20d", "intraday_return", "overnight_gap"],
    "factors_candle": ["amplitude", "close_position", "candle_body_ratio"],
    "factors_ma": ["close_to_ma_5d", "ma_5d_slope", "ma_distance_change_5d", "ma_spread_5d_20d", "ma_spread_change_5d_20d"],
    "factors_channel_breakout": ["breakout_strength_20d", "channel_position_20d"],
    "factors_vol_updays_volume": ["volatility_5d", "up_days_ratio_5d", "volume_ratio_5d"],
    "factors_momentum": ["momentum_acceleration_5d_20d"], "factor_alpha_001": ["alpha_001"], "factor_alpha_002": ["alpha_002"],
}


#: Over the tick days: on the panel, changes of logarithms tie up to the last bit, which two libraries rank differently.
ON_TICKS = {"factor_alpha_002"}


def family_sql(name: str) -> str:
    return expression_sql({f: DAILY[f] for f in FACTOR_FAMILIES[name]}, panel=name not in ON_TICKS)
