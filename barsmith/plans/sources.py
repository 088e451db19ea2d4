"""Queries through the data sources: stores are written to the shared scratch folder and read by name."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import factors
from ..scratch import shared_dir
from ..sources import base
from ..sources.driver import ticks
from ..sources.writers import write_bars
from . import sql, store
from .base import daily, query

c = F.col


def _service(s, d) -> base.MarketDataSource:
    path = f"{shared_dir(s)}/barsmith/bars-{uuid.uuid4().hex}"
    write_bars(ticks(s, d), path)
    return base.open_source(s, "market_service", path=path)


_RANGE = (dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25))
_SOME = ["1", "2", "3", "5", "8", "13", "21", "34"]
_IN = "(" + ", ".join(f"'{x}'" for x in _SOME) + ")"
_TICKS = sql.TICKS.replace("ticks AS (", "every AS (")
RANGED = [_TICKS, f"ticks AS (SELECT * FROM every WHERE trade_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND code IN {_IN})",
    sql.DAILY_BARS]
query("source_minute_scan", sql.rounded(RANGED, "SELECT code, trade_time, seq, close, volume FROM ticks", "close"))(lambda s, d: _service(s,
    d).load_bars(_SOME, *_RANGE).select("code", "trade_time", "seq", "close", "volume"))
_EXPR = {"gap_rank": "cs_rank(overnight_gap) - cs_rank(return_1d)", "turn": "where(realized_vol > 0, volume_ratio_5d, return_1d)"}
_FACTORS = ["return_1d", "last_30m_return"]


def _features(s, d) -> DataFrame:
    source = _service(s, d)
    return source.build_features(source.load_bars(_SOME, *_RANGE), _FACTORS, _EXPR).select("code", "trade_date", *_FACTORS, *_EXPR)


_INTRA = "intra AS (SELECT code, trade_date, realized_vol, last_30m_return FROM (" + sql.INTRADAY_SQL.replace(sql.TICKS, f"{_TICKS},\n{RANGED[1]}") + "))"
_INLINE = {
    "return_1d": factors.DAILY["return_1d"], "gap_rank": f"cs_rank({factors.DAILY['overnight_gap']}) - cs_rank({factors.DAILY['return_1d']})",
    "turn": f"where(realized_vol > 0, {factors.DAILY['volume_ratio_5d']}, {factors.DAILY['return_1d']})",
}
query("source_minute_features",
    sql.rounded([*RANGED, _INTRA,
    "dj AS (SELECT d.*, i.realized_vol, i.last_30m_return FROM daily d LEFT JOIN intra i ON i.code = d.code AND i.trade_date = d.trade_date)",
    *sql.expression_ctes("dj", _INLINE)], f"SELECT code, trade_date, return_1d, last_30m_return, {', '.join(_EXPR)} FROM valued",
    " ".join([*_FACTORS, *_EXPR])))(_features)


def _daily_source(s, d, **options) -> base.MarketDataSource:
    held = store.synced(s, d)
    return base.open_source(s, "qmt_daily", root=held.root, landed=held.landed, broken="drop", **options)


ADJUSTED = [
    *store.LIVES, *store.kept_sql(),
    "ac AS (SELECT 'C' || code AS code, trade_date AS ex_date FROM daily WHERE volume % 9 = 0)",
    "fq AS (SELECT k.*, pow(1.25, (SELECT count(*) FROM ac WHERE ac.code = k.code AND ac.ex_date <= k.trade_date)) AS hfq, pow(1.25, "
    "(SELECT count(*) FROM ac WHERE ac.code = k.code AND ac.ex_date <= DATE '2024-01-15')) AS anchor FROM kp k WHERE suspend_flag = 0 AND trade_date "
    "BETWEEN DATE '2024-01-08' AND DATE '2024-01-26' AND (k.code, k.trade_date) IN (SELECT 'C' || code, trade_date FROM daily WHERE volume >= 0 AND "
    "CAST(low AS DECIMAL(24,4)) > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high)))",
]
for _mode, _factor in (("hfq", "hfq"), ("qfq", "hfq / anchor"), ("none", "1.0::DOUBLE")):
    query(f"source_daily_{_mode}",
        sql.rounded(ADJUSTED, f"SELECT code, trade_date, close * {_factor} AS close, volume / ({_factor if _mode == 'qfq' else '1.0::DOUBLE'}) AS "
        f"volume, {_factor} AS factor FROM fq", "close volume factor"))(
        lambda s, d, m=_mode: _daily_source(s, d, adjust=m, adjust_anchor="2024-01-15" if m == "qfq" else None,
        adjust_volume=m == "qfq").load_bars(None, "2024-01-08", "2024-01-26").select("code", "trade_date", "close",
        c("volume").cast("double").alias("volume"), "factor")
    )


def _cached(s, d) -> DataFrame:
    """The same features twice through a cache: computed, then read."""
    source = _daily_source(s, d)
    cache = factors.FactorCache(f"{shared_dir(s)}/barsmith/cache-{uuid.uuid4().hex}")
    bars = source.load_bars(None, "2024-01-08", "2024-01-26")
    source.build_features(bars, ["return_1d"], {"x": "cs_rank(close)"}, cache)
    return source.build_features(bars, ["return_1d"], {"x": "cs_rank(close)"}, cache).select("code", "trade_date", "return_1d", "x")


query("source_factor_cache",
    sql.rounded([*ADJUSTED, "ad AS (SELECT code, trade_date, close * hfq AS close FROM fq)",
    *sql.expression_ctes("ad", {"return_1d": factors.DAILY["return_1d"], "x": "cs_rank(close)"})],
    "SELECT code, trade_date, return_1d, x FROM valued", "return_1d x"))(_cached)
query("source_symbols", sql.rounded(store.LIVES, "SELECT 'C' || code AS code FROM lf ORDER BY 1 LIMIT 10"))(
    lambda s, d: s.createDataFrame([(x,) for x in _daily_source(s, d).list_symbols(10)], "code string"))
query("factor_by_name", sql.expression_sql({"a": f"ts_mean({factors.DAILY['ma_5d_slope']}, window=3)", "b": f"cs_rank({factors.DAILY['return_5d']}) + close"}))(
    lambda s, d: factors.build(daily(s, d), [], None, {"a": "ts_mean(ma_5d_slope, window=3)", "b": "cs_rank(return_5d) + close"}).select("code",
    "trade_date", "a", "b")
)
