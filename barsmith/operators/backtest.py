"""Top-N backtest: selections, costs, equity, drawdowns, deciles and sensitivity, as DataFrames.

Windows over dates alone (equity, drawdown) see one row per trading day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, ratio

DAYS = 252


def dedup_history(predictions: DataFrame, score: str = "score") -> DataFrame:
    """Per (target_date, code) the row of highest finite score (or rows without one), with the number of different returns among its ties (NULL is
    one) and the return before it."""
    p = predictions.withColumn("__s", finite(F.col(score)))
    key = Window.partitionBy("target_date", "code")
    best = p.withColumn("__best", F.max("__s").over(key)).filter(F.col("__s").eqNullSafe(F.col("__best")))
    kinds = F.countDistinct("target_return") + F.max(F.when(F.col("target_return").isNull(), 1).otherwise(0))
    out = best.groupBy("target_date", "code").agg(F.max("__s").alias(score), F.min("target_return").alias("target_return"), kinds.alias("n_returns"))
    return out.withColumn("previous_return", F.lag("target_return").over(Window.partitionBy("code").orderBy("target_date")))


def checked_history(predictions: DataFrame, score: str = "score") -> DataFrame:
    """dedup_history, or ValueError where rows that tie for the best score of a code and day have different returns."""
    history = dedup_history(predictions, score)
    if rows := history.filter("n_returns > 1").orderBy("code", "target_date").limit(5).collect():
        raise ValueError("conflicting returns: " + ", ".join(f"{r.code}:{r.target_date}" for r in rows))
    return history.drop("n_returns")


def ranked(predictions: DataFrame, score: str = "score") -> DataFrame:
    """Finite-scored rows with their place from the top (score down, code up) and the day's size."""
    p = predictions.filter(finite(F.col(score)).isNotNull())
    day = Window.partitionBy("target_date")
    return p.withColumn("place", F.row_number().over(day.orderBy(F.col(score).desc(), "code"))).withColumn("size", F.count(F.lit(1)).over(day))


def top_n(predictions: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The first n of each day; only those are kept by each task before the shuffle."""
    p = predictions.filter(finite(F.col(score)).isNotNull())
    order = Window.partitionBy("target_date").orderBy(F.col(score).desc(), "code")
    return p.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def buckets(predictions: DataFrame, n: int, score: str = "score") -> DataFrame:
    """Rows of the top, middle and bottom n of each day, labelled (a row may be in several)."""
    r = ranked(predictions, score)
    held = F.least(F.lit(n), F.col("size"))
    start = F.floor((F.col("size") - held) / 2)
    names = F.array_compact(F.array(
        F.when(F.col("place") <= n, "top"), F.when((F.col("place") > start) & (F.col("place") <= start + held), "middle"),
        F.when(F.col("place") > F.col("size") - n, "bottom")
    ))
    return r.withColumn("bucket", F.explode(names))


def cost_multiplier(commission: float, slippage: float) -> float:
    return (1 - slippage) * (1 - commission) / ((1 + slippage) * (1 + commission))


def net(gross: Column, commission: float, slippage: float) -> Column:
    return (1 + gross) * F.lit(cost_multiplier(commission, slippage)) - 1


def daily_returns(selected: DataFrame, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """target_date, n_held, gross, net of equal-weighted selections."""
    out = selected.groupBy("target_date").agg(F.count(F.lit(1)).alias("n_held"), F.avg("target_return").alias("gross"))
    return out.withColumn("net", net(F.col("gross"), commission, slippage))


def equity(daily: DataFrame, value: str = "net") -> DataFrame:
    w = Window.orderBy("target_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("equity", F.product(1 + F.col(value)).over(w))


def drawdown(curve: DataFrame) -> DataFrame:
    """With the running peak (1.0 at the start) and the drawdown from it."""
    w = Window.orderBy("target_date").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w))).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def drawdown_episodes(curve: DataFrame) -> DataFrame:
    """Maximal runs of days below the peak: peak date (NULL before day one), first deepest day, recovery, depth, and days from peak to trough, trough
    to recovery (NULL if none) and in all."""
    w = Window.orderBy("target_date")
    d = drawdown(curve).withColumn("idx", F.row_number().over(w))
    d = d.withColumn("island", F.sum(F.when(F.col("drawdown") >= 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("previous", F.lag("target_date").over(w)).withColumn("next", F.lead("target_date").over(w))
    deepest = F.struct("drawdown", "idx")
    out = d.filter("drawdown < 0").groupBy("island").agg(
        F.min_by("previous", "idx").alias("peak_date"), F.min("target_date").alias("start_date"),
        F.min_by("target_date", deepest).alias("trough_date"), F.max_by("next", "idx").alias("recovery_date"),
        F.min("drawdown").alias("depth"), (F.min_by("idx", deepest) - F.min("idx") + 1).cast("long").alias("decline_days"),
        (F.max("idx") - F.min_by("idx", deepest) + 1).cast("long").alias("to_end"), F.count(F.lit(1)).alias("days_under"),
    )
    recovered = F.col("recovery_date").isNotNull()
    return out.select(
        "peak_date", "start_date", "trough_date", "recovery_date", "depth", "days_under", "decline_days",
        F.when(recovered, F.col("to_end")).alias("recovery_days"),
        (F.col("days_under") + F.when(recovered, 1).otherwise(0)).alias("total_days"), recovered.alias("recovered"),
    )


def drawdown_metrics(curve: DataFrame, value: str = "net") -> DataFrame:
    """One row: deepest, current and average drawdown, the deepest episode's days, the longest episode and the Calmar ratio."""
    d = drawdown(curve)
    depth = d.agg(F.min("drawdown").alias("max_drawdown"), F.max_by("drawdown", "target_date").alias("current_drawdown"),
        F.avg("drawdown").alias("average_drawdown"))
    e = drawdown_episodes(curve)
    first = F.struct("depth", "start_date")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    days = e.agg(
        zero(F.min_by("decline_days", first)).alias("max_drawdown_decline_days"),
        F.min_by("recovery_days", first).cast("long").alias("max_drawdown_recovery_days"),
        zero(F.min_by("total_days", first)).alias("max_drawdown_total_days"), zero(F.max("total_days")).alias("longest_drawdown_days"),
        F.count(F.lit(1)).alias("episodes"),
    )
    annual = compound_metrics(curve, value).select("annual_return")
    out = depth.crossJoin(F.broadcast(days)).crossJoin(F.broadcast(annual))
    return out.withColumn("calmar", ratio(F.col("annual_return"), -F.col("max_drawdown"))).drop("annual_return")


def compound_metrics(daily: DataFrame, value: str = "net") -> DataFrame:
    x, n = F.col(value), F.count(F.lit(1))
    total = F.product(1 + x)
    return daily.agg(
        n.alias("days"), (total - 1).alias("total_return"), F.when(total > 0, F.pow(total, DAYS / n) - 1).alias("annual_return"),
        (F.stddev_samp(x) * DAYS**0.5).alias("annual_volatility"), (ratio(F.avg(x), F.stddev_samp(x)) * DAYS**0.5).alias("sharpe"),
    )


def spread_metrics(selected: DataFrame) -> DataFrame:
    """Daily top minus bottom mean return, arithmetically annualised."""
    day = selected.groupBy("target_date").agg(F.avg(F.when(F.col("bucket") == "top", F.col("target_return"))).alias("top"),
        F.avg(F.when(F.col("bucket") == "bottom", F.col("target_return"))).alias("bottom"))
    s = F.col("top") - F.col("bottom")
    return day.agg(F.count(s).alias("days"), (F.avg(s) * DAYS).alias("annual_spread"), (F.stddev_samp(s) * DAYS**0.5).alias("spread_volatility"),
        (ratio(F.avg(s), F.stddev_samp(s)) * DAYS**0.5).alias("spread_sharpe"))


def _deciled(predictions: DataFrame, score: str = "score") -> DataFrame:
    r = ranked(predictions, score)
    up = F.row_number().over(Window.partitionBy("target_date").orderBy(score, F.col("code").desc())) - 1
    r = r.withColumn("pos", up)
    d = F.when(F.col("size") >= 10, F.floor(F.col("pos") * 10 / F.col("size")) + 1).when(F.col("size") == 1,
        10).otherwise(F.rint(F.col("pos") * 9 / F.greatest(F.col("size") - 1, F.lit(1))) + 1)
    return r.withColumn("decile", d.cast("int"))


def deciles(predictions: DataFrame, score: str = "score") -> DataFrame:
    """Day-equal mean return per prediction decile (10 is the highest)."""
    day = _deciled(predictions, score).groupBy("target_date", "decile").agg(F.avg("target_return").alias("m"), F.count(F.lit(1)).alias("n"))
    return day.groupBy("decile").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("samples"), F.avg("m").alias("mean_return"))


def slippage_sensitivity(daily: DataFrame, levels: list[float], commission: float) -> DataFrame:
    """Total return per slippage level, recosted from daily gross means; no levels give no rows."""
    if not levels:
        return daily.sparkSession.createDataFrame([], "slippage double, days long, total_return double")
    grid = F.explode(
        F.array(*[F.struct(F.lit(float(s)).alias("slippage"), F.lit(cost_multiplier(commission, s)).alias("m")) for s in sorted(set(levels))])).alias("x")
    x = daily.select("gross", grid)
    return x.groupBy(F.col("x.slippage").alias("slippage")).agg(F.count(F.lit(1)).alias("days"),
        (F.product((1 + F.col("gross")) * F.col("x.m")) - 1).alias("total_return"))


def top_vs_rest(predictions: DataFrame, n: int, score: str = "score") -> DataFrame:
    r = ranked(predictions, score).withColumn("top", F.col("place") <= n)
    x, hit = F.col("target_return"), (F.col("target_return") > 0).cast("double")
    mean = lambda c, top: F.avg(F.when(F.col("top") == top, c))
    return r.agg(
        mean(hit, True).alias("top_hit_rate"), mean(hit, False).alias("rest_hit_rate"), mean(x, True).alias("top_mean"), mean(x, False).alias("rest_mean"),
        (mean(x, True) - mean(x, False)).alias("difference"),
    )


def yearly(daily: DataFrame, value: str = "net") -> DataFrame:
    return daily.groupBy(F.year("target_date").alias("year")).agg(F.count(F.lit(1)).alias("days"), (F.product(1 + F.col(value)) - 1).alias("total_return"))


def _drawn(seed: int, n: int) -> Column:
    """min(n, size) different places of 1..size, by Floyd's sampling from hashes of (seed, sim, date, step): each set is as likely."""
    held = F.least(F.lit(n).cast("long"), F.col("size"))

    def add(chosen: Column, step: Column) -> Column:
        text = F.concat_ws("|", F.lit(seed), F.col("sim"), F.col("target_date"), step)
        place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % step + 1
        return F.array_append(chosen, F.when(F.array_contains(chosen, place), step).otherwise(place))

    return F.aggregate(F.sequence(F.col("size") - held + 1, F.col("size")), F.array().cast("array<bigint>"), add)


def random_portfolios(predictions: DataFrame, n: int, simulations: int = 1000, seed: int = 42, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """sim, equity of portfolios of n codes drawn a day without replacement: n places per (sim, day) are drawn, then joined with the ranked rows."""
    r = ranked(predictions).select("target_date", "place", "size", net(F.col("target_return"), commission, slippage).alias("r"))
    days = r.select("target_date", "size").distinct().withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(simulations - 1).cast("long"))))
    draws = days.select("sim", "target_date", F.explode(_drawn(seed, n)).alias("place"))
    day = draws.join(r.select("target_date", F.col("place").cast("long").alias("place"), "r"), ["target_date", "place"]).groupBy("sim",
        "target_date").agg(F.avg("r").alias("net"))
    return day.groupBy("sim").agg(F.product(1 + F.col("net")).alias("equity"), F.count(F.lit(1)).alias("days"))


def random_baseline(portfolios: DataFrame, strategy: DataFrame) -> DataFrame:
    """One row: simulations, 5th, 50th and 95th percentile of annual returns, and the share of them at or below the strategy's (strategy: annual_return)."""
    annual = portfolios.filter("equity > 0").select((F.pow("equity", DAYS / F.col("days")) - 1).alias("a"))
    x = annual.crossJoin(F.broadcast(strategy.select(F.col("annual_return").alias("own"))))
    return x.agg(
        F.count(F.lit(1)).alias("simulations"), F.percentile("a", 0.05).alias("random_p05"), F.percentile("a", 0.5).alias("random_median"),
        F.percentile("a", 0.95).alias("random_p95"),
        F.avg((F.col("a") <= F.col("own")).cast("double")).alias("strategy_percentile"),
    )


# ---- whole runs


def daily_table(predictions: DataFrame, n: int, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """Per day: counts, gross and net means of the top, all, bottom and middle, their equities, drawdowns and spreads."""
    b = buckets(predictions, n).unionByName(ranked(predictions).withColumn("bucket", F.lit("universe")))
    k = lambda name: F.when(F.col("bucket") == name, F.col("target_return"))
    names = ("top", "universe", "bottom", "middle")
    day = b.groupBy("target_date").agg(*[f for m in names for f in (F.count(k(m)).alias(f"{m}_count"), F.avg(k(m)).alias(f"{m}_gross"))])
    day = day.withColumns({f"{m}_net": net(F.col(f"{m}_gross"), commission, slippage) for m in names})
    w = Window.orderBy("target_date").rowsBetween(Window.unboundedPreceding, 0)
    day = day.withColumns({f"{m}_equity": F.product(1 + F.col(f"{m}_net")).over(w) for m in names})
    under = lambda m: F.col(f"{m}_equity") / F.greatest(F.lit(1.0), F.max(f"{m}_equity").over(w)) - 1
    day = day.withColumns({"top_drawdown": under("top"), "universe_drawdown": under("universe")})
    return day.withColumns({"top_minus_universe": F.col("top_gross") - F.col("universe_gross"), "top_minus_bottom": F.col("top_gross") - F.col("bottom_gross")})


def benchmark_metrics(table: DataFrame) -> DataFrame:
    """One row: the equal-weighted universe's compound metrics and both spreads' arithmetic ones."""
    out = compound_metrics(table.select("target_date", F.col("universe_net").alias("net"))).select(
        F.col("total_return").alias("equal_weight_total_return"), F.col("sharpe").alias("equal_weight_sharpe"))
    for s in ("top_minus_universe", "top_minus_bottom"):
        x = F.col(s)
        spread = table.agg((F.avg(x) * DAYS).alias(f"{s}_annual"), (F.stddev_samp(x) * DAYS**0.5).alias(f"{s}_volatility"),
            (ratio(F.avg(x), F.stddev_samp(x)) * DAYS**0.5).alias(f"{s}_sharpe"), F.avg((x > 0).cast("double")).alias(f"{s}_win_rate"))
        out = out.crossJoin(F.broadcast(spread))
    return out


def decile_table(predictions: DataFrame, score: str = "score") -> DataFrame:
    """Per decile (10 highest): samples, days, day-equal mean return, its annual sum and the day-equal share of positive returns."""
    d = _deciled(predictions, score)
    hit = F.avg((F.col("target_return") > 0).cast("double"))
    day = d.groupBy("target_date", "decile").agg(F.avg("target_return").alias("m"), hit.alias("h"), F.count(F.lit(1)).alias("n"))
    out = day.groupBy("decile").agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("days"), F.avg("m").alias("mean_return"), F.avg("h").alias("hit_rate"))
    return out.withColumn("annual_return", F.col("mean_return") * DAYS)


def selections(predictions: DataFrame, n: int, history: DataFrame, score: str = "score") -> DataFrame:
    """The held rows with their place and the code's return before (many rows to one of history)."""
    return top_n(predictions, n, score).join(history.select("target_date", "code", "previous_return"), ["target_date", "code"], "left")


def run_top_n(predictions: DataFrame, n: int = 10, commission: float = 0.0, slippage: float = 0.0, levels: list[float] | None = None,
    simulations: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """Every table of a backtest, lazily: daily, metrics, drawdowns, benchmarks, deciles, slippage, selections, random."""
    if n < 1 or simulations < 1 or not 0 <= commission < 1 or not 0 <= slippage < 1:
        raise ValueError("n and simulations at least 1, costs in [0, 1)")
    history = checked_history(predictions)
    bad = ranked(predictions).filter(finite(F.col("target_return")).isNull())
    if bad.limit(1).count():
        raise ValueError("scored rows without a finite return")
    table = daily_table(predictions, n, commission, slippage)
    curve = table.select("target_date", F.col("top_gross").alias("gross"), F.col("top_net").alias("net"), F.col("top_equity").alias("equity"))
    metrics = compound_metrics(curve)
    return {
        "daily": table, "metrics": metrics, "drawdown_episodes": drawdown_episodes(curve), "drawdown_metrics": drawdown_metrics(curve),
        "benchmarks": benchmark_metrics(table), "deciles": decile_table(predictions),
        "slippage": slippage_sensitivity(curve, [x for x in levels or [] if x != slippage], commission), "top_vs_rest": top_vs_rest(predictions, n),
        "selections": selections(predictions, n, history),
        "random": random_baseline(random_portfolios(predictions, n, simulations, seed, commission, slippage), metrics),
    }
