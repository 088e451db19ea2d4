"""Forward targets, labels, information coefficients and model metrics."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dsl import average_rank
from ..functions.scalars import finite, ratio


def forward_targets(daily: DataFrame, kind: str) -> DataFrame:
    """feature_date, target_date, target_end_date, target_return by rows of each code: inday, close or open."""
    w = Window.partitionBy("code").orderBy("trade_date")
    ahead = lambda c, n: F.lead(c, n).over(w)
    if kind == "inday":
        end, value = ahead("trade_date", 1), ratio(ahead("close", 1), ahead("open", 1)) - 1
    else:
        end, value = ahead("trade_date", 2), ratio(ahead(kind, 2), ahead(kind, 1)) - 1
    out = daily.select("*", F.col("trade_date").alias("feature_date"), ahead("trade_date", 1).alias("target_date"), end.alias("target_end_date"),
        value.alias("target_return"))
    return out.filter("target_end_date IS NOT NULL AND target_return IS NOT NULL")


RESERVED = {"trade_date", "feature_date", "target_date", "target_end_date", "code", "target_return", "label", "eligible", "reason"}


def report_returns(daily: DataFrame) -> DataFrame:
    """daily with the day's close-to-close and open-to-close returns and the next close over this one, by rows of each code."""
    w = Window.partitionBy("code").orderBy("trade_date")
    c, o = F.col("close"), F.col("open")
    return daily.withColumns({
        "previous_close_to_close_return": ratio(c, F.lag("close").over(w)) - 1, "previous_open_to_close_return": ratio(c, o) - 1,
        "target_close_to_previous_close_return": ratio(F.lead("close").over(w), c) - 1,
    })


def direction_dataset(features: DataFrame, names: list[str], kind: str = "inday", threshold: float = 0.005) -> DataFrame:
    """feature_date, target dates, code, the named features, report returns, target_return and label of rows with a finite target."""
    if reserved := set(names) & RESERVED:
        raise ValueError(f"reserved names: {sorted(reserved)}")
    if missing := set(names) - set(features.columns):
        raise ValueError(f"no such features: {sorted(missing)}")
    if not 0 <= threshold < float("inf"):
        raise ValueError("the threshold is a finite return, not below 0")
    out = forward_targets(report_returns(features), kind)
    reports = ["previous_close_to_close_return", "previous_open_to_close_return", "target_close_to_previous_close_return"]
    return out.select("feature_date", "target_date", "target_end_date", "code", *names, *reports, "target_return",
        direction_label(F.col("target_return"), threshold).alias("label"))


def direction_label(value: Column, threshold: float = 0.005) -> Column:
    """1 if value exceeds threshold by more than 8 ulp, else 0."""
    return F.when(finite(value) - threshold > 8 * sys.float_info.epsilon * max(1.0, abs(threshold)), 1).otherwise(0).cast("byte")


def correlation(x: Column, y: Column) -> Column:
    """Pearson over complete pairs; NULL below two pairs or without variance."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.when(F.count(a) >= 2, ratio(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))))


def daily_ic(predictions: DataFrame, score: str, target: str = "target_return", date: str = "target_date") -> DataFrame:
    """samples, ic and rank_ic per date over complete pairs."""
    pairs = predictions.select(date, finite(F.col(score)).alias("s"), finite(F.col(target)).alias("t")).filter("s IS NOT NULL AND t IS NOT NULL")
    pairs = pairs.withColumn("rs", average_rank(F.col("s"), date)).withColumn("rt", average_rank(F.col("t"), date))
    return pairs.groupBy(date).agg(F.count(F.lit(1)).alias("samples"), correlation(F.col("s"), F.col("t")).alias("ic"),
        correlation(F.col("rs"), F.col("rt")).alias("rank_ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    won = lambda c: F.avg(F.when(F.col(c).isNotNull(), F.when(F.col(c) > 1e-12, 1.0).otherwise(0.0)))
    return ic.agg(
        F.count(F.lit(1)).alias("dates"), F.count("ic").alias("ic_dates"), F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"),
        ratio(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), won("ic").alias("ic_win_rate"),
    )


def period_summary(dataset: DataFrame) -> DataFrame:
    """One row: samples, different dates and codes, first and last date."""
    return dataset.agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("target_date").alias("dates"), F.countDistinct("code").alias("codes"),
        F.min("target_date").alias("first_date"), F.max("target_date").alias("last_date"))


def period_ic(ic: DataFrame, total_samples: DataFrame, min_daily_samples: int = 2) -> DataFrame:
    """Coverage, means, ratios of means to deviations and positive shares of a period, dates in all, valid and thin; thin dates count as missing."""
    enough = F.col("samples") >= min_daily_samples
    x = ic.withColumn("thin", ~enough).withColumns({c: F.when(enough, F.col(c)) for c in ("ic", "rank_ic")})
    out = x.agg(
        F.count(F.lit(1)).alias("dates"), F.count("rank_ic").alias("rank_ic_dates"), F.sum(F.col("thin").cast("long")).alias("thin_dates"),
        F.sum("samples").alias("samples"), F.count("ic").alias("ic_dates"), F.avg("samples").alias("mean_cross_section"),
        F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"),
        ratio(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_icir"),
        F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("positive_ic_ratio"),
        F.avg(F.when(F.col("rank_ic").isNotNull(), (F.col("rank_ic") > 0).cast("double"))).alias("positive_rank_ic_ratio"),
    )
    return out.crossJoin(F.broadcast(total_samples)).withColumn("coverage", ratio(F.col("samples"), F.col("total"))).drop("total")


def auc(scored: DataFrame, score: str, label: str, ranges: int = 256) -> DataFrame:
    """Tie-aware area under the curve, from counts per different score, scores dealt into ranges of about equal numbers of different scores.

    Running counts are summed per range first, so no task orders all scores, however concentrated they are.
    """
    by_score = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    edges = by_score.agg(F.percentile_approx("s", [k / ranges for k in range(1, ranges)], 10_000).alias("edges"))
    by_score = by_score.crossJoin(F.broadcast(edges)).withColumn("range",
        F.size(F.filter("edges", lambda e: e < F.col("s")))).drop("edges").withColumn("neg", F.col("n") - F.col("pos"))
    totals = by_score.groupBy("range").agg(F.sum("neg").alias("neg_in"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("neg_in").over(ahead), F.lit(0)).alias("neg_before"))
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    x = by_score.join(totals, "range").withColumn("below", F.col("neg_before") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return x.agg(ratio(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def classification(scored: DataFrame, probability: str, label: str) -> DataFrame:
    p, y = F.col(probability), F.col(label)
    hit = ((p >= 0.5).cast("int") == y).cast("double")
    clipped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), ((F.avg(F.when(y == 1, hit)) + F.avg(F.when(y == 0, hit))) / 2).alias("balanced_accuracy"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))).alias("log_loss"),
    )


def regression(scored: DataFrame, predicted: str, actual: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    n = F.count(F.lit(1))
    return scored.agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - ratio(F.sum(e * e), F.var_pop(actual) * n)).alias("r2"),
        F.avg(((F.col(predicted) > 0) == (F.col(actual) > 0)).cast("double")).alias("direction_accuracy"),
        correlation(F.col(predicted), F.col(actual)).alias("ic"),
    )


def accuracy_trend(scored: DataFrame, probability: str, label: str, date: str = "target_date") -> DataFrame:
    by_day = scored.groupBy(date).agg(F.count(F.lit(1)).alias("samples"),
        F.avg(((F.col(probability) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))
    w = Window.orderBy(date)
    return by_day.select("*", (F.col("accuracy") - F.lag("accuracy").over(w)).alias("accuracy_change"),
        F.avg("accuracy").over(w.rowsBetween(-19, 0)).alias("rolling_accuracy"))


def rolling_ic(ic: DataFrame, date: str = "target_date") -> DataFrame:
    """Means of ic and rank_ic over 20 dates (at least 5) and 60 dates (at least 20)."""
    out = ic
    for n, least in ((20, 5), (60, 20)):
        w = Window.orderBy(date).rowsBetween(1 - n, 0)
        for c in ("ic", "rank_ic"):
            out = out.withColumn(f"{c}_{n}", F.when(F.count(c).over(w) >= least, F.avg(c).over(w)))
    return out
