"""Execution filters on training samples: could a sample have been bought on its target date and sold on its end date?

context, one row per (execution_date, code): execution_open, _close, _pre_close, _board, _is_st,
_sessions_since_listing, _has_corporate_action, _suspended. Limit prices are pre_close * (1 +- ratio) rounded to
the tick: an interpretation, as the source publishes none; days with a corporate action have no known limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.limits import limit_ratio

FILTERS = {"limit_up_buy": "buy", "limit_down_sell": "sell"}
POLICIES = ("allow", "exclude", "error")
c = F.col


@dataclass(frozen=True)
class Options:
    tick: float = 0.01
    tolerance: float = 1e-6
    apply_st: bool = True

    def __post_init__(self):
        if self.tick <= 0 or self.tolerance < 0:
            raise ValueError("tick above 0, tolerance not below 0")


def _verdict(side: str, timing: str, options: Options) -> tuple[Column, Column]:
    """(why a trade is blocked, whether that is unknown) of a context row."""
    limit = limit_ratio(c("execution_board"), c("execution_date"), c("execution_sessions_since_listing"), c("execution_is_st") if options.apply_st else None)
    sign = 1 if side == "buy" else -1
    edge = F.rint(c("execution_pre_close") * (1 + sign * limit) / options.tick + 1e-9) * options.tick
    price = c(f"execution_{timing}")
    at_limit = price >= edge - options.tolerance if side == "buy" else price <= edge + options.tolerance
    suspended = F.coalesce(c("execution_suspended"), F.lit(False))
    name = "limit_up_buy" if side == "buy" else "limit_down_sell"
    waived = F.coalesce(c("execution_has_corporate_action"), F.lit(False)) | (limit.isNull() & c("execution_board").isNotNull())
    blocked = F.when(suspended, f"suspended_{side}").when(~waived & F.coalesce(at_limit, F.lit(False)), name)
    unknown = ~suspended & ~waived & (price.isNull() | c("execution_pre_close").isNull() | c("execution_board").isNull())
    return blocked, unknown


def mark_eligibility(
    dataset: DataFrame, context: DataFrame, filters: list[str], entry: str = "open", exit: str = "close", cutoff=None, missing: str = "allow",
    options: Options = Options()
) -> DataFrame:
    """dataset with eligible and reason ("buy:...;sell:..."), and per side whether it was judged, blocked or unknown.

    Only samples that end before cutoff are judged. missing: samples without a usable context are allowed,
    excluded ("missing_context"), or make statistics() raise.
    """
    if wrong := set(filters) - set(FILTERS):
        raise ValueError(f"unknown filters: {sorted(wrong)}")
    if missing not in POLICIES:
        raise ValueError(f"missing is one of {POLICIES}")
    out = dataset.withColumn("__judged", F.lit(True) if cutoff is None else c("target_end_date") < F.lit(cutoff).cast("date"))
    own = [c(f"`{x}`") for x in dataset.columns]
    for side, date, timing in (("buy", "target_date", entry), ("sell", "target_end_date", exit)):
        if not any(FILTERS[f] == side for f in filters):
            out = out.withColumns({f"{side}_blocked": F.lit(None).cast("string"), f"{side}_unknown": F.lit(False)})
            continue
        blocked, unknown = _verdict(side, timing, options)
        known = context.select(c("execution_date").alias(date), "code", blocked.alias("__blocked"), unknown.alias("__unknown"))
        out = out.join(known, [date, "code"], "left")
        lost = c("__judged") & F.coalesce(c("__unknown"), F.lit(True))
        why = F.when(c("__judged"), F.coalesce("__blocked", F.when(lost, F.lit("missing_context") if missing == "exclude" else F.lit(None))))
        out = out.withColumns({f"{side}_blocked": why, f"{side}_unknown": lost}).drop("__blocked", "__unknown")
    reason = F.concat_ws(";", *[F.concat(F.lit(f"{side}:"), c(f"{side}_blocked")) for side in ("buy", "sell")])
    return out.select(*own, reason.alias("reason"), (reason == "").alias("eligible"), c("__judged").alias("judged"),
        *[f"{s}_{k}" for s in ("buy", "sell") for k in ("blocked", "unknown")])


def statistics(marked: DataFrame, filters: list[str]) -> DataFrame:
    """filter, side, candidate_count, blocked_count, unknown_count of marked samples."""
    x = marked.filter("judged")
    rows = F.explode(
        F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(FILTERS[f]).alias("side"), c(f"{FILTERS[f]}_blocked").alias("blocked"),
        c(f"{FILTERS[f]}_unknown").alias("unknown")) for f in filters])).alias("x")
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    return x.select(rows).select("x.*").groupBy("filter", "side").agg(F.count(F.lit(1)).alias("candidate_count"),
        count(c("blocked").isNotNull()).alias("blocked_count"), count(c("unknown")).alias("unknown_count"))


def checked(marked: DataFrame) -> DataFrame:
    """marked, or ValueError if a judged sample's context is unknown (the policy "error")."""
    if n := marked.filter("buy_unknown OR sell_unknown").count():
        raise ValueError(f"{n} samples without a usable context")
    return marked


def training_rows(marked: DataFrame) -> DataFrame:
    """Samples that may be fitted; eligible must be boolean and set on every row."""
    if dict(marked.dtypes).get("eligible") != "boolean":
        raise ValueError("eligible must be a boolean column")
    if marked.filter("eligible IS NULL").limit(1).count():
        raise ValueError("eligible must not be missing")
    return marked.filter("eligible")
