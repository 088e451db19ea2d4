"""Commands: sync a store, audit it, test a factor, run an experiment with its backtest, search expressions.

python -m barsmith.cli sync --root S --landed L
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import backtest, models, research, search
from .operators.daily_check import DailyCheck
from .operators.store import DailyStore, filter_summary
from .reporting import documents
from .sources import base

#: A small demonstration grid, and the settings of a genetic demonstration.
DEMO_SOURCES = ["close", "volume", "high", "low", "open"]
DEMO_STAGES = [search.Stage((None, ("delta", {"periods": (1, 5)}))),
    search.Stage((None, ("ts_mean", {"window": (5, 20)}), ("ts_stddev", {"window": (5, 20)}))), search.Stage((None, ("cs_rank", {})))]
DEMO_GENETIC = {"sources": tuple(DEMO_SOURCES), "population": 96, "generations": 8, "max_evaluations": 500, "length_penalty": 0.001}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barsmith", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sync")
    s.add_argument("--root", required=True)
    s.add_argument("--landed", required=True)
    s.add_argument("--mode", choices=["auto", "full", "rebuild"], default="auto")
    s.add_argument("--verify-hash", action="store_true")
    s.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("check")
    c.add_argument("--root", required=True)
    c.add_argument("--report", required=True)
    c.add_argument("--start")
    c.add_argument("--end")
    c.add_argument("--codes", nargs="*", default=[])
    for name in ("factor", "experiment", "search"):
        q = sub.add_parser(name)
        q.add_argument("--source", choices=base.available_sources(), default=base.DEFAULT_SOURCE)
        q.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="an option of the source")
        q.add_argument("--start", required=True)
        q.add_argument("--end", required=True)
        q.add_argument("--codes", nargs="*")
        q.add_argument("--symbol-limit", type=int, default=20)
        if name != "factor":
            q.add_argument("--report", required=True)
            q.add_argument("--holdout", required=True, help="first date that is predicted, or held out")
        if name == "experiment":
            q.add_argument("--factors", nargs="*", default=["return_1d"])
            q.add_argument("--expression", action="append", default=[])
            q.add_argument("--model", choices=sorted(models.MODELS), default="simple_decision_tree")
            q.add_argument("--task", choices=models.TASKS, default="classification")
            q.add_argument("--mode", choices=["rolling", "single"], default="rolling")
            q.add_argument("--top", type=int, default=10)
        if name == "search":
            q.add_argument("--genetic", action="store_true")
            q.add_argument("--holdout-top-k", type=int, default=20)
    return p


def _loaded(spark: SparkSession, args) -> tuple[base.MarketDataSource, DataFrame]:
    options = dict(o.split("=", 1) for o in args.option)
    source = base.open_source(spark, args.source, **options)
    codes = args.codes or source.list_symbols(args.symbol_limit)
    if not codes:
        raise ValueError("the source has no codes")
    return source, source.load_bars(codes, args.start, args.end)


def quick_factor(source: base.MarketDataSource, bars: DataFrame) -> DataFrame:
    """trade_date, code, return_1d: the quickest look at a source."""
    return source.build_features(bars, ["return_1d"]).select("trade_date", "code", "return_1d").orderBy("trade_date", "code")


def run_experiment(spark: SparkSession, args) -> list[str]:
    source, bars = _loaded(spark, args)
    expressions = {f"x{k}": e for k, e in enumerate(args.expression)}
    names = [*args.factors, *expressions]
    features = source.build_features(bars, args.factors, expressions)
    dataset = research.direction_dataset(features, names).withColumn("label", F.col("label").cast("int"))
    predicted, weights = models.Experiment(names, args.model, args.task, args.holdout, args.mode).run(dataset)
    tables = backtest.run_top_n(predicted, args.top)
    doc = documents.backtest_report(tables, args.top)
    doc.add("Importances", rows=[{"feature": k, "importance": v} for k, v in (weights or {}).items()])
    return doc.add("Repeat", text=documents.reproduction("barsmith.cli", vars(args))).write(spark, args.report)


def run_search(spark: SparkSession, args) -> list[str]:
    source, bars = _loaded(spark, args)
    daily = source.build_features(bars, ["return_1d"])
    context = search.make_context(daily, args.holdout)
    if args.genetic:
        result = search.genetic_search(context, search.GeneticConfig(**DEMO_GENETIC), args.holdout_top_k)
    else:
        result = search.grid_search(context, search.grid(DEMO_SOURCES, DEMO_STAGES), holdout_top_k=args.holdout_top_k)
    rolling = None
    if any(r["eligible"] for r in result.rows):
        ic = search.daily_detail(context, result, 1)
        rolling = sorted(documents.rows_of(research.rolling_ic(ic.select("target_date", "samples", "ic", "rank_ic"))), key=lambda r: r["target_date"])
    return documents.search_report(result, rolling, None, documents.reproduction("barsmith.cli", vars(args))).write(spark, args.report)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: an audit found errors, or a store was locked."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "sync":
        report = DailyStore(spark, args.root, args.landed).sync(args.mode, args.verify_hash, args.dry_run)
        print(json.dumps({"status": report.status, "message": report.message, "pending": report.pending}))
        print("\n".join(filter_summary(report.filtered)) if report.filtered else "")
        return int(report.status == "skipped_locked")
    if args.command == "check":
        store = DailyStore(spark, args.root, "")
        check = DailyCheck(store.bars(suspended=True), store.table("instruments"), store.table("trading_calendar"), store.table("corporate_actions"),
            codes=tuple(args.codes), start=args.start, end=args.end)
        summary = documents.audit_report(spark, args.report, check.run(), {}, {"root": args.root, "start": args.start, "end": args.end})
        print(json.dumps(summary, default=str))
        return int(summary["status"] == "failed")
    if args.command == "factor":
        quick_factor(*_loaded(spark, args)).show(100, False)
        return 0
    print("\n".join((run_experiment if args.command == "experiment" else run_search)(spark, args)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
