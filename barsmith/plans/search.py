"""Queries of expression search over a fixed set of candidates, and of the genetic loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsl
from ..operators import search
from . import sql
from .base import SPLIT, daily, query

c = F.col
GRID = search.grid(["close", "volume"],
    [search.Stage((("returns", {"periods": (1, 3)}), ("ts_mean", {"window": (3,)}))), search.Stage((None, ("cs_rank", {})))])
#: Equal to one of the grid: by values, by daily ranks, turned around.
SAME = [dsl.parse(x) for x in ("ts_mean(close, window=3) + 0", "ts_mean(close, window=3) * 2", "negative(returns(volume, periods=1))", "close - open",
    "open - close")]
_AT = f"DATE '{SPLIT}'"


def context(s, d) -> search.Context:
    return search.make_context(daily(s, d), SPLIT)


def _long(nodes: list[dsl.Node], where: str) -> list[str]:
    union = " UNION ALL ".join(f"SELECT '{n.identity}' AS factor_id, code, trade_date, target_date, target_return AS t, {n.identity} AS s FROM valued "
        f"WHERE {where}" for n in nodes)
    return [
        sql.TICKS, sql.DAILY_BARS, *sql.target_ctes("inday"), *sql.expression_ctes("targets", {n.identity: n for n in nodes}), f"al AS ({union})",
        "lg AS (SELECT * FROM al WHERE s IS NOT NULL AND t IS NOT NULL)",
        "rk AS (SELECT *, rank() OVER (PARTITION BY factor_id, target_date ORDER BY s) + (count(*) OVER (PARTITION BY factor_id, target_date, "
        "s) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY factor_id, target_date ORDER BY t) + (count(*) OVER (PARTITION BY factor_id, target_date, "
        "t) - 1) / 2.0 AS rt, count(*) OVER (PARTITION BY factor_id, target_date) AS n FROM lg)",
        f"di AS (SELECT factor_id, target_date, count(*) AS samples, {sql.CORR.format('s', 't')} AS ic, {sql.CORR.format('rs', 'rt')} AS rank_ic FROM "
        f"rk GROUP BY 1, 2)",
        """me AS (SELECT a.factor_id, a.rows, coalesce(b.valid, 0) AS valid, b.ic, b.rank_ic, b.ic_std, b.rank_ic_std, b.rank_ic_dates FROM (SELECT
        factor_id, count(*) AS rows FROM al GROUP BY 1) a
          LEFT JOIN (SELECT factor_id, sum(samples)::BIGINT AS valid, avg(CASE WHEN samples >= 2 THEN ic END) AS ic, avg(CASE WHEN samples >= 2 THEN
          rank_ic END) AS rank_ic, stddev_samp(CASE WHEN samples >= 2 THEN ic END) AS ic_std, stddev_samp(CASE WHEN samples >= 2 THEN rank_ic END) AS
          rank_ic_std, count(CASE WHEN samples >= 2 THEN rank_ic END) AS rank_ic_dates FROM di GROUP BY 1) b ON b.factor_id = a.factor_id)""",
        "bd AS (SELECT *, CASE WHEN rank_ic < 0 THEN -1 ELSE 1 END AS direction, valid / rows::DOUBLE AS coverage FROM me)",
    ]


SELECTED = _long(GRID, f"target_date < {_AT}")
BOARD = ("SELECT factor_id, direction, coverage AS selection_coverage, rank_ic_dates AS selection_dates, ic * direction AS selection_ic, "
    "rank_ic * direction AS selection_rank_ic, rank_ic / nullif(rank_ic_std, 0) * direction AS selection_rank_icir, "
    "rank_ic_std AS selection_rank_ic_std, coalesce(rank_ic IS NOT NULL AND coverage >= 0.7 AND rank_ic_dates >= 2, false) AS eligible FROM bd")
_NUMBERS = "selection_coverage selection_ic selection_rank_ic selection_rank_icir selection_rank_ic_std"
query("search_scores", sql.rounded(SELECTED, "SELECT factor_id, target_date, samples, ic, rank_ic FROM di", "ic rank_ic"))(
    lambda s, d: search.scores(context(s, d), GRID).filter("samples > 0").select("factor_id", "target_date", "samples", "ic", "rank_ic"))
query("search_leaderboard_grid", sql.rounded(SELECTED, BOARD, _NUMBERS))(lambda s, d: search.leaderboard(search.metrics(search.scores(context(s, d), GRID))))
_PLACED = f"bo AS ({BOARD})"
_TOP = ("tp AS (SELECT factor_id, direction, selection_rank_ic, row_number() OVER (ORDER BY selection_rank_ic DESC NULLS LAST, "
    "factor_id) AS place FROM bo WHERE eligible QUALIFY place <= 3)")
_HELD = [x.replace("al AS (", "ah AS (").replace("FROM al", "FROM ah").replace("lg AS (", "lh AS (").replace("FROM lg", "FROM lh").replace("rk AS (",
    "rh AS (").replace("FROM rk", "FROM rh").replace("di AS (", "dh AS (").replace(f"target_date < {_AT}", f"target_date >= {_AT}") for x in SELECTED[-6:-2]]


def _frozen(s, d) -> DataFrame:
    """A whole grid search: the holdout is scored for the three best only."""
    result = search.grid_search(context(s, d), GRID, holdout_top_k=3)
    rows = [(r["factor_id"], r["selection_rank_ic"], r["holdout_rank_ic"]) for r in result.rows if "holdout_rank_ic" in r]
    return s.createDataFrame(rows, "factor_id string, selection_rank_ic double, holdout_rank_ic double")


query("search_holdout_topk",
    sql.rounded([*SELECTED, _PLACED, _TOP, *_HELD],
    "SELECT t.factor_id, any_value(t.selection_rank_ic) AS selection_rank_ic, avg(CASE WHEN samples >= 2 THEN h.rank_ic END) * any_value(t.direction) "
    "AS holdout_rank_ic FROM tp t JOIN dh h ON h.factor_id = t.factor_id GROUP BY 1", "selection_rank_ic holdout_rank_ic"))(_frozen)


def _detail(s, d) -> DataFrame:
    ctx = context(s, d)
    return search.daily_detail(ctx, search.grid_search(ctx, GRID, holdout_top_k=0), 2).filter("samples > 0")


query("search_daily_detail", sql.rounded([*SELECTED, _PLACED, _TOP, *_HELD], """SELECT place::INT AS selection_rank, t.factor_id, period,
    target_date, samples, ic * direction AS ic, rank_ic * direction AS rank_ic FROM tp t JOIN (SELECT 'selection' AS period, * FROM di UNION ALL
    SELECT 'holdout', * FROM dh) x ON x.factor_id = t.factor_id WHERE place <= 2""", "ic rank_ic"))(_detail)


def _best(s, d) -> DataFrame:
    ctx = context(s, d)
    result = search.grid_search(ctx, GRID, holdout_top_k=0)
    return result.materialize(ctx.frame, oriented=True).select("code", "trade_date", F.col(result.best.identity).alias("best"))


_VALUE = "CASE (SELECT factor_id FROM tp WHERE place = 1) " + " ".join(f"WHEN '{n.identity}' THEN {n.identity}" for n in GRID) + " END"
query("search_materialize_best",
    sql.rounded([*SELECTED, _PLACED, _TOP], f"SELECT code, trade_date, {_VALUE} * (SELECT direction FROM tp WHERE place = 1) AS best FROM valued",
    "best"))(_best)
EQUAL = [*GRID, *SAME]
_SHAPES = ", ".join(f"('{n.identity}', {n.node_count}, {n.depth})" for n in EQUAL)


def _kept(s, d) -> DataFrame:
    """Ids that stay when candidates of equal values or daily ranks count once, turned by their direction."""
    ctx = context(s, d)
    board = {r.factor_id: r for r in search.leaderboard(search.metrics(search.scores(ctx, EQUAL))).collect()}
    by_id = {n.identity: n for n in EQUAL}
    rows = []
    for r in search.fingerprints(ctx, EQUAL).collect():
        side = "up" if board[r.factor_id].direction > 0 else "down"
        n = by_id[r.factor_id]
        rows.append({"factor_id": r.factor_id, "nodes": n.node_count, "depth": n.depth, "eligible": True, "fitness": None,
            "value_key": r[f"value_{side}"], "rank_key": r[f"rank_{side}"]})
    return s.createDataFrame([(r["factor_id"],) for r in search.without_equals(rows)], "factor_id string")


query("search_equivalence_dedup", sql.rounded([
    *_long(EQUAL, f"target_date < {_AT}"), f"shp(factor_id, nodes, depth) AS (VALUES {_SHAPES})",
    "fp AS (SELECT r.factor_id, md5(string_agg(code || trade_date::VARCHAR || CASE WHEN direction > 0 THEN rs ELSE n + 1 - rs END::VARCHAR, "
    "',' ORDER BY trade_date, code)) AS key FROM rk r JOIN bd ON bd.factor_id = r.factor_id GROUP BY 1)"],
    "SELECT arg_min(fp.factor_id, (nodes, depth, fp.factor_id)) AS factor_id FROM fp JOIN shp ON shp.factor_id = fp.factor_id GROUP BY key"))(_kept)


def _model_scored(s, d) -> DataFrame:
    """The best candidate as the only feature of a ridge regression from the holdout on."""
    result = search.grid_search(context(s, d), GRID, holdout_top_k=0, model_top_k=1, model=search.model_evaluator("logistic_regression", "regression"))
    return s.createDataFrame([(r["factor_id"], r["model_n"], r["model_mae"]) for r in result.rows if "model_mae" in r], "factor_id string, n long, mae double")


query("search_model_topk",
    sql.rounded([*SELECTED, _PLACED, _TOP, f"bs AS (SELECT target_date, target_end_date, target_return, coalesce({_VALUE}, -10000.0) AS x FROM valued)",
      f"tr AS (SELECT count(*) AS n, avg(target_return) AS my, avg(x) AS mx, stddev_pop(x) AS sx, covar_pop(x, target_return) / nullif(stddev_pop(x), "
      f"0) AS cv FROM bs WHERE target_end_date < {_AT})"],
      f"SELECT (SELECT factor_id FROM tp WHERE place = 1) AS factor_id, count(*) AS n, avg(abs(my + n * cv / (n + 1.0) * (x - mx) / sx - "
      f"target_return)) AS mae FROM bs, tr WHERE target_date >= {_AT}", "mae"))(_model_scored)


def _genetic(s, d) -> DataFrame:
    """A small seeded run of the loop: every candidate it has judged, equal ones once."""
    config = search.GeneticConfig(sources=("open", "high", "low", "close", "volume"), population=24, generations=3, max_lookback=20, min_coverage=0.1,
        target_coverage=0.5)
    result = search.genetic_search(context(s, d), config)
    rows = [(r["factor_id"], r["expression"], r["nodes"], r["depth"], r["direction"], r["selection_rank_ic"], r["fitness"], r["eligible"],
        r["origin"], r["generation"]) for r in result.rows]
    return s.createDataFrame(rows, "factor_id string, expression string, nodes int, depth int, direction int, selection_rank_ic double, "
        "fitness double, eligible boolean, origin string, generation int")


query("search_genetic")(_genetic)
