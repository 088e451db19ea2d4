"""Markdown and HTML documents of collected results, and their writing to any store."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import shlex
from html import escape

from pyspark.sql import DataFrame, SparkSession

from ..sources import files


def shown(value) -> str:
    """A cell: numbers short, missing as a dash, dates without time."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{value:,.4f}" if abs(value) < 1e6 else f"{value:,.0f}"
    if isinstance(value, int):
        return f"{value:,}"
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat(" ")
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(rows: list[dict], columns: list[str] | None = None) -> str:
    """A pipe table; no rows give a line that says so."""
    if not rows:
        return "_No rows._"
    columns = columns or list(rows[0])
    lines = ["| " + " | ".join(columns) + " |", "|" + "|".join("---" for _ in columns) + "|"]
    return "\n".join(lines + ["| " + " | ".join(shown(r.get(c)) for c in columns) + " |" for r in rows])


def chunks(rows: list[dict], size: int = 50) -> list[list[dict]]:
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def slug(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")


class Document:
    """Sections of text, tables and charts, as Markdown with chart files or as one HTML page."""

    def __init__(self, title: str):
        self.title, self.sections = title, []

    def add(self, title: str, text: str = "", rows: list[dict] | None = None, columns: list[str] | None = None, chart: str | None = None) -> Document:
        self.sections.append((title, text, rows, columns, chart))
        return self

    def markdown(self) -> str:
        out = [f"# {self.title}", "", *[f"- [{t}](#{slug(t)})" for t, *_ in self.sections], ""]
        for title, text, rows, columns, chart in self.sections:
            out += [f"## {title}", ""]
            out += [text, ""] if text else []
            out += [f"![{title}]({slug(title)}.svg)", ""] if chart else []
            for part in chunks(rows) if rows else [[]] if rows is not None else []:
                out += [markdown_table(part, columns), ""]
        return "\n".join(out)

    def html(self) -> str:
        body = [f"<h1>{escape(self.title)}</h1>", "<nav><ul>", *[f'<li><a href="#{slug(t)}">{escape(t)}</a></li>' for t, *_ in self.sections], "</ul></nav>"]
        for title, text, rows, columns, chart in self.sections:
            body.append(f'<section id="{slug(title)}"><h2>{escape(title)}</h2>')
            body += [f"<p>{escape(text)}</p>"] if text else []
            body += [chart] if chart else []
            if rows is not None:
                names = columns or (list(rows[0]) if rows else [])
                head = "".join(f"<th>{escape(n)}</th>" for n in names)
                lines = "".join("<tr>" + "".join(f"<td>{escape(shown(r.get(n)))}</td>" for n in names) + "</tr>" for r in rows)
                body.append(f"<table><thead><tr>{head}</tr></thead><tbody>{lines}</tbody></table>" if rows else "<p>No rows.</p>")
            body.append("</section>")
        style = ("body{font-family:sans-serif;max-width:960px;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccd;padding:2px "
            "8px;text-align:right}svg{width:100%}")
        return (f'<!doctype html><html lang="en"><head><meta '
            f'charset="utf-8"><title>{escape(self.title)}</title><style>{style}</style></head><body>{"".join(body)}</body></html>')

    def write(self, spark: SparkSession, folder: str) -> list[str]:
        """report.md, report.html and the charts; the paths written."""
        out = {"report.md": self.markdown(), "report.html": self.html()} | {f"{slug(t)}.svg": c for t, _, _, _, c in self.sections if c}
        for name, text in out.items():
            files.write_text(spark, f"{folder}/{name}", text)
        return [f"{folder}/{name}" for name in out]


def rows_of(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """The rows of a small table; ValueError if there are more than a report can hold."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a report")
    return [r.asDict() for r in rows]


def reproduction(module: str, options: dict) -> str:
    """The command line that repeats a run."""
    words = ["python", "-m", module]
    for k, v in options.items():
        name = "--" + k.replace("_", "-")
        if v is True:
            words.append(name)
        elif v not in (None, False):
            words += [name, *(map(str, v) if isinstance(v, (list, tuple)) else [str(v)])]
    return shlex.join(words)


def audit_report(spark: SparkSession, folder: str, issues: DataFrame, tables: dict[str, DataFrame], scope: dict) -> dict:
    """summary.json, summary.md, issues and every table as CSV folders; returns the summary."""
    from ..operators import issues as frames

    status = frames.status(issues).first().asDict()
    codes = {r.issue_code: r.n for r in frames.summary(issues).orderBy("issue_code").collect()}  # one row per code
    summary = {**status, **scope, "issue_codes": codes, "finished_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")}
    files.write_text(spark, f"{folder}/summary.json", json.dumps(summary, default=str, indent=1, sort_keys=True))
    doc = Document("Audit").add("Summary", rows=[{"item": k, "value": v if not isinstance(v, dict) else len(v)} for k, v in summary.items()]).add(
        "Issues by code", rows=[{"code": k, "issues": n} for k, n in codes.items()])
    files.write_text(spark, f"{folder}/summary.md", doc.markdown())
    for name, df in {"issues": issues, **tables}.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")
    return summary


def backtest_report(tables: dict[str, DataFrame], top: int) -> Document:
    """A backtest's document from run_top_n()'s tables."""
    from . import charts

    daily = sorted(rows_of(tables["daily"]), key=lambda r: r["target_date"])
    doc = Document(f"Top {top} backtest").add("Metrics", rows=rows_of(tables["metrics"])).add("Equity",
        chart=charts.equity_chart(daily)).add("Drawdown", chart=charts.drawdown_chart(daily), rows=rows_of(tables["drawdown_metrics"]))
    doc.add("Drawdown episodes", rows=rows_of(tables["drawdown_episodes"])).add("Benchmarks",
        rows=rows_of(tables["benchmarks"])).add("Random baseline", rows=rows_of(tables["random"]))
    doc.add("Deciles", rows=sorted(rows_of(tables["deciles"]), key=lambda r: r["decile"])).add("Top against the rest",
        rows=rows_of(tables["top_vs_rest"])).add("Slippage", rows=rows_of(tables["slippage"]))
    return doc.add("Selections", rows=sorted(rows_of(tables["selections"]), key=lambda r: (r["target_date"], r["place"])),
        columns=["target_date", "place", "code", "score", "target_return", "previous_return"])


def search_report(result, rolling: list[dict] | None = None, holdout_start=None, command: str = "") -> Document:
    """A search's document: leaderboard, objective, rolling IC of the best, history, errors and how to repeat it."""
    from . import charts

    shown_columns = [c for c in ("factor_id", "expression", "nodes", "direction", "selection_rank_ic", "selection_rank_icir", "holdout_rank_ic",
        "fitness", "eligible") if any(c in r for r in result.rows)]
    doc = Document("Expression search").add("Leaderboard", rows=result.rows[:100], columns=shown_columns)
    if any(r.get("selection_rank_ic") is not None for r in result.rows):
        doc.add("Objective", chart=charts.objective_chart(result.rows))
    if rolling:
        doc.add("Rolling IC of the best", chart=charts.rolling_ic_chart(rolling, holdout_start))
    if result.history:
        doc.add("Generations", rows=result.history)
    doc.add("Errors", rows=[{"factor_id": k, "error": v} for k, v in result.errors.items()])
    return doc.add("Repeat", text=command) if command else doc
