"""Charts as SVG text, from small collected rows; every number is checked before anything is drawn."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from html import escape

WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM = 860, 320, 70, 20, 36, 44
COLOURS = ("#1f6feb", "#d1495b", "#2a9d8f", "#e9a13b", "#7b5ea7", "#5c6770")


def _checked(days: Sequence[dt.date], series: dict[str, Sequence[float | None]]) -> None:
    if not days or not series:
        raise ValueError("nothing to draw")
    if any(a >= b for a, b in zip(days, days[1:], strict=False)):
        raise ValueError("dates must ascend")
    for name, values in series.items():
        if len(values) != len(days):
            raise ValueError(f"{name} has {len(values)} values for {len(days)} dates")
        if any(v is not None and not math.isfinite(v) for v in values):
            raise ValueError(f"{name} holds a value that is not finite")


def ticks(low: float, high: float, count: int = 5) -> list[float]:
    """Round numbers from at or below low to at or above high."""
    if high <= low:
        low, high = low - 0.5, high + 0.5
    raw = (high - low) / count
    size = 10 ** math.floor(math.log10(raw))
    step = next(m * size for m in (1, 2, 2.5, 5, 10) if m * size >= raw)
    first = math.floor(low / step) * step
    return [round(first + k * step, 12) for k in range(int(math.ceil((high - first) / step - 1e-9)) + 1)]


def _frame(title: str, body: list[str], height: int = HEIGHT) -> str:
    head = (f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {height}" role="img" aria-label="{escape(title)}" font-family="sans-serif" '
        f'font-size="12">')
    return "\n".join([head, f'<rect width="{WIDTH}" height="{height}" fill="#ffffff"/>',
        f'<text x="{LEFT}" y="22" font-size="15" font-weight="bold">{escape(title)}</text>', *body, "</svg>"])


def line_chart(title: str, days: Sequence[dt.date], series: dict[str, Sequence[float | None]], percent: bool = False,
    marks: dict[dt.date, str] | None = None, fill: bool = False) -> str:
    """Lines over dates, broken where a value is None; marks: vertical lines with a label; fill: shade down from zero."""
    _checked(days, series)
    known = [v for values in series.values() for v in values if v is not None]
    if not known:
        raise ValueError("nothing to draw")
    scale = ticks(min(known), max(known))
    low, high = scale[0], scale[-1]
    x = lambda k: LEFT + (WIDTH - LEFT - RIGHT) * (k / max(len(days) - 1, 1))
    y = lambda v: TOP + (HEIGHT - TOP - BOTTOM) * (1 - (v - low) / (high - low))
    said = lambda v: f"{v:.1%}" if percent else f"{v:g}"
    body = []
    for v in scale:
        body += [f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{y(v):.1f}" y2="{y(v):.1f}" stroke="#e3e6ea"/>',
            f'<text x="{LEFT - 6}" y="{y(v) + 4:.1f}" text-anchor="end">{said(v)}</text>']
    for k in sorted({round(i * (len(days) - 1) / 5) for i in range(6)}):
        body.append(f'<text x="{x(k):.1f}" y="{HEIGHT - BOTTOM + 18}" text-anchor="middle">{days[k]:%Y-%m-%d}</text>')
    for n, (name, values) in enumerate(series.items()):
        colour, parts, run = COLOURS[n % len(COLOURS)], [], []
        for k, v in enumerate([*values, None]):
            if v is None:
                if run:
                    parts.append(run)
                run = []
            else:
                run.append((x(k), y(v)))
        for part in parts:
            points = " ".join(f"{a:.1f},{b:.1f}" for a, b in part)
            if fill:
                body.append(f'<polygon points="{part[0][0]:.1f},{y(min(max(0.0, low), high)):.1f} {points} '
                    f'{part[-1][0]:.1f},{y(min(max(0.0, low), high)):.1f}" fill="{colour}" fill-opacity="0.2"/>')
            body.append(f'<polyline points="{points}" fill="none" stroke="{colour}" stroke-width="1.8"/>' if len(part) > 1
                else f'<circle cx="{part[0][0]:.1f}" cy="{part[0][1]:.1f}" r="2.5" fill="{colour}"/>')
        body.append(f'<text x="{LEFT + 8 + 150 * n}" y="{HEIGHT - 8}" fill="{colour}">{escape(name)}</text>')
    for day, label in (marks or {}).items():
        k = next((i for i, d in enumerate(days) if d >= day), None)
        if k is not None:
            body += [f'<line x1="{x(k):.1f}" x2="{x(k):.1f}" y1="{TOP}" y2="{HEIGHT - BOTTOM}" stroke="#5c6770" stroke-dasharray="4 3"/>',
                f'<text x="{x(k) + 4:.1f}" y="{TOP + 12}">{escape(label)}</text>']
    return _frame(title, body)


def bar_chart(title: str, values: dict[str, float], percent: bool = False) -> str:
    """Horizontal bars, in the order given, from zero either way."""
    if not values or any(not math.isfinite(v) for v in values.values()):
        raise ValueError("bars need finite values")
    low, high = min(0.0, *values.values()), max(0.0, *values.values())
    span = (high - low) or 1.0
    x = lambda v: 220 + (WIDTH - 220 - 90) * (v - low) / span
    body = []
    for k, (name, v) in enumerate(values.items()):
        top = TOP + 24 * k
        a, b = sorted((x(0.0), x(v)))
        body += [f'<text x="212" y="{top + 14}" text-anchor="end">{escape(name[:32])}</text>',
            f'<rect x="{a:.1f}" y="{top}" width="{max(b - a, 0.5):.1f}" height="18" fill="{COLOURS[0] if v >= 0 else COLOURS[1]}"/>',
            f'<text x="{b + 5:.1f}" y="{top + 14}">{f"{v:.2%}" if percent else f"{v:.4f}"}</text>']
    return _frame(title, body, TOP + 24 * len(values) + 16)


def equity_chart(rows: list[dict], curves: dict[str, str] | None = None) -> str:
    """Equity of a backtest's daily rows (target_date and the curves' columns)."""
    curves = curves or {"top": "top_equity", "universe": "universe_equity", "bottom": "bottom_equity"}
    return line_chart("Equity", [r["target_date"] for r in rows], {name: [r[column] for r in rows] for name, column in curves.items()})


def drawdown_chart(rows: list[dict], equity: str = "top_equity", drawdown: str = "top_drawdown") -> str:
    """The drawdown curve; ValueError where it is not that of the equity."""
    peak = 1.0
    for r in rows:
        peak = max(peak, r[equity])
        if abs(r[equity] / peak - 1 - r[drawdown]) > 1e-9:
            raise ValueError(f"the drawdown of {r['target_date']} is not that of the equity")
    return line_chart("Drawdown", [r["target_date"] for r in rows], {"drawdown": [r[drawdown] for r in rows]}, percent=True, fill=True)


def slippage_chart(rows: list[dict], levels: list[float], cost: dict[float, float]) -> str:
    """Equity per slippage level from daily gross means (rows: target_date, gross; cost: multiplier by level)."""
    series = {}
    for level in levels:
        value, curve = 1.0, []
        for r in rows:
            value *= (1 + r["gross"]) * cost[level]
            curve.append(value)
        series[f"{level * 1e4:g} bp"] = curve
    return line_chart("Equity by slippage", [r["target_date"] for r in rows], series)


def rolling_ic_chart(rows: list[dict], holdout_start: dt.date | None = None) -> str:
    """Rolling 20 and 60 day rank IC, the holdout's first day marked."""
    series = {f"rank IC {n}": [r[f"rank_ic_{n}"] for r in rows] for n in (20, 60)}
    return line_chart("Rolling rank IC", [r["target_date"] for r in rows], {k: v for k, v in series.items() if any(x is not None for x in v)},
        marks={holdout_start: "holdout"} if holdout_start else None)


def objective_chart(rows: list[dict], objective: str = "selection_rank_ic", k: int = 20) -> str:
    """The first k candidates' objective."""
    return bar_chart(f"Best {objective}", {r["factor_id"]: float(r[objective]) for r in rows[:k] if r[objective] is not None})
