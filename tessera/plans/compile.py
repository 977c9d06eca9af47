"""Many formulas into one plan of native columns.

The pool of formulas is one graph: equal subtrees (by canonical text) are one
column.  Columns are made in phases that alternate between series windows
(partitioned by key) and cross-section windows (partitioned by date), so the
number of exchanges is the depth of alternation, not the number of formulas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import INF, correlation, finite, guarded, null_nan, safe_div
from tessera.functions.groups import map_groups, numbers
from tessera.plans.formula import CROSS, ELEMENT, SERIES, Node, canonical, parse, render


def schedule(roots: Iterable[Node]) -> tuple[dict[Node, str], list[tuple[str, list[list[Node]]]]]:
    """Column names of all inner nodes, and the phases with their levels.

    Even phases are series phases, odd ones cross-section phases; within a phase
    a level only needs columns of earlier levels.
    """
    names: dict[Node, str] = {}
    phase: dict[Node, int] = {}
    level: dict[Node, int] = {}

    def place(n: Node) -> None:
        if n in phase:
            return
        for c in n.children:
            place(c)
        at = max((phase[c] for c in n.children), default=0)
        if n.kind == SERIES and at % 2 or n.kind == CROSS and at % 2 == 0:
            at += 1
        phase[n] = at
        level[n] = max((level[c] + 1 for c in n.children if phase[c] == at), default=0)
        if n.children:
            names[n] = f"n{len(names)}"

    for root in roots:
        place(canonical(root))
    plan = []
    for p in range(max(phase.values(), default=0) + 1):
        nodes = [n for n in names if phase[n] == p]
        levels = sorted({level[n] for n in nodes})
        plan.append((CROSS if p % 2 else SERIES, [[n for n in nodes if level[n] == x] for x in levels]))
    return names, plan


def late(names: dict[Node, str], phases: int) -> list[tuple[str, list[list[Node]], list[Node]]]:
    """Passes (kind, levels, Arrow nodes) of so many phases, each node as late as it can be.

    What is carried through an exchange is then fields, and not what is made of
    them; an element function of several columns comes with the last of these, as
    it is one column.  Each phase ends with element functions alone, which need no
    exchange; before them a pass has windows first, then what goes through Arrow,
    and only what windows of the same phase are made of goes through Arrow earlier.
    """
    users: dict[str, list[str]] = {name: [] for name in names.values()}
    for n, name in names.items():
        for c in n.children:
            if c in names:
                users[names[c]].append(name)
    phase: dict[str, int] = {}
    for n, name in reversed(names.items()):  # children are named before their parents
        at = min((phase[u] for u in users[name]), default=phases - 1)
        phase[name] = at - 1 if n.kind == SERIES and at % 2 or n.kind == CROSS and at % 2 == 0 else at
    for n, name in names.items():
        if n.kind == ELEMENT and len({c for c in n.children if c.number is None}) > 1:
            phase[name] = max((phase[names[c]] for c in n.children if c in names), default=phase[name] - phase[name] % 2)
    passes = []
    for p in range(phases):
        left = {name: n for n, name in names.items() if phase[name] == p}
        made: list[tuple[str, list[list[Node]], list[Node]]] = []  # from the last to the first

        def take(wanted: Callable[[Node], bool], left: dict[str, Node] = left) -> list[Node]:
            found = [name for name, n in left.items() if wanted(n) and not any(u in left for u in users[name])]
            return [left.pop(name) for name in found]

        while left or not made:
            ending, levels = not made, []
            arrow = [] if ending else take(lambda n: n.label in ARROW)
            while level := take(lambda n, ending=ending: n.kind == ELEMENT or not ending and n.label not in ARROW):
                levels.insert(0, level)
            made.append((CROSS if p % 2 else SERIES, levels, arrow))
        passes += made[::-1]
    return passes


def _value(n: Node, names: dict[Node, str]) -> Column:
    if n.number is not None:
        return F.lit(n.number)
    if not n.children:
        return F.col(n.label[1:])
    c = F.col(names[n])
    return c


def _number(n: Node, names: dict[Node, str]) -> Column:
    """As a number: conditions count as 0 and 1."""
    v = _value(n, names)
    return v.cast("double") if n.is_condition else v


def _element(n: Node, names: dict[Node, str]) -> Column:
    x = [_number(c, names) for c in n.children]
    match n.label:
        case "+":
            return null_nan(x[0] + x[1])
        case "-":
            return null_nan(x[0] - x[1])
        case "*":
            return null_nan(x[0] * x[1])
        case "/":
            return safe_div(x[0], x[1])
        case "neg":
            return -x[0]
        case ">":
            return x[0] > x[1]
        case "<":
            return x[0] < x[1]
        case ">=":
            return x[0] >= x[1]
        case "<=":
            return x[0] <= x[1]
        case "ABS":
            return F.abs(x[0])
        case "SIGN":
            return F.signum(x[0])
        case "LOG":
            return F.when(x[0] > 0, F.ln(x[0]))
        case "SQRT":
            return F.when(x[0] >= 0, F.sqrt(x[0]))
        case "POWER":
            return null_nan(guarded(F.pow, *x))
        case "BOUND":
            return F.when(x[0].isNotNull(), F.least(F.greatest(x[0], x[1]), x[2]))
        case "IF":
            c = _value(n.children[0], names)
            return F.when(c, x[1]).when(~c, x[2])
        case "MIN":
            return guarded(F.least, *x)
        case "MAX":
            return guarded(F.greatest, *x)
    raise AssertionError(n.label)


def _series(n: Node, names: dict[Node, str], key: str, date: str) -> Column:
    w = int(n.children[-1].number)
    raw = _number(n.children[0], names)
    x = finite(raw)
    ordered = Window.partitionBy(key).orderBy(date)
    frame = ordered.rowsBetween(-(w - 1), 0)
    full = F.count(x).over(frame) == w
    match n.label:
        case "TS_MEAN":
            return F.when(full, F.avg(x).over(frame))
        case "TS_STD":
            return F.when(full, F.stddev_samp(x).over(frame))
        case "TS_MAX":
            return F.when(full, F.max(x).over(frame))
        case "TS_MIN":
            return F.when(full, F.min(x).over(frame))
        case "TS_SUM" | "COUNT":
            return F.when(full, F.sum(x).over(frame))
        case "TS_DELTA":
            return null_nan(raw - F.lag(raw, w).over(ordered))
        case "DELAY":
            return F.lag(raw, w).over(ordered)
        case "TS_CORR" | "TS_COV":
            y = finite(_number(n.children[1], names))
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
            full = F.count(x).over(frame) == w
            cov = F.covar_samp(x, y).over(frame)
            if n.label == "TS_COV":
                return F.when(full, cov)
            low = F.min(x).over(frame) < F.max(x).over(frame), F.min(y).over(frame) < F.max(y).over(frame)
            r = correlation(cov, F.stddev_samp(x).over(frame), F.stddev_samp(y).over(frame))
            return F.when(full & low[0] & low[1], r)
    raise AssertionError(n.label)


def _cross(n: Node, names: dict[Node, str], date: str) -> Column:
    day = Window.partitionBy(date)
    x = finite(_number(n.children[0], names))
    if n.label == "CS_DEMEAN":
        return x - F.avg(x).over(day)
    spread = F.stddev_samp(x).over(day)
    return F.when(spread > 0, (x - F.avg(x).over(day)) / spread)


#: Series functions that Spark has no moving form of; in Arrow they are numpy over a sliding view.
MOVING = {"EMA", "TS_RANK", "TS_ARGMAX", "TS_ARGMIN", "TS_PRODUCT", "TS_DECAY_LINEAR"}
ARROW = MOVING | {"RANK"}
CELLS = 1 << 20  # entries of a sliding view that are worked on at once


def _moved(label: str, x: np.ndarray, w: int) -> np.ndarray:
    """One moving function over a series; missing where the window isn't full of finite values."""
    out = np.full(len(x), np.nan)
    if label == "EMA":
        return pd.Series(np.where(np.isfinite(x), x, np.nan)).ewm(span=w, adjust=True, ignore_na=False, min_periods=w).mean().to_numpy()
    if len(x) < w:
        return out
    there = np.isfinite(x)
    upto = np.concatenate([[0], np.cumsum(there)])
    full = np.flatnonzero(upto[w:] - upto[:-w] == w)  # numbers of windows
    view = np.lib.stride_tricks.sliding_window_view(np.where(there, x, 0.0), w)
    for begin in range(0, len(full), max(1, CELLS // w)):
        at = full[begin : begin + max(1, CELLS // w)]
        part = view[at]
        match label:
            case "TS_RANK":
                last = part[:, -1:]
                made = ((part < last).sum(axis=1) + ((part == last).sum(axis=1) + 1) / 2.0) / w
            case "TS_ARGMAX":
                made = (w - 1 - part.argmax(axis=1)).astype(float)
            case "TS_ARGMIN":
                made = (w - 1 - part.argmin(axis=1)).astype(float)
            case "TS_PRODUCT":
                made = part.prod(axis=1)
            case _:
                made = part @ np.arange(1.0, w + 1) / (w * (w + 1) / 2)
        out[at + w - 1] = made
    return out


def _moving(df: DataFrame, nodes: list[Node], names: dict[Node, str], key: str, date: str) -> DataFrame:
    """Columns of moving functions: one key's series at a time, all of a level in one pass.

    A key holds one row for each date; its columns go through Arrow as they are,
    so ``df`` should only hold those that are still needed.
    """
    sources: dict[str, str] = {}
    jobs = []
    for n in nodes:
        text = render(n.children[0])
        if text not in sources:
            sources[text] = f"__x{len(sources)}"
            df = df.withColumn(sources[text], finite(_number(n.children[0], names)))
        jobs.append((names[n], n.label, sources[text], int(n.children[-1].number)))
    shipped = list(sources.values())
    schema = df.drop(*shipped).withColumns({name: F.lit(None).cast("double") for name, *_ in jobs}).schema

    def run(rows: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        series = dict(zip(shipped, numbers(rows, shipped), strict=True))
        made = {name: np.concatenate([_moved(label, part, w) for part in np.split(series[source], edges[1:-1])]) for name, label, source, w in jobs}
        return _with(rows.drop_columns(shipped), made)

    return map_groups(df, key, date, run, schema)


def _with(rows: pa.RecordBatch, made: dict[str, np.ndarray]) -> pa.RecordBatch:
    for name, values in made.items():
        rows = rows.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
    return rows


def _ranked(df: DataFrame, nodes: list[Node], names: dict[Node, str], date: str) -> DataFrame:
    """RANK columns: one date's cross-section at a time, all ranks of a level in one pass.

    As windows each of them would need two sorts of its own.  A date holds one row
    for each key; only columns that are still needed should be in ``df``.
    """
    sources = [f"__x{i}" for i in range(len(nodes))]
    df = df.withColumns({s: _number(n.children[0], names) for s, n in zip(sources, nodes, strict=True)})
    out = [names[n] for n in nodes]
    schema = df.drop(*sources).withColumns({name: F.lit(None).cast("double") for name in out}).schema

    def run(rows: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        made = {}
        for source, name in zip(sources, out, strict=True):  # one column at a time, as a date can be long
            parts = np.split(numbers(rows, [source])[0], edges[1:-1])
            made[name] = np.concatenate([pd.Series(part).rank(pct=True).to_numpy() for part in parts])
        return _with(rows.drop_columns(sources), made)

    return map_groups(df, date, date, run, schema)


def evaluate(
    grid: DataFrame, formulas: dict[str, str], key: str = "key", date: str = "date", keep: Iterable[str] = (), series: dict[str, Column] | None = None, needs: Iterable[str] = (), by_date: bool = False
) -> DataFrame:
    """``grid`` (dense, one row for each key and date) to key, date, ``keep``, ``series`` and one column per formula.

    ``series`` are columns of windows by key over the columns that ``needs`` names;
    they are made in the last pass by key, so that they aren't carried from the
    first.  With ``by_date`` the rows of a date end up next to each other in one
    task, which passes over whole dates can rely on.
    """
    roots = {name: canonical(parse(text)) for name, text in formulas.items()}
    names, plan = schedule(roots.values())
    phases = len(plan) + (by_date and len(plan) % 2)  # the last one by date
    passes = late(names, phases)
    last = [i for i, (kind, levels, arrow) in enumerate(passes) if kind == SERIES and (i == 0 or arrow or any(n.kind == SERIES for nodes in levels for n in nodes))][-1]
    fields = {n.label[1:] for r in roots.values() for n in _all(r) if n.label.startswith("$")}
    held, series = [key, date, *dict.fromkeys(keep)], series or {}
    df = grid.select(*held, *(f for f in sorted({*fields, *(needs if series else ())}) if f not in held))
    dealt = whole = None  # by what rows were dealt out, and by what an Arrow pass left them lying together, which Spark doesn't see
    for i, (kind, levels, arrow) in enumerate(passes):
        by = key if kind == SERIES else date
        windows = any(n.kind != ELEMENT for nodes in levels for n in nodes) or bool(series) and i == last
        inputs = [c for _, later, more in passes[i:] for n in [*sum(later, []), *more] for c in n.children] + list(roots.values())
        alive = {names[c] if c.children else c.label[1:] for c in inputs if c.number is None} | ({*needs} if series and i <= last else set())
        df = df.select(*held, *(c for c in df.columns if c in alive and c not in held))
        if arrow and (windows or dealt != by):
            df = df.repartition(by)  # windows of this pass use the same exchange
        if windows or arrow:
            dealt, whole = by, by if arrow else None
        if series and i == last:
            df = df.withColumns(series)
            held += series
        for nodes in levels:
            made = {}
            for n in nodes:
                if n.kind == ELEMENT:
                    made[names[n]] = _element(n, names)
                elif n.kind == SERIES:
                    made[names[n]] = _series(n, names, key, date)
                else:
                    made[names[n]] = _cross(n, names, date)
            df = df.withColumns(made)
        if arrow:
            df = _moving(df, arrow, names, key, date) if kind == SERIES else _ranked(df, arrow, names, date)
    if by_date and whole != date:
        df = df.repartition(date).sortWithinPartitions(date)
    return df.select(*held, *[_value(r, names).cast("double").alias(name) for name, r in roots.items()])


def _all(n: Node):
    yield n
    for c in n.children:
        yield from _all(c)


# --- the same language as DuckDB SQL, for checks -----------------------------------------


def _sql_value(n: Node, names: dict[Node, str]) -> str:
    if n.number is not None:
        return f"CAST({n.number!r} AS DOUBLE)"
    v = f'"{n.label[1:]}"' if not n.children else names[n]
    return f"CAST({v} AS DOUBLE)" if n.is_condition else v


def _sql_finite(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


def _sql_nan(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def _sql_node(n: Node, names: dict[Node, str], key: str, date: str) -> str:
    x = [_sql_value(c, names) for c in n.children]
    a = x[0]
    if n.kind == CROSS:
        if n.label == "RANK":
            return (
                f"CASE WHEN {a} IS NOT NULL THEN (rank() OVER (PARTITION BY {date}, {a} IS NULL ORDER BY {a}) + "
                f"(count(*) OVER (PARTITION BY {date}, {a}) - 1) / 2.0) / count({a}) OVER (PARTITION BY {date}) END"
            )
        f = _sql_finite(a)
        mean = f"avg({f}) OVER (PARTITION BY {date})"
        if n.label == "CS_DEMEAN":
            return f"{f} - {mean}"
        return f"({f} - {mean}) / nullif(stddev_samp({f}) OVER (PARTITION BY {date}), 0)"
    if n.kind == SERIES:
        w = int(n.children[-1].number)
        ordered = f"PARTITION BY {key} ORDER BY {date}"
        frame = f"({ordered} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        f = _sql_finite(a)
        strict = lambda v: f"CASE WHEN count({f}) OVER {frame} = {w} THEN {v} END"
        values = f"list({f}) OVER {frame}"
        match n.label:
            case "TS_DELTA":
                return _sql_nan(f"{a} - lag({a}, {w}) OVER ({ordered})")
            case "DELAY":
                return f"lag({a}, {w}) OVER ({ordered})"
            case "TS_RANK":
                below = f"len(list_filter({values}, lambda v: v < {f}))"
                same = f"len(list_filter({values}, lambda v: v = {f}))"
                return strict(f"({below} + ({same} + 1) / 2.0) / {float(w)}")
            case "TS_PRODUCT":
                return strict(f"list_reduce({values}, lambda p, v: p * v)")
            case "TS_ARGMAX":
                return strict(f"CAST({w} - list_position({values}, list_max({values})) AS DOUBLE)")
            case "TS_ARGMIN":
                return strict(f"CAST({w} - list_position({values}, list_min({values})) AS DOUBLE)")
            case "TS_DECAY_LINEAR":
                return strict(f"list_sum(list_transform({values}, lambda v, i: v * i)) / {w * (w + 1) / 2}")
            case "EMA":
                past = f"list({f}) OVER ({ordered} ROWS UNBOUNDED PRECEDING)"
                q = 1 - 2 / (w + 1)
                num = f"list_sum(list_transform({past}, lambda v, i: v * pow({q!r}, len({past}) - i)))"
                den = f"list_sum(list_transform({past}, lambda v, i: CASE WHEN v IS NOT NULL THEN pow({q!r}, len({past}) - i) END))"
                return f"CASE WHEN count({f}) OVER ({ordered} ROWS UNBOUNDED PRECEDING) >= {w} THEN {num} / {den} END"
            case "TS_CORR" | "TS_COV":
                g = _sql_finite(x[1])
                both = f"{f} IS NOT NULL AND {g} IS NOT NULL"
                p, q = f"(CASE WHEN {both} THEN {f} END)", f"(CASE WHEN {both} THEN {g} END)"
                full = f"count({p}) OVER {frame} = {w}"
                if n.label == "TS_COV":
                    return f"CASE WHEN {full} THEN covar_samp({p}, {q}) OVER {frame} END"
                varied = " AND ".join(f"min({v}) OVER {frame} < max({v}) OVER {frame}" for v in (p, q))
                return (
                    f"CASE WHEN {full} AND {varied} THEN covar_samp({p}, {q}) OVER {frame} / "
                    f"(stddev_samp({p}) OVER {frame} * stddev_samp({q}) OVER {frame}) END"
                )
        name = {"TS_MEAN": "avg", "TS_STD": "stddev_samp", "TS_MAX": "max", "TS_MIN": "min", "TS_SUM": "sum", "COUNT": "sum"}[n.label]
        return strict(f"{name}({f}) OVER {frame}")
    present = " AND ".join(f"{v} IS NOT NULL" for v in x)
    match n.label:
        case "+" | "-" | "*":
            return _sql_nan(f"({x[0]} {n.label} {x[1]})")
        case "/":
            zero = f"CASE WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) WHEN {a} < 0 THEN CAST('-inf' AS DOUBLE) END"
            return _sql_nan(f"(CASE WHEN {x[1]} = 0 THEN {zero} ELSE {a} / {x[1]} END)")
        case "neg":
            return f"-{a}"
        case ">" | "<" | ">=" | "<=":
            return f"{x[0]} {n.label} {x[1]}"
        case "ABS":
            return f"abs({a})"
        case "SIGN":
            return f"CAST(sign({a}) AS DOUBLE)"
        case "LOG":
            return f"CASE WHEN {a} > 0 THEN ln({a}) END"
        case "SQRT":
            return f"CASE WHEN {a} >= 0 THEN sqrt({a}) END"
        case "POWER":
            # a fractional power of a negative number is missing
            return f"CASE WHEN {present} AND NOT ({a} < 0 AND {x[1]} <> floor({x[1]})) THEN pow({a}, {x[1]}) END"
        case "BOUND":
            return f"CASE WHEN {a} IS NOT NULL THEN least(greatest({a}, {x[1]}), {x[2]}) END"
        case "IF":
            c = names[n.children[0]]
            return f"CASE WHEN {c} THEN {x[1]} WHEN NOT {c} THEN {x[2]} END"
        case "MIN" | "MAX":
            return f"CASE WHEN {present} THEN {'least' if n.label == 'MIN' else 'greatest'}({', '.join(x)}) END"
    raise AssertionError(n.label)


def to_sql(source: str, formulas: dict[str, str], key: str = "key", date: str = "date", keep: Iterable[str] = ()) -> str:
    """A SELECT over the grid named ``source`` with key, date, ``keep`` and one column per formula."""
    roots = {name: canonical(parse(text)) for name, text in formulas.items()}
    names, plan = schedule(roots.values())
    query = f"SELECT * FROM {source}"
    for _, levels in plan:
        for nodes in levels:
            if nodes:
                columns = ", ".join(f"{_sql_node(n, names, key, date)} AS {names[n]}" for n in nodes)
                query = f"SELECT *, {columns} FROM ({query})"
    held = [key, date, *dict.fromkeys(keep)]
    last = [f"CAST({_sql_value(r, names)} AS DOUBLE) AS {name}" for name, r in roots.items()]
    return f"SELECT {', '.join([*held, *last])} FROM ({query})"


__all__ = ["INF", "evaluate", "render", "schedule", "to_sql"]
