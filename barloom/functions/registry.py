"""Named features and the staged pipeline that computes them.

A feature is declared with its inputs and how far it looks back or ahead. ``compute`` takes the wanted
names, adds what they need, sizes the halo and emits a handful of stages over one blocked shuffle:

* native - a Column over the block window,
* total / fill - since-the-start running sum or forward fill (``blocks.carry``),
* ring - the last k events as an array (``rings.ring_carry``),
* ewm - exponential recursion, evaluated per block with a warm-up long enough that the influence of
  anything earlier is below double precision,
* table - joined in from a function of the bars (sequential scans, chart peaks).

Users add their own with the same decorators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from barloom.operators.blocks import BLOCK_ROWS, SERIES, carry, core_rows, to_blocks
from barloom.operators.rings import ring_carry

BASE = ("pair", "timeframe", "ts", "open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    deps: tuple[str, ...]
    build: Callable | None = None
    back: int = 0
    ahead: int = 0
    alpha: float | str = 0.0
    min_periods: int = 1
    group: str = ""
    tags: frozenset[str] = field(default_factory=frozenset)


REGISTRY: dict[str, Feature] = {}
CARRIED = ("total", "fill", "ring")


def register(feature: Feature) -> Feature:
    REGISTRY[feature.name] = feature
    return feature


def native(name: str, deps: Sequence[str], build: Callable[[], Column], back: int = 0, ahead: int = 0, group: str = ""):
    return register(Feature(name, "native", tuple(deps), build, back, ahead, group=group))


def total(name: str, deps: Sequence[str], build: Callable[[], Column], back: int = 1, group: str = ""):
    return register(Feature(name, "total", tuple(deps), build, back, group=group))


def fill(name: str, deps: Sequence[str], build: Callable[[], Column], back: int = 1, group: str = ""):
    return register(Feature(name, "fill", tuple(deps), build, back, group=group))


def ring(name: str, deps: Sequence[str], build: Callable[[], tuple[Column, Column]], back: int = 1, group: str = ""):
    """The last events, newest first; ``build`` gives the event and the value kept of it."""
    return register(Feature(name, "ring", tuple(deps), build, back, group=group))


def warm_up(alpha: float) -> int:
    """Rows after which the weight of older observations is below 1e-17."""
    return 1 if alpha >= 1 else math.ceil(math.log(1e-17) / math.log1p(-alpha))


def ewm(name: str, source: str | Callable, alpha: float, deps: Sequence[str] = (), min_periods: int = 1, group: str = ""):
    """Exponential mean seeded with the first observation. ``source`` is a column or ``f(frame)``."""
    deps = (source,) if isinstance(source, str) else tuple(deps)
    return register(Feature(name, "ewm", deps, None if isinstance(source, str) else source,
                            warm_up(alpha), alpha=alpha, min_periods=min_periods, group=group))


def ema(name: str, source, n: int, deps: Sequence[str] = (), group: str = ""):
    return ewm(name, source, 2.0 / (n + 1), deps, n, group)


def rma(name: str, source, n: int, deps: Sequence[str] = (), group: str = "", min_periods: int | None = None):
    return ewm(name, source, 1.0 / n, deps, n if min_periods is None else min_periods, group)


def table(names: Sequence[str], build: Callable[[DataFrame, int], DataFrame], group: str = ""):
    """Columns that come from ``build(bars, block_rows)`` keyed by series and ts."""
    for n in names:
        register(Feature(n, "table", (), build, group=group))


def closure(wanted: Iterable[str]) -> dict[str, Feature]:
    need: dict[str, Feature] = {}

    def visit(name: str):
        if name in BASE or name in ("_i", "_rn") or name in need:
            return
        f = REGISTRY[name]
        for d in f.deps:
            visit(d)
        need[name] = f

    for w in wanted:
        visit(w)
    return need


def halo(need: dict[str, Feature]) -> tuple[int, int]:
    back: dict[str, int] = {}
    ahead: dict[str, int] = {}
    for name, f in need.items():
        back[name] = f.back + max((back.get(d, 0) for d in f.deps), default=0)
        ahead[name] = f.ahead + max((ahead.get(d, 0) for d in f.deps), default=0)
    b, a = max(back.values(), default=0), max(ahead.values(), default=0)
    if any(f.kind in CARRIED for f in need.values()):
        b = 2 * b + 16
    return b, a


class _Columns(dict):
    """Columns of an Arrow table as pandas series, converted when they are asked for."""

    def __init__(self, table: pa.Table):
        super().__init__()
        self.table = table

    def __missing__(self, name: str) -> pd.Series:
        self[name] = self.table[name].to_pandas()
        return self[name]


def _without_nan(column: pa.ChunkedArray) -> pa.ChunkedArray:
    return pc.if_else(pc.is_nan(column), pa.scalar(None, column.type), column) if pa.types.is_floating(column.type) else column


def _recursions(specs: list[tuple]) -> Callable[[pa.Table], pa.Table]:
    """Only what the recursions read becomes pandas; the other columns, rings above all, stay in Arrow."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["_rn"]))
        work = _Columns(rows)
        for name, src, fn, alpha, min_periods in specs:
            x = work[src] if fn is None else fn(work)
            if isinstance(x, np.ndarray):
                x = pd.Series(x)
            if isinstance(alpha, str):
                work[name] = varying(x, work[alpha], min_periods)
            else:
                work[name] = x.ewm(alpha=alpha, adjust=False, min_periods=min_periods).mean()
        new = [pa.array(work[s[0]].to_numpy(np.float64), pa.float64(), from_pandas=True) for s in specs]
        kept = [_without_nan(c) for c in rows.columns]
        return pa.table([*kept, *new], names=[*rows.column_names, *[s[0] for s in specs]])

    def varying(x: pd.Series, a: pd.Series, hold: int) -> pd.Series:
        """y += a*(x - y); the first ``hold`` rows repeat the first observation."""
        out = np.empty(len(x))
        y = x.iat[0]
        for i, (xi, ai) in enumerate(zip(x.to_numpy(), a.to_numpy(), strict=True)):
            if i >= hold and ai == ai:
                y = y + ai * (xi - y)
            out[i] = y
        return pd.Series(out)

    return run


def compute(
    bars: DataFrame,
    wanted: Sequence[str],
    block_rows: int = BLOCK_ROWS,
    keep: Sequence[str] = (),
    keep_inputs: bool = True,
) -> DataFrame:
    """Bars with the wanted features. ``keep`` names further input columns to pass through."""
    wanted = list(dict.fromkeys(wanted))
    need = closure(wanted)
    extra = [c for c in bars.columns if c not in BASE]
    src = bars
    built = []
    for f in need.values():
        if f.kind == "table" and f.build not in built:
            built.append(f.build)
            src = src.join(f.build(bars.select(*BASE), block_rows), [*SERIES, "ts"], "left")
    done = {n for n, f in need.items() if f.kind == "table"}
    todo = [f for f in need.values() if f.kind != "table"]
    back, ahead = halo(need)
    rows = max(block_rows, back, ahead)
    df = to_blocks(src, back, ahead, block_rows=rows)

    def inputs_of(names: Iterable[str]) -> set[str]:
        seen: set[str] = set()
        stack = [n for n in names if n in need]
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack += [d for d in need[n].deps if d in need]
        return seen

    # Carried columns first, while the frame is narrow; then what the recursions read; then the rest.
    carried_first = {f.name for f in todo if f.kind in CARRIED
                     and not any(need[d].kind == "ewm" for d in inputs_of([f.name]))}
    for_recursions = inputs_of(d for f in todo if f.kind == "ewm" for d in f.deps)

    def ready(f: Feature, also: set[str] = frozenset()) -> bool:
        return all(d in BASE or d in ("_i", "_rn") or d in done or d in also for d in f.deps)

    for allowed in (inputs_of(carried_first), for_recursions, {f.name for f in todo}):
        while True:
            pending = [f for f in todo if f.name not in done and f.name in allowed]
            if not pending:
                break
            batch = [f for f in pending if f.kind == "native" and ready(f)]
            if batch:
                df = df.withColumns({f.name: f.build() for f in batch})
                done |= {f.name for f in batch}
                continue
            carried = [f for f in pending if f.kind in CARRIED and ready(f)]
            if carried:
                sums, lasts, rings = ({f.name: f.build() for f in carried if f.kind == k} for k in CARRIED)
                if sums or lasts:
                    df = carry(df, back, sums, lasts, block_rows=rows)
                if rings:
                    df = ring_carry(df, back, rings, block_rows=rows)
                done |= {f.name for f in carried}
                continue
            chain: list[Feature] = []
            for f in todo:
                if f.name not in done and f.kind == "ewm" and ready(f, {c.name for c in chain}):
                    chain.append(f)
            if chain:
                specs = [(f.name, f.deps[0], f.build, f.alpha, f.min_periods) for f in chain]
                schema = T.StructType(df.schema.fields + [T.StructField(f.name, T.DoubleType()) for f in chain])
                df = df.groupBy(*SERIES, "_blk").applyInArrow(_recursions(specs), schema)
                done |= {f.name for f in chain}
                continue
            break
    missing = [f.name for f in todo if f.name not in done]
    if missing:
        raise ValueError(f"features with unresolved inputs: {missing}")
    out = core_rows(df, keep=keep)
    first = [*BASE, *extra] if keep_inputs else [*SERIES, "ts"]
    return out.select(*first, *[c for c in keep if c not in first], *[w for w in wanted if w not in first])
