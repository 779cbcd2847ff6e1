"""Conditions, formulas and confirmation rules compiled to Columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import flag, lag
from barloom.functions.registry import BASE, REGISTRY, compute, native
from barloom.operators.blocks import trailing

_COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}


@dataclass(frozen=True)
class Condition:
    """``indicator op value`` where value is a number or another column; held for ``lookback`` bars."""

    indicator: str
    op: str
    value: float | str
    lookback: int = 1

    def inputs(self) -> list[str]:
        return [c for c in (self.indicator, self.value) if isinstance(c, str)]

    def column(self) -> Column:
        x = F.col(self.indicator)
        v = F.col(self.value) if isinstance(self.value, str) else F.lit(self.value)
        if self.op in ("crosses_above", "crosses_below"):
            was = lag(x) - (lag(v) if isinstance(self.value, str) else v)
            out = (x > v) & (was <= 0) if self.op == "crosses_above" else (x < v) & (was >= 0)
        else:
            out = _COMPARE[self.op](x, v)
        if self.lookback > 1:
            w = trailing(self.lookback)
            return (F.count(x).over(w) == self.lookback) & (F.min(out.cast("int")).over(w) == 1)
        return F.coalesce(out, F.lit(False))

    def text(self) -> str:
        return f"{self.indicator} {self.op} {self.value}" + (f" for {self.lookback} bars" if self.lookback > 1 else "")


@dataclass(frozen=True)
class Formula:
    """All primary conditions and at least ``least`` of the confirmations."""

    primary: Sequence[Condition]
    confirmations: Sequence[Condition] = ()
    least: int = 0

    def column(self) -> Column:
        out = reduce(and_, [c.column() for c in self.primary], F.lit(True))
        if self.confirmations:
            out = out & (reduce(add, [flag(c.column()) for c in self.confirmations]) >= self.least)
        return out

    def text(self) -> str:
        parts = [" AND ".join(c.text() for c in self.primary)]
        if self.confirmations:
            parts.append(f"AT LEAST {self.least} OF ({', '.join(c.text() for c in self.confirmations)})")
        return " AND ".join(parts)


def _temporary(columns: dict[str, tuple[list[str], object]], bars: DataFrame, back: int) -> DataFrame:
    names = []
    for name, (deps, fn) in columns.items():
        native(name, [d for d in dict.fromkeys(deps) if d in REGISTRY or d in BASE], fn, back=back)
        names.append(name)
    try:
        return compute(bars, names)
    finally:
        for n in names:
            REGISTRY.pop(n, None)


def apply_conditions(bars: DataFrame, conditions: dict[str, Condition]) -> DataFrame:
    back = max(c.lookback for c in conditions.values()) + 1
    return _temporary({n: (c.inputs(), lambda c=c: flag(c.column())) for n, c in conditions.items()}, bars, back)


def apply_formula(bars: DataFrame, formulas: dict[str, Formula]) -> DataFrame:
    every = lambda f: [*f.primary, *f.confirmations]
    back = max(c.lookback for f in formulas.values() for c in every(f)) + 1
    return _temporary({n: ([i for c in every(f) for i in c.inputs()], lambda f=f: flag(f.column())) for n, f in formulas.items()}, bars, back)


def high_low_rules(bars: DataFrame, factors: dict[str, Sequence[tuple[str, str]]], window: int = 50) -> DataFrame:
    """Per rule name: every factor is above (HIGH) or below (LOW) its own rolling mean; unknown features are skipped."""
    spec = {}
    for name, parts in factors.items():
        known = [(f, d) for f, d in parts if f in REGISTRY or f in BASE]

        def build(known=known):
            tests = [(F.col(f) > F.avg(f).over(trailing(window))) if d == "HIGH" else (F.col(f) < F.avg(f).over(trailing(window))) for f, d in known]
            return flag(reduce(and_, tests, F.lit(bool(tests))))

        spec[name] = ([f for f, _ in known], build)
    return _temporary(spec, bars, window)
