"""Query catalog: each entry is a Spark query over the driver's tables and, where SQL can say the same, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.registry import compute
from barloom.sources.bars import event_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = ("pair", "timeframe", "ts")

_INTERVAL = {"15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, *timeframes: str) -> DataFrame:
    return event_bars(load(spark, sf_dir, "events"), timeframes or ("1h",))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def features(spark: SparkSession, sf_dir: str, names: Sequence[str], timeframes: Sequence[str] = ("1h",)) -> DataFrame:
    df = compute(bars(spark, sf_dir, *timeframes), names)
    return rounded(df.select(*KEYS, *names))


# ---- SQL text helpers -------------------------------------------------------------------------------

def bars_cte(timeframe: str = "1h", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT event_type AS pair, '{timeframe}' AS timeframe, time_bucket(INTERVAL '{_INTERVAL[timeframe]}', ts) AS ts,
         arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ROW(ts, event_id)) AS close, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume
  FROM events GROUP BY 1, 2, 3)"""


PART = "PARTITION BY pair, timeframe ORDER BY ts"


def frame(n: int) -> str:
    return f"({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, min1: bool = False) -> str:
    value = f"{agg}({x}) OVER {frame(n)}"
    return value if min1 else f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {value} END"


def prev(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({PART})"


def ewm_cte(name: str, source: str, x: str, specs: Sequence[tuple[str, float, int]]) -> str:
    """Exponential means in closed form: every observation weighted by its age."""
    cols = ", ".join(
        f"CASE WHEN b.rn >= {n} THEN sum(CASE WHEN j.rn = 1 THEN 1.0::DOUBLE ELSE {a!r}::DOUBLE END"
        f" * pow({1 - a!r}::DOUBLE, b.rn - j.rn) * j.x) END AS {out}"
        for out, a, n in specs
    )
    return f"""{name} AS (
  WITH s AS MATERIALIZED (SELECT pair, timeframe, ts, {x} AS x, row_number() OVER ({PART}) AS rn FROM {source} WHERE {x} IS NOT NULL)
  SELECT b.pair, b.timeframe, b.ts, {cols}
  FROM s b JOIN s j ON j.pair = b.pair AND j.timeframe = b.timeframe AND j.rn <= b.rn
  GROUP BY b.pair, b.timeframe, b.ts, b.rn)"""


def ema_spec(out: str, n: int) -> tuple[str, float, int]:
    return out, 2.0 / (n + 1), n


def rma_spec(out: str, n: int) -> tuple[str, float, int]:
    return out, 1.0 / n, n


def sql_select(ctes: Sequence[str], cols: dict[str, str], source: str = "bars", joins: Sequence[str] = ()) -> str:
    """Keys plus the named expressions, doubles rounded; ``joins`` are CTEs matched on the keys."""
    sel = ", ".join(f"round({e}, 6) AS {c}" for c, e in cols.items())
    tail = "".join(f" LEFT JOIN {j} USING (pair, timeframe, ts)" for j in joins)
    return f"WITH {', '.join(ctes)} SELECT pair, timeframe, ts, {sel} FROM {source}{tail}"


def sql_flags(ctes: Sequence[str], cols: dict[str, str], source: str = "bars", joins: Sequence[str] = ()) -> str:
    sel = ", ".join(f"CASE WHEN {e} THEN 1 ELSE 0 END AS {c}" for c, e in cols.items())
    tail = "".join(f" LEFT JOIN {j} USING (pair, timeframe, ts)" for j in joins)
    return f"WITH {', '.join(ctes)} SELECT pair, timeframe, ts, {sel} FROM {source}{tail}"
