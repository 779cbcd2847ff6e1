"""Confirmation rule and playbook queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import KEYS, bars, query, rounded
from barloom.catalog.indicators import B, RSI, TP, nz, prev, roc, roll, step
from barloom.functions.registry import compute
from barloom.plans import playbook as P
from barloom.plans.instances import segments
from barloom.plans.rules import high_low_rules
from barloom.session import cut_lineage


def counted(spark, sf):
    x = P.confirmed(compute(bars(spark, sf), P.INPUTS))
    return x.select(*KEYS, *[F.size(c).alias(c) for c in P.RULES])


query("rl1_2_11_confirmations")(counted)
query("rl1_momentum_subset", f"WITH {B}, {', '.join(RSI)}, {step('q', {'r': roc('close', 10) + ' * 100'}, 'rs')} SELECT pair, timeframe, ts,"
      " CASE WHEN rsi > 55 THEN 1 ELSE 0 END + CASE WHEN rsi_30 > 55 THEN 1 ELSE 0 END + CASE WHEN r > 2 THEN 1 ELSE 0 END AS bullish FROM q")(
    lambda spark, sf: compute(bars(spark, sf), ["rsi", "rsi_30", "roc"]).select(*KEYS, F.size(P.confirmations(
        [r for r in P.MOMENTUM_BULL if r[1] in (("rsi",), ("rsi_30",), ("roc",))])).alias("bullish")))


def counts_of(category: str, *first: str):
    """Per bar, how many bullish and bearish rules of ``category`` hold whose condition begins with one of ``first``."""
    def run(spark, sf):
        x = compute(bars(spark, sf), list(first))
        return x.select(*KEYS, *[F.size(P.confirmations([r for r in P.RULES[f"{category}_{side}"] if r[2].split()[0] in first])).alias(side) for side in ("bull", "bear")])
    return run


query("rl3_volume_confirmations", f"WITH {B}, " + step("q", {"tp": TP, "cv": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume"}) + ", "
      + step("q1", {"up": f"CASE WHEN tp > {prev('tp')} THEN tp * volume ELSE 0 END", "dn": f"CASE WHEN tp < {prev('tp')} THEN tp * volume ELSE 0 END"}, "q") + ", "
      + step("q2", {"cmf": f"({roll('sum', 'cv', 20)}) / {nz(roll('sum', 'volume', 20))}",
                    "mfi": f"100 * ({roll('sum', 'up', 14)}) / nullif(({roll('sum', 'up', 14)}) + ({roll('sum', 'dn', 14)}), 0)"}, "q1")
      + " SELECT pair, timeframe, ts, CASE WHEN cmf > 0 THEN 1 ELSE 0 END + CASE WHEN mfi > 50 THEN 1 ELSE 0 END + CASE WHEN mfi > 80 THEN 1 ELSE 0 END AS bull,"
      " CASE WHEN cmf < 0 THEN 1 ELSE 0 END + CASE WHEN mfi < 50 THEN 1 ELSE 0 END + CASE WHEN mfi < 20 THEN 1 ELSE 0 END AS bear FROM q2")(
    counts_of("volume", "cmf", "mfi"))
query("rl4_volatility_confirmations", f"WITH {B}, " + step("q0", {"mx": roll("max", "close", 14, True), "u": roll("max", "high", 20), "l": roll("min", "low", 20)}) + ", "
      + step("q1", {"dd": "pow((close - mx) / nullif(mx, 0) * 100, 2)"}, "q0") + ", "
      + step("q2", {"dc": "(close - l) / nullif(u - l, 0)", "ui": f"sqrt({roll('avg', 'dd', 14, True)})"}, "q1")
      + " SELECT pair, timeframe, ts, CASE WHEN dc > 0.8 THEN 1 ELSE 0 END + CASE WHEN ui < 2 THEN 1 ELSE 0 END AS bull, CASE WHEN ui > 5 THEN 1 ELSE 0 END AS bear FROM q2")(
    counts_of("volatility", "dc_pct", "ulcer_index"))
query("rl13_playbook")(lambda spark, sf: rounded(P.playbook(segments(cut_lineage(compute(bars(spark, sf), [*P.INPUTS, "seg_trigger"]))))))
query("rl14_playbook_rows")(lambda spark, sf: P.playbook_rows(P.playbook(segments(cut_lineage(compute(bars(spark, sf), [*P.INPUTS, "seg_trigger"]))))))
query("prj7_high_low_rules", f"WITH {B}, {', '.join(RSI)}, {step('q', {'hi': 'rsi > avg(rsi) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS 49 PRECEDING)', 'lo': 'volume < avg(volume) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS 49 PRECEDING)'}, 'rs')}"
      " SELECT pair, timeframe, ts, CASE WHEN hi AND lo THEN 1 ELSE 0 END AS my_rule FROM q")(
    lambda spark, sf: high_low_rules(bars(spark, sf), {"my_rule": [("rsi", "HIGH"), ("volume", "LOW"), ("no_such_feature", "HIGH")]}).select(*KEYS, "my_rule"))
