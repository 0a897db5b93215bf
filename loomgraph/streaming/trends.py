"""The trend of each series as state: reports arrive in a stream, each leaves with its changes and a drift flag.

The state of a series is the list of its last reports, HISTORY at most, so that it stays bounded however
long the stream runs; an expired report is dropped when a new one comes. Within a batch a series' reports
are taken in their order; a report that comes in a later batch than a newer one is compared with what the
state then ends with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators.governance import DRIFT_COST, DRIFT_LATENCY, DRIFT_SCORE, DRIFT_SCORES, HISTORY


class TrendProcessor(StatefulProcessor):
    """Keeps the last reports of a series and compares each new one with the one before it."""

    def __init__(self, series: str, order: str, metrics: list[str], order_type: str, keep: int = HISTORY):
        self.series, self.order, self.metrics, self.order_type, self.keep = series, order, metrics, order_type, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reports = handle.getListState("reports", f"at {self.order_type}, " + ", ".join(f"{m} double" for m in self.metrics))

    def drifted(self, delta: dict[str, float]) -> bool:
        rose = any(delta.get(m, 0.0) >= limit for m, limit in (("avg_latency_ms", DRIFT_LATENCY), ("estimated_cost_usd", DRIFT_COST)))
        return rose or any(delta[m] <= DRIFT_SCORE for m in DRIFT_SCORES if m in delta)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(self.order)
        kept = [tuple(r) for r in self.reports.get()]
        out = []
        for row in new[[self.order, *self.metrics]].itertuples(index=False, name=None):
            at, values = row[0], [float(v) for v in row[1:]]
            delta = {m: round(v - was, 6) for m, v, was in zip(self.metrics, values, kept[-1][1:], strict=True)} if kept else dict.fromkeys(self.metrics, 0.0)
            out.append((key[0], at, *values, *delta.values(), self.drifted(delta)))
            kept = [*kept, (at, *values)][-self.keep :]
        self.reports.put(kept)
        yield pd.DataFrame(out, columns=[self.series, self.order, *self.metrics, *(f"delta_{m}" for m in self.metrics), "drift_flagged"])

    def close(self) -> None:
        pass


def drift_stream(reports: DataFrame, series: str, order: str, metrics: list[str], keep: int = HISTORY) -> DataFrame:
    """A stream of reports (series, order, metrics) with each metric's change and drift_flagged.

    The session needs the RocksDB state store, as Spark's transformWithState does.
    """
    kinds = dict(reports.dtypes)
    shape = f"{series} {kinds[series]}, {order} {kinds[order]}, " + ", ".join(f"{m} double" for m in [*metrics, *(f"delta_{m}" for m in metrics)]) + ", drift_flagged boolean"
    return reports.select(series, order, *metrics).groupBy(series).transformWithStateInPandas(TrendProcessor(series, order, metrics, kinds[order], keep), shape, "Append", "None")
