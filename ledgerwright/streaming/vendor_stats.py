"""Per-vendor statistics on a stream of confirmed totals: score first, then update."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerwright import fixed
from ledgerwright.operators.vendors import step

OUTPUT = (
    "vendor_id string, invoice_id string, ts timestamp, total double, "
    "n bigint, avg double, std double, outlier_z double"
)
STATE = "n bigint, avg double, std double, m2 double"


def _score_then_update(
    key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    # Events come batch by batch and the state is four numbers, so a vendor's events are
    # held only for one trigger; the source's per-trigger limit bounds them.
    events = pd.concat(list(batches)).sort_values(["ts", "invoice_id"])
    n, avg, std, m2 = state.get if state.exists else (0, 0.0, 0.0, 0.0)
    rows = []
    for ts, invoice_id, x in zip(events["ts"], events["invoice_id"], events["total"]):
        z = None
        if n >= fixed.MIN_HISTORY and std > 0 and abs(x - avg) / std >= fixed.OUTLIER_Z:
            z = round(abs(x - avg) / std, 2)
        rows.append((key[0], invoice_id, ts, x, n, avg, std, z))
        n, avg, std, m2 = step(n, avg, m2, x)
    state.update((n, avg, std, m2))
    yield pd.DataFrame(
        rows, columns=["vendor_id", "invoice_id", "ts", "total", "n", "avg", "std", "outlier_z"]
    ).astype({"outlier_z": "float64"})


def running_vendor_stats(confirms: DataFrame) -> DataFrame:
    """Each confirmed total (vendor_id, invoice_id, ts, total) with the statistics before it.

    State is kept per vendor without end, as a later confirmation may always come.
    """
    known = confirms.where(F.col("total").isNotNull() & F.col("vendor_id").isNotNull()).select(
        F.col("vendor_id").cast("string"), F.col("invoice_id").cast("string"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("total").cast("double"),
    )
    return known.groupBy("vendor_id").applyInPandasWithState(
        _score_then_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
