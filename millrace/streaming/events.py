"""Ordered operators on event streams: hopping means, and merged intervals as sessions. Additions of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seconds(c: str):
    """Seconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def hop_window(events: DataFrame, time_col: str, by: list[str], value: str, size: str, hop: str, late: str | None = None) -> DataFrame:
    """Count and sum for every hopping window; with `late` as a stream with a watermark."""
    src = events.withColumn("_t", F.col(time_col).cast("timestamp" if late else "timestamp_ntz"))
    src = src.withWatermark("_t", late) if late else src
    out = src.groupBy(F.window("_t", size, hop).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(seconds("w.start").alias("start"), seconds("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time_col: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Events closer than the gap merge into one span."""
    src = events.withColumn("_t", F.col(time_col).cast("timestamp" if late else "timestamp_ntz"))
    src = src.withWatermark("_t", late) if late else src
    out = src.groupBy(F.session_window("_t", gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(seconds("w.start").alias("start"), seconds("w.end").alias("end"), *by, "n")


def forward(events: DataFrame, by: str, order: list[str], symbol: str, model) -> DataFrame:
    """(by, n, lnl) after each batch of a stream: symbols so far of each key that had some, and ln of their chance under an hmm.Model.

    What a key keeps is one number a state, the count and the log. A key's rows
    of one batch are put in order in one task (the source's rate bounds them);
    rows of a later batch come after those of earlier ones, whatever their order
    says. Null or unknown symbols are equally likely in all states; a null key is a key.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    prior, move = np.array(model.prior, float), np.array(model.move, float)
    known = {s: np.array([e.get(s, 0.0) for e in model.emit], float) for s in {s for e in model.emit for s in e}}
    cols = [f"p{i}" for i in range(len(prior))]

    def run(key, batches, state):
        *p, n, lnl = state.get if state.exists else (*prior, 0, 0.0)
        p = np.array(p, float)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for s in rows[symbol]:
            p = (p @ move if n else p) * known.get(s, 1.0)
            total = p.sum()
            lnl += float(np.log(total)) if total > 0 else -np.inf
            p, n = (p / total if total > 0 else p), n + 1
        state.update((*(float(x) for x in p), int(n), float(lnl)))
        yield pd.DataFrame({by: [key[0]], "n": [int(n)], "lnl": [float(lnl)]})

    kept = events.select(by, *order, symbol)
    out = f"`{by}` {kept.schema[by].dataType.simpleString()}, n long, lnl double"
    return kept.groupBy(by).applyInPandasWithState(run, out, ", ".join(f"{c} double" for c in cols) + ", n long, lnl double", "update", GroupStateTimeout.NoTimeout)
