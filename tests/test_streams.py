import random

import pytest

from millrace.operators import hmm
from millrace.streaming import events


def test_forward_keeps_what_a_batch_would_give(spark, tmp_path):
    model = hmm.Model([0.3, 0.7], [[0.9, 0.1], [0.2, 0.8]], [{"a": 0.6, "b": 0.4}, {"a": 0.1, "b": 0.9}])
    rng = random.Random(3)
    data = [(u, i, rng.choice(["a", "b", "b", "?", None])) for i in range(40) for u in ("x", "y")] + [("z", 0, "a")]
    schema = "u string, at int, s string"
    for k, part in enumerate((data[:30], data[30:55], data[55:])):
        part = part[:]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in" / "*"))
    got: dict = {}

    def keep(df, _):
        got.update({r.u: (r.n, r.lnl) for r in df.collect()})

    q = events.forward(stream, "u", ["at"], "s", model).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination(120)
    assert q.exception() is None and len(q.recentProgress) >= 3
    want = {r.u: r.lnl for r in hmm.likelihood(spark.createDataFrame(data, schema), "u", ["at"], "s", model).collect()}
    assert {u: n for u, (n, _) in got.items()} == {"x": 40, "y": 40, "z": 1}
    assert {u: v for u, (_, v) in got.items()} == pytest.approx(want, abs=1e-9)
