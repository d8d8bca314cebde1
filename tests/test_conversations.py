"""Memory of conversations that stream in, against the batch view."""

import random

from stratum.operators.memory import bounded_memory
from stratum.streaming.conversations import memory_views

SHAPE = "conv_id bigint, turn int, role string, text string"


def test_streamed_memory_equals_the_batch_view_in_any_order(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for conv in range(8):
        for turn in range(r.choice([1, 5, 30, 45])):
            words = " ".join(r.choices(["词语", "a b", "  x\n", "long" * 40], k=r.choice([0, 3, 60])))
            rows.append((conv, turn, r.choice(["user", "assistant", "system"]), None if r.random() < 0.05 else words))
    rows += [(99, t, "system", "nothing to remember") for t in range(3)]
    r.shuffle(rows)
    feed, seen = str(tmp_path / "feed"), {}
    (tmp_path / "feed").mkdir()
    views = memory_views(spark.readStream.schema(SHAPE).parquet(feed), last=12, total=900, user_chars=300, assistant_chars=200)

    def keep(batch, _):
        seen.update({x.conv_id: (x.memory, x.n_lines) for x in batch.collect()})

    for low in range(0, len(rows), 70):
        spark.createDataFrame(rows[low : low + 70], SHAPE).coalesce(1).write.mode("append").parquet(feed)
        views.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(200)
    whole = bounded_memory(spark.createDataFrame(rows, SHAPE), last=12, total=900, user_chars=300, assistant_chars=200).collect()
    assert {c: v for c, v in seen.items() if v[1]} == {str(x.conv_id): (x.memory, x.n_lines) for x in whole}
    assert seen["99"] == (None, 0)
