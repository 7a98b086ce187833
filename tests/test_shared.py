"""Tables in the shared folder."""

from __future__ import annotations

from loomgraph import shared


def test_batches_bounded_in_bytes(spark):
    """Long texts go through Python in batches of about BATCH_BYTES while a table is written, and no setting stays behind."""

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    before = [spark.conf.get(key) for key in (shared._ROWS, shared._BYTES)]
    texts = spark.range(300, numPartitions=1).selectExpr("repeat('x', 100000) AS text")
    got = shared.save(texts.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r["rows"] for r in got) == 300 and max(r["bytes"] for r in got) <= 2 * shared.BATCH_BYTES
    huge = spark.range(3, numPartitions=1).selectExpr(f"repeat('x', {3 * shared.BATCH_BYTES}) AS text")
    assert sum(r["rows"] for r in shared.save(huge.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()) == 3
    assert [spark.conf.get(key) for key in (shared._ROWS, shared._BYTES)] == before


def test_shuffled_joins(spark):
    """Joins without a hint are shuffled inside, whatever was set before, and no setting stays behind."""
    key, adaptive = shared._BROADCASTS
    before = [spark.conf.get(k, None) for k in (key, adaptive)]
    joined = lambda: spark.range(9).join(spark.range(5), "id")._jdf.queryExecution().executedPlan().toString()
    try:
        spark.conf.set(adaptive, "1m")
        with shared.shuffled(spark):
            assert "BroadcastHashJoin" not in joined()
        assert "BroadcastHashJoin" in joined() and (spark.conf.get(key, None), spark.conf.get(adaptive)) == (before[0], "1m")
    finally:
        spark.conf.unset(adaptive)
    with shared.shuffled(spark):
        pass
    assert [spark.conf.get(k, None) for k in (key, adaptive)] == before
