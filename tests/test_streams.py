"""Streams: state that outlives a stop and begins where a batch job ended, and sinks that can be replayed."""

import tempfile

import pytest
from pyspark.sql import functions as F

from spanwatt.operators import audit, sag
from spanwatt.streaming import sag_stream, sinks
from tests.test_sag import INPUT, random_rows

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(STORE)


def states(df):
    return {(r.tower_id, r.sample_index): (r.state, r.error_code, round(r.threshold_c, 9), round(r.final_current_a, 9)) for r in df.collect()}


def test_sag_stream(spark, rocks):
    """A stream that is stopped and started again after each file gives what one batch gives."""
    rows = spark.createDataFrame(random_rows(3, 45), INPUT)
    folder = tempfile.mkdtemp(prefix="spark-")
    for k in range(3):
        rows.where(F.col("sample_index").between(15 * k, 15 * k + 14)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        made = sag_stream.validate_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    assert states(spark.read.parquet(f"{folder}/out")) == states(sag.validate(rows))


def test_initial_state(spark, rocks):
    """A batch job sees the first part, a stream the rest; and a batch job goes on from a batch job."""
    rows = spark.createDataFrame(random_rows(3, 40, seed=9), INPUT)
    first, rest = rows.where("sample_index < 20"), rows.where("sample_index >= 20")
    whole = states(sag.validate(rows))
    early, memories = sag.folded(first)
    later, _ = sag.folded(rest, start=memories)
    assert states(early) | states(later) == whole
    folder = tempfile.mkdtemp(prefix="spark-")
    rest.write.parquet(f"{folder}/in")
    made = sag_stream.validate_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), initial=memories)
    made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    assert states(early) | states(spark.read.parquet(f"{folder}/out")) == whole


def test_replayed_batch(spark):
    """A batch that is written twice is there once; a failing audit changes no result."""
    folder = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([("r", str(k), "l", "1", "i", "c", "s", None) for k in range(4)], "run_id string, result_id string, line_id string, tower_id string, input_hash string, config_hash string, source string, fallback_reason string")
    write = sinks.by_batch(f"{folder}/direct")
    for part, batch in ((df.where("result_id < 2"), 0), (df.where("result_id = 2"), 1), (df.where("result_id = 2"), 1), (df.where("result_id < 2"), 0)):
        write(part, batch)
    assert sorted((r.result_id, r.batch_id) for r in spark.read.parquet(f"{folder}/direct").collect()) == [("0", 0), ("1", 0), ("2", 1)]
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    sinks.start(stream, f"{folder}/out", f"{folder}/check", lambda d: audit.events(d, "rating", ["source"]), f"{folder}/log").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == spark.read.json(f"{folder}/log").count() == 4

    def broken(d):
        raise RuntimeError("no audit")

    sinks.start(stream, f"{folder}/out2", f"{folder}/check2", broken, f"{folder}/log2").awaitTermination()
    assert spark.read.parquet(f"{folder}/out2").count() == 4
