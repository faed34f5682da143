"""Keyed streams under disorder, and the serve path as one stream."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from eventlane.operators import folds
from eventlane.plans import serve
from eventlane.streaming import keyed
from workload import fixtures
from workload.queries import serve_config

BASE = 1_700_000_000
SCHEMA = "seq bigint, received_epoch bigint, dedup_key string, cooldown_key string, source string, client_ip string"
NIL = (None, None, None, None)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a keyed stream starts its own Python process in each micro-batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def made(seed, n, step):
    draw = random.Random(seed)
    time, rows = 0, []
    for seq in range(n):
        time += draw.choice([0, 0, 1, step, 3 * step])
        rows.append((seq, BASE + time, draw.choice(["a", "b", "c", "d", "", None]), draw.choice(["x", "y", None]), draw.choice(["s", "t"]), draw.choice(["1.1.1.1", None])))
    return rows


def disordered(rows, seconds, seed):
    """Rows in an order in which none is more than ``seconds`` behind an earlier one."""
    draw = random.Random(seed)
    return [r for _, r in sorted(((r[1] + draw.uniform(0, seconds), r) for r in rows), key=lambda p: p[0])]


def run(spark, folder, batches, build, schema=SCHEMA):
    """One micro-batch a list of rows; returns the rows written and the rows Spark dropped."""
    folder = folder / uuid.uuid4().hex
    base = spark.createDataFrame([], schema).schema
    dropped = 0
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, base).coalesce(1).write.mode("append").parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(base).parquet(f"{folder}/in/*").withColumn("received_at", F.timestamp_seconds("received_epoch"))
        stream = stream.withColumn("received_ms", F.col("received_epoch") * 1000)
        query = build(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        dropped += keyed.late_rows(query)
    return spark.read.parquet(f"{folder}/out"), dropped


STREAMS = {
    "dedup": (lambda s, **o: keyed.dedup_ttl_stream(s, 90, **o), lambda d: folds.dedup_ttl(d, 90).select("seq", "decision")),
    "idempotency": (
        lambda s, **o: keyed.idempotency_stream(s, 60, 25, **o), lambda d: folds.idempotency(d, 60, 25).select("seq", "decision"),
    ),
    "source": (
        lambda s, **o: keyed.rate_limit_source_stream(s, 3, 60, **o),
        lambda d: folds.rate_limit_source(d, 3, 60).select("seq", F.when(F.col("within_limit"), "accept").otherwise("limited").alias("decision")),
    ),
    "address": (
        lambda s, **o: keyed.rate_limit_ip_stream(s, 4, **o),
        lambda d: folds.rate_limit_ip(d.withColumn("received_ms", F.col("received_epoch") * 1000), 4).select(
            "seq", F.when(F.col("within_ip_limit"), "accept").otherwise("limited").alias("decision")
        ),
    ),
}


@pytest.mark.parametrize("name", STREAMS)
def test_disorder_gives_the_answers_of_the_batch_fold(spark, tmp_path, name):
    """Rows up to two minutes out of order, over restarts; a last row moves the watermark past all."""
    stream, batch = STREAMS[name]
    rows = made(3, 240, 7)
    mixed = disordered(rows, 110, 4)
    end = (10_000, BASE + 1_000_000, *NIL)
    out, dropped = run(spark, tmp_path, [mixed[:120], mixed[120:], [end]], lambda s: stream(s, delay="2 minutes", order="event"))
    got = {r.seq: r.decision for r in out.collect() if r.seq < 10_000}
    assert dropped == 0
    assert got == {r.seq: r.decision for r in batch(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_every_late_row_has_a_decision(spark, tmp_path):
    """Days behind the watermark: judged where the state is there or never was, ``late`` where it is gone."""
    day = 86_400
    row = lambda seq, t, key: (seq, BASE + t, key, None, None, None)
    batches = [
        [row(1, 0, "a"), row(2, 10, "b")], [row(3, 5 * day, "c")], [row(4, 5 * day + 1, "z")],
        [row(5, 20, "a"), row(6, 5 * day - 5, "a"), row(7, 5 * day + 30, "c"), row(8, 1, "new")],
    ]
    for order in ("arrival", "event"):
        ends = [[row(9, 9 * day, "e")], [row(10, 9 * day + 1, "e")]] if order == "event" else []
        out, dropped = run(spark, tmp_path, batches + ends, lambda s, order=order: keyed.dedup_ttl_stream(s, 600, delay="1 minute", order=order))
        got = {r.seq: r.decision for r in out.collect() if r.seq < 9}
        assert dropped == 0
        assert got == {1: "accept", 2: "accept", 3: "accept", 4: "accept", 5: "late", 6: "accept", 7: "duplicate", 8: "accept"}


def test_late_rows_against_state_that_is_there(spark, tmp_path):
    row = lambda seq, t, key: (seq, BASE + t, key, None, None, None)
    batches = [[row(1, 1000, "a")], [row(2, 1500, "b")], [row(3, 1300, "a"), row(4, 900, "a"), row(5, 1450, "c")], [row(9, 90_000, "e")]]
    for order, early in (("arrival", "duplicate"), ("event", "late")):
        out, dropped = run(spark, tmp_path, batches, lambda s, order=order: keyed.dedup_ttl_stream(s, 600, delay="10 seconds", order=order))
        got = {r.seq: r.decision for r in out.collect() if r.seq < 9}
        assert dropped == 0 and got == {1: "accept", 2: "accept", 3: "duplicate", 4: early, 5: "accept"}


def test_state_is_removed(spark, tmp_path):
    """After the watermark is beyond its end, a key starts anew and its number is gone."""
    row = lambda seq, t, key: (seq, BASE + t, key, None, None, None)
    seen = []

    def build(stream):
        return keyed.dedup_ttl_stream(stream, 50, delay="5 seconds")

    folder = tmp_path / "one"
    base = spark.createDataFrame([], SCHEMA).schema
    for n, batch in enumerate([[row(i, i, f"k{i}") for i in range(20)], [row(50, 5000, "z")], [row(51, 5001, "z")]]):
        spark.createDataFrame(batch, base).coalesce(1).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(base).parquet(f"{folder}/in/*").withColumn("received_at", F.timestamp_seconds("received_epoch"))
        query = build(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        seen.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert seen[-1] < seen[0]


@pytest.mark.parametrize("limit", [None, 2])
def test_serve_as_one_stream_equals_the_batch(spark, tmp_path, limit):
    config = serve_config(ip_limit_per_minute=limit, source_limit=40, dedup_ttl_seconds=3 * 86_400, cooldown_seconds=36_000)
    fixtures.ready(spark)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = [tuple(r) for r in events.orderBy("ts", "event_id").collect()]
    folder = tmp_path / "serve"
    cuts = [0, 400, 700, len(rows)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:b], events.schema).coalesce(1).write.parquet(f"{folder}/in/{n}")
        stream = fixtures.requests_from(spark.readStream.schema(events.schema).parquet(f"{folder}/in/*"))
        decided = serve.decide_stream(stream, config)
        query = decided.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        assert keyed.late_rows(query) == 0
    want = serve.decide(fixtures.requests_from(events), config).collect()
    got = spark.read.parquet(f"{folder}/out").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len({r.reason for r in want}) > 5
