"""Envelopes, routing, delivery, settling, relay and sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from eventlane.operators import delivery, envelopes, health, relay, reports, routing
from eventlane.plans import fanout, serve
from eventlane.sources import parsers, readers, writers
from eventlane.sources.batches import BatchSink, read_batches


def values(spark, *texts):
    rows = [(i, None if t is None else bytearray(t.encode())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "seq int, value binary")


ENVELOPE = {"id": "1", "source": "github", "event_type": "push", "received_at": "2024-01-01T00:00:00Z", "payload": {"n": 1}}


def test_decode_rules(spark):
    def changed(**fields):
        return json.dumps({**ENVELOPE, **fields})

    cases = [
        (changed(), None), (changed(meta=None), None), (changed(meta={}), None), (changed(extra=1), None), (changed(payload=None), None),
        (changed(meta={"trace_id": None, "flags": []}), None), (changed(meta={"flags": ["a"]}), None), (changed(id=5), "invalid envelope"),
        (changed(meta={"flags": None}), "invalid envelope"), (changed(meta={"flags": [1]}), "invalid envelope"), (changed(meta="x"), "invalid envelope"),
        (changed(meta={"trace_id": 1}), "invalid envelope"), (json.dumps({k: v for k, v in ENVELOPE.items() if k != "payload"}), "invalid envelope"),
        ("[1]", "invalid envelope"), ("{", "invalid json"), (None, "missing payload"),
    ]
    got = envelopes.decode_envelope(values(spark, *(c for c, _ in cases))).orderBy("seq").select("decode_error").collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_encode_leaves_out_what_is_empty(spark):
    texts = [json.dumps(ENVELOPE), json.dumps({**ENVELOPE, "meta": {"flags": [], "route_key": "r"}}), json.dumps({**ENVELOPE, "payload": None})]
    decoded = envelopes.decode_envelope(values(spark, *texts)).orderBy("seq")
    out = [json.loads(r[0]) for r in decoded.select(envelopes.encode_envelope("envelope")).collect()]
    assert out == [ENVELOPE, {**ENVELOPE, "meta": {"route_key": "r"}}, {**ENVELOPE, "payload": None}]


def test_dead_letter_round_trip(spark):
    decoded = envelopes.decode_envelope(values(spark, json.dumps(ENVELOPE)))
    record = decoded.select("seq", envelopes.encode_dlq(F.lit("2024-01-02T00:00:00Z"), F.lit("boom"), F.col("envelope")).cast("binary").alias("value"))
    back = envelopes.decode_dlq(record)
    assert back.select("failed_at", "error", "envelope.id", "decode_error").collect() == [("2024-01-02T00:00:00Z", "boom", "1", None)]
    assert relay.replay_dlq(back, "core").select("topic", "key").collect() == [("core", "1")]
    assert envelopes.decode_dlq(values(spark, json.dumps(ENVELOPE))).select("decode_error").collect() == [("invalid dead letter",)]


def test_frames_and_calls(spark):
    frames = ['{"payload":{"a":1},"event_type":"t"}', '{"payload":null,"x":1}', '{"a":1}', '{"payload":{"a":1},"event_type":5}', "[1,2]", "nope"]
    got = parsers.parse_ws_frame(values(spark, *frames)).orderBy("seq").select(F.to_json("payload"), "event_type", "parse_error").collect()
    assert [tuple(r) for r in got] == [
        ('{"a":1}', "t", None), ('{"payload":null,"x":1}', None, None), ('{"a":1}', None, None),
        ('{"event_type":5,"payload":{"a":1}}', None, None), ("[1,2]", None, None), (None, None, "parse websocket frame JSON"),
    ]
    calls = ['{"source":"github","payload":{"a":1}}', '{"source":1,"payload":{}}', '{"source":"x"}', '{"source":"x","payload":null,"event_type":null}']
    got = parsers.parse_mcp_call(values(spark, *calls)).orderBy("seq").select("source", "event_type", "parse_error").collect()
    assert [tuple(r) for r in got] == [
        ("github", None, None), (None, None, "missing or mistyped field"), (None, None, "missing or mistyped field"), ("x", None, None),
    ]


def test_meta_and_ids(spark):
    null = F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    row = spark.range(1).select(
        envelopes.build_meta(null, null, null, none).isNull(), envelopes.build_meta(null, null, F.lit("r"), none).isNull(),
        envelopes.uuid_text(F.lit("a"), F.lit("b")), envelopes.uuid_text(F.lit("a"), F.lit("b")),
    ).collect()[0]
    assert row[0] and not row[1] and row[2] == row[3]
    assert row[2][14] == "4" and row[2][19] in "89ab" and [len(p) for p in row[2].split("-")] == [8, 4, 4, 4, 12]


ROUTES = (
    routing.SmashRoute("one", "t.*", ("push",), (routing.Destination("opt", False), routing.Destination("req"))),
    routing.SmashRoute("two", "t.a", (), (routing.Destination("req2"),)),
    routing.SmashRoute("idle", "t.b", ("view",), ()),
)


def test_many_routes_match_as_few_do(spark):
    df = spark.createDataFrame([(1, "t.a", "push"), (2, "t.b", "push"), (3, "t.b", "view"), (4, "z", None)], "id int, topic string, event_type string")
    filler = tuple(routing.SmashRoute(f"f{i}", f"none{i}", (), (routing.Destination("x"),)) for i in range(routing.INLINE_ROUTES))
    few = routing.expand_destinations(routing.route_smash(df, ROUTES)).collect()
    many = routing.expand_destinations(routing.route_smash(df, ROUTES + filler)).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))
    assert [(r.id, r.step, r.adapter_id) for r in sorted(few)] == [(1, 0, "req"), (1, 1, "opt"), (1, 2, "req2"), (2, 0, "req"), (2, 1, "opt")]


@pytest.mark.parametrize("policy,outcome", [((False, None), "error"), ((True, "discard"), "commit"), ((True, "dlq"), "dlq"), ((True, None), "error")])
def test_no_output_policies(spark, policy, outcome):
    df = spark.createDataFrame([(3, "t.b", "view"), (4, "z", "push")], "id int, topic string, event_type string")
    out = routing.no_output(routing.route_smash(df, ROUTES), routing.NoOutputPolicy(*policy)).orderBy("id").collect()
    assert [r.outcome for r in out] == [outcome, outcome]
    if policy != (True, None):
        assert out[0].reason.startswith("no active smash destinations") and out[1].reason.startswith("no matching smash route")


def test_settle_first_required_failure(spark):
    steps = [
        ("a", 0, "r1", "x", True, False, None), ("a", 1, "r1", "y", False, True, "e1"), ("a", 2, "r2", "z", True, True, "e2"),
        ("a", 3, "r2", "w", True, True, "e3"), ("b", 0, "r1", "x", True, False, None), ("b", 1, "r1", "y", False, True, "e1"),
    ]
    df = spark.createDataFrame(steps, "id string, step int, route_id string, adapter_id string, required boolean, failed boolean, error string")
    settled = delivery.settle(df)
    assert [tuple(r)[:4] for r in settled.orderBy("id").collect()] == [
        ("a", "dlq", 2, "required destination adapter 'z' failed on route 'r2': e2"), ("b", "commit", None, None),
    ]
    assert [(r.id, r.step) for r in delivery.executed_steps(df, settled).orderBy("id", "step").collect()] == [
        ("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1),
    ]


class Replies:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), 0

    def __call__(self, key, body):
        self.calls += 1
        answer = self.answers[min(self.calls, len(self.answers)) - 1]
        if isinstance(answer, Exception):
            raise answer
        return answer


@pytest.mark.parametrize("answers,wanted", [
    ((200,), [(1, 200, None, None)]), ((404,), [(1, 404, None, None)]), ((503, 429, 200), [(1, 503, None, 1), (2, 429, None, 2), (3, 200, None, None)]),
    ((TimeoutError(), 200), [(1, None, "timeout", 1), (2, 200, None, None)]), ((ConnectionError(), 404), [(1, None, "connection", 1), (2, 404, None, None)]),
    ((ValueError(),), [(1, None, "request: ValueError", None)]), ((500,), [(1, 500, None, 1), (2, 500, None, 2), (3, 500, None, None)]),
])
def test_retry_classes(answers, wanted):
    paused = []
    assert delivery.attempt_rows("k", "b", Replies(*answers), delivery.RetryPolicy(3), paused.append) == wanted
    assert len(paused) == len(wanted) - 1
    frames = delivery.attempt_rows("k", "b", Replies(404, 200), delivery.RetryPolicy(2, 0.2, retry_all=True), paused.append)
    assert [f[1] for f in frames] == [404, 200]


def test_keys_and_shapes(spark):
    env = envelopes.decode_envelope(values(spark, json.dumps({**ENVELOPE, "payload": {"t": "é" * 100}})))
    row = env.select(
        delivery.shape_http_payload(F.col("envelope"), 128), delivery.kafka_key(F.col("envelope"), "source"), delivery.kafka_key(F.col("envelope"), "none"),
        delivery.shape_tool_call(F.col("envelope"), "t", jsonrpc=True),
    ).collect()[0]
    body = json.loads(row[0])
    assert body["payload"].endswith("...") and len(body["payload"].encode()) <= 128 and body["eventType"] == "push"
    assert row[1] == "github" and row[2] is None and json.loads(row[3])["params"]["arguments"]["envelope"]["id"] == "1"
    with pytest.raises(ValueError):
        delivery.kafka_key(F.col("envelope"), "other")


def sender():
    def send(key, body):
        return 500 if json.loads(body)["id"] == "2" else 200

    return send


def test_fan_out_batch_end_to_end(spark, tmp_path):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    texts = [json.dumps({**ENVELOPE, "id": str(i), "event_type": t}) for i, t in enumerate(("push", "view", "push", "other"))] + ["bad"]
    records = values(spark, *texts).withColumn("topic", F.lit("t.b"))
    config = fanout.FanoutConfig(
        ROUTES,
        (fanout.Adapter("req", sender, policy=delivery.RetryPolicy(2, 0, 0)), fanout.Adapter("opt", sender, policy=delivery.RetryPolicy(1)), fanout.Adapter("req2", sender)),
        routing.NoOutputPolicy(True, "dlq"),
    )
    dead, broken = str(tmp_path / "dead"), str(tmp_path / "bad")
    settled = fanout.process_batch(
        records, config, str(tmp_path / "attempts"), 0,
        lambda df: writers.write_dlq(df, "dlq", table_path=dead), lambda df: writers.quarantine(df, broken),
    )
    assert sorted((r.id or "", r.outcome) for r in settled.collect()) == [("", "undecodable"), ("0", "commit"), ("1", "dlq"), ("2", "dlq"), ("3", "dlq")]
    lost = [json.loads(r.value) for r in spark.read.parquet(dead).collect()]
    assert {d["envelope"]["id"]: d["error"].split(" for ")[0] for d in lost} == {
        "1": "no active smash destinations", "3": "no matching smash route",
        "2": "required destination adapter 'req' failed on route 'one': forward failed after 2 attempts: destination returned 500",
    }
    assert spark.read.parquet(broken).select("decode_error").collect() == [("invalid json",)]


def strict():
    """Takes a delivery unless its payload asks for a refusal."""

    def send(key, body):
        return 404 if json.loads(body)["payload"].get("refuse") else 200

    return send


def fan_out(spark, tmp_path, records, policy=routing.NoOutputPolicy(), **sinks):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    order = (routing.SmashRoute("r", "t.*", ("push",), (routing.Destination("first"), routing.Destination("later", False))),)
    config = fanout.FanoutConfig(order, tuple(fanout.Adapter(a, strict, policy=delivery.RetryPolicy(1)) for a in ("first", "later")), policy)
    path = str(tmp_path / "attempts")
    kept = {}
    account = fanout.process_batch(records, config, path, 0, lambda df: kept.update(dead=df.collect()), lambda df: kept.update(bad=df.collect()), **sinks)
    return account.collect(), kept, fanout.read_attempts(spark, path).collect()


def log_rows(spark, *rows):
    texts = [json.dumps({**ENVELOPE, "id": i, "event_type": t, "payload": p}) for i, t, p in rows]
    return values(spark, *texts).withColumn("topic", F.lit("t.a"))


def test_records_of_equal_id_are_judged_apart(spark, tmp_path):
    rows = log_rows(spark, ("7", "push", {}), ("7", "push", {"refuse": True}), ("7", "push", {}))
    account, kept, _ = fan_out(spark, tmp_path, rows)
    assert sorted((r.id, r.outcome) for r in account) == [("7", "commit"), ("7", "commit"), ("7", "dlq")]
    assert len(kept["dead"]) == 1 and "refuse" in str(kept["dead"][0].envelope)


def test_nothing_is_sent_after_a_required_failure(spark, tmp_path):
    rows = log_rows(spark, ("1", "push", {}), ("2", "push", {"refuse": True}))
    account, _, attempts = fan_out(spark, tmp_path, rows)
    assert sorted((r.id, r.adapter_id) for r in attempts) == [("1", "first"), ("1", "later"), ("2", "first")]
    assert {r.id: r.outcome for r in account} == {"1": "commit", "2": "dlq"}


def test_events_without_destination_are_never_lost(spark, tmp_path):
    rows = log_rows(spark, ("1", "push", {}), ("2", "view", {}))
    with pytest.raises(RuntimeError, match="1 events of batch 0 reach no destination"):
        fan_out(spark, tmp_path / "a", rows)
    caught = []
    account, _, _ = fan_out(spark, tmp_path / "b", rows, write_unreached=lambda df: caught.extend(df.collect()))
    assert {r.id: r.outcome for r in account} == {"1": "commit", "2": "error"} and [r.id for r in caught] == ["2"]
    account, _, _ = fan_out(spark, tmp_path / "c", rows, routing.NoOutputPolicy(True, "discard"))
    assert {r.id: r.outcome for r in account} == {"1": "commit", "2": "discard"}


def test_a_batch_leaves_no_work_files(spark, tmp_path):
    import glob

    fan_out(spark, tmp_path, log_rows(spark, ("1", "push", {})))
    for step, count in (("routed", 0), ("bodies", 0), ("attempts", 1), ("accounts", 1)):
        assert len(glob.glob(f"{tmp_path}/attempts/{step}/data/query=fanout/batch_id=0/run=*")) == count


def counting(folder):
    """A receiver that leaves a file for each request; it refuses what asks for it."""

    def make():
        def send(key, body):
            import uuid

            with open(f"{folder}/{key.replace('/', '-')}.{uuid.uuid4().hex}", "w"):
                return 404 if json.loads(body)["payload"].get("refuse") else 200

        return send

    return make


@pytest.mark.parametrize("broken", ["accounts", "dead", "undecodable", "unreached", "finished", None])
def test_a_batch_that_crashed_runs_again(spark, tmp_path, monkeypatch, broken):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    records = log_rows(spark, ("1", "push", {}), ("2", "push", {"refuse": True}), ("3", "view", {})).unionByName(
        values(spark, "bad").withColumn("topic", F.lit("t.a"))
    )
    (tmp_path / "sent").mkdir()
    order = (routing.SmashRoute("r", "t.*", ("push",), (routing.Destination("first"),)),)
    config = fanout.FanoutConfig(order, (fanout.Adapter("first", counting(str(tmp_path / "sent")), policy=delivery.RetryPolicy(1)),))
    sinks = [BatchSink(f"{tmp_path}/{name}", "q") for name in ("dead", "undecodable", "unreached")]

    def run(rows):
        return fanout.process_batch(rows, config, str(tmp_path / "steps"), 4, *sinks, query="q")

    replace = BatchSink.replace

    def crashing(self, df, batch_id):
        done = replace(self, df, batch_id)
        if broken and self.path.endswith(f"/{broken}"):
            raise OSError("lost the driver")
        return done

    with monkeypatch.context() as patched:
        patched.setattr(BatchSink, "replace", crashing)
        if broken:
            with pytest.raises(OSError):
                run(records)
    for layout in (records.repartition(3), records):
        account = run(layout)
        assert sorted((r.id or "", r.outcome) for r in account.collect()) == [("", "undecodable"), ("1", "commit"), ("2", "dlq"), ("3", "error")]
        assert sorted(name.split(".")[0] for name in os.listdir(tmp_path / "sent")) == ["1-0", "2-0"]
        dead, undecodable, unreached = (read_batches(spark, sink.path).collect() for sink in sinks)
        assert [r.envelope.id for r in dead] == ["2"] and [r.decode_error for r in undecodable] == ["invalid json"] and [r.id for r in unreached] == ["3"]
        assert {(r.query, r.batch_id) for r in dead} == {("q", 4)}


def test_a_refused_batch_is_routed_anew(spark, tmp_path):
    rows = log_rows(spark, ("1", "push", {}), ("2", "view", {}))
    with pytest.raises(RuntimeError):
        fan_out(spark, tmp_path, rows)
    with pytest.raises(ValueError, match="no batch was committed"):
        fanout.read_attempts(spark, str(tmp_path / "attempts"))
    account, _, attempts = fan_out(spark, tmp_path, rows, routing.NoOutputPolicy(True, "dlq"))
    assert {r.id: r.outcome for r in account} == {"1": "commit", "2": "dlq"} and len(attempts) == 2


def test_publish_policy():
    options = writers.kafka_options("broker:9092", 5, 200, 5000)
    assert (options["kafka.retries"], options["kafka.retry.backoff.ms"], options["kafka.retry.backoff.max.ms"]) == ("4", "200", "5000")
    assert writers.kafka_options("broker:9092", 1)["kafka.retries"] == "0"
    with pytest.raises(ValueError):
        writers.kafka_options("broker:9092", 0)


def test_batch_sink(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = spark.range(6).withColumn("v", F.lit("old"))
    one, two = BatchSink(path, "007"), BatchSink(path, "1e3")
    assert one.committed(spark, 0) is None
    one.replace(rows, 0)
    one.replace(rows.where("id < 2").withColumn("v", F.lit("new")), 0)
    one.replace(rows.where("false"), 1)
    two.replace(rows.where("id = 5").withColumn("more", F.lit(1)), 0)
    lost = one.replace(rows, 2)  # a run that failed leaves files, but no manifest
    lost.write.parquet(f"{path}/data/query=007/batch_id=3/run=r-failed")
    read = sorted((r.query, r.batch_id, r.id, r.v, r.more) for r in read_batches(spark, path).where("batch_id <> 2").collect())
    assert read == [("007", 0, 0, "new", None), ("007", 0, 1, "new", None), ("1e3", 0, 5, "old", 1)]
    assert one.committed(spark, 1).count() == 0 and one.once(lambda: 1 / 0, spark, 0).count() == 2
    assert read_batches(spark, path, ["1e3"]).count() == 1
    plan = read_batches(spark, path)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    one.vacuum(spark, 0)
    assert one.committed(spark, 0).count() == 2 and len(os.listdir(f"{path}/data/query=007/batch_id=0")) == 1
    with pytest.raises(ValueError, match="place of a batch"):
        one.replace(rows.withColumn("Run", F.lit(1)), 5)
    with pytest.raises(ValueError, match="named by letters"):
        BatchSink(path, "a/b")


def test_a_deadline_leaves_retries_pending():
    def down(key, body):
        raise TimeoutError

    import time

    tries = delivery.attempt_rows("k", "b", down, delivery.RetryPolicy(5, 10, 30), lambda s: None, time.monotonic() + 15)
    assert 2 <= len(tries) <= 5
    tries = delivery.attempt_rows("k", "b", down, delivery.RetryPolicy(5, 10, 30), lambda s: None, time.monotonic())
    assert len(tries) == 1 and tries[0][3] == 10


def test_fan_out_stream(spark, tmp_path):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    source = str(tmp_path / "in")
    texts = [json.dumps({**ENVELOPE, "id": str(i), "event_type": "push"}) for i in range(4)]
    values(spark, *texts).withColumn("topic", F.lit("t.b")).select("topic", "value").write.parquet(source)
    stream = spark.readStream.schema("topic string, value binary").parquet(source)
    config = fanout.FanoutConfig(ROUTES, (fanout.Adapter("req", sender, policy=delivery.RetryPolicy(1)), fanout.Adapter("opt", sender, policy=delivery.RetryPolicy(1))))
    dead, done = str(tmp_path / "dead"), str(tmp_path / "done")
    query = fanout.start(
        stream, config, str(tmp_path / "attempts"), str(tmp_path / "state"),
        lambda df: writers.write_dlq(df, "dlq", table_path=dead), lambda df: writers.quarantine(df, str(tmp_path / "bad")),
        lambda df: writers.write_table(df, done),
    )
    query.awaitTermination()
    assert sorted((r.id, r.outcome) for r in spark.read.parquet(done).select("id", "outcome").collect()) == [("0", "commit"), ("1", "commit"), ("2", "dlq"), ("3", "commit")]
    assert spark.read.parquet(dead).count() == 1


def test_serve_ids_are_repeatable(spark):
    from workload import fixtures, queries

    requests = fixtures.requests(spark, "/root/testdata/sf0.001")
    first, _ = serve.serve(requests, queries.serve_config())
    again, _ = serve.serve(requests.repartition(5), queries.serve_config())
    assert sorted(r.key for r in first.collect()) == sorted(r.key for r in again.collect())


def test_serve_with_client_limit(spark):
    from workload import fixtures, queries

    decided = serve.decide(fixtures.requests(spark, "/root/testdata/sf0.001"), queries.serve_config(ip_limit_per_minute=1, max_payload_bytes=150))
    codes = {r.http_code: r["count"] for r in decided.groupBy("http_code").count().collect()}
    assert codes[413] > 0 and sum(codes.values()) == 1000


def test_topic_table_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("a", "k", "v1"), ("b", "k", "v2"), ("c", None, "v3")], "topic string, key string, value string")
    path = str(tmp_path / "log")
    writers.write_topic(records, table_path=path)
    log = readers.read_topics(spark, ["a", "c"], table_path=path)
    assert sorted(r.topic for r in log.collect()) == ["a", "c"]
    assert "PartitionFilters: [topic" in log._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        readers.read_topics(spark, ["a"])


def test_stream_to_topic_table(spark, tmp_path):
    source = str(tmp_path / "src")
    spark.createDataFrame([("t.a", bytearray(json.dumps(ENVELOPE).encode())), ("t.a", bytearray(b"x"))], "topic string, value binary").write.parquet(source)
    stream = spark.readStream.schema("topic string, value binary").parquet(source)
    records = stream.select("topic", F.lit(None).cast("binary").alias("key"), "value")
    forwarded, _ = relay.relay_fan_in(records, "core")
    query = writers.write_topic(forwarded, table_path=str(tmp_path / "out"), checkpoint=str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_reading_files(spark, tmp_path):
    (tmp_path / "replay").mkdir()
    (tmp_path / "replay" / "a.json").write_text(json.dumps(ENVELOPE, indent=1))
    (tmp_path / "replay" / "b.json").write_text("{}")
    got = readers.read_replay_files(spark, str(tmp_path / "replay"))
    assert sorted(str(r[0]) for r in got.select("decode_error").collect()) == ["None", "invalid envelope"]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "unit.log").write_text("2024-01-01T00:00:00Z a\n2024-01-03T00:00:00Z b\nplain\n")
    logs = readers.read_logs(spark, str(tmp_path / "logs"), since="2024-01-02", until="2024-01-04")
    assert [(r.source, r.line) for r in logs.orderBy("line_no").collect()] == [("unit", "2024-01-03T00:00:00Z b"), ("unit", "plain")]
    beat = {"host": "h", "timestamp": "2024-01-01T00:00:00Z", "services": {"x": "active"}, "vms": {"kafka_brokers": []}}
    (tmp_path / "hb.json").write_text(json.dumps(beat))
    beats = readers.read_heartbeats(spark, str(tmp_path / "hb.json"))
    rules = {r.event for r in health.health_rules(beats, health.HealthConfig("relay.service", "b@{id}.service", "10.0.0.1", ("net.service",))).collect()}
    assert rules == {"relay_port_down", "required_service_down_net.service"}


def test_stage_gap_stream(spark, tmp_path):
    schema = "id string, timestamp timestamp"
    for name, rows in (("a", [("1", 0), ("2", 1), ("3", 5000)]), ("b", [("2", 2), ("9", 6000)])):
        df = spark.createDataFrame(rows, "id string, t bigint").select("id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("timestamp"))
        df.write.parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(schema).parquet(str(tmp_path / n)) for n in "ab")
    gaps = relay.reconcile_stages_stream(a, b)
    query = gaps.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start(str(tmp_path / "o"))
    query.awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["1"]


def test_windowed_metrics_and_percentiles(spark):
    df = spark.createDataFrame([("smash_dlq_total", None, None, "t", "x", 5), ("smash_dlq_total", None, None, "t", "y", 65), ("other", None, None, "t", None, 5)],
                               "metric string, adapter string, source string, topic string, reason string, at bigint")
    counted = reports.metrics(df.withColumn("received_at", F.timestamp_seconds("at")), window="1 minute")
    assert sorted((r.reason, r.value) for r in counted.collect()) == [(None, 1), (None, 1)]
    lat = spark.range(1, 101).selectExpr("'a' as k", "id as latency_ms")
    assert reports.latency_percentiles(lat, ["k"]).collect() == [("a", 50, 95, 99)]
