"""Steps whose cost must not follow the number of sources, row groups or rows of one key."""

import pandas as pd
from pyspark.sql import functions as F

from eventlane.functions import payload, signing, text
from eventlane.operators import delivery, reports
from eventlane.plans import serve
from eventlane.streaming import keyed
from workload import fixtures
from workload.queries import serve_config

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_not_shuffled_by_source(spark):
    text = plan(serve.examine(fixtures.requests(spark, SF_DIR), serve_config()).select("seq", "middle"))
    assert "BroadcastHashJoin" in text and "hashpartitioning(source" not in text


def test_requests_and_log_spread_over_all_cores(spark):
    for rows in (fixtures.requests(spark, SF_DIR), fixtures.envelopes_json(spark, SF_DIR)):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_document_is_parsed_once(spark):
    rows = spark.createDataFrame([("{}",)], "t string")
    text = rows.select(payload.parse_json("t").alias("doc"))._jdf.queryExecution().analyzed().toString()
    assert text.count("try_parse_json(") == 1


def analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_all_paths_are_read_in_one_walk(spark):
    rows = spark.createDataFrame([('{"a":{"b":1,"c":" x\\\\y "},"d":null}',), ('{"a":"s","d":"t"}',), ("[1]",)], "t string")
    paths = [("a", "b"), ("a", "c"), ("d",), ("e", "f")]
    df = rows.select(payload.as_tokens(payload.tokens_at(payload.parse_json("t"), paths)).alias("found"))
    assert str(payload.tokens_at("doc", paths)).count("variant_get(") == 1
    assert [[t and t["text"] for t in r.found] for r in df.collect()] == [["1", "x\\y", None, None], [None, None, "t", None], [None] * 4]


def test_paths_that_fit_in_no_struct_are_read_one_by_one(spark):
    rows = spark.createDataFrame([('{"a":{"b":1},"A":2,"x y":3}',)], "t string")
    for paths, found in (([("a",), ("a", "b")], [None, "1"]), ([("A",), ("a", "b")], ["2", "1"]), ([("x y",), ("A",)], ["3", "2"])):
        tokens = payload.as_tokens(payload.tokens_at(payload.parse_json("t"), paths))
        assert [t and t["text"] for t in rows.select(tokens.alias("t")).head().t] == found


def test_a_trimmed_value_is_named_once(spark):
    rows = spark.createDataFrame([(" sha256=A B ",), (" \u3000",), ("x",), (None,)], "t string")
    for column in (text.blank_to_null("t"), text.normalize_source("t"), signing.normalize_signature("t")):
        assert analyzed(rows.select(column)).count("t#") <= 2
    found = rows.select(text.blank_to_null("t").alias("b"), signing.normalize_signature("t").alias("s")).collect()
    assert [tuple(r) for r in found] == [("sha256=A B", "ab"), (None, ""), ("x", "x"), (None, None)]


def test_generators_are_given_finished_columns(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, why string")
    once = payload.computed_once(rows, twice=F.col("n") * 2)
    counts = (reports.Count("smash_egress_success_total", F.col("why").isNull(), {"adapter": F.col("why")}),
              reports.Count("smash_egress_failure_total", F.col("n") == 1, {"reason": F.col("why")}))
    hits = reports.metric_rows(rows, *counts)
    for df in (once, hits):
        made = [line for line in plan(df).splitlines() if "Generate inline" in line]
        assert len(made) == 1 and "struct(" not in made[0]
    assert [r.twice for r in once.collect()] == [2, 4]
    assert sorted((r.metric, r.reason) for r in hits.collect()) == [("smash_egress_failure_total", "a"), ("smash_egress_success_total", None)]


def test_only_requests_that_the_folds_saw_are_looked_up(spark):
    decided = serve.decide(fixtures.requests(spark, SF_DIR), serve_config())
    text_ = plan(decided.filter("status = 'rejected'").select("seq", "status"))
    assert "Window" not in plan(decided) and "Union" in text_
    accepted = decided.filter("status = 'accepted'")
    assert "Union" not in plan(accepted) and accepted.count() == decided.count() - decided.filter("status != 'accepted'").count()


def test_one_shuffle_and_sort_settles_the_steps(spark):
    text = plan(delivery.settle(fixtures.delivery_steps(spark, SF_DIR)))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("+- Sort [") == 1


def test_executed_steps_sorts_the_steps_once_in_a_task(spark):
    steps = fixtures.delivery_steps(spark, SF_DIR)
    assert plan(delivery.executed_steps(steps, delivery.settle(steps))).count("Window [") == 1


def test_rows_of_a_key_are_numbers_given_out_in_blocks():
    held = keyed._Rows()
    for start in (3, 0):
        held.add(pd.DataFrame({
            "fold_key": ["".join(("b", "a")), "a", "".join(("b", "a"))], "fold_time": [start, 5, start + 1], "at_us": [1, 2, 3],
            "seq": [start, start + 1, start + 2], "carried": [None] * 3,
        }))
    blocks = list(held.in_order(4))
    assert [len(b.codes) for b in blocks] == [4, 2] and all(b.carried is None for b in blocks)
    rows = [r for b in blocks for r in zip(held.named(b.codes), b.times.tolist(), b.seq.tolist())]
    assert rows == [("ba", 0, 0), ("ba", 1, 2), ("ba", 3, 3), ("ba", 4, 5), ("a", 5, 1), ("a", 5, 4)]


def test_state_goes_on_over_blocks(monkeypatch):
    """A key whose rows come in many blocks is judged as if they came in one."""
    times, rule = [0, 1, 5, 9, 10, 30, 31, 70], keyed.TtlRule(10)
    values = {}

    class State:
        def exists(self):
            return False

        def getValue(self, key):
            return values.get(key)

        def updateValue(self, key, value):
            values[key] = value

    judge = keyed.Judge(rule, "duplicate", 0, False)
    judge.values = judge.swept = State()
    judge._wake = lambda at: None
    whole = keyed._Rows.in_order
    monkeypatch.setattr(keyed._Rows, "in_order", lambda self: whole(self, 3))
    held = keyed._Rows()
    held.add(pd.DataFrame({"fold_key": ["k"] * 8, "fold_time": times, "at_us": times, "seq": range(8), "carried": ["c"] * 8}))
    out = pd.concat(judge._judged(held, 0))
    assert [t for t, d in zip(times, out["decision"]) if d == "accept"] == [0, 10, 30, 70]
    assert values == {("k",): (80,)} and set(out["carried"]) == {"c"}


def test_rows_without_a_time_come_last_of_their_key():
    held = keyed._Rows()
    held.add(pd.DataFrame({"fold_key": ["a", "a"], "fold_time": [None, 7.0], "at_us": [None, 1.0], "seq": [0, 1], "carried": [None, None]}))
    held.add(pd.DataFrame({"fold_key": ["a"], "fold_time": [3], "at_us": [1], "seq": [2], "carried": ["c"]}))
    (block,) = held.in_order()
    assert block.seq.tolist() == [2, 1, 0] and block.times[:2].tolist() == [3, 7] and block.carried.tolist() == ["c", None, None]
