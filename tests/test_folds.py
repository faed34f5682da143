"""Keyed folds against plain sequential stores, in batch and as streams."""

import os
import random
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from eventlane.operators import folds
from eventlane.streaming import keyed


class Store:
    """Sequential model: two maps of key to expiry."""

    def __init__(self, ttl, cooldown):
        self.ttl, self.cooldown, self.dedup, self.cool = ttl, cooldown, {}, {}

    def check(self, dedup, cool, now):
        if not dedup:
            return "accept"
        if self.dedup.get(dedup, -1 << 62) > now:
            return "duplicate"
        self.dedup[dedup] = now + self.ttl
        if not cool:
            return "accept"
        if self.cool.get(cool, -1 << 62) > now:
            return "cooldown"
        self.cool[cool] = now + self.cooldown
        return "accept"


def test_store_steps():
    store = Store(60, 30)
    assert [store.check("d", "c", t) for t in (0, 10, 60)] == ["accept", "duplicate", "accept"]
    store = Store(1, 30)
    assert [store.check(k, "c", t) for k, t in (("a", 0), ("b", 10), ("c", 31))] == ["accept", "cooldown", "accept"]


def events(seed, n=3000, hot=0.4):
    """Random rows where one key holds a large share."""
    rng = random.Random(seed)
    rows, now = [], 0
    for seq in range(n):
        now += rng.choice((0, 0, 1, 2, 7))
        dedup = "hot" if rng.random() < hot else rng.choice(("", None, *(f"k{rng.randrange(200)}" for _ in range(4))))
        cool = "warm" if rng.random() < hot else rng.choice(("", None, f"c{rng.randrange(40)}"))
        rows.append((seq, now, dedup, cool))
    return rows


@pytest.mark.parametrize("seed,ttl,cooldown", [(1, 50, 20), (2, 7, 300), (3, 0, 5), (4, 1000, 1)])
def test_idempotency_equals_store(spark, seed, ttl, cooldown):
    rows = events(seed)
    store = Store(ttl, cooldown)
    wanted = [(seq, store.check(d, c, t)) for seq, t, d, c in rows]
    df = spark.createDataFrame(rows, "seq bigint, received_epoch bigint, dedup_key string, cooldown_key string")
    got = folds.idempotency(df, ttl, cooldown).select("seq", "decision").collect()
    assert sorted(map(tuple, got)) == wanted
    simple = folds.dedup_ttl(df, ttl).select("seq", "decision").collect()
    assert sorted(map(tuple, simple)) == [(s, "duplicate" if d == "duplicate" else "accept") for s, d in wanted]


def test_fold_state_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, i, "k" if i < 40 else "m", None) for i in range(80)]
        df = spark.createDataFrame(rows, "seq bigint, received_epoch bigint, dedup_key string, cooldown_key string")
        got = folds.dedup_ttl(df, 10).filter("decision = 'accept'").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.seq for r in got] == [0, 10, 20, 30, 40, 50, 60, 70]


def test_source_limit(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate((60, 60, 60, 120))], "seq bigint, received_epoch bigint, source string")
    assert [r.within_limit for r in folds.rate_limit_source(df, 2).orderBy("seq").collect()] == [True, True, False, True]
    assert folds.rate_limit_source(df, 0).filter("within_limit").count() == 0


class Bucket:
    """Sequential model of the token bucket."""

    def __init__(self, limit):
        self.period, self.burst, self.at = max(1, 60_000 // limit), limit, {}

    def allow(self, ip, now):
        tat = self.at.get(ip, now + self.period)
        if now < tat - self.period * self.burst:
            return False
        self.at[ip] = max(tat, now) + self.period
        return True


def arrivals(seed, n=4000):
    rng = random.Random(seed)
    rows, now = [], 0
    for seq in range(n):
        now += rng.choice((0, 0, 0, 40, 400, 9000))
        rows.append((seq, now, "hot" if rng.random() < 0.5 else f"ip{rng.randrange(5)}"))
    return rows


@pytest.mark.parametrize("limit", [1, 3, 20, 100])
def test_ip_limit_equals_bucket(spark, limit):
    rows = arrivals(limit)
    bucket = Bucket(limit)
    wanted = [(seq, bucket.allow(ip, t)) for seq, t, ip in rows]
    df = spark.createDataFrame(rows, "seq bigint, received_ms bigint, client_ip string")
    got = folds.rate_limit_ip(df, limit).select("seq", "within_ip_limit").collect()
    assert sorted(map(tuple, got)) == wanted


def test_alert_throttle(spark):
    rows = [(1, "a b", 0), (2, "a/b", 299), (3, "a_b", 300), (4, "other", 10)]
    df = spark.createDataFrame(rows, "seq bigint, event string, epoch bigint")
    got = folds.alert_throttle(df).select("seq", "sent").collect()
    assert sorted(map(tuple, got)) == [(1, True), (2, False), (3, True), (4, True)]


@pytest.mark.parametrize("limit", [5, 5000, 1_000_000])
def test_hot_bucket_is_cut_before_the_shuffle(spark, capsys, limit):
    df = spark.range(10**9).selectExpr("id as seq", "id div 500 as received_epoch", "cast(id % 2 as string) as source")
    folds.rate_limit_source(df, limit).explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") >= 2


def test_large_limits(spark):
    df = spark.range(0, 20_000, 1, 7).selectExpr("id as seq", "5 as received_epoch", "if(id % 10 = 0, 'a', 'b') as source")
    got = folds.rate_limit_source(df, 5000).where("within_limit").groupBy("source").agg(F.count("*"), F.max("seq")).collect()
    assert sorted(map(tuple, got)) == [("a", 2000, 19_990), ("b", 5000, 5555)]


@pytest.mark.parametrize("ttl", [1, 7, 40, 5000])
def test_sliced_keys_equal_whole_keys(spark, monkeypatch, ttl):
    """Dense runs, gaps and single instants, cut into slices; every key takes that way."""
    draw = random.Random(ttl)
    rows = []
    for key in ("dense", "gaps", "one", "mixed"):
        t = 1_000_000
        for _ in range({"one": 1}.get(key, 1500)):
            t += draw.choice({"dense": [0, 1, 1, 2], "gaps": [1, 90], "one": [0], "mixed": [0, 1, 3, ttl, 9 * ttl]}[key])
            rows.append((key, t, len(rows), f"c{len(rows)}"))
    df = spark.createDataFrame(rows, "fold_key string, fold_time bigint, seq bigint, ck string")
    whole = sorted(map(tuple, folds.ttl_accepted(df, ttl, carry="ck").collect()))
    monkeypatch.setattr(folds, "HOT_INSTANTS", 1)
    assert sorted(map(tuple, folds.ttl_accepted(df, ttl, carry="ck").collect())) == whole
    monkeypatch.setattr(folds, "SLICE_SECONDS", 3)
    monkeypatch.setattr(folds, "HOT_INSTANTS", 2)
    assert sorted(map(tuple, folds.ttl_accepted(df, ttl, carry="ck").collect())) == whole
    want, expiry = [], {}
    for key, t, seq, ck in rows:
        if t >= expiry.get(key, 0):
            want.append((key, t, seq, ck))
            expiry[key] = t + ttl
    assert whole == sorted(want)


# Streams start with a watermark of 1970, so their rows must be later.
BASE = 1_700_000_000


# --- streams --------------------------------------------------------------------


def run_stream(spark, folder, rows, schema, sizes, build, restart=False):
    """Feed rows file by file (one file per micro-batch) and collect the output."""
    source, out, state = folder / "in", folder / "out", folder / "state"
    start, files = 0, 0
    for size in sizes:
        part = rows[start:start + size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        start += size
        files += 1
        if restart:
            step(spark, source, out, state, schema, build)
    step(spark, source, out, state, schema, build)
    return spark.read.parquet(str(out))


def step(spark, source, out, state, schema, build):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (
        build(stream.withColumn("received_at", F.timestamp_seconds("received_epoch")))
        .writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out))
    )
    query.awaitTermination()


@pytest.mark.parametrize("restart", [False, True])
def test_stream_dedup_equals_batch(spark, tmp_path, restart):
    rows = [(s, BASE + t * 10, d or "none") for s, t, d, _ in events(9, 400)]
    schema = "seq bigint, received_epoch bigint, dedup_key string"
    sizes = (150, 250) if restart else (400,)
    out = run_stream(spark, tmp_path, rows, schema, sizes, lambda s: keyed.dedup_ttl_stream(s, 500), restart)
    batch = folds.dedup_ttl(spark.createDataFrame(rows, schema), 500)
    assert sorted(map(tuple, out.select("seq", "decision").collect())) == sorted(map(tuple, batch.select("seq", "decision").collect()))


def test_stream_limits_equal_batch(spark, tmp_path):
    rows = [(s, BASE + t, "s1" if s % 3 else "s2") for s, t, _, _ in events(11, 300)]
    schema = "seq bigint, received_epoch bigint, source string"
    out = run_stream(spark, tmp_path, rows, schema, (120, 180), lambda s: keyed.rate_limit_source_stream(s, 4))
    batch = folds.rate_limit_source(spark.createDataFrame(rows, schema), 4)
    got = out.select("seq", (F.col("decision") == "accept").alias("w")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.select("seq", "within_limit").collect()))


def test_stream_ip_limit_equals_bucket(spark, tmp_path):
    rows = [(s, BASE + t // 1000, BASE * 1000 + t, ip) for s, t, ip in arrivals(5, 300)]
    schema = "seq bigint, received_epoch bigint, received_ms bigint, client_ip string"
    out = run_stream(spark, tmp_path, rows, schema, (100, 200), lambda s: keyed.rate_limit_ip_stream(s, 3))
    bucket = Bucket(3)
    wanted = [(s, bucket.allow(ip, t)) for s, _, t, ip in rows]
    got = out.select("seq", (F.col("decision") == "accept").alias("w")).collect()
    assert sorted(map(tuple, got)) == wanted


def test_stream_cooldown_and_throttle(spark, tmp_path):
    rows = [(i, BASE + t, k) for i, (t, k) in enumerate([(0, "a b"), (10, "a/b"), (31, "a b"), (40, "c"), (61, "a b")])]
    schema = "seq bigint, received_epoch bigint, cooldown_key string"
    out = run_stream(spark, tmp_path / "c", rows, schema, (2, 3), lambda s: keyed.cooldown_stream(s, 30))
    assert sorted(map(tuple, out.select("seq", "decision").collect())) == [
        (0, "accept"), (1, "accept"), (2, "accept"), (3, "accept"), (4, "accept"),
    ]
    throttled = run_stream(
        spark, tmp_path / "t", rows, schema, (2, 3),
        lambda s: keyed.alert_throttle_stream(s, 30, "cooldown_key", "received_epoch", "received_at"),
    )
    assert [d for _, d in sorted(map(tuple, throttled.select("seq", "decision").collect()))] == [
        "accept", "suppressed", "accept", "accept", "accept",
    ]


def test_blank_keys_pass_a_stream(spark, tmp_path):
    rows = [(1, BASE, "k"), (2, BASE + 1, ""), (3, BASE + 2, None), (4, BASE + 3, "k")]
    schema = "seq bigint, received_epoch bigint, dedup_key string"
    out = run_stream(spark, tmp_path, rows, schema, (4,), lambda s: keyed.dedup_ttl_stream(s, 500, carry=("received_epoch",)))
    batch = folds.dedup_ttl(spark.createDataFrame(rows, schema), 500)
    assert sorted(map(tuple, out.select("seq", "decision").collect())) == sorted(map(tuple, batch.select("seq", "decision").collect()))
    assert sorted(r.received_epoch for r in out.collect()) == [r[1] for r in rows]


def test_addresses_are_not_forgotten(spark, tmp_path):
    """An address that was idle for days keeps the token its bucket holds, as in batch."""
    rows = [(i, BASE + t, (BASE + t) * 1000, "1.2.3.4") for i, t in enumerate([0, 1, 2, 400_000, 400_000, 400_000, 400_000])]
    schema = "seq bigint, received_epoch bigint, received_ms bigint, client_ip string"
    out = run_stream(spark, tmp_path, [*rows, (99, BASE + 900_000, (BASE + 900_000) * 1000, None)], schema, (3, 4, 1), lambda s: keyed.rate_limit_ip_stream(s, 3))
    batch = folds.rate_limit_ip(spark.createDataFrame(rows, schema), 3)
    got = {r.seq: r.decision == "accept" for r in out.collect()}
    assert got.pop(99) and got == {r.seq: r.within_ip_limit for r in batch.collect()}


def test_streams_start_from_any_folder(tmp_path):
    script = tmp_path / "away.py"
    script.write_text(
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession, functions as F\n"
        "from eventlane.session import prepare\nfrom eventlane.streaming import keyed\n"
        "s = prepare(SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate())\n"
        "s.createDataFrame([(1, 1700000000, 'a')], 'seq bigint, received_epoch bigint, dedup_key string').write.parquet(sys.argv[2] + '/in')\n"
        "r = s.readStream.schema('seq bigint, received_epoch bigint, dedup_key string').parquet(sys.argv[2] + '/in')\n"
        "q = keyed.dedup_ttl_stream(r.withColumn('received_at', F.timestamp_seconds('received_epoch'))).writeStream.format('parquet')\n"
        "q.option('checkpointLocation', sys.argv[2] + '/st').trigger(availableNow=True).start(sys.argv[2] + '/out').awaitTermination()\n"
        "print('ROWS', s.read.parquet(sys.argv[2] + '/out').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, str(script), root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from eventlane import session

    none = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: none, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(SimpleNamespace(sparkContext=context, conf=none))
