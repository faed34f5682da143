"""Keyed first-come folds: time-to-live dedup, cooldown, throttle, token bucket.

The rule "accept, then refuse until ``accepted + ttl``" is sequential per key.
It is kept narrow and proof against hot keys:

1. Rows are pre-aggregated to one per (key, instant), combined on the map
   side. At one instant only the first row can pass, so nothing is lost, and a
   key that holds a third of all rows shrinks to at most one row per second.
2. Those rows are shuffled by key and sorted; each task streams over them in
   Arrow batches with constant state, jumping from one accepted instant to the
   next by binary search. No group is ever held in memory.
3. Only accepted (key, instant, seq) triples come out. Joining them back on
   all three columns spreads a hot key over all partitions.

A key of very many instants is cut into slices of time, which all tasks share:
each slice is folded as if nothing came before, and tells for every state that
it could be entered with in which state it would be left. A pass over these
tables, a fraction of the instants, gives the true states at the cuts, and only
slices that are entered within a time-to-live are folded again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlane.functions.text import safe_key
from eventlane.session import staged

ACCEPT, DUPLICATE, COOLDOWN = "accept", "duplicate", "cooldown"
# Instants from which on a key is cut into slices, times-to-live a slice is long, and its most seconds.
HOT_INSTANTS, SLICE_TTLS, SLICE_SECONDS = 1_000_000, 4, 4_000_000


def key_runs(keys: pa.Array) -> list[tuple[int, int]]:
    """(start, end) of each run of equal neighbouring keys."""
    n = len(keys)
    if n == 0:
        return []
    if n == 1:
        return [(0, 1)]
    differs = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = [0, *(differs.nonzero()[0] + 1).tolist()]
    return list(zip(starts, [*starts[1:], n]))


def accepted_positions(times: list[int], start: int, end: int, expiry: int | None, ttl: int) -> tuple[list[int], int | None]:
    """Accepted indices of a sorted run and the expiry after it.

    The one statement of the rule, used by batch and stream: refuse while the
    stored expiry is later than now; refused rows do not extend it.
    """
    out = []
    i = start if expiry is None else bisect_left(times, expiry, start, end)
    while i < end:
        out.append(i)
        expiry = times[i] + ttl
        i = bisect_left(times, expiry, i + 1, end)
    return out, expiry


def _ttl_fold(ttl: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, expiry = None, None
        for batch in batches:
            keys = batch.column(0)
            times = batch.column(1).to_pylist()
            picked: list[int] = []
            for start, end in key_runs(keys):
                key = keys[start].as_py()
                if key != last_key:
                    last_key, expiry = key, None
                kept, expiry = accepted_positions(times, start, end, expiry, ttl)
                picked.extend(kept)
            yield batch.take(pa.array(picked, pa.int64()))

    return fold


def ttl_accepted(rows: DataFrame, ttl_seconds: int, carry: str | None = None) -> DataFrame:
    """Rows of (fold_key, fold_time, seq[, carry]) that the rule accepts.

    ``rows`` needs ``fold_key`` (not null), ``fold_time`` BIGINT seconds and a
    unique ``seq``; ``carry`` is one more column to keep.
    """
    if ttl_seconds <= 0:
        return rows
    if carry is None:
        firsts = rows.groupBy("fold_key", "fold_time").agg(F.min("seq").alias("seq"))
    else:
        first = F.min(F.struct("seq", carry)).alias("first")
        firsts = (
            rows.groupBy("fold_key", "fold_time")
            .agg(first)
            .select("fold_key", "fold_time", F.col("first.seq").alias("seq"), F.col(f"first.{carry}").alias(carry))
        )
    firsts = staged(firsts, "instants")
    hot = firsts.groupBy("fold_key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_INSTANTS).select("fold_key")
    if not hot.limit(1).count():
        return _folded(firsts, ttl_seconds)
    hot = staged(hot, "hot")
    cool = firsts.join(hot, "fold_key", "left_anti")
    return _folded(cool, ttl_seconds).unionByName(_sliced(firsts.join(hot, "fold_key", "left_semi"), ttl_seconds))


def _folded(firsts: DataFrame, ttl: int) -> DataFrame:
    """Accepted rows, each key in one task, which streams over it."""
    ordered = firsts.repartition("fold_key").sortWithinPartitions("fold_key", "fold_time")
    return ordered.mapInArrow(_ttl_fold(ttl), ordered.schema)


def slice_table(times: np.ndarray, start: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """What a slice makes of the state it is entered with: (instants, state at the end).

    A state is the expiry of the last accepted instant. Entered with one, the
    slice is left with that of the first instant not before it; past the last
    instant, with the one it was entered with. States reach at most one
    time-to-live into the slice, so later instants need no row, nor do
    neighbours that lead to the same end.
    """
    n = len(times)
    own = np.arange(n)
    step = np.searchsorted(times, times + ttl)
    last = np.where(step < n, np.minimum(step, n - 1), own)
    while not np.array_equal(further := last[last], last):
        last = further
    ends = times[last] + ttl
    some = min(n, int(np.searchsorted(times, start + ttl)) + 1)
    keep = np.append(ends[1:some] != ends[: some - 1], True)
    return times[:some][keep], ends[:some][keep]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (fold_key, slice), which arrive in order."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, slices = batch["fold_key"], batch["slice"]
        n = batch.num_rows
        differs = pc.or_(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)), pc.not_equal(slices.slice(1), slices.slice(0, n - 1)))
        starts = [0, *(differs.to_numpy(zero_copy_only=False).nonzero()[0] + 1).tolist()]
        for start, end in zip(starts, [*starts[1:], n], strict=True):
            own = (keys[start].as_py(), slices[start].as_py())
            if own != mark:
                if held:
                    yield pa.Table.from_batches(held)
                held, mark = [], own
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _sliced(firsts: DataFrame, ttl: int) -> DataFrame:
    """Accepted rows of keys whose slices all tasks share."""
    span, columns = min(SLICE_TTLS * ttl, SLICE_SECONDS), firsts.columns
    rows = firsts.withColumn("slice", F.floor(F.col("fold_time") / span))

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition("fold_key", "slice").sortWithinPartitions("fold_key", "slice", "fold_time")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows accepted if nothing came before, and those of the tables (with an end)."""
        for table in _slices(batches):
            times = table["fold_time"].to_numpy()
            picked, _ = accepted_positions(times, 0, len(times), None, ttl)
            at, ends = slice_table(times, table["slice"][0].as_py() * span, ttl)
            known = table.take(pa.array(np.concatenate([picked, np.searchsorted(times, at)]).astype(np.int64)))
            ends = np.concatenate([np.zeros(len(picked), np.int64), ends])
            known = known.append_column("ends", pa.array(ends, mask=np.arange(len(ends)) < len(picked)))
            known = known.append_column("begins", pa.array(np.full(len(ends), times[0])))
            yield from known.combine_chunks().to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state at the start of each slice that is entered within a time-to-live."""
        key, state = None, None
        for table in _slices(batches):
            if (own := table["fold_key"][0].as_py()) != key:
                key, state = own, None
            at, ends, begins = table["fold_time"].to_numpy(), table["ends"].to_numpy(), table["begins"][0].as_py()
            if state is not None and state > begins:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), table["slice"].slice(0, 1).combine_chunks(), pa.array([state], pa.int64())], names=["fold_key", "slice", "entry"]
                )
                place = int(np.searchsorted(at, state))
                state = int(ends[place]) if place < len(at) else state
            else:
                state = int(ends[0])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches):
            times = table["fold_time"].to_numpy()
            picked, _ = accepted_positions(times, 0, len(times), table["entry"][0].as_py(), ttl)
            yield from table.take(pa.array(picked, pa.int64())).select(columns).combine_chunks().to_batches()

    schema = rows.schema.simpleString()[7:-1]
    known = staged(spread(rows).mapInArrow(alone, f"{schema},ends:bigint,begins:bigint"), "slices")
    tables = known.where("ends is not null").select("fold_key", "slice", "fold_time", "ends", "begins")
    ordered = tables.repartition("fold_key").sortWithinPartitions("fold_key", "slice", "fold_time")
    entered = staged(ordered.mapInArrow(scan, "fold_key string, slice bigint, entry bigint"), "entries")
    kept = known.where("ends is null").join(entered, ["fold_key", "slice"], "left_anti").select(*columns)
    redone = spread(rows.join(entered, ["fold_key", "slice"]).select(*rows.columns, "entry"))
    return kept.unionByName(redone.mapInArrow(again, firsts.schema))


def _keyed(key: Column) -> Column:
    return F.coalesce(key, F.lit("")) != ""


def idempotency_decisions(
    df: DataFrame,
    dedup_ttl_seconds: int = 604_800,
    cooldown_seconds: int = 30,
    dedup_key: str = "dedup_key",
    cooldown_key: str = "cooldown_key",
    epoch: str = "received_epoch",
) -> DataFrame:
    """Narrow table of (seq, accept | cooldown) for the keyed rows that are not duplicates.

    Dedup runs on all rows with a dedup key, cooldown on its survivors. The
    survivors feed both the second fold and the result, so they are staged
    once. Rows left out are duplicates, or have a blank dedup key.
    """
    keyed = df.filter(_keyed(F.col(dedup_key))).select(
        F.col(dedup_key).alias("fold_key"),
        F.col(epoch).alias("fold_time"),
        "seq",
        F.coalesce(F.col(cooldown_key), F.lit("")).alias("ck"),
    )
    survivors = staged(
        ttl_accepted(keyed, dedup_ttl_seconds, carry="ck").select("seq", "fold_time", "ck"), "survivors"
    )
    candidates = survivors.filter(F.col("ck") != "").select(F.col("ck").alias("fold_key"), "fold_time", "seq")
    passed = ttl_accepted(candidates, cooldown_seconds).select(F.col("seq").alias("passed_seq"))
    free = (F.col("ck") == "") | F.col("passed_seq").isNotNull()
    return survivors.join(passed, F.col("seq") == F.col("passed_seq"), "left").select(
        "seq", F.when(free, F.lit(ACCEPT)).otherwise(F.lit(COOLDOWN)).alias("decision")
    )


def _label(df: DataFrame, decisions: DataFrame, default: str, out: str) -> DataFrame:
    renamed = decisions.select(F.col("seq").alias("decided_seq"), F.col("decision").alias("decided"))
    return (
        df.join(renamed, F.col("seq") == F.col("decided_seq"), "left")
        .withColumn(out, F.coalesce(F.col("decided"), F.lit(default)))
        .drop("decided_seq", "decided")
    )


def dedup_ttl(
    df: DataFrame, ttl_seconds: int = 604_800, key: str = "dedup_key", epoch: str = "received_epoch", out: str = "decision"
) -> DataFrame:
    """Label each row ``accept`` or ``duplicate`` under the time-to-live rule.

    ``df`` is read twice (fold and label): stage it first if its keys are
    costly to derive. The same goes for :func:`idempotency`.
    """
    rows = df.filter(_keyed(F.col(key))).select(
        F.col(key).alias("fold_key"), F.col(epoch).alias("fold_time"), "seq"
    )
    accepted = ttl_accepted(rows, ttl_seconds).select("seq", F.lit(ACCEPT).alias("decision"))
    labelled = _label(df, accepted, DUPLICATE, out)
    return labelled.withColumn(out, F.when(_keyed(F.col(key)), F.col(out)).otherwise(F.lit(ACCEPT)))


def idempotency(df: DataFrame, dedup_ttl_seconds: int = 604_800, cooldown_seconds: int = 30, out: str = "decision") -> DataFrame:
    """Label each row ``accept``, ``duplicate`` or ``cooldown``; a blank dedup key is accepted."""
    labelled = _label(df, idempotency_decisions(df, dedup_ttl_seconds, cooldown_seconds), DUPLICATE, out)
    return labelled.withColumn(out, F.when(_keyed(F.col("dedup_key")), F.col(out)).otherwise(F.lit(ACCEPT)))


def alert_throttle(
    alerts: DataFrame, cooldown_seconds: int = 300, key: str = "event", epoch: str = "epoch"
) -> DataFrame:
    """Add ``sent``: false while a sent alert of the same safe event key is younger than the cooldown."""
    keyed = alerts.withColumn("throttle_key", safe_key(key))
    rows = keyed.select(F.col("throttle_key").alias("fold_key"), F.col(epoch).alias("fold_time"), "seq")
    passed = ttl_accepted(rows, cooldown_seconds).select(F.col("seq").alias("passed_seq"))
    return keyed.join(passed, F.col("seq") == F.col("passed_seq"), "left").withColumn(
        "sent", F.col("passed_seq").isNotNull()
    ).drop("passed_seq", "throttle_key")


# --- fixed-minute limit per source ------------------------------------------


def rate_limit_source(
    df: DataFrame,
    limit: int = 500,
    bucket_seconds: int = 60,
    source: str = "source",
    epoch: str = "received_epoch",
    out: str = "within_limit",
) -> DataFrame:
    """Add ``out``: whether the row is among the first ``limit`` of its source and bucket.

    Instead of ranking every row, the order key of the ``limit``-th row of each
    full bucket is found. Spark keeps only the first ``limit`` rows per bucket
    of each map task before the shuffle, so a hot bucket costs little, and only
    buckets that reach the limit appear in the joined table.
    """
    if limit < 0 or bucket_seconds <= 0:
        raise ValueError("limit must not be negative and bucket_seconds must be positive")
    if limit == 0:
        return df.withColumn(out, F.lit(False))
    bucket = F.call_function("div", F.col(epoch), F.lit(bucket_seconds))
    order = F.struct(F.col(epoch).alias("at"), F.col("seq").alias("seq"))
    cutoffs = bucket_cutoffs(
        df.select(F.col(source).alias("cut_source"), bucket.alias("cut_bucket"), F.col(epoch).alias("at"), "seq"), limit
    )
    joined = df.withColumn("_bucket", bucket).join(
        cutoffs,
        (F.col(source) == F.col("cut_source")) & (F.col("_bucket") == F.col("cut_bucket")),
        "left",
    )
    within = F.col("cutoff").isNull() | (order <= F.col("cutoff"))
    return joined.withColumn(out, within).drop("_bucket", "cut_source", "cut_bucket", "cutoff")


def bucket_cutoffs(rows: DataFrame, limit: int) -> DataFrame:
    """(cut_source, cut_bucket, cutoff) of the buckets holding at least ``limit`` rows."""
    window = Window.partitionBy("cut_source", "cut_bucket").orderBy("at", "seq")
    return (
        rows.withColumn("rn", F.row_number().over(window))
        .filter(F.col("rn") == limit)
        .select("cut_source", "cut_bucket", F.struct("at", "seq").alias("cutoff"))
    )


# --- token bucket per client address ----------------------------------------


def refill_period_ms(limit_per_minute: int) -> int:
    return max(1, 60_000 // limit_per_minute)


def bucket_admissions(
    times: list[int], counts: list[int], start: int, end: int, full_at: int | None, period: int, burst: int
) -> tuple[list[tuple[int, int]], int | None]:
    """(index, admitted) of the instants of a sorted run that admit anything.

    ``full_at`` is when the bucket would be full again. A request passes while
    ``full_at - period * burst <= now``; a fresh bucket starts one period ahead.
    """
    out = []
    tau = period * burst
    i = start
    while i < end:
        now = times[i]
        tat = now + period if full_at is None else full_at
        if now < tat - tau:
            # Nothing passes before the next token; refusals change no state.
            i = bisect_left(times, tat - tau, i + 1, end)
            full_at = tat
            continue
        base = max(tat, now)
        # The first request passes here; each one moves the horizon by a period.
        # A bucket that has been idle holds one request more than a fresh one.
        admitted = min(counts[i], 1 + (now + tau - base) // period)
        full_at = base + admitted * period
        out.append((i, admitted))
        i += 1
    return out, full_at


def _bucket_fold(period: int, burst: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, full_at = None, None
        for batch in batches:
            keys = batch.column(0)
            times = batch.column(1).to_pylist()
            counts = batch.column(2).to_pylist()
            picked, admitted = [], []
            for start, end in key_runs(keys):
                key = keys[start].as_py()
                if key != last_key:
                    last_key, full_at = key, None
                hits, full_at = bucket_admissions(times, counts, start, end, full_at, period, burst)
                picked.extend(i for i, _ in hits)
                admitted.extend(a for _, a in hits)
            taken = batch.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), pa.array(admitted, pa.int64())],
                names=["fold_key", "fold_time", "admitted"],
            )

    return fold


def ip_admissions(rows: DataFrame, limit_per_minute: int) -> DataFrame:
    """(fold_key, fold_time, admitted) from rows of (fold_key, fold_time ms).

    One row per address and millisecond reaches the fold, combined map-side.
    """
    period = refill_period_ms(limit_per_minute)
    counted = rows.groupBy("fold_key", "fold_time").agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.repartition("fold_key").sortWithinPartitions("fold_key", "fold_time")
    schema = "fold_key string, fold_time bigint, admitted bigint"
    return ordered.mapInArrow(_bucket_fold(period, limit_per_minute), schema)


def rate_limit_ip(
    df: DataFrame,
    limit_per_minute: int = 100,
    ip: str = "client_ip",
    millis: str = "received_ms",
    out: str = "within_ip_limit",
) -> DataFrame:
    """Add ``out``: whether the client's token bucket admits the request.

    Burst is the limit; one token comes back every ``60000 div limit`` ms. Rows
    of one address and millisecond are admitted in ``seq`` order, found by a
    cutoff row as in :func:`rate_limit_source`.
    """
    if limit_per_minute <= 0:
        raise ValueError("limit_per_minute must be positive")
    base = df.select(F.col(ip).alias("fold_key"), F.col(millis).alias("fold_time"), "seq").filter(
        F.col("fold_key").isNotNull()
    )
    admissions = ip_admissions(base.select("fold_key", "fold_time"), limit_per_minute)
    window = Window.partitionBy("fold_key", "fold_time").orderBy("seq")
    firsts = (
        base.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= limit_per_minute + 1)
    )
    admitted = (
        firsts.join(admissions, ["fold_key", "fold_time"])
        .filter(F.col("rn") <= F.col("admitted"))
        .select(F.col("seq").alias("admitted_seq"))
    )
    return (
        df.join(admitted, F.col("seq") == F.col("admitted_seq"), "left")
        .withColumn(out, F.col("admitted_seq").isNotNull() | F.col(ip).isNull())
        .drop("admitted_seq")
    )
