"""Hard-negative mining by Four-Russians scoring.

Components are integers. For each anchor and each group of eight dimensions a
table holds the sums of all 256 subsets of the anchor's components there. A
candidate is kept as bit planes: for each bit of its components and each group
one byte, which is an index into that group's tables. So the looked-up sums of
a plane, shifted by its bit and added up, are the exact inner product.

Anchors meet candidates in blocks of bounded size: the stated query set against
all rows, block by block, first those of their own label, then the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlane.llm.common import runs
from eventlane.session import staged

# Most anchors and most candidates of one block; candidates are also cut into so many blocks at least.
ANCHORS, CANDIDATES, LEAST_BLOCKS = 8192, 65_536, 48
# Tables stand for so many anchors at once, and meet so many candidates at once.
_AT_ONCE, _MET = 256, 512
# Stands for a null id; sorts behind all others.
_NO_ID = (1 << 63) - 1
_SUBSETS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bytes (row, bit, group) of the two's complement bits of integers, eight dimensions a byte."""
    level = (values[:, None, :] >> np.arange(bits)[:, None]) & 1
    return np.packbits(level.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (group, subset, anchor) of the sums of the anchors' components, eight dimensions a group."""
    wide = np.zeros((len(anchors), -(-anchors.shape[1] // 8) * 8), anchors.dtype)
    wide[:, : anchors.shape[1]] = anchors
    groups = wide.reshape(len(anchors), -1, 8).transpose(1, 2, 0)
    return np.ascontiguousarray(_SUBSETS.astype(anchors.dtype) @ groups)


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products (anchor, candidate) by look-ups: the sign plane is taken off, then shift and add."""
    total = np.zeros((len(packed), tables.shape[2]), tables.dtype)
    for bit in range(packed.shape[1] - 1, -1, -1):
        total *= 2
        for group, table in enumerate(tables):
            found = table.take(packed[:, bit, group], axis=0)
            if bit == packed.shape[1] - 1:
                total -= found  # the sign weighs minus its bit; the doublings give it that weight
            else:
                total += found
    return np.ascontiguousarray(total.T)


def quantised(vector: Column, scale: float) -> Column:
    """Components as ``floor(scale * x)``, in double precision."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _usable(df: DataFrame, scale: float) -> DataFrame:
    """``item, id, chosen, label, q`` of the rows that take part, whole repeats once."""
    own = df.where("label is not null and v is not null")
    own = own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    own = own.select("id", "chosen", "label", quantised(F.col("v"), scale).alias("q")).distinct()
    return own.select(F.monotonically_increasing_id().alias("item"), "id", "chosen", "label", "q")


def _pack(items: DataFrame, bits: int) -> DataFrame:
    """The items with their bit planes in place of the components of a candidate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                width = len(batch["q"].iloc[0]) if len(set(map(len, batch["q"]))) == 1 else None
                if width is None:
                    packed = [planes(np.array(q, np.int64)[None], bits).tobytes() for q in batch["q"]]
                else:
                    packed = [p.tobytes() for p in planes(np.stack(batch["q"]), bits)]
                yield batch.drop(columns="q").assign(width=batch["q"].map(len).astype("int32"), packed=packed)

    return items.mapInPandas(run, f"item long, id long, label {items.schema['label'].dataType.simpleString()}, width int, packed binary")


def _meet(anchors: DataFrame, candidates: DataFrame, keys: list[str], blocks: Column, anchor_blocks: Column, handle, schema: str) -> DataFrame:
    """Anchors and candidates of equal ``keys`` in blocks; ``handle(anchors, candidates)`` gives the rows of one.

    Rows carry the numbers of blocks of either side: an anchor goes to each
    block of candidates, a candidate to each block of anchors.
    """
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    one_of = lambda n, salt: F.pmod(F.xxhash64("item", F.lit(salt)), n.cast("long")).cast("int")
    left = anchors.select("*", F.lit(True).alias("anchor"), one_of(anchor_blocks, 1).alias("i"), all_of(blocks).alias("j"))
    right = candidates.select("*", F.lit(False).alias("anchor"), one_of(blocks, 2).alias("j"), all_of(anchor_blocks).alias("i"))
    at = [*keys, "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, at):
            own, others = group[group["anchor"]], group[~group["anchor"]]
            if len(own) and len(others):
                yield from handle(own, others)

    rows = left.unionByName(right, allowMissingColumns=True)
    return rows.repartition(*at).sortWithinPartitions(*at, "anchor", "id", "item").mapInPandas(run, schema)


def _scored(own: pd.DataFrame, others: pd.DataFrame, kind: str, bits: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(anchors, positions of candidates, scores) of a block, some anchors at a time; candidates stay in order."""
    q = np.stack(own["q"]).astype(kind)
    packed = np.frombuffer(b"".join(others["packed"]), np.uint8).reshape(len(others), bits, -(-q.shape[1] // 8))
    for at in range(0, len(own), _AT_ONCE):
        tables = subset_sums(q[at : at + _AT_ONCE])
        for start in range(0, len(others), _MET * 8):
            part = [scores(tables, packed[s : s + _MET]) for s in range(start, min(len(others), start + _MET * 8), _MET)]
            yield own.iloc[at : at + _AT_ONCE], np.arange(start, min(len(others), start + _MET * 8)), np.concatenate(part, axis=1)


def _first(values: np.ndarray, allowed: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the highest allowed value of each row, then of the next, ``count`` times; ties by column."""
    least = np.iinfo(values.dtype).min
    left = np.where(allowed, values, least)
    rows = np.arange(len(left))
    for _ in range(count):
        best = left.argmax(axis=1)
        some = np.flatnonzero(left[rows, best] > least)
        if not len(some):
            return
        yield some, best[some]
        left[some, best[some]] = least


def mine(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of anchors.

    Scores are inner products of the components ``floor(scale * x)``, exact in
    64 bits. The positives of an anchor are the first ``positives`` other ids of
    its label, highest score first, ties by smaller id. For each positive come
    the first ``negatives`` rows of other labels whose score lies between
    ``low`` and ``high`` per cent of the positive's. Rows with a null label, a
    null vector or a null or non-finite component take no part. Rows equal in
    id, label and components count once; rows that share only the id are each
    mined, but are no positives or negatives of each other; neither are rows
    with a null id, which come last among ties. Ids are integers. Vectors of different lengths do not meet; extra columns are ignored; an
    empty table gives no rows. ``is_anchor`` is a condition on the columns of ``df``.
    """
    named = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id")
    rows = df.select(named, F.col(label).alias("label"), F.col(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("chosen"))
    items = staged(_usable(rows, scale), "items")
    top = items.agg(F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))), F.max(F.size("q"))).first()
    largest, width = top[0] or 0, max(1, top[1] or 1)
    if 100 * width * max(1, largest) ** 2 >= 1 << 63:
        raise ArithmeticError(f"scores of {width} components up to {largest} do not fit in 64 bits; choose a smaller scale")
    bits = largest.bit_length() + 1
    kind = "int32" if width * (largest + 1) ** 2 * 2 < 1 << 31 else "int64"
    candidates = staged(_pack(items.select("item", "id", "label", "q"), bits), "planes")
    anchors = items.where("chosen").select("item", "id", "label", F.size("q").alias("width"), "q")

    # Each label by itself: its rows among themselves.
    per_label = candidates.groupBy("label", "width").agg(F.count("*").alias("n"))
    per_label = per_label.join(anchors.groupBy("label", "width").agg(F.count("*").alias("m")), ["label", "width"]).select(
        "label", "width", _blocks(F.col("n")).alias("nj"), F.ceil(F.col("m") / ANCHORS).alias("ni")
    )
    # One row a label and length; the same numbers for both sides.
    per_label = staged(per_label, "labels")

    def near(own: pd.DataFrame, others: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids = others["id"].to_numpy()
        for some, places, found in _scored(own, others, kind, bits):
            allowed = ids[places][None] != some["id"].to_numpy()[:, None]
            for rows, columns in _first(found, allowed, positives):
                yield pd.DataFrame({
                    "item": some["item"].to_numpy()[rows], "positive_item": others["item"].to_numpy()[places[columns]],
                    "positive_id": ids[places[columns]], "positive_score": found[rows, columns].astype("int64"),
                })

    sized = lambda rows: rows.join(per_label, ["label", "width"])
    met = _meet(sized(anchors), sized(candidates), ["label", "width"], F.col("nj"), F.col("ni"), near, "item long, positive_item long, positive_id long, positive_score long")
    order = Window.partitionBy("item").orderBy(F.desc("positive_score"), "positive_id", "positive_item")
    best = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pairs = best.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("place", "positive_item", "positive_id", "positive_score"))).alias("own"))
    asked = staged(anchors.join(pairs, "item"), "positives")

    # All labels together; a candidate of the anchor's own label is passed over.
    per_width = candidates.groupBy("width").agg(F.count("*").alias("n")).join(asked.groupBy("width").agg(F.count("*").alias("m")), "width")
    per_width = staged(per_width.select("width", _blocks(F.col("n")).alias("nj"), F.ceil(F.col("m") / ANCHORS).alias("ni")), "widths")

    def hard(own: pd.DataFrame, others: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, labels = others["id"].to_numpy(), others["label"].to_numpy()
        for some, places, found in _scored(own, others, kind, bits):
            allowed = (labels[places][None] != some["label"].to_numpy()[:, None]) & (ids[places][None] != some["id"].to_numpy()[:, None])
            for place in range(positives):
                have = np.flatnonzero(some["own"].map(len) > place)
                if not len(have):
                    break
                given = [some["own"].iloc[i][place] for i in have]
                score = np.array([g["positive_score"] for g in given])
                part = found[have]
                # Whole numbers between the two shares: rounded up from below, down from above.
                least, most = -(-low * score // 100), high * score // 100
                inside = allowed[have] & (part >= least[:, None]) & (part <= most[:, None])
                busy = np.flatnonzero(inside.any(axis=1))
                for rows, columns in _first(part[busy], inside[busy], negatives):
                    at = busy[rows]
                    yield pd.DataFrame({
                        "item": some["item"].to_numpy()[have[at]], "positive_item": [given[i]["positive_item"] for i in at],
                        "negative_item": others["item"].to_numpy()[places[columns]], "negative_id": ids[places[columns]],
                        "negative_score": part[at, columns].astype("int64"),
                    })

    sized = lambda rows: rows.join(F.broadcast(per_width), "width")
    schema = "item long, positive_item long, negative_item long, negative_id long, negative_score long"
    met = _meet(sized(asked), sized(candidates), ["width"], F.col("nj"), F.col("ni"), hard, schema)
    order = Window.partitionBy("item", "positive_item").orderBy(F.desc("negative_score"), "negative_id", "negative_item")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    known = asked.select("item", F.col("id").alias("anchor_id"), F.explode("own").alias("p")).select("item", "anchor_id", "p.positive_item", "p.positive_id", "p.positive_score")
    given = [F.nullif(F.col(c), F.lit(_NO_ID)).alias(c) if c.endswith("_id") else c for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]
    return known.join(ranked, ["item", "positive_item"]).select(*given)


def _blocks(rows: Column) -> Column:
    """How many blocks candidates are dealt into: bounded rows each, enough of them for many tasks, none needlessly small."""
    return F.greatest(F.ceil(rows / CANDIDATES), F.least(F.lit(LEAST_BLOCKS), F.ceil(rows / 512)))
