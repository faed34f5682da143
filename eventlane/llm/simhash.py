"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant that differs
in at most r bits from each. So every distinct fingerprint emits all its
variants within r bits, rows meet on equal variants, and what meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlane.llm.common import fresh, text_or_empty
from eventlane.llm.graph import components
from eventlane.session import staged

SEED = 42
BITS = 64
_AT_ONCE = 1 << 14


def fingerprint_of(text: str, shingle: int) -> int:
    """The fingerprint of a text: for each bit, whether over half of the shingle hashes have it."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII white spaces
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    ones, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for start in range(0, n, _AT_ONCE):
        part = words[start : start + _AT_ONCE + shingle - 1]
        grams = zip(*[part[i:] for i in range(shingle)], strict=False)
        hashes = np.array([digest(b" ".join(g), SEED) for g in grams], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text as a signed long; null counts as empty, and empty is zero."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text_or_empty(text))


def masks(radius: int) -> list[int]:
    """All signed 64-bit masks of at most ``radius`` bits."""
    found = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def ball_links(fingerprints: DataFrame, distance: int) -> DataFrame:
    """``a, b``: links that connect all ``fp`` (distinct) at most ``distance`` bits apart.

    A variant is shared by at most as many fingerprints as it has neighbours
    in its ball, so no group grows with the data. Those that share a variant
    are linked to the least of them where their own distance allows, and to
    each other otherwise; each pair that meets is verified.
    """
    radius = (distance + 1) // 2
    variants = fingerprints.select("fp", F.explode(F.array(*[F.lit(m) for m in masks(radius)])).alias("mask"))
    variants = variants.select("fp", F.expr("fp ^ mask").alias("variant"))
    near = F.bit_count(F.expr("a ^ b")) <= distance
    if distance == 2 * radius:
        # All in the ball of one variant are within the distance of each other.
        least = F.min("fp").over(Window.partitionBy("variant"))
        pairs = variants.select(least.alias("a"), F.col("fp").alias("b"))
        return pairs.where("a <> b").where(near).distinct()
    balls = variants.groupBy("variant").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    one = balls.select("all", F.explode("all").alias("a"))
    return one.select("a", F.explode("all").alias("b")).where("a < b").where(near).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id_col, fp, component_id`` for every row of ``docs``.

    Links join rows whose fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the least id reachable. Equal fingerprints collapse
    before any search, so copies cost one row. Null and empty texts have
    fingerprint zero and link like others; repeated rows stay repeated; rows
    with a null id keep a component but never name one; extra columns are
    ignored. An empty table gives an empty result.
    """
    prints = staged(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text), shingle).alias("fp")), "simhash")
    linked = _rooted(prints, distance)
    least = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(named, prints["fp"] == named["of"]).select(F.col("id").alias(id_col), "fp", "component_id")


def _rooted(prints: DataFrame, distance: int) -> DataFrame:
    """``fp, low, root`` of each distinct fingerprint: its least id and the least fingerprint it is linked to."""
    groups = staged(prints.groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    roots = components(ball_links(groups.select("fp"), distance))
    return groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, with its columns.

    It is the row of least id, nulls last, then of least fingerprint, then of
    least text hash, so that rows with null ids or equal ids and different
    texts stand for themselves. Of rows equal in id and text one stays. Null
    texts count as empty; an empty table stays empty.
    """
    mark = fresh(docs, "mark")
    hashed = F.xxhash64(text_or_empty(text))
    prints = staged(docs.select(F.col(id_col).alias("id"), hashed.alias("hash"), fingerprint(F.col(text), shingle).alias("fp")), "simhash")
    linked = _rooted(prints, distance).select(F.col("fp").alias("of"), "root")
    rows = prints.groupBy("id", "hash", "fp").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "hash", "n")
    # The first of each fingerprint is found before the join, so copies do not travel to one task.
    heads = rows.groupBy("fp").agg(F.min(order).alias("head"))
    first = heads.join(linked, heads["fp"] == linked["of"]).groupBy("root").agg(F.min("head").alias("first")).select("first.id", "first.hash", "first.n")
    kept = staged(first, "kept")
    own = docs.withColumn(mark, hashed)

    def those(some: DataFrame) -> DataFrame:
        return own.join(some, own[id_col].eqNullSafe(some["id"]) & (own[mark] == some["hash"]), "left_semi")

    # Only repeated rows travel with their bodies to be made one.
    one, repeated = those(kept.where("n = 1")), those(kept.where("n > 1"))
    return one.unionByName(repeated.dropDuplicates([id_col, mark])).drop(mark)


def hexadecimal(fp: Column) -> Column:
    """A signed fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))
