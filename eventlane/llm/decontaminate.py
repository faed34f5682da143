"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

A window is 13 consecutive words. Masks pick some of its words and ignore the
rest, so that any words that the threshold lets differ leave one mask of the
window untouched: windows that agree enough always share a seed. Seeds of all
documents meet the benchmark's seeds, and each hit is verified word by word over
its whole window.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.llm.common import fresh, text_or_empty
from eventlane.session import staged

WINDOW = 13
# Shorter items must be there word for word.
LOOSE = 8
# Items of fewer words than a shingle of five are no evidence.
SHORTEST = 5
# The masks of a width lie within its first so many words.
_SPANS = (12, 10, LOOSE)
# A seed key is a long: this many take about 64 MB as a broadcast table.
MOST_BROADCAST = 2_000_000


def masks_of(width: int, similarity: float) -> tuple[str, ...]:
    """Masks for windows of ``width`` words (1 counts, 0 is ignored).

    The words are cut into blocks, and a mask counts all blocks but as many as
    words may differ. However these lie, they touch no more blocks than that,
    so one mask counts none of them. A word that a document lacks at its end
    is one that differs.
    """
    changes = 0 if width < LOOSE else width - sum(same < similarity * width for same in range(width + 1))
    if not 0 <= changes < width:
        raise ValueError(f"similarity is above 0 and at most 1, not {similarity}")
    # Six words or more count at 0.8; where more may differ, a mask is a block.
    span = width if changes > 2 else next((s for s in _SPANS if s <= width), width)
    parts = 1 if changes == 0 else changes + 1 if changes > 2 else 5 if span == 10 else 4
    block = [i * parts // span for i in range(span)]
    return tuple("".join("01"[b not in out] for b in block).ljust(WINDOW, "0") for out in combinations(range(parts), changes))


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def windows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, n, pos, w``: a row for each word, with itself and those behind it as ``w.w0`` to ``w.w12`` (null past the end)."""
    tail = F.array_repeat(F.lit(None).cast("string"), WINDOW - 1)
    own = df.select(F.col(id_col).alias("id"), F.concat(words(text), tail).alias("padded"))
    n = F.size("padded") - (WINDOW - 1)
    zipped = F.arrays_zip(*[F.slice("padded", i + 1, n).alias(f"w{i}") for i in range(WINDOW)])
    return own.select("id", n.alias("n"), F.posexplode(zipped).alias("pos", "w"))


def _word(i: int) -> Column:
    return F.col("w").getField(f"w{i}")


def _seeded(rows: DataFrame, chosen: dict[str, Column], *kept: str) -> DataFrame:
    """The ``kept`` columns and ``key``: a row for each mask whose condition holds.

    Each word is hashed once and a seed is a hash of word hashes. The keys are
    a column before they are exploded: a generator's own expressions run
    uncompiled where the stage is too large to be compiled as a whole. It is the
    outer form, as the plain one adds a filter that computes all keys again.
    """
    hashes = [F.xxhash64(_word(i)).alias(f"h{i}") for i in range(WINDOW)]
    keys = []
    for mask, holds in chosen.items():
        used = [i for i, c in enumerate(mask) if c == "1"]
        keys.append(F.when(holds, F.xxhash64(F.lit(int(mask, 2)), *[F.col(f"h{i}") for i in used])))
    listed = rows.select("*", *hashes).select(*kept, F.array(*keys).alias("keys"))
    return listed.select(*kept, F.explode_outer("keys").alias("key")).where("key is not null")


def benchmark_windows(benchmark: DataFrame, id_col: str, text: str, shortest: int = SHORTEST) -> DataFrame:
    """``item_id, own, width``: the distinct windows of each item.

    An item of fewer than 13 words has one window of all its words, one of fewer
    than ``shortest`` none.
    """
    rows = windows(benchmark, id_col, text).where(F.col("n") >= shortest)
    rows = rows.where(f"pos + {WINDOW} <= n or (pos = 0 and n < {WINDOW})")
    return rows.select(F.col("id").alias("item_id"), F.array(*map(_word, range(WINDOW))).alias("own"), F.least("n", F.lit(WINDOW)).alias("width")).distinct()


def overlaps(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8,
    id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST,
) -> DataFrame:
    """``doc_id, item_id, n_windows, similarity, first_word`` of documents that overlap the benchmark.

    A document overlaps an item where a window of the item and the words at
    some place of the document agree in at least ``similarity`` of their
    places; an item of fewer than eight words must be there word for word, one
    of fewer than ``shortest`` is passed over. Items that share a window are
    each reported. ``n_windows`` counts such places, ``first_word`` is the first,
    ``similarity`` the best. Null and empty texts overlap nothing. Rows that
    repeat a document's id count together; repeated items count once; extra
    columns are ignored; an empty table on either side gives no rows.
    """
    # Each distinct window is searched once; its items join what was found.
    members = staged(benchmark_windows(benchmark, item_col, item_text, shortest), "members")
    distinct = staged(members.select("own", "width").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    widths = [r.width for r in distinct.select("width").distinct().sort("width").collect()]
    of: dict[str, list[int]] = {}
    for width in widths:
        for mask in masks_of(width, similarity):
            of.setdefault(mask, []).append(width)
    of = of or {"1": [0]}
    spread = distinct.select("*", F.struct(*[F.col("own")[i].alias(f"w{i}") for i in range(WINDOW)]).alias("w"))
    seeds = staged(_seeded(spread, {mask: F.col("width").isin(some) for mask, some in of.items()}, "window", "own", "width"), "seeds")
    keys = seeds.select("key").distinct()
    if keys.count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)
    last = F.col("n") - F.col("pos")
    places = _seeded(windows(docs, id_col, text), {mask: last > mask.rindex("1") for mask in of}, "id", "pos", "w")
    hits = places.join(keys, "key", "left_semi").join(seeds, "key")
    same = sum((_word(i).eqNullSafe(F.col("own")[i]) & (F.col("width") > i)).cast("int") for i in range(WINDOW))
    checked = hits.select("id", "window", "pos", "width", same.alias("same"))
    enough = F.when(F.col("width") < LOOSE, F.col("width")).otherwise(F.lit(similarity) * F.col("width"))
    met = checked.where(F.col("same") >= enough).select("id", "window", "pos", (F.col("same") / F.col("width")).alias("best")).distinct()
    owners = members.join(distinct, ["own", "width"]).select("window", "item_id")
    once = met.join(owners, "window").groupBy("id", "item_id", "pos").agg(F.max("best").alias("best"))
    found = once.groupBy("id", "item_id").agg(F.count("*").alias("n_windows"), F.max("best").alias("similarity"), F.min("pos").cast("long").alias("first_word"))
    return found.withColumnsRenamed({"id": id_col, "item_id": item_col} if item_col != "item_id" else {"id": id_col})


def without_overlap(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text", shortest: int = SHORTEST
) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with their columns.

    Rows that share an id are judged together; each row with a null id by its own text.
    """
    key, mark = fresh(docs, "text_hash"), F.xxhash64(text_or_empty(text))
    known, nameless = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    found = staged(overlaps(known, benchmark, similarity, id_col, text, shortest=shortest).select(F.col(id_col).alias("id")).distinct(), "leaks")
    texts = staged(nameless.select(mark.alias(key), F.col(text).alias("text")).distinct(), "texts")
    leaked = staged(overlaps(texts, benchmark, similarity, key, "text", shortest=shortest).select(key).distinct(), "leaks")
    clean = known.join(found, known[id_col] == found["id"], "left_anti")
    return clean.unionByName(nameless.join(leaked, mark == leaked[key], "left_anti"))
