"""Near-duplicate embeddings by an inverted multi-index.

The two halves of a vector have a codebook each; a pair of codewords names a
cell. A vector lives in its nearest cell and visits the cells nearest to it in
multi-sequence order, as many as reach the target recall. Members and visitors
of a cell meet in blocks of bounded size, and what meets is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlane.llm.common import Shared, runs
from eventlane.llm.graph import components
from eventlane.session import staged

# Most members, and most visitors, that one block compares.
BLOCK = 4096
_MOST_CODEWORDS = 1024
# Ranks are first looked up so far; where the target lies beyond, further.
_VISITS = 512
# Links that the number of visits is measured on, and vectors drawn for them at first and at most.
_LINKS, _DRAWN, _MOST_DRAWN = 300, 256, 4096


def unit(vectors: list, width: int) -> np.ndarray:
    """Vectors of length one in double precision, padded with zeros to ``width``."""
    x = np.zeros((len(vectors), width))
    for row, v in zip(x, vectors, strict=True):
        row[: len(v)] = v
    # The largest component first: squares of very small or large ones stay finite.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """K-means centres of at most ``size`` of the rows of ``x``."""
    draw = np.random.default_rng(11)
    centres = x[np.sort(draw.permutation(len(x))[:size])]
    for _ in range(rounds):
        own = (-2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, column, len(centres)) for column in x.T], axis=1) if x.shape[1] else centres
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    """Two codebooks, and the cells that are visited from a vector."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    @property
    def width(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """For each row the numbers of its nearest cells, nearest first.

        The n nearest cells of the product grid lie among those whose places
        in the two sorted lists multiply to n at most; these are what a
        multi-sequence traversal can reach in n steps.
        """
        split = self.first.shape[1]
        far, order = [], []
        for part, book in ((x[:, :split], self.first), (x[:, split:], self.second)):
            d = ((part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)).clip(0)
            order.append(np.argsort(d, axis=1, kind="stable"))
            far.append(np.take_along_axis(d, order[-1], axis=1))
        n = min(visits or self.visits, len(self.first) * len(self.second))
        steps = [(i, j) for i in range(min(n, len(self.first))) for j in range(min(n // (i + 1), len(self.second)))]
        i, j = (np.array(s) for s in zip(*steps, strict=True))
        near = np.argsort(far[0][:, i] + far[1][:, j], axis=1, kind="stable")[:, :n]
        return np.take_along_axis(order[0], i[near], axis=1) * len(self.second) + np.take_along_axis(order[1], j[near], axis=1)


def _groups(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``mark, label, vector, rep, weight``: the distinct vectors that can link, each with its least id."""
    own = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    own = own.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    own = own.where(F.exists("vector", lambda x: x != 0))
    return own.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("mark", F.xxhash64("label", "vector"))


def fit(groups: DataFrame, count: int, width: int, sample: int = 20_000) -> Index:
    """Codebooks from about ``sample`` vectors, drawn by hash; about 64 vectors a cell if a third share a label."""
    drawn = groups.where(F.pmod(F.col("mark"), F.lit(1 << 30)) < int(min(1, sample / max(1, count)) * (1 << 30)))
    rows = drawn.select("mark", "vector").toPandas().sort_values("mark")
    x = unit(rows["vector"].tolist(), width) if len(rows) else np.zeros((1, width))
    size = int(np.clip(np.ceil(np.sqrt(count / 3 / 64)), 1, _MOST_CODEWORDS))
    half = (width + 1) // 2
    return Index(codebook(x[:, :half], size), codebook(x[:, half:], size), 1)


def _rank(cells: np.ndarray, home: np.ndarray) -> np.ndarray:
    """The place of each home in its row of cells; their number where it is not among them."""
    same = cells == home[:, None]
    return np.where(same.any(axis=1), same.argmax(axis=1), cells.shape[1])


def at_threshold(x: np.ndarray, threshold: float, seed: int = 7) -> np.ndarray:
    """For each unit vector one of cosine ``threshold`` with it, in a seeded direction."""
    if x.shape[1] < 2:
        return x
    aside = np.random.default_rng(seed).standard_normal(x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    return threshold * x + np.sqrt(1 - threshold**2) * aside


def link_ranks(groups: DataFrame, drawn: pd.DataFrame, index: Index, threshold: float, most: int) -> np.ndarray:
    """At which visit each link of the drawn vectors is found; ``most`` where it is not.

    The drawn vectors are compared with all others. A link is found at the rank
    of one's cell in the other's order, whichever of the two is less.
    """
    q = unit(drawn["vector"].tolist(), index.width)
    shared = Shared(groups.sparkSession, (index, drawn["mark"].to_numpy(), drawn["label"].to_numpy(), drawn["vector"].map(len).to_numpy(), q, index.cells(q, most)))

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, marks, labels, sizes, q, order = shared.value
        for batch in batches:
            x = unit(batch["vector"].tolist(), own.width)
            same = (labels[:, None] == batch["label"].to_numpy()) & (sizes[:, None] == batch["vector"].map(len).to_numpy())
            a, b = np.nonzero((q @ x.T >= threshold) & same & (marks[:, None] != batch["mark"].to_numpy()))
            met, at = np.unique(b, return_inverse=True)
            if not len(met):
                continue
            theirs = own.cells(x[met], order.shape[1])
            least = np.minimum(_rank(order[a], theirs[at, 0]), _rank(theirs[at], order[a, 0]))
            yield pd.DataFrame({"rank": least.astype("int64")})

    seen = groups.select("mark", "label", "vector").mapInPandas(ranks, "rank long").groupBy("rank").count().toPandas()
    return np.repeat(seen["rank"].to_numpy(dtype=np.int64), seen["count"].clip(upper=1 << 20).to_numpy(dtype=np.int64))


def visits_for(groups: DataFrame, count: int, index: Index, threshold: float, target: float) -> int:
    """How many cells must be visited to find the share ``target`` of links.

    Vectors are drawn by hash, more and more, until they have some hundreds of
    links. Where ``_MOST_DRAWN`` have fewer, links are rare, and each drawn
    vector's rank for a vector at just the threshold, the hardest to find, is
    measured too. If the target lies beyond the ranks looked up, these go on.
    """
    cells = len(index.first) * len(index.second)
    most, number = min(_VISITS, cells), _DRAWN
    salted = F.pmod(F.xxhash64("mark", F.lit(1)), F.lit(1 << 30))
    while True:
        share = min(1.0, number / max(1, count))
        drawn = groups.where(salted < int(share * (1 << 30))).select("mark", "label", "vector").toPandas().sort_values("mark")
        if not len(drawn):
            if share == 1.0:
                return 1
            number *= 4
            continue
        ranks = link_ranks(groups, drawn, index, threshold, most)
        if len(ranks) < _LINKS and share < 1.0 and number < _MOST_DRAWN:
            number *= 4
            continue
        if len(ranks) < _LINKS:
            q = unit(drawn["vector"].tolist()[:_MOST_DRAWN], index.width)
            near = at_threshold(q, threshold)
            own, theirs = index.cells(q, most), index.cells(near, most)
            ranks = np.concatenate([ranks, np.minimum(_rank(own, theirs[:, 0]), _rank(theirs, own[:, 0]))])
        ranks.sort()
        reached = int(ranks[max(0, int(np.ceil(target * len(ranks))) - 1)])
        if reached < most:
            return min(max(reached + 1, 4), cells)
        if most == cells:
            raise RuntimeError(f"visiting all {cells} cells does not reach the share {target} of links")
        most = min(4 * most, cells)


def _compare(threshold: float, width: int):
    """Links between the members and the visitors of each block."""

    def block(group: pd.DataFrame) -> pd.DataFrame:
        m, q = group[group["member"]], group[~group["member"]]
        if not len(m) or not len(q):
            return pd.DataFrame({"rep": [], "mark": [], "n": [], "root": []}, dtype="int64")
        a, b = unit(q["vector"].tolist(), width), unit(m["vector"].tolist(), width)
        linked = a @ b.T >= threshold
        linked &= q["mark"].to_numpy()[:, None] != m["mark"].to_numpy()
        # Where each visits the other's cell, the other block counts for the member.
        i, j = np.nonzero(linked)
        homes, lists = q["home"].to_numpy(), np.stack(m["visits"].tolist())
        mutual = (lists[j] == homes[i][:, None]).any(axis=1)
        n_q = np.bincount(i, m["weight"].to_numpy()[j], len(q))
        n_m = np.bincount(j[~mutual], q["weight"].to_numpy()[i[~mutual]], len(m))
        # The block's own components: nodes move to the least member they reach.
        root = np.arange(len(m))
        up = np.full(len(q), len(m))
        while True:
            np.minimum.at(up, i, root[j])
            low = root.copy()
            np.minimum.at(low, j, up[i])
            if (low == root).all():
                break
            root = low
        reps = m["rep"].to_numpy()
        on_q, on_m = np.flatnonzero(np.bincount(i, minlength=len(q))), np.flatnonzero(np.bincount(j, minlength=len(m)))
        return pd.DataFrame({
            "rep": np.concatenate([q["rep"].to_numpy()[on_q], reps[on_m]]),
            "mark": np.concatenate([q["mark"].to_numpy()[on_q], m["mark"].to_numpy()[on_m]]),
            "n": np.concatenate([n_q[on_q], n_m[on_m]]).astype("int64"),
            "root": reps[np.concatenate([up[on_q], root[on_m]])],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["label", "width", "cell", "i", "j"]):
            if len(found := block(group)):
                yield found

    return run


def near_duplicates(
    df: DataFrame, threshold: float = 0.93, target: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``df``.

    Two rows link if their labels and vector lengths are equal and their cosine
    is at least ``threshold``; ``n_links`` counts linked other rows, the
    component is the least id reachable. Equal vectors of a label collapse
    first. Null labels, null ids, and vectors that are null, zero or hold null
    or non-finite components link with nothing. Rows that repeat an id count
    as rows but share a component. Extra columns are ignored; an empty table
    gives an empty result. ``target`` is the share of links that the index aims at, measured before the search.
    """
    spark = df.sparkSession
    groups = staged(_groups(df, id_col, vector, label), "vectors")
    count, width = groups.agg(F.count("*"), F.max(F.size("vector"))).first()
    index = fit(groups, count, width or 1)
    index.visits = visits_for(groups, count, index, threshold, target)
    shared = Shared(spark, index)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Index = shared.value
        for batch in batches:
            cells = own.cells(unit(batch["vector"].tolist(), own.width)).astype("int32")
            yield batch.assign(width=batch["vector"].map(len), home=cells[:, 0], visits=list(cells))

    schema = groups.schema.simpleString()[7:-1] + ",width:int,home:int,visits:array<int>"
    placed = staged(groups.mapInPandas(assign, schema), "cells")
    keys = ["label", "width", "cell"]
    visits = placed.select("rep", "mark", "label", "width", F.explode("visits").alias("cell"), "home").withColumn("at_home", F.expr("cell = home"))
    sizes = visits.groupBy(*keys).agg(F.count("*").alias("visitors"), F.sum(F.col("at_home").cast("long")).alias("members"))
    sizes = sizes.where("members > 0 and visitors > 1")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    met = visits.join(sizes, keys).select("rep", "mark", *keys, "at_home", parts("visitors").alias("nv"), parts("members").alias("nm"))
    some = lambda n, salt: F.pmod(F.xxhash64("mark", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    visitors = met.select("rep", "mark", *keys, F.lit(False).alias("member"), some("nv", 2).alias("j"), every("nm").alias("i"))
    members = met.where("at_home").select("rep", "mark", *keys, F.lit(True).alias("member"), some("nm", 3).alias("i"), every("nv").alias("j"))
    rows = visitors.unionByName(members).join(placed.select("rep", "mark", "vector", "weight", "home", "visits"), ["rep", "mark"])
    blocks = rows.repartition("label", "width", "cell", "i", "j").sortWithinPartitions("label", "width", "cell", "i", "j")
    found = staged(blocks.mapInPandas(_compare(threshold, index.width), "rep long, mark long, n long, root long"), "near")
    roots = components(found.select("rep", "root"), "rep", "root")
    totals = found.groupBy("rep", "mark").agg(F.sum("n").alias("n"))
    known = (
        placed.select("rep", "mark", "weight", F.col("label").alias("own_label"), F.col("vector").alias("own_vector"))
        .join(totals, ["rep", "mark"], "left").join(roots, F.col("rep") == F.col("node"), "left")
        .select("mark", "own_label", "own_vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "rep").alias("root"))
    )
    all_rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).withColumn("of", F.xxhash64("label", "vector"))
    equal = (F.col("of") == F.col("mark")) & (F.col("label") == F.col("own_label")) & (F.col("vector") == F.col("own_vector")) & F.col("id").isNotNull()
    out = all_rows.join(known, equal, "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
