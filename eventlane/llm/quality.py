"""Quality grades by ordinal cumulative-link regression.

A text is a set of hashed features: its words, and bands of how its chunks
look (symbols, capitals, repeats). One weight a feature gives a score; ordered
thresholds on that score give the probability of each grade.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.llm.common import Shared, fresh, once, text_or_empty

_BANDS = (0.0, 0.02, 0.1, 0.25, 0.5, 0.75)
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W_][\w'’-]*[.,;:!?]?")


def _band(name: str, part: int, whole: int) -> str:
    share = part / whole if whole else 0.0
    return f"{name}:{sum(share > b for b in _BANDS)}"


def features(text: str) -> list[str]:
    """The distinct features of a whole text, as text."""
    chunks = text.split()
    n = len(chunks)
    lines = text.split("\n")
    letters = sum(map(str.isalpha, text)) if n < 4 else None
    looks = Counter(chunk for chunk in chunks if not _PLAIN.fullmatch(chunk))
    seen = set(_WORD.findall(text.lower()))
    odd = sum(looks.values())
    plain = [chunk.lower().strip(".,;:!?") for chunk in chunks]
    bands = [
        _band("odd", odd, n),
        _band("bar", looks.get("|", 0), n),
        _band("capitals", sum(c.isupper() and len(c) > 1 for c in chunks), n),
        _band("repeated", n - len(set(chunks)), n) if n >= 20 else "repeated:few",
        _band("lines", len(lines) - len(set(lines)), len(lines)) if len(lines) >= 4 else "lines:few",
        _band("digits", sum(c[0].isdigit() for c in chunks), n),
        _band("echo", sum(a == b for a, b in zip(plain, plain[1:], strict=False)), n),
        f"letters:{letters > 0}" if letters is not None else "letters:many",
    ]
    return [*seen, *(f"{a}/{b}" for i, a in enumerate(bands) for b in ["", *bands[i + 1 :]])]


def hashed(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the features of a text."""
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(f) for f in features(text)), np.uint64))


@dataclass
class Model:
    """Feature hashes (sorted), their weights, and the thresholds between the grades."""

    hashes: np.ndarray
    weights: np.ndarray
    grades: np.ndarray
    thresholds: np.ndarray

    def table(self) -> dict[int, float]:
        return dict(zip(self.hashes.tolist(), self.weights.tolist(), strict=True))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """For each score the probability of every grade but the lowest, or more."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - scores[:, None]))


def score(known: dict[int, float], text: str) -> float:
    """The weights of a text's features together; unknown features weigh nothing."""
    digest = xxhash.xxh3_64_intdigest
    return sum(known.get(digest(f), 0.0) for f in features(text))


def fit(rows: list[np.ndarray], grades: list[int], seen_in: int = 4, most: int = 1 << 17, rounds: int = 500, sparse: float = 1e-3) -> Model:
    """Fit shared weights and ordered thresholds by accelerated proximal gradient steps.

    Features in fewer than ``seen_in`` rows are dropped and the ``most`` frequent
    kept; the L1 penalty ``sparse`` leaves weights on few of them. Grades weigh
    by the square root of their rarity. Fewer than two grades give no weights.
    """
    levels = np.unique(np.array(grades, int))
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), levels, np.zeros(max(0, len(levels) - 1)))
    if len(levels) < 2:
        return empty
    flat = np.concatenate(rows)
    found, counts = np.unique(flat, return_counts=True)
    kept = np.flatnonzero(counts >= seen_in)
    kept = np.sort(kept[np.argsort(-counts[kept], kind="stable")[:most]])
    hashes = found[kept]
    if not len(hashes):
        return empty
    at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
    inside = hashes[at] == flat
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[inside]
    column = at[inside]
    y = np.searchsorted(levels, grades)
    size = np.bincount(y).astype(float)
    importance = np.sqrt(1 / size)[y]
    importance /= importance.sum()
    cuts = len(levels) - 1
    above = (y[:, None] > np.arange(cuts)).astype(float)
    forward = lambda w: np.bincount(row, w[column], len(rows))
    back = lambda g: np.bincount(column, g[row], len(hashes))
    # A word of a long text must not drown in it, so features are not scaled by
    # length; the step follows from the largest curvature instead.
    probe = np.ones(len(hashes))
    for _ in range(12):
        probe = back(importance * forward(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1 / (0.25 * cuts * norm + 1e-9)
    # Cumulative logits: the chance of more than cut k is sigmoid(score - theta_k).
    tail = np.clip((importance[:, None] * above).sum(axis=0), 1e-3, 1 - 1e-3)
    theta = -np.log(tail / (1 - tail))
    w = last = np.zeros(len(hashes))
    last_theta = theta
    for r in range(rounds):
        push = r / (r + 3)
        v, t = w + push * (w - last), theta + push * (theta - last_theta)
        miss = (1 / (1 + np.exp(t[None, :] - forward(v)[:, None])) - above) * importance[:, None]
        last, last_theta = w, theta
        moved = v - step * back(miss.sum(axis=1))
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * sparse, 0)
        theta = np.maximum.accumulate(t + 2 * miss.sum(axis=0))
    on = w != 0
    return Model(hashes[on], w[on], levels, theta)


def train(docs: DataFrame, ratings: DataFrame, text: str = "text", grade: str = "grade", id_col: str = "doc_id", most_rows: int = 8000) -> Model:
    """Fit on a bounded sample of rated rows: about ``most_rows``, drawn by a hash of their id.

    ``ratings`` has ``id_col`` and an integer ``grade``; rows with a null id,
    grade or text teach nothing, and repeated rows teach as often as they are
    there. Other columns of either table, whatever their names, are not looked
    at. Without ratings every text gets no grade.
    """
    rated = ratings.select(F.col(id_col).alias("rated_id"), F.col(grade).cast("int").alias("grade")).where("rated_id is not null and grade is not null")
    share = min(1.0, most_rows / max(1, rated.count()))
    drawn = F.broadcast(rated.where(F.pmod(F.xxhash64("rated_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    own = docs.select(F.col(id_col).alias("known_id"), F.col(text).alias("text")).where("text is not null")
    sample = own.join(drawn, F.col("known_id") == F.col("rated_id")).select("rated_id", "grade", "text")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rated_id": batch["rated_id"].astype(str), "grade": batch["grade"], "x": [hashed(t).tobytes() for t in batch["text"]]})

    rows = sample.mapInPandas(featured, "rated_id string, grade int, x binary").toPandas().sort_values(["rated_id", "grade", "x"])
    return fit([np.frombuffer(x, np.uint64) for x in rows["x"]], rows["grade"].tolist())


def graded(text: Column, model: Shared) -> Column:
    """``struct<expected_grade double, tail double>``: the mean grade and the chance of the highest grade.

    Null counts as empty. A model of one grade gives that grade with certainty,
    a model of none gives null.
    """

    @F.pandas_udf("expected_grade double, tail double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own: Model = model.value
        known = once("quality", model.key, own.table)
        for texts in batches:
            if not len(own.grades):
                yield pd.DataFrame({"expected_grade": [None] * len(texts), "tail": [None] * len(texts)}, dtype=float)
                continue
            tails = own.tails(np.array([score(known, t) for t in texts]))
            mean = own.grades[0] + tails @ np.diff(own.grades)
            yield pd.DataFrame({"expected_grade": mean, "tail": tails[:, -1] if tails.shape[1] else np.ones(len(texts))})

    return run(text_or_empty(text))


def grade(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` with ``expected_grade, tail, selected`` of each text, in place of same-named columns.

    ``selected`` says that the highest grade has at least the chance ``least``.
    Repeated rows get equal answers; an empty table stays empty.
    """
    made = fresh(df, "graded")
    out = df.withColumn(made, graded(F.col(text), Shared(df.sparkSession, model))).drop("expected_grade", "tail", "selected")
    return out.select("*", f"{made}.expected_grade", f"{made}.tail", (F.col(f"{made}.tail") >= least).alias("selected")).drop(made)


def select(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose highest grade has at least the chance ``least``, with their columns; all, if the model knows no grade.

    Null texts count as empty, rows with a null id are rows like others, repeated
    rows stay or go together, and an empty table stays empty.
    """
    return df.where(F.coalesce(graded(F.col(text), Shared(df.sparkSession, model))["tail"], F.lit(1.0)) >= least)
