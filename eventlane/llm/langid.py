"""Language identification with error-correcting output codes.

Each language has a codeword; a binary classifier over byte n-grams predicts
each bit. A text's language is the codeword of least loss, where a bit's loss
counts by how well its classifier separated the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.llm.common import Shared, fresh, text_or_empty

UNKNOWN = "und"
_SIZE = 4096
_ORDERS = (2, 3, 4)
WIDTH = _SIZE * len(_ORDERS)
_AT_ONCE = 1 << 18
# Bytes that are not part of a letter become spaces; all of a non-ASCII letter's bytes stay.
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)
# Fixed odd multiplier of a multiplicative hash.
_MIX = np.uint32(2654435761)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def n_grams(text: str) -> np.ndarray:
    """Hashed byte n-grams of a whole text: square roots of their counts, of length one."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    counts = np.zeros(WIDTH, np.int64)
    for start in range(0, len(raw), _AT_ONCE):
        own = np.concatenate([[32], _LETTERS[raw[start : start + _AT_ONCE + max(_ORDERS) - 1]], [32]]).astype(np.uint32)
        gram = own
        for k, order in enumerate(range(2, max(_ORDERS) + 1)):
            gram = gram[:-1] << np.uint32(8) | own[order - 1 :]
            bucket = (gram * _MIX) >> np.uint32(20)
            counts[k * _SIZE : (k + 1) * _SIZE] += np.bincount(bucket, minlength=_SIZE)
    x = np.sqrt(counts, dtype=np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language.

    Up to seven languages take the exhaustive code: every split of them in two.
    More take the best separated of 200 seeded random codes.
    """
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= 7:
        splits = np.arange(1, 2 ** (languages - 1))
        return np.array([1 - 2 * (splits >> k & 1) for k in range(languages)], np.int8)
    draw, best = np.random.default_rng(7), (-1, None)
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (languages, bits))
        apart = (bits - code.astype(int) @ code.T) // 2 + np.eye(languages, dtype=int) * bits
        if apart.min() > best[0] and (abs(code.sum(axis=0)) < languages).all():
            best = (apart.min(), code)
    return best[1]


@dataclass
class Model:
    """Languages, their codewords, and per bit the weights, offset and trust."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for rows of features, by loss-weighted decoding."""
        margin = x @ self.weights + self.offset
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: list[str], rounds: int = 150, decay: float = 1e-4) -> Model:
    """One logistic classifier a bit, all fitted together by accelerated gradient descent."""
    languages = sorted(set(y))
    code = codewords(len(languages))
    rank = {name: i for i, name in enumerate(languages)}
    own = np.array([rank[name] for name in y], int)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((WIDTH, 0), np.float32), np.zeros(0), np.zeros(0))
    target = code[own].astype(np.float32)
    share = 1 / np.bincount(own)[own].astype(np.float32) / len(languages)
    weights, offset = np.zeros((WIDTH, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    last, last_offset = weights, offset
    step = np.float32(4.0)  # rows have length one and an offset: the loss bends by at most 1/2
    for r in range(rounds):
        push = np.float32(r / (r + 3))
        at, at_offset = weights + push * (weights - last), offset + push * (offset - last_offset)
        slope = -target * share[:, None] / (1 + np.exp(target * (x @ at + at_offset)))
        last, last_offset = weights, offset
        weights, offset = at - step * (x.T @ slope + np.float32(decay) * at), at_offset - step * slope.sum(axis=0)
    wrong = ((x @ weights + offset) * target <= 0).T @ share
    trust = np.clip(1 - 2 * wrong, 0.05, 1)
    return Model(languages, code, weights, offset, trust / trust.sum() * min(len(trust), 8))


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = 400, total: int = 6000
) -> Model:
    """Fit on a bounded sample of labelled rows: about ``per_language`` a language, ``total`` in all.

    Rows are drawn by a hash of their id, so the sample does not depend on how
    the table is stored. Rows with a null language, a null text or no letter
    teach nothing. Without any labelled row the model knows no language.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    each = min(per_language, total // max(1, len(counts)))
    if not counts:
        return fit(np.zeros((0, WIDTH), np.float32), [])
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    few = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1, each / n) * (1 << 30)))])
    sample = labelled.where(draw < few[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            yield pd.DataFrame({"lang": batch["lang"], "x": [n_grams(t).astype("<f2").tobytes() for t in batch["text"]]})

    rows = sample.mapInPandas(featured, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    x = np.frombuffer(b"".join(rows["x"]), "<f2").reshape(-1, WIDTH).astype(np.float32)
    return fit(x, rows["lang"].tolist())


def predicted(text: Column, model: Shared, unsure: float = 0.4) -> Column:
    """``struct<lang_pred, score, ambiguous>`` of a text.

    ``score`` is the probability of the language; below ``unsure`` the text is
    flagged ambiguous. A null text or one without a letter is ``und`` with
    score zero, and so is all text if the model knows no language.
    """

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own: Model = model.value
        names = np.array([*own.languages, UNKNOWN], dtype=object)
        for texts in batches:
            best, score = np.full(len(texts), len(own.languages)), np.zeros(len(texts))
            told = [i for i, t in enumerate(texts) if has_letter(t)] if own.languages else []
            for start in range(0, len(told), 128):
                rows = told[start : start + 128]
                p = own.decode(np.stack([n_grams(texts.iloc[i]) for i in rows]))
                best[rows], score[rows] = p.argmax(axis=1), p.max(axis=1)
            yield pd.DataFrame({"lang_pred": names[best], "score": np.clip(score, 0, 1), "ambiguous": (score < unsure) & (best < len(own.languages))})

    return run(text_or_empty(text))


def identify(df: DataFrame, model: Model, text: str = "text", unsure: float = 0.4) -> DataFrame:
    """``df`` with ``lang_pred, score, ambiguous`` of each text, in place of same-named columns.

    Repeated rows get equal answers; an empty table stays empty.
    """
    made, names = fresh(df, "guess"), ("lang_pred", "score", "ambiguous")
    out = df.withColumn(made, predicted(F.col(text), Shared(df.sparkSession, model), unsure))
    return out.drop(*names).select("*", *[f"{made}.{n}" for n in names]).drop(made)


def understood(df: DataFrame, model: Model, text: str = "text", unsure: float = 0.4) -> DataFrame:
    """The rows of ``df`` whose language is known and not ambiguous, with their columns."""
    guess = predicted(F.col(text), Shared(df.sparkSession, model), unsure)
    return df.where((guess["lang_pred"] != UNKNOWN) & ~guess["ambiguous"])
