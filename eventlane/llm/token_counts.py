"""Token counts of a SentencePiece BPE model, without moving any pre-token.

A pre-token is a run of spaces with the word behind it, or a newline with the
word behind it. No piece of the model spans the edge between two pre-tokens
(``check_model`` verifies this), so a text's count is the sum over its
pre-tokens. Two tiers answer a pre-token: a broadcast table of the corpus's
frequent ones, and a bounded cache in each worker, filled by encoding misses.
The tiers only save time; the counts do not depend on what they hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.llm.common import Shared, file_bytes, fresh, once, text_or_empty

SPACE = "▁"
_PRE_TOKEN = re.compile(f"[ {SPACE}]+[^ {SPACE}\n]*|\n[^ {SPACE}\n]*")
# Longer pre-tokens are encoded each time, so that the tiers stay small in bytes.
LONGEST_KEPT = 64
LONGEST_COUNTED = 255
_FAN_IN = 128


def check_model(model: sentencepiece.SentencePieceProcessor) -> None:
    """Refuse a model whose tokens could span two pre-tokens."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    spanning = any(SPACE in piece.lstrip(SPACE) or "\n" in piece for piece in pieces)
    kept = "a  b ﬁ² "
    if spanning or "".join(model.encode(kept, out_type=str)).replace(SPACE, " ") != " " + kept:
        raise ValueError("the model rewrites texts or has pieces across words; count whole texts instead")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a non-empty text, each without its first space; only newlines start with one."""
    if SPACE in text or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
        return [t[1:] if t[0] != "\n" else t for t in _PRE_TOKEN.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


class Lengths(dict):
    """Pre-token to its number of tokens: the frequent ones, and a bounded cache of others."""

    def __init__(self, model: bytes, frequent: dict[str, int], room: int) -> None:
        super().__init__(frequent)
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.encode = lambda texts: processor.encode(texts, num_threads=1)
        self.frequent, self.limit = frequent, len(frequent) + room

    def measure(self, keys: list[str]) -> list[int]:
        # The model puts a space before each text: it stands for the first space
        # that was cut off, and is a token of its own before a newline.
        return [max(1, len(ids)) - (key[:1] == "\n") for key, ids in zip(keys, self.encode(keys), strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; misses are encoded together."""
        parts = [pre_tokens(t) if t else [] for t in texts]
        missed = list(set().union(*parts) - self.keys())
        once = dict(zip(missed, self.measure(missed), strict=True))
        if len(self) + len(once) <= self.limit:
            self.update(once)
            totals = [sum(map(self.__getitem__, p)) for p in parts]
        else:
            both = {**self, **once}
            totals = [sum(map(both.__getitem__, p)) for p in parts]
            self.clear()
            self.update(self.frequent)
        for key in once:
            if len(key) > LONGEST_KEPT:
                self.pop(key, None)
        return totals


def _lengths(model: Shared, packed: Shared, room: int) -> Lengths:
    """This worker's tiers; one set per process."""

    def build() -> Lengths:
        keys, lengths = packed.value
        return Lengths(model.value, dict(zip(keys.split("\0"), lengths, strict=True)) if lengths else {}, room)

    return once("lengths", (model.key, packed.key, room), build)


def _top(counter: Counter, size: int) -> Counter:
    return Counter(dict(counter.most_common(size)))


def _summaries(size: int):
    """Frequent pre-tokens of one task: lossy counting in bounded memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(pre_tokens(text) if text else ())
                if len(seen) > 16 * size:
                    seen = _top(seen, size)
        kept = [(k, n) for k, n in seen.most_common(size) if len(k) <= LONGEST_KEPT and "\0" not in k]
        keys, counts = [k for k, _ in kept], [n for _, n in kept]
        yield pd.DataFrame({"bucket": [TaskContext.get().partitionId()], "keys": [keys], "counts": [counts]})

    return run


def _merge(size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for keys, counts in zip(group["keys"], group["counts"], strict=True):
            for k, n in zip(keys, counts, strict=True):
                total[k] += int(n)
        kept = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]
        return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "keys": [[k for k, _ in kept]], "counts": [[n for _, n in kept]]})

    return run


def frequent_pre_tokens(texts: DataFrame, size: int) -> list[str]:
    """About the ``size`` most frequent pre-tokens of a one-column table of texts.

    Each task reads its texts once and keeps a summary of at most ``size``
    entries; summaries, never pre-tokens, are merged in a tree of fixed fan-in.
    """
    schema = "bucket long, keys array<string>, counts array<long>"
    found = texts.select(text_or_empty(texts.columns[0]).alias("text")).mapInPandas(_summaries(size), schema)
    for _ in range(3):
        found = found.withColumn("bucket", F.expr(f"bucket div {_FAN_IN}")).groupBy("bucket").applyInPandas(_merge(size), schema)
    rows = found.groupBy(F.lit(0).alias("bucket")).applyInPandas(_merge(size), schema).collect()
    return list(rows[0]["keys"]) if rows else []


def token_count(text: Column, model: Shared, packed: Shared, room: int) -> Column:
    """The number of tokens of a text; null counts as empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = _lengths(model, packed, room)
        for texts in batches:
            yield pd.Series(lengths.count(texts.tolist()), dtype="int64")

    return count(text_or_empty(text))


def count_tokens(
    df: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens", frequent: int = 16384, room: int = 800_000
) -> DataFrame:
    """``df`` with the token count of ``text`` as column ``out`` (replaced if it exists).

    Null and empty texts count zero; repeated rows each get their count; an
    empty table stays empty. ``frequent`` bounds the broadcast table (at most
    64 characters an entry, about 2 MB), ``room`` a worker's cache.
    """
    spark = df.sparkSession
    model = file_bytes(spark, model_path)
    processor = sentencepiece.SentencePieceProcessor(model_proto=model.value)
    check_model(processor)
    keys = frequent_pre_tokens(df.select(F.col(text).alias("text")), frequent)
    sized = [(k, n) for k, n in zip(keys, Lengths(model.value, {}, 0).measure(keys), strict=True) if n <= LONGEST_COUNTED]
    packed = Shared(spark, ("\0".join(k for k, _ in sized), bytes(n for _, n in sized)))
    made = fresh(df, "counted")
    counted = df.withColumn(made, token_count(F.col(text), model, packed, room))
    return counted.drop(out).withColumnRenamed(made, out)
