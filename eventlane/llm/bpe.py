"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The vocabulary is a tokenizer file with byte-level symbols and a word-end
suffix. A text is cut at its special tokens, normalised and split into words;
a word's symbols are merged by a segment tree whose root names the leftmost
pair of lowest rank. Each merge changes three leaves, so it costs a logarithm
of the word's length: a word of a million letters is no problem.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventlane.llm.common import Shared, file_bytes, fresh, once, text_or_empty

# Texts of these characters only need no normalisation but lower case, and are
# split by a plain pattern. All others take the tokenizer file's own steps.
_LATIN = "À-ÖØ-öø-įı-ſ"
_OTHER = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{_LATIN}‐-‧]")
_LOWER = "a-zß-öø-ſ"
_WORD = re.compile(f"[{_LOWER}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\t-\\r {_LOWER}0-9]+")
LONGEST_KEPT = 64
# Words of up to this many bytes are merged many at a time.
_TOGETHER = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class SegmentTree:
    """Least rank, then least place, over the pairs of a row of symbols."""

    def __init__(self, ranks: dict[int, int], merged: list[int]) -> None:
        # A pair (a, b) is the key a << 32 | b; a rank r makes the symbol merged[r].
        self.ranks, self.merged = ranks, merged
        self.none = len(merged)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge until no pair of the row has a rank."""
        n, rank, merged, none = len(symbols), self.ranks.get, self.merged, self.none
        if n < 2:
            return symbols
        shift = (n - 1).bit_length()
        size = 1 << shift
        never = none << shift | size - 1
        # A leaf holds its rank and its place, so a minimum is the leftmost lowest rank.
        tree = [never] * size
        tree += [rank(a << 32 | b, none) << shift | i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
        tree += [never] * (2 * size - len(tree))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) >> shift < none:
            i = best & size - 1
            j = after[i]
            k = after[j]
            symbols[i] = merged[best >> shift]
            symbols[j] = -1
            after[i] = k
            changes = [(j, never), (i, never)]
            if k < n:
                before[k] = i
                changes[1] = (i, rank(symbols[i] << 32 | symbols[k], none) << shift | i)
            if (h := before[i]) >= 0:
                changes.append((h, rank(symbols[h] << 32 | symbols[i], none) << shift | h))
            for at, value in changes:
                at += size
                tree[at] = value
                while at > 1:
                    at >>= 1
                    a, b = tree[2 * at], tree[2 * at + 1]
                    least = a if a < b else b
                    if tree[at] == least:
                        break
                    tree[at] = least
        return [s for s in symbols if s >= 0]


class SegmentTrees:
    """The same merges for many short words at once, one tree a column."""

    def __init__(self, ranks: dict[int, int], merged: list[int]) -> None:
        order = sorted(ranks)
        self.keys = np.array([*order, 1 << 62], np.int64)
        self.values = np.array([*map(ranks.__getitem__, order), len(merged)], np.int32)
        self.merged, self.none = np.array(merged, np.int32), len(merged)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], self.none).astype(np.int32)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        """Merge the rows of ``symbols`` (words by places, a power of two wide) in place; -1 marks no symbol."""
        count, size = symbols.shape
        shift = size.bit_length() - 1
        places = np.arange(size, dtype=np.int32)
        never = np.int32(self.none << shift | size - 1)
        tree = np.full((2 * size, count), never, np.int32)
        for i in range(size - 1):
            rows = np.flatnonzero(lengths > i + 1)
            tree[size + i, rows] = self.rank(symbols[rows, i], symbols[rows, i + 1]) << shift | i
        for i in range(size - 1, 0, -1):
            np.minimum(tree[2 * i], tree[2 * i + 1], out=tree[i])
        after = np.tile(places + 1, (count, 1))
        before = np.tile(places - 1, (count, 1))
        rows = np.arange(count)
        while len(rows := rows[tree[1, rows] >> shift < self.none]):
            best = tree[1, rows]
            i = best & size - 1
            j = after[rows, i]
            k = after[rows, j]
            h = before[rows, i]
            new = self.merged[best >> shift]
            symbols[rows, i], symbols[rows, j], after[rows, i] = new, -1, k
            tree[size + j, rows] = never
            tree[size + i, rows] = never
            on = np.flatnonzero(k < lengths[rows])
            r, left, right = rows[on], i[on], k[on]
            before[r, right] = left
            tree[size + left, r] = self.rank(new[on], symbols[r, right]) << shift | left
            on = np.flatnonzero(h >= 0)
            r, left = rows[on], h[on]
            tree[size + left, r] = self.rank(symbols[r, left], new[on]) << shift | left
            changed = (size + i, size + j, size + np.where(h >= 0, h, i))
            for _ in range(shift):
                changed = tuple(at >> 1 for at in changed)
                for at in changed:
                    tree[at, rows] = np.minimum(tree[2 * at, rows], tree[2 * at + 1, rows])


class Codec:
    """Encoding and decoding with one tokenizer file, with a bounded cache of chunks between white space."""

    def __init__(self, file: bytes, room: int = 300_000) -> None:
        data = json.loads(file)
        model = data["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        ranks: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            ranks[vocab[a] << 32 | vocab[b]] = r
        merged = [vocab[a + b] for a, b in pairs]
        self.tree, self.trees = SegmentTree(ranks, merged), SegmentTrees(ranks, merged)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # The file's normaliser and the first step of its splitter: the second only renames bytes.
        steps = data | {"pre_tokenizer": data["pre_tokenizer"]["pretokenizers"][0], "model": model | {"vocab": {}, "merges": []}, "added_tokens": []}
        steps = Tokenizer.from_str(json.dumps(steps))
        self.normalise, self.split = steps.normalizer.normalize_str, steps.pre_tokenizer.pre_tokenize_str
        self.room = room
        self.chunks: dict[str, bytes] = {}

    def merged(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words as little-endian 32-bit integers."""
        if not words:
            return {}
        raws = [word.encode() for word in words]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        flat = np.frombuffer(b"".join(raws), np.uint8)
        starts = lengths.cumsum() - lengths
        sizes = np.maximum(2, 1 << np.ceil(np.log2(lengths)).astype(np.int64))
        found: dict[str, bytes] = {}
        for at in np.flatnonzero(lengths > _TOGETHER).tolist():
            places = flat[starts[at] : starts[at] + lengths[at]]
            ids = self.tree.merge([*self.inner[places[:-1]].tolist(), int(self.last[places[-1]])])
            found[words[at]] = np.array(ids, "<u4").tobytes()
        for size in np.unique(sizes[lengths <= _TOGETHER]).tolist():
            rows = np.flatnonzero(sizes == size)
            own, n = starts[rows], lengths[rows]
            inside = np.arange(size) < n[:, None]
            places = flat[np.where(inside, own[:, None] + np.arange(size), 0)]
            symbols = np.where(inside, self.inner[places], -1).astype(np.int32)
            symbols[np.arange(len(rows)), n - 1] = self.last[flat[own + n - 1]]
            self.trees.merge(symbols, n)
            kept = symbols >= 0
            ids = symbols[kept].astype("<u4").tobytes()
            ends = (4 * kept.sum(axis=1).cumsum()).tolist()
            found.update(zip([words[i] for i in rows.tolist()], [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text all ids as little-endian 32-bit integers.

        Words that the cache lacks are merged together, each once a batch.
        """
        plain = [not (("<" in t and self.cut and self.cut.search(t)) or _OTHER.search(t)) for t in texts]
        parts = [t.split() if p else self.pieces(t) for t, p in zip(texts, plain, strict=True)]
        new = set().union(*[x for x, p in zip(parts, plain, strict=True) if p])
        if len(self.chunks) + len(new) > self.room:
            self.chunks.clear()
        chunks = self.chunks
        new -= chunks.keys()
        cut = {chunk: _WORD.findall(chunk.lower()) for chunk in new}
        odd = [x for x, p in zip(parts, plain, strict=True) if not p]
        words = self.merged(list(set().union(*cut.values(), *odd) - self.special.keys()))
        words.update((t, np.array([i], "<u4").tobytes()) for t, i in self.special.items())
        # A chunk always has words: white space is all that is dropped.
        chunks.update((chunk, words[own[0]] if len(own) == 1 else b"".join([words[w] for w in own])) for chunk, own in cut.items())
        out = [b"".join(map((chunks if p else words).__getitem__, x)) for x, p in zip(parts, plain, strict=True)]
        for chunk in new:
            if len(chunk) > LONGEST_KEPT:
                del chunks[chunk]
        return out

    def pieces(self, text: str) -> list[str]:
        """The words and special tokens of a text that needs the file's own steps."""
        found: list[str] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                found.append(piece)
            else:
                found.extend(word for word, _ in self.split(self.normalise(piece)))
        return found

    def decode(self, ids: bytes) -> str:
        """The tokens of ids, joined by spaces: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(file: Shared) -> Codec:
    """This worker's codec, with its cache."""
    # The cache is many small objects without cycles; scanning them costs a third of the time.
    gc.disable()
    return once("codec", file.key, lambda: Codec(file.value))


def encoded(text: Column, file: Shared) -> Column:
    """The ids of a text as little-endian 32-bit integers (binary); null counts as empty."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(file)
        for texts in batches:
            yield pd.Series(own.encode(texts.tolist()), dtype=object)

    return run(text_or_empty(text))


def decoded(ids: Column, file: Shared) -> Column:
    """The text of ids as ``encoded`` gives them; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(file)
        for column in batches:
            yield pd.Series([None if x is None else own.decode(x) for x in column], dtype=object)

    return run(ids)


def digests(text: Column, file: Shared) -> Column:
    """``struct<n_tokens, ids_sha256, decoded_sha256>`` of a text, of its real ids and decoded text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, sha = codec(file), hashlib.sha256
        for texts in batches:
            rows = [(len(ids) // 4, sha(ids).hexdigest(), sha(own.decode(ids).encode()).hexdigest()) for ids in own.encode(texts.tolist())]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text_or_empty(text))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` as binary column ``out`` (replaced if it exists).

    Null and empty texts have no ids; repeated rows are each encoded; an empty
    table stays empty.
    """
    made = fresh(df, "coded")
    return df.withColumn(made, encoded(F.col(text), file_bytes(df.sparkSession, path))).drop(out).withColumnRenamed(made, out)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text of column ``ids`` as column ``out`` (replaced if it exists); null ids give null."""
    made = fresh(df, "text")
    return df.withColumn(made, decoded(F.col(ids), file_bytes(df.sparkSession, path))).drop(out).withColumnRenamed(made, out)


def encode_digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with the token count and the digests of ids and decoded text, in place of same-named columns."""
    made = fresh(df, "coded")
    out = df.withColumn(made, digests(F.col(text), file_bytes(df.sparkSession, path)))
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    return out.drop(*names).select("*", *[f"{made}.{n}" for n in names]).drop(made)


def digested(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with the digests of its ids and of their decoded text, in place of same-named columns; null ids give nulls."""
    text = decoded(F.col(ids), file_bytes(df.sparkSession, path))
    return df.withColumns({
        "n_tokens": (F.octet_length(ids) / 4).cast("long"), "ids_sha256": F.sha2(F.col(ids), 256), "decoded_sha256": F.sha2(F.encode(text, "UTF-8"), 256),
    })
