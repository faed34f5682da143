"""Hidden Markov language model.

A text is its lower-cased words and one end token. Latent states follow each
other by a transition matrix and emit symbols: a frequent word, or the class of
any other word (by its last bytes). Within its class such a word has the share
of its own corpus count, which no state changes, so its part of a text's
probability is a factor that a join with the counts of all words supplies.

Baum-Welch: each task adds up the expected counts of its texts, Spark sums them
by symbol, and the next round broadcasts the new matrices, whose size does not
depend on the corpus. Scoring is the scaled forward recursion over whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.llm.common import Shared, once, text_or_empty
from eventlane.session import staged

END = b""  # no word is empty, so the end token is
CLASSES = 1024
# A frequent word is no longer than this, which bounds what is broadcast.
_LONGEST = 64
# Distinct words that a task counts before it passes them on.
_AT_ONCE = 200_000
# Training cuts texts into stretches of so many tokens, this many at a time.
STRETCH, _STRETCHES = 64, 1024
# Scoring holds about so many tokens; longer texts than _LONG go by transfer matrices.
_HELD, _LONG, _PIECE = 1 << 22, 1 << 17, 1024


def words(text: str) -> list[bytes]:
    """Runs without ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


def class_of(word: bytes) -> int:
    """The class of a word that is not frequent."""
    return zlib.crc32(word[-3:]) % CLASSES


def class_column(word: Column) -> Column:
    """``class_of`` as a column function."""
    return (F.crc32(F.substring(word, -3, 3)) % CLASSES).cast("int")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, cls, n``: how often each token occurs; the end token is the empty word. Null texts are empty."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def counted() -> pd.DataFrame:
            return pd.DataFrame({"word": list(seen), "n": list(seen.values())})

        for batch in batches:
            for value in batch["text"]:
                seen.update(words(value))
                seen[END] += 1
                if len(seen) > _AT_ONCE:
                    yield counted()
                    seen.clear()
        yield counted()

    rows = docs.select(text_or_empty(text).alias("text")).mapInPandas(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).select("word", class_column(F.col("word")).alias("cls"), "n")


@dataclass
class Vocabulary:
    """What is known of the words: the counts of all in a table, the frequent ones and class totals here."""

    counts: DataFrame
    frequent: list[bytes]
    n: np.ndarray  # of the frequent words, then of the end token
    tokens: int
    distinct: int
    class_n: np.ndarray
    class_words: np.ndarray

    @property
    def symbols(self) -> int:
        return len(self.frequent) + CLASSES + 1

    @property
    def mass(self) -> float:
        """The divisor of the base score."""
        return self.tokens + 0.5 * (self.distinct + 1)

    def shares(self) -> np.ndarray:
        """The smoothed share of each symbol: frequent words, classes, end."""
        own = np.concatenate([self.n[:-1], self.class_n, self.n[-1:]]) + 0.5
        return own / own.sum()


def least_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more.

    Counts of 1024 and more are taken by their first ten bits, so the driver
    sees a histogram whose size does not depend on the corpus.
    """
    low = (F.floor(F.log2("n")) - 9).cast("int")
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.expr("shiftleft(shiftright(n, low), low)"))
    levels = counts.withColumn("low", low).groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()
    least, total = 1 << 62, 0
    for r in sorted(levels, key=lambda r: -r.level):
        total += r.words
        if total > most:
            break
        least = r.level
    return least


def vocabulary(docs: DataFrame, frequent: int = 60_000, text: str = "text") -> Vocabulary:
    """The vocabulary of ``docs``; at most ``frequent`` words, the most frequent, become symbols of their own.

    Words that are as frequent as the first one beyond them are not among them.
    """
    if not 0 <= frequent <= (1 << 16) - CLASSES - 1:
        raise ValueError("symbols are 16 bits: too many frequent words")
    counts = staged(word_counts(docs, text), "words")
    short = counts.where((F.length("word") > 0) & (F.length("word") <= _LONGEST))
    top = sorted(short.where(F.col("n") >= least_count(short, frequent)).collect(), key=lambda r: (-r.n, bytes(r.word)))
    ends = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    class_n, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where(F.length("word") > 0).groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        class_n[r.cls], class_words[r.cls] = r.n, r.words
    tokens, distinct = int(class_n.sum() + ends), int(class_words.sum() + (ends > 0))
    for r in top:
        class_n[r.cls] -= r.n
        class_words[r.cls] -= 1
    return Vocabulary(counts, [bytes(r.word) for r in top], np.array([*(r.n for r in top), ends], dtype=float), tokens, distinct, class_n, class_words)


class _Symbols(dict):
    """The symbol of a word: its place among the frequent ones, or behind these its class."""

    def __init__(self, frequent: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(frequent))
        self.first = len(frequent)

    def __missing__(self, word: bytes) -> int:
        return self.first + class_of(word)


ENCODED = (
    "row long, id {}, teaches boolean, n_tokens long, n_known long, base_score double, symbols binary, "
    "others array<binary>, times array<int>"
)


def encode(docs: DataFrame, vocab: Vocabulary, teaches: Column | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A staged table with the symbols of each text (two bytes each), and its words that are not frequent.

    ``base_score`` and ``n_known`` are so far those of frequent words and the end.
    """
    spark = docs.sparkSession
    table = Shared(spark, (vocab.frequent, np.log10((vocab.n + 0.5) / vocab.mass), vocab.n[-1] > 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, logs, ended = table.value
        symbol = once("hmm", table.key, lambda: _Symbols(frequent))
        first, end = symbol.first, symbol.first + CLASSES
        for batch in batches:
            out = []
            for value in batch["text"]:
                own = words(value)
                ids = np.empty(len(own) + 1, "<u2")
                ids[:-1] = np.fromiter(map(symbol.__getitem__, own), "<u2", len(own))
                ids[-1] = end
                rare = np.flatnonzero(ids[:-1] >= first)
                others = Counter(own[i] for i in rare)
                base = logs[ids[:-1][ids[:-1] < first]].sum() + logs[-1]
                known = len(own) - len(rare) + int(ended)
                out.append((len(ids), known, base, ids.tobytes(), list(others), list(others.values())))
            part = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "symbols", "others", "times"])
            yield pd.concat([batch[["row", "id", "teaches"]].reset_index(drop=True), part], axis=1)

    flag = F.lit(True) if teaches is None else F.coalesce(teaches, F.lit(True))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), flag.alias("teaches"), text_or_empty(text).alias("text"))
    return staged(rows.mapInPandas(run, ENCODED.format(rows.schema["id"].dataType.simpleString())), "symbols")


@dataclass
class Model:
    """Start, transition and emission probabilities; a row of ``emit`` is a symbol."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def stationary(self) -> np.ndarray:
        """The state distribution that the transitions keep."""
        own = self.start
        for _ in range(1000):
            own = own @ self.move
        return own / own.sum()


def untrained(vocab: Vocabulary, states: int, seed: int = 1) -> Model:
    """Sticky transitions, and the symbols' shares disturbed by seeded noise, so that states differ."""
    noise = np.random.default_rng(seed).standard_normal((vocab.symbols, states))
    emit = vocab.shares()[:, None] * np.exp(noise)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _stretches(texts: Iterator[bytes]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The texts cut into stretches, ``_STRETCHES`` at a time, longest first, and whether each begins its text."""
    held: list[tuple[np.ndarray, bool]] = []

    def sorted_out() -> tuple[list[np.ndarray], np.ndarray]:
        held.sort(key=lambda s: -len(s[0]))
        return [s for s, _ in held], np.array([b for _, b in held])

    for data in texts:
        ids = np.frombuffer(data, "<u2")
        for at in range(0, len(ids), STRETCH):
            held.append((ids[at : at + STRETCH], at == 0))
            if len(held) == _STRETCHES:
                yield sorted_out()
                held = []
    if held:
        yield sorted_out()


class _Expected:
    """Expected counts of emissions, transitions and starts, added up over stretches."""

    def __init__(self, model: Model) -> None:
        self.start, self.rest = model.start.astype("f4"), model.stationary().astype("f4")
        self.move, self.emit = model.move.astype("f4"), model.emit.astype("f4")
        states = len(model.start)
        self.emitted, self.moved, self.started = np.zeros(model.emit.shape), np.zeros((states, states)), np.zeros(states)
        self.log10 = 0.0

    def add(self, parts: list[np.ndarray], begins: np.ndarray) -> None:
        """Scaled forward and backward recursions over stretches sorted by falling length."""
        sizes = np.array([len(p) for p in parts])
        states, ones = len(self.start), np.ones(len(self.start), "f4")
        ids = np.zeros((sizes[0], len(parts)), np.int64)
        for column, part in enumerate(parts):
            ids[: len(part), column] = part
        within = np.arange(sizes[0])[:, None] < sizes
        live = within.sum(axis=1)
        seen = self.emit.take(ids, axis=0)
        ahead = np.zeros_like(seen)
        scale = np.ones(ids.shape, "f4")
        own = np.where(begins[:, None], self.start, self.rest)
        for t, n in enumerate(live):
            own = (own if t == 0 else ahead[t - 1, :n] @ self.move) * seen[t, :n]
            scale[t, :n] = own @ ones
            np.multiply(own, (1 / scale[t, :n])[:, None], out=ahead[t, :n])
        seen *= (within / scale)[:, :, None]
        likely = ahead.copy()
        behind = np.ones((len(parts), states), "f4")
        for t in range(len(live) - 2, -1, -1):
            n = live[t + 1]
            onward = seen[t + 1, :n]
            onward *= behind[:n]
            behind[:n] = onward @ self.move.T
            likely[t, :n] *= behind[:n]
        self.moved += ahead[:-1].reshape(-1, states).T @ seen[1:].reshape(-1, states)
        # Past a stretch's end all shares are zero and all scales one.
        at, share = ids.ravel(), likely.reshape(-1, states)
        for state in range(states):
            self.emitted[:, state] += np.bincount(at, share[:, state], len(self.emitted))
        self.started += likely[0][begins].sum(axis=0)
        self.log10 += float(np.log10(scale, dtype="f8").sum())


def train(encoded: DataFrame, vocab: Vocabulary, states: int = 8, rounds: int = 5) -> Model:
    """Baum-Welch over all rows of ``encoded`` that teach, for a fixed number of rounds.

    Texts are cut into stretches, whose inner starts follow the stationary
    distribution. Sums come back as one row a symbol: the symbols are bounded,
    whatever the corpus. Without any text that teaches the model stays untrained.
    """
    spark, model = encoded.sparkSession, untrained(vocab, states)
    size, names = vocab.symbols, [f"s{i}" for i in range(states)]
    texts = encoded.where("teaches").select("symbols")
    background = vocab.shares()[:, None]
    for _ in range(rounds):
        shared = Shared(spark, model)

        def expected(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sums = _Expected(shared.value)
            for parts, begins in _stretches(data for batch in batches for data in batch["symbols"]):
                sums.add(parts, begins)
            used = np.flatnonzero(sums.emitted.any(axis=1))
            # Behind the symbols come the transitions, then the starts.
            values = np.concatenate([sums.emitted[used], sums.moved * shared.value.move, sums.started[None]])
            keys = np.concatenate([used, size + np.arange(states + 1)])
            yield pd.DataFrame(values, columns=names).assign(key=keys)

        parts = texts.mapInPandas(expected, ", ".join(f"{n} double" for n in names) + ", key long")
        total = parts.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        sums = np.zeros((size + states + 1, states))
        sums[total["key"].to_numpy(dtype=int)] = total[names].to_numpy()
        # A hundred tokens' worth of the corpus shares keeps every symbol possible in every state.
        emit = sums[:size] + 100 * background
        move, start = sums[size:-1] + 1, sums[-1] + 1
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def _forward(model: Model, parts: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability and final state distribution of each part, from its distribution over first states."""
    sizes = np.array([len(p) for p in parts])
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([parts[i] for i in order])
    sizes, own = sizes[order], own[order]
    starts = np.cumsum(sizes) - sizes
    live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    ones = np.ones(len(model.start))
    logs, last = np.zeros(len(parts)), np.zeros(own.shape)
    # Where parts end and at every eighth step the distributions are scaled to one.
    scaled = (np.arange(1, sizes[0] + 1) % 8 == 0) | (np.append(live[1:], 0) < live)
    for t, (n, now) in enumerate(zip(live.tolist(), scaled.tolist(), strict=True)):
        own = own[:n] if t == 0 else own[:n] @ model.move
        own = own * model.emit.take(flat[starts[:n] + t], axis=0)
        if now:
            scale = own @ ones
            own *= (1 / scale)[:, None]
            last[:n] = own
            logs[:n] += np.log10(scale)
    back = np.argsort(order, kind="stable")
    return logs[back], last[back]


def log10_of(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The log10 probability of each sequence of symbols.

    Very long sequences are cut in pieces. The recursion is linear in the state
    distribution, so it runs over each piece from every state at once, and the
    pieces' results are put together in order: the same sum, in other brackets.
    """
    found = np.zeros(len(texts))
    short = [i for i, t in enumerate(texts) if len(t) <= _LONG]
    if short:
        found[short] = _forward(model, [texts[i] for i in short], np.tile(model.start, (len(short), 1)))[0]
    states = len(model.start)
    for i in (i for i, t in enumerate(texts) if len(t) > _LONG):
        logs, own = _forward(model, [texts[i][:_PIECE]], model.start[None])
        total, own = logs[0], own[0]
        for at in range(_PIECE, len(texts[i]), 256 * _PIECE):
            pieces = [texts[i][p : p + _PIECE] for p in range(at, min(len(texts[i]), at + 256 * _PIECE), _PIECE)]
            logs, last = _forward(model, [p for p in pieces for _ in range(states)], np.tile(model.move, (len(pieces), 1)))
            for log, end in zip(logs.reshape(-1, states), last.reshape(-1, states, states), strict=True):
                own = (own * 10 ** (log - log.max())) @ end
                total += log.max() + np.log10(own.sum())
                own /= own.sum()
        found[i] = total
    return found


def score(encoded: DataFrame, vocab: Vocabulary, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``encoded``.

    ``base_score`` adds up the smoothed log10 shares of the tokens, ``score``
    is the model's log10 probability of the text, end token included. Null and
    empty texts are the end token alone. Rows that repeat an id are scored one
    by one; null ids stay null. An empty table gives no rows; with nothing to
    learn from, all counts are zero and the model is uniform up to its noise.
    """
    spark, shared = encoded.sparkSession, Shared(encoded.sparkSession, model)
    plain = ["row", "id", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def scored(held: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            return rows[plain].assign(score=log10_of(shared.value, [np.frombuffer(s, "<u2") for s in rows["symbols"]]))

        for batch in batches:
            held.append(batch)
            size += int(batch["n_tokens"].sum())
            if size > _HELD:
                yield scored(held)
                held, size = [], 0
        if held:
            yield scored(held)

    kind = encoded.schema["id"].dataType.simpleString()
    rows = encoded.select(*plain, "symbols").mapInPandas(run, f"row long, id {kind}, n_tokens long, n_known long, base_score double, score double")
    totals = spark.createDataFrame(
        [(i, float(n + 0.5 * (w + 1))) for i, (n, w) in enumerate(zip(vocab.class_n, vocab.class_words, strict=True))], "cls int, mass double"
    )
    others = encoded.select("row", F.explode(F.arrays_zip(F.col("others").alias("word"), F.col("times").alias("n"))).alias("o")).select("row", "o.*")
    others = others.withColumn("cls", class_column(F.col("word"))).join(F.broadcast(totals), "cls")
    counted = others.join(vocab.counts.select("word", F.col("n").alias("c")), "word", "left")
    c = F.coalesce("c", F.lit(0))
    added = counted.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(vocab.mass))).alias("more_base"),
        F.sum(F.col("n") * F.log10((c + 0.5) / F.col("mass"))).alias("more_score"),
    )
    joined = rows.join(added, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return joined.select(
        F.col("id").alias(id_col), "n_tokens", plus("n_known", "more_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        plus("base_score", "more_base"), plus("score", "more_score"),
    )
