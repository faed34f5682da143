"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Each
has features of its ancestors (tags, class and id words, roles) and its text.
A chain over the blocks of a page, trained on labelled pages, is decoded by
Viterbi; the blocks labelled as main text are the result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.llm.common import Shared, fresh, text_or_empty
from eventlane.llm.html_pages import labelled_pages

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[a-z]+")
# Fixed values of the markup language.
_SKIPPED = frozenset("script style template noscript svg head title textarea select button iframe object canvas audio video annotation".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mphantom semantics".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div section article main body html blockquote nav aside header footer form".split())
_BUCKETS = 1 << 14
# Their text is raw: without an end tag they take the rest of the page, as in browsers.
_RAW = frozenset("script style textarea title template iframe".split())
_LENGTHS = (10, 30, 80, 200, 600)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg")}


@dataclass(slots=True)
class Block:
    """A leaf block: its text, the names of its ancestors, and how much of it is links."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: float


@lru_cache(4096)
def _names(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role."""
    return tuple(dict.fromkeys(w for _, v in _ATTRIBUTE.findall(attributes) for w in _NAME.findall(v.lower())))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that have text, in page order.

    Tags may be unclosed or closed out of order, and the page may end anywhere.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    in_links = links = 0
    # Elements that have no end tag from here on.
    endless: set[str] = set()

    def close() -> None:
        nonlocal in_links
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            path = tuple(node for node in stack if node[0] not in _INLINE or node[0] == "label")
            found.append(Block(text, path, min(1.0, in_links / len(text))))
        in_links = 0

    at = 0
    while (match := _TOKEN.search(page, at)) is not None:
        if match.start() > at:
            text = page[at : match.start()]
            held.append(text)
            if links:
                in_links += len(text)
        at = match.end()
        # The second form takes a tag whose quotes do not match.
        ends, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], "")
        if not name:
            continue
        name = name.lower()
        if name in _SKIPPED and not ends:
            if name not in _INLINE and name != "button":
                close()
            # Foreign markup may close itself in its start tag.
            if name == "svg" and match[0].endswith("/>"):
                continue
            closing = None if name in endless else (_RAW_END.get(name) or re.compile(rf"</{name}\b[^>]*>", re.I)).search(page, at)
            if closing is not None:
                at = closing.end()
            elif name in _RAW:
                at = len(page)
            else:
                endless.add(name)
            continue
        if name in ("br", "wbr"):
            held.append(" ")
        elif name in _INLINE:
            if name == "a":
                links = 0 if ends else 1
            elif name == "label":
                close()
                if ends:
                    _pop(stack, "label")
                else:
                    stack.append(("label", ()))
        elif ends:
            close()
            links = 0
            _pop(stack, name)
        else:
            close()
            links = 0
            if name in _VOID:
                continue
            # A new block ends an open paragraph, a new item its neighbour.
            if any(node[0] == "p" for node in stack[-2:]):
                _pop(stack, "p")
            for node in reversed(stack):
                if node[0] in _CLOSES.get(name, ()):
                    _pop(stack, node[0])
                    break
                if node[0] in _SCOPE:
                    break
            stack.append((name, _names(attributes)))
    held.append(page[at:])
    close()
    return found


def _pop(stack: list[tuple[str, tuple[str, ...]]], name: str) -> None:
    """Close the nearest open element of a name, and all within it."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return


def _level(value: float, steps: tuple[float, ...]) -> int:
    return sum(value > s for s in steps)


def described(own: list[Block]) -> list[list[str]]:
    """The features of each block of a page, as text."""
    rows = []
    for k, b in enumerate(own):
        tags = [name for name, _ in b.path if name not in ("html", "body")]
        words = [w for _, names in b.path for w in names]
        tag = tags[-1] if tags else "none"
        size, linked = _level(len(b.text), _LENGTHS), _level(b.linked, (0.05, 0.5, 0.9))
        ends = b.text[-1] in ".!?:;\"'”"
        rows.append([
            "bias", f"tag:{tag}", f"size:{size}", f"linked:{linked}", f"ends:{ends}", f"size:{size}/linked:{linked}", f"tag:{tag}/linked:{linked}",
            f"tag:{tag}/size:{size}", f"depth:{min(len(tags), 6)}", f"copyright:{'©' in b.text}", f"first:{k == 0}", f"last:{k == len(own) - 1}",
            *{f"in:{t}" for t in tags}, *{f"word:{w}" for w in words}, *{f"start:{w[:4]}" for w in words},
            f"held:{any(t in ('article', 'main') for t in tags)}", f"named:{bool(words)}",
        ])
    return rows


@lru_cache(1 << 16)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % _BUCKETS


@dataclass
class Model:
    """Weights of the features for the label main text, and scores of label pairs."""

    weights: np.ndarray
    steps: np.ndarray

    def states(self, own: list[Block]) -> np.ndarray:
        rows = described(own)
        return np.array([sum(self.weights[_bucket(f)] for f in row) for row in rows])

    def viterbi(self, own: list[Block]) -> list[bool]:
        """The most likely labels of a page's blocks together."""
        if not own:
            return []
        best = (0.0, 0.0)
        steps, back = self.steps.tolist(), []
        for k, score in enumerate(self.states(own).tolist()):
            if k:
                from_0 = [best[0] + steps[0][j] for j in (0, 1)]
                from_1 = [best[1] + steps[1][j] for j in (0, 1)]
                back.append([int(from_1[j] > from_0[j]) for j in (0, 1)])
                best = (max(from_0[0], from_1[0]), max(from_0[1], from_1[1]))
            best = (best[0], best[1] + score)
        label = int(best[1] > best[0])
        labels = [label]
        for row in reversed(back):
            label = row[label]
            labels.append(label)
        return [bool(v) for v in reversed(labels)]

    def extract(self, page: str) -> str:
        own = blocks(page)
        return "\n\n".join(b.text for b, main in zip(own, self.viterbi(own), strict=True) if main)


def fit(pages: list[tuple[str, list[bool]]], rounds: int = 150, decay: float = 2e-3) -> Model:
    """Maximum-likelihood training by accelerated gradient steps; all pages together.

    Forward and backward sums run over the places of a page, for all pages at
    once; pages are padded to the longest.
    """
    cut = [(described(blocks(page)), labels) for page, labels in pages]
    cut = [(rows, labels) for rows, labels in cut if rows]
    if any(len(rows) != len(labels) for rows, labels in cut):
        raise ValueError("a labelled page has not as many labels as blocks")
    count, longest = len(cut), max(len(rows) for rows, _ in cut)
    at = np.array([(p * longest + k, _bucket(f)) for p, (rows, _) in enumerate(cut) for k, row in enumerate(rows) for f in row])
    place, column = at[:, 0], at[:, 1]
    real, truth = np.zeros((count, longest), bool), np.zeros((count, longest), int)
    for p, (rows, labels) in enumerate(cut):
        real[p, : len(rows)] = True
        truth[p, : len(rows)] = labels
    both = real[:, 1:] & real[:, :-1]
    seen = np.array([[(both & (truth[:, :-1] == a) & (truth[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    weights = np.zeros(_BUCKETS)
    steps = np.zeros((2, 2))
    # Adam: first and second moments of the slopes.
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, steps)]
    total = real.sum()
    for r in range(1, rounds + 1):
        state = np.bincount(place, weights[column], count * longest).reshape(count, longest)
        emit = np.stack([np.zeros_like(state), state], axis=2)
        forward, backward = np.zeros((count, longest, 2)), np.zeros((count, longest, 2))
        forward[:, 0] = emit[:, 0]
        for k in range(1, longest):
            moved = np.logaddexp.reduce(forward[:, k - 1, :, None] + steps, axis=1) + emit[:, k]
            forward[:, k] = np.where(real[:, k, None], moved, forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            moved = np.logaddexp.reduce(steps + (emit[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(real[:, k + 1, None], moved, 0)
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None])
        pair = np.exp(forward[:, :-1, :, None] + steps + (emit + backward)[:, 1:, None, :] - whole[:, None, None, None])
        slope = np.bincount(column, ((chance - truth) * real).ravel()[place], _BUCKETS) / total + decay * weights / len(weights) ** 0.5
        slope_steps = (np.where(both[:, :, None, None], pair, 0).sum(axis=(0, 1)) - seen) / total
        for x, g, (m, v) in ((weights, slope, moments[0]), (steps, slope_steps, moments[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8) * (g != 0)
    return Model(weights, steps)


def train(pages: int = 600) -> Model:
    """A model of the built-in labelled pages."""
    return fit(labelled_pages(pages))


def main_text(page: Column, model: Shared) -> Column:
    """The main text of a page: blocks joined by an empty line; null counts as empty, and empty has none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own: Model = model.value
        for column in batches:
            yield pd.Series([own.extract(p) for p in column], dtype=object)

    return run(text_or_empty(page))


def extract(df: DataFrame, model: Model, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of ``html`` as column ``out`` (replaced if it exists).

    Null and empty pages have an empty text; repeated rows get equal texts; an
    empty table stays empty.
    """
    made = fresh(df, "main")
    return df.withColumn(made, main_text(F.col(html), Shared(df.sparkSession, model))).drop(out).withColumnRenamed(made, out)
