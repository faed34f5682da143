"""Prompt-injection phrases in text and in the string leaves of JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlane.functions.text import UNICODE_SPACE, WORD_CHAR, fold_letters, folded_lower

# The phrase patterns, in the order that gives each its number.
PATTERNS = (
    r"\b(you are|you're) (now |)(a |an |)(new |different |)?(assistant|ai|bot|system|admin)\b",
    r"\bignore (all |)(previous|prior|above|earlier) (instructions|prompts|context|rules)\b",
    r"\bignore (everything|anything) (above|before|previously)\b",
    r"\bforget (your|all|previous|prior) (instructions|rules|prompts|constraints)\b",
    r"\boverride (system|safety|security) (prompt|instructions|rules|settings)\b",
    r"\b(system|admin|root) ?(prompt|override|mode|access)\b",
    r"\bnew (system ?prompt|instructions|persona|role)\b",
    r"<\/?system>",
    r"\[INST\]",
    r"\[\/INST\]",
    r"<<SYS>>",
    r"<\|im_start\|>",
    r"```system",
    r"\b(execute|run|eval|exec)\s*\(",
    r"\bcurl\s+-",
    r"\bwget\s+",
    r"\b(rm|del|remove)\s+(-rf?|--force)",
    r"\bbase64[_\s\-]*(decode|encode|eval)",
    r"\batob\s*\(",
    r"\bdo not (review|check|flag|report|mention)\b",
    r"\bthis is (a |)(test|safe|authorized|harmless)\b.*\b(ignore|skip|bypass)\b",
    r"\bpretend (you|that|to)\b",
    r"\brole\s*:\s*(system|assistant|user)\b",
)

# For each pattern, groups of lower-case substrings: a text can match only if
# it holds at least one substring of every group. Substring tests are far
# cheaper than the expressions and dismiss nearly all text.
NEEDED = (
    (("you are ", "you're "), ("assistant", "ai", "bot", "system", "admin")),
    (("ignore ",), ("previous ", "prior ", "above ", "earlier ")),
    (("ignore everything ", "ignore anything "),),
    (("forget your ", "forget all ", "forget previous ", "forget prior "),),
    (("override system ", "override safety ", "override security "),),
    (("system", "admin", "root"), ("prompt", "override", "mode", "access")),
    (("new system", "new instructions", "new persona", "new role"),),
    (("system>",),),
    (("[inst]",),),
    (("[/inst]",),),
    (("<<sys>>",),),
    (("<|im_start|>",),),
    (("```system",),),
    (("execute", "run", "eval", "exec"), ("(",)),
    (("curl",), ("-",)),
    (("wget",),),
    (("rm", "del", "remove"), ("-r", "--force")),
    (("base64",), ("decode", "encode", "eval")),
    (("atob",), ("(",)),
    (("do not review", "do not check", "do not flag", "do not report", "do not mention"),),
    (("this is ",), ("test", "safe", "authorized", "harmless"), ("ignore", "skip", "bypass")),
    (("pretend you", "pretend that", "pretend to"),),
    (("role",), (":",), ("system", "assistant", "user")),
)

MIN_LEAF_BYTES = 11


def java_pattern(pattern: str) -> str:
    """A pattern with Unicode semantics spelled out for the JVM.

    ``\\b`` and ``\\s`` follow Unicode, ``(?i)`` is ASCII plus the two letters
    that fold into it, and ``.`` stops at a line feed only.
    """
    starts = rf"(?<!{WORD_CHAR})"
    ends = rf"(?!{WORD_CHAR})"
    out = fold_letters(pattern)
    out = out.replace(r"[_\s\-]", r"[_\-\s\x{85}\p{Z}]").replace(r"\s*", f"{UNICODE_SPACE}*")
    out = out.replace(r"\s+", f"{UNICODE_SPACE}+")
    pieces = out.split(r"\b")
    text = pieces[0]
    for before, piece in zip(pieces, pieces[1:]):
        # Every boundary here has a word character on one known side: behind
        # it when a group or text just closed, ahead of it otherwise.
        opening = before == "" or before.endswith("*")
        text += (starts if opening and piece else ends) + piece
    return f"(?id){text}"


JAVA_PATTERNS = tuple(java_pattern(p) for p in PATTERNS)


def _holds_needed(folded: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    test = None
    for group in groups:
        one = None
        for piece in group:
            hit = F.contains(folded, F.lit(piece))
            one = hit if one is None else one | hit
        test = one if test is None else test & one
    return test


def pattern_hits(text: Column, folded: Column | None = None) -> list[Column]:
    """23 boolean columns, one per pattern."""
    low = folded_lower(text) if folded is None else folded
    return [
        _holds_needed(low, groups) & F.regexp_like(text, F.lit(java))
        for groups, java in zip(NEEDED, JAVA_PATTERNS)
    ]


def detect_injections(text: Column, folded: Column | None = None) -> Column:
    """Number of patterns (not occurrences) found in a text."""
    total = F.lit(0)
    for hit in pattern_hits(text, folded):
        total = total + hit.cast("int")
    return total


def may_hold_hit(json_text: Column) -> Column:
    """Superset test on raw JSON text: could any string leaf match a pattern?

    JSON can write a quote, a backslash, a slash and control characters with a
    short escape; every other character is hidden only by ``\\u``. So texts
    with ``\\u`` always qualify and groups holding a slash are left out.
    """
    low = folded_lower(json_text)
    test = F.contains(json_text, F.lit("\\u")) | F.contains(low, F.lit("inst]"))
    for groups in NEEDED:
        plain = tuple(g for g in groups if not any("/" in piece for piece in g))
        if plain:
            test = test | _holds_needed(low, plain)
    return test


LEAF = T.ArrayType(
    T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])
)


def _walk(value, path: str, out: list) -> None:
    stack = [(value, path)]
    while stack:
        node, where = stack.pop()
        if isinstance(node, str):
            if len(node.encode("utf-8", "surrogatepass")) >= MIN_LEAF_BYTES:
                out.append({"path": where, "text": node})
            continue
        if isinstance(node, dict):
            children = sorted(node.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))
        elif isinstance(node, list):
            children = [(str(i), item) for i, item in enumerate(node)]
        else:
            continue
        for name, child in reversed(children):
            stack.append((child, f"{where}.{name}" if where else name))


_LEAF_ARROW = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))


@F.arrow_udf(LEAF)
def _string_leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        result = []
        for text in batch.to_pylist():
            leaves: list = []
            if text is not None:
                _walk(json.loads(text), "", leaves)
            result.append(leaves)
        yield pa.array(result, _LEAF_ARROW)


def string_leaves(json_text: Column) -> Column:
    """String leaves of more than 10 UTF-8 bytes as (dotted path, text).

    Keys are visited in sorted order and array positions appear as numbers.
    The one place that needs Python: the nesting depth is open. Pass null for
    rows that need no look; they cost an empty Arrow slot.
    """
    return _string_leaves(json_text)


def flagged_leaves(json_text: Column) -> Column:
    """``[{field, count}]`` of the leaves with at least one pattern hit.

    ``count`` is the number of patterns that match. Only texts that might hold
    a hit are sent to Python; the expressions themselves run in the JVM.
    """
    leaves = string_leaves(F.when(may_hold_hit(json_text), json_text))
    counted = F.transform(
        leaves,
        lambda leaf: F.struct(
            leaf["path"].alias("field"), detect_injections(leaf["text"]).alias("count")
        ),
    )
    return F.coalesce(
        F.filter(counted, lambda flag: flag["count"] > 0),
        F.array().cast("array<struct<field:string,count:int>>"),
    )


def sanitized_text(json_text: Column, flags: Column) -> Column:
    """Payload text with ``_sanitized`` and, if there are hits, ``_flags`` set.

    The two fields go to the end of the object: on repeated keys the last one
    counts, so ours replace a caller's, and a caller's ``_flags`` survives when
    there are no hits.
    """
    trimmed = F.regexp_replace(json_text, r"[ \t\n\r]+\z", "")
    head = F.substring(trimmed, 1, F.length(trimmed) - 1)
    comma = F.when(F.regexp_like(head, F.lit(r"\A[ \t\n\r]*\{[ \t\n\r]*\z")), F.lit("")).otherwise(F.lit(","))
    marks = F.when(
        F.size(flags) > 0, F.concat(F.lit('"_flags":'), F.to_json(flags), F.lit(","))
    ).otherwise(F.lit(""))
    return F.concat(head, comma, marks, F.lit('"_sanitized":true}'))
