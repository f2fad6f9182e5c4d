"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard
parser evaluates and/or/with licence expressions.

Defined cases: null and empty texts have no words, no labels and score 0; a phrase matches wherever its
words stand consecutively, whatever ASCII separators stand between; overlapping places all count; an
expression that does not parse is ignored; a tag stands where the automaton finds its words. An expression ends with its
line, but for line breaks inside its brackets. After a tag with a colon or equals sign every name of an expression that
fills the rest of the line, the quotes or the comment is a label, listed or not (LicenseRef- too); after LOOSE, tags in
prose and expressions that other words follow, listed ones only, and expressions without them are ignored; repeated rows give repeated results; other columns are kept.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from shinglery.llm.common import map_texts

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notice phrases (as words) and the labels that they stand for.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "cc0 1 0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
}
#: Words before a licence expression.
LOOSE = "licensed under"
TAGS = ("spdx license identifier", LOOSE, "license expression")

#: How much a licence asks of a user, by the first prefix that fits; the rest count as UNKNOWN.
DUTY = (
    ("proprietary", 1.0), ("cc-by-nc", 0.9), ("cc-by-nd", 0.9), ("agpl", 0.8), ("gpl", 0.7), ("cc-by-sa", 0.6), ("lgpl", 0.5), ("mpl", 0.45), ("cc-by", 0.25),
    ("apache", 0.2), ("bsd", 0.15), ("mit", 0.1), ("isc", 0.1), ("unlicense", 0.05), ("cc0", 0.05), ("public-domain", 0.05),
)
UNKNOWN, EXCEPTION = 0.5, 0.6

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
NAME = r"(\(|\)|[A-Za-z0-9.+-]+(?::LicenseRef-[A-Za-z0-9.-]+)?)"
TOKEN = re.compile(r"[^\S\n]*" + NAME)
#: Inside brackets a line may break, and the next one begin as a comment does.
INNER = re.compile(r"\s*(?:(?:#|//|;|--|\*(?!/))[^\S\n]*)?" + NAME)
FIELD = re.compile(r"[^\S\n]*[\"'*]*[^\S\n]*[:=][^\S\n\"'*]*[\"'*]*")
HEAD = re.compile(r"[\s:=\"'*]*(?:(?:the|terms|of|either)\s+)*", re.I)
#: What stands behind an expression that fills its field.
CLOSED = re.compile(r"[^\S\n]*(?:\n|\Z|[\"'`,;|<>)\]}*]|-->|\*/|#|\\n)")
#: A word, as in the fixed definition.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lower case; all that cannot be in a word becomes a space.
WORDS = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)


def duty(label: str) -> float:
    return next((v for k, v in DUTY if label.startswith(k)), UNKNOWN)


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: `with` binds before `and` before `or`, all to the left; None if malformed."""
    out, ops, operand = [], [], False
    for t in tokens:
        low = t.lower()
        if low in PRECEDENCE:
            if not operand:
                return None
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        elif t == "(":
            if operand:
                return None
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops or not operand:
                return None
            ops.pop()
        else:
            if operand:
                return None
            out.append(low)
            operand = True
    if not operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(expression: list[str]) -> float | None:
    """The duties of an expression: the least of an `or`, the most of an `and`, eased by `with`."""
    stack: list[tuple[float, str]] = []
    if (order := postfix(expression)) is None:
        return None
    for t in order:
        if t not in PRECEDENCE:
            stack.append((duty(t), t))
            continue
        (b, _), (a, name) = stack.pop(), stack.pop()
        stack.append((a * EXCEPTION if t == "with" else min(a, b) if t == "or" else max(a, b), name))
    return stack[0][0]


def read_expression(text: str, at: int) -> tuple[list[str], list[str], int]:
    """The longest well-formed expression from `at`, its licence names, and where it ends; empty if there is none.

    Only `and`, `or`, `with` and brackets carry an expression over a further operand.
    """
    tokens, whole, depth, operand, end = [], 0, 0, False, at
    while m := (INNER if depth else TOKEN).match(text, at):
        t = m[1].rstrip(".") if m[1] not in "()" else m[1]
        word = t not in ("(", ")") and t.lower() not in PRECEDENCE
        if not t or (word and operand) or (t == ")" and (not depth or not operand)) or (t == "(" and operand) or (t.lower() in PRECEDENCE and not operand):
            break
        tokens.append(t)
        depth += (t == "(") - (t == ")")
        operand = word or t == ")"
        at = m.end()
        if operand and not depth:
            whole, end = len(tokens), at
        if word and m[1].endswith("."):
            break
    best = tokens[:whole]
    after_with = {i + 1 for i, t in enumerate(best) if t.lower() == "with"}
    return best, [t.lower() for i, t in enumerate(best) if t not in "()" and t.lower() not in PRECEDENCE and i not in after_with], end


@cache
def automaton() -> ahocorasick.Automaton:
    """Phrases between spaces over the lower-cased words, as bytes seen as Latin-1."""
    found: dict[str, list[tuple[int, str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {t: t for t in TAGS})):
        for p, label in phrases.items():
            found.setdefault(f" {p} ", []).append((len(p.split()), kind, label))
    a = ahocorasick.Automaton()
    for p, x in found.items():
        a.add_word(p, (len(p), x))
    a.make_automaton()
    return a


KNOWN = re.compile(r"(?:" + "|".join(re.escape(k) for k, _ in DUTY) + r")(?:[-+.0-9][a-z0-9.+-]*)?")


def scan(text: str) -> dict:
    """Words, places of base phrases, labels and the strictest duty among the statements of a text."""
    words = text.encode("utf-8", "replace").translate(LOWER).translate(WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    line = joined.decode("latin-1")
    starts, base, labels, duties, tags = [], set(), set(), [], []
    at = seen = 0
    for end, (size, kinds) in automaton().iter(line):
        begin = end - size + 1
        if begin >= at:
            seen += line.count(" ", at, begin)
        else:
            seen -= line.count(" ", begin, at)
        at = begin
        for _, kind, label in kinds:
            if kind == "base":
                starts.append(seen)
                base.add(label)
            if kind == "tag":
                tags.append((seen + label.count(" "), label))
            else:
                labels.add(label)
                duties.append(duty(label))
    if tags:
        ends = [m.end() for m in WORD.finditer(text)]
        for last, tag in tags:
            field = FIELD.match(text, ends[last])
            at = HEAD.match(text, ends[last]).end() if tag == LOOSE else field.end() if field else ends[last]
            tokens, names, end = read_expression(text, at)
            if tag == LOOSE or not field or not CLOSED.match(text, end):
                names = [n for n in names if KNOWN.fullmatch(n)]
            if names and (d := evaluate(tokens)) is not None:
                labels.update(names)
                duties.append(d)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": max(duties, default=0.0),
    }


SCHEMA = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def license_scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the columns of `scan` to each row; narrow, no shuffle."""

    def scanned(texts: list[str]) -> dict[str, list]:
        rows = [scan(t) for t in texts]
        return {c: [r[c] for r in rows] for c in SCHEMA}

    return map_texts(df, scanned, SCHEMA, text, keep)
