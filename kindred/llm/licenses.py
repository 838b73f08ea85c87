"""Licence scan: an Aho-Corasick automaton over word sequences, and licence expressions.

A text's words are runs of ASCII letters and digits (lower-cased) and of all non-ASCII signs.
The automaton finds every place where the words of a phrase stand consecutively: the base
phrases, further notice phrases, licence identifiers, and the tag words that announce an
expression.  An expression after a tag (identifiers with AND, OR, WITH, ``+`` and parentheses)
is read from the text itself and evaluated with a shunting-yard parser: its labels, and whether
it can be met with permissive licences alone (OR takes the better side, AND the worse).

The score is the strength of the evidence: 1 for an expression that parses, 0.9 for a base
phrase, 0.6 for other notices or identifiers, 0 for none.  Null and empty texts have no words,
no labels and score 0.  Rows are independent: repeats repeat, no rows give no rows, and further
columns pass through (a column named like the new one is replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notice phrases of common licences, in normalised words.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "apache software license": "apache",
    "gnu lesser general public": "lgpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "under cc by": "cc-by",
    "under cc by sa": "cc-by-sa",
    "under cc by nc": "cc-by-nc",
    "under cc by nd": "cc-by-nd",
    "under cc by nc sa": "cc-by-nc-sa",
    "under cc by nc nd": "cc-by-nc-nd",
    "under cc0": "cc0",
    "all rights reserved": "proprietary",
}

# Identifiers that an expression may hold, with their label and whether they are permissive.
IDENTIFIERS = {
    "mit": ("mit", True),
    "apache-2.0": ("apache", True),
    "apache-1.1": ("apache", True),
    "bsd-2-clause": ("bsd", True),
    "bsd-3-clause": ("bsd", True),
    "isc": ("isc", True),
    "bsl-1.0": ("bsl", True),
    "zlib": ("zlib", True),
    "unlicense": ("unlicense", True),
    "cc0-1.0": ("cc0", True),
    "cc-by-4.0": ("cc-by", True),
    "cc-by-sa-4.0": ("cc-by-sa", False),
    "cc-by-nc-4.0": ("cc-by-nc", False),
    "gpl-2.0": ("gpl", False),
    "gpl-3.0": ("gpl", False),
    "lgpl-2.1": ("lgpl", False),
    "lgpl-3.0": ("lgpl", False),
    "agpl-3.0": ("agpl", False),
    "mpl-2.0": ("mpl", False),
    "epl-2.0": ("epl", False),
}

#: Tag words that announce an expression, and the tag as it is written.
TAG = "spdx license identifier"
WRITTEN_TAG = re.compile(r"spdx[^0-9a-z]{1,3}license[^0-9a-z]{1,3}identifier\s*:?[ \t]*([^\r\n]*)")
PIECE = re.compile(r"[()]|[0-9a-z][0-9a-z.+-]*")
STRENGTH = {"or": 1, "and": 2, "with": 3}

_SEPARATORS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

RESULT = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:array<string>,"
    "labels:array<string>,expressions:array<string>,permissive:boolean,score:double>"
)


def words(text: str) -> list[str]:
    """A text's words in lower case."""
    return text.encode("utf-8").translate(_SEPARATORS).decode("utf-8").split(" ")


def postfix(expression: str) -> list[str]:
    """Shunting-yard: operands and operators of a licence expression in postfix order.

    Reading ends quietly at the first piece that cannot go on an expression (a sentence may
    follow on the line).  Raises ValueError if what was read is not an expression.
    """
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether an operand is due
    for piece in PIECE.findall(expression):
        if piece in STRENGTH:
            if operand:
                raise ValueError("operator without a left side")
            while held and held[-1] != "(" and STRENGTH[held[-1]] >= STRENGTH[piece]:
                out.append(held.pop())
            held.append(piece)
            operand = True
        elif piece == "(":
            if not operand:
                break
            held.append(piece)
        elif piece == ")":
            if operand or "(" not in held:
                raise ValueError("unbalanced")
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            if not operand:
                break
            out.append(piece)
            operand = False
    if operand or "(" in held:
        raise ValueError("incomplete")
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], bool]:
    """Labels of an expression, and whether permissive licences alone can meet it."""
    stack: list[tuple[set[str], bool]] = []
    for piece in postfix(expression):
        if piece in STRENGTH:
            right, left = stack.pop(), stack.pop()
            if piece == "with":  # the right side is an exception to the left one
                stack.append(left)
            else:
                free = left[1] or right[1] if piece == "or" else left[1] and right[1]
                stack.append((left[0] | right[0], free))
        else:
            stack.append(_identified(piece))
    return stack[0]


def _identified(name: str) -> tuple[set[str], bool]:
    base = re.sub(r"(\+|-only|-or-later|\.)$", "", name)
    label, free = IDENTIFIERS.get(base, (base, False))
    return {label}, free


def automaton() -> ahocorasick.Automaton:
    """Phrases as blank-delimited words; each carries (is base, label, number of words)."""
    machine = ahocorasick.Automaton()
    phrases = {phrase: (False, label) for phrase, label in NOTICES.items()}
    for name, (label, _) in IDENTIFIERS.items():
        spoken = " ".join(re.findall(r"[0-9a-z]+", name))
        if " " in spoken:  # a single word such as "mit" is no evidence
            phrases.setdefault(spoken, (False, label))
    phrases[TAG] = (False, "")
    phrases |= {phrase: (True, label) for phrase, label in BASE.items()}
    for phrase, (base, label) in phrases.items():
        machine.add_word(f" {phrase} ", (base, label, len(phrase) + 2))
    machine.make_automaton()
    return machine


def scan_text(text: str, machine: ahocorasick.Automaton) -> dict:
    found = [w for w in words(text) if w]
    line = f" {' '.join(found)} "
    starts: list[int] = []
    base: set[str] = set()
    others: dict[int, tuple[int, str]] = {}  # by start: of phrases that begin together the longest counts
    tagged = False
    seen = at = 0  # blanks up to a position, counted onwards as matches come in order of their ends
    for end, (is_base, label, length) in machine.iter(line):
        if is_base:
            begin = end - length + 1
            if begin >= at:
                seen += line.count(" ", at, begin)
                at = begin
                starts.append(seen)
            else:
                starts.append(seen - line.count(" ", begin, at))
            base.add(label)
        elif label:
            others[end - length] = max(others.get(end - length, (0, "")), (length, label))
        else:
            tagged = True
    labels = {label for _, label in others.values()}
    expressions, permissive, parsed = [], None, False
    if tagged:
        for m in WRITTEN_TAG.finditer(text.lower()):
            try:
                names, free = evaluate(m[1])
            except ValueError:
                continue
            parsed = True
            expressions.append(m[1].strip())
            labels |= names
            permissive = free if permissive is None else permissive and free
    score = 1.0 if parsed else 0.9 if base else 0.6 if labels else 0.0
    return {
        "n_words": len(found),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": sorted(base),
        "labels": sorted(base | labels),
        "expressions": expressions,
        "permissive": permissive,
        "score": score,
    }


def scan(docs: DataFrame, text: str = "text", out: str = "license") -> DataFrame:
    """Add a struct: word count, base places, labels, expressions, permissiveness and score."""
    small_batches(docs.sparkSession)
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_base", pa.int64()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("base_labels", pa.list_(pa.string())),
            ("labels", pa.list_(pa.string())),
            ("expressions", pa.list_(pa.string())),
            ("permissive", pa.bool_()),
            ("score", pa.float64()),
        ]
    )

    def scan_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton()
        for batch in batches:
            yield pa.array([scan_text(t.as_py() or "", machine) for t in batch], kind)

    return docs.withColumn(out, F.arrow_udf(scan_texts, RESULT)(text))


def license_report(docs: DataFrame) -> DataFrame:
    """Per row: words, base places with their smallest and largest start, labels and score."""
    found = scan(docs.select("doc_id", "text"), out="__l")
    return found.select(
        "doc_id",
        *[F.col(f"__l.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join("__l.base_labels", ",").alias("base_labels"),
        F.array_join("__l.labels", ",").alias("labels"),
        F.col("__l.score").alias("score"),
        F.col("__l.permissive").alias("permissive"),
    )
