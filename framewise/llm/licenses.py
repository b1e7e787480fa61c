"""Licence scans: one Aho-Corasick pass for phrases and identifier tags, a shunting-yard parser for expressions.

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII
bytes; the automaton holds whole-word phrases and finds all places at once. The
tag `spdx license identifier` is one of them: from its place, the text after a
colon, up to the next tag or the line's end, begins with a licence expression
(and / or / with, parentheses; `with` binds strongest, `or` least), which is
taken whole and evaluated against a set of permitted licences. Prose may follow:
the expression ends where a word can't continue it, before an operator that no
licence follows (a licence is of a known family, or its name has a digit or a
dash), or with a name before a full stop, comma or semicolon.

Result for nulls and odd input: null or empty text has no words and no labels
and score 0; very long texts and expressions are taken whole, in time in
proportion to their length; an expression that breaks off, or that a licence
follows without an operator, gives its licences' labels but no verdict; rows that
share a doc_id are scanned one by one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows

#: Phrases as words -> label: fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices beyond the base: fixed values. Weight: how surely the phrase is a licence notice.
NOTICES = {
    "mozilla public license": ("mpl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "bsd license": ("bsd", 0.8),
    "boost software license": ("bsl", 0.9),
    "isc license": ("isc", 0.8),
    "eclipse public license": ("epl", 0.9),
    "creative commons": ("cc", 0.6),
    "cc by": ("cc-by", 0.6),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "cc0 1 0": ("cc0", 0.7),
    "public domain": ("public-domain", 0.4),
    "all rights reserved": ("proprietary", 0.5),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "permission to use copy modify and or distribute this software": ("isc", 0.9),
}
BASE_WEIGHT = 0.7
LEAD_WEIGHT = 0.5
#: Words that lead to a notice; they raise the score of a phrase, and give no label: fixed values.
LEADS = ("licensed under", "released under", "under the terms of", "distributed under")
TAG = "spdx license identifier"
TAG_WEIGHT = 0.95
#: Licence identifiers' first parts -> label: fixed values.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "bsd": "bsd", "isc": "isc", "epl": "epl", "bsl": "bsl", "cc0": "cc0"}
#: Licences that the default policy permits, by label: fixed values.
PERMITTED = frozenset({"mit", "apache", "bsd", "isc", "bsl", "cc0", "cc-by"})

WORD_BYTES = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in range(256))
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permitted boolean"


# Expressions


class BadExpression(ValueError):
    """Not a licence expression."""


#: Operator -> how strongly it binds.
BINDS = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: the expression's names and operators in postfix order; raises BadExpression."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in re.findall(r"[()]|[^\s()]+", expression):
        kind = token.lower()
        if kind == "(":
            if not operand_next:
                raise BadExpression(expression)
            stack.append(kind)
        elif kind == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if operand_next or not stack:
                raise BadExpression(expression)
            stack.pop()
        elif kind in BINDS:
            if operand_next:
                raise BadExpression(expression)
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[kind]:
                out.append(stack.pop())
            stack.append(kind)
            operand_next = True
        elif not operand_next:
            raise BadExpression(expression)
        else:
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        raise BadExpression(expression)
    return out + stack[::-1]


def evaluate(postfix: list[str], permitted) -> bool:
    """Whether the expression can be met: `permitted(name)` for names; `with` keeps its licence's verdict."""
    stack: list[bool] = []
    for token in postfix:
        if token not in BINDS:
            stack.append(permitted(token))
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if token == "with" else left and right if token == "and" else left or right)
    return stack.pop()


def label_of(name: str) -> str:
    """The label of a licence identifier: its family's, else itself in lower case."""
    name = name.lower().rstrip("+")
    if name.startswith("cc-"):
        return "-".join(p for p in name.split("-") if p.isalpha())
    return FAMILIES.get(re.split(r"[-.]", name)[0], name)


# The scan


@dataclass
class Scan:
    """What one text holds; `places` are (word, phrase)."""

    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)
    expressions: list[str] = field(default_factory=list)
    labels: set[str] = field(default_factory=set)
    permitted: bool | None = None
    score: float = 0.0

    def base(self) -> list[tuple[int, str]]:
        return [(w, p) for w, p in self.places if p in BASE]


@cache
def automaton():
    """All phrases with a space on either side, so that only whole words match."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, **dict.fromkeys(LEADS), TAG: None}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A colon after a tag, on its line, and the rest of the line.
AFTER_TAG = re.compile(rb"[^\S\r\n]*:[^\S\r\n]*([^\r\n]*)")
#: A parenthesis, a name or an operator, or anything else.
TOKEN = re.compile(r"[()]|[a-z0-9.+:_-]+|\S")


def scan(text: bytes | None) -> Scan:
    """Scan one whole UTF-8 text."""
    if not text:
        return Scan()
    low = text.lower()
    words = low.translate(WORD_BYTES).split()
    found = Scan(n_words=len(words))
    if not words:
        return found
    line = b" " + b" ".join(words) + b" "
    hits = [(end + 1 - len(p) - 2, p) for end, p in automaton().iter(line.decode("latin-1"))]
    counted, at = 0, 0
    weights: dict[str, float] = {}
    leads: list[int] = []
    for start, phrase in sorted(hits):
        counted += line.count(b" ", at, start)
        at = start
        if phrase in LEADS:
            leads.append(counted)
            continue
        found.places.append((counted, phrase))
    for word, phrase in found.places:
        if phrase in BASE:
            label, weight = BASE[phrase], BASE_WEIGHT
        elif phrase in NOTICES:
            label, weight = NOTICES[phrase]
        else:
            continue
        found.labels.add(label)
        k = bisect_right(leads, word)
        if k and word - leads[k - 1] <= 6:
            weight = 1 - (1 - weight) * (1 - LEAD_WEIGHT)
        weights[phrase] = max(weight, weights.get(phrase, 0))
    tags = [w for w, p in found.places if p == TAG]
    if tags:
        _tags(low, tags, found, weights)
    rest = 1.0
    for phrase in sorted(weights):
        rest *= 1 - weights[phrase]
    found.score = 1 - rest
    return found


def is_identifier(name: str) -> bool:
    """Whether a lower-case name is a licence's: a known family, or of the form of an identifier (a digit or a dash in it)."""
    return label_of(name) in FAMILIES.values() or name[0].isalnum() and any(c.isdigit() or c == "-" for c in name)


def leading_expression(text: str) -> str:
    """The licence expression that a text begins with; raises BadExpression where it breaks off or a licence follows.

    Prose after an operator ends the expression before that operator.
    """
    depth, complete, end, whole = 0, False, 0, None
    for m in TOKEN.finditer(text):
        token = m[0]
        name = token.rstrip(".,;:") if token not in BINDS else ""
        if token == "(" and not complete:
            depth += 1
        elif token == ")" and complete and depth:
            depth -= 1
            end = m.end()
        elif token in BINDS and complete:
            complete = False
        elif not complete and name and TOKEN.fullmatch(name) and is_identifier(name):
            complete, end = True, m.start() + len(name)
        elif not complete and name and name[0].isalpha() and whole:
            return text[:whole]
        elif complete and not depth and label_of(name) not in FAMILIES.values():
            break
        else:
            raise BadExpression(text)
        if complete and not depth:
            whole = end
        if complete and name and name != token:
            break
    if depth or not complete:
        raise BadExpression(text)
    return text[:end]


def _tags(low: bytes, tags: list[int], found: Scan, weights: dict[str, float]) -> None:
    """Parse what follows the identifier tags at these words; several tags must all be permitted."""
    spans: dict[int, tuple[int, int]] = {}
    wanted = {w for t in tags for w in (t, t + TAG.count(" "))}
    last = max(wanted)
    for k, m in enumerate(WORD.finditer(low)):
        if k in wanted:
            spans[k] = m.span()
        if k == last:
            break
    verdicts: list[bool] = []
    for tag, following in zip(tags, [*tags[1:], None], strict=True):
        m = AFTER_TAG.match(low, spans[tag + TAG.count(" ")][1], len(low) if following is None else spans[following][0])
        if not m or not m[1].strip():
            continue
        rest = m[1].decode("utf-8", "replace").strip()
        try:
            expression = leading_expression(rest)
            postfix = to_postfix(expression)
        except BadExpression:
            found.expressions.append(rest.rstrip("*/#-> ").strip())
            known = {label_of(t) for t in re.findall(r"[a-z0-9.+-]+", rest)} & {*FAMILIES.values()}
            found.labels |= known
            if known:
                weights[TAG] = TAG_WEIGHT
            continue
        found.expressions.append(expression)
        exceptions = {postfix[i - 1] for i, t in enumerate(postfix) if t == "with"}
        found.labels.update(label_of(t) for t in postfix if t not in BINDS and t not in exceptions)
        verdicts.append(evaluate(postfix, lambda name: label_of(name) in PERMITTED))
        weights[TAG] = TAG_WEIGHT
    if verdicts:
        found.permitted = all(verdicts)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per document: counts and places of base phrases, labels, score, expressions and their verdict."""

    def read(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = scan(text)
                base = found.base()
                starts = [w for w, _ in base]
                rows.append(
                    (
                        doc_id,
                        found.n_words,
                        len(base),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted({BASE[p] for _, p in base})),
                        ",".join(sorted(found.labels)),
                        found.score,
                        found.expressions,
                        found.permitted,
                    )
                )
            types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    arrow_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(read, RESULT)
