"""Licence notices: Aho-Corasick over words, expressions by shunting-yard.

A text's words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased)
are joined by one space, and one Aho-Corasick automaton finds in one pass every
place of every notice phrase and every tag that introduces a licence expression
(``SPDX-License-Identifier:``, ``licensed under`` ...). At a tag, the expression
is read from the text itself up to the end of its line: operators are stacked
by their binding (WITH before AND before OR, parentheses before all) and the
postfix form is evaluated at once:

* an identifier has the labels and the level of its family (1 permissive,
  2 weak copyleft, 3 strong copyleft, 4 restricted);
* AND binds to both sides: union of labels, larger level;
* OR leaves the choice: the side of the smaller level (both sides' labels when
  level);
* WITH and a known exception lowers strong to weak copyleft.

Reading stops before the first word that is no part of an expression; what was
read must be whole (an operator at the end is left out, an open parenthesis
makes it void). ``score`` is the largest level among the notices and evaluated
expressions of a document over 4: 0 without any.

Defined cases: a null text is empty; empty texts have zero counts, null
positions, empty label lists and score 0; overlapping and repeated places all
count; texts of any length are one pass in memory proportional to one text;
null ids and repeated rows keep their rows; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm.common import slices

#: Fixed by the task.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Levels of licence families.
PERMISSIVE, WEAK, STRONG, RESTRICTED = 1, 2, 3, 4
#: Notice phrases as words, with the label that each adds.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "public domain": "public-domain",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "proprietary and confidential": "proprietary",
}
LEVEL = {
    "mit": PERMISSIVE, "apache": PERMISSIVE, "bsd": PERMISSIVE, "isc": PERMISSIVE, "zlib": PERMISSIVE, "unlicense": PERMISSIVE,
    "public-domain": PERMISSIVE, "cc0": PERMISSIVE, "cc-by": PERMISSIVE,
    "mpl": WEAK, "epl": WEAK, "lgpl": WEAK, "cc-by-sa": WEAK,
    "gpl": STRONG, "agpl": STRONG,
    "cc-by-nc": RESTRICTED, "cc-by-nd": RESTRICTED, "cc-by-nc-sa": RESTRICTED, "cc-by-nc-nd": RESTRICTED,
    "reserved": RESTRICTED, "proprietary": RESTRICTED,
}
#: Words that introduce an expression.
TAGS = ("spdx license identifier", "license expression", "licensed under", "released under", "distributed under")
#: Identifiers as they stand in an expression, without version.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense",
    "mpl": "mpl", "epl": "epl", "lgpl": "lgpl", "gpl": "gpl", "agpl": "agpl", "cc0": "cc0", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa",
    "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc-nd": "cc-by-nc-nd", "proprietary": "proprietary",
}
EXCEPTIONS = ("classpath-exception", "gcc-exception", "llvm-exception", "linking-exception", "autoconf-exception", "font-exception")
BINDING = {"or": 1, "and": 2, "with": 3}

_CUT = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOKEN = re.compile(rb"[ \t]*([()]|[0-9A-Za-z.+-]*[0-9A-Za-z+])")
#: A version, as in -2.0-only, -3-clause, 4.0 or 2.0+.
_VERSION = re.compile(r"(?:[- ]?v?\d[\d.]*(?:-clause)?)?(?:-only|-or-later|\+)?$")


@cache
def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for phrase in (*BASE, *NOTICES, *TAGS):
        auto.add_word(f" {phrase} ", phrase)
    auto.make_automaton()
    return auto


def _identifier(token: str) -> str | None:
    token = token.lower()
    return IDENTIFIERS.get(token) or IDENTIFIERS.get(_VERSION.sub("", token))


def _apply(op: str, values: list) -> None:
    right, left = values.pop(), values.pop()
    if op == "with":
        values.append((left[0], WEAK if left[1] == STRONG else left[1]))
    elif op == "and":
        values.append((left[0] | right[0], max(left[1], right[1])))
    elif left[1] == right[1]:
        values.append((left[0] | right[0], left[1]))
    else:
        values.append(min(left, right, key=lambda v: v[1]))


def evaluate(line: bytes) -> tuple[frozenset[str], int] | None:
    """Labels and level of the licence expression at the start of ``line``."""
    tokens, at = [], 0
    while m := _TOKEN.match(line, at):
        tokens.append(m.group(1).decode())
        at = m.end()
    values: list = []
    ops: list[str] = []
    depth, whole = 0, None
    operand = True
    for k, token in enumerate(tokens):
        low = token.lower()
        if operand:
            if low == "(":
                ops.append(low)
                depth += 1
                continue
            if low == "the" and k == 0:
                continue
            if ops and ops[-1] == "with":
                if not low.startswith(EXCEPTIONS):
                    break
                values.append(None)
            elif label := _identifier(low):
                values.append((frozenset([label]), LEVEL[label]))
            elif low == "cc" and k + 1 < len(tokens) and (label := _identifier(f"cc-{tokens[k + 1]}")):
                tokens[k + 1] = ""
                values.append((frozenset([label]), LEVEL[label]))
            else:
                break
            operand = False
        elif low == "":
            continue
        elif low in BINDING:
            while ops and ops[-1] != "(" and BINDING[ops[-1]] >= BINDING[low]:
                _apply(ops.pop(), values)
            if not ops and len(values) == 1:
                whole = values[0]
            ops.append(low)
            operand = True
            continue
        elif low == ")" and depth:
            while ops[-1] != "(":
                _apply(ops.pop(), values)
            ops.pop()
            depth -= 1
        else:
            break
    if operand and ops and ops[-1] != "(":
        ops.pop()
    if "(" in ops or not values:
        return whole
    while ops and len(values) > 1:
        _apply(ops.pop(), values)
    return values[0]


def scan(text: bytes) -> tuple[int, int, int | None, int | None, list[str], list[str], int]:
    """Words, base places, first and last base word, base labels, all labels and
    level of one text."""
    words = text.translate(_CUT).split()
    # one character per byte, so that places are byte offsets
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    tags: list[int] = []
    level = 0
    for end, phrase in _automaton().iter(line):
        if phrase in BASE:
            base.add(BASE[phrase])
            labels.add(BASE[phrase])
            starts.append(end - len(phrase) - 1)
        elif phrase in NOTICES:
            labels.add(NOTICES[phrase])
        else:
            tags.append(end)
    level = max((LEVEL[x] for x in labels), default=0)
    if tags:
        # the end of each tag's last word in the text itself
        number, seen, ends = 0, 0, []
        for end in tags:
            number += line.count(" ", seen, end)
            seen = end
            ends.append(number)
        wanted = iter(ends)
        goal = next(wanted)
        for i, m in enumerate(_WORD.finditer(text), 1):
            if i == goal:
                rest = m.end()
                while rest < len(text) and text[rest] in b" :\t":
                    rest += 1
                stop = text.find(b"\n", rest)
                found = evaluate(text[rest:stop if stop >= 0 else len(text)])
                if found:
                    labels |= found[0]
                    level = max(level, found[1])
                goal = next(wanted, None)
                if goal is None:
                    break
    first = last = None
    if starts:
        first = line.count(" ", 0, min(starts))
        last = first + line.count(" ", min(starts), max(starts))
    return len(words), len(starts), first, last, sorted(base), sorted(labels), level


def notices(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (comma
    lists), level and score of every row of ``docs``."""

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, level int, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [scan(t.as_py() or b"") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)),
                    *(pa.array([",".join(r[k]) for r in rows], pa.string()) for k in (4, 5)),
                    pa.array([r[6] for r in rows], pa.int32()),
                    pa.array([r[6] / RESTRICTED for r in rows], pa.float64()),
                ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "level", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text")).mapInArrow(work, schema)
