"""Operator 2: licence scan.  One Aho-Corasick pass finds notice phrases, a second finds identifier tags; a shunting-yard
parser turns the tags' and/or/with expressions into a verdict.

After an SPDX tag the expression must fill its line and may name anything; after ``license:``, which prose has too, it
goes as far as known identifiers do; those that are words of prose too (``ruby on rails``) must end their line.

Defined cases: null text is empty; an empty text has no words, null positions, empty labels and score 0; a malformed
expression contributes the known licences before the fault and no verdict; a null id stays null; rows are independent,
so ties and repeated rows need no rule; a text of any length is read once, in time and memory in proportion to it; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

#: The contract's phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases of well-known public licences.
NOTICES = {
    "the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "public domain dedication": "cc0",
    "all rights reserved": "all-rights-reserved",
}
#: Phrases that score as high as the contract's: a licence called by its full name.
SURE = frozenset({*BASE_PHRASES, "the mit license"})
#: Tag identifiers whose label differs from the identifier itself.
ALIASES = {"apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc0-1.0": "cc0", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd"}
PERMISSIVE = frozenset({"mit", "apache-2", "bsd", "isc", "zlib", "unlicense", "cc0", "cc-by", "0bsd"})
#: Tags, and whether what follows is an expression by syntax alone.
TAGS = {"spdx-license-identifier:": True, "license-expression:": True, "license:": False}
#: Families of public licence identifiers, as SPDX writes them.
KNOWN = re.compile(
    r"(mit(-0)?|0bsd|isc|zlib|unlicense|wtfpl|postgresql|ncsa|openssl|ruby|vim|x11|cc0-1\.0|(apache|epl|eupl|mpl|osl|afl|artistic|bsl|cddl|cpl|psf|python|php|zpl|ofl|ms-pl|ecl|upl|cecill)-[0-9.]+"
    r"|bsd(-[0-4]-clause(-[a-z]+)?)?|[al]?gpl-[0-9.]+(\+|-only|-or-later)?|gfdl-[0-9.]+(-only|-or-later)?|cc-by(-nc)?(-sa|-nd)?-[0-9.]+|licenseref-[a-z0-9.-]+)\.?"
)
#: Known identifiers that are common words.
PROSE = frozenset({"ruby", "vim"})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
#: What may follow an expression on its line: blanks, punctuation and ends of comments.
REST = re.compile(r"[ \t\r.,;\"'#*/>-]*(?=\n|\Z)")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
BINDS = {"or": 1, "and": 2, "with": 3}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, permissive boolean, phrases array<struct<label: string, first_word: long>>"


def to_rpn(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: infix to postfix; None if the expression is malformed."""
    out: list[str] = []
    wait: list[str] = []
    operand = True
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            wait.append(t)
        elif t == ")":
            if operand:
                return None
            while wait and wait[-1] != "(":
                out.append(wait.pop())
            if not wait:
                return None
            wait.pop()
        elif t in BINDS:
            if operand:
                return None
            while wait and wait[-1] != "(" and BINDS[wait[-1]] >= BINDS[t]:
                out.append(wait.pop())
            wait.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in wait:
        return None
    return out + wait[::-1]


def label_of(identifier: str) -> str:
    return ALIASES.get(identifier.rstrip("."), identifier.rstrip("."))


def evaluate(rpn: list[str]) -> tuple[bool, list[str]]:
    """(whether the terms can be met by permissive licences alone, the licences named).  An exception never widens a term."""
    stack: list[tuple[bool, list[str]]] = []
    for t in rpn:
        if t not in BINDS:
            stack.append((label_of(t) in PERMISSIVE, [label_of(t)]))
            continue
        (rb, b), (ra, a) = stack.pop(), stack.pop()
        stack.append((ra, a) if t == "with" else (ra or rb, a + b) if t == "or" else (ra and rb, a + b))
    return stack[0]


def tag_tokens(low: str, at: int = 0, any_name: bool = True) -> list[str]:
    """The longest run of tokens from ``at`` on, within its line, that alternates licences and operators, brackets aside.

    Without ``any_name`` it ends before a licence that is not known; what stands after ``with`` is an exception's name.
    Otherwise nothing else may stand on the line, or the unknown licences are prose and the run is read again without.
    """
    found, operand, depth, start = [], True, 0, at
    while m := TOKEN.match(low, at):
        t = m.group(1)
        if t in BINDS or t == ")":
            if operand or (t == ")" and not depth):
                break
            operand = t != ")"
            depth -= t == ")"
        elif not operand or not (any_name or t == "(" or KNOWN.fullmatch(t) or found[-1:] == ["with"]):
            break
        else:
            operand = t == "("
            depth += t == "("
        found.append(t)
        at = m.end()
    if any_name and not REST.match(low, at):
        return tag_tokens(low, start, False)
    if not any_name and found and found[-1] in PROSE and not REST.match(low, at):
        found.pop()
    while found and (found[-1] in BINDS or found[-1] == "("):
        found.pop()
    return found


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p, label in {**NOTICES, **BASE_PHRASES}.items():
        phrases.add_word(f" {p} ", (len(p) + 2, label, p in BASE_PHRASES, p in SURE))
    for t, strict in TAGS.items():
        tags.add_word(t, (len(t), strict))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None) -> dict:
    """Every field of the result for one text."""
    phrases, tags = automata()
    low = (text or "").translate(ASCII_LOWER)
    found = WORD.findall(low)
    flat = f" {' '.join(found)} "
    hits = [(end - size + 1, label, base, sure) for end, (size, label, base, sure) in phrases.iter(flat)]
    places: list[tuple[int, str, bool, bool]] = []
    if hits:
        starts, at = [], 0
        for w in found:
            starts.append(at)
            at += len(w) + 1
        places = sorted((bisect_right(starts, s) - 1, label, base, sure) for s, label, base, sure in hits)
    base = [(w, label) for w, label, b, _ in places if b]
    base_labels = {label for _, label in base}
    labels = {label for _, label, _, _ in places}
    expression, permissive = None, None
    for end, (_, strict) in tags.iter_long(low):
        tokens = tag_tokens(low, end + 1, strict)
        rpn = to_rpn(tokens)
        named = {label_of(t) for t, before in zip(tokens, ["", *tokens], strict=False) if t not in BINDS and t not in "()" and before != "with"}
        if rpn:
            ok, listed = evaluate(rpn)
            named = set(listed)
            if expression is None:
                expression, permissive = " ".join(tokens), ok
        labels |= named
    if permissive is None and labels:
        permissive = labels <= PERMISSIVE
    score = 1.0 if expression else 0.95 if any(sure for *_, sure in places) else 0.7 if labels else 0.0
    return {
        "n_words": len(found), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": score, "expression": expression, "permissive": permissive,
        "phrases": [{"label": label, "first_word": w} for w, label, _, _ in places],
    }


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the places, labels, expression and verdict of its licence notices."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        for b in batches:
            found = [scan_text(t) for t in b.column(1).to_pylist()]
            cols = {k: [x[k] for x in found] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expression", "permissive", "phrases")}
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expression": pa.string(), "permissive": pa.bool_(), "phrases": pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kinds[k]) for k, v in cols.items())], names=["doc_id", *cols])

    return rows.mapInArrow(scan, SCHEMA)
