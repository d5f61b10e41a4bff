"""Licence scans: identifier tags, notice phrases and licence expressions.

All texts of a batch are laid out as lower-case words with one blank between them,
so that one Aho-Corasick automaton finds phrases and tags at once, wherever they
stand and however their words are separated. Behind a tag (``SPDX-License-Identifier:``
and the like) the raw text is read as a licence expression: a shunting-yard parser puts
it into postfix order and evaluates it. ``and`` joins duties, ``or`` leaves a choice,
``with`` eases the licence before it.

Every text is a row of its own and nothing is shuffled. Edge cases: null and empty
texts have no words and no places; overlapping phrases all count; an expression that
breaks off or does not balance is reported with ``valid`` false and the licences read
so far; repeated rows give repeated results; other columns pass through, those with
the names of added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from calltide.llm.common import LOWER, chunks

# Phrases of the base rules and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# More notices, in the words of the licences themselves.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# Tags before an expression; a strict one may name only licences known here.
TAGS = {"spdx license identifier": False, "license": True, "licence": True, "license expression": True}

# Identifier beginnings, label and strictness (0 free use, 1 notice, 2 share
# changes of the files, 3 share the whole work, 4 share over a network too, 5 no free use).
FAMILIES = {
    "0bsd": ("bsd", 0),
    "agpl": ("agpl", 4),
    "apache": ("apache", 1),
    "artistic": ("artistic", 1),
    "bsd": ("bsd", 1),
    "bsl": ("bsl", 1),
    "cc-by-nc": ("cc-by-nc", 5),
    "cc-by-nd": ("cc-by-nd", 5),
    "cc-by-sa": ("cc-by-sa", 3),
    "cc-by": ("cc-by", 1),
    "cc0": ("cc0", 0),
    "epl": ("epl", 2),
    "eupl": ("eupl", 3),
    "gfdl": ("gfdl", 3),
    "gpl": ("gpl", 3),
    "isc": ("isc", 1),
    "lgpl": ("lgpl", 2),
    "mit": ("mit", 1),
    "mpl": ("mpl", 2),
    "postgresql": ("postgresql", 1),
    "python": ("python", 1),
    "unlicense": ("unlicense", 0),
    "wtfpl": ("wtfpl", 0),
    "zlib": ("zlib", 1),
}
UNKNOWN = 5

# How far a place speaks for a licence of the text.
WEIGHTS = {"tag": 0.9, "broken": 0.3, "phrase": 0.6}

_IS_WORD = np.ones(256, bool)
_IS_WORD[:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False
_BLANK, _BREAK = 0x20, 0x0A
_GAP = b" \n "


@lru_cache(maxsize=4096)
def family(identifier: str) -> tuple[str, int, bool]:
    """Label, strictness and whether the identifier (``GPL-2.0-only``) is known."""
    name = identifier.lower().rstrip("+")
    parts = name.split("-")
    for size in range(min(3, len(parts)), 0, -1):
        known = FAMILIES.get("-".join(parts[:size]))
        if known:
            return *known, True
    return name, UNKNOWN, False


@dataclass
class Expression:
    """A licence expression: its postfix order and what it comes to."""

    postfix: list[str]
    licenses: list[str]
    strictness: int | None
    valid: bool
    known: bool


_ATOM = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:\-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def read_expression(text: str) -> Expression:
    """Reads the expression that ``text`` starts with; what follows it is left alone.

    Shunting-yard: operands go out, operators wait until one that binds less (or a
    bracket) comes. An operator without its right side ends the expression as broken.
    """
    out: list[str] = []
    waiting: list[str] = []
    at, operand_next, valid = 0, True, True
    while found := _ATOM.match(text, at):
        token = found.group(1)
        word = token.lower()
        if operand_next:
            if token == "(":
                waiting.append(token)
            elif token == ")" or word in _BINDS:
                break
            else:
                out.append(token.rstrip(".:"))
                operand_next = False
        elif word in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        elif token == ")" and "(" in waiting:
            while (top := waiting.pop()) != "(":
                out.append(top)
        else:
            break
        at = found.end()
    if operand_next:  # broken off: the operator that lacks its right side goes
        valid = False
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    while waiting:
        top = waiting.pop()
        if top == "(":
            valid = False
        else:
            out.append(top)
    return _evaluated(out, valid)


def _evaluated(postfix: list[str], valid: bool) -> Expression:
    stack: list[tuple[int, str]] = []
    licenses: set[str] = set()
    known = True
    exceptions = {k - 1 for k, x in enumerate(postfix) if x == "with"}
    for k, token in enumerate(postfix):
        if token == "with":
            stack.pop()
            level, name = stack.pop()
            # An exception lifts the duty to share the whole work to that of the files.
            stack.append((min(level, 2) if level in (3, 4) else level, name))
        elif token in _BINDS:
            right, left = stack.pop(), stack.pop()
            stack.append(max(left, right) if token == "and" else min(left, right))
        elif k in exceptions:
            stack.append((0, token))
        else:
            label, level, is_known = family(token)
            licenses.add(label)
            known &= is_known
            stack.append((level, label))
    level = stack[-1][0] if stack else None
    return Expression(postfix, sorted(licenses), level, valid and bool(stack), known and bool(stack))


@lru_cache(maxsize=1)
def automaton() -> tuple[ahocorasick.Automaton, list[tuple[str, str, str]]]:
    """The automaton of all phrases and tags between blanks, and its rules (kind, text, label)."""
    rules = [("base", p, label) for p, label in BASE_PHRASES.items()]
    rules += [("notice", p, label) for p, label in NOTICE_PHRASES.items()]
    rules += [("strict" if strict else "tag", p, "") for p, strict in TAGS.items()]
    built = ahocorasick.Automaton()
    for number, (_, phrase, _) in enumerate(rules):
        built.add_word(f" {phrase} ", (number, len(phrase) + 1))
    built.make_automaton()
    return built, rules


_AFTER_TAG = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")


class Scan:
    """Places of all rules in the texts of a batch."""

    def __init__(self, texts: list[bytes]):
        joined = _GAP + _GAP.join(texts) + b" "
        raw = np.frombuffer(joined, np.uint8)
        breaks = np.cumsum([1, *(len(t) + len(_GAP) for t in texts[:-1])])
        low = LOWER[raw]
        word = _IS_WORD[low]
        keep = word.copy()
        keep[1:] |= word[:-1]  # one blank after every word
        for shift in (-1, 0, 1):
            keep[breaks + shift] = True
        low[~word] = _BLANK
        low[breaks] = _BREAK
        plain = low[keep]
        self.raw = joined
        self.raw_starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        inside = plain > _BLANK
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.first = np.append(np.searchsorted(starts, np.flatnonzero(plain == _BREAK)), len(starts))
        self.n_words = np.diff(self.first)
        found, self.rules = automaton()
        hits = [(rule, end - size) for end, (rule, size) in found.iter(plain.tobytes().decode("latin-1"))]
        rule, at = np.array(hits, np.int64).reshape(-1, 2).T
        self.word = np.searchsorted(starts, at)  # of the whole batch
        self.rule = rule
        self.text = np.searchsorted(self.first, self.word, side="right") - 1

    def of_text(self) -> Iterator[tuple[list[dict], list[dict]]]:
        """Phrases and tags of every text, in the order of their words."""
        order = np.lexsort((self.rule, self.word))
        cuts = np.searchsorted(self.text[order], np.arange(len(self.n_words) + 1))
        for k in range(len(self.n_words)):
            phrases, tags = [], []
            for hit in order[cuts[k] : cuts[k + 1]]:
                kind, phrase, label = self.rules[self.rule[hit]]
                word = int(self.word[hit])
                place = {"word": word - int(self.first[k]), "phrase": phrase}
                if kind in ("base", "notice"):
                    phrases.append(place | {"label": label, "base": kind == "base"})
                    continue
                read = self._expression(word, phrase)
                if read and read.postfix and (kind == "tag" or (read.known and read.valid)):
                    tags.append(
                        place
                        | {
                            "expression": " ".join(read.postfix),
                            "licenses": read.licenses,
                            "strictness": read.strictness,
                            "valid": read.valid,
                        }
                    )
            yield phrases, tags

    def _expression(self, word: int, tag: str) -> Expression | None:
        last = word + tag.count(" ")
        after = int(self.raw_starts[last]) + len(tag.rsplit(" ", 1)[-1])
        begins = _AFTER_TAG.match(self.raw, after)
        if not begins:
            return None
        stop = self.raw.find(b"\n", begins.end())  # every text is followed by one, but for the last
        line = self.raw[begins.end() : stop if stop >= 0 else len(self.raw)]
        return read_expression(line.decode("latin-1"))


def score(phrases: list[dict], tags: list[dict]) -> float:
    """How sure it is that the text bears a licence: independent evidence, once for each label."""
    best: dict[str, float] = {}
    for one in phrases:
        best[one["label"]] = max(best.get(one["label"], 0.0), WEIGHTS["phrase"])
    for one in tags:
        for label in one["licenses"]:
            weight = WEIGHTS["tag" if one["valid"] else "broken"]
            best[label] = max(best.get(label, 0.0), weight)
    doubt = 1.0
    for label in sorted(best):
        doubt *= 1.0 - best[label]
    return 1.0 - doubt


_ADDED = """n_words long,
    phrases array<struct<word: long, phrase: string, label: string, base: boolean>>,
    tags array<struct<word: long, phrase: string, expression: string, licenses: array<string>,
        strictness: int, valid: boolean>>,
    labels array<string>, score double"""
_ARROW_PHRASES = pa.list_(
    pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string()), ("base", pa.bool_())])
)
_ARROW_TAGS = pa.list_(
    pa.struct(
        [
            ("word", pa.int64()),
            ("phrase", pa.string()),
            ("expression", pa.string()),
            ("licenses", pa.list_(pa.string())),
            ("strictness", pa.int32()),
            ("valid", pa.bool_()),
        ]
    )
)


def scan(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``phrases`` (where the words of notices stand), ``tags``
    (expressions behind identifier tags: postfix form, licences, strictness), ``labels``
    (of both, sorted) and ``score`` (0 to 1)."""
    added = T.StructType.fromDDL(_ADDED)
    fields = [f for f in docs.schema.fields if f.name not in added.names and (keep_text or f.name != text)]
    schema = T.StructType(fields + added.fields)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, text)):
            texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
            found = Scan(texts)
            phrases, tags = zip(*found.of_text())
            labels = [
                sorted({x["label"] for x in a} | {label for x in b for label in x["licenses"]})
                for a, b in zip(phrases, tags)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in fields),
                    pa.array(found.n_words, pa.int64()),
                    pa.array(phrases, _ARROW_PHRASES),
                    pa.array(tags, _ARROW_TAGS),
                    pa.array(labels, pa.list_(pa.string())),
                    pa.array([score(a, b) for a, b in zip(phrases, tags)], pa.float64()),
                ],
                names=schema.names,
            )

    # Only the needed columns go to Python: other columns named like added ones stay behind.
    return docs.select(*(f"`{f.name}`" for f in fields), *([] if keep_text else [f"`{text}`"])).mapInArrow(run, schema)
