"""License scans: notice phrases and identifier tags by Aho-Corasick, tag expressions by a shunting-yard parser.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case. A phrase is found
where its words stand consecutively. A tag is ``SPDX-License-Identifier:`` or
``License:`` at any place of a line; what follows up to the line's end or its next tag
is read as an expression of identifiers with AND, OR, WITH and brackets (WITH binds
tightest, then AND, and stands between a licence and an exception): its longest
beginning that is one, so prose may stand behind. Operands are the identifiers listed
here, ``-only``, ``-or-later`` or ``+`` after them, and ``LicenseRef-`` names; colons and
dashes at their ends don't count, and a full stop there ends the expression. A tag without a known licence counts for
nothing. Beside known ones, unknown licences and exceptions are told in ``unknown``:
an unknown licence asks for nothing known and isn't permissive, and a licence with an
unknown exception is the licence.

Evaluation of an expression gives the labels that it names, those that every
choice requires (AND requires both sides, OR what both share), the number of
choices (AND multiplies, OR adds; it stops at 2**62), and whether some choice
holds permissive licences alone (AND needs both sides, OR either; an exception
leaves its licence as it is).

A null text scans like an empty one: no words, no labels, score 0. Texts are
scanned whole; every row has one result row, repeated rows too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from galvana.shared import bounded_batches

#: The phrases that a base label needs.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases, in the licences' own words.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause license": "bsd-2",
    "bsd 3 clause license": "bsd-3",
    "isc license": "isc",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Identifiers of tags, without suffixes, and the labels they stand for.
IDENTIFIERS = {
    "mit": "mit",
    "mit-0": "mit",
    "apache-1.1": "apache-1",
    "apache-2.0": "apache-2",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nc-sa-4.0": "cc-by-nc-sa",
    "cc-by-nc-nd-4.0": "cc-by-nc-nd",
    "cc-by-3.0": "cc-by",
    "cc-by-4.0": "cc-by",
    "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-sa-3.0": "cc-by-sa",
    "cc-by-sa-4.0": "cc-by-sa",
    "cc0-1.0": "cc0",
    "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3",
    "lgpl-2.0": "lgpl",
    "lgpl-2.1": "lgpl",
    "lgpl-3.0": "lgpl",
    "agpl-3.0": "agpl",
    "mpl-1.1": "mpl-1",
    "mpl-2.0": "mpl-2",
    "0bsd": "bsd-0",
    "bsd-2-clause": "bsd-2",
    "bsd-3-clause": "bsd-3",
    "bsd-4-clause": "bsd-4",
    "isc": "isc",
    "artistic-2.0": "artistic-2",
    "epl-1.0": "epl",
    "epl-2.0": "epl",
    "eupl-1.2": "eupl",
    "bsl-1.0": "bsl-1",
    "ofl-1.1": "ofl",
    "postgresql": "postgresql",
    "psf-2.0": "psf",
    "python-2.0": "psf",
    "unlicense": "unlicense",
    "wtfpl": "wtfpl",
    "x11": "x11",
    "zlib": "zlib",
}
#: Labels whose licences ask for notices at most.
PERMISSIVE = {"mit", "apache-1", "apache-2", "cc-by", "cc0", "bsd-0", "bsd-2", "bsd-3", "bsd-4", "isc", "bsl-1", "ofl", "postgresql", "psf", "unlicense", "wtfpl", "x11", "zlib"}
#: Exceptions that WITH can name.
EXCEPTIONS = {
    "autoconf-exception-2.0",
    "autoconf-exception-3.0",
    "bison-exception-2.2",
    "bootloader-exception",
    "classpath-exception-2.0",
    "font-exception-2.0",
    "gcc-exception-2.0",
    "gcc-exception-3.1",
    "linux-syscall-note",
    "llvm-exception",
    "openssl-exception",
    "qt-gpl-exception-1.0",
    "universal-foss-exception-1.0",
}
TAGS = ("spdx-license-identifier:", "license:")

_WORD = bytes(c for c in range(256) if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)
_TO_WORDS = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20) for c in range(256))
_TOKEN = re.compile(r"\s*(?:([A-Za-z0-9.+:-]+)|([()]))")
_POWER = {"or": 1, "and": 2, "with": 3}


MOST_CHOICES = 2**62


def licence(name: str) -> str | None:
    """The label of an identifier, None if it is unknown; ``+`` is ``-or-later``."""
    plain = name.lower()
    if plain.startswith("licenseref-") and len(plain) > len("licenseref-"):
        return plain
    later = plain.endswith(("+", "-or-later"))
    plain = plain.removesuffix("+").removesuffix("-or-later").removesuffix("-only")
    label = IDENTIFIERS.get(plain)
    return f"{label}-or-later" if label and later else label


def _tokens(text: str) -> Iterator[tuple[str, int]]:
    """Names, operators (in lower case) and brackets from the start of a text on, with their ends, while they last."""
    place, end = 0, len(text.rstrip())
    while place < end and (found := _TOKEN.match(text, place)):
        place = found.end()
        name = found[1] and found[1].rstrip(".:-")
        if found[1] and not name:
            return
        yield found[2] or (name.lower() if name.lower() in _POWER else name), place
        if name and found[1][-1] == ".":
            return


def parse(text: str) -> tuple[list[str], str] | None:
    """The longest beginning of a text that is an expression: operands and operators in postfix order, and that beginning; None if there is none.

    Operands and operators must alternate, and a WITH takes a plain identifier on
    either side.
    """
    taken: list[str] = []
    whole, end, open_brackets, operand, last = 0, 0, 0, True, ""
    for token, stop in _tokens(text):
        name = token not in _POWER and token not in ("(", ")")
        if operand != (name or token == "(") or token == "(" and last == "with" or token == ")" and not open_brackets:
            break
        if token == "with" and (last != "name" or taken[-2:-1] == ["with"]):
            break
        open_brackets += (token == "(") - (token == ")")
        operand = token in _POWER or token == "("
        last = "name" if name else token
        taken.append(token)
        if not operand and not open_brackets:
            whole, end = len(taken), stop
    if not whole:
        return None
    out: list[str] = []
    waiting: list[str] = []
    for token in taken[:whole]:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in _POWER:
            while waiting and waiting[-1] != "(" and _POWER[waiting[-1]] >= _POWER[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1], text[:end].strip()


@dataclass
class Terms:
    """What an expression comes to."""

    required: set[str]
    choices: int
    permissive: bool


def evaluate(postfix: list[str]) -> tuple[set[str], Terms, set[str]] | None:
    """All labels that an expression names, its terms, and its unknown names; None if it names nothing known."""
    labels: set[str] = set()
    unknown: set[str] = set()
    stack: list[str | Terms] = []

    def terms(x: str | Terms, label: str = "") -> Terms:
        if isinstance(x, Terms):
            return x
        plain = licence(x)
        if plain is None:
            unknown.add(x)
            return Terms(set(), 1, False)
        labels.add(label or plain)
        return Terms({label or plain}, 1, plain.removesuffix("-or-later") in PERMISSIVE)

    for x in postfix:
        if x not in _POWER:
            stack.append(x)
            continue
        right, left = stack.pop(), stack.pop()
        if x == "with":
            known = right.lower() in EXCEPTIONS
            if not known:
                unknown.add(right)
            stack.append(terms(left, f"{licence(left)}-with-{right.lower()}" if known else ""))
            continue
        one, two = terms(left), terms(right)
        small, large = sorted((one.required, two.required), key=len)
        if x == "and":
            large |= small
            stack.append(Terms(large, min(MOST_CHOICES, one.choices * two.choices), one.permissive and two.permissive))
        else:
            small &= large
            stack.append(Terms(small, min(MOST_CHOICES, one.choices + two.choices), one.permissive or two.permissive))
    whole = terms(stack[0])
    return (labels, whole, unknown) if labels else None


def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES]:
        phrases.add_word(f" {phrase} ", phrase)
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def tagged(text: str, lower: str, tags: ahocorasick.Automaton) -> Iterator[tuple[str, set[str], Terms, set[str]]]:
    """Each tag's expression, labels, terms and unknown names."""
    ends = [(end + 1, end + 1 - len(tag)) for end, tag in tags.iter(lower)]
    for (start, _), (_, following) in zip(ends, [*ends[1:], (0, len(text))], strict=True):
        stop = text.find("\n", start, max(start, following))
        rest = text[start : stop if stop >= 0 else max(start, following)]
        if (parsed := parse(rest)) and (found := evaluate(parsed[0])):
            yield parsed[1], *found


#: Columns of a scan: places are starts of base phrases in words; the last five come from tags.
SCAN = pa.schema([
    ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("expressions", pa.list_(pa.string())), ("required", pa.string()), ("choices", pa.int64()), ("permissive", pa.bool_()), ("unknown", pa.string()),
])
_SCAN = "n_words long, places array<long>, base_labels string, labels string, score double, expressions array<string>, required string, choices long, permissive boolean, unknown string"


def _scan_texts(phrases, tags):
    def scan(raw: bytes) -> dict:
        words = raw.translate(_TO_WORDS).split()
        joined = b" " + b" ".join(words) + b" "
        starts, base, more, hits = [], set(), set(), 0
        for end, phrase in phrases.iter(joined.decode("latin-1")):  # a letter for each byte: phrases are ASCII
            hits += 1
            if phrase in BASE:
                starts.append(end - len(phrase) - 1)
                base.add(BASE[phrase])
            else:
                more.add(NOTICES[phrase])
        places = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20), np.array(starts, np.int64)) if starts else np.zeros(0, np.int64)
        text = raw.decode()
        lower = raw.lower().decode()  # A-Z alone, so places stay
        found = list(tagged(text, lower, tags)) if "license:" in lower or TAGS[0] in lower else []
        for _, labels, _, _ in found:
            more |= labels
        choices = 1
        for _, _, terms, _ in found:
            choices = min(MOST_CHOICES, choices * terms.choices)
        return {
            "n_words": len(words),
            "places": np.sort(places).tolist(),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | more)),
            "score": 1 - 0.5**hits * 0.1 ** len(found),
            "expressions": [x for x, *_ in found],
            "required": ",".join(sorted(set().union(*(terms.required for _, _, terms, _ in found)))),
            "choices": choices if found else 0,
            "permissive": all(terms.permissive for _, _, terms, _ in found) if found else None,
            "unknown": ",".join(sorted(set().union(*(names for *_, names in found)))),
        }

    return scan


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the columns ``SCAN`` of every row of ``docs``; a map over the rows, without a shuffle.

    The score is 0 without evidence; each phrase halves its distance to 1, each
    tag takes a tenth of it. A text's tags hold together like an AND: ``required``
    joins theirs, ``choices`` multiplies (0 without a tag), and ``permissive`` needs
    each (null without a tag).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan_texts(*_automata())
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for a in range(0, batch.num_rows, 500):
                rows = pa.RecordBatch.from_pylist([scan(x or b"") for x in texts.slice(a, 500).to_pylist()], schema=SCAN)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 500), *rows.columns], names=["doc_id", *SCAN.names])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCAN}")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every text of ``documents``, with the places of base phrases and the terms of tags."""
    scan = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scan.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(places) as long) as n_base",
        "array_min(places) as first_word",
        "array_max(places) as last_word",
        "base_labels",
        "labels",
        "score",
        "expressions",
        "required",
        "choices",
        "permissive",
        "unknown",
    )
