"""Licence scan: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser reads tagged expressions.

A text is lower-cased (A-Z) and cut into words (letters, digits and everything beyond ASCII). Phrases match
whole consecutive words. Behind an identifier tag a licence expression (identifiers, AND, OR, WITH,
parentheses; WITH binds closest, then AND) is parsed to reverse Polish notation and evaluated: its labels
and whether it is permissive. Identifiers are those of IDENTIFIERS (with + for later versions) and LicenseRef- ones;
WITH takes one of them and an exception. A label that names a family (apache) gives way to one of its versions.

Edge cases. A null text is empty: no words, no labels, score 0. A malformed expression, one of other words, NONE and NOASSERTION give no label.
Repeated rows are scanned each for themselves; an empty table gives an empty result; other columns are
ignored. Whole texts are scanned, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched

#: Base phrases and labels, the method's own notices, the tag, permissive identifiers.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "academic free license": "afl", "affero general public license": "agpl", "apache license": "apache", "apache license version 1 1": "apache-1.1",
    "apache license version 2 0": "apache-2.0", "artistic license": "artistic", "artistic license 2 0": "artistic-2.0", "boost software license": "bsl",
    "boost software license version 1 0": "bsl-1.0", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "cc by nc": "cc-by-nc", "cc by nc nd": "cc-by-nc-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0-1.0", "common development and distribution license": "cddl", "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa", "eclipse public license": "epl", "european union public licence": "eupl",
    "gnu free documentation license": "gfdl", "gpl version 2": "gpl-2.0", "gpl version 3": "gpl-3.0", "isc license": "isc", "lesser general public license": "lgpl",
    "microsoft public license": "ms-pl", "mit license": "mit", "mozilla public license": "mpl", "mozilla public license version 2 0": "mpl-2.0",
    "open font license": "ofl", "permission is hereby granted free of charge": "mit", "python software foundation license": "psf",
    "redistribution and use in source and binary forms": "bsd", "released into the public domain": "public-domain", "unlicense": "unlicense",
    "zlib license": "zlib",
}
TAG = "spdx license identifier"
#: Licence identifiers that an expression may name, and exceptions behind WITH; all compared without case.
IDENTIFIERS = frozenset("""
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause
BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0
CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only
GFDL-1.3-or-later GPL-1.0-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0
PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Sleepycat SSPL-1.0 Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".lower().split())
EXCEPTIONS = frozenset("""
Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 Font-exception-2.0 GCC-exception-3.1 Linux-syscall-note LLVM-exception
OpenJDK-assembly-exception-1.0 Qt-GPL-exception-1.0 u-boot-exception-2.0 WxWindows-exception-3.1
""".lower().split())
PERMISSIVE = ("0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-4.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib")
#: Parameters: how sure a label is by its kind of evidence.
SURE = {"base": 0.6, "notice": 0.8, "tag": 0.95}

WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TAGGED = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+-]+)")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"
RANK = {"or": 1, "and": 2, "with": 3}


@cache
def automaton():
    found = ahocorasick.Automaton()
    for phrase in [*NOTICES, TAG]:
        found.add_word(f" {phrase} ", (len(phrase) + 2, "notice", NOTICES.get(phrase)))
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, "base", label))
    found.make_automaton()
    return found


def known(identifier: str) -> bool:
    return identifier.removesuffix("+") in IDENTIFIERS or identifier.startswith("licenseref-") and len(identifier) > 11


def polish(expression: str) -> list[str] | None:
    """Reverse Polish notation of a licence expression by the shunting-yard algorithm; None if malformed."""
    out, stack, operand_due, simple, at = [], [], True, False, 0
    while m := TOKEN.match(expression, at):
        token, at = m[1], m.end()
        low = token.lower()
        if token == "(" or low not in RANK and token != ")":
            if not operand_due:
                break  # prose or a comment behind a complete expression
            if token == "(":
                stack.append(token)
            else:
                behind_with = bool(stack) and stack[-1] == "with"
                if not (low in EXCEPTIONS if behind_with else known(low)):
                    return None
                out.append(token)
                operand_due, simple = False, not behind_with
        elif operand_due:
            return None
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
            simple = False
        else:
            if low == "with" and not simple:
                return None  # only a single identifier takes an exception
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_due = True
    if operand_due or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """Labels of an expression, and whether some choice it leaves is permissive throughout."""
    rpn = polish(expression)
    if rpn is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for token in rpn:
        if token not in RANK:
            stack.append(({token.lower()}, token.lower().removesuffix("+") in PERMISSIVE))
            continue
        (right, free_r), (left, free_l) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{a}-with-{b}" for a in left for b in right}, free_l))
        else:
            stack.append((left | right, free_l and free_r if token == "and" else free_l or free_r))
    return stack[0]


def scan(text: bytes | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and permissive of one text."""
    words = (text or b"").translate(WORD_TABLE).split()
    joined = f" {b' '.join(words).decode()} "
    base, sure, free, starts = set(), {}, None, []
    tagged, word, seen = False, 0, 1
    for start, kind, label in sorted((end + 1 - n, kind, label or "") for end, (n, kind, label) in automaton().iter(joined)):
        if not label:
            tagged = True
            continue
        sure[label] = max(sure.get(label, 0), SURE[kind])
        if kind == "base":
            word += joined.count(" ", seen, start + 1)
            seen = start + 1
            starts.append(word)
            base.add(label)
    for m in TAGGED.finditer(text) if tagged else ():
        got = evaluate(m[1].decode(errors="replace"))
        if got:
            sure |= dict.fromkeys(got[0], SURE["tag"])
            free = got[1] if free is None else free and got[1]
    for family in [x for x in sure if x not in base and any(y.startswith(f"{x}-") and y[len(x) + 1].isdigit() for y in sure)]:
        del sure[family]  # a version of it is named
    doubt = 1.0
    for label in sorted(sure):
        doubt *= 1 - sure[label]
    ends = (starts[0], starts[-1]) if starts else (None, None)
    return len(words), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(sure)), 1 - doubt, free


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, permissive."""
    batched(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            cols = list(zip(*map(scan, as_bytes(b.column(1))), strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, SCHEMA)
