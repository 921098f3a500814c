import re

from phasewell.llm import licenses as li
from phasewell.llm import queries

from . import docs

A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))
    hits = sorted((i, label) for p, label in li.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = ["CC-BY cc by Cc/By-NC 4.0", "GNU General\nPublic  License, all rights reserved. all rights reserved", "xcc by", "cc byé", "ccby", "CC BY", "The MIT License", "Ａll rights reserved cc\x80by", "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND ISC */", "SPDX-License-Identifier: MIT AND (", "all rights reserved " * 500]


def test_base_columns(spark):
    rows = docs.rows() + [(100 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(TEXTS)]
    got = li.license_scan(docs.table(spark, rows)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((r[0], *base(r[1])) for r in rows), key=str)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.op5_licenses(spark, sf).collect()
    assert len(got) == len(texts) and all(tuple(r)[1:6] == base(texts[r.doc_id]) for r in got)


def test_expressions():
    assert li.polish("MIT OR Apache-2.0 AND ISC") == ["MIT", "Apache-2.0", "ISC", "and", "or"]
    assert li.polish("(MIT OR GPL-2.0) AND ISC */") == ["MIT", "GPL-2.0", "or", "ISC", "and"]
    assert [li.polish(x) for x in ("", "MIT AND", "(MIT", "OR MIT", "()")] == [None] * 5
    assert li.evaluate("GPL-2.0 OR MIT") == ({"gpl-2.0", "mit"}, True)
    assert li.evaluate("GPL-2.0 and MIT") == ({"gpl-2.0", "mit"}, False)
    assert li.evaluate("GPL-2.0 WITH Linux-syscall-note") == ({"gpl-2.0-with-linux-syscall-note"}, False)


def test_identifiers():
    tag = lambda x: li.scan(f"SPDX-License-Identifier: {x}\n".encode())[5]
    assert [tag(x) for x in ("see LICENSE file", "NOASSERTION", "NONE", "Proprietary", "MIT AND see")] == [""] * 5
    assert tag("GPL-2.0+") == "gpl-2.0+" and tag("LicenseRef-Own AND MIT") == "licenseref-own,mit" and tag("LicenseRef-") == ""
    assert tag("MIT -- a comment") == tag("MIT */") == "mit"
    assert [li.polish(x) for x in ("(MIT OR ISC) WITH Classpath-exception-2.0", "MIT WITH ISC", "MIT WITH Classpath-exception-2.0 WITH LLVM-exception", "Classpath-exception-2.0")] == [None] * 4
    assert li.scan(b"Apache License, Version 2.0. SPDX-License-Identifier: Apache-2.0")[5] == "apache-2.0"
    assert li.scan(b"the Apache License")[5] == "apache"
    assert len(li.IDENTIFIERS) < 200


def test_labels():
    assert li.scan(TEXTS[0].encode())[5] == "cc-by,cc-by-nc" and li.scan(TEXTS[6].encode())[5] == "mit"
    got = li.scan(TEXTS[8].encode())
    assert set(got[5].split(",")) == {"mit", "gpl-2.0-only-with-classpath-exception-2.0", "isc"} and got[7] is True
    assert li.scan(TEXTS[9].encode())[5] == "" and li.scan(None)[:2] == (0, 0)


def test_empty(spark):
    assert li.license_scan(docs.empty(spark)).collect() == []
