import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phasewell.llm import quality

from . import docs


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    repeat = {i + o for i, g in enumerate(grams) if n[g] > 1 for o in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    kept = not (failed or 5 * symbols > len(w) or 10 * dup > 3 * (t.count("\n") + 1) or chars > 25 * len(w))
    return len(w), chars, symbols, dup, len(repeat), failed, kept


def test_measures(spark):
    got = quality.measures(docs.table(spark)).drop("failed_rule").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *brute(r[1])) for r in docs.rows()), key=str)


def test_cascade_keeps_the_same(spark):
    table = docs.table(spark)
    got = quality.apply_rules(table)
    assert got.columns == [*table.columns, "failed_rule"]
    assert sorted((r.doc_id, r.failed_rule is None) for r in got.collect() if r.doc_id is not None) == sorted((r[0], brute(r[1])[-1]) for r in docs.rows() if r[0] is not None)


def test_order_by_rejections_per_cost(spark):
    order = quality.ordered(docs.table(spark))
    gain = [hits / seconds for _, seconds, hits in order]
    assert gain[0] == max(gain) and {r.name for r, _, _ in order} == {r.name for r in quality.RULES}
    failing = sum(not brute(r[1])[-1] for r in docs.rows())
    assert sum(hits for _, _, hits in order) == failing  # each of the sample (here the table) once, by the first that rejects it


def test_rejected_texts_meet_no_later_rule(spark):
    raises = quality.Rule("raises", lambda t, w: F.raise_error(F.lit("evaluated")).cast("boolean"))
    rest = quality.Rule("all", lambda t, w: F.length(t) >= 0)
    judged = docs.table(spark).select(quality.verdict(quality.text_of("text"), [rest, raises]).alias("r"))
    assert {r.r for r in judged.collect()} == {"all"}
    with pytest.raises(Exception, match="evaluated"):
        docs.table(spark).select(quality.verdict(quality.text_of("text"), [raises, rest]).alias("r")).collect()


def test_clashing_names(spark):
    given = docs.table(spark).select("*", *[F.lit(7).alias(c) for c in ("t", "w", "m", "k", "_words", "failed_rule", "a.b")])
    got = quality.apply_rules(given)
    assert got.columns == [*[c for c in given.columns if c != "failed_rule"], "failed_rule"]
    assert {(r.t, r.w, r._words, r["a.b"]) for r in got.collect()} == {(7, 7, 7, 7)} and got.count() == len(docs.rows())


def test_native_and_empty(spark):
    plan = quality.measures(docs.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.measures(docs.empty(spark)).collect() == [] and quality.apply_rules(docs.empty(spark)).collect() == []
