"""Quality rules as a short-circuit cascade, in DataFrame functions throughout.

Each rule is a predicate over a text and its words. One hash sample of the table is saved; on it each rule is timed
alone, net of what the same job costs without a rule, and the sets of rules that reject each row are counted. Greedily
the rule that rejects most of what is left for its cost comes next. The rules then stand nested in one CASE: a rule's
measures (words, windows and all) are worked out inside its branch, so a text that one rule rejects never pays for
the next ones. The order changes the cost and which rule is named, never the verdict.

Edge cases. A null or empty text has no words, and all measures 0; it fails the rule on few words. Words are runs of
anything but space and \\x09-\\x0D. Lines count as repeated if equal as they stand. Repeated rows are judged each for
themselves; an empty table gives an empty result. Whole texts are measured. apply_rules keeps all columns, whatever
their names, but for one called failed_rule, which the verdict replaces; measures ignores other columns.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work

#: Parameters: rows (about) of the sample that orders the rules, and how often each is judged when a rule is timed (as
#: often as the second number says where the first gives less than CLEAR seconds); words of a window; least words of a text.
SAMPLE_ROWS, TIMES, CLEAR = 400, (4, 40), 0.1
WINDOW = 5
MIN_WORDS = 10
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[ \t\n\x0B\f\r]"


def text_of(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, and only where the whole is."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(text: Column) -> Column:
    """Words of a text; an empty array if it has none."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS + "+"))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each WINDOW of words, in place."""

    def of(hashes: Column) -> Column:
        all_places = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
        return F.slice(all_places, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def repeated_words(words: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    return bound(window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(twins(h), covered)))


def twins(hashes: Column) -> Column:
    """Sorted places of hashes that occur twice or more."""
    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    return bound(tagged, places)


def covered(places: Column) -> Column:
    """Words under windows that start at sorted places: each adds what lies before the next one's start."""
    steps = F.zip_with(places, F.slice(places, 2, 1 << 30), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda total, s: total + s)


def repeated_lines(text: Column) -> Column:
    solid = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    return bound(solid, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


@dataclass(frozen=True)
class Rule:
    """fails(text, words): true for a text to reject."""

    name: str
    fails: Callable[[Column, Column], Column]


#: The rules. few_words and repeated_words are the base ones.
RULES = (
    Rule("few_words", lambda t, w: F.size(w) < MIN_WORDS),
    Rule("repeated_words", lambda t, w: 100 * repeated_words(w) > 20 * F.size(w)),
    Rule("symbols", lambda t, w: 5 * symbols(t) > F.size(w)),
    Rule("repeated_lines", lambda t, w: 10 * repeated_lines(t) > 3 * F.size(F.split(t, "\n"))),
    Rule("long_words", lambda t, w: word_chars(w) > 25 * F.size(w)),
)


def holds(rule: Rule, text: Column, words: Column) -> Column:
    return F.coalesce(rule.fails(text, words), F.lit(False))


def sampled(df: DataFrame, text_col: str, rows: int) -> DataFrame:
    """About rows rows of df's texts, by a hash of the text and the row's place: saved once, one pass over the table."""
    n = df.count()
    part = min(1.0, rows / max(n, 1))
    picked = F.pmod(F.xxhash64(f"`{text_col}`", F.monotonically_increasing_id()), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))
    texts = df.where(picked) if part < 1 else df
    texts = texts.select(text_of(f"`{text_col}`").alias("t"))
    return Work(df.sparkSession, "quality").save(texts.select("t", words_of(F.col("t")).alias("w")), "sample")


def ordered(df: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, int]]:
    """The rules in the cascade's order: (rule, seconds, rejections of what earlier rules leave of the sample).

    Seconds are those of the sample judged once, the words (which all rules share) being at hand.
    """
    sample, t, w = sampled(df, text_col, sample_rows), F.col("t"), F.col("w")

    def seconds(rejects: Column, times: int) -> float:
        many = sample.select("t", "w", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("k"))
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.count_if(rejects)).first()
            best = min(best, time.perf_counter() - began)
        return best

    idle: dict[int, float] = {}

    def cost(rule: Rule) -> float:
        for times in TIMES:
            if times not in idle:
                idle[times] = seconds((F.length(t) < 0) & (F.size(w) < 0), times)  # launch and reading
            net = seconds(holds(rule, t, w), times) - idle[times]
            if net >= CLEAR:
                break
        return max(net, 1e-3) / times

    costs = [cost(r) for r in rules]
    sets = [(row.m, row.n) for row in sample.groupBy(F.array(*[holds(r, t, w) for r in rules]).alias("m")).agg(F.count("*").alias("n")).collect()]  # at most 2 ** rules
    out, left = [], list(range(len(rules)))
    while left:
        hits = {i: sum(n for m, n in sets if m[i]) for i in left}
        i = max(left, key=lambda i: (hits[i] / costs[i], -costs[i]))
        out.append((rules[i], costs[i], hits[i]))
        left.remove(i)
        sets = [(m, n) for m, n in sets if not m[i]]
    return out


def verdict(text: Column, rules) -> Column:
    """The first rule that rejects a text, null if none does: each stands in the branch that the ones before leave."""
    nested = lambda w: reduce(lambda rest, r: F.when(holds(r, text, w), F.lit(r.name)).otherwise(rest), rules[::-1], F.lit(None).cast("string"))
    return bound(words_of(text), nested)


def apply_rules(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """df with failed_rule: the first rule of the cascade that rejects the text, null for a kept one."""
    order = [r for r, _, _ in ordered(df, text_col, rules)]
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != "failed_rule"]
    return settled(df.select(*kept, verdict(text_of(f"`{text_col}`"), order).alias("failed_rule")))


def settled(df: DataFrame) -> DataFrame:
    """df behind a row counter, through which Spark pushes no filter: pushed down, a filter on a verdict would
    repeat the whole cascade inside itself."""
    return df.observe(f"quality-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule.

    The verdict is the cascade's; the measures are reported for every row besides, rejected or not.
    """
    judged = apply_rules(df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(f"`{text_col}`").alias("t")), "t")
    t = F.col("t")
    counts = bound(words_of(t), lambda w: F.struct(F.size(w).alias("n_words"), word_chars(w).alias("word_chars"), symbols(t).alias("n_symbols"), repeated_lines(t).alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words")))
    wide = judged.select("doc_id", counts.alias("m"), "failed_rule")
    columns = [F.col(f"m.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > 20 * F.col("m.n_words"))
    return settled(wide).select("doc_id", *columns, failed.alias("base_failed"), "failed_rule", F.col("failed_rule").isNull().alias("kept"))
