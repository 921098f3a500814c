"""Secret scan in DataFrame functions: three base patterns and a battery of randomness tests.

Base kinds are found by pattern, leftmost and without overlap, and filtered by length afterwards. Further candidates
are all runs of [A-Za-z0-9+/_=-] of LENGTHS[0] or more characters. From its alphabet a candidate's encoding is inferred
(hex, base32, base64); three tests, each with that encoding's own figures, ask how unlikely natural text of its length
would be as random as it is: chi-squared uniformity over the alphabet, the number of runs of character classes, and the
serial correlation of places in the alphabet. The sum of the three, over its spread in natural text (the tests aren't
independent), gives a p-value, counted over the whole table in bins of a tenth of a decade by length class, and within
each class cut by the Benjamini-Hochberg rule at RATE (false-discovery control that knows length).

Positions are code points, from 0, end exclusive. Edge cases. A null text is empty and has no spans.
Equal spans of several kinds are all reported. Repeated rows are scanned each for themselves; an empty
table gives an empty result; spans returns the columns asked for, whatever other names there are. Whole texts are
scanned, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work

KEY_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({KEY_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, a pattern every text with a passing match has, group and least length of it.
KINDS = (
    ("assign", ASSIGN, ASSIGN[:-2] + "{6})", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{16}", 0, 20),
    ("hex", "[0-9a-f]{24,}", "[0-9a-f]{24}", 0, 24),
)
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Parameters: false-discovery rate; length classes; what natural text looks like in each encoding (decimal numbers and
#: a-f words for hex, upper-case words for base32, slugs, paths and camel case for base64): excess of the chi-squared sum
#: per character, chance that neighbours differ in class, correlation of neighbours, how far both vary from text to text,
#: and the spread of the tests' sum above its mean. tests/llm checks the p-values on such texts.
RATE = 0.01
LENGTHS = (20, 32, 48, 96)
EXCESS = {16: 0.6, 32: 1.2, 64: 2.4}
CLASS_CHANGE = {16: 0.1, 32: 0.1, 64: 0.3}
CLASS_STYLE = {16: 0.05, 32: 0.05, 64: 0.1}
CORRELATION = {16: 0.1, 32: -0.05, 64: -0.08}
CORRELATION_STYLE = {16: 0.05, 32: 0.05, 64: 0.25}
SPREAD = {16: 1.4, 32: 1.6, 64: 1.9}
#: The alphabets in order (base64 with both forms of its last two, then padding).
ALPHABETS = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567=", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="}
BLOCK = 256
BINS = 400


def cat(text: Column, pattern: str, gate: str, group: int, least: int) -> Column:
    """Sorted (s, e) spans of a pattern's matches whose group has the least length."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    packed = F.struct(F.split(text, pattern, -1).alias("gap"), found.alias("m"), sized.alias("g"))
    spans = F.transform(F.array(packed), lambda p: placed(p["gap"], p["m"], p["g"], least))
    return F.when(text.rlike(gate), F.element_at(spans, 1)).otherwise(none)


def placed(gaps: Column, matches: Column, sized: Column, least: int) -> Column:
    """Spans of matches between gaps: prefix sums of lengths, in blocks so that long lists stay cheap."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))

    def with_steps(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / BLOCK).cast("int")), lambda b: total(F.slice(s, b * BLOCK + 1, BLOCK)))

        def with_blocks(before: Column) -> Column:
            def end(i: Column) -> Column:
                return F.get(before, F.floor(i / BLOCK).cast("int")) + total(F.slice(s, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), (i % BLOCK + 1).cast("int")))

            every = F.transform(matches, lambda m, i: F.struct((end(i) - F.length(m)).alias("s"), end(i).alias("e"), m.alias("m"), F.length(F.get(sized, i)).alias("n")))
            return F.transform(F.filter(every, lambda x: x["n"] >= least), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))

        sums = F.transform(blocks, lambda _, i: total(F.slice(blocks, F.lit(1), i)))
        return bound(sums, with_blocks)

    return bound(steps, with_steps)


def bound(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


# --- randomness -----------------------------------------------------------------------------------------


def alphabet(m: Column) -> Column:
    return F.when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(16)).when(m.rlike("^[A-Z2-7]+=*$"), F.lit(32)).otherwise(F.lit(64))


def by_encoding(size: Column, figures: dict) -> Column:
    return F.when(size == 16, F.lit(figures[16])).when(size == 32, F.lit(figures[32])).otherwise(F.lit(figures[64]))


def uniformity(m: Column, size: Column) -> Column:
    """How far the chi-squared sum over the alphabet lies below that of natural text, in deviations."""
    n = F.length(m).cast("double")
    square = F.aggregate(F.array_distinct(F.split(m, "")), F.lit(0.0), lambda a, c: a + F.pow(F.length(m) - F.length(F.replace(m, c, F.lit(""))), 2.0))
    far = n * by_encoding(size, EXCESS)
    return (size - 1 + far - (square * size / n - n)) / F.sqrt(2 * (size - 1 + 2 * far))


def runs(m: Column, size: Column) -> Column:
    """Changes of class between neighbours against natural text, in deviations."""
    n, natural = F.length(m).cast("double") - 1, by_encoding(size, CLASS_CHANGE)
    changes = F.regexp_count(m, F.lit("[a-z]+|[A-Z]+|[0-9]+|[+/_=-]+")) - 1
    return (changes / n - natural) / F.sqrt(natural * (1 - natural) / n + F.pow(by_encoding(size, CLASS_STYLE), 2.0))


def correlation(m: Column, size: Column) -> Column:
    """How far the serial correlation of places in the alphabet lies below that of natural text, in deviations; that of equal characters is 1."""
    n = F.length(m).cast("double")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    def of(codes: Column) -> Column:
        mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
        return bound(F.transform(codes, lambda x: x - mean), lambda d: F.coalesce(F.try_divide(dot(F.slice(d, 1, 1 << 30), F.slice(d, 2, 1 << 30)), dot(d, d)), F.lit(1.0)))

    letters = F.when(size == 16, F.lower(m)).otherwise(m)
    r = bound(F.transform(F.split(letters, ""), lambda c: F.position(c, by_encoding(size, ALPHABETS)).cast("double")), of)
    return (by_encoding(size, CORRELATION) - r) / F.sqrt(1 / n + F.pow(by_encoding(size, CORRELATION_STYLE), 2.0))


def score(m: Column) -> Column:
    """The battery's sum over its spread in natural text: near normal there, and large for random strings."""
    return bound(alphabet(m), lambda size: (uniformity(m, size) + runs(m, size) + correlation(m, size)) / by_encoding(size, SPREAD))


def p_bin(m: Column) -> Column:
    """Tenths of a decade of the combined p-value, rounded towards 1; -1 beyond 1/2."""

    def of(z: Column) -> Column:
        # exp(-0.717 z - 0.416 z^2) / 2 lies near the normal tail for z >= 0
        decades = (0.717 * z + 0.416 * z * z) / 2.302585 + 0.30103
        return F.when(z < 0, F.lit(-1)).otherwise(F.floor(decades * 10)).cast("int")

    return bound(F.greatest(F.least(score(m), F.lit(40.0)), F.lit(-1.0)), of)


def length_class(m: Column) -> Column:
    case = F.lit(0)
    for k, least in enumerate(LENGTHS[1:], 1):
        case = F.when(F.length(m) >= least, F.lit(k)).otherwise(case)
    return case


def candidates(text: Column) -> Column:
    """(s, e, c, b): spans to test, their length class and p-value's bin."""
    spans = cat(text, CANDIDATE, CANDIDATE[:-2] + "}", 0, LENGTHS[0])
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), length_class(x["m"]).alias("c"), p_bin(x["m"]).alias("b")))


def cut_offs(scanned: DataFrame) -> dict[int, int]:
    """The least bin accepted of each length class by Benjamini-Hochberg; at most classes * BINS rows reach the driver."""
    bins = scanned.select(F.explode("tested").alias("x")).groupBy(F.col("x.c").alias("c"), F.least(F.col("x.b"), F.lit(BINS)).alias("b")).count().collect()
    least = {}
    for c in {r.c for r in bins}:
        mine = sorted((r for r in bins if r.c == c), key=lambda r: -r.b)
        tests, rank = sum(r["count"] for r in mine), 0
        for r in mine:
            rank += r["count"]
            if r.b >= 0 and 10 ** (-r.b / 10) * tests <= RATE * rank:
                least[c] = r.b
    return least


def of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def spans(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep of df, then base and found: spans (s, k, e) by start and kind, of the base kinds and of all.

    k is 0 assign, 1 access, 2 hex, 3 random.
    """
    work = Work(df.sparkSession, "secrets")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("pad"))
    wide = df.select(row.alias("row"), text.alias("t"))
    kinds = [of_kind(cat(F.col("t"), *k[1:]), n) for n, k in enumerate(KINDS)]
    scanned = work.save(wide.select("row", F.concat(*kinds).alias("base"), candidates(F.col("t")).alias("tested")), "scanned")
    least = cut_offs(scanned)
    accept = lambda x: F.coalesce(*[F.when(x["c"] == c, x["b"] >= b) for c, b in sorted(least.items())], F.lit(False))
    random = of_kind(F.filter("tested", accept), len(KINDS))
    columns = [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(keep)]
    return scanned.select(*columns, F.array_sort("base").alias("base"), F.array_sort(F.concat("base", random)).alias("found"))


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("random"))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """text with every span (overlapping ones as one) replaced by mask."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(mask))
        return F.struct(F.when(x["s"] >= a["at"], fresh).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["e"]).alias("at"))

    done = F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)
