import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from phasewell.llm import simhash
from phasewell.llm.common import Work
from phasewell.llm.components import components

from . import docs


def fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, radius=4):
    prints = [(i, fingerprint(t)) for i, t in rows]
    owner = {}
    for i, f in prints:
        if i is not None:
            owner[f] = min(i, owner.get(f, i))
    near = [(a, b) for (f, a), (g, b) in itertools.combinations(owner.items(), 2) if (f ^ g).bit_count() <= radius]
    root = closure(near, owner.values())
    return sorted(((i, f, root[owner[f]] if f in owner else None) for i, f in prints), key=str)


def test_documents(spark):
    rows = docs.rows()
    got = simhash.simhash_components(docs.table(spark)).collect()
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=str) == brute([r[:2] for r in rows])


def test_spark_hash_agrees(spark):
    t = "some words to hash"
    assert spark.sql(f"select xxhash64('{t}')").first()[0] % 2**64 == xxhash.xxh64_intdigest(t.encode(), 42)


@pytest.mark.parametrize(("radius", "block", "small"), [(4, 8192, 48), (4, 7, 2), (9, 8192, 48), (0, 16, 2)])
def test_links_span_all_near_pairs(spark, monkeypatch, radius, block, small):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    for base in [centre] * 100 + list(fps)[:40]:
        f = base
        for j in rng.sample(range(64), rng.randint(0, radius + 1)):
            f ^= 1 << j
        fps.add(f)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    nodes = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in fps.items()], "id long, fp long")
    got = simhash.links(Work(spark, "t"), nodes, radius).collect()
    assert all((fps[a] ^ fps[b]).bit_count() <= radius for a, b in got)
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= radius]
    assert closure([tuple(r) for r in got], fps) == closure(near, fps)


def test_thresholds_sum():
    counts = [np.array([50, 1, 1, 1]), np.array([10, 20, 13, 10]), np.array([53, 0, 0, 0])]
    for radius in range(5):
        cost, t = simhash.allocate(counts, [2, 2, 2], radius)
        assert sum(t) == radius - 2 and min(t) >= -1 and cost < float("inf")


def test_empty(spark):
    assert simhash.simhash_components(docs.empty(spark)).collect() == []
    assert simhash.near_dedup(docs.empty(spark)).collect() == []


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(100)] + [(7, 7), (None, 3)]
    got = components(Work(spark, "t"), spark.createDataFrame(pairs, "a long, b long"))
    nodes = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert dict(map(tuple, got.collect())) == closure([p for p in pairs if p[0] is not None], nodes) and got.count() == len(nodes)


def jaccard(a, b, k=5):
    s, t = ({" ".join(x.lower().split()[i : i + k]) for i in range(len(x.split()) - k + 1)} for x in (a, b))
    return len(s & t) / len(s | t)


def test_near_dedup(spark):
    rng = random.Random(4)
    base = [docs.words(rng, rng.randint(150, 400)) for _ in range(60)]
    rows, of = [], defaultdict(list)
    for n, b in enumerate(base):
        for _ in range(3):
            w = b.copy()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edited"
            of[n].append(len(rows))
            rows.append((len(rows), " ".join(w), "en", "s", 1, 1, "r", 1, 1))
    odd = [(900, None), (901, ""), (902, None), (None, rows[0][1]), (None, None)]
    table = docs.table(spark, rows + [(i, t, None, None, None, None, None, None, None) for i, t in odd] + [rows[0]])
    got = simhash.near_dedup(table).collect()
    kept = [r.doc_id for r in got]
    assert got[0].__fields__ == table.columns and {900, 901, 902} < set(kept) and kept.count(None) == 2
    left = {i for i in kept if i is not None and i < 900}
    want = sum(1 for m in of.values() for i in m[1:] if any(jaccard(rows[i][1], rows[j][1]) >= 0.8 for j in m if j < i))
    assert all(m[0] in left for m in of.values()) and len(kept) == len(set(kept)) + 1
    assert len(rows) - len(left) >= 0.9 * want


def test_near_dedup_against_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for i, t in sorted(tuple(r) for r in df.collect()):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")
        words = [w for part in words for w in part.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    by, root = {}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    far = set()
    for i, s in sets.items():
        for j in {j for g in s for j in by.get(g, ())}:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
            else:
                far |= {i}
        for g in s:
            by.setdefault(g, []).append(i)
    want = {i for i, s in sets.items() if not s or find(i) == i}
    got = {r.doc_id for r in simhash.near_dedup(df).collect()}
    assert far and want <= got and len(got - want) <= 0.05 * (len(sets) - len(want))


def grouped(sets, least=0.8):
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return closure(near, sets)


def sets_of(rows, k=5):
    return {i: frozenset(tuple(t.split()[j : j + k]) for j in range(max(1, len(t.split()) - k + 1))) for i, t in rows}


@pytest.fixture(scope="module", params=[2048, 100])
def star(spark, request):
    """Ids kept, and ids to keep, of variants about 0.8 from one base and mostly less from each other."""
    rng = random.Random(11)
    base = docs.words(rng, 240)
    rows = []
    for i in range(400):
        w = base.copy()
        at = rng.randrange(len(w))
        for j in range(rng.randint(3, 6)):
            w[(at + 11 * j + rng.randrange(6)) % len(w)] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    root = grouped(sets_of(rows))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash, "GROUP_ROWS", request.param, raising=False)
        got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return got, {i for i in root if root[i] == i}


def test_near_dedup_misses_none_of_a_star_group(star):
    got, want = star
    assert 20 <= len(want) <= 300 and got <= want


def test_near_dedup_drops_none_of_a_star_group_wrongly(star):
    got, want = star
    assert want <= got


def test_near_dedup_short_texts(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(150):  # 4 of 5 shingles
        w = docs.words(rng, 9, "abcdefghijklmnop")
        rows += [(2 * i, " ".join(w[:8])), (2 * i + 1, " ".join(w))]
    for i in range(60):  # one shingle that many share
        rows.append((1000 + i, " ".join(["the", "same", "five", "words", "here", *docs.words(rng, 3 + i % 9)])))
    root = grouped(sets_of(rows))
    monkeypatch.setattr(simhash, "GROUP_ROWS", 20, raising=False)
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i in root if root[i] == i}


def test_heads_share_a_shingle():
    rng = np.random.default_rng(3)
    for n in range(1, simhash.SHORT + 1):
        for m in range(n, int(n / 0.8) + 1):
            common = int(np.ceil(0.8 * (n + m) / 1.8 - 1e-9))
            if common > n:
                continue
            for _ in range(20):
                x = rng.choice(10**6, n + m - common, replace=False)
                a, b = np.sort(x[:n]), np.sort(np.r_[x[:common], x[n:]])
                assert set(simhash.heads_of(a, 0.8)) & set(simhash.heads_of(b, 0.8))


def test_near_dedup_clashing_names_and_equal_rows(spark):
    given = docs.table(spark).selectExpr("*", "7 AS `a.b`", "7 AS _rank", "7 AS rank", "7 AS t", "7 AS fp", "7 AS n")
    got = simhash.near_dedup(given)
    assert got.columns == given.columns
    kept = [r.doc_id for r in got.collect()]
    again = [r.doc_id for r in simhash.near_dedup(docs.table(spark)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, again)) and len({k for k in kept if k is not None}) == len([k for k in kept if k is not None])
    assert {(r["a.b"], r.rank, r.fp) for r in got.collect()} == {(7, 7, 7)}


def test_near_dedup_small_groups_against_all_pairs(spark):
    """150 groups of 8 copies of a 300-word text with up to 6 edits each: nothing is dropped wrongly, and what is missed lies beyond the radii."""
    rng = random.Random(21)
    rows = []
    for g in range(150):
        base = docs.words(rng, 300)
        for _ in range(8):
            w = base.copy()
            for k in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"edit{g}x{len(rows)}x{k}"
            rows.append((len(rows), " ".join(w)))
    sets = sets_of(rows)
    root = {i: r for g in range(150) for i, r in grouped({i: sets[i] for i in range(8 * g, 8 * g + 8)}).items()}
    want = {i for i in root if root[i] == i}
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 0.01 * (len(rows) - len(want))
