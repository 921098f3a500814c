"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints: a text is lower-cased (A-Z), its words (runs of anything but space and \\x09-\\x0D) make
overlapping shingles; bit j of the fingerprint is 1 if it is 1 in over half of the shingles' XXH64 hashes.

Search: equal fingerprints first become one node. For radius R the 64 bits are dealt into m parts, bits
that correlate going to the same part, and each part i gets a threshold T[i] >= -1 with sum T = R - m + 1:
two fingerprints within R bits then differ by at most T[i] in some part i (-1: the part isn't probed). For
several m, dynamic programming picks the T of the least cost, from exact counts of each part's values over
all nodes; the cheapest m wins. Part i is cut into T[i] + 1 pieces: of two values within T[i] bits, one piece is
equal, so nodes are dealt to tasks by their pieces, R + 1 rows a node whatever m is. A task looks up the values
within T[i] of each value it holds, verifies those candidates and emits links that span what is connected there,
never all pairs. A piece shared by more than BLOCK nodes is cut into blocks; each pair of blocks meets.

Edge cases. A null text, an empty one and one of white space have fingerprint zero and link like any other;
fewer words than a shingle make one shingle of all words. A row without an id belongs to the component
of its fingerprint and never names one (null if there is no id). Repeated rows share a component. Ties: a
bit in exactly half is 0. An empty table gives an empty result; other columns are ignored by
simhash_components and kept by near_dedup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, as_bytes, tasks_for
from .components import components

#: Parameters: nodes in a block of a hot piece; costs of looking up a value and of verifying a pair; rows to
#: a task; the widest part in bits, which bounds the counts that reach the driver.
BLOCK = 65_536
PROBE_COST, PAIR_COST = 1.5e-5, 2e-9
TASK_ROWS = 100_000
WIDEST = 16
SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U64 = np.uint64


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """XXH64 of each shingle, repeats included."""
    joined = b" ".join((text or b"").translate(LOWER).split())
    if not joined:
        return []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(gaps) + 1 <= size:
        return [digest(joined, SEED)]
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes; sizes are the runs' lengths."""
    n = len(sizes)
    row = np.repeat(np.arange(n) * 256, sizes)
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
    out = np.zeros((n, 64), np.uint8)
    for j in range(8):
        counts = np.bincount(row + octets[:, j], minlength=256 * n).reshape(n, 256)
        out[:, 8 * j : 8 * j + 8] = 2 * (counts @ table) > sizes[:, None]
    return np.packbits(out, axis=1, bitorder="little").view(U64).reshape(n)


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """A further hash of each hash (a multiply-xorshift finaliser), for wide fingerprints."""
    x = hashes + U64((k * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, U64).view(np.int64))


def heads_of(hashes: np.ndarray, least: float) -> np.ndarray:
    """The first of some sorted hashes: of two sets of Jaccard similarity least or more, these have one in common."""
    return hashes[: len(hashes) - ceil(least * len(hashes) - 1e-9) + 1]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, wide: int = 0, once: bool = False, least: float = 0.0) -> DataFrame:
    """id, fp (64 bits as a long), n (shingles), w (wide: that many further longs) and heads for each row.

    once: a shingle that repeats in a text counts once. least (with once): heads are the smallest hashes of a text that has
    no more than SHORT / least shingles, so many that two such texts of that Jaccard similarity share one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            at = 0
            while at < len(texts):  # a few MB of hashes at a time
                parts, heads, total, start = [], [], 0, at
                while at < len(texts) and total < 1_000_000:
                    found = np.array(shingle_hashes(texts[at], shingle), U64)
                    parts.append(np.unique(found) if once else found)
                    n = len(parts[-1])
                    heads.append(heads_of(parts[-1], least).view(np.int64) if least and 0 < n <= SHORT / least else parts[-1][:0].view(np.int64))
                    total, at = total + n, at + 1
                sizes, hashes = np.array([len(p) for p in parts]), np.concatenate(parts)
                with np.errstate(over="ignore"):
                    more = [majority(mixed(hashes, k + 1), sizes) for k in range(wide)]
                flat = np.stack(more, 1).reshape(-1) if wide else np.zeros(0, U64)
                w = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * wide, pa.int32()), signed(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, at - start), signed(majority(hashes, sizes)), pa.array(sizes.astype(np.int64)), w, pa.array(heads, pa.list_(pa.int64()))], names=["id", "fp", "n", "w", "heads"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "id long, fp long, n long, w array<long>, heads array<long>")


# --- parts and thresholds ---------------------------------------------------------------------------


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, U64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(together: np.ndarray, ones: np.ndarray, n: int, m: int) -> list[list[int]]:
    """64 bits in m parts; each part grows by the free bit that correlates most with its bits so far."""
    mean = ones / max(n, 1)
    cov = together / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    free, parts = set(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        part = [min(free, key=lambda j: (abs(mean[j] - 0.5), j))]
        free.discard(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda j: (corr[j, part].sum(), -j)))
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def value_of(fps: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part, packed."""
    out = np.zeros(len(fps), np.int64)
    for k, j in enumerate(part):
        out |= (((fps >> U64(j)) & U64(1)).astype(np.int64)) << k
    return out


def flips(width: int, radius: int) -> list[int]:
    """Masks of at most radius of width bits, zero first."""
    return [sum(1 << j for j in c) for r in range(radius + 1) for c in combinations(range(width), r)]


@dataclass(frozen=True)
class Piece:
    """Some bits of a part, and the masks (over the part's bits) that it is the first piece to leave alone."""

    part: int
    bits: list[int]
    masks: list[int]


def pieces_of(parts: list[list[int]], thresholds: list[int]) -> list[Piece]:
    """T + 1 pieces of each probed part: a mask of at most T bits leaves one of them alone."""
    out = []
    for i, (part, t) in enumerate(zip(parts, thresholds, strict=True)):
        cuts = [range(k, len(part), t + 1) for k in range(t + 1)]
        left = flips(len(part), t)
        for cut in cuts:
            touched = sum(1 << k for k in cut)
            out.append(Piece(i, [part[k] for k in cut], [f for f in left if not f & touched]))
            left = [f for f in left if f & touched]
    return out


def spread(part: list[int]) -> np.ndarray:
    """Fingerprints that have each value of a part, in order, and zeros elsewhere."""
    values, out = np.arange(1 << len(part), dtype=U64), np.zeros(1 << len(part), U64)
    for k, j in enumerate(part):
        out |= ((values >> U64(k)) & U64(1)) << U64(j)
    return out


def allocate(counts: list[np.ndarray], widths: list[int], radius: int, bands: int = 1, share: float = 1.0) -> tuple[float, list[int]]:
    """Least estimated cost, and the thresholds that have it: dynamic programming over parts and their sum.

    bands: groups in which each value is looked up; share: of the pairs of a value, those that also meet by band.
    """
    m, n = len(counts), int(counts[0].sum())
    most = max(0, min(3, radius - m + 1 + m))
    cost = []
    for c, width in zip(counts, widths, strict=True):
        row, pairs, c = {-1: 0.0}, 0.0, c.astype(np.float64)
        for t in range(most + 1):
            if t > width or comb(width, t) > 1000:
                break
            index = np.arange(len(c))
            pairs += sum(float(c @ c[index ^ sum(1 << j for j in f)]) for f in combinations(range(width), t))
            row[t] = PAIR_COST * share * pairs + PROBE_COST * min(n, bands * len(c)) * sum(comb(width, s) for s in range(t + 1))
        cost.append(row)
    best = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (so_far, chosen) in best.items():
            for t, c in row.items():
                if total + t not in nxt or so_far + c < nxt[total + t][0]:
                    nxt[total + t] = so_far + c, [*chosen, t]
        best = nxt
    return best.get(radius - m + 1, (float("inf"), []))


def plan(nodes: DataFrame, radius: int, banded: bool = False) -> tuple[list[list[int]], list[int], list[Piece], dict[tuple[int, int], int]]:
    """Parts, thresholds, pieces, and the blocks of each (piece, value) so common that its nodes go into several."""
    moments = "i int, j int, x long"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((64, 64)), 0
        for b in batches:
            bits = bits_of(b.column(0).to_numpy()).astype(np.float32)
            sums, n = sums + bits.T @ bits, n + len(bits)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array([*i, -1], pa.int32()), pa.array([*j, -1], pa.int32()), pa.array([*sums.reshape(-1).astype(np.int64), n])], names=["i", "j", "x"])

    together, n = np.zeros((64, 64)), 0
    for r in nodes.select("fp").mapInArrow(gather, moments).groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # 4,097 rows
        if r.i < 0:
            n = r.x
        else:
            together[r.i, r.j] = r.x
    ms = [m for m in range(-(-64 // WIDEST), min(radius + 2, 17)) if m >= (radius + 1) / 3] or [16]
    parts = {m: grouped_bits(together, np.diag(together), n, m) for m in ms}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(m, i): np.zeros(1 << len(p), np.int64) for m in ms for i, p in enumerate(parts[m])}
        for b in batches:
            fps = b.column(0).to_numpy().view(U64)
            for (m, i), c in sums.items():
                c += np.bincount(value_of(fps, parts[m][i]), minlength=len(c))
        for (m, i), c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 100 * m + i), pa.int32()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["i", "j", "x"])

    counts = {(m, i): np.zeros(1 << len(p), np.int64) for m in ms for i, p in enumerate(parts[m])}
    for r in nodes.select("fp").mapInArrow(count, moments).groupBy("i", "j").agg(F.sum("x").alias("x")).toLocalIterator():  # at most 2**WIDEST a part
        counts[divmod(r.i, 100)][r.j] = r.x
    share, bands = 1.0, {}
    if banded and n:  # a band is a logarithm of a length, so they are few
        bands = {r.band: r.x for r in nodes.groupBy("band").agg(F.count("*").alias("x")).toLocalIterator()}
        share = sum((x + bands.get(k + 1, 0)) ** 2 for k, x in bands.items()) / n**2
    choices = {m: allocate([counts[m, i] for i in range(m)], [len(p) for p in parts[m]], radius, max(1, len(bands)), share) for m in ms}
    m = min(ms, key=lambda m: (choices[m][0], m))
    pieces = pieces_of(parts[m], choices[m][1])
    hot = {}
    for p, piece in enumerate(pieces):
        x = np.bincount(value_of(spread(parts[m][piece.part]), piece.bits), counts[m, piece.part], 1 << len(piece.bits)).astype(np.int64)
        if bands and x.max() > BLOCK:  # of a common value, the most nodes that meet in one band
            x = by_band(nodes, piece.bits, min(bands), max(bands))
        hot |= {(p, int(v)): -(-int(x[v]) // BLOCK) for v in np.flatnonzero(x > BLOCK)}
    return parts[m], choices[m][1], pieces, hot


def by_band(nodes: DataFrame, part: list[int], first: int, last: int) -> np.ndarray:
    """For each value of some bits, the most nodes that have it and one of two neighbouring bands."""
    wide = last - first + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(wide << len(part), np.int64)
        for b in batches:
            at = value_of(b.column(0).to_numpy().view(U64), part) * wide + b.column(1).to_numpy() - first
            c += np.bincount(at, minlength=len(c))
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at])], names=["i", "x"])

    c = np.zeros(wide << len(part), np.int64)
    for r in nodes.select("fp", "band").mapInArrow(count, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).toLocalIterator():  # at most 2**WIDEST a band
        c[r.i] = r.x
    c = c.reshape(-1, wide)
    c[:, 1:] += c[:, :-1].copy()
    return c.max(axis=1)


# --- links inside one value of one part ---------------------------------------------------------------


def span(fps, wide, radius, levels) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers that connect what is connected; fewer pairs than rows.

    Breadth first: each row is compared once with all rows not yet reached, which a tight cluster leaves few.
    With wide bits this is done for each level (a wide radius, rising), a cluster of the levels before being reached as
    one by its closest row: what is connected at a level is then connected by links within it.
    """
    if wide is not None and len(levels) > 1:  # rows with no link at all need no further look
        a, b = span(fps, wide, radius, levels[-1:])
        rows = np.unique(np.concatenate([a, b]))
        if len(rows) < len(fps):
            a, b = span(fps[rows], wide[rows], radius, levels)
            return rows[a], rows[b]
    a, b, cluster = [], [], np.arange(len(fps))
    for n, level in enumerate(levels if wide is not None else (None,)):
        todo, front, joined = np.arange(len(fps)), [], np.zeros(len(fps), np.int64)
        while len(todo):
            if not front:
                mine = cluster[todo] == cluster[todo[0]]
                front, now = todo[mine].tolist(), int(todo[0])
                joined[front], todo = now, todo[~mine]
                continue
            c = front.pop()
            near = todo[np.bitwise_count(fps[todo] ^ fps[c]) <= radius]
            if wide is not None and len(near):
                apart = np.bitwise_count(wide[near] ^ wide[c]).sum(axis=1, dtype=np.int64)
                order = np.argsort(apart, kind="stable")
                near = near[order[: np.searchsorted(apart[order], level, "right")]]
            if len(near):
                if n:
                    near = near[np.unique(cluster[near], return_index=True)[1]]
                a += [c] * len(near)
                b += near.tolist()
                reached = np.isin(cluster[todo], cluster[near])
                front += todo[reached].tolist()
                joined[todo[reached]], todo = now, todo[~reached]
        cluster = joined
    return np.array(a, np.int64), np.array(b, np.int64)


#: Comparisons at a time; links a row from which spanning ones are taken instead.
AT_ONCE, MANY = 1 << 18, 8


def across(fps, wide, mine, others, radius, levels) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of two runs of rows (slices; the same or apart); spanning ones if they are many."""
    size, total, a, b = mine.stop - mine.start, 0, [], []
    step = max(1, AT_ONCE // max(1, others.stop - others.start))
    for at in range(mine.start, mine.stop, step):
        low = at if mine == others else others.start
        x, y = np.nonzero(np.bitwise_count(fps[at : min(at + step, mine.stop), None] ^ fps[None, low : others.stop]) <= radius)
        x, y = x + at, y + low
        if mine == others:
            x, y = x[x < y], y[x < y]
        if wide is not None and len(x):
            ok = np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int64) <= levels[-1]
            x, y = x[ok], y[ok]
        total += len(x)
        if total > MANY * (size + others.stop - others.start):
            rows = np.unique(np.r_[mine, others])
            x, y = span(fps[rows], wide[rows] if wide is not None else None, radius, levels)
            return rows[x], rows[y]
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def probe(fps, wide, values, masks, radius, levels) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows, sorted by value, whose values differ by one of the masks."""
    found, starts = np.unique(values, return_index=True)
    ends = [*starts[1:].tolist(), len(values)]
    place = {v: slice(a, b) for v, a, b in zip(found.tolist(), starts.tolist(), ends, strict=True)}
    for v, mine in place.items():
        for mask in masks:
            others = place.get(v ^ mask)
            if others is not None and v <= v ^ mask:
                yield across(fps, wide, mine, others, radius, levels)


def starred(pairs: np.ndarray) -> np.ndarray:
    """Of pairs (distance, a, b): (0, smallest, other) for each set that they connect, so that later rounds meet no chains."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for _, x, y in pairs.tolist():
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)
        up.setdefault(min(x, y), min(x, y))
    return np.array([(0, r, x) for x in up if (r := find(x)) != x], np.int64).reshape(-1, 3)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs (distance first) that each connect two sets that weren't connected yet."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    used = []
    for n, (_, x, y) in enumerate(pairs.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            used.append(n)
    return pairs[used]


SMALL = 512


def links(work: Work, nodes: DataFrame, radius: int, levels: tuple[int, ...] = (), banded: bool = False, stars: bool = False) -> DataFrame:
    """(a, b): ids of nodes that lie within radius bits, as spanning links (stars: each task's sets as stars instead,
    which connect the same nodes).

    With levels, also within levels[-1] wide bits, spanning at each level; their number comes as a column apart.
    nodes: id, fp, w and, if banded, band: only nodes whose bands differ by at most one are compared.
    """
    spark = nodes.sparkSession
    parts, thresholds, pieces, hot = plan(nodes, radius, banded)
    use_wide = bool(levels)
    part_bits = [U64(sum(1 << j for j in parts[p.part])) for p in pieces]
    piece_bits = [U64(sum(1 << j for j in p.bits)) for p in pieces]
    blocks_of = {p: np.ones(1 << len(pieces[p].bits), np.int64) for p, _ in hot}
    for (p, v), count in hot.items():
        blocks_of[p][v] = count

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(U64)
            bands = b.column(3).to_numpy()
            slot = (mixed(fps, 7) % U64(1 << 20)).astype(np.int64)
            for p, piece in enumerate(pieces):
                value = value_of(fps, piece.bits)
                blocks = blocks_of[p][value] if p in blocks_of else np.ones(len(value), np.int64)
                # a row for each pair of blocks, so that any two nodes meet
                at = np.repeat(np.arange(len(ids)), blocks)
                other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                mine = slot[at] % blocks[at]
                pair = np.minimum(mine, other) << 20 | np.maximum(mine, other)
                rows = pa.array(at)
                for shift in (0, 1) if banded else (0,):
                    cell = p << 40 | value[at] << 20 | bands[at] + shift
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(pair), *[b.column(c).take(rows) for c in range(3)]], names=["cell", "blocks", "id", "fp", "w"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        fps, cell, blocks = table["fp"].to_numpy().view(U64), table["cell"].to_numpy(), table["blocks"].to_numpy()
        values = np.zeros(len(fps), np.int64)  # of the whole part
        for p, piece in enumerate(pieces):
            here = np.flatnonzero(cell >> 40 == p)
            values[here] = value_of(fps[here], parts[piece.part])
        order = np.lexsort((values, blocks, cell))
        ids, fps, cell, blocks, values = table["id"].to_numpy()[order], fps[order], cell[order], blocks[order], values[order]
        wide = None
        if use_wide:
            wide = table["w"].combine_chunks().flatten().to_numpy().view(U64).reshape(table.num_rows, -1)[order]
        del table
        edges = [0, *(1 + np.flatnonzero((cell[1:] != cell[:-1]) | (blocks[1:] != blocks[:-1]))).tolist(), len(order)]
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo < 2:
                continue
            f, w = fps[lo:hi], wide[lo:hi] if use_wide else None
            if hi - lo <= SMALL:
                met = [across(f, w, slice(0, hi - lo), slice(0, hi - lo), radius, levels)]
            else:
                met = probe(f, w, values[lo:hi], pieces[int(cell[lo]) >> 40].masks, radius, levels)
            for x, y in met:
                out_a.append(lo + x)
                out_b.append(lo + y)
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        mine, differ, keep = cell[a] >> 40, fps[a] ^ fps[b], ids[a] != ids[b]
        for p, piece in enumerate(pieces[:-1]):  # pairs that an earlier piece brings together are connected there
            there = (differ & piece_bits[p] == 0) & (np.bitwise_count(differ & part_bits[p]) <= thresholds[piece.part])
            keep &= (mine <= p) | ~there
        a, b = a[keep], b[keep]
        apart = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64) if use_wide else np.zeros(len(a), np.int64)
        pairs = forest(np.unique(np.column_stack([apart, ids[a], ids[b]]), axis=0))
        if stars:
            pairs = starred(pairs)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in (1, 2, 0)], names=["a", "b", "apart"])

    band = F.col("band").cast("long") if banded else F.lit(0).cast("long")
    rows = nodes.count() * len(pieces) * (2 if banded else 1)
    filed = nodes.select("id", "fp", "w" if use_wide else F.array().cast("array<long>").alias("w"), band.alias("band")).mapInArrow(file, "cell long, blocks long, id long, fp long, w array<long>")
    met = filed.repartition(tasks_for(spark, rows, TASK_ROWS), "cell", "blocks").mapInArrow(meet, "a long, b long, apart long")
    return met if use_wide else met.select("a", "b")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """id, fp, component: the smallest id reachable by links of at most radius bits."""
    work = Work(df.sparkSession, "simhash")
    prints = work.save(fingerprints(df, id_col, text_col, shingle).select("id", "fp"), "prints")
    nodes = work.save(prints.groupBy("fp").agg(F.min("id").alias("id")).where("id IS NOT NULL").select("id", "fp"), "nodes")
    found = components(work, links(work, nodes, radius, stars=True))
    named = nodes.join(found, nodes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component"))
    return prints.join(work.save(named, "named"), "fp", "left").select("id", "fp", "component")


#: Rows and shingles in a block of a group whose pairs are verified; members of groups that go to all tasks at once.
GROUP_ROWS, GROUP_SHINGLES, FEW = 2_048, 1_000_000, 1_000_000
#: Shingles of a text up to which its near-copies are found by shared shingles too: ties make its bits differ more often.
SHORT = 32


def alike(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Row numbers that pairs of a Jaccard similarity of at least least connect (no set is empty), as stars.

    Breadth first: each row is compared with all rows not yet reached, so only pairs that confirmed links join are left out.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(flat), np.uint8)
    a, b, front, todo, left, root = [], [], [], np.arange(len(sets)), flat, 0
    while len(todo):
        if not front:
            root = int(todo[0])
            front, left, todo = [root], left[sizes[todo[0]] :], todo[1:]
            continue
        c = front.pop()
        own = flat[starts[c] : starts[c] + sizes[c]]
        mark[own] = 1
        both = np.add.reduceat(mark[left], np.cumsum(sizes[todo]) - sizes[todo], dtype=np.int64)
        mark[own] = 0
        near = both >= least * (sizes[c] + sizes[todo] - both)
        if near.any():
            reached = todo[near].tolist()
            a, b, front = a + [root] * len(reached), b + reached, front + reached
            left, todo = left[np.repeat(~near, sizes[todo])], todo[~near]
    return a, b


def confirmed(work: Work, df: DataFrame, members: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """(a, b): of all pairs of one group that have a similarity of at least least, links that span what they connect.

    members: kind and key of a group, id, n (shingles). A group of more than GROUP_ROWS rows or GROUP_SHINGLES is cut into
    blocks, and each pair of blocks meets in a run of its own.
    """
    spark = df.sparkSession
    blocks = F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("blocks")
    groups = members.groupBy("kind", "key").agg(F.count("*").alias("x"), blocks).where("x > 1").select("kind", "key", "blocks")
    held = work.save(members.select("kind", "key", "id").distinct().join(groups, ["kind", "key"]), "members")
    number, copies = held.agg(F.count("*"), F.sum(F.greatest(F.col("blocks") - 1, F.lit(1)))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            x, y = alike(sets, least)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in x], pa.int64()), pa.array([ids[i] for i in y], pa.int64())], names=["a", "b"])

        last, ids, sets = None, [], []
        for b in batches:  # rows come sorted by cell
            cells = zip(*[b.column(c).to_pylist() for c in range(4)], strict=True)
            for cell, i, t in zip(cells, b.column(4).to_pylist(), as_bytes(b.column(5)), strict=True):
                if cell != last:
                    if len(ids) > 1:
                        yield found()
                    last, ids, sets = cell, [], []
                hashes = np.unique(np.array(shingle_hashes(t, shingle), U64))
                if len(hashes):
                    ids.append(i)
                    sets.append(hashes)
        if len(ids) > 1:
            yield found()

    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = texts.join(F.broadcast(held) if number <= FEW else held, "id").distinct()
    slot, cell = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), ["kind", "key", "low", "high"]
    dealt = rows.withColumn("slot", slot).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 OR other != slot")
    dealt = dealt.select("kind", "key", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), "id", "t")
    dealt = dealt.repartition(tasks_for(spark, copies or 0, 4 * GROUP_ROWS), *cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(run, "a long, b long").where("a != b").distinct()


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 15, wide: int = 4, levels: tuple[int, ...] = (22, 40, 56), ratio: float = 1.25, one_blank: bool = False) -> DataFrame:
    """The rows of df less near-copies: of each group the row of the smallest id stays (all columns).

    Candidates are texts whose numbers of different shingles lie within about ratio, their 64-bit fingerprints
    within radius and their wide fingerprints (64 * wide further bits) within levels[-1]. For sets of shingles of
    Jaccard similarity s a bit differs with probability acos(2 s / (1 + s)) / pi, 0.15 at 0.8: these radii lie two and
    three standard deviations above that. Groups that candidates connect are then compared from the texts, each pair that
    confirmed links don't join already, and so are texts of up to SHORT / similarity shingles that share one of their
    smallest hashes (heads_of), by which no pair with a text of at most SHORT shingles is missed. Only texts of equal
    fingerprints, wide ones too, are near-copies without that look. Texts without words are left alone
    (one_blank: they are copies of each other, and the smallest id stays), and so are rows without an id; rows that
    share an id stay or go together, but of equal rows one stays.
    """
    work = Work(df.sparkSession, "neardup")
    keyed = fingerprints(df, id_col, text_col, shingle, wide, once=True, least=similarity)
    prints = work.save(keyed.select("id", "fp", "w", "n", "heads"), "prints")
    nodes = prints.where("n > 0 AND id IS NOT NULL").groupBy("fp", "w").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("heads").alias("heads"))
    nodes = work.save(nodes.select("id", "fp", "w", F.floor(F.log(ratio, F.col("n"))).cast("long").alias("band"), "n", "heads"), "nodes")
    likely = work.save(links(work, nodes, radius, levels, banded=True, stars=True), "likely")
    groups = work.save(components(work, likely), "groups")
    members = groups.join(nodes, groups["node"] == nodes["id"]).select(F.lit(0).alias("kind"), F.col("component").alias("key"), "id", "n")
    short = nodes.select(F.lit(1).alias("kind"), F.explode("heads").alias("key"), "id", "n")
    members = members.unionByName(short)
    found = components(work, confirmed(work, df, members, id_col, text_col, shingle, similarity))
    lost = work.save(found.where("node != component").select(F.col("node").alias("id")), "lost")
    stay = nodes.select("id").join(lost, "id", "left_anti")
    empty = prints.where("n = 0 AND id IS NOT NULL").select("id").distinct()
    if one_blank:
        empty = empty.agg(F.min("id").alias("id")).where("id IS NOT NULL")
    named = prints.where("id IS NOT NULL").select("id").distinct()
    gone = work.save(named.join(stay.unionByName(empty), "id", "left_anti"), "gone")  # fewer than those that stay
    twice = prints.where("id IS NOT NULL").groupBy("id", "fp").count().where("count > 1").select("id").distinct()
    twice = work.save(twice.join(gone, "id", "left_anti"), "twice")  # ids that equal rows may share; few as a rule
    for done in ("prints", "nodes", "likely", "groups", "lost"):
        work.drop(done)
    columns = [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)]
    inside = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    if twice.isEmpty():
        return inside.join(gone, "id", "left_anti").select(*columns)
    rank = F.row_number().over(Window.partitionBy("id", F.xxhash64("t")).orderBy(F.lit(0)))
    once = inside.join(twice, "id", "left_semi").withColumn("rank", rank).where("rank = 1")  # only these rows are dealt out
    return inside.join(gone.unionByName(twice), "id", "left_anti").select(*columns).unionByName(once.select(*columns))
