"""Scores of every pattern of one block against every one of another, by matrix products.

Null components, and those beyond the shorter pattern, count for nothing, as in SQL's sums; without a common component
there is no score. Where a score lies too near a cut between two rounded values to tell, or components are null, it is
worked out term by term, in the order of the SQL, so that rounded scores don't depend on how a matrix product adds up.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores within DOUBT of a cut are worked out again, so many pairs at once.
DOUBT, AT_ONCE = 1e-11, 1 << 13


class Block(NamedTuple):
    """Patterns of one length, a row each; valid: which components aren't null (None: all)."""

    length: int
    valid: np.ndarray | None
    of: dict[str, np.ndarray]

    def take(self, at) -> Block:
        return Block(self.length, None if self.valid is None else self.valid[at], {k: x[at] for k, x in self.of.items()})


def total(terms: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """Sums of rows, term after term; use: the terms that count."""
    if use is not None:
        terms = np.where(use, terms, 0.0)
    out = np.zeros(len(terms))
    for i in range(terms.shape[1]):
        out += terms[:, i]
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds; no negative zero."""
    t = x * 10.0**digits
    whole = np.trunc(t)
    with np.errstate(invalid="ignore"):
        whole += np.copysign(np.abs(t - whole) >= 0.5, t)
    return np.where(np.isfinite(t), whole / 10.0**digits, x) + 0.0


def used(q: Block, c: Block, n: int) -> np.ndarray | None:
    """Where components of both are there, of row by row pairs; None: everywhere."""
    sides = [b.valid[:, :n] for b in (q, c) if b.valid is not None]
    return np.logical_and.reduce(sides) if sides else None


class ClosedForm:
    """Energy of real vectors from their inner product: a pattern's components are the vector's elements in pairs."""

    columns = ("vector",)

    @staticmethod
    def block(v):
        return {"v": v, "t": total(v * v)}

    @staticmethod
    def energy(ea, eb, product):
        both = ea + eb
        return np.where(both == 0, 0.0, 0.5 * (both + 2 * product) / both * 2 * np.sqrt(ea * eb) / both)

    @classmethod
    def fast(cls, q, c, n):
        return cls.energy(q.of["t"][:, None], c.of["t"], q.of["v"][:, :n] @ c.of["v"][:, :n].T), DOUBT

    @classmethod
    def exact(cls, q, c, n):
        return cls.energy(q.of["t"], c.of["t"], total(q.of["v"][:, :n] * c.of["v"][:, :n], used(q, c, n)))


def balanced(ea, eb, product):
    """kernel.balanced in numpy."""
    both = ea + eb
    balance = np.where((ea > 0) & (eb > 0), 2 * np.sqrt(ea * eb) / both, 0.0)
    return np.where(both == 0, 0.0, 0.5 * (both + 2 * product) / both * balance)


class IgnorePhase:
    """Energy of amplitudes alone."""

    columns = ("amplitude",)

    @staticmethod
    def block(a):
        return {"a": a, "t": total(a * a)}

    @staticmethod
    def fast(q, c, n):
        return balanced(q.of["t"][:, None], c.of["t"], q.of["a"][:, :n] @ c.of["a"][:, :n].T), DOUBT

    @staticmethod
    def exact(q, c, n):
        return balanced(q.of["t"], c.of["t"], total(q.of["a"][:, :n] * c.of["a"][:, :n], used(q, c, n)))


class MeanDelta:
    """Mean of the absolute wrapped phase differences over the query's length."""

    columns = ("phase",)

    @staticmethod
    def block(p):
        return {"p": p, "w": np.where(np.abs(p) > np.pi, np.arctan2(np.sin(p), np.cos(p)), p)}

    @staticmethod
    def fast(q, c, n):
        ones, out = np.ones(n), np.empty((len(q.of["w"]), len(c.of["w"])))
        for at in range(0, out.shape[1], 1024):  # what is worked on stays in a core's cache
            held = np.ascontiguousarray(c.of["w"][at : at + 1024, :n].T)
            turn = np.empty_like(held)
            for i, w in enumerate(q.of["w"][:, :n]):
                np.subtract(held, w[:, None], out=turn)
                np.abs(turn, out=turn)
                turn -= np.pi
                np.abs(turn, out=turn)  # pi less the wrapped difference
                out[i, at : at + 1024] = np.pi * n - ones @ turn
        return out / q.length, DOUBT

    @staticmethod
    def exact(q, c, n):
        d = c.of["p"][:, :n] - q.of["p"][:, :n]
        return total(np.abs(np.arctan2(np.sin(d), np.cos(d))), used(q, c, n)) / q.length


class PhaseDelta:
    """Circular mean of the phase differences, the row's less the query's."""

    columns = ("phase",)

    @staticmethod
    def block(p):
        return {"p": p, "c": np.cos(p), "s": np.sin(p)}

    @staticmethod
    def fast(q, c, n):
        qc, qs, cc, cs = q.of["c"][:, :n], q.of["s"][:, :n], c.of["c"][:, :n].T, c.of["s"][:, :n].T
        re, im, err = qc @ cc + qs @ cs, qc @ cs - qs @ cc, 1e-14 * n
        # opposite phases: the sign of next to nothing chooses between pi and -pi; a short sum has no sure direction
        return np.arctan2(im, re), np.where((re < 0) & (np.abs(im) <= err), np.inf, DOUBT + err / np.hypot(re, im))

    @staticmethod
    def exact(q, c, n):
        d, use = c.of["p"][:, :n] - q.of["p"][:, :n], used(q, c, n)
        return np.arctan2(total(np.sin(d), use), total(np.cos(d), use))


class Compare:
    """Energy of patterns, kernel.compare."""

    columns = ("amplitude", "phase")

    @staticmethod
    def block(a, p):
        return {"a": a, "p": p, "x": a * np.cos(p), "y": a * np.sin(p), "t": total(a * a)}

    @staticmethod
    def fast(q, c, n):
        product = q.of["x"][:, :n] @ c.of["x"][:, :n].T + q.of["y"][:, :n] @ c.of["y"][:, :n].T
        return balanced(q.of["t"][:, None], c.of["t"], product), DOUBT

    @staticmethod
    def exact(q, c, n):
        turned = np.cos(c.of["p"][:, :n] - q.of["p"][:, :n])
        return balanced(q.of["t"], c.of["t"], total(q.of["a"][:, :n] * c.of["a"][:, :n] * turned, used(q, c, n)))


def blocks(kind, rows: pa.Table) -> list[tuple[np.ndarray, Block | None]]:
    """Row numbers and patterns by length, those with null components apart; None for patterns that are null."""
    columns, out = [rows[c].combine_chunks() for c in kind.columns], []
    sizes = pc.fill_null(pc.list_value_length(columns[0]), -1).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size < 0:
            out.append((at, None))
            continue
        flat = [c.take(pa.array(at)).flatten() for c in columns]
        shaped = lambda f: f.to_numpy(zero_copy_only=False).reshape(len(at), size)  # noqa: B023, E731
        valid = np.logical_and.reduce([shaped(f.is_valid()) for f in flat]) if any(f.null_count for f in flat) else None
        block = Block(int(size), valid, kind.block(*[shaped(pc.fill_null(f, 0.0)) for f in flat]))
        if valid is None:
            out.append((at, block))
            continue
        whole = valid.all(1)
        out += [(at[some], block.take(some)._replace(valid=held)) for some, held in ((whole, None), (~whole, valid[~whole])) if some.any()]
    return out


def scores(kind, q: Block | None, c: Block | None, shape: tuple[int, int], digits: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores, a row for each of q and a column for each of c, and where there is none (None: nowhere)."""
    n = min(q.length, c.length) if q and c else 0
    if not n:
        return np.zeros(shape), np.ones(shape, bool)
    gaps = q.valid is not None or c.valid is not None
    with np.errstate(all="ignore"):
        if gaps:
            x, again = np.empty(shape), np.ones(shape, bool)
        else:
            x, doubt = kind.fast(q, c, n)
            if digits is not None:
                t = np.abs(x) * 10.0**digits
                again = np.abs(t - np.floor(t) - 0.5) <= doubt * 10.0**digits
        i, j = np.nonzero(again) if gaps or digits is not None else ((), ())
        for at in range(0, len(i), AT_ONCE):
            a, b = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
            x[a, b] = kind.exact(q.take(a), c.take(b), n)
        if digits is not None:
            x = rounded(x, digits)
    if not gaps:
        return x, None
    held = lambda b, rows: (np.ones((rows, n)) if b.valid is None else b.valid[:, :n].astype(float))
    return x, held(q, shape[0]) @ held(c, shape[1]).T == 0
