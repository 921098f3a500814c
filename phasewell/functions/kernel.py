"""Scalar kernels as Column expressions, with a numpy twin for long patterns.

A pattern is two arrays, amplitudes A and phases f; component i is the complex number A[i] * exp(i f[i]).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zone thresholds, the energy that counts as an exact match, step count of the smooth score.
CORE_ENERGY, FRINGE_ENERGY, CORE_PHASE = 0.85, 0.3, math.pi / 8
EXACT_ENERGY = 0.9999989867210388
SMOOTH_STEPS = 1000


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def energy_total(amplitude: Column) -> Column:
    return F.aggregate(amplitude, F.lit(0.0), lambda a, x: a + x * x)


def inner(a_amp: Column, a_phase: Column, b_amp: Column, b_phase: Column) -> Column:
    """Real inner product of two patterns."""
    cosines = F.zip_with(a_phase, b_phase, lambda f, g: F.cos(g - f))
    return total(F.zip_with(F.zip_with(a_amp, b_amp, lambda x, y: x * y), cosines, lambda x, c: x * c))


def balanced(ea: Column, eb: Column, product: Column) -> Column:
    """Energy of superposition times amplitude balance, from both totals and the inner product."""
    both = ea + eb
    balance = F.when((ea > 0) & (eb > 0), 2 * F.sqrt(ea * eb) / both).otherwise(0.0)
    return F.when(both == 0, 0.0).otherwise(0.5 * (both + 2 * product) / both * balance)


def compare(a_amp: Column, a_phase: Column, b_amp: Column, b_phase: Column, ea: Column | None = None, eb: Column | None = None) -> Column:
    """Energy of two patterns in double precision; ea and eb: their totals, where known."""
    ea = energy_total(a_amp) if ea is None else ea
    eb = energy_total(b_amp) if eb is None else eb
    return balanced(ea, eb, inner(a_amp, a_phase, b_amp, b_phase))


def compare_ignore_phase(a_amp: Column, b_amp: Column) -> Column:
    product = total(F.zip_with(a_amp, b_amp, lambda x, y: x * y))
    return balanced(energy_total(a_amp), energy_total(b_amp), product)


def wrapped(x: Column) -> Column:
    """A phase in (-pi, pi]."""
    return F.lit(math.pi) - F.pmod(F.lit(math.pi) - x, F.lit(2 * math.pi))


def phase_delta(a_phase: Column, b_phase: Column) -> Column:
    """Circular mean of the phase differences, second less first."""
    diff = F.zip_with(a_phase, b_phase, lambda f, g: g - f)
    return F.atan2(total(F.transform(diff, F.sin)), total(F.transform(diff, F.cos)))


def mean_phase_delta(a_phase: Column, b_phase: Column) -> Column:
    """Mean of the absolute wrapped differences."""
    diff = F.zip_with(a_phase, b_phase, lambda f, g: F.abs(F.atan2(F.sin(g - f), F.cos(g - f))))
    return total(diff) / F.size(a_phase)


def zone(energy: Column, delta: Column) -> Column:
    turned = F.abs(delta % (2 * math.pi))
    return F.when((energy >= CORE_ENERGY) & (turned <= CORE_PHASE), "CORE").when(energy >= FRINGE_ENERGY, "FRINGE").otherwise("SHADOW")


def zone_score(zone_col: Column) -> Column:
    return F.when(zone_col == "CORE", 2.0).when(zone_col == "FRINGE", 1.0).otherwise(0.0)


def smooth_score(energy: Column, delta: Column) -> Column:
    """Sigmoid of the energy times a Gaussian of the phase difference, both on a grid of a thousand steps."""
    e = F.round(F.greatest(F.least(energy, F.lit(1.0)), F.lit(0.0)) * SMOOTH_STEPS) / SMOOTH_STEPS
    d = F.round(F.greatest(F.least(delta, F.lit(math.pi)), F.lit(0.0)) / math.pi * SMOOTH_STEPS) / SMOOTH_STEPS * math.pi
    return 1 / (1 + F.exp(-10 * (e - 0.5))) * F.exp(-(d * d) / (2 * (math.pi / 8) ** 2))


def is_exact(energy: Column) -> Column:
    return energy > EXACT_ENERGY


def phase_center(phase: Column) -> Column:
    """Arithmetic mean of the raw phases, 0 if there are none."""
    return F.when(F.size(phase) > 0, total(phase) / F.size(phase)).otherwise(0.0)


def in_range(x: Column, start, end) -> Column:
    """Half-open range [start, end)."""
    return (x >= start) & (x < end)


def ranges_overlap(a_start, a_end, b_start, b_end) -> Column:
    return (a_start < b_end) & (b_start < a_end)


# --- complex numbers as struct<re, im> ----------------------------------------------------------------------


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def to_complex(amp: Column, phase: Column) -> Column:
    return F.zip_with(amp, phase, lambda a, f: complex_of(a * F.cos(f), a * F.sin(f)))


def c_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def c_subtract(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def c_multiply(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_scale(a: Column, x) -> Column:
    return complex_of(a["re"] * x, a["im"] * x)


def c_conjugate(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def c_negate(a: Column) -> Column:
    return complex_of(-a["re"], -a["im"])


def c_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def c_abs_squared(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def c_phase(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


# --- numpy twin -------------------------------------------------------------------------------------------


def scores(amplitude: np.ndarray, phase: np.ndarray, q_amp: np.ndarray, q_phase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Energies and phase differences of rows against one query."""
    diff = phase - q_phase
    cos = np.cos(diff)
    eb, ea = (amplitude * amplitude).sum(1), float((q_amp * q_amp).sum())
    both = ea + eb
    with np.errstate(invalid="ignore", divide="ignore"):
        energy = np.where(both == 0, 0.0, 0.5 * (both + 2 * (amplitude * cos) @ q_amp) / both * np.where((eb > 0) & (ea > 0), 2 * np.sqrt(ea * eb) / both, 0.0))
    return energy, np.arctan2(np.sin(diff).sum(1), cos.sum(1))


def energies(a_amp: np.ndarray, a_phase: np.ndarray, b_amp: np.ndarray, b_phase: np.ndarray) -> np.ndarray:
    """Energies of all rows of a against all rows of b by one matrix product of complex components."""
    x, y = a_amp * np.exp(1j * a_phase), b_amp * np.exp(1j * b_phase)
    ea, eb = (a_amp * a_amp).sum(1)[:, None], (b_amp * b_amp).sum(1)[None, :]
    product = np.hstack([x.real, x.imag]) @ np.hstack([y.real, y.imag]).T
    both = ea + eb
    with np.errstate(invalid="ignore", divide="ignore"):
        balance = np.where((ea > 0) & (eb > 0), 2 * np.sqrt(ea * eb) / both, 0.0)
        return np.where(both == 0, 0.0, 0.5 * (both + 2 * product) / both * balance)


def score_udf(q_amp: list[float], q_phase: list[float]):
    """Arrow-batched scorer of one query: (amplitude, phase) -> struct<energy, phase_delta>."""
    qa, qp = np.asarray(q_amp, float), np.asarray(q_phase, float)

    @F.pandas_udf("energy double, phase_delta double")
    def score(amplitude: pd.Series, phase: pd.Series) -> pd.DataFrame:
        if not len(amplitude):
            return pd.DataFrame({"energy": [], "phase_delta": []}, dtype=float)
        energy, delta = scores(np.stack(amplitude.to_numpy()), np.stack(phase.to_numpy()), qa, qp)
        return pd.DataFrame({"energy": energy, "phase_delta": delta})

    return score
