"""Vector arithmetic on array columns, inside the JVM. Elements are taken to double before any product."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    """Inner product, folded in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Raw cosine in -1..1; null where a side has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine mapped to 0..1."""
    return (cosine(a, b) + 1) / 2


def similarity(a: Column, b: Column) -> Column:
    """Mapped cosine; 0 where a side is missing."""
    return F.coalesce(cosine01(a, b), F.lit(0.0))


def length_normalized(a: Column, scale_by_dims: bool = False) -> Column:
    """Scaled to length 1, or to the root of the number of dimensions; short vectors (norm up to 1e-10) stay."""
    n = norm(a)
    factor = F.sqrt(F.size(a).cast("double")) if scale_by_dims else F.lit(1.0)
    return F.when(n > 1e-10, F.transform(a, lambda x: _d(x) / n * factor)).otherwise(F.transform(a, _d))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _d(x) - _d(y))


def mat_vec(rows: Column, x: Column) -> Column:
    """Product of a matrix (array of rows) and a vector."""
    return F.transform(rows, lambda r: dot(r, x))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def plda_llr(enroll: Column, test: Column, psi: Column, n_enroll: Column) -> Column:
    """Log-likelihood ratio of a two-covariance model in its diagonal space.

    Given ``n`` enrolment utterances with mean ``e``, the test vector is normal with mean ``n psi e / (n psi + 1)`` and
    variance ``1 + psi / (n psi + 1)`` if the speaker is the same, else normal with mean 0 and variance ``1 + psi``.
    """
    zipped = F.arrays_zip(enroll.alias("e"), test.alias("t"), psi.alias("p"))
    n = n_enroll.cast("double")

    def term(z: Column) -> Column:
        e, t, p = z.getField("e").cast("double"), z.getField("t").cast("double"), z.getField("p").cast("double")
        same_mean, same_var, other_var = n * p / (n * p + 1) * e, 1 + p / (n * p + 1), 1 + p
        return -0.5 * (F.ln(same_var) + F.pow(t - same_mean, F.lit(2)) / same_var) + 0.5 * (F.ln(other_var) + t * t / other_var)

    return F.aggregate(F.transform(zipped, term), F.lit(0.0), lambda s, x: s + x)


def clipped_sigmoid(x: Column, clip: float = 60.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))))


def score_factors(a: Column, b: Column, digits: int = 4) -> list[Column]:
    """Minimum, maximum, difference and ratio of two magnitudes, to so many digits (halves up)."""
    low, high, unit = F.least(a, b), F.greatest(a, b), float(10**digits)
    return [F.floor(x * unit + 0.5) / unit for x in (low, high, high - low, F.try_divide(high, low))]


def linear_score(weights: Column, factors: Column, bias: Column) -> Column:
    return dot(weights, factors) + bias


def cyclic_fill(a: Column, n: int) -> Column:
    """The first ``n`` elements of the array repeated end to end."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(a, F.pmod(i, F.size(a)).cast("int")))


def chunk_at(a: Column, start: Column, n: int) -> Column:
    """``n`` elements from ``start``; arrays that are too short are filled cyclically."""
    return F.when(F.size(a) >= n, F.slice(a, start + 1, F.lit(n))).otherwise(cyclic_fill(a, n))


def zero_range(a: Column, begin: Column, end: Column) -> Column:
    """Elements ``begin..end-1`` set to 0."""
    return F.transform(a, lambda x, i: F.when((i >= begin) & (i < end), F.lit(0).cast("double")).otherwise(_d(x)))


def cut_spans(a: Column, spans: Column, per_second: int) -> Column:
    """The elements inside ``ARRAY<STRUCT<begin, end>>`` of seconds, one span after another."""
    part = lambda s: F.slice(a, F.floor(s["begin"] * per_second).cast("int") + 1, (F.floor(s["end"] * per_second) - F.floor(s["begin"] * per_second)).cast("int"))
    return F.flatten(F.transform(spans, part))


def energy_db(a: Column) -> Column:
    """Mean power in decibels, with a floor of 1e-4 under it."""
    return 10 * F.log10(dot(a, a) / F.size(a) + 1e-4)


def noise_gain(speech_db: Column, noise_db: Column, snr_db: Column) -> Column:
    """The factor that brings noise to a signal-to-noise ratio."""
    return F.pow(F.lit(10.0), (speech_db - noise_db - snr_db) / 20)


def peak_normalized(a: Column) -> Column:
    peak = F.array_max(F.transform(a, lambda x: F.abs(_d(x)))) + 1e-4
    return F.transform(a, lambda x: _d(x) / peak)


def pre_emphasis(a: Column, c: float = 0.97) -> Column:
    """Each sample less ``c`` times the one before; the first uses itself."""
    return F.transform(a, lambda x, i: _d(x) - c * _d(F.get(a, F.greatest(i - 1, F.lit(0)))))


def mel(hertz: Column) -> Column:
    return 1127.0 * F.ln(1 + hertz / 700.0)


def inverse_mel(m: Column) -> Column:
    return 700.0 * (F.exp(m / 1127.0) - 1)


def hamming(i: Column, n: Column) -> Column:
    return 0.54 - 0.46 * F.cos(2 * math.pi * i / (n - 1))


def cepstral_mean(frames: Column) -> Column:
    """Mean over time of an array of frames."""
    dims = F.sequence(F.lit(0), F.size(F.get(frames, F.lit(0))) - 1)
    return F.transform(dims, lambda k: F.aggregate(frames, F.lit(0.0), lambda s, f: s + _d(F.get(f, k))) / F.size(frames))


def mean_normalized(frames: Column) -> Column:
    """Frames less their mean over time."""
    mean = cepstral_mean(frames)
    return F.transform(frames, lambda f: F.zip_with(f, mean, lambda x, m: _d(x) - m))


def exponential_rate(step: Column, total: float, initial: float, final: float, warm_up: float = 0.0) -> Column:
    """Learning rate that falls exponentially from initial to final, after a linear warm-up."""
    now = initial * F.exp(step / total * math.log(final / initial))
    return now * F.when(step < warm_up, step / max(warm_up, 1e-12)).otherwise(1.0)


def margin_at(step: Column, start: float, stop: float, initial: float, final: float) -> Column:
    """Margin that rises from initial to final between two steps along an exponential curve."""
    ratio = 1 - F.exp((step - start) / (stop - start) * math.log(1e-3 / (1 + 1e-6))) * 1.0
    return F.when(step < start, initial).when(step >= stop, final).otherwise(initial + (final - initial) * ratio)


def cosine_rate(step: Column, total: float, base: float, final: float) -> Column:
    return final + 0.5 * (base - final) * (1 + F.cos(math.pi * step / total))


def triangular_rate(step: Column, cycle: float, high: float, low: float, ratio: float = 0.5) -> Column:
    """Learning rate that rises and falls once a cycle; each cycle's peak lies ``ratio`` as far above the lowest as the one before."""
    point, half = step % cycle, cycle / 2
    peak = (high - low) * F.pow(F.lit(ratio), F.floor(step / cycle))
    return low + peak * F.when(point <= half, point / half).otherwise(1 - (point - half) / half)


def fixed_chunks(a: Column, n: int) -> Column:
    """The array in chunks of ``n``; the last one is filled up from the head, and a short array is repeated."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / n).cast("int") - 1, F.lit(0)))

    def chunk(i: Column) -> Column:
        part = F.slice(a, i * n + 1, F.lit(n))
        return F.when(F.size(part) < n, F.concat(part, F.slice(a, F.lit(1), n - F.size(part)))).otherwise(part)

    return F.when(F.size(a) < n, F.array(cyclic_fill(a, n))).otherwise(F.transform(starts, chunk))


def reported_percent(line: Column) -> Column:
    """The diarization error that a report line gives, in percent; null where it gives none."""
    return F.regexp_extract(line, r"(?i)OVERALL\s+SPEAKER\s+DIARIZATION\s+ERROR\s*=\s*([\d.]+)\s+percent", 1).try_cast("double")


def zero_padded_steps(a: Column, n: int) -> Column:
    """The array in steps of ``n``, the last filled up with zeros; an empty one has no steps."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / n).cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    part = lambda i: F.transform(F.slice(a, i * n + 1, F.lit(n)), _d)
    return F.transform(starts, lambda i: F.concat(part(i), F.array_repeat(F.lit(0.0), n - F.size(part(i)))))
