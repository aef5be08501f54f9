"""Scalar functions on columns: angles, guards, bit fields, quantisers and labels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers below this mean "missing" in event files.
SENTINEL_BELOW = -900.0


def wrap_angle(a: Column, b: Column | None = None) -> Column:
    """``a`` (less ``b``) as an angle in [-pi, pi)."""
    turned = a if b is None else a - b
    return F.pmod(turned + F.pi(), 2 * F.pi()) - F.pi()


def delta_r2(eta1: Column, phi1: Column, eta2: Column, phi2: Column) -> Column:
    """Squared distance in (eta, phi)."""
    dphi = F.pi() - F.abs(F.pi() - F.abs(phi1 - phi2))
    return (eta1 - eta2) * (eta1 - eta2) + dphi * dphi


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """``part / whole`` where ``whole`` is positive, else 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def log_positive(x: Column) -> Column:
    """Logarithm of a positive number, 0 for others."""
    return F.ln(F.when(x > 0, x).otherwise(F.lit(1.0)))


def log_floor(x: Column, floor: float = 1e-3) -> Column:
    """Logarithm of ``x`` or of ``floor``, whichever is larger."""
    return F.ln(F.greatest(x, F.lit(floor)))


def relative_to(child: dict[str, Column], parent: dict[str, Column]) -> dict[str, Column]:
    """pt_rel, pt_rel_log, deta and dphi of a child with ``pt``, ``eta`` and ``phi`` in its parent's frame."""
    share = ratio_or_zero(child["pt"], parent["pt"])
    return {"pt_rel": share, "pt_rel_log": log_positive(share), "deta": child["eta"] - parent["eta"], "dphi": wrap_angle(child["phi"], parent["phi"])}


# A candidate's particle id of each flag, and the sign of its charge (0: any).
PARTICLE_FLAGS = {
    "isPhoton": (3, 0),
    "isElectronPlus": (1, 1),
    "isElectronMinus": (1, -1),
    "isMuonPlus": (4, 1),
    "isMuonMinus": (4, -1),
    "isNeutralHadron": (2, 0),
    "isChargedHadronPlus": (0, 1),
    "isChargedHadronMinus": (0, -1),
}


def particle_flags(kind: Column, charge: Column) -> dict[str, Column]:
    """Eight 0/1 flags of a candidate's kind, by charge sign where it has one."""
    return {name: ((kind == code) & (F.signum(charge) == sign) if sign else kind == code).cast("float") for name, (code, sign) in PARTICLE_FLAGS.items()}


def charge_of_flags(sign_of: dict[str, tuple[int, int]] = PARTICLE_FLAGS) -> Column:
    """Charge of a candidate by its flags: 1, -1, or 0 for kinds without one."""
    charged = [F.col(name) * sign for name, (_, sign) in sign_of.items() if sign]
    return sum(charged[1:], charged[0])


def twos_complement(bits: Column, width: int) -> Column:
    """Signed value of a ``width``-bit word."""
    return F.when(bits >= 1 << (width - 1), bits - (1 << width)).otherwise(bits)


def undigitise(bits: Column, width: int, step: float, offset: float = 0.5) -> Column:
    """Middle of the step that a signed word stands for."""
    return (twos_complement(bits, width) + offset) * F.lit(step)


def bin_value(code: Column, values: list[float]) -> Column:
    """The value of a bin code; null for a code without one."""
    return F.get(F.array(*[F.lit(float(v)) for v in values]), code)


def interior_gaps(pattern: Column, width: int = 7) -> Column:
    """Zero bits between the lowest and the highest set bit."""
    low = pattern.cast("int").bitwiseAND(F.lit((1 << width) - 1))
    highest = reduce(lambda rest, b: F.when(F.getbit(low, F.lit(b)) == 1, b).otherwise(rest), range(width), F.lit(-1))
    lowest = reduce(lambda rest, b: F.when(F.getbit(low, F.lit(b)) == 1, b).otherwise(rest), reversed(range(width)), F.lit(-1))
    return F.when(low > 0, highest - lowest + 1 - F.bit_count(low)).otherwise(F.lit(0)).cast("int")


def has_flag(word: Column, bit: int) -> Column:
    """Whether a bit of the word is set."""
    return word.bitwiseAND(F.lit(1 << bit)) != 0


def charge_class(flavour: Column) -> Column:
    """Class of a parton by its charge: 2 positive, 0 negative, 1 for gluons and none."""
    down = F.abs(flavour).isin(1, 3, 5)
    up = F.abs(flavour).isin(2, 4, 6)
    sign = F.signum(flavour.cast("double"))
    return F.when(up, 1 + sign).when(down, 1 - sign).otherwise(F.lit(1)).cast("int")


def clipped_response(target: Column, measured: Column, low: float = 0.3, high: float = 2.0) -> Column:
    """``target / measured`` within [low, high]; 0 where nothing was measured, null where the target is."""
    share = F.greatest(F.lit(low), F.least(F.lit(high), target / F.when(measured > 0, measured)))
    return F.when(target.isNull(), None).when(measured > 0, share).otherwise(F.lit(0.0))


def null_sentinel(x: Column, below: float = SENTINEL_BELOW) -> Column:
    """``x``, or null for the numbers that stand for missing."""
    return F.when(x > below, x)


def zero_sentinel(x: Column, below: float = SENTINEL_BELOW) -> Column:
    """``x``, or 0 for the numbers that stand for missing."""
    return F.coalesce(null_sentinel(x, below), F.lit(0.0))


def log1p_clipped(x: Column, high: float | None = None) -> Column:
    """log(1 + x) of ``x`` within [0, high]; null and NaN stay null."""
    low = F.greatest(x, F.lit(0.0))
    return F.when(x.isNotNull() & ~F.isnan(x), F.log1p(low if high is None else F.least(low, F.lit(high))))


def quantise_chi2(x: Column) -> Column:
    """Four-bit code of a chi2: twice log2(1 + x), rounded half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(15), F.rint(2 * F.log2(1 + x)))).cast("int")


def quantise_count(x: Column, bits: int) -> Column:
    """``bits``-bit code of a count: log2(1 + x), cut off."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor(F.log2(1.0 + x)))).cast("int")


def quantise_log10(x: Column, scale: float = 3000.0) -> Column:
    """16-bit code of a positive number's logarithm; numbers are kept within 1e-9 and 1e9."""
    return F.rint(F.log10(F.least(F.greatest(x, F.lit(1e-9)), F.lit(1e9))) * scale).cast("smallint")


def dequantise_log10(code: Column, scale: float = 3000.0) -> Column:
    """The number that a code of :func:`quantise_log10` stands for."""
    return F.pow(F.lit(10.0), code / F.lit(scale))


def softmax(logits: Column) -> Column:
    """Shares of an array of logits, taken from the largest so that none overflows."""
    parts = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits)))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda s, y: s + y))


def log_softmax(logits: Column) -> Column:
    """Logarithms of :func:`softmax`."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda s, y: s + F.exp(y.cast("double") - top))
    return F.transform(logits, lambda x: x.cast("double") - top - F.ln(total))


def sigmoid(x: Column) -> Column:
    """Logistic function."""
    return 1 / (1 + F.exp(-x))


def normal_cdf(x: Column, terms: int = 60) -> Column:
    """Share of the standard normal distribution below ``x``: its density times x (1 + x^2/3 (1 + x^2/5 (1 + ...))).

    Exact to 1e-9; 0 or 1 beyond six deviations.
    """
    square = x * x
    series = reduce(lambda rest, k: 1 + square / (2 * k + 1) * rest, range(terms, 0, -1), F.lit(1.0))
    inside = 0.5 + x * series * F.exp(-square / 2) / math.sqrt(2 * math.pi)
    return F.when(x > 6, 1.0).when(x < -6, 0.0).otherwise(inside)


def first_present(*columns: Column) -> tuple[Column, Column]:
    """The first of several columns that isn't a missing number, and which one it was (from 0)."""
    kept = [null_sentinel(c) for c in columns]
    which = reduce(lambda rest, k: F.when(kept[k].isNotNull(), k).otherwise(rest), reversed(range(len(kept))), F.lit(None).cast("int"))
    return F.coalesce(*kept), which


def transverse_impact(x: Column, y: Column, phi: Column) -> Column:
    """Impact parameter of a track at angle ``phi`` from a vertex at (x, y)."""
    return x * F.sin(phi) - y * F.cos(phi)


def in_range(x: Column, low: float | None, high: float | None) -> Column:
    """Whether a number is within inclusive bounds; NaN and null are not."""
    tests = [x.isNotNull(), ~F.isnan(x.cast("double"))]
    tests += [x >= low] if low is not None else []
    tests += [x <= high] if high is not None else []
    return reduce(lambda a, b: a & b, tests)


def one_hot(code: Column, size: int) -> Column:
    """Array of ``size`` zeros with a one at ``code``."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == code).cast("int"))


def arg_max(values: Column) -> Column:
    """Place of the largest element, the first of equals, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def name_of(code: Column, names: dict[int, str], other: str = "unknown") -> Column:
    """Name of a code."""
    return reduce(lambda rest, k: F.when(code == k, names[k]).otherwise(rest), names, F.lit(other))


def edge_bin(x: Column, edges: list[float]) -> Column:
    """Bin of ``x`` between ascending edges, from 0; the last edge belongs to the last bin; null outside."""
    inside = reduce(lambda n, e: n + (x >= e).cast("int"), edges, F.lit(0)) - 1
    last = len(edges) - 2
    return F.when((x >= edges[0]) & (x <= edges[-1]), F.least(inside, F.lit(last))).cast("int")


def clamped_bin(x: Column, edges: list[float]) -> Column:
    """Bin of ``x`` between ascending edges, from 0; numbers outside go to the first or last bin."""
    inside = reduce(lambda n, e: n + (x >= e).cast("int"), edges, F.lit(0)) - 1
    return F.greatest(F.lit(0), F.least(inside, F.lit(len(edges) - 2))).cast("int")


def cylinder_crossing(curvature: Column, phi0: Column, radius: Column) -> Column:
    """Azimuth at which a helix from the origin crosses a cylinder; null where it turns back before."""
    half = radius * curvature / 2
    return F.when(F.abs(half) <= 1, wrap_angle(phi0 - F.asin(half)))


def hashed_uniform(key: Column, stream: str) -> Column:
    """Even number in (0, 1] made from a key by MD5: the same on any engine and partitioning."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(stream)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 1) / F.lit(float(1 << 32))


def hashed_normal(key: Column, stream: str) -> Column:
    """Normal number made from a key, by two even ones."""
    radius = F.sqrt(-2 * F.ln(hashed_uniform(key, f"{stream}/r")))
    return radius * F.cos(2 * F.pi() * hashed_uniform(key, f"{stream}/a"))


def other_convention(df: DataFrame, names: dict[str, str], flipped: list[str] | None = None) -> DataFrame:
    """Columns under the names of another convention (old: new; two may change places), the ``flipped`` new ones negated."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    renamed = {c: names.get(c, c) for c in df.columns}
    if len(set(renamed.values())) < len(renamed):
        raise ValueError("two columns would have one name")
    return df.select(*[(-F.col(c) if n in (flipped or []) else F.col(c)).alias(n) for c, n in renamed.items()])
