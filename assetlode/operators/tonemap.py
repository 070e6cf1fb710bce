"""Tone mapping of linear HDR colours as column expressions; nothing leaves the JVM.

Each operator takes and gives a triple of columns. What it uses more than once it
names with ``Steps.let``, so that each value is computed once, in a projection of
its own, and plans stay as long as the formulas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Color = tuple[Column, Column, Column]

# SMPTE ST 2084.
PQ_N, PQ_M = 2610.0 / 4096.0 / 4.0, 2523.0 / 4096.0 * 128.0
PQ_C1, PQ_C2, PQ_C3 = 3424.0 / 4096.0, 2413.0 / 4096.0 * 32.0, 2392.0 / 4096.0 * 32.0
PQ_PEAK = 10000.0

# Colour matrices, by rows.
TO_2020 = ((0.627404, 0.329282, 0.0433136), (0.069097, 0.91954, 0.0113612), (0.0163916, 0.0880132, 0.895595))
TO_709 = ((1.660491, -0.587641, -0.0728499), (-0.12455, 1.1329, -0.0083494), (-0.0181508, -0.100579, 1.11873))
TO_LMS = ((0.412109, 0.523926, 0.063965), (0.166748, 0.720459, 0.112793), (0.024170, 0.075439, 0.900391))
TO_ICTCP = ((0.5, 0.5, 0.0), (1.6137, -3.3234, 1.7097), (4.3780, -4.2455, -0.1325))
FROM_ICTCP = ((1.0, 0.008605, 0.111036), (1.0, -0.008605, -0.111036), (1.0, 0.560049, -0.320637))
FROM_LMS = ((3.43661, -2.50645, 0.069845), (-0.79133, 1.9836, -0.192271), (-0.02595, -0.098914, 1.12486))


class Steps:
    """A relation that grows by named values."""

    def __init__(self, df: DataFrame):
        self.df, self.count = df, 0

    def let(self, *values: Column) -> Color:
        names = [f"__step{self.count + k}" for k in range(len(values))]
        self.count += len(values)
        self.df = self.df.withColumns(dict(zip(names, values)))
        return tuple(F.col(n) for n in names)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def apply(matrix: tuple, c: Color) -> Color:
    return tuple(c[0] * row[0] + c[1] * row[1] + c[2] * row[2] for row in matrix)


def luma(c: Color) -> Column:
    return c[0] * 0.2126 + c[1] * 0.7152 + c[2] * 0.0722


def smoothstep(steps: Steps, low: float, high: float, x: Column) -> Column:
    (t,) = steps.let(clamp((x - low) / (high - low)))
    return t * t * (F.lit(3.0) - t * 2.0)


def oetf(x: Column) -> Column:
    """The sRGB transfer function of a value from 0 to 1."""
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)


def to_pq(steps: Steps, *nits: Column) -> Color:
    powers = steps.let(*[F.pow(F.abs(v / PQ_PEAK), F.lit(PQ_N)) for v in nits])
    return steps.let(*[F.pow(F.abs((y * PQ_C2 + PQ_C1) / (y * PQ_C3 + 1.0)), F.lit(PQ_M)) for y in powers])


def from_pq(steps: Steps, *values: Column) -> Color:
    roots = steps.let(*[F.pow(F.abs(v), F.lit(1 / PQ_M)) for v in values])
    return steps.let(*[F.pow(F.abs(F.greatest(y - PQ_C1, F.lit(0.0)) / (F.lit(PQ_C2) - y * PQ_C3)), F.lit(1 / PQ_N)) * PQ_PEAK for y in roots])


def to_ictcp(steps: Steps, c: Color) -> Color:
    lms = apply(TO_LMS, steps.let(*apply(TO_2020, steps.let(*c))))
    return steps.let(*apply(TO_ICTCP, to_pq(steps, *[F.greatest(v, F.lit(0.0)) for v in lms])))


def from_ictcp(steps: Steps, c: Color) -> Color:
    """Linear colours, 1 at 100 nits."""
    lms = from_pq(steps, *apply(FROM_ICTCP, steps.let(*c)))
    return tuple(x / 100.0 for x in apply(TO_709, steps.let(*apply(FROM_LMS, lms))))


# Operators


def none(steps: Steps, c: Color) -> Color:
    return c


def aces(steps: Steps, c: Color) -> Color:
    return tuple((x * (x * 2.51 + 0.03)) / (x * (x * 2.43 + 0.59) + 0.14) for x in steps.let(*c))


def false_color(steps: Steps, c: Color) -> Color:
    (v,) = steps.let(clamp((F.log2(F.greatest(luma(c), F.lit(1e-5))) + 10.0) * 0.071428))
    red = smoothstep(steps, 0.5, 0.8, v) + F.when(v >= 0.9, F.lit(1.0)).otherwise(F.lit(0.0))
    green = smoothstep(steps, 0.2, 0.5, v) - smoothstep(steps, 0.7, 0.9, v)
    return red, green, smoothstep(steps, 0.0, 0.2, v) - smoothstep(steps, 0.4, 0.5, v)


def _toe(steps: Steps, c: Color) -> Color:
    """Colours of at least 0, less the offset of their smallest part."""
    c = steps.let(*[F.greatest(x, F.lit(0.0)) for x in c])
    (x,) = steps.let(F.least(*c))
    (low,) = steps.let(F.when(x < 0.08, x - x * x * 6.25).otherwise(F.lit(0.04)))
    return steps.let(*[v - low for v in c])


def pbr_neutral(steps: Steps, c: Color) -> Color:
    start = 0.8 - 0.04
    c = _toe(steps, c)
    (peak,) = steps.let(F.greatest(*c))
    d = 1.0 - start
    (squeezed,) = steps.let(F.lit(1.0) - F.lit(d * d) / (peak + d - start))
    (mix,) = steps.let(F.lit(1.0) - F.lit(1.0) / ((peak - squeezed) * 0.15 + 1.0))
    return tuple(F.when(peak < start, x).otherwise(x * (squeezed / peak) * (F.lit(1.0) - mix) + squeezed * mix) for x in c)


def aces2(steps: Steps, c: Color) -> Color:
    i, t, p = to_ictcp(steps, tuple(x * 100.0 for x in c))
    (linear,) = steps.let(from_pq(steps, i)[0] / 100.0)
    (f,) = steps.let(F.pow(F.greatest(linear, F.lit(0.0)) / (linear + 0.9078), F.lit(1.15)) * 1.0470)
    (mapped,) = steps.let(F.greatest(f * f / (f + 0.04), F.lit(0.0)))
    (chroma,) = steps.let(clamp(F.lit(1.1) - mapped * F.sqrt(mapped) * 1.1))
    return from_ictcp(steps, (to_pq(steps, mapped * 100.0)[0], t * chroma, p * chroma))


def _pq(nits: float) -> float:
    y = abs(nits / PQ_PEAK) ** PQ_N
    return ((PQ_C1 + PQ_C2 * y) / (1 + PQ_C3 * y)) ** PQ_M


def eetf(i: Column, top_in: float, top_out: float) -> Column:
    """The BT.2390 roll-off."""
    knee = max(0.0, 1.5 * top_out - 0.5 * top_in)
    width = top_in - knee
    if width <= 1e-5:
        return F.least(i, F.lit(top_out))
    t = (i - knee) / width
    bent = (t * t * t * 2.0 - t * t * 3.0 + 1.0) * knee + (t * t * t - t * t * 2.0 + t) * width + (t * t * 3.0 - t * t * t * 2.0) * top_out
    return F.when(i < knee, i).otherwise(bent)


def bt2446c(steps: Steps, c: Color, peak: float = 1000.0) -> Color:
    i, t, p = to_ictcp(steps, tuple(F.greatest(x * 100.0, F.lit(0.0)) for x in c))
    white = _pq(100.0)
    (out,) = steps.let(eetf(i, _pq(peak), white))
    fade = F.lit(1.0) - smoothstep(steps, 0.90, 1.0, clamp(out / white))
    (chroma,) = steps.let(F.when(i > 1e-5, out / i).otherwise(F.lit(1.0)) * 1.15 * fade)
    return from_ictcp(steps, (out, t * chroma, p * chroma))


def lumina(steps: Steps, c: Color, peak: float = 1000.0) -> Color:
    i, t, p = to_ictcp(steps, tuple(F.greatest(x, F.lit(0.0)) * 100.0 for x in _toe(steps, c)))
    white = _pq(100.0)
    (level,) = steps.let(clamp(eetf(i, _pq(peak), white) / white))
    (out,) = steps.let((level + (level - 0.5) * level * (F.lit(1.0) - level) * 0.5) * white)
    fade = F.lit(1.0) / (F.greatest(i - out, F.lit(0.0)) * 0.15 + 1.0)
    (chroma,) = steps.let(F.when(i > 1e-5, out / i).otherwise(F.lit(1.0)) * fade)
    return from_ictcp(steps, (out, t * chroma, p * chroma))


OPERATORS = {"none": none, "false_color": false_color, "aces": aces, "aces2": aces2, "pbr_neutral": pbr_neutral, "bt2446c": bt2446c, "lumina": lumina}


def tonemap(hdr: DataFrame, operator: str, exposure: float = 1.0, **options: float) -> DataFrame:
    """8-bit colours of linear ones; all operators but false colour end in the sRGB curve."""
    steps = Steps(hdr)
    c = steps.let(*[clamp(x) for x in OPERATORS[operator](steps, tuple(F.col(x) * exposure for x in "rgb"), **options)])
    if operator != "false_color":
        c = tuple(oetf(x) for x in c)
    eight = lambda x: F.floor(clamp(x) * 255).cast("bigint")
    return steps.df.select("img", "y", "x", *[eight(v).alias(n) for v, n in zip(c, "rgb")], eight(F.col("a").cast("double")).alias("a"))
