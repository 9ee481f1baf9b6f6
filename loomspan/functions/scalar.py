"""Column functions: transforms, angles, palettes, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ash(x: Column) -> Column:
    """asinh by its odd symmetry, exact for large negatives."""
    return F.signum(x) * F.asinh(F.abs(x))


def log_1(x: Column) -> Column:
    return F.log1p(x)


def boxcox(x: Column, power: float) -> Column:
    return (F.signum(x) * F.pow(F.abs(x), F.lit(power)) - 1) / power


def logit(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))


def to_xy(phase: Column, amplitude: Column) -> tuple[Column, Column]:
    return amplitude * F.cos(F.radians(phase)), amplitude * F.sin(F.radians(phase))


def degrees_of(re: Column, im: Column) -> Column:
    """-atan2 in degrees, in (0, 360]."""
    a = F.degrees(-F.atan2(im, re))
    return F.when(a <= 0, a + 360).otherwise(a)


def palette_index(x: Column, low: float, high: float, n: int) -> Column:
    """1..n, values outside go to the ends."""
    return F.greatest(F.lit(1), F.least(F.lit(n), F.width_bucket(x, F.lit(low), F.lit(high), F.lit(n)).cast("int")))


def clipped(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def file_name(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9._-]", "_")


def short_number(x: Column) -> Column:
    """1321 -> 1.3k: two digits over 1000."""
    e = F.floor(F.log10(x / 1000.0)) - 1
    two = F.round(x / 1000.0 / F.pow(F.lit(10.0), e)) * F.pow(F.lit(10.0), e)
    return F.when(x > 1000, F.concat(F.regexp_replace(F.round(two, 3).cast("string"), r"\.0$", ""), F.lit("k"))).otherwise(x.cast("string"))


def p_display(p: Column, sign: Column, least: float = 1e-10) -> Column:
    """Signed -log2 of p, capped."""
    return -F.log2(F.greatest(p, F.lit(least))) * sign


def alpha_colour(colour: Column, alpha: Column) -> Column:
    """#RRGGBB with an opacity of 0..1 as #RRGGBBAA."""
    return F.concat(F.substring(colour, 1, 7), F.lpad(F.hex(F.round(alpha * 255).cast("int")), 2, "0"))
