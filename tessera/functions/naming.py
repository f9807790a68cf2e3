"""Scalar rules of file names, digit widths, intervals and colours, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of indexed frame names.
FRAME_NAME = r"(?i)^(mask|t|man_track|man_seg)(\d+)\.tiff?$"
#: Fixed value: hue step between consecutive labels.
GOLDEN = 0.618033988749895


def natural_key(name: Column) -> Column:
    """Sort key: digit runs compare as numbers, other parts lower-cased [O-36, O-116].

    Digit runs are stripped of leading zeros and preceded by their length, so that plain string
    order of the parts is numeric order.
    """
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(
        parts,
        lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(F.regexp_replace(p, "^0+(?=.)", "")).cast("string"), 6, "0"), F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(F.concat(F.lit("1"), F.lower(p))),
    )


def normalise_sequence(seq: Column) -> Column:
    """All-digit sequence names padded to two digits [O-36]."""
    return F.when(seq.rlike(r"^\d+$"), F.lpad(seq.cast("int").cast("string"), F.greatest(F.lit(2), F.length(seq.cast("int").cast("string"))), F.lit("0"))).otherwise(seq)


def digits_of(name: Column) -> Column:
    """Digit width of an indexed frame name, null for other names [§1.5]."""
    d = F.regexp_extract(name, FRAME_NAME, 2)
    return F.when(d != "", F.length(d))


def minimum_digits(frames: int) -> int:
    """At least three digits, enough for the last frame's index [§1.5]."""
    if frames < 0:
        raise ValueError("a frame count can't be negative")
    return max(3, len(str(max(frames - 1, 0))))


def resolve_digits(names: Iterable[str], frames: int, wanted: str = "auto") -> int:
    """Output width: given, or the inferred width if all names agree on one, but never too narrow [§1.5]."""
    import re

    needed = minimum_digits(frames)
    if wanted != "auto":
        if frames > 10 ** int(wanted):
            raise ValueError(f"{frames} frames don't fit {wanted} digits")
        return int(wanted)
    found = {len(m[1]) for n in names if (m := re.match(r"^[^\d]*?(\d+)[^\d]*\.\w+$", n))}
    return max(needed, found.pop()) if len(found) == 1 else needed


def frame_name(prefix: str, frame: Column, digits: int) -> Column:
    """prefix + zero-padded index + .tif [O-36]."""
    text = frame.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0")), F.lit(".tif"))


def focus_bounds(frame: Column, last: Column, window: int | None) -> tuple[Column, Column]:
    """View around a frame, the whole sequence without a window [O-39]."""
    if window is None:
        return F.lit(0), last
    return F.greatest(F.lit(0), frame - window), F.least(last, frame + window)


def interpolated_index(frame: Column, cycles: int) -> Column:
    """Frame i of the input stands at i * 2**cycles of the output [O-42]."""
    return F.shiftleft(frame.cast("long"), cycles)


def interpolated_count(frames: Column, cycles: int) -> Column:
    """(n - 1) * 2**cycles + 1 frames [O-42]."""
    return F.shiftleft((frames - 1).cast("long"), cycles) + 1


def cycles_for_factor(factor: int) -> int:
    """log2 of a power of two; other factors are errors [O-42]."""
    if factor < 1 or factor & (factor - 1):
        raise ValueError(f"{factor} is not a power of two")
    return int(math.log2(factor))


def to_unit(value: Column, high: float) -> Column:
    """Image value to [0, 1]: NaN to 0, infinities and overshoot clipped [O-43]."""
    v = F.when(F.isnan(value), F.lit(0.0)).otherwise(value / high)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def from_unit(value: Column, high: float) -> Column:
    """[0, 1] back to the integer range, rounding half to even [O-43, O-44]."""
    return F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) * high)


def three_channels(channels: list[Column]) -> list[Column]:
    """The first three channels of an image; a single one counts for all three [O-09, O-43]."""
    return channels * 3 if len(channels) == 1 else channels[:3]


def grey(channels: list[Column]) -> Column:
    """Mean of the channels, each from 0 to 1 [O-43]."""
    total = channels[0]
    for c in channels[1:]:
        total = total + c
    return total / len(channels)


def scaled_size(size: Column, scale: float) -> Column:
    """max(1, round(size * scale)), half to even [O-45]."""
    return F.greatest(F.lit(1), F.rint(size * scale).cast("int"))


def track_color(label: Column) -> tuple[Column, Column, Column]:
    """RGB of a track: hue label * 0.618… mod 1, saturation .85, value 1 [O-46]."""
    h6 = F.pmod(label * GOLDEN, F.lit(1.0)) * 6
    i, f = F.floor(h6), h6 - F.floor(h6)
    p, q, t = F.lit(1 - 0.85), 1 - 0.85 * f, 1 - 0.85 * (1 - f)
    v = F.lit(1.0)
    table = ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))

    def channel(c: int) -> Column:
        out = table[5][c]
        for k in range(4, -1, -1):
            out = F.when(i == k, table[k][c]).otherwise(out)
        return out

    return channel(0), channel(1), channel(2)


def short_number(value: Column) -> Column:
    """'%.12g' of a number: twelve significant digits without closing zeros, in exponent form below 1e-4 and from 1e12 on [O-37, Q25].

    Null stays null; nan, inf and -inf read so; a zero keeps its sign. Subnormal numbers have fewer digits here.
    """
    v = value.cast("double")
    said = F.format_string("%.11e", v)  # d.ddddddddddde±dd: rounded to twelve digits, so the exponent is the final one
    sign = F.when(said.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.replace(F.replace(F.substring_index(said, "e", 1), F.lit(".")), F.lit("-"))
    power = F.substring_index(said, "e", -1).try_cast("int")

    def joined(whole: Column, rest: Column) -> Column:
        rest = F.rtrim(rest, F.lit("0"))
        return F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))

    scientific = F.concat(joined(F.substring(digits, 1, 1), F.substring(digits, 2, 11)), F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    above = joined(F.substring(digits, F.lit(1), power + 1), F.substring(digits, power + 2, F.lit(12)))
    below = joined(F.lit("0"), F.concat(F.repeat(F.lit("0"), -power - 1), digits))
    text = F.concat(sign, F.when((power < -4) | (power >= 12), scientific).when(power >= 0, above).otherwise(below))
    return F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").when(v.isNotNull(), text)


def fixed_number(value: Column, digits: int) -> Column:
    """Fixed decimals, halves rounded to even [O-37, Q13]."""
    return F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))
