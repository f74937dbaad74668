"""Display strings of cell values, on the driver and as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: float) -> str:
    """Shortest digits that give x back; exponents from 1E+15 and below 0.0001, as in 1E+15 and 1E-05."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    digits, _, exponent = repr(x).lower().partition("e")
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    bare = (whole + part).lstrip("0")
    point -= len(whole + part) - len(bare)
    bare = bare.rstrip("0")
    if not bare:
        return sign + "0"
    power = point - 1
    if -5 < power < 15:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{bare}"
        return sign + bare[:point].ljust(point, "0") + ("." + bare[point:] if len(bare) > point else "")
    return f"{sign}{bare[0]}{'.' * (len(bare) > 1)}{bare[1:]}E{'+' if power > 0 else '-'}{abs(power):02d}"


def number_column(x: Column) -> Column:
    """The same in Spark, from the digits of Spark's own shortest form."""
    plain = F.regexp_replace(F.format_string("%.0f", x), "^-0$", "0")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    shortest = x.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(shortest, r"^-?([0-9.]+?)(\.0)?(E|$)", 1), r"\.", "")
    power = F.coalesce(F.try_to_number(F.regexp_extract(shortest, r"E(-?[0-9]+)$", 1), F.lit("S9999")).cast("int"), F.lit(0))
    small = F.abs(x) < 1e-4
    sign = F.when(x < 0, "-").otherwise("")
    zeros = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), mantissa)
    digits = F.concat(F.substring(mantissa, 1, 1), F.when(F.length(mantissa) > 1, F.lit(".")).otherwise(""), F.substring(mantissa, 2, 400))
    scientific = F.concat(sign, digits, F.when(power < 0, "E-").otherwise("E+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    large = F.abs(x) >= 1e15
    return (
        F.when(F.isnan(x) | (F.abs(x) == float("inf")), shortest)
        .when(x == 0, "0")
        .when(whole, plain)
        .when(shortest.contains("E") & ~large & ~small, F.when(power < 0, zeros).otherwise(F.regexp_replace(F.format_string("%.15f", x), r"\.?0+$", "")))
        .when(shortest.contains("E") & (large | small), scientific)
        .otherwise(shortest)
    )


def date_column(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd")
