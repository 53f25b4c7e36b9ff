"""Value classes, thresholds and scalar formulas, as column expressions (all inside whole-stage code generation)."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_class(value: Column, edges: Sequence[float]) -> Column:
    """0 up to and including edges[0], 1 up to edges[1] ... len(edges) above all; null stays null. Upper edges are inclusive."""
    out = F.when(value <= edges[0], 0)
    for i, e in enumerate(edges[1:], 1):
        out = out.when(value <= e, i)
    return out.when(value.isNotNull(), len(edges))


def open_lower_classes(value: Column, lowest: Column, uppers: Sequence[float]) -> Column:
    """Class i + 1 if the previous bound < value <= uppers[i]; the first bound is the data's minimum, so the minimum itself is 0."""
    out = F.lit(0)
    for i in reversed(range(len(uppers))):
        low = lowest if i == 0 else F.lit(uppers[i - 1])
        out = F.when((value > low) & (value <= uppers[i]), i + 1).otherwise(out)
    return out


def half_open_classes(value: Column, thresholds: Sequence[float]) -> Column:
    """Class i if thresholds[i - 1] <= value < thresholds[i] (0 below the first, and from the last on the number of thresholds)."""
    out = F.when(value < thresholds[0], 0)
    for i, t in enumerate(thresholds[1:], 1):
        out = out.when(value < t, i)
    return out.when(value.isNotNull(), len(thresholds))


def first_match(name: Column, patterns: dict[str, str], other: str = "other") -> Column:
    """The key of the first pattern found in ``name``, whatever its case."""
    out = None
    for phase, p in patterns.items():
        hit = name.rlike(f"(?i){p}")
        out = F.when(hit, phase) if out is None else out.when(hit, phase)
    return out.otherwise(other)


_FUNCTIONS = {"sin", "cos", "tan", "arcsin", "arccos", "arctan", "sqrt", "log", "log10", "exp", "abs", "floor", "ceil", "where"}
_SPARK = {"arcsin": "asin", "arccos": "acos", "arctan": "atan", "where": "if"}


def formula(text: str, variables: dict[str, str]) -> Column:
    """A formula over named columns as one expression: + - * / ** comparisons & | ~ ( ) numbers and the listed functions.

    ``variables`` maps the names used in the formula to columns, which enter as
    doubles. Anything else in the text is refused, so it can't reach SQL.
    """
    tokens = re.findall(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|\{[^}]+\}|\*\*|<=|>=|==|!=|[-+*/()<>,&|~])", text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"formula has unknown signs: {text}")
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (want and tokens[at] != want):
            raise ValueError(f"formula breaks off at {peek()!r}: {text}")
        at += 1
        return tokens[at - 1]

    def binary(lower, signs: dict[str, str]):
        def parse() -> str:
            left = lower()
            while peek() in signs:
                left = f"({left} {signs[take()]} {lower()})"
            return left

        return parse

    def atom() -> str:
        t = take()
        if t == "(":
            inner = either()
            take(")")
            return f"({inner})"
        if t == "-":
            return f"(-{power()})"
        if t == "~":
            return f"(NOT {power()})"
        if re.match(r"\d", t):
            return f"cast({t} AS double)"
        if t in _FUNCTIONS and peek() == "(":
            take("(")
            args = [either()]
            while peek() == ",":
                take()
                args.append(either())
            take(")")
            return f"{_SPARK.get(t, 'ln' if t == 'log' else t)}({', '.join(args)})"
        name = t.strip("{}")
        if name not in variables:
            raise ValueError(f"formula names no known column: {name}")
        return f"cast(`{variables[name]}` AS double)"

    def power() -> str:
        base = atom()
        return f"power({base}, {(take(), power())[1]})" if peek() == "**" else base

    product = binary(power, {"*": "*", "/": "/"})
    total = binary(product, {"+": "+", "-": "-"})
    compare = binary(total, {"<": "<", ">": ">", "<=": "<=", ">=": ">=", "==": "=", "!=": "<>"})
    both = binary(compare, {"&": "AND"})
    either = binary(both, {"|": "OR"})
    out = either()
    if at < len(tokens):
        raise ValueError(f"formula goes on at {peek()!r}: {text}")
    return F.expr(f"cast({out} AS double)")


def column_formula(text: str, columns: Sequence[str]) -> Column:
    """A formula whose variables A, B ... Z are the columns by position."""
    return formula(text, {chr(65 + i): c for i, c in enumerate(columns[:26])})


#: Millimetres in each unit of length.
MILLIMETRES = {"mm": 1.0, "millimeter": 1.0, "cm": 10.0, "centimeter": 10.0, "m": 1000.0, "meter": 1000.0, "km": 1e6, "um": 1e-3, "micrometer": 1e-3, "in": 25.4, "inch": 25.4, "ft": 304.8, "foot": 304.8}


def millimetres(unit: str) -> float:
    """The factor from ``unit`` to millimetres; what isn't a length is an error."""
    try:
        return MILLIMETRES[unit.strip().lower().rstrip("s") or unit]
    except KeyError:
        raise ValueError(f"not a unit of length: {unit!r}") from None


def capillary_radius(pressure: Column, tension: float = 0.48, angle: float = 140.0) -> Column:
    """Radius from capillary pressure (and back: the formula is its own inverse)."""
    return F.lit(2 * tension * abs(math.cos(math.radians(angle)))) / pressure


def timur_coates(phi: Column, a: float, b: float, c: float) -> Column:
    return F.when(phi > c, F.lit(a) * F.pow(phi - c, F.lit(b))).otherwise(0.0)


def line(x: Column, slope: float, intercept: float) -> Column:
    return x * slope + intercept


def conductivity(radius: Column, shape: Column) -> Column:
    """Of a duct with area r^2 / (4 G): triangle up to 0.048, square up to 0.07, else circle."""
    area = radius * radius / (4 * shape)
    return F.when(shape <= 0.048, 0.6 * area * area * shape).when(shape <= 0.07, 0.5623 * area * area * shape).otherwise(area * radius * radius / 8)


def series(*parts: tuple[Column, Column]) -> Column:
    """Conductance of lengths and conductivities in a row."""
    return 1 / sum((length / k for length, k in parts[1:]), parts[0][0] / parts[0][1])


def fractional_flow(krw: Column, kro: Column, water_viscosity: float, oil_viscosity: float) -> Column:
    return 1 / (1 + water_viscosity * kro / (oil_viscosity * krw))


def corrected_saturation(sw: Column, volume: Column) -> Column:
    return sw * (1 - volume) + volume


#: Square centimetres in millidarcy.
DARCY = 1.01325e11


def darcy_permeability(flow: Column, viscosity: float, length: float, area: float, pressure: float) -> Column:
    """Millidarcy, from consistent centimetre-gram-second inputs."""
    return flow * F.lit(viscosity * length / (area * pressure) * DARCY)


def affine(matrix: Sequence[Sequence[float]], x: Column, y: Column, z: Column) -> list[Column]:
    """A 4 x 4 matrix on points."""
    return [F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2]) * z + F.lit(r[3]) for r in matrix[:3]]


def half_circle_degrees(radians: Column) -> Column:
    """Degrees, plus 180 for negative angles; between 90 and 270 (exclusive) turned by half a circle."""
    d = F.degrees(radians) + F.when(radians < 0, 180.0).otherwise(0.0)
    return F.when((d > 90) & (d < 270), F.pmod(d + 180, F.lit(360.0))).otherwise(d)


def below_plane(x: Column, y: Column, z: Column, point: Sequence[float], normal: Sequence[float]) -> Column:
    return (x - point[0]) * normal[0] + (y - point[1]) * normal[1] + (z - point[2]) * normal[2] < 0


def ellipse_area(a: Column, b: Column) -> Column:
    return math.pi * a * b


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.2125 * r + 0.7154 * g + 0.0721 * b


def hex_rgb(text: Column) -> Column:
    """Red, green and blue of #rrggbb, each from 0 to 1."""
    return F.array(*[F.conv(F.substring(F.regexp_replace(text, "^#", ""), 1 + 2 * i, 2), 16, 10).cast("double") / 255 for i in range(3)])


def depth_of_folder(path: Column) -> Column:
    """The depth in a folder name: two or more digits and an optional two-digit fraction; the last that occurs."""
    found = F.regexp_extract_all(path, F.lit(r"([0-9]{2,}(?:[.,;_-][0-9]{2}m?)?)"), F.lit(1))
    return F.regexp_replace(F.regexp_replace(F.try_element_at(found, F.lit(-1)), "m$", ""), "[,;_-]", ".").cast("double")


def clean_name(name: Column) -> Column:
    """A name with anything but letters, digits and underscores replaced, and no digit first."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_]+", "_"), r"^(?=[0-9])", "_")


def same_or_contains(a: Column, b: Column) -> Column:
    return (a == b) | a.contains(b) | b.contains(a)


def local_number(text: Column) -> Column:
    """A number as text with decimal comma and thousands points (1.234,5), or a plain one; null where it is neither."""
    plain = F.when(text.contains(","), F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".")).otherwise(text)
    return plain.try_cast("double")


def rescale(value: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    return (value - low) / (high - low) * (to_high - to_low) + to_low


def ramp_porosity(value: Column, low: Column, high: Column) -> Column:
    """1 at ``low`` and under, 0 at ``high`` and over, linear between; a step where both are equal (1 up to it)."""
    step = F.when(value <= low, 1.0).otherwise(0.0)
    return F.when(high == low, step).otherwise(F.least(F.greatest(F.try_divide(high - value, high - low), F.lit(0.0)), F.lit(1.0)))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees (0 for gray), saturation and value, both 0 to 1, of channels from 0 to 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(top - low, F.lit(0))
    sector = F.when(top == r, F.pmod((g - b) / span, F.lit(6))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.coalesce(sector * 60, F.lit(0.0)), F.coalesce(span / top, F.lit(0.0)), top / 255.0


def in_sphere(point: Sequence[Column], centre: Sequence[float], radius: float) -> Column:
    """Whether a point lies inside or on a sphere."""
    return sum((p - c) * (p - c) for p, c in zip(point, centre, strict=True)) <= radius * radius


def nominal_headers(names: Sequence[str], depth: str) -> dict[str, str]:
    """Names of a table of nominal depths to their plain forms."""
    return {n: "n depth (m)" if (flat := n.replace("\n", "")) == depth else re.sub("[Cc]ondicao", "cond", re.sub("[Dd]escida|[Cc]orrida", "desc", flat)) for n in names}


def prefixed(names: Sequence[str], prefix: str) -> dict[str, str]:
    """Columns that start with a prefix and something behind it up to white space, to that."""
    return {n: m[1] for n in names if (m := re.match(re.escape(prefix) + r"(\S+)", n))}
