"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is zero."""
    return F.when(b != 0, a / b)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def round_binary(x: Column, places: int) -> Column:
    """Rounding as DuckDB and numpy do it: the product with a power of ten is rounded, halves away from zero.

    Spark's own rounding takes the decimal digits instead, so that 999.65 / 1000, a little under 0.99965, goes down.
    """
    power = F.lit(10.0**places)
    return F.round(x * power) / power


def neuron_key(i: Column, j: Column) -> Column:
    return F.concat_ws("_", i, j)


def key_parts(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, "_")
    return parts[0].cast("int"), parts[1].cast("int")


def to_double(text: Column, default: float | None = None) -> Column:
    """Tolerant number: null, empty or malformed text gives *default*."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default).cast("double"))


def int_list(text: Column) -> Column:
    """A list written in a string, such as "[10, 10]"; null if it is none."""
    return F.from_json(text, "array<int>")


def gene_uid(genes: dict[str, Column], skip: tuple[str, ...] = ("uid",)) -> Column:
    """MD5 of the sorted gene items; metadata keys are left out."""
    items = [F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("null"))) for k, c in sorted(genes.items()) if k not in skip]
    return F.md5(F.concat_ws(";", *items))


def verdict(value: Column, passing: float, warning: float) -> Column:
    """PASS at or above *passing*, WARN at or above *warning*, else FAIL; null is SKIP."""
    return F.when(value.isNull(), "SKIP").when(value >= passing, "PASS").when(value >= warning, "WARN").otherwise("FAIL")


def log_interpolate(x: Column, anchors: list[tuple[float, float]]) -> Column:
    """Log-log interpolation between sorted anchors, clamped at both ends, to two places."""
    out = F.lit(float(anchors[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:], strict=False))):
        t = (F.log(x) - F.log(F.lit(float(x0)))) / (F.log(F.lit(float(x1))) - F.log(F.lit(float(x0))))
        out = F.when(x <= x1, F.lit(float(y0)) * F.pow(F.lit(y1 / y0), t)).otherwise(out)
    return F.round(F.when(x <= anchors[0][0], F.lit(float(anchors[0][1]))).otherwise(out), 2)


def decay(step: Column, total: int, start: float, end: float, kind: str, growth: float = 10.0) -> Column:
    """Value of a schedule at *step* of *total*; with one step or fewer it is *start*.

    A growth of zero makes exponential and logarithmic curves linear, and the step
    width is at least one.
    """
    first, span = F.lit(float(start)), end - start
    if total <= 1 or kind == "static":
        return first
    if kind in ("linear-drop", "linear-growth"):
        return first + step / float(total - 1) * span
    if kind == "step-down":
        stage = F.least(F.floor(step / max(1, total // 10)), F.lit(9))
        return F.greatest(F.lit(float(end)), first * F.pow(F.lit(0.7), stage))
    g = F.lit(float(growth))
    if kind in ("exp-drop", "exp-growth", "log-drop", "log-growth") and growth == 0:
        return first + step / float(total) * span
    if kind == "exp-drop":
        return first + (1 - F.exp(-g * step / float(total))) / (1 - F.exp(-g)) * span
    if kind == "exp-growth":
        return first + (F.exp(g * step / float(total)) - 1) / (F.exp(g) - 1) * span
    if kind in ("log-drop", "log-growth"):
        return first + F.ln(g * step + 1) / F.ln(g * float(total) + 1) * span
    raise ValueError(f"unknown schedule {kind!r}")
