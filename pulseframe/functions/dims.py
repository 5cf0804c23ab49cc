"""Scalar expressions: cleaning, names, groups, tasks, conditions, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sensor names after norm_key() -> canonical muscle.
SENSOR_ALIASES = {
    "bicbrachii": "Biceps", "biceps": "Biceps", "bicipite": "Biceps",
    "tricbrachii": "Triceps", "triceps": "Triceps", "tricipite": "Triceps",
    "deltmed": "Deltoid", "deltoid": "Deltoid", "deltoide": "Deltoid",
    "trap": "Trapezius", "trapdesc": "Trapezius", "trap desc": "Trapezius", "trapezio": "Trapezius", "trapezius": "Trapezius",
    "extcarprad": "Extensor", "extensor": "Extensor", "estensore carpo": "Extensor", "estensore": "Extensor", "ext": "Extensor",
    "flexcarprad": "Flexor", "flexor": "Flexor", "flessore carpo": "Flexor", "flessore": "Flexor", "flex": "Flexor",
    "abduttore v": "AbdV", "abdv": "AbdV", "abdvfing": "AbdV", "abd": "AbdV", "abd5": "AbdV", "abd 5 dito": "AbdV",
    "intdors": "IntDors", "interdors": "IntDors", "inter dors": "IntDors", "primo inter dors": "IntDors", "interv": "IntDors",
}

#: The vocabulary of the subject matrix: muscles of the arm alone.
MATRIX_ALIASES = {k: v for k, v in SENSOR_ALIASES.items() if v not in ("AbdV", "IntDors") and k not in ("ext", "flex", "trap desc")}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x: Column | str) -> Column:
    """NaN and infinities as NULL, so that aggregates skip them."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def zero_filled(x: Column | str) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def to_number(x: Column | str) -> Column:
    return finite(col(x).try_cast("double"))


def norm_key(s: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(col(s), "[_-]", " "), r"\s+", " ")))


def canon_name(s: Column | str, aliases: dict[str, str] = SENSOR_ALIASES, spaced_default: bool = False) -> Column:
    """Canonical name; unknown names stay, trimmed (with separators as spaces if spaced_default)."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    raw = F.regexp_replace(col(s), "[_-]", " ") if spaced_default else col(s)
    return F.coalesce(F.try_element_at(table, norm_key(s)), F.regexp_replace(F.trim(raw), r"\s+", " "))


def safe_token(s: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(col(s)), r"\s+", "_"), "[^A-Za-z0-9_]", ""), "_+", "_")


def group_of(s: Column | str) -> Column:
    x = F.lower(col(s))
    return F.when(x.contains("als"), "ALS").when(x.contains("healthy"), "Healthy")


def group_of_wide(s: Column | str) -> Column:
    """Group by synonyms; 'Unknown' otherwise."""
    x = F.lower(F.trim(col(s)))
    return F.when(x.rlike("als|patient|sick|disease"), "ALS").when(x.rlike("healthy|control|hc|normal"), "Healthy").otherwise("Unknown")


def label_of(s: Column | str) -> Column:
    return F.when(group_of(s) == "ALS", 1.0).when(group_of(s) == "Healthy", 0.0)


def task_of(trial: Column | str) -> Column:
    x = F.lower(col(trial))
    return F.when(x.contains("drink"), "drinking").when(x.contains("lift"), "lifting").when(x.contains("pick"), "pick_place").otherwise("other")


def condition_of(trial: Column | str) -> Column:
    """noexo is tested first, since it contains exo."""
    x = F.lower(col(trial))
    return F.when(x.contains("noexo"), "noexo").when(x.contains("exo"), "exo").otherwise("unknown")


def first_key_in(text: Column | str, keys: list[str]) -> Column:
    """First of the keys that the text contains."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.lower(col(text)).contains(k), k).otherwise(out)
    return out


def magnitude(*axes: Column | str) -> Column:
    return F.sqrt(sum((col(a) * col(a) for a in axes[1:]), col(axes[0]) * col(axes[0])))


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def percent_change(before: Column | str, after: Column | str) -> Column:
    return F.try_divide(col(after) - col(before), col(before)) * 100


def log_ratio(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def status(ok: Column, warn: Column) -> Column:
    """OK, WARN or FAIL; unknown is FAIL."""
    return F.when(F.coalesce(ok, F.lit(False)), "OK").when(F.coalesce(warn, F.lit(False)), "WARN").otherwise("FAIL")


def effect_label(r: Column | str) -> Column:
    r = F.abs(col(r))
    return F.when(r >= 0.5, "large").when(r >= 0.3, "medium").otherwise("small")


def shape_label(skew: Column | str, kurt: Column | str) -> Column:
    """Class of the absolute skewness, and whether excess kurtosis is over 3."""
    s = F.abs(col(skew))
    kind = F.when(s < 0.5, "Approximately symmetric").when(s < 1, "Mildly skewed").when(s < 2, "Moderately skewed").otherwise("Heavily skewed")
    return F.concat(kind, F.when(col(kurt) > 3, " + heavy tails").otherwise(""))


def ok_fail(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "OK").otherwise("FAIL")


def ok_warn_fail(x: Column, ok: float, warn: float) -> Column:
    """Status of a share where larger is better."""
    return status(x >= ok, x >= warn)


def ape_status(ape: Column, ok: float = 0.05, warn: float = 0.2) -> Column:
    """Status of a relative error."""
    return status(ape <= ok, ape <= warn)


def near_share(x: Column, target: float, tol: float) -> Column:
    """Aggregate: share of values within tol + 1e-5 * |target| of target."""
    return F.avg((F.abs(x - target) <= tol + 1e-5 * abs(target)).cast("double"))


def median_ape(observed: Column | str, expected: Column | str) -> Column:
    """Aggregate: median absolute relative error over positive expectations."""
    o, e = col(observed), col(expected)
    return F.median(F.when(e > 0, F.abs(o - e) / e))
