"""Scalar feature expressions (survey 2H).

All are Catalyst expressions: they run inside whole-stage codegen, no Python.
Zero denominators give null (``try_divide``), never an exception or inf.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordinal map of the three education levels
# (Bachelor's -> 1, Master's -> 2, PhD -> 3); anything else maps to null.
EDUCATION_ORDINAL = {"Bachelor's": 1, "Master's": 2, "PhD": 3}

CAREER_START_AGE = 22  # ratio_velocidad_carrera denominator: age - 22 (18 in the synthetic table)


def literal_map(mapping: dict, key: Column) -> Column:
    """C4/H7: literal map lookup; a miss (or null key) gives null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(key.isNull(), F.lit(None)).otherwise(F.try_element_at(m, key))


def log_experience(x: Column) -> Column:
    """H6: 0 when x == 0, else ln(1 + x); null stays null."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.log(F.lit(1.0) + x))


def engineered(age: Column, exp: Column, edu_num: Column, start_age: float = CAREER_START_AGE) -> dict[str, Column]:
    """H1-H8: the engineered numeric columns, keyed by output name."""
    return {
        "inicio_laboral": age - exp,
        "ratio_experiencia": F.try_divide(exp, age),
        "ratio_velocidad_carrera": F.try_divide(exp, age - F.lit(float(start_age))),
        "experience2": exp * exp,
        "experience3": exp * exp * exp,
        "edad_x_experiencia": age * exp,
        "edad_x_experiencia2": age * (exp * exp),
        "log_experiencia": log_experience(exp),
        "education_numerica": edu_num,
        "educacion_x_experiencia": edu_num * exp,
    }


def null_concat(*cols: Column, sep: str = "_") -> Column:
    """H9: a + sep + b that is null when any part is null (not concat_ws)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(c)
    return F.concat(*parts)


def newline_to_space(c: Column) -> Column:
    """Every newline character becomes one space."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def strip_code_fence(c: Column) -> Column:
    """Strip whitespace (spaces, tabs, newlines -- ``trim`` alone only
    removes spaces), drop a leading ```json / ``` fence and a trailing ```."""
    ws = r"^\s+|\s+$"
    t = F.regexp_replace(c, ws, "")
    t = F.regexp_replace(t, r"^```(json)?", "")
    t = F.regexp_replace(t, r"```$", "")
    return F.regexp_replace(t, ws, "")


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def metric_name_clean(name: Column) -> Column:
    """Strip the neg_ prefix, underscores to spaces, title case."""
    return F.initcap(F.replace(F.regexp_replace(name, "^neg_", ""), F.lit("_"), F.lit(" ")))


def interval_text(value: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    """H20: '0.935 (0.889-0.971)'; '(No IC)' without bounds; 'N/A' without value."""
    fmt = f"%.{digits}f"
    v, l_, h = F.round(value, digits), F.round(lo, digits), F.round(hi, digits)
    return (F.when(value.isNull(), F.lit("N/A"))
            .when(lo.isNull() | hi.isNull(), F.concat(F.format_string(fmt, v), F.lit(" (No IC)")))
            .otherwise(F.format_string(f"{fmt} ({fmt}-{fmt})", v, l_, h)))


def linspace_expr(lo: Column, hi: Column, i: Column, n: int) -> Column:
    """I-th point of linspace(lo, hi, n)."""
    return lo + (hi - lo) * i.cast("double") / F.lit(float(n - 1))


def zero_safe(c: Column) -> Column:
    """Round-trip helper: turn -0.0 into 0.0 (keeps hashes engine-neutral)."""
    return c + F.lit(0.0)


SQRT_2PI = math.sqrt(2 * math.pi)
