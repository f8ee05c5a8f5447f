"""Scalar column expressions; all of them stay in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grade weights, severity levels and their order.
GRADE_WEIGHTS = {"A": 4, "B": 2, "C": 1}
SEVERITY_LEVELS = ("normal", "caution", "risk", "high_risk")
SEVERITY_THRESHOLDS = (7, 10, 11, 12, 13, 14)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_number(date: str | Column) -> Column:
    """Days since 1970-01-01: the numeric order key of every calendar frame."""
    return F.unix_date(col(date))


def ratio(num: str | Column, den: str | Column, default: float | None = None) -> Column:
    """Division that yields ``default`` (NULL unless given) for a zero denominator."""
    out = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def tolerant_date(text: str | Column) -> Column:
    """First ten characters as a date, NULL when they are none."""
    return F.try_to_date(F.substring(col(text).cast("string"), 1, 10), "yyyy-MM-dd")


def calendar_columns(date: str | Column) -> dict[str, Column]:
    """Day of week (Monday is 0) and the month on a circle."""
    angle = F.month(col(date)) * F.lit(2.0 * pi / 12.0)
    return {
        "day_of_week": F.weekday(col(date)),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }


def grade_weight(grade: str | Column, weights: Mapping[str, int] = GRADE_WEIGHTS) -> Column:
    clean = F.upper(F.trim(col(grade)))
    out = F.lit(None).cast("int")
    for name, weight in weights.items():
        out = F.when(clean == name, F.lit(weight)).otherwise(out)
    return out


def severity_level(score: str | Column, threshold: int = 12) -> Column:
    """0 / 1-5 / 6-(t-1) / rest. Fractions between two bands belong to the top level."""
    if isinstance(threshold, bool) or not isinstance(threshold, int) or threshold < 7:
        raise ValueError("threshold must be an integer of at least 7")
    s = col(score)
    return (
        F.when(s == 0, F.lit("normal"))
        .when(s.between(1, 5), F.lit("caution"))
        .when(s.between(6, threshold - 1), F.lit("risk"))
        .when(s.isNotNull(), F.lit("high_risk"))
    )


def severity_code(level: str | Column) -> Column:
    out = F.lit(None).cast("int")
    for code, name in enumerate(SEVERITY_LEVELS):
        out = F.when(col(level) == name, F.lit(code)).otherwise(out)
    return out


def _bands(value: Column, cuts: Sequence[tuple[Column, str]], rest: str) -> Column:
    out = F.lit(rest)
    for condition, name in reversed(cuts):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def observed_severity(score: str | Column) -> Column:
    """Level of an observed score: 0, up to 5, up to 11, above."""
    s = col(score)
    return _bands(s, [(s <= 0, "normal"), (s <= 5, "caution"), (s <= 11, "risk")], "high_risk")


def predicted_severity(score: str | Column) -> Column:
    """Level of a predicted score, cut at the half points between the observed bands."""
    s = F.greatest(col(score), F.lit(0.0))
    return _bands(col(score), [(s < 0.5, "normal"), (s < 5.5, "caution"), (s < 11.5, "risk")], "high_risk")


def interaction_columns(t1: str, t2: str, v1: str, v2: str, load: str) -> dict[str, Column]:
    """Gap of two temperatures, magnitude of two vibrations and two products."""
    magnitude = F.hypot(F.col(v1), F.col(v2))
    return {
        "temp_gap": F.col(t1) - F.col(t2),
        "vibration_magnitude": magnitude,
        "temp_vibration_product": F.col(t1) * magnitude,
        "temp_load_product": F.col(t2) * F.col(load),
    }


def out_of_range(value: str | Column, lower: str | Column, upper: str | Column) -> Column:
    return (col(value) < col(lower)) | (col(value) > col(upper))


def first_reason(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Exclusive reason code: the first condition that holds names the row."""
    out = F.lit(otherwise)
    for condition, name in reversed(cases):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def nullable_prediction(score: str | Column, cutoff: str | Column) -> Column:
    """0/1 at the cutoff, NULL when the policy offers no cutoff."""
    return F.when(col(cutoff).isNotNull(), (col(score) >= col(cutoff)).cast("int"))


def abs_z_summary(z: Sequence[str], hot: Sequence[str] = (), shaking: Sequence[str] = ()) -> dict[str, Column]:
    """Row summary of absolute robust z: max, NULL-skipping mean, counts at 2 and 3, joint flag."""
    mags = [F.abs(F.col(c)) for c in z]
    present = F.filter(F.array(*mags), lambda x: x.isNotNull())
    size = F.size(present)
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)

    def reached(cols: Sequence[str], cut: float) -> Column:
        out = F.lit(False)
        for c in cols:
            out = out | F.coalesce(F.abs(F.col(c)) >= cut, F.lit(False))
        return out

    def tally(cut: float) -> Column:
        out = F.lit(0)
        for m in mags:
            out = out + F.coalesce((m >= cut).cast("int"), F.lit(0))
        return out

    return {
        "max_abs_z": F.array_max(present),
        "mean_abs_z": ratio(total, size),
        "count_abs_z_ge_2": tally(2.0),
        "count_abs_z_ge_3": tally(3.0),
        "temp_vibration_joint": (reached(hot, 2.0) & reached(shaking, 2.0)).cast("int"),
    }


# Verdict limits.
VERDICT_MIN_LIFT, VERDICT_ASSIST_PRECISION, VERDICT_OPERATE = 1.2, 0.5, 0.8


def operational_verdict(lift: str | Column, precision: str | Column, recall: str | Column) -> Column:
    lift, precision, recall = col(lift), col(precision), col(recall)
    return (
        F.when(lift < VERDICT_MIN_LIFT, "unusable")
        .when((precision >= VERDICT_OPERATE) & (recall >= VERDICT_OPERATE), "operational_review")
        .when(precision >= VERDICT_ASSIST_PRECISION, "inspection_aid")
        .otherwise("exploratory")
    )


def candidate_status(n: str | Column, diff_pp: str | Column, ci_low: str | Column) -> Column:
    """Strength of a part-measure relation from its size, difference and interval."""
    n, diff, low = col(n), col(diff_pp), col(ci_low)
    return (
        F.when(n < 10, "small_sample")
        .when(diff <= -5, "reverse")
        .when((low > 0) & (diff >= 15), "strong")
        .when(diff >= 5, "weak")
        .otherwise("none")
    )


def undefined_notes(rows: str | Column, positives: str | Column, predicted: str | Column) -> Column:
    """Why a metric has no meaning; empty when all have."""
    rows, pos, pred = col(rows), col(positives), col(predicted)
    return F.concat_ws(
        "; ",
        F.when(pred == 0, "no predicted positives: precision undefined"),
        F.when(pos == 0, "no actual positives: recall undefined"),
        F.when(pos == rows, "no actual negatives: pr_auc undefined"),
        F.when((pos == 0) | (pos == rows), "single class: pr_auc undefined"),
    )


def rate_change(now: str | Column, before: str | Column) -> Column:
    """Difference of two displayed percentages (rounded to one digit before subtracting)."""
    return F.round(F.round(col(now), 1) - F.round(col(before), 1), 1)


def display(value: str | Column, kind: str, labels: Mapping[str, str] | None = None, blank: str = "no work") -> Column:
    """Text shown for a cell of the given kind."""
    c = col(value)
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind in ("int", "int_comma"):
        return F.format_number(c.cast("double"), 0)
    if kind in ("float1", "float2"):
        return F.regexp_replace(F.format_number(c.cast("double"), int(kind[-1])), ",", "")
    if kind == "category":
        return F.coalesce(c.cast("string"), F.lit(blank))
    if kind == "label":
        out = c.cast("string")
        for name, label in (labels or {}).items():
            out = F.when(c == name, F.lit(label)).otherwise(out)
        return out
    if kind == "text":
        return c.cast("string")
    raise ValueError(f"unknown display kind: {kind}")


def feature_group(feature: str | Column, health: Sequence[str], operating: Sequence[str]) -> Column:
    """health / operating / other by name prefix; calendar flags count as operating."""
    f = col(feature)

    def any_prefix(prefixes: Sequence[str]) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | f.startswith(p)
        return out

    return (
        F.when(any_prefix(health), "health")
        .when(any_prefix(operating) | f.isin("day_of_week", "is_weekend"), "operating")
        .otherwise("other")
    )


def add(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns))
