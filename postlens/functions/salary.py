"""Free-text pay to a monthly range, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.fixed import PAY_AMOUNT, PAY_PERIODS, PAY_WITHOUT_FIGURE
from postlens.functions.staging import pin
from postlens.functions.text import is_blank


def _contains_any(col: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(col, F.lit(word))
    return found


def pay_amounts(col: Column) -> Column:
    """All amounts in the text as an array of doubles; 'k' directly after an amount means thousands."""
    hits = F.regexp_extract_all(F.lower(col), F.lit(PAY_AMOUNT), F.lit(0))
    return F.transform(
        hits,
        lambda m: F.regexp_replace(m, "[^0-9.]", "").cast("double") * F.when(F.contains(m, F.lit("k")), 1000.0).otherwise(1.0),
    )


def pay_period(col: Column, strict: bool = False) -> Column:
    """hourly / daily / yearly / monthly by substring, monthly by default.

    ``strict`` asks for whole words, so that "base pay" or "company" no longer reads as a yearly figure.
    """
    text = F.lower(col)
    period = F.lit("monthly")
    for name, marks, _ in reversed(PAY_PERIODS):
        if strict:
            pattern = "|".join(f"\\Q{m}\\E" for m in marks)
            hit = text.rlike(f"(?U)(?<![\\p{{L}}])(?:{pattern})s?(?![\\p{{L}}])")
        else:
            hit = _contains_any(text, marks)
        period = F.when(hit, name).otherwise(period)
    return period


def to_monthly(value: Column, period: Column) -> Column:
    factor = F.lit(1.0)
    for name, _, per_month in PAY_PERIODS:
        factor = F.when(period == name, per_month).otherwise(factor)
    return value * factor


def with_salary(
    df: DataFrame,
    col: str,
    keep_open_ranges: bool = False,
    strict_period: bool = False,
    prefix: str = "",
) -> DataFrame:
    """Add min_raw, max_raw, period, min_monthly, max_monthly and currency read from a pay text.

    "up to X" and "from X" lose both bounds, as does text without a figure; ``keep_open_ranges`` keeps
    the one bound they name. Each step is its own projection, so that the amounts are extracted once.
    """
    text = F.lower(F.col(col))
    usable = ~is_blank(F.col(col)) & ~_contains_any(text, PAY_WITHOUT_FIGURE)
    amounts = F.col("_amounts")
    up_to = text.rlike("(?U)\\bup to\\b")
    starting = text.rlike("(?U)\\bfrom\\b") & (F.size(amounts) == 1)
    low, high, period = F.col("_low"), F.col("_high"), F.col(f"{prefix}period")
    kept = (low.isNotNull() | high.isNotNull()) if keep_open_ranges else (low.isNotNull() & high.isNotNull())
    return (
        pin(df, _amounts=F.when(usable, pay_amounts(F.col(col))))
        .withColumns(
            {
                "_low": F.when(~up_to, F.try_element_at(amounts, F.lit(1))),
                "_high": F.when(up_to | ~starting, F.try_element_at(amounts, F.lit(-1))),
            }
        )
        .withColumns(
            {
                f"{prefix}min_raw": F.when(kept, low),
                f"{prefix}max_raw": F.when(kept, high),
                f"{prefix}period": F.when(kept, pay_period(F.col(col), strict_period)).otherwise(""),
            }
        )
        .withColumns(
            {
                f"{prefix}min_monthly": to_monthly(F.col(f"{prefix}min_raw"), period),
                f"{prefix}max_monthly": to_monthly(F.col(f"{prefix}max_raw"), period),
                f"{prefix}currency": F.lit("SGD"),
            }
        )
        .drop("_amounts", "_low", "_high")
    )
