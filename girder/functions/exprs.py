"""Column expressions shared by every plan.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation and pushes down where Catalyst allows it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- dates -----------------------------------------------------------------


def month_start(month: ColumnLike) -> Column:
    """First day of a ``YYYY-MM`` month string."""
    return F.to_date(F.concat(as_col(month), F.lit("-01")))


def month_key(day: ColumnLike) -> Column:
    """``YYYY-MM`` string of a date."""
    return F.date_format(as_col(day), "yyyy-MM")


def first_of_month(day: ColumnLike) -> Column:
    return F.trunc(as_col(day), "month")


def month_diff(end: ColumnLike, start: ColumnLike) -> Column:
    """Calendar months between two dates, ignoring the day of month."""
    end, start = as_col(end), as_col(start)
    return (
        (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    ).cast("long")


def month_span(end: ColumnLike, start: ColumnLike) -> Column:
    """Length in average months (30.44 days)."""
    return F.datediff(as_col(end), as_col(start)) / F.lit(30.44)


def parse_dates(df: DataFrame, cols: Sequence[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    return df.withColumns({c: F.to_date(F.col(c), fmt) for c in cols})


def fiscal_year(day: ColumnLike, first_month: int = 4) -> Column:
    """Year in which the fiscal year of ``day`` started."""
    day = as_col(day)
    return (F.year(day) - (F.month(day) < first_month).cast("int")).cast("int")


# --- arithmetic ------------------------------------------------------------


def safe_div(a: ColumnLike, b: ColumnLike) -> Column:
    """Quotient, NULL when the denominator is zero or either side is NULL."""
    return F.try_divide(as_col(a), as_col(b))


def div_or_one(a: ColumnLike, b: ColumnLike, only_zero: bool = False) -> Column:
    """Quotient with a denominator of 1 in place of a non-positive one.

    ``only_zero`` replaces exactly zero and leaves negative denominators alone.
    """
    a, b = as_col(a), as_col(b)
    if only_zero:
        return a / F.when(b == 0, F.lit(1)).otherwise(b)
    return a / F.when(b > 0, b).otherwise(F.lit(1))


def pct(a: ColumnLike, b: ColumnLike, digits: int | None = 1) -> Column:
    """``a`` as a percentage of ``b``; unrounded when ``digits`` is None."""
    ratio = safe_div(a, b) * 100
    return ratio if digits is None else F.round(ratio, digits)


def to_int(x: ColumnLike) -> Column:
    """Nearest integer, halves away from zero (a bare Spark cast truncates)."""
    return F.round(as_col(x)).cast("long")


def exact_avg(x: ColumnLike) -> Column:
    """Mean of an integer column from its exact integer sum."""
    x = as_col(x)
    return safe_div(F.sum(x), F.count(x))


def clip_scale(x: ColumnLike, low: float, high: float, factor: float = 1.0) -> Column:
    """Clip to [low, high] and scale; NULL stays NULL."""
    x = as_col(x)
    clipped = F.greatest(F.lit(low), F.least(x, F.lit(high)))
    return F.when(x.isNotNull(), clipped * factor)


def finite_or_zero(x: ColumnLike) -> Column:
    """0 in place of NULL, NaN and the infinities."""
    x = as_col(x).cast("double")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(odd, F.lit(0.0)).otherwise(x)


def thousand_to_million(x: ColumnLike) -> Column:
    return as_col(x) / 1000


def zero(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c), F.lit(0))


def zero_fill(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: zero(c) for c in cols})


def first_known(*cols: ColumnLike) -> Column:
    """First non-NULL of the columns, e.g. the actual amount else the expected one."""
    return F.coalesce(*[as_col(c) for c in cols])


# --- labels ----------------------------------------------------------------

Rule = tuple[str | tuple[str, ...], str]


def label_by_rules(text: ColumnLike, rules: Sequence[Rule], default: str) -> Column:
    """Label of the first rule whose pattern occurs in ``text``.

    A rule is (substring or tuple of alternative substrings, label). Order
    matters: the first hit wins. NULL text takes the default.
    """
    text = as_col(text)
    chain = F
    for patterns, label in rules:
        alternatives = (patterns,) if isinstance(patterns, str) else patterns
        hit = F.lit(False)
        for p in alternatives:
            hit = hit | text.contains(p)
        chain = chain.when(hit, F.lit(label))
    return chain.otherwise(F.lit(default))


def band(
    value: ColumnLike,
    steps: Sequence[tuple[ColumnLike | float, str]],
    default: str,
    above: bool = True,
) -> Column:
    """Label of the first step that ``value`` reaches.

    ``above`` compares with >=, otherwise with <. NULL takes the default.
    """
    value = as_col(value)
    chain = F
    for limit, label in steps:
        limit = limit if isinstance(limit, Column) else F.lit(limit)
        chain = chain.when(value >= limit if above else value < limit, F.lit(label))
    return chain.otherwise(F.lit(default))


def cost_risk_level(rate: ColumnLike, target: ColumnLike) -> Column:
    """Overrun band of an unrounded cost rate relative to the target rate."""
    target = as_col(target)
    return band(
        rate,
        [(target + 5, "緊急"), (target, "警告"), (target * 0.95, "注意")],
        default="正常",
    )


def cashflow_risk(net: ColumnLike, shortage: float = -50000) -> Column:
    return band(net, [(shortage, "資金不足リスク"), (0, "注意")], default="正常", above=False)


def shortfall_flag(balance: ColumnLike) -> Column:
    return F.when(as_col(balance) < 0, F.lit(1)).otherwise(F.lit(0))


def gap_zone(gap: ColumnLike) -> Column:
    return band(gap, [(5, "緊急"), (0, "警告")], default="正常")


# Risk levels as they are shown, from high to low.
SCORE_LEVELS = ("🔴 高リスク", "🟠 中リスク", "🟢 低リスク")


def score_level(score: ColumnLike, labels: Sequence[str] = SCORE_LEVELS) -> Column:
    high, middle, low = labels
    return band(score, [(75, high), (40, middle)], default=low)


# Standard cost shares of a contract's budget.
STANDARD_SHARES = {"外注費": 0.45, "材料費": 0.25, "労務費": 0.20, "経費": 0.10}


def category_budget(
    contract: ColumnLike,
    target_rate: ColumnLike,
    category: ColumnLike,
    shares: Mapping[str, float] = STANDARD_SHARES,
) -> Column:
    """Standard budget of a cost category; 0 for a category without a share."""
    base = as_col(contract) * as_col(target_rate) / 100
    chain = F
    for name, share in shares.items():
        chain = chain.when(as_col(category) == name, base * share)
    return chain.otherwise(F.lit(0.0))


# --- conditional aggregates ------------------------------------------------


def sum_where(cond: Column, value: ColumnLike) -> Column:
    return F.sum(F.when(cond, as_col(value)).otherwise(F.lit(0)))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def hash_number(key: ColumnLike, seed: int = 42) -> Column:
    """Seeded, engine-independent number in [0, 2^32) from the md5 of the key."""
    digest = F.md5(F.concat(as_col(key).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_bucket(key: ColumnLike, buckets: int, seed: int = 42) -> Column:
    """Seeded, engine-independent bucket in [0, buckets)."""
    return F.pmod(hash_number(key, seed), F.lit(buckets)).cast("int")
