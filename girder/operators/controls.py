"""Page filters and role-dependent views of a result.

``secure_view`` masks a table for a role. ``role_page`` gives a role its part of
a page of sums: rows in detail where it may see them, totals per group where it
may only see those, and the grand total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_controls(
    df: DataFrame,
    between: tuple[str, Any, Any] | None = None,
    **chosen: Any,
) -> DataFrame:
    """Date-range and drop-down filters. A list selects any of its values, None all."""
    if between:
        col, low, high = between
        if low is not None:
            df = df.filter(F.col(col) >= F.lit(low))
        if high is not None:
            df = df.filter(F.col(col) <= F.lit(high))
    for col, value in chosen.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            df = df.filter(F.col(col).isin(list(value)))
        else:
            df = df.filter(F.col(col) == F.lit(value))
    return df


@dataclass(frozen=True)
class Access:
    """What a role may see of a table: rows by scope columns, and masked columns."""

    row_scope: tuple[str, ...] = ()
    masked: tuple[str, ...] = ()
    denied: bool = False


# Who sees which part of the project table. "own division" and
# "own projects" restrict the rows; a summary role has the details masked.
DETAIL_COLUMNS = (
    "outsourcing_cost_kpy",
    "material_cost_kpy",
    "labor_cost_kpy",
    "expense_cost_kpy",
    "outsourcing_ratio",
    "material_ratio",
    "labor_ratio",
    "expense_ratio",
)
PROJECT_ACCESS = {
    "経営陣": Access(),
    "経営企画": Access(),
    "事業部長": Access(row_scope=("division",)),
    "DX推進室": Access(masked=DETAIL_COLUMNS),
    "現場監督": Access(row_scope=("pm_name",), masked=DETAIL_COLUMNS),
}


def secure_view(
    df: DataFrame,
    role: str,
    scope: dict[str, Sequence[str]] | None = None,
    matrix: dict[str, Access] = PROJECT_ACCESS,
) -> DataFrame:
    """Rows and columns of ``df`` open to ``role``; an unknown role sees no row."""
    access = matrix.get(role, Access(denied=True))
    if access.denied:
        return df.filter(F.lit(False))
    for col in access.row_scope:
        df = df.filter(F.col(col).isin(list((scope or {}).get(col, ()))))
    hidden = [c for c in access.masked if c in df.columns]
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hidden})


DETAIL, SUMMARY, NOTHING = "detail", "summary", "nothing"


@dataclass(frozen=True)
class Grant:
    """What a role sees of a page: of its own scope, of the rest, and whether of the company as a whole.

    ``scope`` is the column that tells the own rows; without it all are own.
    """

    own: str = DETAIL
    rest: str = DETAIL
    company: bool = True
    scope: str | None = None


COMPANY_PAGE, PROFIT_PAGE, AREA_PAGE, PROGRAM_PAGE, RISK_PAGE, ENTRY_PAGE = "全社サマリー", "事業部損益", "まちづくりROI", "DXエコ", "AI予測", "データ入力"
_ALL, _TOTALS = Grant(), Grant(SUMMARY, SUMMARY)
_OWN_DIVISION = Grant(DETAIL, SUMMARY, scope="division")
_OWN_RISKS = Grant(DETAIL, NOTHING, company=False, scope="division")
_OWN_SITES = Grant(SUMMARY, NOTHING, company=False, scope="pm_name")
_MANAGEMENT = {page: _ALL for page in (COMPANY_PAGE, PROFIT_PAGE, AREA_PAGE, PROGRAM_PAGE, RISK_PAGE)}

# Which role sees which page, and how much of it. A page that is
# not listed is closed; only site managers enter data.
PAGE_GRANTS: Mapping[str, Mapping[str, Grant]] = {
    "経営陣": _MANAGEMENT,
    "経営企画": _MANAGEMENT,
    "事業部長": {COMPANY_PAGE: _ALL, PROFIT_PAGE: _OWN_DIVISION, AREA_PAGE: _ALL, PROGRAM_PAGE: _TOTALS, RISK_PAGE: _OWN_RISKS},
    "DX推進室": {COMPANY_PAGE: _ALL, PROFIT_PAGE: _TOTALS, AREA_PAGE: _ALL, PROGRAM_PAGE: _ALL, RISK_PAGE: _ALL},
    "現場監督": {PROFIT_PAGE: _OWN_SITES, RISK_PAGE: _OWN_SITES, ENTRY_PAGE: _ALL},
}


def grant_of(role: str, page: str, grants: Mapping[str, Mapping[str, Grant]] = PAGE_GRANTS) -> Grant | None:
    """The role's grant on a page; None if the page, or the role, is unknown or closed."""
    return grants.get(role, {}).get(page)


def role_page(
    df: DataFrame,
    role: str,
    page: str,
    group: str,
    key: str,
    measures: Sequence[str],
    scope: Mapping[str, Sequence[str]] | None = None,
    grants: Mapping[str, Mapping[str, Grant]] = PAGE_GRANTS,
) -> DataFrame:
    """(level, group, key, row_count, measures): what ``role`` sees of a page.

    One ``rollup`` makes the rows in detail, the totals of each group and the
    grand total; its grouping id tells them apart, also where a group or a key
    is NULL. A group that holds own and other rows has a total of each. Rows
    without a scope value are not own. Where only own rows are open, others are
    left out before the rollup.
    """
    grant = grant_of(role, page, grants)
    own = F.lit(True)
    if grant and grant.scope:
        own = F.coalesce(F.col(grant.scope).isin(list((scope or {}).get(grant.scope, ()))), F.lit(False))
    rows = df.select(own.alias("_own"), F.col(group).alias("_group"), F.col(key).alias("_key"), *measures)
    if grant is None:
        rows = rows.filter(F.lit(False))
    elif grant.rest == NOTHING and not grant.company:
        rows = rows.filter("_own")
    rolled = rows.rollup("_own", "_group", "_key").agg(
        F.grouping_id().alias("_level"), F.count("*").alias("row_count"), *[F.sum(m).alias(m) for m in measures]
    )
    grant = grant or Grant(NOTHING, NOTHING, company=False)
    seen = F.when(F.col("_own"), F.lit(grant.own)).otherwise(F.lit(grant.rest))
    # Grouping ids: 0 a key, 1 a group, 3 own or other rows, 7 everything.
    level = F.when(F.col("_level") == 0, "detail").when(F.col("_level") == 1, "group").when(F.col("_level") == 7, "company")
    open_ = (
        F.when(F.col("_level") == 0, seen == DETAIL).when(F.col("_level") == 1, seen != NOTHING).otherwise((F.col("_level") == 7) & F.lit(grant.company))
    )
    # An empty table has a grand total too, of no rows.
    shown = rolled.withColumn("level", level).filter(open_ & (F.col("row_count") > 0))
    return shown.select("level", F.col("_group").alias(group), F.col("_key").alias(key), "row_count", *measures)
