"""Column roles of a sales table and the checks made before any operator runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Role names and the "no category" choice that uploaded tables use.
NO_CATEGORY = "Aucune"
DEFAULT_CATEGORY = "Produit"
OPTIONAL_ROLES = {"region_col": "Region", "promo_col": "Promo", "stock_col": "Stock"}
PROMO_YES = "Oui"
PROMO_NO = "Non"


@dataclass(frozen=True)
class SalesSpec:
    """Roles of the columns of a table.

    ``order_by`` lists the tie-breakers that make ``(date_col, *order_by)`` a total order;
    operators that depend on row order need it to give the same answer on every run.
    """

    date_col: str
    target_col: str
    cat_col: str | None = None
    order_by: tuple[str, ...] = ()
    region_col: str | None = None
    promo_col: str | None = None
    stock_col: str | None = None

    def __post_init__(self):
        if self.cat_col == NO_CATEGORY:
            object.__setattr__(self, "cat_col", None)

    @property
    def order(self) -> list[str]:
        return [self.date_col, *self.order_by]

    @property
    def columns(self) -> list[str]:
        roles = [self.date_col, self.target_col, self.cat_col, self.region_col, self.promo_col, self.stock_col]
        return list(dict.fromkeys(c for c in [*roles, *self.order_by] if c))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of any numeric type, in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def detect_roles(df: DataFrame, date_col: str | None = None, target_col: str | None = None) -> SalesSpec:
    """Default roles: first column is the date, first numeric column the target, optional roles by name."""
    numeric = [c for c in numeric_columns(df) if c != date_col]
    if not df.columns or not numeric:
        raise ValueError("a sales table needs a date column and a numeric target column")
    date_col = date_col or df.columns[0]
    target_col = target_col or next((c for c in numeric if c != date_col), numeric[0])
    optional = {role: name for role, name in OPTIONAL_ROLES.items() if name in df.columns}
    cat_col = DEFAULT_CATEGORY if DEFAULT_CATEGORY in df.columns else None
    return SalesSpec(date_col, target_col, cat_col, **optional)


def check_table(df: DataFrame, spec: SalesSpec | None = None) -> DataFrame:
    """Return ``df`` unchanged, or raise when it cannot be analysed."""
    if len(df.columns) <= 1:
        raise ValueError("the table has one column or none; check the separator")
    if spec is not None:
        missing = [c for c in spec.columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {missing}; the table has {df.columns}")
        # A text target is accepted, since preparation coerces it; a date or nested one is not.
        kind = df.schema[spec.target_col].dataType
        if not isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)):
            raise ValueError(f"target column {spec.target_col!r} is not numeric")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df
