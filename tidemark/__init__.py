"""Sales analytics and forecasting on Spark: every operator maps DataFrames to DataFrames."""

from tidemark.spec import SalesSpec

__all__ = ["SalesSpec"]
