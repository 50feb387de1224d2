"""Brand and competitor listening over large mention tables, on Spark DataFrames."""

from earshot.settings import tune

__all__ = ["tune"]
