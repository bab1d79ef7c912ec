"""Discovery of exact and partial inclusion dependencies on Spark DataFrames."""

from .config import DiscoveryConfig, Duplicates, Nulls
from .plans.discover import Discovery, discover

__all__ = ["Discovery", "DiscoveryConfig", "Duplicates", "Nulls", "discover"]
