"""Where relations come from."""

from .tables import from_folder, from_parquet, read_delimited
from .presets import PRESETS, read_preset

__all__ = ["PRESETS", "from_folder", "from_parquet", "read_delimited", "read_preset"]
