"""Settings of a discovery run and of delimited sources."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Nulls(Enum):
    """What a null in a key means."""

    SUBSET = "subset"  #: rows with a null component don't count
    EQUALITY = "equality"  #: null is one ordinary value
    FOREIGN = "foreign"  #: as SUBSET, and a referenced side may not have any
    INEQUALITY = "inequality"  #: as SUBSET, and each such row of the dependent side is a violation


class Duplicates(Enum):
    AWARE = "aware"  #: count rows
    UNAWARE = "unaware"  #: count distinct keys


@dataclass(frozen=True)
class DiscoveryConfig:
    """threshold: least share of the dependent side that must be contained; max_nary: largest number
    of columns (None: as many as there are); null_string: the text that stands for null."""

    threshold: float = 1.0
    max_nary: int | None = None
    nulls: Nulls = Nulls.SUBSET
    duplicates: Duplicates = Duplicates.AWARE
    null_string: str = ""
    name: str = "discovery"

    def __post_init__(self):
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError(f"threshold {self.threshold} is not between 0 and 1")
        if self.max_nary is not None and self.max_nary < 1:
            raise ValueError("max_nary must be positive")


@dataclass(frozen=True)
class Dialect:
    """How a delimited file is read.  multi_line: quoted values may hold line breaks; without it a large
    file is read by many tasks."""

    separator: str = ","
    quote: str = '"'
    escape: str = "\\"
    header: bool = True
    ending: str = ".csv"
    null_string: str = ""
    skip_ragged: bool = True
    ignore_leading_space: bool = True
    header_prefix: str = "column"
    multi_line: bool = True
