"""Dialects of well-known corpora.  Tables are those named here or else all files with the ending."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import Dialect
from .tables import list_folder, read_delimited


@dataclass(frozen=True)
class Preset:
    dialect: Dialect = Dialect()
    tables: tuple[str, ...] | None = None


TPCH = ("customer", "lineitem", "nation", "orders", "part", "partsupp", "region", "supplier")

#: The tables of corpora that name them.
ANIMAL_CROSSING = (
    "accessories", "achievements", "art", "bags", "bottoms", "construction", "dress-up", "fencing", "fish", "floors", "fossils", "headwear", "housewares", "insects", "miscellaneous",
    "music", "other", "photos", "posters", "reactions", "recipes", "rugs", "shoes", "socks", "tools", "tops", "umbrellas", "villagers", "wall-mounted", "wallpaper",
)
POPULATION = ("midyear_population_age_country_code",)
CARS = ("audi", "bmw", "cclass", "focus", "ford", "hyundi", "merc", "skoda", "toyota", "unclean cclass", "unclean focus", "vauxhall", "vw")
DATA_GOV = (
    "Air_Quality", "Air_Traffic_Passenger_Statistics", "Crash_Reporting_-_Drivers_Data", "Crime_Data_from_2020_to_Present", "diabetes_all_2016", "Electric_Vehicle_Population_Data",
    "iou_zipcodes_2020", "Lottery_Mega_Millions_Winning_Numbers__Beginning_2002", "Lottery_Powerball_Winning_Numbers__Beginning_2010", "Motor_Vehicle_Collisions_-_Crashes",
    "National_Obesity_By_State", "NCHS_-_Death_rates_and_life_expectancy_at_birth", "Popular_Baby_Names", "Real_Estate_Sales_2001-2020_GL", "Traffic_Crashes_-_Crashes", "Warehouse_and_Retail_Sales",
)

#: Names, separators, headers, endings and null strings of the corpora.
PRESETS = {
    "ANIMAL_CROSSING": Preset(tables=ANIMAL_CROSSING),
    "TPCH_1": Preset(Dialect(separator="|", header=False, ending=".tbl"), TPCH),
    "TPCH_10": Preset(Dialect(separator="|", header=False, ending=".tbl"), TPCH),
    "POPULATION": Preset(tables=POPULATION),
    "DATA_GOV": Preset(tables=DATA_GOV),
    "CARS": Preset(tables=CARS),
    "MUSICBRAINZ": Preset(Dialect(separator="\t", header=False, ending="", quote="\0", null_string="\\N")),
    "ENSEMBL_UNIPROT": Preset(Dialect(separator="\t", ending=".111.uniprot.tsv")),
    "EU": Preset(),
    "T2D": Preset(),
    "TESMA": Preset(tables=("main", "extern_info")),
    "WEB_TABLES": Preset(tables=tuple(map(str, range(5000)))),
}


def read_preset(spark: SparkSession, name: str, folder: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """tables: names to read instead of the preset's own list, or of all files where it has none."""
    preset = PRESETS[name]
    ending, named = preset.dialect.ending, tables or preset.tables
    if named:
        paths = {t: f"{folder.rstrip('/')}/{t}{ending}" for t in named}
    else:
        files = [p.rpartition("/")[2] for p in list_folder(spark, folder).values()]
        paths = {f[: len(f) - len(ending)]: f"{folder.rstrip('/')}/{f}" for f in files if f.endswith(ending)}
    return {t: read_delimited(spark, p, preset.dialect) for t, p in paths.items()}
