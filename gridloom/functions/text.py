"""Names, labels and dimensions hidden in file names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), "_", " ")


def underscored(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit("_"))


def scientific_name(label: Column) -> Column:
    """Text inside the first parentheses, else the whole label."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"\(([^)]+)\)", 1), F.lit("")), label)


def parse_layer_name(path: Column) -> dict[str, Column]:
    """species + date of ``<code>_abundance_median_<yyyy-MM-dd>.tif``; NULL when it does not match."""
    pattern = r"([^/]+)_abundance_median_(\d{4}-\d{2}-\d{2})\.tif$"
    code = F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    date = F.nullif(F.regexp_extract(path, pattern, 2), F.lit(""))
    return {"species": code, "date": F.try_to_date(date)}


def parse_month_name(path: Column) -> dict[str, Column]:
    """variable + year + month of ``<var>_<yyyyMM>.<ext>``."""
    pattern = r"([a-z]+)_(\d{4})(\d{2})\.[a-z]+$"
    return {
        "var": F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")),
        "year": F.nullif(F.regexp_extract(path, pattern, 2), F.lit("")).try_cast("int"),
        "month": F.nullif(F.regexp_extract(path, pattern, 3), F.lit("")).try_cast("int"),
    }


def parse_band_name(path: Column) -> dict[str, Column]:
    """name + year + band of ``<name>_<yyyy>_band<n>.<ext>``."""
    pattern = r"([A-Za-z]\w*)_(\d{4})_band(\d+)\.[a-z]+$"
    return {
        "name": F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")),
        "year": F.nullif(F.regexp_extract(path, pattern, 2), F.lit("")).try_cast("int"),
        "band": F.nullif(F.regexp_extract(path, pattern, 3), F.lit("")).try_cast("int"),
    }


def parse_kernel_label(label: Column) -> dict[str, Column]:
    """direction and distance bin of ``to_DIR_lo-hi``."""
    return {
        "direction": F.split_part(label, F.lit("_"), F.lit(2)),
        "dist_bin": F.split_part(label, F.lit("_"), F.lit(3)),
    }
