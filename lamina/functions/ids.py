"""Names of slides, punches and sections from file names.

Three rules differ on purpose: the split groups by series, cohort analysis by
slide number, batch reports by the leading slide name.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def slide_of_tile(path: Column) -> Column:
    return F.regexp_replace(stem(path), r"_\d+_\d+$", "")


def punch_of_tile(path: Column) -> Column:
    base = F.regexp_replace(slide_of_tile(path), r"_\d+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(base, r"\d+$", ""), F.lit("")), base)


def punch_of_section(section: Column) -> Column:
    sample = F.trim(F.regexp_extract(section, r"^(.+)_sample_(\d+)$", 1))
    short = F.regexp_extract(sample, r"^([A-Za-z]+\d+)", 1)
    serial = F.regexp_extract(section, r"^(.+?)_(\d+)$", 1)
    return (
        F.when(section.rlike(r"^(.+)_sample_(\d+)$"), F.when(short != "", short).otherwise(sample))
        .when(serial != "", serial)
        .otherwise(section)
    )


def slide_of_file(filename: Column) -> Column:
    base = stem(filename)
    lead = F.regexp_extract(base, r"^([A-Za-z]+\d+)_\d+", 1)
    parts = F.split(base, "_")
    return (
        F.when(lead != "", lead)
        .when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "_"))
        .otherwise(base)
    )
