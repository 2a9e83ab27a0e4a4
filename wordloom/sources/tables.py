"""Loaders for metadata, coordinates and media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Markers of a missing value in the input files.
MISSING = ("", "\\N")
UNDEFINED = "__UNDEF__"


def known(column: Column | str) -> Column:
    """NULL for the missing-value markers, else the value."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isin(*MISSING), None).otherwise(column)


def defined(column: Column | str) -> Column:
    """NULL for an undefined token attribute."""
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(UNDEFINED))


def text_table_schema(header: list[str]) -> T.StructType:
    """Schema from header names: ``code$num`` and the position columns are numbers, the rest are strings."""
    fields = []
    for name in header:
        code, _, kind = name.partition("$")
        number = kind.startswith("n") or code in ("startpos", "endpos")
        fields.append(T.StructField(code, T.LongType() if number else T.StringType()))
    return T.StructType(fields)


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1. Metadata file with a header line and tab-separated columns, the first of which is the text id.

    Written texts end in ``startpos, endpos``, speakers in ``bounds``. A value that is no number raises an error.
    """
    header = spark.read.text(path).first()[0].split("\t")
    raw = T.StructType([T.StructField(name, T.StringType()) for name in header])
    return typed_text_table(spark.read.csv(path, sep="\t", header=True, schema=raw, quote="", mode="FAILFAST"))


def typed_text_table(raw: DataFrame) -> DataFrame:
    """The string columns of a metadata file with their types, missing markers as NULL, and the id as ``text_id``."""
    schema = text_table_schema(raw.columns)
    columns = [
        known(F.col(f"`{name}`")).cast(f.dataType).alias("text_id" if k == 0 else f.name)
        for k, (name, f) in enumerate(zip(raw.columns, schema))
    ]
    return raw.select(*columns)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7. Headerless tab-separated file of place, latitude and longitude."""
    return spark.read.csv(path, sep="\t", schema="place string, lat double, lng double", quote="", mode="FAILFAST")


def parse_bounds(speakers: DataFrame, speaker: str = "text_id", bounds: str = "bounds") -> DataFrame:
    """SRC-6. ``bounds`` such as ``0-4:10-32:34-34`` to rows (speaker, start, end), ends inclusive.

    Speakers with blank bounds give no row; a part that is no number raises an error.
    """
    parts = speakers.where(F.trim(bounds) != "").select(
        F.col(speaker).alias("text_id"), F.explode(F.split(bounds, ":")).alias("_range")
    )
    return parts.select(
        "text_id",
        F.split("_range", "-")[0].cast("bigint").alias("start"),
        F.split("_range", "-")[1].cast("bigint").alias("end"),
    )


def media_manifest(files: DataFrame, path: str = "path") -> DataFrame:
    """SRC-8. File list to one row per recording: ``av_file, has_audio, has_video, silent_player``.

    The folder and the ending are taken off the name. A file ``_.mp3`` means that the player may be opened for every
    recording although there is no sound; it is no recording itself, and sets ``silent_player`` in its own row.
    """
    name = F.regexp_replace(path, "^.*/", "")
    listed = files.select(name.alias("_name")).where(F.col("_name").rlike(r"\.mp[34]$"))
    return listed.groupBy(F.regexp_replace("_name", r"\.mp[34]$", "").alias("av_file")).agg(
        F.max(F.col("_name").endswith(".mp3")).alias("has_audio"),
        F.max(F.col("_name").endswith(".mp4")).alias("has_video"),
        F.max(F.col("_name") == "_.mp3").alias("silent_player"),
    )


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """Paths under a folder; the file contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def pivot_values(values: DataFrame, categories: list, order: list[str], texts: DataFrame | None = None) -> DataFrame:
    """SRC-9. Rows (text_id, category, value) to one column per category; the last value in ``order`` wins.

    Cells are stripped, and blank where a text has no value. ``max_by`` is combined before the shuffle.
    """
    last = F.max_by(F.trim(F.col("value").cast("string")), F.struct(*order))
    wide = values.groupBy("text_id").pivot("category", categories).agg(last)
    rows = wide if texts is None else texts.join(wide, "text_id", "left")
    named = {c: F.col("`" + str(c).replace("`", "``") + "`") for c in categories}
    return rows.select(
        *(c for c in rows.columns if c not in named), *(F.coalesce(col, F.lit("")).alias(str(c)) for c, col in named.items())
    )


def value_map(values: DataFrame, order: list[str]) -> DataFrame:
    """SRC-9. Rows (text_id, category, value) to one map per text over all categories there are; the last in ``order`` wins.

    No category has to be known beforehand. Values are stripped strings, NULL ones blank; rows without a category are left
    out. The last value of a category is combined before the shuffle, so a map has one entry per category and text.
    """
    last = F.max_by(F.trim(F.col("value").cast("string")), F.struct(*order))
    cells = values.where(F.col("category").isNotNull()).groupBy("text_id", "category").agg(F.coalesce(last, F.lit("")).alias("value"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "value"))))
    return cells.groupBy("text_id").agg(entries.alias("values"))


def map_columns(maps: DataFrame, categories: list) -> DataFrame:
    """SRC-9. The asked categories of ``value_map`` as columns, blank where a text has no value."""
    columns = [F.coalesce(F.try_element_at("values", F.lit(c)), F.lit("")).alias(str(c)) for c in categories]
    return maps.select(*(c for c in maps.columns if c != "values"), *columns)
