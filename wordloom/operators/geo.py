"""Geographical distributions (AGG-18..22, JOI-8, JOI-9, FLT-11)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from wordloom.functions.geo import Point, in_any_polygon
from wordloom.layout import unfolded


def geo_distribution(hits: DataFrame, speakers: DataFrame, form: str) -> DataFrame:
    """AGG-18, JOI-8. Hits per form and place; speakers without a place are left out.

    Hits are counted per (form, speaker) before the join with ``speakers`` (text_id, place).
    """
    places = speakers.where(F.col("place").isNotNull()).select("text_id", "place").distinct()
    counted = hits.groupBy(F.col(form).alias("form"), "text_id").agg(F.count(F.lit(1)).alias("_n"))
    return counted.join(places, "text_id").groupBy("form", "place").agg(F.sum("_n").alias("n"))


def form_attribute(attributes: tuple[str, ...]) -> str:
    """AGG-18. Forms are phonetic if the corpus has them, else words."""
    return "phon" if "phon" in attributes else "word"


def placed(distribution: DataFrame, coords: DataFrame) -> DataFrame:
    """JOI-9. Rows of places that have coordinates."""
    return distribution.join(coords, "place")


def unknown_places(distribution: DataFrame, coords: DataFrame) -> DataFrame:
    """JOI-9. Places without coordinates, each once."""
    return distribution.select("place").distinct().join(coords, "place", "left_anti")


def places_with_forms(distribution: DataFrame, coords: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """AGG-19. One point per place with ``form: n; form: n``, forms in order: the chosen ``forms``, or all.

    A whole vocabulary is better read from the distribution itself, which has a row for each place and form.
    """
    if forms is not None:
        distribution = distribution.where(F.col("form").isin(*forms))
    pairs = F.array_sort(F.collect_list(F.struct("form", "n")))
    label = F.array_join(F.transform("_pairs", lambda p: F.concat(p["form"], F.lit(": "), p["n"].cast("string"))), "; ")
    grouped = distribution.groupBy("place").agg(pairs.alias("_pairs"))
    return grouped.select("place", label.alias("forms")).join(coords, "place")


def forms_with_places(distribution: DataFrame) -> DataFrame:
    """AGG-20. Per form ``place: n; place: n``, most frequent place first (ties by name), and the total."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "place", "n")))
    label = F.array_join(F.transform("_pairs", lambda p: F.concat(p["place"], F.lit(": "), p["n"].cast("string"))), "; ")
    grouped = distribution.groupBy("form").agg(pairs.alias("_pairs"), F.sum("n").alias("total"))
    return grouped.select("form", label.alias("places"), "total")


def marker_sets(distribution: DataFrame, colours: DataFrame, coords: DataFrame) -> DataFrame:
    """AGG-21. Points (place, colour) where a form of the colour occurs, each once. ``colours`` has (form, colour)."""
    marked = distribution.join(colours, "form").select("place", "colour").distinct()
    return marked.join(coords, "place")


def speakers_and_places(speakers: DataFrame) -> DataFrame:
    """AGG-22. Number of selected speakers and of the places they come from."""
    return speakers.agg(
        F.count_distinct("text_id").alias("n_speakers"), F.count_distinct("place").alias("n_places")
    )


def places_in(coords: DataFrame, polygons: list[list[Point]]) -> DataFrame:
    """FLT-11. Places inside at least one polygon; the polygons are part of the predicate, so nothing is joined."""
    return coords.where(in_any_polygon("lat", "lng", polygons))


#: Height in degrees of the bands of latitude by which points meet the edges of polygons.
BAND = 0.25


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """Corners (polygon, corner, lat, lng), numbered from 0 in each polygon, to edges (polygon, wraps, a_lat, …, b_lng).

    A polygon with an edge of more than 180 degrees of longitude crosses the 180th meridian: ``wraps`` is true, and its
    longitudes run on beyond 180.
    """
    sizes = polygons.groupBy("polygon").agg(F.count(F.lit(1)).alias("_n"))
    ends = polygons.select("polygon", F.col("corner").alias("_next"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
    edges = (
        polygons.join(sizes, "polygon")
        .select("polygon", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), ((F.col("corner") + 1) % F.col("_n")).alias("_next"))
        .join(ends, ["polygon", "_next"])
    )
    wide = edges.groupBy("polygon").agg(F.max(F.abs(F.col("a_lng") - F.col("b_lng")) > 180).alias("wraps"))
    on = lambda c: F.when(F.col("wraps") & (F.col(c) < 0), F.col(c) + 360).otherwise(F.col(c)).alias(c)
    return edges.join(wide, "polygon").select("polygon", "wraps", "a_lat", on("a_lng"), "b_lat", on("b_lng"))


def places_in_polygons(coords: DataFrame, polygons: DataFrame, band: float = BAND) -> DataFrame:
    """FLT-11. Places inside at least one polygon of a table (polygon, corner, lat, lng); without polygons all places.

    Edges are listed by the bands of latitude they cross and points meet those of their own band, so neither the number of
    polygons nor that of their corners is part of the plan. A point is inside a polygon if it has an odd number of the
    polygon's edges to its east.
    """
    if polygons.isEmpty():
        return coords
    of_band = lambda c: F.floor(c / band)
    edges = polygon_edges(polygons).where(F.col("a_lat") != F.col("b_lat"))
    listed = unfolded(edges, of_band(F.least("a_lat", "b_lat")), of_band(F.greatest("a_lat", "b_lat")), "_band")
    points = coords.select("lat", "lng").distinct().withColumn("_band", of_band(F.col("lat")))
    lng = F.when(F.col("wraps") & (F.col("lng") < 0), F.col("lng") + 360).otherwise(F.col("lng"))
    spans = (F.col("a_lat") > F.col("lat")) != (F.col("b_lat") > F.col("lat"))
    at = (F.col("b_lng") - F.col("a_lng")) * (F.col("lat") - F.col("a_lat")) / (F.col("b_lat") - F.col("a_lat")) + F.col("a_lng")
    crossed = points.join(listed, "_band").where(spans & (lng < at))
    inside = crossed.groupBy("lat", "lng", "polygon").agg((F.count(F.lit(1)) % 2).alias("_odd")).where(F.col("_odd") == 1)
    return coords.join(inside.select("lat", "lng").distinct(), ["lat", "lng"], "left_semi")


def colour_table(distribution: DataFrame, colours: Mapping[str, list[str]]) -> DataFrame:
    """(form, colour) rows of a colour choice, one row for each colour a form was given."""
    by_form: dict[str, list[str]] = {}
    for colour, forms in colours.items():
        for form in forms:
            by_form.setdefault(form, []).append(colour)
    chosen = F.coalesce(
        *(F.when(F.col("form") == f, F.array(*map(F.lit, c))) for f, c in by_form.items()), F.array().cast("array<string>")
    )
    return distribution.select("form").distinct().select("form", F.explode(chosen).alias("colour"))
