"""Polygons as a table, maps of all categories, metadata pages that are cut first."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions.geo import in_any_polygon
from wordloom.operators import geo, stats
from wordloom.operators.selection import Choice, Dimension, Selection
from wordloom.plans.corpus import Corpus
from wordloom.sources import tables


def corners_of(spark, polygons):
    rows = [(k, i, float(lat), float(lng)) for k, corners in enumerate(polygons) for i, (lat, lng) in enumerate(corners)]
    return spark.createDataFrame(rows, "polygon long, corner long, lat double, lng double")


@pytest.mark.parametrize("band", [0.25, 7.0])
def test_polygons_as_a_table_are_those_of_the_predicate(spark, band):
    rng = random.Random(2)
    polygons = [[(rng.uniform(-80, 80), rng.uniform(-90, 80)) for _ in range(rng.randint(3, 9))] for _ in range(6)]
    points = spark.createDataFrame(
        [(str(i), rng.uniform(-85, 85), rng.uniform(-100, 100)) for i in range(800)] + [("twin", 1.0, 1.0)] * 2 + [("nowhere", None, None)],
        "place string, lat double, lng double",
    )
    found = sorted(r.place for r in geo.places_in_polygons(points, corners_of(spark, polygons), band).collect())
    want = sorted(r.place for r in points.where(in_any_polygon("lat", "lng", polygons)).collect())
    assert found == want and 50 < len(found) < 800
    assert geo.places_in_polygons(points, corners_of(spark, polygons).limit(0)).count() == points.count()


def test_a_polygon_across_the_180th_meridian(spark):
    square = [(-10, 170), (10, 170), (10, -170), (-10, -170)]
    places = {"east": (0.0, 175.0), "west": (0.0, -175.0), "line": (5.0, 180.0), "far": (0.0, 0.0), "beside": (0.0, 165.0), "north": (11.0, 175.0)}
    points = spark.createDataFrame([(k, *v) for k, v in places.items()], "place string, lat double, lng double")
    found = {r.place for r in geo.places_in_polygons(points, corners_of(spark, [square])).collect()}
    assert found == {"east", "west", "line"}


def test_a_coastline_of_many_corners(spark):
    circle = [(40 * math.sin(a), 60 * math.cos(a)) for a in (2 * math.pi * i / 50_000 for i in range(50_000))]
    rng = random.Random(3)
    rows = [(str(i), rng.uniform(-50, 50), rng.uniform(-70, 70)) for i in range(300)]
    points = spark.createDataFrame(rows, "place string, lat double, lng double")
    found = {r.place for r in geo.places_in_polygons(points, corners_of(spark, [circle])).collect()}
    assert found == {p for p, lat, lng in rows if (lat / 40) ** 2 + (lng / 60) ** 2 < 1}


def test_maps_hold_every_category(spark):
    rows = [(1, "a", " x ", 1), (1, "a", "y", 2), (1, "b", None, 1), (2, "new", "z", 1), (3, None, "lost", 1), (2, "new", "z2", 0)]
    values = spark.createDataFrame(rows, "text_id long, category string, value string, k int")
    maps = tables.value_map(values, ["k"])
    assert {r.text_id: r["values"] for r in maps.collect()} == {1: {"a": "y", "b": ""}, 2: {"new": "z"}}
    wide = {r.text_id: tuple(r)[1:] for r in tables.map_columns(maps, ["a", "new", "none"]).collect()}
    assert wide == {1: ("y", "", ""), 2: ("", "z", "")}
    assert tables.value_map(values.limit(0), ["k"]).count() == 0


def test_a_metadata_page_lists_its_own_texts_only(spark, monkeypatch):
    texts = spark.range(0, 500).select(F.col("id").alias("text_id"), (F.col("id") % 7).alias("year"), (F.col("id") % 2).alias("kind"))
    table = spark.createDataFrame([(i, f"n{i:02}") for i in range(40)], "id long, name string")
    bridge = spark.range(0, 1500).select((F.col("id") % 500).alias("text_id"), (F.col("id") * 7 % 40).alias("id"))
    dimensions = {"author": Dimension(table, bridge)}
    listed, asked = stats.listed_values, []

    def watched(dimension, column, ids=None):
        asked.append(ids.count())
        return listed(dimension, column, ids)

    monkeypatch.setattr(stats, "listed_values", watched)
    corpus = Corpus(texts, texts, dimensions)
    selection = Selection({"kind": Choice((1,))})
    found = [tuple(r) for r in corpus.metadata_page(["year", "author.name"], selection, 3, "year", True).collect()]
    assert asked == [50]
    names = {}
    for i in range(1500):
        names.setdefault(i % 500, []).append(f"n{i * 7 % 40:02}")
    order = sorted((i for i in range(500) if i % 2), key=lambda i: (-(i % 7), i))[100:150]
    assert found == [(i, str(i % 7), "; ".join(sorted(names[i]))) for i in order]
