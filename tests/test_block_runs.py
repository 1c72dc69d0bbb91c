"""Pixels meet runs packed, block by block: what is asked of components is no join of pixels."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from lamina.operators import blocks, component_filter as cf, components, decode, distance, morphology
from tests import helpers
from tests.test_growth import SF, plan_of

K = ["section_id"]


def joins_of_pixels(df):
    return [line for line in plan_of(df).splitlines() if re.search(r"Join \[[^\]]*\bx#", line)]


def test_runs_are_painted_across_blocks(spark, to_pixels):
    lattice = to_pixels({"s": np.ones((20, 30), int), "t": np.ones((3, 3), int)}, "v")
    runs = spark.createDataFrame([("s", 4, 3, 25, 7), ("s", 19, 0, 0, 8), ("none", 0, 0, 1, 9)], "section_id string, y int, x0 int, x1 int, label int")

    def fn(tile, covered, marks):
        return tile.present & covered, {"label": marks["label"], "v": tile["v"]}

    got = blocks.block_runs_map(lattice, K, ["v"], runs, ["label"], fn, {"label": "int", "v": "int"}, 8)
    assert sorted(map(tuple, got.collect())) == [("s", 4, x, 7, 1) for x in range(3, 26)] + [("s", 19, 0, 8, 1)]


def test_groups_are_whole_however_batches_fall(spark):
    rows = spark.range(0, 4000, 1, 3).select((F.col("id") % 7 * F.col("id") % 31).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("b"), "id")

    def total(table):
        return pa.table({"a": table["a"][:1], "b": table["b"][:1], "n": pa.array([table.num_rows], pa.int64()), "s": pa.array([sum(table["id"].to_pylist())], pa.int64())})

    want = {tuple(r) for r in rows.groupBy("a", "b").agg(F.count("*"), F.sum("id")).collect()}
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "17", kept):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = [tuple(r) for r in blocks.map_groups(rows, ["a", "b"], total, "a long, b long, n long, s long").collect()]
        assert len(got) == len(want) and set(got) == want
    # a group of its own in Spark is left to what is large
    assert "FlatMapGroups" not in plan_of(components.label_runs(rows.select(F.col("a").alias("section_id"), F.col("id").cast("int").alias("y"), F.col("id").cast("int").alias("x")), K))


def test_runs_carry_values_and_sums(spark, to_pixels):
    rng = np.random.default_rng(3)
    cls = rng.integers(0, 4, (37, 41))
    mask = to_pixels({"s": cls}).where("cls >= 2").withColumn("lp", F.col("x") + 100 * F.col("y"))
    for block in (8, 256):
        runs = components.label_runs(mask, K, 8, block, ["cls"], ["lp"])
        plain = components.runs_to_pixels(components.label_runs(mask, K, 8, block), K)
        rows = [tuple(r) for r in components.runs_to_pixels(runs, K, ["cls"]).select("y", "x", "cls", "label").collect()]
        assert {(y, x): c for y, x, c, _ in rows} == {(y, x): cls[y, x] for y, x in np.argwhere(cls >= 2)}
        assert {(y, x): lab for y, x, _, lab in rows} == {(r["y"], r["x"]): r["label"] for r in plain.collect()}
        assert runs.agg(F.sum("lp")).first()[0] == mask.agg(F.sum("lp")).first()[0]


def test_component_distance_comes_from_edge_pixels(spark, to_pixels):
    rng = np.random.default_rng(11)
    grid = np.where(rng.random((45, 50)) < 0.004, 0, np.where(rng.random((45, 50)) < 0.7, 2, 1))
    mask = to_pixels({"s": grid, "all": np.full((6, 7), 2)}).withColumn("lp", F.lit(255))
    runs = components.runs_to_pixels(cf.component_runs(mask, K, 16), K)
    labels = {(r["section_id"], r["y"], r["x"]): r["label"] for r in runs.collect()}
    d2, want = helpers.distance2(grid > 0), {("all", 0): None}
    for (s, y, x), label in labels.items():
        if s == "s":
            want[s, label] = min(want.get((s, label), 1 << 30), d2[y, x])
    got = cf.component_features(cf.component_runs(mask, K, 16), mask, K, 1.0)
    assert {(r["section_id"], r["label"]): r["edge_um"] for r in got.collect()} == {k: None if v is None else v ** 0.5 for k, v in want.items()}


def test_wanted_distances(spark, to_pixels):
    on = np.random.default_rng(7).random((40, 70)) < 0.97
    lattice = to_pixels({"s": on}, "on")
    some = distance.distance_squared(lattice.withColumn("w", F.col("x") % 5 == 0), K, wanted="w").collect()
    want = helpers.distance2(on)
    assert {(r["y"], r["x"]): r["d2"] for r in some} == {(y, x): want[y, x] for y, x in np.argwhere(on) if x % 5 == 0}


def test_holes_are_filled_without_joining_pixels(spark, to_pixels):
    lattice = to_pixels({"s": np.random.default_rng(1).random((20, 20)) < 0.6}, "on").withColumn("cls", F.col("x"))
    filled = components.fill_holes(lattice, K, 8)
    assert not joins_of_pixels(filled)
    assert {(r["x"], r["cls"]) for r in filled.collect()} == {(x, x) for x in range(20)}
    mask = to_pixels({"s": np.random.default_rng(2).integers(0, 4, (20, 20))}).withColumn("inside", F.col("cls") >= 2)
    for step in (decode.fill_lesion_holes, decode.bridge_fragments, decode.fill_ablation):
        assert not joins_of_pixels(step(mask, K, 8))


def test_filter_and_features_join_no_pixels(spark):
    for name in ("g6_apply_filter", "g2_component_features", "f6_lesion_objects", "f7_optimal_assignment", "d10_nested_decode_rim", "d10_interior_background", "d15_border_and_ring"):
        assert not joins_of_pixels(__spark_entry__.queries()[name](spark, SF)), name


def test_border_and_ring_are_asked_in_one_pass(spark):
    """Of what grows with the components nothing is joined, so nothing of it is sent to all: the section's sides alone are."""
    df = __spark_entry__.queries()["d15_border_and_ring"](spark, SF)
    assert not [line for line in plan_of(df).splitlines() if re.search(r"Join \[section_id#\d+L?, label#", line)]
    runs = spark.createDataFrame([("s", 0, 2, 3, 2, False), ("s", 1, 2, 2, 2, True), ("s", 2, 5, 6, 9, False)], "section_id string, y int, x0 int, x1 int, label long, beside boolean")
    extent = spark.createDataFrame([("s", 9, 9)], "section_id string, width int, height int")
    assert sorted(map(tuple, components.touches_border(runs, extent, K, ["beside"]).collect())) == [("s", 2, True, True), ("s", 9, False, False)]


def test_beside_background(spark, to_pixels):
    grid = np.random.default_rng(5).integers(0, 4, (19, 23))
    got = morphology.beside_background(to_pixels({"s": grid}), K, 8).collect()
    padded = np.pad(grid, 1, constant_values=9)
    want = {(y, x): any(padded[y + 1 + a, x + 1 + b] == 0 for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) for y, x in np.argwhere(grid >= 2)}
    assert {(r["y"], r["x"]): r["beside"] for r in got} == want


def test_rectangles_are_taken_in_two_passes(monkeypatch):
    rng = np.random.default_rng(4)
    grid, present = rng.integers(0, 9, (30, 34)).astype(np.int8), rng.random((30, 34)) < 0.7
    seen, shifted = [], blocks.shifted
    monkeypatch.setattr(blocks, "shifted", lambda *a: seen.append(a[1:3]) or shifted(*a))
    for largest, pick, none in ((True, max, 0), (False, min, 0)):
        got = blocks.extreme(grid, present, blocks.rectangle(7), largest)
        for y, x in np.ndindex(grid.shape):
            near = [grid[a, b] for a in range(max(0, y - 3), min(30, y + 4)) for b in range(max(0, x - 3), min(34, x + 4)) if present[a, b]]
            assert got[y, x] == (pick(near) if present[y, x] else none)
    assert len(seen) == 2 * 14
