"""What keeps memory and work in proportion to the input: plans and splits, on the smallest tables."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from lamina.operators import batch_stats, components, distance, evaluation, objects, spacing, tiling
from lamina.plans.rasters import DRAWN, raster, spread_suppliers
from lamina.session import materialize
from tests import helpers

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_not_sent_to_all(spark):
    gt, pred = raster(spark, SF, "gt"), raster(spark, SF, "pred")
    at = ["section_id", "y", "x"]
    assert "Broadcast" not in plan_of(evaluation.paired(gt, pred, ["section_id"]))
    assert "Broadcast" not in plan_of(gt.select(*at).join(pred.where("cls = 3").select(*at), at, "left_semi"))
    runs = spark.createDataFrame([(1, 0, 0, 9, 0)], "section_id long, y int, x0 int, x1 int, label long")
    assert "Broadcast" not in plan_of(gt.join(components.runs_to_pixels(runs, ["section_id"]), at, "left"))


def test_paired_keeps_the_pixels_of_both_masks(spark):
    gt = spark.createDataFrame([("s", 0, 0, 1), ("s", 0, 1, 2), ("t", 0, 0, 3)], "section_id string, y int, x int, cls int")
    pred = spark.createDataFrame([("s", 0, 0, 0), ("t", 0, 0, 3), ("t", 1, 0, 1)], "section_id string, y int, x int, cls int")
    assert sorted(map(tuple, evaluation.paired(gt, pred, ["section_id"]).collect())) == [("s", 0, 0, 1, 0), ("t", 0, 0, 3, 3)]


def test_a_task_draws_a_bounded_number_of_pixels(spark):
    suppliers = spread_suppliers(spark, SF, 3 * DRAWN)
    assert suppliers.rdd.getNumPartitions() == 3 * suppliers.count()


def test_luma_is_drawn_once(spark):
    plan = plan_of(__spark_entry__.queries()["b4_luma"](spark, SF))
    assert not [line for line in plan.splitlines() if "Filter" in line and "0.299" in line]


def test_nearest_neighbours_of_few_and_of_many_centres(spark):
    rng = np.random.default_rng(6)
    rows = [(s, i, float(a), float(b)) for s, n in (("one", 1), ("few", 9), ("many", 300)) for i, (a, b) in enumerate(rng.integers(0, 60, (n, 2)))]
    points = spark.createDataFrame(rows, "section_id string, i int, center_x double, center_y double")
    want = {}
    for s, i, x, y in rows:
        rest = [(x - a) ** 2 + (y - b) ** 2 for t, j, a, b in rows if t == s and j != i]
        want[s, i] = min(rest) ** 0.5 if rest else None
    for few in (0, 20, spacing.FEW):
        got = spacing.nearest_neighbour(points, ["section_id"], ["i"], few).collect()
        assert {(r["section_id"], r["i"]): r["nn_px"] for r in got} == want
    # a section that fits a task needs no candidates of other levels
    assert "_level" not in plan_of(spacing.nearest_neighbour(points, ["section_id"], ["i"]))


def test_distance_packs_pixels_for_both_passes(spark, to_pixels):
    rng = np.random.default_rng(7)
    on = rng.random((40, 70)) < 0.97
    lattice = to_pixels({"s": on, "all on": np.ones((5, 6), bool)}, "on")
    d2 = distance.distance_squared(lattice, ["section_id"])
    got = {(r["section_id"], r["y"], r["x"]): r["d2"] for r in d2.collect()}
    want = helpers.distance2(on)
    assert {k: v for k, v in got.items() if k[0] == "s"} == {("s", y, x): want[y, x] for y, x in np.argwhere(on)}
    assert [got["all on", y, x] for y in range(5) for x in range(6)] == [None] * 30
    assert "Window" not in plan_of(d2)


def test_confusion_pairs_the_pixels_once(spark):
    pairs = evaluation.paired(raster(spark, SF, "gt"), raster(spark, SF, "pred"), ["section_id"])
    assert "s_suppkey" not in plan_of(evaluation.confusion(pairs, ["section_id"]))


def test_member_means_stay_where_their_section_was_dealt(spark):
    plan = plan_of(__spark_entry__.queries()["g1_mean_probabilities"](spark, SF))
    assert plan.count("Exchange") == 1 and "Union" not in plan


def test_quantiles_of_few_groups_gather_no_values(spark):
    values = spark.range(30_000).select((F.col("id") % 997 / 2).alias("a"), (F.col("id") % 1013).cast("double").alias("b"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        box = batch_stats.box_numbers(values, ["a", "b"])
        assert "SortMergeJoin" not in plan_of(box)
        got = {r["measure"]: (r["q1"], r["med"], r["q3"]) for r in box.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    rows = values.toPandas()
    assert got == {c: tuple(np.quantile(rows[c], [0.25, 0.5, 0.75])) for c in ("a", "b")}


def test_nearest_component_looks_in_blocks(spark):
    rng = np.random.default_rng(9)
    pixels = [(s, int(y), int(x), int(y * 100 + x)) for s in ("a", "b") for y, x in np.argwhere(rng.random((40, 50)) < 0.02)]
    labelled = spark.createDataFrame(pixels, "section_id string, y int, x int, label long")
    spots = [(s, i, float(x) / 2, float(y) / 2) for s in ("a", "b", "none") for i, (x, y) in enumerate(rng.integers(-16, 120, (150, 2)))]
    points = spark.createDataFrame([*spots, ("a", -1, None, 3.0)], "section_id string, i int, center_x double, center_y double")
    want = {("a", -1): None}
    for s, i, cx, cy in spots:
        xi, yi = int(np.rint(cx)), int(np.rint(cy))
        box = [((y, x) != (yi, xi), (x - cx) ** 2 + (y - cy) ** 2, y, x, lab) for t, y, x, lab in pixels if t == s and abs(x - xi) <= 6 and abs(y - yi) <= 6]
        want[s, i] = min(box)[-1] if box else None
    for block in (8, 256):
        near = objects.component_near_point(points, labelled, ["section_id"], ["i"], 6, block)
        assert {(r["section_id"], r["i"]): r["label"] for r in near.collect()} == want
    # no join makes a row for a point and a pixel
    assert "Join" not in plan_of(near)


def test_stored_tables_of_many_rows_are_not_sent_to_all(spark):
    rows = spark.range(2000).selectExpr("id", "id % 3 as v")
    other = spark.range(50).selectExpr("id", "id as w")
    assert "Broadcast" not in plan_of(other.join(materialize(rows, few=1999), "id"))
    assert "Broadcast" in plan_of(other.join(materialize(rows, few=2000), "id"))


def test_grid_spacing_of_few_and_of_many_centres(spark):
    rng = np.random.default_rng(12)
    rows = [(s, float(a), float(b)) for s, n in (("one", 1), ("two", 2), ("few", 40), ("many", 300)) for a, b in np.round(rng.integers(0, 90, (n, 2)) + rng.random((n, 2)), 1)]
    rows += [("line", 7.0, float(b)) for b in (1, 1, 4, 9)]
    points = spark.createDataFrame(rows, "section_id string, center_x double, center_y double")
    found = []
    for few in (0, 50, spacing.FEW):
        got = spacing.grid_spacing(points, ["section_id"], few=few)
        found.append({r["section_id"]: round(r["mean_grid_distance_um"], 9) for r in got.collect()})
    assert found[0] == found[1] == found[2] and set(found[0]) == {"one", "two", "few", "many", "line"}


def test_white_share_sums_pixels_to_cells_first(spark):
    rng = np.random.default_rng(8)
    sides = {"even": (12, 20), "odd": (9, 13), "small": (5, 6)}
    white = {s: rng.random(side) < 0.7 for s, side in sides.items()}
    pixels = spark.createDataFrame([(s, int(y), int(x), *[250 if on else 10] * 3) for s, grid in white.items() for (y, x), on in np.ndenumerate(grid)],
                                   "section_id string, y int, x int, r int, g int, b int")
    sections = spark.createDataFrame([(s, h, w) for s, (h, w) in sides.items()], "section_id string, height int, width int")
    for sizes, pcts in (([8], (25, 50)), ([8, 5], (20, 40))):
        want = {}
        for s, grid in white.items():
            for size in sizes:
                steps = {"no_shift": size} | {f"ovlp_{p}": size - size * p // 100 for p in pcts if round(100 * (size * p // 100) / size) in pcts}
                for folder, step in steps.items():
                    rows, columns = ({*range(0, n - size + 1, step), n - size} if n >= size else set() for n in grid.shape)
                    if rows and columns:
                        want |= {(s, size, folder, i, j): grid[i:i + size, j:j + size].sum() / size ** 2 for i in rows for j in columns}
        got = tiling.tile_white_share(pixels, sections, sizes, pcts)
        found = {(r["section_id"], r["size"], r["folder"], r["i"], r["j"]): r["white_share"] for r in got.collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    # nothing is repeated per tile before the pixels are summed
    lines = plan_of(got).splitlines()
    assert any("Aggregate" in line for line in lines[max(i for i, line in enumerate(lines) if "Generate explode" in line):])
