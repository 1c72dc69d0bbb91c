"""Steps look at many blocks at once and keep pixels packed between them."""

import re

import numpy as np
from pyspark.sql import functions as F

from lamina.operators import blocks, clustering, component_filter as cf, decode, ensemble, lesions, objects
from lamina.plans.rasters import raster
from tests import helpers
from tests.test_growth import SF, plan_of

K = ["section_id"]


def test_steps_look_at_many_blocks_at_once(spark, to_pixels):
    rng = np.random.default_rng(1)
    grids = {s: rng.integers(0, 2, (40, 33)) for s in ("s", "t")}

    def fn(tile):
        near = blocks.dilate(tile["v"] > 0, tile.present, blocks.ellipse(5))
        return tile.present, {"near": near, "stack": np.full(tile.present.shape, len(tile.present))}

    given = to_pixels(grids, "v").coalesce(1)
    whole = blocks.packed(given, K, ["v"], 8)
    for source in (given, whole):
        got = blocks.block_map(source, K, ["v"], 2, fn, {"near": "boolean", "stack": "int"}, 8)
        got = got.pixels() if isinstance(got, blocks.Blocks) else got
        rows = got.collect()
        assert len(rows) == 2 * 40 * 33 and max(r["stack"] for r in rows) > 1
        for s, grid in grids.items():
            want = blocks.dilate(grid > 0, np.ones(grid.shape, bool), blocks.ellipse(5))
            assert {(r["y"], r["x"]): r["near"] for r in rows if r["section_id"] == s} == {(y, x): want[y, x] for y, x in np.ndindex(grid.shape)}


def test_wide_windows(monkeypatch):
    rng = np.random.default_rng(2)
    grid, present = rng.integers(0, 9, (2, 40, 30)).astype(np.int8), rng.random((2, 40, 30)) < 0.6
    seen, shifted = [], blocks.shifted
    for size in (9, 25, 31):
        r = size // 2
        for largest, pick in ((True, max), (False, min)):
            got = blocks.extreme(grid, present, blocks.rectangle(size), largest)
            for i, y, x in [(0, 0, 0), (1, 39, 29), (0, 20, 15), *map(tuple, rng.integers(0, (2, 40, 30), (60, 3)))]:
                box = np.s_[i, max(0, y - r):y + r + 1, max(0, x - r):x + r + 1]
                assert got[i, y, x] == (pick(grid[box][present[box]]) if present[i, y, x] else 0)
    monkeypatch.setattr(blocks, "shifted", lambda *a: seen.append(1) or shifted(*a))
    blocks.extreme(grid, present, blocks.rectangle(25), True)
    assert len(seen) < 25  # a wide window grows by its own length, not cell by cell


def test_packed_pixels_come_back(spark, to_pixels):
    grids = {s: np.random.default_rng(i).integers(-5, 9, (19, 23)) for i, s in enumerate(("s", "t"))}
    whole = blocks.packed(to_pixels(grids, "v"), K, ["v"], 8).stored()
    assert {(r["section_id"], r["y"], r["x"]): r["v"] for r in whole.pixels().collect()} == {(s, y, x): g[y, x] for s, g in grids.items() for y, x in np.ndindex(g.shape)}
    assert whole.rows.count() == 2 * 3 * 3
    counts = {(r["section_id"], r["v"]): r["n"] for r in whole.tally(["v"]).groupBy("section_id", "v").agg(F.sum("n").alias("n")).collect()}
    assert counts == {(s, v): (g == v).sum() for s, g in grids.items() for v in np.unique(g)}
    assert {tuple(r) for r in whole.extent().collect()} == {("s", 18, 22), ("t", 18, 22)}


def test_decoding_makes_no_rows_of_pixels_between_its_steps(spark, to_pixels):
    """from the first packing to the last step, what Spark moves are blocks and runs."""
    rng = np.random.default_rng(3)
    probs = to_pixels({"s": rng.integers(0, 60, (40, 40))}, "p0").select("section_id", "y", "x", "p0", *[((F.col("p0") * k + F.col("x") * 7) % 60).cast("int").alias(f"p{c}") for c, k in ((1, 3), (2, 5), (3, 11))])
    whole = blocks.packed(probs, K, ["p0", "p1", "p2", "p3"], 16).stored()
    for options in ({}, {"interior_background": True, "fill_crater": True}):
        got = decode.nested_decode(whole, K, 2.0, block=16, **options)
        assert isinstance(got, blocks.Blocks) and " x#" not in plan_of(got.rows)
        rows = decode.nested_decode(probs, K, 2.0, block=16, **options)
        assert sorted(map(tuple, got.pixels().collect())) == sorted(map(tuple, rows.collect()))


def test_clusters_of_few_and_of_many_colours(spark, to_pixels):
    """a section's colours are clustered in one task; the classes are counted from colours, pixels are joined to nothing."""
    rng = np.random.default_rng(4)
    centres = np.array([(230, 240, 220), (160, 150, 170), (90, 100, 80), (20, 10, 30)])
    cls = {s: rng.integers(0, 4, (30, 31)) for s in ("s", "t")}
    rgb = {s: centres[g] + rng.integers(0, 9, (*g.shape, 3)) for s, g in cls.items()}
    rows = [(s, int(y), int(x), *map(int, rgb[s][y, x]), int(g[y, x])) for s, g in cls.items() for y, x in np.ndindex(g.shape)]
    pixels = spark.createDataFrame(rows, "section_id string, y int, x int, r int, g int, b int, gt int")
    found = [sorted(map(tuple, clustering.colour_clusters(pixels, K, few=few).collect())) for few in (0, 1 << 16)]
    assert found[0] == found[1] and {r[-1] for r in found[0]} == {0, 1, 2, 3}
    classes = clustering.oracle_colours(clustering.colour_counts(pixels, K), K)
    assert " x#" not in plan_of(classes)
    counts = {(r["section_id"], r["cls"]): r["n"] for r in classes.groupBy("section_id", "cls").agg(F.sum("n").alias("n")).collect()}
    assert counts == {(s, c): (g == c).sum() for s, g in cls.items() for c in range(4)}
    per_pixel = clustering.oracle_clusters(pixels.drop("gt"), pixels.withColumnRenamed("gt", "cls"), K).collect()
    assert {(r["section_id"], r["y"], r["x"]): r["cls"] for r in per_pixel} == {(s, y, x): g[y, x] for s, g in cls.items() for y, x in np.ndindex(g.shape)}


def test_member_means_and_scores_stay_packed(spark):
    """a set's mean is that of the rows, and no pixel is a row between the members and the counts."""
    probs = raster(spark, SF, "probs").where("section_id < 3")
    gt = raster(spark, SF, "gt").where("section_id < 3")
    members = ensemble.member_blocks(probs, K, 32)
    means = ensemble.mean_blocks(members, K, {"a": [0, 2], "b": [1]})
    assert " x#" not in plan_of(means.rows)
    for name, s in (("a", [0, 2]), ("b", [1])):
        want = ensemble.mean_probabilities(probs, K, s).collect()
        got = means.pixels().where(f"trial = '{name}'").drop("trial").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    scores = ensemble.score_sets(probs, gt, K, {"a": [0, 2], "b": [1]}, 32)
    one = ensemble.score_sets(members, ensemble.reference_blocks(gt, K, 32), K, {"b": [1]}, 32)
    assert 0 < scores["a"] <= 1 and one["b"] == scores["b"]


def test_validation_counts_come_from_blocks(spark, to_pixels):
    """features, confusion and overlaps are counted block by block, no pixels are joined."""
    rng = np.random.default_rng(5)
    pred, ref = rng.integers(0, 4, (40, 33)), np.kron(rng.integers(0, 4, (5, 5)), np.ones((8, 8), int))[:40, :33]
    mask = blocks.packed(to_pixels({"s": pred}).withColumn("lp", F.lit(200)), K, ["cls", "lp"], 16).stored()
    gt = blocks.packed(to_pixels({"s": ref}), K, ["cls"], 16).stored()
    runs = cf.component_runs(mask, K, 16)
    base, per, overlaps = cf.validation_tables(runs, mask, gt, K, 20, 16)
    assert not [line for df in (base, per, overlaps) for line in plan_of(df).splitlines() if re.search(r"Join \[[^\]]*\bx#", line)]
    assert {(r["pred"], r["gt"]): r["n"] for r in base.collect()} == {(a, b): n for a in range(4) for b in range(4) if (n := ((pred == a) & (ref == b)).sum())}
    own, other = helpers.labels(pred >= 2), helpers.labels(ref >= 2)
    want, shared = {}, {}
    for y, x in np.ndindex(pred.shape):
        if own[y, x] >= 0:
            want[own[y, x], pred[y, x], ref[y, x]] = want.get((own[y, x], pred[y, x], ref[y, x]), 0) + 1
            if other[y, x] >= 0:
                shared[other[y, x], own[y, x]] = shared.get((other[y, x], own[y, x]), 0) + 1
    assert {(r["label"], r["pred"], r["gt"]): r["n"] for r in per.collect()} == want
    large = {lab for lab in np.unique(other) if lab >= 0 and (other == lab).sum() >= 20}
    assert {(r["gt_label"], r["label"]): r["n"] for r in overlaps.where("label is not null").collect()} == {k: n for k, n in shared.items() if k[0] in large}


def test_clean_up_stays_packed(spark, to_pixels):
    """F2, F8: the passes hand blocks to each other and give what they give on rows."""
    grid = np.kron(np.random.default_rng(6).integers(0, 4, (9, 8)), np.ones((4, 4), int))
    rows = to_pixels({"s": grid, "t": grid.T})
    whole = blocks.packed(rows, K, ["cls"], 16).stored()
    for step in (decode.clean_mask, decode.fill_lesion_holes):
        got = step(whole, K, 16)
        assert isinstance(got, blocks.Blocks)
        assert sorted(map(tuple, got.pixels().collect())) == sorted(map(tuple, step(rows, K, 16).collect())) == sorted(map(tuple, step(rows, K, 64).collect()))
    inside = whole.map(lambda tile: (tile.present, {"cls": tile["cls"], "inside": tile["cls"] >= 2}), {"cls": "int", "inside": "boolean"}).stored()
    bridged = decode.bridge_fragments(inside, K, 16)
    assert " x#" not in plan_of(bridged.rows)
    assert sorted(map(tuple, bridged.pixels().collect())) == sorted(map(tuple, decode.bridge_fragments(inside.pixels(), K, 64).collect()))


def test_points_look_beyond_their_block(spark):
    """points meet many blocks at once; one that rounds into the next block sees its whole box."""
    labelled = spark.createDataFrame([("s", 4, 14, 7), ("t", 14, 4, 8), ("t", 0, 0, 9)], "section_id string, y int, x int, label long")
    points = spark.createDataFrame([("s", 1, 7.6, 4.0), ("t", 2, 4.0, 7.6), ("t", 3, 0.0, 0.0), ("u", 4, 1.0, 1.0)], "section_id string, i int, center_x double, center_y double")
    for source in (labelled, blocks.packed(labelled, K, ["label"], 8)):
        near = objects.component_near_point(points, source, K, ["i"], 6, 8)
        assert "FlatMapCoGroups" not in plan_of(near)
        assert {r["i"]: r["label"] for r in near.collect()} == {1: 7, 2: 8, 3: 9, 4: None}


def test_widths_of_few_and_of_many_corners(spark, to_pixels):
    """corners of many lesions are measured at once, and lesions with very many corners row by row."""
    yy, xx = np.mgrid[:60, :70]
    grid = np.zeros((60, 70), int)
    for cy, cx, r, hot in ((15, 15, 12, 5), (15, 50, 9, 0), (44, 30, 13, 8)):
        grid[(yy - cy) ** 2 + (xx - cx) ** 2 <= r * r] = 2
        grid[(yy - cy) ** 2 + (xx - cx - 1) ** 2 <= hot * hot - 1] = 3
    runs = lesions.labelled_lesion_runs(to_pixels({"s": grid, "t": grid[::-1].copy()}), K, 5, 32)
    found = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in lesions.morphometry_px(runs, K, block=32, many_corners=many).collect()) for many in (0, 1 << 16)]
    assert found[0] == found[1] and len(found[0]) == 6
