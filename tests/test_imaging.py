import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewise.functions import geometry as g
from pagewise.operators import degrade, imaging
from pagewise.plans import queries as plans


def picture(ink=40, paper=235, stroke=3, spacing=9, shape=(120, 160)):
    x = np.full(shape, paper, np.uint8)
    for k in range(stroke):
        x[20:100, 20 + k : 140 : spacing] = ink
    return x


def rows(spark, pictures):
    made = [(str(i), p.shape[1], p.shape[0], p.tobytes()) for i, p in enumerate(pictures)]
    every = [(*m, [(0.0, 0.0, float(m[1]), float(m[2]))]) for m in [*made, ("null", 5, 5, None), ("short", 5, 5, b"x")]]
    return spark.createDataFrame(every, f"id string, width int, height int, pixels binary, boxes array<{g.BOX}>")


def test_features_follow_what_they_measure(spark):
    df = rows(spark, [picture(), picture(ink=120), picture(stroke=5), picture(paper=180)])
    f = {r.id: r for r in imaging.features(df).collect()}
    assert f["1"].contrast < f["0"].contrast and f["2"].stroke_width > f["0"].stroke_width and f["3"].paper_lightness < f["0"].paper_lightness
    assert f["0"].stroke_width == pytest.approx(3) and f["0"].aspect_ratio == pytest.approx(160 / 120)
    assert f["null"].contrast is None and f["short"].contrast is None
    assert imaging.features(df.limit(0)).count() == 0


def test_gate(spark):
    flat = np.tile(np.linspace(120, 250, 160).astype(np.uint8), (120, 1))
    got = {r.id: r for r in imaging.pixel_gate(rows(spark, [picture(), np.full((120, 160), 230, np.uint8), flat, picture(ink=190)])).collect()}
    assert [got[str(i)].passed for i in range(4)] == [True, False, False, False] and got["null"].passed is None


def test_degradations(spark):
    df = rows(spark, [picture()])
    for preset in imaging.PRESETS:
        out = imaging.degrade(df, preset, seed=3)
        first, again = out.where("id = '0'").first(), imaging.degrade(df.repartition(3), preset, seed=3).where("id = '0'").first()
        assert len(first.pixels) == first.width * first.height and first.pixels == again.pixels and len(first.records) == len(first.applied)
        assert (first.pixels == picture().tobytes()) == (not first.applied)
    base, rng = picture().astype(np.float32), np.random.default_rng(0)
    moving = {"rotation", "perspective", "wrinkles", "page_curl"}
    for name, step in degrade.STEPS.items():
        out, moved, drawn = step(base, rng)
        assert (moved is not None) == (name in moving) and drawn, name
        assert name in {"rotation", "perspective"} or out.shape == base.shape, name
    assert degrade.STEPS["ink_spread"](base, rng)[0].mean() < base.mean() < degrade.STEPS["ink_erosion"](base, rng)[0].mean()
    with pytest.raises(ValueError):
        degrade.step("nothing")
    with pytest.raises(ValueError):
        imaging.degrade(df, "nothing")


def test_boxes_follow_rotation_and_perspective(spark):
    m, w, h = imaging.rotation_map(100, 200, 90)
    row = spark.range(1).select(imaging.map_box(g.box(0, 0, 10, 20), m).alias("b")).first().b
    assert (w, h) == (201, 101) or (w, h) == (200, 100) or (w, h) == (200, 101) or (w, h) == (201, 100)
    assert row.bbox.x1 - row.bbox.x0 == pytest.approx(20) and row.bbox.y1 - row.bbox.y0 == pytest.approx(10)
    corners, moved = [(0, 0), (100, 0), (100, 200), (0, 200)], [(5, 3), (98, 0), (100, 190), (0, 200)]
    p = imaging.perspective_map(corners, moved)
    flat = spark.range(1).select(imaging.map_box(g.box(0, 0, 100, 200), p)["polygon"].alias("p"), F.lit(1)).first().p
    assert flat == pytest.approx([v for c in moved for v in c])


def test_pictures_show_every_line_to_its_end(spark, tmp_path):
    line = "x" * 30
    texts = ["\n".join([line] * 11), "\n".join([line] * 40), "\n".join([line] * 400), "x" * 140, "x" * 100 + "\n" + "x" * 3000, "x" * 100 + "\n" + "x" * 6000, "", None]
    spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "doc_id int, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ink = {int(r.id): np.frombuffer(r.pixels, np.uint8).reshape(350, 250) < 100 for r in imaging.rasterize(plans._small_pages(spark, str(tmp_path))).collect()}
    last = lambda x, axis: int(np.flatnonzero(x.any(axis))[-1])
    assert [last(ink[i], 1) // 10 for i in (0, 1, 2)] == [8, 30, 34] and last(ink[3], 0) > 240
    # a longer second line leaves the first less of the width, and ends at the same place itself
    assert last(ink[4], 0) > 240 and last(ink[5], 0) > 240 and ink[4].sum() > ink[5].sum()
    assert not ink[6].any() and not ink[7].any()


def test_presets_draw_as_many_steps_as_their_probabilities_say():
    x = np.full((24, 24), 200, np.uint8)
    for name, expected in (("clean", 0), ("scan", 4.15), ("photo", 7.35), ("fax", 4.2), ("archive", 7.0)):
        assert sum(s.probability for s in degrade.PRESETS[name]) == pytest.approx(expected)
        n = np.mean([len(degrade.run_steps(x, degrade.PRESETS[name], lambda k, i=i: np.random.default_rng([i, k]))[2]) for i in range(120)])
        assert abs(n - expected) < 0.5


def test_ink_stays_in_its_box(spark):
    from pagewise.functions import annotations as an

    x = np.full((300, 400), 240, np.uint8)
    x[90:170, 120:260] = 20
    steps = {
        "rotation": degrade.step("rotation", max_angle=6.0), "perspective": degrade.step("perspective", magnitude=0.05),
        "wrinkles": degrade.step("wrinkles", shading=0.0), "page_curl": degrade.step("page_curl", edge="left"),
    }
    box = {"x0": 120.0, "y0": 90.0, "x1": 260.0, "y1": 170.0}
    line = {"text": "a", "bbox": box, "direction": "ltr", "words": [{"text": "a", "bbox": box, "polygon": None}], "baseline": 160.0, "polygon": None}
    cell = {"row": 0, "col": 0, "text": "a", "row_span": 1, "col_span": 1, "is_header": False, "bbox": box}
    region = {"type": "table", "bbox": box, "reading_order": 0, "lines": [line], "table": {"rows": 1, "cols": 1, "has_header_row": False, "cells": [cell]}, "attributes": {"k": "v"}}
    page = {"width": 400, "height": 300, "direction": "ltr", "regions": [region], "attributes": None}
    df = spark.createDataFrame([("a", 400, 300, x.tobytes(), page)], f"id string, width int, height int, pixels binary, page {an.PAGE}")
    for name, step in steps.items():
        r = imaging.degrade(df, (step,), seed=11).first()
        ink = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) < 100
        rows, cols = np.flatnonzero(ink.any(1)), np.flatnonzero(ink.any(0))
        for b in (r.page.regions[0].bbox, r.page.regions[0].lines[0].bbox, r.page.regions[0].lines[0].words[0].bbox, r.page.regions[0].table.cells[0].bbox):
            assert max(abs(b.x0 - cols[0]), abs(b.x1 - cols[-1] - 1), abs(b.y0 - rows[0]), abs(b.y1 - rows[-1] - 1)) < (9 if name == "wrinkles" else 3), name
        assert (r.page.width, r.page.height) == (r.width, r.height) and len(r.page.regions[0].lines[0].polygon) == 8
        assert r.page.regions[0].attributes == {"k": "v"} and r.page.regions[0].lines[0].baseline is None


def test_contrast_is_a_vote_of_blocks():
    x = np.full((220, 200), 235, np.uint8)
    x[5:15, 10:190:4] = 10  # one dark heading
    boxes = [{"x0": 5.0, "y0": 0.0, "x1": 195.0, "y1": 20.0}]
    for k in range(8):  # and eight blocks that are washed out
        x[25 + 20 * k : 35 + 20 * k, 10:190:4] = 190
        boxes.append({"x0": 5.0, "y0": 22.0 + 20 * k, "x1": 195.0, "y1": 38.0 + 20 * k})
    ink, depth, failing, passed = imaging.judge(x, boxes, 0.0, 90, 0.5)
    assert not passed and failing == pytest.approx(8 / 9) and depth == 45
    assert imaging.judge(x, boxes[:2], 0.0, 90, 0.5)[3] and imaging.judge(x, [], 0.0, 90, 0.5)[2:] == (0.0, True)


def test_jpeg_loses_more_at_lower_quality():
    x = picture().astype(np.float32)
    loss = [float(np.abs(degrade.jpeg(x, np.random.default_rng(0), quality=q)[0] - x).mean()) for q in (90, 50, 10)]
    assert loss[0] < loss[1] < loss[2] and degrade.jpeg(x[:13, :21], np.random.default_rng(0))[0].shape == (13, 21)
