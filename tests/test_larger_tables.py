"""What keeps queries in proportion to their tables: parts of batches, values computed once, plans without shuffles."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewise.functions import geometry as g
from pagewise.functions import text as t
from pagewise.operators import content, degrade, evaluation, imaging, layout
from pagewise.plans import queries as plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_are_mapped_at_once_and_bands_change_nothing(monkeypatch):
    boxes = [{"x0": 5.0 + k, "y0": 9.0 * k, "x1": 60.0 + k, "y1": 9.0 * k + 7} for k in range(9)]
    page = imaging.drawn(90, 120, boxes)
    steps = [s for s in degrade.PRESETS["archive"] if s.name in ("rotation", "wrinkles")]
    steps = tuple(degrade.Step(s.name, 1.0, s.settings) for s in steps)
    x, maps, done = degrade.run_steps(page, steps, imaging._generator(1, "a"))
    one_by_one = degrade.map_page({"regions": [{"bbox": b, "lines": [], "table": None} for b in boxes]}, maps, 0, 0)["regions"]
    assert len(done) == 2 and degrade.map_boxes(boxes, maps) == [r["bbox"] for r in one_by_one]
    assert degrade.map_boxes([], maps) == [] and degrade.map_boxes(boxes, []) == boxes
    monkeypatch.setattr(degrade, "BAND", 1)
    assert (degrade.run_steps(page, steps, imaging._generator(1, "a"))[0] == x).all()
    for p in (page, page[:, :7], page[:1, :1]):
        assert imaging.middle_of(p) == np.median(p)


def test_pages_are_laid_out_a_few_documents_at_a_time(spark, data, monkeypatch):
    b = pa.RecordBatch.from_pydict({"k": list(range(150))})
    assert [p.num_rows for p in content.parts(iter([b, b.slice(0, 0)]))] == [64, 64, 22]
    assert [p["k"][0].as_py() for p in content.parts(iter([b]))] == [0, 64, 128]
    laid = plans.layout_pages(spark, data)
    assert laid.select("index").distinct().count() == plans.template_documents(spark, data).where("n_blocks > 0").count() > 2 * content.AT_ONCE


def test_pictures_are_measured_where_they_are_drawn(spark, data):
    pages = plans._small_pages(spark, data).limit(20)
    one, two = (sorted(df.collect()) for df in (imaging.drawn_features(pages), imaging.features(imaging.rasterize(pages))))
    assert one == two and len(one) == 20
    assert plan(plans.image_features(spark, data)).count("MapInArrow") == 1


def test_drawn_pictures_leave_in_parts(monkeypatch):
    b = pa.RecordBatch.from_pydict({"width": [10, 10, None, 50, 10], "height": [10, 10, 10, 50, 10]})
    monkeypatch.setattr(imaging, "PART_PIXELS", 200)
    assert [p.num_rows for p in imaging._few(b)] == [3, 1, 1] and list(imaging._few(b.slice(0, 0))) == []


def test_detections_of_rows_against_the_column(spark):
    rng = random.Random(7)
    box = lambda: (lambda x, y: (x, y, x + rng.randint(5, 9), y + rng.randint(5, 9)))(*(float(rng.randint(0, 9)) for _ in "xy"))
    groups = [([box() for _ in range(rng.randint(0, 12))], [box() for _ in range(rng.randint(0, 12))]) for _ in range(60)] + [([(0.0, 0.0, 4.0, 4.0)] * 3, [(0.0, 0.0, 4.0, 4.0)] * 4)]
    groups = [x for x in groups if x[0] or x[1]]
    at = lambda x, k: x[k] if k < len(x) else None
    rows = spark.createDataFrame([(i, k, at(r, k), at(p, k)) for i, (r, p) in enumerate(groups) for k in range(max(len(r), len(p)))], f"id int, k int, reference {g.BOX}, prediction {g.BOX}")
    whole = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(groups)], f"id int, r array<{g.BOX}>, p array<{g.BOX}>")
    want = sorted(whole.select("id", evaluation.detection(F.col("r"), F.col("p"), 0.3).alias("d")).select("id", "d.*").collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in (before, "5"):  # groups that go over the ends of batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert sorted(evaluation.detections(rows, "k", threshold=0.3).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert evaluation.detections(rows.limit(0), "k").count() == 0


def test_detection_query_against_the_column(spark, data):
    boxes = plans._boxes(spark, data).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "box"))), lambda x: x["box"]).alias("b"))
    found = boxes.select("l_orderkey", evaluation.detection(F.col("b"), F.transform("b", lambda b, i: g.translate(b, 8.0 * i, 0))).alias("d")).select("l_orderkey", "d.*")
    made = plans.eval_detection(spark, data)
    assert made.columns == found.columns and sorted(made.collect()) == sorted(found.collect())
    assert "aggregate(" not in plan(made)


def test_documents_are_built_a_few_at_a_time(monkeypatch):
    seen = []
    monkeypatch.setattr(content, "AT_ONCE", 2)
    for p in content.parts(iter([pa.RecordBatch.from_pydict({"k": list(range(5))})])):
        seen.append(p["k"].to_pylist())
    assert seen == [[0, 1], [2, 3], [4]]


def test_sentences_are_split_and_not_extracted(spark, data):
    assert "regexp_extract_all" not in plan(plans.sentences(spark, data))
    texts = ["", "a b c", " a  b c. d e f! g h؟ i j\r\nk l m\n\n", "no end of three words\r", "...", "a\x1cb\x1dc.", "﻿a b c؟", None]
    df = spark.createDataFrame([(x,) for x in texts], "s string").select("s", t.sentences(F.col("s")).alias("three"), t.sentences(F.col("s"), 0).alias("any"), t.strip_white(F.col("s")).alias("bare"))
    ends = ".!?؟۔،\n"
    for r in df.collect():
        if r.s is None:
            assert r.three is None and r.any is None
            continue
        pieces, piece = [], ""
        for c in r.s:
            piece += c
            if c in ends:
                pieces, piece = [*pieces, piece], ""
        pieces = [x.strip() for x in pieces + ([piece] if piece else [])]
        assert r.any == pieces and r.three == [x for x in pieces if len(x.split()) >= 3] and r.bare == r.s.strip()
    assert set(t.WHITE_CHARS) == {c for c in map(chr, range(0x110000)) if c.isspace()}


def test_wrapping_reads_a_text_once(spark):
    rng = random.Random(3)
    texts = ["", " 　\n", "x" * 24, "x" * 25 + " y", "a b\x85c \U0001f600" + "\U0001f600" * 30, " ".join("é" * rng.randint(1, 30) for _ in range(2000)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", layout.wrap(F.col("s"), 12).alias("lines"), layout.wrap(F.col("s"), 1).alias("letters"))
    assert "aggregate(" not in plan(df)
    for r in df.collect():
        if texts[r.k] is None:
            assert r.lines is None
            continue
        want, line = [], ""
        for w in (w[i : i + 12] for w in texts[r.k].split() for i in range(0, len(w), 12)):
            if line and len(line) + 1 + len(w) <= 12:
                line += " " + w
            else:
                want += [line] if line else []
                line = w
        assert r.lines == want + ([line] if line else []) and r.letters == list("".join(texts[r.k].split()))


def test_a_page_is_judged_once(spark, data):
    for name in ("gate_verdicts", "gate_reject_rate", "gate_failures"):
        assert plan(plans.queries()[name](spark, data)).count("aggregate(") == 1, name


def test_forms_are_made_of_few_texts_at_a_time(monkeypatch):
    sizes, formed = [], t._formed
    monkeypatch.setattr(t, "_formed", lambda x, form: sizes.append(len(x)) or formed(x, form))
    texts = ["é" * 100, None, "plain", "é"] * 400 + ["é" * 400_000, "", "ö"]
    made = t._in_form("NFC").func(pa.array(texts))
    import unicodedata

    assert made.to_pylist() == [x and unicodedata.normalize("NFC", x) for x in texts]
    assert max(sizes) <= t.FORMED_ROWS and 1 in sizes and sum(sizes) == len(texts)
    assert t._in_form("NFC").func(pa.array([], "string")).to_pylist() == []


def test_places_of_words_without_a_shuffle(spark, data):
    rng = random.Random(5)
    lines = [(i, [rng.choice(["rtl", "ltr", None]) for _ in range(n)], base) for i, (n, base) in enumerate((n, b) for n in (0, 1, 2, 3, 8, 40) for b in ("rtl", "ltr") for _ in range(4))]
    df = spark.createDataFrame(lines, "id int, directions array<string>, base string")
    words = df.select("id", "base", F.posexplode("directions").alias("pos", "direction"))
    want = {(r.id, r.pos): r.place for r in layout.visual_order(words).collect()}
    assert {(r.id, k): p for r in layout.visual_places(df).collect() for k, p in enumerate(r.places)} == want
    assert "Window" not in plan(plans.bidi_order_all(spark, data))


def test_the_values_of_a_gate_stay_in_its_report(spark, data):
    report = plans._gated(spark, data).select("report.*").collect()
    failed = [r for r in report if not r.passed]
    assert failed and len(failed) < len(report) and all(len(r.failures) == 1 and r.failures[0].passed is False and r.failures[0].value is not None for r in failed)
    odd = spark.createDataFrame([("a" * 8,), ("a bcdefg",), ("a b",), (" " * 9,), (None,)], "s string")
    from pagewise.operators import quality

    got = [r[0] for r in odd.select(quality.non_empty_text(F.col("s"))).collect()]
    assert [(r.passed, r.value) for r in got] == [(False, 8), (True, 8), (False, 3), (False, 0), (False, 0)]


def test_marks_are_told_by_their_place_first(spark):
    every = "".join(chr(c) for c in [*range(0x5F0, 0x720), *range(0x8C0, 0x910), 0x41, 0x1F600, 0x10A00])
    df = spark.createDataFrame([(every,), ("no marks",), ("",), (None,)], "s string")
    made = df.select(t.strip_marks_partly(F.col("s"), F.lit(1e-12), F.lit(3)).alias("kept"), t.strip_marks(F.col("s")).alias("stripped"))
    assert [r.kept for r in made.collect()] == [r.stripped for r in made.collect()]
    assert "< ؐ" in plan(made)
