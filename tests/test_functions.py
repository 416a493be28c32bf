import random

import pytest
from pyspark.sql import functions as F

from pagewise.functions import annotations as an
from pagewise.functions import geometry as g
from pagewise.functions import text as t
from pagewise.operators import evaluation, layout, quality, sampling, stats


def one(spark, schema, values, *columns):
    return spark.createDataFrame([values], schema).select(*columns).first()


def column(spark, texts, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


VOCALISED = "كَتَبَ الْوَلَدُ دَرْسَهُ فِي الدَّفْتَرِ"


def test_scripts_and_directions(spark):
    texts = ["مرحبا", "hello", "hello مرحبا", "2024", "", None, "2024 مرحبا", "× 1"]
    assert column(spark, texts, t.script) == ["arabic", "latin", "mixed", "neutral", "neutral", None, "arabic", "latin"]
    assert column(spark, texts, t.direction) == ["rtl", "ltr", "ltr", "ltr", "ltr", None, "rtl", "ltr"]
    assert column(spark, texts, t.is_arabic)[:4] == [True, False, False, False]


def test_normalisation(spark):
    texts = ["  a\t\tb \n c  ", "a  b\n\n c ", "x y　z", "", None]
    assert column(spark, texts, t.collapse_white) == ["a b c", "a b c", "x y z", "", None]
    assert column(spark, texts, lambda c: t.collapse_white(c, True)) == ["a b\nc", "a b\nc", "x y z", "", None]
    policy = t.TextPolicy(strip_marks=True, strip_tatweel=True, unify_alef=True, unify_ya=True, unify_ta_marbuta=True, numerals="western")
    cases = ["أحمد إلى آية على", VOCALISED, "مـــد ٢٠٢٤ ۲۰", "é"]
    once = column(spark, cases, lambda c: t.normalize(c, policy))
    assert once[0] == "احمد الي ايه علي" and once[2] == "مد 2024 20" and once[3] == "é"
    assert column(spark, once, lambda c: t.normalize(c, policy)) == once
    with pytest.raises(ValueError):
        t.numerals(F.lit("1"), "roman")


def test_marks(spark):
    row = one(spark, "x string", (VOCALISED,), t.count_marks(F.col("x")), t.mark_ratio(F.col("x")), t.vocalisation(F.col("x")))
    assert row[0] > 10 and row[1] > 0.4 and row[2] == "full"
    assert column(spark, ["", None, "abc"], t.mark_ratio) == [0.0, None, 0.0]
    for keep in (0.0, 0.4, 1.0):
        (kept,) = column(spark, [VOCALISED], lambda c: t.strip_marks_partly(c, keep, F.lit(3)))
        assert column(spark, [kept], t.strip_marks) == column(spark, [VOCALISED], t.strip_marks)
        assert keep != 1.0 or kept == VOCALISED


def test_sentences_and_wrapping(spark):
    (found,) = column(spark, ["One two three. Too short. four five six seven! a b c"], t.sentences)
    assert found == ["One two three.", "four five six seven!", "a b c"]
    rng = random.Random(1)
    texts = [" ".join("x" * rng.randint(1, 30) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    for text, lines in zip(texts, column(spark, texts, lambda c: layout.wrap(c, 12))):
        assert all(0 < len(x) <= 12 for x in lines) and "".join(lines).replace(" ", "") == text.replace(" ", "")
        words, want, line = [w[i : i + 12] for w in text.split() for i in range(0, len(w), 12)], [], ""
        for w in words:
            if line and len(line) + 1 + len(w) <= 12:
                line += " " + w
            else:
                want += [line] if line else []
                line = w
        assert lines == want + ([line] if line else [])


def test_boxes(spark):
    a, b = g.box(10, 20, 0, 5), g.box(5, 5, 15, 20)
    row = one(spark, "x int", (1,), a.alias("a"), g.iou(a, b), g.intersects(a, g.box(10, 5, 20, 20)), g.contains(g.box(0, 0, 30, 30), a), g.as_int(g.box(0.5, 0.5, 1.5, 1.2)), g.clip(g.box(-10, -10, 150, 50), 0, 0, 100, 100).alias("c"), g.as_xywh(a))
    assert tuple(row[0]) == (0, 5, 10, 20) and row[1] == pytest.approx(75 / 225) and row[2] is False and row[3] is True
    assert row[4] == [0, 0, 2, 2] and tuple(row.c) == (0, 0, 100, 50) and row[6] == [0, 5, 10, 15]
    with pytest.raises(Exception, match="positive"):
        one(spark, "x int", (1,), g.normalized(a, F.lit(0), F.lit(5)))


def table(rows, cols, cells, header=False):
    made = [{"row": r, "col": c, "text": x, "row_span": rs, "col_span": cs, "is_header": header and r == 0, "bbox": None} for r, c, x, rs, cs in cells]
    return {"rows": rows, "cols": cols, "has_header_row": header, "cells": made}


def test_tables(spark):
    def all_of(value):
        x = F.col("x")
        return one(spark, f"x {an.TABLE}", (value,), an.table_otsl(x), an.table_html(x), an.table_markdown(x))

    grid = all_of(table(2, 2, [(0, 0, "h", 1, 1), (0, 1, "h<", 1, 1), (1, 0, "A", 1, 1), (1, 1, "42", 1, 1)], True))
    assert grid[0] == "fcel fcel nl fcel fcel nl"
    assert grid[1] == "<table><tr><th>h</th><th>h&lt;</th></tr><tr><td>A</td><td>42</td></tr></table>"
    assert grid[2] == "| h | h< |\n| --- | --- |\n| A | 42 |"
    assert all_of(table(1, 3, [(0, 0, "w", 1, 2), (0, 2, "x", 1, 1)]))[0] == "fcel lcel fcel nl"
    assert all_of(table(2, 1, [(0, 0, "t", 2, 1)]))[0] == "fcel nl ucel nl"
    assert all_of(table(1, 2, [(0, 0, "t", 1, 1), (0, 1, "", 1, 1)]))[0] == "fcel ecel nl"
    assert all_of(table(2, 2, [(0, 0, "t", 2, 2)]))[0] == "fcel lcel nl ucel xcel nl"


def region(kind, text, order=0, box=(0, 0, 10, 10)):
    b = dict(zip(("x0", "y0", "x1", "y1"), map(float, box)))
    lines = [{"text": x, "bbox": b, "direction": "ltr", "words": [], "baseline": None, "polygon": None} for x in text.split("\n")] if text else []
    return {"type": kind, "bbox": b, "reading_order": order, "lines": lines, "table": None, "attributes": None}


def page(*regions):
    return {"width": 100, "height": 100, "direction": "ltr", "regions": list(regions), "attributes": None}


def test_pages(spark):
    made = page(region("paragraph", "Body", 2), region("title", "Title", 0), region("heading", "Section", 1))
    x = F.col("x")
    row = one(spark, f"x {an.PAGE}", (made,), an.page_markdown(x), an.page_text(x), an.page_html(x))
    assert row[0] == "# Title\n\n## Section\n\nBody" and row[1] == "Title\nSection\nBody" and row[2] == "<h1>Title</h1>\n<h2>Section</h2>\n<p>Body</p>"
    row = one(spark, f"x {an.PAGE}", (page(region("list", "one"), region("separator", "", 1)),), an.page_markdown(x))
    assert row[0] == "- one\n\n---"
    far = page(region("paragraph", "a", 0, (-10, -10, 150, 50)), region("paragraph", "b", 1, (200, 200, 300, 300)))
    (cut,) = one(spark, f"x {an.PAGE}", (far,), an.clipped(x))
    assert [tuple(r.bbox) for r in cut.regions] == [(0, 0, 100, 50)]
    (back,) = one(spark, f"x {an.PAGE}", (made,), an.from_json(an.to_json(x)))
    assert back.asDict(True)["regions"][0]["lines"][0]["text"] == "Body" and back.direction == "ltr"
    with pytest.raises(Exception, match="unknown region type"):
        one(spark, "x string", ('{"width":1,"height":1,"regions":[{"type":"poster"}]}',), an.from_json(F.col("x")))


def test_reading_order(spark):
    boxes = [region("paragraph", "below", 0, (0, 50, 10, 60)), region("paragraph", "right", 0, (50, 0.01, 60, 10)), region("paragraph", "left", 0, (0, 0, 10, 10))]
    for direction, want in (("ltr", ["left", "right", "below"]), ("rtl", ["right", "left", "below"])):
        (got,) = one(spark, f"x {an.PAGE}", (page(*boxes),), an.with_reading_order(F.col("x")["regions"], direction))
        assert [r.lines[0].text for r in got] == want and [r.reading_order for r in got] == [0, 1, 2]


def test_edit_distances(spark):
    pairs = [("0123456789", "012345678x", 0.1), ("abc", "", 1.0), ("", "", 0.0), ("", "x", 1.0), ("a  b\nc", "a b c", 0.0)]
    df = spark.createDataFrame(pairs, "r string, h string, v double")
    for row in df.select("v", evaluation.cer(F.col("r"), F.col("h")).alias("cer"), evaluation.similarity(F.col("r"), F.col("h")).alias("s")).collect():
        assert row.cer == pytest.approx(row.v) and 0 <= row.s <= 1
    row = one(spark, "r string, h string", ("one two three", "one too three"), evaluation.wer(F.col("r"), F.col("h")))
    assert row[0] == pytest.approx(1 / 3)
    row = one(spark, "a array<string>, b array<string>", (["a", "b"], ["a", "c"]), evaluation.token_distance(F.col("a"), F.col("b")))
    assert row[0] == 1


def test_table_similarity(spark):
    a, other = table(1, 2, [(0, 0, "ab", 1, 1), (0, 1, "cd", 1, 1)]), table(1, 2, [(0, 0, "xx", 1, 1), (0, 1, "yy", 1, 1)])
    df = spark.createDataFrame([(a, a), (a, other), (a, None)], f"r {an.TABLE}, h {an.TABLE}")
    same, wrong, null = (r[0] for r in df.select(evaluation.table_similarity(F.col("r"), F.col("h"))).collect())
    assert (same, null) == (1.0, 0.0) and 0.4 <= wrong <= 0.6


def test_detection_against_a_loop(spark):
    def area(b):
        return max(0, b[2] - b[0]) * max(0, b[3] - b[1])

    def iou(a, b):
        i = area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))
        return i / (area(a) + area(b) - i) if i else 0.0

    rng = random.Random(4)
    box = lambda: (lambda x, y: (x, y, x + rng.randint(5, 20), y + rng.randint(5, 20)))(rng.randint(0, 20), rng.randint(0, 20))
    rows = [([box() for _ in range(rng.randint(0, 5))], [box() for _ in range(rng.randint(0, 5))]) for _ in range(40)]
    df = spark.createDataFrame([(i, [tuple(map(float, b)) for b in r], [tuple(map(float, b)) for b in p]) for i, (r, p) in enumerate(rows)], f"i int, r array<{g.BOX}>, p array<{g.BOX}>")
    got = {x.i: x.d for x in df.select("i", evaluation.detection(F.col("r"), F.col("p"), 0.3).alias("d")).collect()}
    for i, (r, p) in enumerate(rows):
        free, tp = list(r), 0
        for b in p:
            best = max(free, key=lambda a: iou(a, b), default=None)
            if best is not None and iou(best, b) > 0 and iou(best, b) >= 0.3:
                free.remove(best)
                tp += 1
        assert (got[i].tp, got[i].fp, got[i].fn) == (tp, len(p) - tp, len(r) - tp)


def test_gate(spark):
    bad = page(region("paragraph", "enough text here", 0, (0, 0, 50, 30)), region("paragraph", "and over it", 1, (0, 0, 50, 28)))
    x = F.col("x")
    row = one(spark, f"x {an.PAGE}", (bad,), quality.check([quality.non_empty_text(an.page_text(x)), quality.boxes_inside(x), quality.no_overlaps(x), quality.legible_lines(x)], fail_fast=False))
    assert row[0].passed is False and [f.validator for f in row[0].failures] == ["NoOverlappingRegions"]
    small = page(region("paragraph", "enough text here", 0, (0, 0, 50, 4)), region("paragraph", "off the page", 1, (0, 50, 150, 60)))
    row = one(spark, f"x {an.PAGE}", (small,), quality.check([quality.boxes_inside(x), quality.legible_lines(x)]))
    assert [f.validator for f in row[0].failures] == ["BoxesInsidePage"]
    rates = spark.createDataFrame([("a", 0.7)], "shard string, rate double")
    with pytest.raises(Exception, match="rejection rate"):
        quality.guarded(rates).collect()


def test_sampling(spark):
    seed = one(spark, "i bigint", (8412,), sampling.sample_seed(1234, F.col("i")), sampling.sample_seed(None, F.lit(0)))
    assert tuple(seed) == (812653330, 0)
    plan = [tuple(r) for r in sampling.plan_shards(spark, 0, 7, 3).orderBy("shard").collect()]
    assert plan == [(0, 0, 3), (1, 3, 6), (2, 6, 7)]
    assert [tuple(r)[1:] for r in sampling.plan_shards(spark, 10, 4, 2).orderBy("shard").collect()] == [(10, 12), (12, 14)]
    assert sampling.effective_workers(12, 400, 250) == 2
    with pytest.raises(ValueError):
        sampling.weighted_choice(F.lit(0.5), {"a": 0})
    df = spark.range(500).select(sampling.code_field(F.lit(1), F.col("id")).alias("c"), sampling.amount_field(F.lit(1), F.col("id")).alias("a"), sampling.weighted_choice(t.uniform(F.lit(1), F.col("id")), {"x": 3, "y": 1, "z": 0}).alias("w")).cache()
    assert df.where(~F.col("c").rlike(r"^[A-HJ-NP-Z]{2,4}[-/ .]\d{4,9}$") | ~F.col("a").rlike(r"^[\d,]+\.\d\d [A-Z]{3}$")).count() == 0
    assert {r.w for r in df.collect()} == {"x", "y"}


def test_statistics(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,)], "v double")
    assert {r.fraction: r.value for r in stats.nearest_rank(df, "v").collect()} == {0.05: 10.0, 0.5: 30.0, 0.95: 40.0}
    assert stats.nearest_rank(df.limit(0), "v").count() == 0
    words = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)], "p int, w string")
    assert [r.w for r in stats.most_common(words, "w", "p").collect()] == ["b", "a", "c"]
    assert stats.alphabet(spark.createDataFrame([("ab ab",)], "text string")).count() == 3


def test_word_order(spark):
    words = ["قال", "A", "B", "2024", "مرحبا"]
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "id int, pos int, word string").withColumns({"direction": t.strong_direction(F.col("word")), "base": F.lit("rtl")})
    assert [r.word for r in layout.visual_order(df).orderBy("place").collect()] == ["مرحبا", "A", "B", "2024", "قال"]
