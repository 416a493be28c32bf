"""Content, layout, sinks and pictures against their rules."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewise.functions import annotations as an
from pagewise.functions import text as t
from pagewise.operators import content, pages
from pagewise.sources import sinks

LATIN = ["One small step is taken today.", "Seven men went out to mow a meadow.", "Rain fell on the quiet harbour all night long."]
ARABIC = ["ذهب الولد الى البيت الكبير.", "قرأت كتابا جديدا في المكتبة اليوم.", "تشرق الشمس كل صباح على المدينة."]


def test_genres_follow_their_recipes(spark):
    sources = spark.createDataFrame([(i, (LATIN, ARABIC)[i % 2] if i else []) for i in range(300)], "index bigint, sentences array<string>")
    rows = {r["index"]: r for r in content.documents(sources, 4).collect()}
    assert rows[0].blocks == [] and {r.template for r in rows.values()} == set(content.GENRES)
    assert rows == {r["index"]: r for r in content.documents(sources.repartition(5), 4).collect()}
    first = {"article": "title", "report": "header", "letter": "paragraph", "form": "title", "invoice": "title", "paper": "title", "newspaper": "header", "contents": "title", "slide": "title", "notes": "heading"}
    for i, r in rows.items():
        if i:
            kinds = [b.type for b in r.blocks]
            assert kinds[0] == first[r.template] and r.direction == ("ltr", "rtl")[i % 2]
            assert {"report": "table", "invoice": "table", "paper": "formula", "form": "key_value", "slide": "list", "letter": "separator"}.get(r.template, kinds[0]) in kinds
            for b in r.blocks:
                if b.table:
                    assert len(b.table.cells) == b.table.rows * b.table.cols and b.table.cells[0].is_header
                if b.type == "chart":
                    data = json.loads(b.attributes["chart"])
                    assert data["type"] in content.CHARTS and all(len(s["values"]) == len(data["categories"]) for s in data["series"]) and all(5 <= v <= 100 for s in data["series"] for v in s["values"])
            assert ("handwritten" in r.attributes) == (r.template == "notes")
    assert {r.template for r in content.documents(sources, 4, {"form": 1, "letter": 0, "unknown": 5}).collect()} == {"form"}
    shares = [r.template for r in rows.values()]
    assert shares.count("article") > shares.count("slide")


def test_builder_and_registry():
    with pytest.raises(ValueError):
        content.Builder().add("nothing")
    with pytest.raises(ValueError):
        content.build("nothing", LATIN, 1)
    ragged = content.table_of([["a", "b"], ["c"]])
    assert [c["text"] for c in ragged["cells"]] == ["a", "b", "c", ""]

    @content.genre(-2, "poem")
    def poem(b, s, f, rng):
        b.title(s.title()).quote(s.sentence())

    try:
        assert content.GENRES["poem"][0] == 0.0 and [b["type"] for b in content.build("poem", LATIN, 3).blocks] == ["title", "quote"]
    finally:
        del content.GENRES["poem"]


def test_formulas_and_fields():
    node = ("row", ("frac", "a", ("sup", "x", "2")), "+", ("sum", ("sqrt", "k"), "i=1", "n"))
    assert content.latex(node) == r"\frac{a}{x^{2}} + \sum_{i=1}^{n} \sqrt{k}"
    w, above, below = content.measure(node, 20)
    assert w > content.measure("a", 20)[0] and above > 0.75 * 20 and below >= 0.25 * 20
    rng = random.Random(1)
    for _ in range(200):
        text = content.latex(content.sample_formula(rng))
        assert text and text.count("{") == text.count("}")
    s, f = content.Sentences(LATIN, rng), content.Fields(rng, "arabic_indic")
    for _ in range(50):
        assert not any(c in "0123456789" for c in f.any())
        phrase, fragment = s.phrase(3), s.fragment()
        assert any(phrase in x for x in LATIN) and any(fragment in x for x in LATIN)
        assert len(s.title().split()) <= 7 and 1 <= len(s.contextless().split()) <= 4


def check(page):
    inside = lambda a, b: a["x0"] >= b["x0"] - 1e-6 and a["y0"] >= b["y0"] - 1e-6 and a["x1"] <= b["x1"] + 1e-6 and a["y1"] <= b["y1"] + 1e-6
    whole = pages.box(0, 0, page["width"], page["height"])
    assert [r["reading_order"] for r in page["regions"]] == list(range(len(page["regions"])))
    for r in page["regions"]:
        assert inside(r["bbox"], whole), r["type"]
        for x in r["lines"]:
            assert [w["text"] for w in x["words"]] == x["text"].split()
            assert all(inside(w["bbox"], x["bbox"]) for w in x["words"])
            if r["type"] != "chart":
                assert inside(x["bbox"], r["bbox"])


@pytest.mark.parametrize("direction,sentences", [("ltr", LATIN), ("rtl", ARABIC)])
def test_layout_loses_nothing(direction, sentences):
    for name in content.GENRES:
        for seed in range(6):
            blocks = content.build(name, sentences, seed).blocks
            spec = pages.Spec.from_paper("a4", 110, 15, columns=1 + seed % 2, direction=direction, header=40.0, footer=40.0)
            made = pages.lay_out(blocks, spec, pages.Typography(20.0), direction, "{page}", max_pages=40)
            for k, page in enumerate(made.pages):
                check(page)
                (number,) = [r for r in page["regions"] if r["type"] == "page_number"]
                assert number["lines"][0]["text"] == str(k + 1)
            drawn = [w for p in made.pages for r in p["regions"] for x in r["lines"] if r["type"] not in ("page_number", "chart", "header") for w in x["text"].split()]
            want = [w for k, b in enumerate(blocks) if k not in made.dropped and b["type"] not in ("chart", "header") for text in ([c["text"] for c in b["table"]["cells"]] if b["table"] else pages._texts(b)) for w in text.split()]
            assert "".join(drawn).replace("•", "") == "".join(want).replace("•", "")


def test_columns_bands_and_errors():
    spec = pages.Spec.from_paper("a4", 150, 20, columns=2, gap=20.0, direction="rtl")
    assert (spec.width, spec.height) == (1240, 1754)
    first, second = spec.column_boxes()
    assert first["x0"] > second["x0"] and abs(first["x0"] - second["x1"] - 20) < 1e-6
    half = spec.scaled(0.5)
    assert (half.width, half.height, half.dpi) == (620, 877, 75)
    for bad in (dict(paper="a99"), dict(paper="a4", columns=0), dict(paper="id_card", margin_mm=60)):
        with pytest.raises(ValueError):
            pages.Spec.from_paper(**bad)


def test_paragraphs_split_and_tables_move():
    long = content.Builder().paragraph(" ".join(LATIN * 60)).blocks
    spec = pages.Spec(500, 400, margin=40)
    made = pages.lay_out(long, spec, pages.Typography(20.0), max_pages=50)
    assert len(made.pages) > 2 and not made.dropped
    tall = content.Builder().paragraph("Short text here.").table([["x"]] * 40).paragraph("After it all.").blocks
    assert pages.lay_out(tall, spec, pages.Typography(20.0)).dropped == [1]
    few = pages.lay_out(long, spec, pages.Typography(20.0), max_pages=1)
    assert few.dropped == [0] and len(few.pages) == 1


def test_tables_shrink_wrap_and_mirror():
    table = content.table_of([["name", "value"], ["a long text that has to wrap in its cell " * 3, "7"]])
    for direction in ("ltr", "rtl"):
        out, lines, wide, tall = pages.table_layout(table, 10, 20, 200, 16, 20, direction)
        a, b, c, d = (x["bbox"] for x in out["cells"])
        assert wide <= 200 + 17 and (a["x0"] < b["x0"]) == (direction == "ltr") and abs(max(a["x1"], b["x1"]) - 10 - wide) < 1.01 + (direction == "rtl")
        assert c["y1"] - c["y0"] > a["y1"] - a["y0"] and c["y0"] == a["y1"] and tall > 60
        assert sum(len(x["words"]) for x in lines) == sum(len(x["text"].split()) for x in table["cells"])


def test_words_are_drawn_from_the_right_in_rtl():
    line = pages.line_at("ذهب الولد abc def الى", 0, 400, 0, 20, 24, "rtl")
    x = [w["bbox"]["x0"] for w in line["words"]]
    assert x[0] > x[1] > x[3] > x[2] > x[4] and line["bbox"]["x1"] == 400
    assert pages.visual(["a", "1", "b"], "ltr") == [0, 1, 2]
    assert pages.pie_angles([1, 1, 2]) == [(-90, 0), (0, 90), (90, 270)]


def _pages(spark):
    sources = spark.createDataFrame([(i, (LATIN, ARABIC)[i % 2]) for i in range(12)], "index bigint, sentences array<string>")
    laid = pages.layout(content.documents(sources, 9), max_pages=2)
    prov = F.struct(F.col("index").alias("seed"), "template").alias("provenance")
    return laid.select((F.col("index") / 5).cast("int").alias("shard"), F.format_string("%06d-%d", "index", "page_no").alias("id"), "page", prov)


def test_every_sink(spark, tmp_path):
    df = _pages(spark).cache()
    n, rows = df.count(), {r.id: r for r in df.collect()}
    for name in sinks.sink_names():
        folder = f"file://{tmp_path}/{name}"
        assert {r.shard for r in sinks.write(name, df, folder).collect()} == {0, 1, 2}
    read = lambda name: [json.loads(x) for k in range(3) for x in open(f"{tmp_path}/{name.format(k)}", encoding="utf-8")]
    records, chats = read("jsonl/annotations-{:05d}.jsonl"), read("chat/chat-{:05d}.jsonl")
    assert {r["id"] for r in records} == set(rows) and len(records) == len(chats) == n
    by_id = {r["id"]: r for r in records}
    for c in chats:
        user, answer = c["messages"]
        assert [p["type"] for p in user["content"]] == ["image", "text"] and "text" not in user["content"][0]
        assert answer["content"] == [{"type": "text", "text": by_id[c["id"]]["markdown"]}] and c["image"] == f"images/{c['id']}.png"
    for k in range(3):
        coco = json.load(open(f"{tmp_path}/coco/instances-{k:05d}.json", encoding="utf-8"))
        assert [i["id"] for i in coco["images"]] == list(range(1, len(coco["images"]) + 1)) and [a["id"] for a in coco["annotations"]] == list(range(1, len(coco["annotations"]) + 1))
        name = {c["id"]: c["name"] for c in coco["categories"]}
        file = {i["id"]: i["file_name"][7:-4] for i in coco["images"]}
        got = [(file[a["image_id"]], name[a["category_id"]], a["text"]) for a in coco["annotations"]]
        want = []
        for i in sorted(i for i, r in rows.items() if r.shard == k):
            for r in rows[i].page.regions:
                text = "\n".join(x.text for x in r.lines)
                want.append((i, r.type, text))
                for x in r.lines:
                    want += [(i, "line", x.text), *((i, "word", w.text) for w in x.words)]
        assert got == want
        assert all(a["iscrowd"] == 0 and a["segmentation"] == [] and abs(a["area"] - a["bbox"][2] * a["bbox"][3]) <= 0.01 * (a["bbox"][2] + a["bbox"][3] + 1) for a in coco["annotations"])
    labels = [x.rstrip("\n").split("\t") for k in range(3) for x in open(f"{tmp_path}/paddleocr/rec_label-{k:05d}.txt", encoding="utf-8")]
    assert sorted(x[1] for x in labels) == sorted(x.text for r in rows.values() for g in r.page.regions for x in g.lines)
    with pytest.raises(ValueError):
        sinks.write("nothing", df, "file:///nowhere")
    df.unpersist()


def test_pictures_crops_and_image_folder(spark, tmp_path):
    x = np.random.default_rng(0).integers(0, 255, (40, 60)).astype(np.uint8)
    assert (sinks.read_png(sinks.png(x)) == x).all() and sinks.read_png(b"no picture") is None and sinks.read_png(sinks.png(x)[:60]) is None
    page = lambda *boxes: {"width": 60, "height": 40, "direction": "ltr", "regions": [{"type": "paragraph", "bbox": pages.box(0, 0, 60, 40), "reading_order": 0, "lines": [{"text": s, "bbox": b, "direction": "ltr", "words": [], "baseline": None, "polygon": None} for s, b in boxes], "table": None, "attributes": None}], "attributes": None}
    made = page(("a", pages.box(-5, 2, 20, 12)), (" ", pages.box(0, 0, 9, 9)), ("b", pages.box(30, 20, 31, 30)), ("c", pages.box(10, 20, 60, 50)))
    df = spark.createDataFrame([("p", 60, 40, x.tobytes(), made)], f"id string, width int, height int, pixels binary, page {an.PAGE}")
    crops = {r.id: sinks.read_png(bytes(r.image)) for r in sinks.crop_pictures(df).collect()}
    assert set(crops) == {"p_0000", "p_0003"} and (crops["p_0000"] == x[2:12, 0:20]).all() and (crops["p_0003"] == x[20:40, 10:60]).all()
    assert [r.label for r in sinks.recognition_labels(df).orderBy("crop_id").collect()] == ["line_crops/p_0000.png\ta", "line_crops/p_0003.png\tc"]
    folder = f"file://{tmp_path}/img"
    assert sinks.write_images(sinks.encode_png(df), folder).first() == ("p", "images/p.png")
    (tmp_path / "img/images/broken.png").write_bytes(b"x")
    (tmp_path / "img/images/other.txt").write_bytes(b"x")
    (row,) = sinks.read_images(spark, folder).collect()
    assert row.id.endswith("p.png") and bytes(row.pixels) == x.tobytes()
    assert sinks.read_images(spark, folder, limit=1).count() == 1


def test_marks_policy(spark):
    text = "كَتَبَ الوَلَدُ"
    df = spark.createDataFrame([(i, text) for i in range(60)] + [(99, "no marks"), (98, None)], "i int, t string")
    got = lambda p: {r.i: r.a for r in df.select("i", t.apply_marks(F.col("t"), p, F.col("i")).alias("a")).collect()}
    assert got(t.MarkPolicy())[3] == (text, 1.0) and got(t.MarkPolicy("strip"))[3].kept == 0.0 and len(got(t.MarkPolicy("strip"))[3].text) == 9
    some = got(t.MarkPolicy("partial", (0.6, 0.2)))
    assert all(0.2 <= some[i].kept <= 0.6 and set(some[i].text) <= set(text) for i in range(60)) and some[99] == ("no marks", 1.0) and some[98].text is None
    mixed = [got(t.MarkPolicy("mixed"))[i].kept for i in range(60)]
    assert {0.0, 1.0} < set(mixed) and mixed.count(0.0) > mixed.count(1.0)
    with pytest.raises(ValueError):
        t.MarkPolicy("nothing")
