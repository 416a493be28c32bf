"""Page layout: documents of content blocks poured into columns and pages, as boxes of regions, lines, words and cells.

Text flows from column to column and from page to page; prose may split, tables, figures, charts and formulas move
whole, and one line of a paragraph never stands alone at the foot of a column. What fits on no page is dropped and
reported. Widths come from a measure of characters, so no font file is needed; another measure can be given.
"""

from __future__ import annotations

import json
import random
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import annotations as an
from . import content
from .sampling import PAPERS_MM

Measure = Callable[[str, float], float]
Box = dict[str, float]


def box(x0: float, y0: float, x1: float, y1: float) -> Box:
    return {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}


def around(boxes: list[Box]) -> Box:
    """The box around some boxes, one at least."""
    return box(min(b["x0"] for b in boxes), min(b["y0"] for b in boxes), max(b["x1"] for b in boxes), max(b["y1"] for b in boxes))


# measures and typography


@lru_cache(maxsize=1 << 16)
def _em(char: str) -> float:
    kind = unicodedata.category(char)
    if kind[0] == "M" or kind == "Cf":
        return 0.0
    if unicodedata.east_asian_width(char) in "WF":
        return 1.0
    return 0.28 if char in " .,:;'|!ilj،" else 0.66 if kind == "Lu" else 0.52


def advance(text: str, size: float) -> float:
    """Width of a text at a size: marks take none, wide characters a whole square."""
    return size * sum(map(_em, text))


#: Of each role: size by that of the body, weight, space before and after by that of the body.
ROLES: dict[str, tuple[float, str, float, float]] = {
    "title": (2.0, "bold", 0.4, 0.8), "heading": (1.4, "bold", 0.9, 0.4), "caption": (0.85, "regular", 0.2, 0.7), "header": (0.85, "regular", 0, 0), "footer": (0.8, "regular", 0, 0),
    "page_number": (0.85, "regular", 0, 0), "quote": (1.0, "light", 0.4, 0.4), "list": (1.0, "regular", 0.2, 0.4), "key_value": (0.95, "regular", 0.1, 0.2), "table": (0.9, "regular", 0.4, 0.6),
    "code": (0.9, "regular", 0.4, 0.4), "formula": (1.05, "regular", 0.5, 0.5),
}


@dataclass(frozen=True)
class Typography:
    """Sizes, spacing and ink of a document."""

    body: float = 24.0
    line_spacing: float = 1.0
    handwritten: bool = False
    ink: tuple[int, int, int] = (20, 20, 24)
    title: float = 2.0
    heading: float = 1.4

    def role(self, kind: str) -> tuple[float, str, float, float]:
        """Size, weight, space before and after of a role; unknown ones are set as the body."""
        factor, weight, before, after = ROLES.get(kind, (1.0, "regular", 0.0, 0.5))
        factor = {"title": self.title, "heading": self.heading}.get(kind, factor)
        return self.body * factor, weight, self.body * before, self.body * after

    def line_height(self, size: float) -> float:
        return max(1.0, round(1.25 * size) * self.line_spacing)

    @classmethod
    def sample(cls, rng: random.Random, sizes: tuple[int, int] = (18, 30), handwritten: bool = False) -> "Typography":
        spacing = rng.uniform(1.05, 1.45) if handwritten else rng.uniform(0.9, 1.15)
        ink = tuple(rng.randint(0, 60) for _ in range(3)) if not handwritten else (rng.randint(10, 40), rng.randint(20, 60), rng.randint(90, 150))
        return cls(rng.uniform(*sorted(sizes)), spacing, handwritten, ink, rng.uniform(1.8, 2.4), rng.uniform(1.25, 1.6))


@dataclass(frozen=True)
class Spec:
    """A page in pixels with its margins, columns and bands."""

    width: int
    height: int
    dpi: int = 150
    margin: int = 80
    columns: int = 1
    gap: float = 24.0
    direction: str = "ltr"
    header: float = 0.0
    footer: float = 0.0

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0:
            raise ValueError("a page needs a size")
        if self.columns < 1:
            raise ValueError("a page needs a column")
        if self.width - 2 * self.margin - self.gap * (self.columns - 1) < self.columns or self.height - 2 * self.margin - self.header - self.footer < 1:
            raise ValueError("margins and bands leave no room")

    @classmethod
    def from_paper(cls, paper: str, dpi: int = 150, margin_mm: float = 20, landscape: bool = False, **more) -> "Spec":
        if paper not in PAPERS_MM:
            raise ValueError(f"unknown paper {paper!r}; one of {', '.join(sorted(PAPERS_MM))}")
        px = lambda mm: max(1, round(mm / 25.4 * dpi))
        w, h = (px(v) for v in PAPERS_MM[paper])
        return cls(*((h, w) if landscape else (w, h)), dpi, px(margin_mm), **more)

    def scaled(self, factor: float) -> "Spec":
        n = lambda v: max(1, round(v * factor))
        return replace(self, width=n(self.width), height=n(self.height), dpi=n(self.dpi), margin=round(self.margin * factor), gap=self.gap * factor, header=self.header * factor, footer=self.footer * factor)

    def bands(self) -> tuple[Box, Box]:
        """The boxes of the running header and footer."""
        left, right = self.margin, self.width - self.margin
        return box(left, self.margin, right, self.margin + self.header), box(left, self.height - self.margin - self.footer, right, self.height - self.margin)

    def column_boxes(self) -> list[Box]:
        """Columns in the order in which they are read."""
        wide = (self.width - 2 * self.margin - self.gap * (self.columns - 1)) / self.columns
        top, low = self.margin + self.header, self.height - self.margin - self.footer
        made = [box(self.margin + k * (wide + self.gap), top, self.margin + k * (wide + self.gap) + wide, low) for k in range(self.columns)]
        return made[::-1] if self.direction == "rtl" else made


DEFAULTS = {"papers": {"a4": 4.0, "a5": 1.0, "letter": 1.0}, "dpi": (110, 200), "margin_mm": (12, 28), "columns": {1: 3.0, 2: 1.0}, "landscape": 0.05, "header": 0.35, "footer": 0.45}


def sample_spec(rng: random.Random, direction: str, body: float, **given) -> Spec:
    """A page drawn from weights and ranges; see ``DEFAULTS``."""
    c = DEFAULTS | given
    pick = lambda w: rng.choices(list(w), [max(0.0, v) for v in w.values()])[0]
    dpi = rng.randint(*c["dpi"])
    bands = {k: 2 * body * 0.85 if rng.random() < c[k] else 0.0 for k in ("header", "footer")}
    spec = dict(paper=pick(c["papers"]), dpi=dpi, margin_mm=rng.uniform(*c["margin_mm"]), landscape=rng.random() < c["landscape"], columns=int(pick(c["columns"])), gap=max(12.0, 0.15 * dpi))
    return Spec.from_paper(**spec, direction=direction, **bands)


# text


def wrap(text: str, width: float | None, size: float, measure: Measure = advance) -> list[str]:
    """Greedy first fit of words; a word that is too wide is cut; without a width all is one line. Nothing is lost."""
    words = text.split()
    if not width or width <= 0:
        return [" ".join(words)] if words else []
    space, lines, line, used = measure(" ", size), [], [], 0.0
    for word in words:
        for part in _pieces(word, width, size, measure):
            w = measure(part, size)
            if line and used + space + w > width:
                lines.append(" ".join(line))
                line, used = [], 0.0
            used += w + (space if line else 0.0)
            line.append(part)
    return [*lines, " ".join(line)] if line else lines


def _pieces(word: str, width: float, size: float, measure: Measure) -> list[str]:
    if measure(word, size) <= width:
        return [word]
    out, part = [], ""
    for c in word:
        if part and measure(part + c, size) > width:
            out.append(part)
            part = ""
        part += c
    return [*out, part]


def _strong(word: str) -> str | None:
    for c in word:
        kind = unicodedata.bidirectional(c)
        if kind in ("R", "AL"):
            return "rtl"
        if kind == "L":
            return "ltr"
    return None


def visual(words: list[str], base: str) -> list[int]:
    """The places of words in the order in which they are drawn from the left; words without direction go on with the run before."""
    runs: list[tuple[str, list[int]]] = []
    now = base
    for k, w in enumerate(words):
        now = _strong(w) or now
        if not runs or runs[-1][0] != now:
            runs.append((now, []))
        runs[-1][1].append(k)
    if base == "rtl":
        runs.reverse()
    return [k for way, part in runs for k in (reversed(part) if way == "rtl" else part)]


def line_at(text: str, x0: float, x1: float, top: float, size: float, height: float, direction: str, align: str = "natural", measure: Measure = advance) -> dict:
    """A line of words set between two edges; words stand in the order of reading, their boxes where they are drawn."""
    words, space = text.split(), measure(" ", size)
    widths = [measure(w, size) for w in words]
    whole = sum(widths) + space * max(0, len(words) - 1)
    x = x0 + (x1 - x0 - whole) / 2 if align == "center" else x1 - whole if align == "right" or (align == "natural" and direction == "rtl") else x0
    boxes: list[Box | None] = [None] * len(words)
    at = x
    for k in visual(words, direction):
        boxes[k] = box(at, top, at + widths[k], top + height)
        at += widths[k] + space
    made = [{"text": w, "bbox": b, "polygon": None} for w, b in zip(words, boxes)]
    return {"text": " ".join(words), "bbox": box(x, top, x + whole, top + height), "direction": direction, "words": made, "baseline": top + 0.8 * height, "polygon": None}


# blocks


def _region(kind: str, bbox: Box, lines: list[dict], attributes: dict[str, str], table: dict | None = None) -> dict:
    return {"type": kind, "bbox": bbox, "reading_order": 0, "lines": lines, "table": table, "attributes": list(attributes.items()) or None}


def table_layout(table: dict, x: float, top: float, width: float, size: float, height: float, direction: str, padding: float = 8.0, border: float = 1.0, measure: Measure = advance) -> tuple[dict, list[dict], float, float]:
    """A table with the boxes of its cells, the lines in them, its width and its height.

    Columns are as wide as their widest cell without a span, and shrink in proportion if the table is too wide; cells
    wrap, rows are as high as their highest cell, and columns run from the right where text does.
    """
    inner = 2 * padding + border
    wide = [inner] * table["cols"]
    for c in table["cells"]:
        if c["col_span"] == 1:
            wide[c["col"]] = max(wide[c["col"]], measure(" ".join(c["text"].split()), size) + inner)
    if sum(wide) > width:
        wide = [max(inner, w * width / sum(wide)) for w in wide]
    texts = [wrap(c["text"], max(1.0, sum(wide[c["col"] : c["col"] + c["col_span"]]) - inner), size, measure) for c in table["cells"]]
    high = [height + inner] * table["rows"]
    for c, lines in zip(table["cells"], texts):
        high[c["row"]] = max(high[c["row"]], height * max(1, len(lines)) + inner)
    total, tall = sum(wide) + border, sum(high) + border
    xs, ys = [0.0], [0.0]
    for w in wide:
        xs.append(xs[-1] + w)
    for h in high:
        ys.append(ys[-1] + h)
    xs = [total - e for e in xs] if direction == "rtl" else xs
    cells, placed = [], []
    for c, lines in zip(table["cells"], texts):
        a, b = xs[c["col"]], xs[min(c["col"] + c["col_span"], table["cols"])]
        y0, y1 = ys[c["row"]], ys[min(c["row"] + c["row_span"], table["rows"])]
        cells.append(c | {"bbox": box(x + min(a, b), top + y0, x + max(a, b), top + y1)})
        first = top + y0 + (y1 - y0 - height * len(lines)) / 2
        placed += [line_at(t, x + min(a, b) + padding, x + max(a, b) - padding, first + k * height, size, height, direction, measure=measure) for k, t in enumerate(lines)]
    return table | {"cells": cells}, placed, total, tall


def pie_angles(values: list[float]) -> list[tuple[float, float]]:
    """First and last degree of each slice, clockwise from the top."""
    total, at, out = sum(values) or 1.0, -90.0, []
    for v in values:
        out.append((at, at + 360 * v / total))
        at = out[-1][1]
    return out


def chart_lines(data: dict, b: Box, size: float, height: float, direction: str, measure: Measure = advance) -> list[dict]:
    """The text of a chart: its title at the top, its categories under, beside or around the plot."""
    lines = []
    top = b["y0"]
    if data["title"].strip():
        title = wrap(data["title"], b["x1"] - b["x0"], size, measure)[0]
        lines.append(line_at(title, b["x0"], b["x1"], top, size, height, direction, "center", measure))
        top += height
    names, small = data["categories"], 0.8 * height
    n = max(1, len(names))
    for k, name in enumerate(names):
        if data["type"] == "horizontal_bar":
            room = (b["y1"] - top) / n
            x0, x1, y = b["x0"], b["x0"] + 0.3 * (b["x1"] - b["x0"]), top + k * room + (room - small) / 2
        elif data["type"] == "pie":
            x0, x1, y = b["x0"] + 0.7 * (b["x1"] - b["x0"]), b["x1"], top + k * small
        else:
            slot = (b["x1"] - b["x0"]) / n
            x0, x1, y = b["x0"] + k * slot, b["x0"] + (k + 1) * slot, b["y1"] - small
        fitted = wrap(name, x1 - x0, 0.8 * size, measure)
        if fitted and y + small <= b["y1"] + 1e-6:
            lines.append(line_at(fitted[0], x0, x1, y, 0.8 * size, small, direction, "center", measure))
    return lines


@dataclass
class Layout:
    """The pages of a document and the numbers of the blocks that fit on none."""

    pages: list[dict]
    dropped: list[int]


def _texts(block: dict) -> list[str]:
    if block["type"] == "list" and block["items"]:
        ordered = dict(block["attributes"]).get("ordered") == "true"
        return [f"{k}. {x}" if ordered else f"• {x}" for k, x in enumerate(block["items"], 1)]
    return (block["text"] or "").split("\n")


class _Flow:
    def __init__(self, spec: Spec, typography: Typography, direction: str, measure: Measure):
        self.spec, self.type, self.way, self.measure = spec, typography, direction, measure

    def place(self, block: dict, column: Box, top: float, start: bool) -> tuple[dict | None, float, dict | None] | None:
        """The region of a block, the height that it takes and what is left of it; None if it does not fit here."""
        size, weight, before, after = self.type.role(block["type"])
        top += 0 if start else before
        room, kind, given = column["y1"] - top, block["type"], dict(block["attributes"])
        if room <= 0:
            return None
        used = 0 if start else before
        if kind == "separator":
            return (_region(kind, box(column["x0"], top, column["x1"], top + 2), [], given), used + 2 + after, None) if room >= 2 else None
        if kind in ("figure", "chart", "formula"):
            placed = self._object(kind, given, column, top, room, size)
        elif kind == "table" and block["table"]:
            height = self.type.line_height(size)
            table, lines, wide, tall = table_layout(block["table"], 0, 0, column["x1"] - column["x0"], size, height, self.way, measure=self.measure)
            if tall > room:
                return None
            x = column["x1"] - wide if self.way == "rtl" else column["x0"]
            table, lines, wide, tall = table_layout(block["table"], x, top, column["x1"] - column["x0"], size, height, self.way, measure=self.measure)
            placed = _region(kind, box(x, top, x + wide, top + tall), lines, given, table)
        else:
            return self._text(block, column, top, room, size, weight, used, after)
        return None if placed is None else (placed, used + placed["bbox"]["y1"] - top + after, None)

    def _object(self, kind: str, given: dict[str, str], column: Box, top: float, room: float, size: float) -> dict | None:
        across = column["x1"] - column["x0"]
        if kind == "formula":
            wide, above, below = content.measure(_node(given.get("node", '""')), size)
            tall = above + below
            if wide > 1.6 * across:
                return None
            given = {k: v for k, v in given.items() if k != "node"}
            shrink = min(1.0, across / wide) if wide else 1.0
            wide, tall = wide * shrink, tall * shrink
        else:
            wide = min(float(given.get("width", across)), across)
            tall = float(given.get("height", wide * (0.7 if kind == "chart" else 0.6)))
        if tall > room:
            return None
        x = column["x0"] + (across - wide) / 2
        b, lines = box(x, top, x + wide, top + tall), []
        if kind == "chart" and "chart" in given:
            data, label = json.loads(given["chart"]), 0.8 * self.type.body
            lines = chart_lines(data, b, label, self.type.line_height(label), self.way, self.measure)
            if data["type"] == "pie":
                given = given | {"angles": json.dumps([[round(v, 3) for v in a] for a in pie_angles(data["series"][0]["values"])])}
        return _region(kind, b, lines, given)

    def _text(self, block: dict, column: Box, top: float, room: float, size: float, weight: str, used: float, after: float) -> tuple | None:
        height, across = self.type.line_height(size), column["x1"] - column["x0"]
        lines = block.get("rest") or [x for t in _texts(block) for x in wrap(t, across, size, self.measure)]
        if not lines:
            return None, after, None
        most = int(room // height)
        if most < 1:
            return None
        left = None
        if len(lines) > most:
            if block["type"] not in content.SPLITTABLE or most < 2:
                return None
            lines, left = lines[:most], block | {"rest": lines[most:]}
        align = "center" if block["type"] == "caption" else "natural"
        made = [line_at(t, column["x0"], column["x1"], top + k * height, size, height, self.way, align, self.measure) for k, t in enumerate(lines)]
        given = dict(block["attributes"]) | {"size": f"{size:.2f}", "weight": weight}
        return _region(block["type"], around([x["bbox"] for x in made]), made, given), used + len(made) * height + after, left

    def band(self, kind: str, text: str, b: Box) -> list[dict]:
        size, weight, _, _ = self.type.role(kind)
        height = self.type.line_height(size)
        lines = wrap(text, b["x1"] - b["x0"], size, self.measure)[: max(1, int((b["y1"] - b["y0"]) // height))]
        made = [line_at(t, b["x0"], b["x1"], b["y0"] + k * height, size, height, self.way, "center", self.measure) for k, t in enumerate(lines)]
        return [_region(kind, around([x["bbox"] for x in made]), made, {})] if made else []


def _node(text: str):
    as_tuple = lambda x: tuple(map(as_tuple, x)) if isinstance(x, list) else x
    return as_tuple(json.loads(text))


def lay_out(blocks: list[dict], spec: Spec, typography: Typography, direction: str = "ltr", footer: str | None = None, max_pages: int = 8, measure: Measure = advance) -> Layout:
    """Pours blocks into pages; ``{page}`` in a footer is the page's number.

    Header blocks run on every page with a band for them. Blocks that are left when ``max_pages`` are full, and those
    that fit on no page, are dropped and reported.
    """
    way = "rtl" if "rtl" in (spec.direction, direction) else "ltr"
    flow = _Flow(replace(spec, direction=way), typography, way, measure)
    header = next((b for b in blocks if b["type"] == "header"), None)
    pending = [(k, b) for k, b in enumerate(blocks) if b["type"] != "header"]
    pages, dropped = [], []
    while pending and len(pages) < max_pages:
        regions = flow.band("header", header["text"], spec.bands()[0]) if header is not None and spec.header else []
        if footer and spec.footer:
            regions += flow.band("page_number", footer.replace("{page}", str(len(pages) + 1)), spec.bands()[1])
        furniture = len(regions)
        for column in flow.spec.column_boxes():
            at, start = column["y0"], True
            while pending:
                number, block = pending[0]
                placed = flow.place(block, column, at, start)
                if placed is None:
                    break
                region, height, left = placed
                pending.pop(0)
                if region is not None:
                    regions.append(region)
                at, start = at + height, False
                if left is not None:
                    pending.insert(0, (number, left))
                    break
        if len(regions) == furniture:
            if pending:
                dropped.append(pending.pop(0)[0])
            continue
        for order, r in enumerate(regions):
            r["reading_order"] = order
        pages.append({"width": spec.width, "height": spec.height, "direction": way, "regions": regions, "attributes": None})
    return Layout(pages, dropped + [k for k, _ in pending])


def layout(documents: DataFrame, max_pages: int = 3, sizes: tuple[int, int] = (18, 30), **spec) -> DataFrame:
    """``index``, ``page_no``, ``page``, ``dropped`` (on its first page) of documents of ``content.documents``; page and type are drawn from their seeds."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"index bigint, template string, page_no int, page {an.PAGE}, dropped array<int>"
    arrow = to_arrow_schema(documents.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in content.parts(batches):
            out: list[tuple] = []
            for index, seed, template, way, blocks, given in zip(*(b.column(c).to_pylist() for c in ("index", "seed", "template", "direction", "blocks", "attributes"))):
                rng = random.Random(seed ^ 0x5EED)
                kind = Typography.sample(rng, sizes, dict(given or []).get("handwritten") == "true")
                page = sample_spec(rng, way, kind.body, **spec)
                made = lay_out(blocks or [], page, kind, way, "{page}" if rng.random() < 0.45 else None, max_pages)
                out += [(index, template, k, p, made.dropped if k == 0 else []) for k, p in enumerate(made.pages)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return documents.select("index", "seed", "template", "direction", "blocks", "attributes").mapInArrow(run, ddl)
