"""Documents as blocks of content: a builder, ten genres, charts and formulas, all drawn from a seed.

A document is a pure function of (seed, index, sentences). Genres are classes of recipes in a registry; ``documents``
builds each row's document in its task, one Arrow batch at a time, so nothing but rows of sentences is read.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annotations as an
from . import sampling

BLOCK = f"struct<type:string,text:string,items:array<string>,table:{an.TABLE},attributes:map<string,string>>"
SCHEMA = f"index bigint, seed bigint, template string, direction string, blocks array<{BLOCK}>, attributes map<string,string>"
SPLITTABLE = ("paragraph", "list", "quote", "code", "key_value")
_ENDS = ".،,;:"


# fields


class Fields:
    """Values that no language model can guess, in a system of numerals."""

    def __init__(self, rng: random.Random, numerals: str = "western"):
        from ..functions.text import DIGITS

        self.rng, self.turn = rng, str.maketrans(DIGITS["western"], DIGITS[numerals])

    def _n(self, low: int, high: int) -> int:
        return self.rng.randint(low, high)

    def date(self) -> str:
        d, m, y, form = self._n(1, 28), self._n(1, 12), self._n(1990, 2026), self.rng.random()
        return (f"{d:02d}/{m:02d}/{y}" if form < 0.4 else f"{d} {sampling.MONTHS[m - 1]} {y}" if form < 0.7 else f"{y}-{m:02d}-{d:02d}").translate(self.turn)

    def amount(self) -> str:
        return f"{self.rng.uniform(1, 99999):,.2f} {self.rng.choice(sampling.CURRENCIES)}".translate(self.turn)

    def code(self) -> str:
        letters = "".join(self.rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ", k=self._n(2, 4)))
        return (letters + self.rng.choice(("-", "/", "", " ")) + "".join(self.rng.choices("0123456789", k=self._n(4, 9)))).translate(self.turn)

    def phone(self) -> str:
        return f"+212 {self._n(5, 7)}{self._n(10, 99)} {self._n(100000, 999999)}".translate(self.turn)

    def percentage(self) -> str:
        return f"{self.rng.uniform(0, 100):.1f}%".translate(self.turn)

    def any(self) -> str:
        return getattr(self, self.rng.choice(("date", "amount", "code", "phone", "percentage")))()


class Sentences:
    """Pieces of text cut from sentences; there must be one at least."""

    def __init__(self, sentences: list[str], rng: random.Random):
        if not sentences:
            raise ValueError("a source needs a sentence")
        self.sentences, self.rng = sentences, rng

    def sentence(self) -> str:
        return self.rng.choice(self.sentences)

    def _words(self) -> list[str]:
        return self.sentence().split() or [""]

    def paragraph(self, sentences: int = 3) -> str:
        return " ".join(self.sentence() for _ in range(max(1, sentences)))

    def title(self) -> str:
        return " ".join(self._words()[: self.rng.randint(2, 7)]).rstrip(_ENDS)

    def phrase(self, most: int = 3) -> str:
        words = self._words()
        n = min(len(words), self.rng.randint(1, max(1, most)))
        at = self.rng.randint(0, len(words) - n)
        return " ".join(words[at : at + n]).strip(_ENDS)

    def fragment(self) -> str:
        """A word with its head or its tail cut off, as at the edge of a crop."""
        word = self.rng.choice(self._words())
        if len(word) < 3:
            return word
        cut = self.rng.randint(1, len(word) - 1)
        return word[:cut] if self.rng.random() < 0.5 else word[cut:]

    def contextless(self, most: int = 4) -> str:
        """Words of different sentences, which predict nothing of each other."""
        return " ".join(self.rng.choice(self._words()) for _ in range(self.rng.randint(1, most)))


# charts and formulas

CHARTS = ("bar", "horizontal_bar", "line", "pie")


def sample_chart(rng: random.Random, labels: list[str], title: str = "", kind: str | None = None) -> dict:
    """The data of a chart, as a model is asked to read it: its kind, labels, and one to three series of values."""
    kind = kind or rng.choice(CHARTS)
    n, pie = rng.randint(3, 5 if kind == "pie" else 6), kind == "pie"
    series = [{"name": labels[k % len(labels)], "values": [round(rng.uniform(5, 100), 1) for _ in range(n)]} for k in range(1 if pie else rng.randint(1, 3))]
    return {"type": kind, "title": title, "x_label": "", "y_label": "", "categories": [labels[k % len(labels)] for k in range(n)], "series": series}


_BIG = {"sum": r"\sum", "prod": r"\prod", "int": r"\int"}
_LETTERS = "abcxyznmktpqr"


def latex(node: tuple | str) -> str:
    """The LaTeX of an expression: a symbol, or (kind, part, ...)."""
    if isinstance(node, str):
        return node
    kind, *parts = node
    x = [latex(p) for p in parts]
    forms: dict[str, Callable[[], str]] = {
        "row": lambda: " ".join(x),
        "frac": lambda: rf"\frac{{{x[0]}}}{{{x[1]}}}",
        "sup": lambda: f"{x[0]}^{{{x[1]}}}",
        "sub": lambda: f"{x[0]}_{{{x[1]}}}",
        "sqrt": lambda: rf"\sqrt{{{x[0]}}}",
        **{k: lambda k=k: f"{_BIG[k]}_{{{x[1]}}}^{{{x[2]}}} {x[0]}" for k in _BIG},
    }
    return forms[kind]()


def measure(node: tuple | str, size: float) -> tuple[float, float, float]:
    """Width and reach above and below the line of an expression set at a size."""
    if isinstance(node, str):
        return 0.55 * size * len(node), 0.75 * size, 0.25 * size
    kind, *parts = node
    if kind == "row":
        boxes = [measure(p, size) for p in parts]
        return sum(b[0] for b in boxes) + 0.25 * size * (len(boxes) - 1), max(b[1] for b in boxes), max(b[2] for b in boxes)
    if kind == "frac":
        top, low = (measure(p, size) for p in parts)
        return max(top[0], low[0]) + 0.3 * size, top[1] + top[2] + 0.4 * size, low[1] + low[2]
    if kind in ("sup", "sub"):
        base, mark = measure(parts[0], size), measure(parts[1], 0.65 * size)
        up = kind == "sup"
        return base[0] + mark[0], max(base[1], 0.45 * size + mark[1]) if up else base[1], base[2] if up else max(base[2], 0.2 * size + mark[2])
    if kind == "sqrt":
        w, a, b = measure(parts[0], size)
        return w + 0.6 * size, a + 0.2 * size, b
    body, low, high = (measure(p, s) for p, s in zip(parts, (size, 0.6 * size, 0.6 * size)))
    sign = max(1.1 * size, low[0], high[0])
    return sign + 0.2 * size + body[0], max(body[1], 1.1 * size + high[1] + high[2]), max(body[2], 0.4 * size + low[1] + low[2])


def sample_formula(rng: random.Random, depth: int = 0) -> tuple | str:
    """An expression of at most three levels; fractions and powers are the most frequent."""
    if depth >= 2 or rng.random() < 0.35:
        return str(rng.randint(1, 99)) if rng.random() < 0.45 else rng.choice(_LETTERS)
    (kind,) = rng.choices(("frac", "sup", "sub", "sqrt", "big", "row"), (3, 3, 1.5, 1.5, 1.5, 2.5))
    inner = lambda: sample_formula(rng, depth + 1)
    if kind in ("sup", "sub"):
        return kind, rng.choice(_LETTERS), str(rng.randint(2 if kind == "sup" else 0, 9))
    if kind == "big":
        return rng.choice(tuple(_BIG)), inner(), f"{rng.choice('ijk')}=1", rng.choice(("n", "m", "∞"))
    if kind == "row":
        return kind, inner(), rng.choice("+-=×"), inner()
    return (kind, inner(), inner()) if kind == "frac" else (kind, inner())


# documents


def table_of(rows: list[list[str]], header: bool = True) -> dict:
    """A grid as a table of cells."""
    cols = max(map(len, rows), default=0)
    cell = lambda r, c, text: {"row": r, "col": c, "text": text, "row_span": 1, "col_span": 1, "is_header": header and r == 0, "bbox": None}
    return {"rows": len(rows), "cols": cols, "has_header_row": header, "cells": [cell(r, c, t) for r, row in enumerate(rows) for c, t in enumerate([*row, *[""] * (cols - len(row))])]}


class Builder:
    """Blocks in their order; every method returns the builder."""

    def __init__(self, **attributes):
        self.blocks, self.attributes = [], {k: _plain(v) for k, v in attributes.items()}

    def add(self, kind: str, text: str = "", items: list[str] | None = None, table: dict | None = None, **attributes) -> "Builder":
        if kind not in an.REGION_TYPES:
            raise ValueError(f"unknown region type {kind!r}")
        self.blocks.append({"type": kind, "text": text, "items": items or [], "table": table, "attributes": {k: _plain(v) for k, v in attributes.items()}})
        return self

    def __getattr__(self, kind: str) -> Callable[..., "Builder"]:
        if kind not in an.REGION_TYPES:
            raise AttributeError(kind)
        return lambda text="", **more: self.add(kind, text, **more)

    def list(self, items: list[str], ordered: bool = False) -> "Builder":
        return self.add("list", "", items, ordered=ordered)

    def table(self, rows: list[list[str]], header: bool = True) -> "Builder":
        return self.add("table", table=table_of(rows, header))

    def key_values(self, pairs: list[tuple[str, str]]) -> "Builder":
        for k, v in pairs:
            self.add("key_value", f"{k}: {v}", key=k, value=v)
        return self

    def chart(self, data: dict, width: int, height: int) -> "Builder":
        return self.add("chart", chart=json.dumps(data, ensure_ascii=False), width=width, height=height)

    def formula(self, node: tuple | str) -> "Builder":
        return self.add("formula", latex=latex(node), node=json.dumps(node))


def _plain(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


Genre = Callable[[Builder, Sentences, Fields, random.Random], None]
GENRES: dict[str, tuple[float, Genre]] = {}


def genre(weight: float, name: str | None = None) -> Callable[[Genre], Genre]:
    """Registers a genre under a name with a weight, negative ones as 0."""

    def add(f: Genre) -> Genre:
        GENRES[name or f.__name__] = max(0.0, float(weight)), f
        return f

    return add


def _some(rng: random.Random, low: int, high: int) -> range:
    return range(rng.randint(low, high))


def _chart(b: Builder, s: Sentences, rng: random.Random, title: str, wide: tuple[int, int], high: tuple[int, int], kind: str | None = None) -> None:
    b.chart(sample_chart(rng, [s.phrase(1) for _ in range(4)], title, kind), rng.randint(*wide), rng.randint(*high))


@genre(3.0)
def article(b, s, f, rng):
    b.title(s.title()).paragraph(s.paragraph(rng.randint(2, 4)))
    for _ in _some(rng, 2, 5):
        b.heading(s.title())
        for _ in _some(rng, 1, 3):
            b.paragraph(s.paragraph(rng.randint(2, 5)))
        if rng.random() < 0.25:
            b.list([s.phrase(6) for _ in _some(rng, 2, 5)])


@genre(2.0)
def report(b, s, f, rng):
    cols = rng.randint(2, 5)
    b.header(s.phrase(4)).title(s.title()).paragraph(s.paragraph(3)).heading(s.title())
    body = [[s.phrase(2), *(str(rng.randint(0, 9999)) for _ in range(cols - 1))] for _ in _some(rng, 3, 7)]
    b.table([[s.phrase(2) for _ in range(cols)], *body]).caption(s.phrase(6)).paragraph(s.paragraph(rng.randint(2, 4)))
    if rng.random() < 0.55:
        _chart(b, s, rng, s.phrase(3), (260, 420), (190, 300))
        b.caption(s.phrase(5))
    elif rng.random() < 0.5:
        b.figure(width=rng.randint(240, 420), height=rng.randint(160, 300)).caption(s.phrase(5))
    b.paragraph(s.paragraph(rng.randint(2, 4)))


@genre(1.0)
def letter(b, s, f, rng):
    b.paragraph(s.phrase(5)).separator().paragraph(s.phrase(4))
    for _ in _some(rng, 2, 4):
        b.paragraph(s.paragraph(rng.randint(2, 4)))
    b.paragraph(s.phrase(3))


@genre(1.0)
def form(b, s, f, rng):
    value = lambda share, most: f.any() if rng.random() < share else s.phrase(most)
    b.title(s.title()).key_values([(s.phrase(2), value(0.5, 3)) for _ in _some(rng, 4, 9)])
    b.separator().heading(s.phrase(3)).key_values([(s.phrase(2), value(0.6, 2)) for _ in _some(rng, 3, 6)])


@genre(1.0)
def invoice(b, s, f, rng):
    b.title(s.phrase(3)).key_values([(s.phrase(2), v()) for v in (f.code, f.date, f.phone)])
    items = [[s.phrase(2), s.phrase(4), str(rng.randint(1, 20)), f.amount()] for _ in _some(rng, 3, 8)]
    b.table([[s.phrase(2), s.phrase(3), "#", f.amount()], *items]).key_values([(s.phrase(1), f.amount())]).paragraph(s.paragraph(2))


@genre(1.5)
def paper(b, s, f, rng):
    b.title(s.title()).paragraph(s.paragraph(rng.randint(2, 4)))
    for _ in _some(rng, 2, 4):
        b.heading(s.title()).paragraph(s.paragraph(rng.randint(2, 4))).formula(sample_formula(rng))
        if rng.random() < 0.4:
            b.paragraph(s.paragraph(2))
    if rng.random() < 0.5:
        _chart(b, s, rng, s.phrase(3), (240, 400), (170, 260), "line")
        b.caption(s.phrase(5))


@genre(1.5)
def newspaper(b, s, f, rng):
    b.header(s.phrase(3)).title(s.title())
    for k in _some(rng, 3, 6):
        if k:
            b.heading(s.title(), level=3)
        for _ in _some(rng, 2, 4):
            b.paragraph(s.paragraph(rng.randint(3, 6)))


@genre(0.8)
def contents(b, s, f, rng):
    b.title(s.phrase(2))
    page = rng.randint(1, 9)
    for _ in _some(rng, 8, 16):
        b.paragraph(f"{s.phrase(rng.randint(2, 5))} {'.' * rng.randint(6, 30)} {page}")
        page += rng.randint(1, 12)


@genre(0.8)
def slide(b, s, f, rng):
    b.title(s.phrase(rng.randint(2, 5))).list([s.phrase(rng.randint(3, 8)) for _ in _some(rng, 3, 6)])
    if rng.random() < 0.4:
        _chart(b, s, rng, "", (280, 420), (180, 260))
    b.footer(s.phrase(2))


@genre(1.0)
def notes(b, s, f, rng):
    b.attributes["handwritten"] = "true"
    b.heading(s.phrase(rng.randint(2, 4)))
    for _ in _some(rng, 4, 9):
        b.paragraph(s.sentence())
    if rng.random() < 0.5:
        b.list([s.phrase(rng.randint(2, 6)) for _ in _some(rng, 2, 5)])


def build(name: str, sentences: list[str], seed: int, numerals: str = "western") -> Builder:
    """The document of one genre, seed and source; without sentences it has no blocks."""
    if name not in GENRES:
        raise ValueError(f"unknown genre {name!r}; one of {', '.join(sorted(GENRES))}")
    rng, b = random.Random(seed), Builder(template=name)
    if sentences:
        GENRES[name][1](b, Sentences(sentences, rng), Fields(rng, numerals), rng)
    return b


def choose(seed: Column, weights: dict[str, float] | None = None) -> Column:
    """The genre of a document by weight; names that are not registered are never chosen."""
    from ..functions.text import uniform

    given = weights if weights is not None else {k: w for k, (w, _) in GENRES.items()}
    return sampling.weighted_choice(uniform(seed, F.lit("genre")), {k: w for k, w in given.items() if k in GENRES})


#: Documents whose blocks or pages are Python objects at once; Arrow's batches hold thousands.
AT_ONCE = 64


def parts(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows."""
    for b in batches:
        for start in range(0, b.num_rows, rows or AT_ONCE):
            yield b.slice(start, rows or AT_ONCE)


def documents(sources: DataFrame, seed: int | None, weights: dict[str, float] | None = None, numerals: str = "western", direction: str = "auto") -> DataFrame:
    """Documents of rows of ``index`` and ``sentences``; see ``SCHEMA``. An empty or null source gives no blocks."""
    from ..functions.text import direction as reads

    way = F.when(F.lit(direction) == "auto", reads(F.array_join("sentences", " "))).otherwise(F.lit(direction))
    rows = sources.withColumn("seed", sampling.sample_seed(seed, F.col("index")))
    rows = rows.select(F.col("index").cast("bigint").alias("index"), "seed", choose(F.col("seed"), weights).alias("template"), F.coalesce(way, F.lit("ltr")).alias("direction"), "sentences")
    types = rows.sparkSession.createDataFrame([], SCHEMA).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            made = [build(t, s or [], n, numerals) for t, s, n in zip(*(b.column(c).to_pylist() for c in ("template", "sentences", "seed")))]
            blocks = [[x | {"attributes": list(x["attributes"].items())} for x in m.blocks] for m in made]
            given = [b.column(c).cast(arrow.field(c).type) for c in ("index", "seed", "template", "direction")]
            yield pa.RecordBatch.from_arrays([*given, pa.array(blocks, arrow.field("blocks").type), pa.array([list(m.attributes.items()) for m in made], arrow.field("attributes").type)], schema=arrow)

    return rows.mapInArrow(run, SCHEMA)


def block_text(block: Column) -> Column:
    """The text of a block: its own, its items, or the cells of its table in their order."""
    cells = F.array_join(F.transform(block["table"]["cells"], lambda c: c["text"]), " ")
    return F.when(block["table"].isNotNull(), cells).when(F.size(block["items"]) > 0, F.array_join(block["items"], "\n")).otherwise(block["text"])


def plain_text(blocks: Column) -> Column:
    return F.array_join(F.filter(F.transform(blocks, block_text), lambda x: x != ""), "\n")
