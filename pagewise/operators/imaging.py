"""Pixel operators over rows of raw pages: checks of ink and contrast, image features, and degradations.

A page is ``width``, ``height`` and ``pixels``: one byte a pixel, grey, row by row. Work is done in Arrow batches with
numpy, one picture at a time; a batch holds few pages, so set ``spark.sql.execution.arrow.maxRecordsPerBatch`` low for
large pages. Rows whose pixels are null or of another length than width times height give nulls.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import annotations as an
from ..functions import geometry as g
from . import degrade as d
from .degrade import PRESETS, perspective_map, rotation_map  # noqa: F401

FEATURES = ("ink_fraction", "ink_darkness", "paper_lightness", "contrast", "stroke_width", "edge_density", "high_frequency_energy", "block_noise", "illumination_range", "aspect_ratio")
LONGEST = 1200
PART_PIXELS = 1 << 23


def _keep_memory() -> None:
    """Freed arrays of a picture's size stay with the process: to give them back after each step costs as much as the step."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 26)  # size from which memory is mapped apart
        libc.mallopt(-1, 1 << 27)  # what may stay free at the end
    except (OSError, AttributeError):  # another C library
        pass


def _grey(width: int | None, height: int | None, pixels) -> np.ndarray | None:
    if not width or not height or pixels is None or len(pixels) != width * height:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def _pictures(b: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    """The pictures of a batch, one after the other, without copies of their bytes."""
    pixels = b.column("pixels")
    for k, (w, h) in enumerate(zip(b.column("width").to_pylist(), b.column("height").to_pylist())):
        raw = pixels[k]
        yield _grey(w, h, raw.as_buffer() if raw.is_valid else None)


def middle_of(grey: np.ndarray) -> float:
    """The median; that of bytes is counted, not sorted."""
    if grey.dtype != np.uint8 or not grey.size:
        return float(np.median(grey))
    upto, n = np.cumsum(np.bincount(grey.ravel(), minlength=256)), grey.size
    return float(np.searchsorted(upto, [(n - 1) // 2, n // 2], side="right").mean())


def ink_coverage(grey: np.ndarray, margin: int = 40) -> float:
    return float((grey < middle_of(grey) - margin).mean())


def depth_of_ink(grey: np.ndarray, window: int = 9) -> np.ndarray:
    """How much darker each pixel is than the lightest around it."""
    return d.square(grey, window, np.maximum).astype(np.int16) - grey


#: So many blocks of a page have their contrast taken, the first ones.
JUDGED = 12


def block_depths(grey: np.ndarray, boxes: list[dict] | None, most: int = JUDGED, window: int = 9, least_pixels: int = 16) -> list[float]:
    """The 99th percentile of the depth of ink of each of the first blocks of text."""
    found = []
    if boxes:
        depth = depth_of_ink(grey, window)
        for b in boxes[:most]:
            patch = depth[max(0, int(np.floor(b["y0"]))) : max(0, int(np.ceil(b["y1"]))), max(0, int(np.floor(b["x0"]))) : max(0, int(np.ceil(b["x1"])))]
            if patch.size >= least_pixels:
                found.append(float(np.percentile(patch, 99)))
    return found


def stroke_width(ink: np.ndarray, longest: int = 40, rows: int = 120) -> float:
    """Mean length of runs of ink of at most so many pixels, over some rows."""
    sample = ink[:: max(1, len(ink) // rows)]
    edges = np.diff(np.pad(sample.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    runs = np.nonzero(edges == -1)[1] - np.nonzero(edges == 1)[1]
    runs = runs[runs <= longest]
    return float(runs.mean()) if len(runs) else 0.0


def extract_features(grey: np.ndarray) -> list[float]:
    """Ten numbers that describe a page image, see ``FEATURES``; of a large one, as it is at ``LONGEST`` pixels."""
    x = grey.astype(np.float64)
    long = max(x.shape)
    if long > LONGEST:
        x = d.resize(x, *(max(1, int(n * LONGEST / long)) for n in x.shape)).astype(np.float64)
    (h, w), middle = x.shape, float(np.median(x))
    ink = x < middle - 40
    dark, light = (float(x[m].mean()) if m.any() else middle for m in (ink, ~ink))
    steps = [np.abs(np.diff(x, axis=a)) for a in (1, 0)]
    mean = lambda f: sum(float(f(s)) for s in steps if s.size) / 2
    columns = np.abs(np.diff(x.mean(0)))[7::8]
    coarse = x[:: max(1, h // 8), :: max(1, w // 8)]
    return [
        float(ink.mean()), dark, light, light - dark, stroke_width(ink), mean(lambda s: (s > 20).mean()), mean(np.std),
        float(columns.mean()) if w > 16 else 0.0, float(coarse.max() - coarse.min()), w / h,
    ]


def _over(pages: DataFrame, work: Callable[[np.ndarray, dict], tuple], out: pa.Schema, ddl: str, *extra: str) -> DataFrame:
    """A row for each page: its id and what ``work`` makes of the picture and the extra columns; nulls without a picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [b.column(c).to_pylist() for c in extra]
            rows = [tuple([None] * len(out)) if x is None else work(x, dict(zip(("id", *extra), (i, *m)))) for i, x, *m in zip(b.column("id").to_pylist(), _pictures(b), *more)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out))], names=["id", *out.names])

    return pages.selectExpr("cast(id as string) id", "cast(width as int) width", "cast(height as int) height", "pixels", *extra).mapInArrow(run, f"id string, {ddl}")


def _few(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose pictures have ``PART_PIXELS`` together, one picture at least."""
    start, n = 0, 0
    for k, (w, h) in enumerate(zip(b.column("width").to_pylist(), b.column("height").to_pylist())):
        size = (w or 0) * (h or 0)
        if k > start and n + size > PART_PIXELS:
            yield b.slice(start, k - start)
            start, n = k, 0
        n += size
    if start < b.num_rows:
        yield b.slice(start)


def drawn_features(pages: DataFrame) -> DataFrame:
    """The features of pages of ``boxes``, drawn and measured one at a time: no picture leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        for b in batches:
            rows = [extract_features(drawn(w, h, boxes)) for w, h, boxes in zip(*(b.column(c).to_pylist() for c in ("width", "height", "boxes")))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(len(FEATURES)))], names=["id", *FEATURES])

    return pages.selectExpr("cast(id as string) id", "cast(width as int) width", "cast(height as int) height", "boxes").mapInArrow(run, "id string, " + ", ".join(f"{f} double" for f in FEATURES))


def features(pages: DataFrame) -> DataFrame:
    """``id`` and the ten features of each page."""
    return _over(pages, lambda x, _: extract_features(x), pa.schema([(f, pa.float64()) for f in FEATURES]), ", ".join(f"{f} double" for f in FEATURES))


_GATE = pa.schema([("ink", pa.float64()), ("contrast", pa.float64()), ("failing", pa.float64()), ("passed", pa.bool_())])
_GATE_DDL = "ink double, contrast double, failing double, passed boolean"


def judge(x: np.ndarray, boxes: list[dict] | None, least_ink: float, least_contrast: float, most_failing: float) -> tuple:
    """Share of ink, median depth of ink and share of failing blocks, and whether both checks pass; blocks vote, none is no fault."""
    depths, ink = block_depths(x, boxes), ink_coverage(x)
    failing = float(np.mean([v < least_contrast for v in depths])) if depths else 0.0
    return ink, float(np.median(depths)) if depths else None, failing, ink >= least_ink and failing <= most_failing


def pixel_gate(pages: DataFrame, least_ink: float = 0.002, least_contrast: float = 90, most_failing: float = 0.5) -> DataFrame:
    """``id``, ``ink``, ``contrast``, ``failing``, ``passed`` of each page; ``boxes`` are its blocks with lines, in reading order."""
    return _over(pages, lambda x, r: judge(x, r["boxes"], least_ink, least_contrast, most_failing), _GATE, _GATE_DDL, "boxes")


def text_boxes(page):
    """Column: the boxes of the regions that have lines, in reading order."""
    return F.transform(F.filter(an.ordered_regions(page), lambda r: F.size(F.coalesce(r["lines"], F.array().cast(f"array<{an.LINE}>"))) > 0), lambda r: r["bbox"])


def _generator(seed: int, id: str) -> Callable[[int], np.random.Generator]:
    return lambda number: np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{id}:{number}".encode()).digest()[:8], "big"))


def steps_of(preset: str | tuple[d.Step, ...]) -> tuple[d.Step, ...]:
    if isinstance(preset, str):
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset!r}; one of {', '.join(PRESETS)}")
        return PRESETS[preset]
    return tuple(preset)


def degrade(pages: DataFrame, preset: str | tuple[d.Step, ...], seed: int = 0) -> DataFrame:
    """The pages after a preset's steps, each taken with its probability: pixels, their new size, ``applied`` names, ``records`` as JSON.

    Draws depend on the seed, the page's id and the step's number only. With a column ``page`` its boxes follow the ink,
    and what leaves the canvas is cut off.
    """
    steps, paged = steps_of(preset), "page" in pages.columns
    source = pages.selectExpr("cast(id as string) id", "cast(width as int) width", "cast(height as int) height", "pixels", *(["page"] if paged else []))
    kind = source.schema["page"].dataType if paged else None
    ddl = "id string, width int, height int, pixels binary, applied array<string>, records array<string>" + (f", page {kind.simpleString()}, moved boolean" if paged else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _few(whole)):
            given = b.column("page") if paged else None
            made = []
            for k, (i, x) in enumerate(zip(b.column("id").to_pylist(), _pictures(b))):
                if x is None:
                    made.append((None, None, None, [], [], given[k].as_py() if paged else None, False))
                    continue
                x, maps, done = d.run_steps(x, steps, _generator(seed, i))
                page = given[k].as_py() if paged else None
                page = d.map_page(page, maps, x.shape[1], x.shape[0]) if page and maps else page
                made.append((x.shape[1], x.shape[0], x.tobytes(), [n for n, _ in done], [json.dumps({"name": n} | p) for n, p in done], page, bool(maps)))
            columns = [pa.array([m[c] for m in made], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())))]
            extra = [pa.array([m[5] for m in made], given.type), pa.array([m[6] for m in made])] if paged else []
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns, *extra], names=["id", "width", "height", "pixels", "applied", "records", *(["page", "moved"] if paged else [])])

    out = source.mapInArrow(run, ddl)
    return out.withColumn("page", F.when(F.col("moved"), an.clipped(F.col("page"))).otherwise(F.col("page"))).drop("moved") if paged else out


def degraded_gate(pages: DataFrame, preset: str, seed: int = 0, least_ink: float = 0.002, least_contrast: float = 90, most_failing: float = 0.5) -> DataFrame:
    """Ink and contrast of pages drawn, degraded and judged in one pass: no picture leaves its task.

    Pages are ``id``, ``width``, ``height`` and ``boxes``, those of their blocks of text in reading order.
    """
    steps = steps_of(preset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        for b in batches:
            rows = []
            for i, w, h, boxes in zip(*(b.column(c).to_pylist() for c in ("id", "width", "height", "boxes"))):
                x, maps, done = d.run_steps(drawn(w, h, boxes), steps, _generator(seed, i))
                moved = d.map_boxes((boxes or [])[:JUDGED], maps)  # those that are judged
                rows.append((*judge(x, moved, least_ink, least_contrast, most_failing), [n for n, _ in done]))
            out = pa.schema([*_GATE, ("applied", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out))], names=["id", *out.names])

    return pages.selectExpr("cast(id as string) id", "cast(width as int) width", "cast(height as int) height", "boxes").mapInArrow(run, f"id string, {_GATE_DDL}, applied array<string>")


def drawn(width: int, height: int, boxes: list[dict] | None, ink: int = 40, paper: int = 235) -> np.ndarray:
    """A picture in which each box is filled with vertical stems."""
    x = np.full((height, width), paper, np.uint8)
    for b in boxes or []:
        x[max(0, int(b["y0"])) : max(0, int(b["y1"])), max(0, int(b["x0"])) : max(0, int(b["x1"])) : 4] = ink
    return x


def rasterize(pages: DataFrame, ink: int = 40, paper: int = 235) -> DataFrame:
    """Pages of boxes as pixels; the boxes stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _few(whole):
                out = [drawn(w, h, boxes, ink, paper).tobytes() for w, h, boxes in zip(*(b.column(c).to_pylist() for c in ("width", "height", "boxes")))]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("width"), b.column("height"), pa.array(out, pa.binary()), b.column("boxes")], names=["id", "width", "height", "pixels", "boxes"])

    return pages.selectExpr("cast(id as string) id", "cast(width as int) width", "cast(height as int) height", "boxes").mapInArrow(run, f"id string, width int, height int, pixels binary, boxes array<{g.BOX}>")


def map_box(box, h: np.ndarray):
    """Column: the corners of a box under a homography, flat, clockwise from the top left, and the box around them."""
    m = [[float(v) for v in row] for row in h]

    def point(x, y):
        w = x * m[2][0] + y * m[2][1] + m[2][2]
        return (x * m[0][0] + y * m[0][1] + m[0][2]) / w, (x * m[1][0] + y * m[1][1] + m[1][2]) / w

    points = [point(box[a], box[b]) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return F.struct(F.array(*[v for p in points for v in p]).alias("polygon"), g.box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)).alias("bbox"))
