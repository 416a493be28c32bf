"""Training formats of page records: JSON lines, Parquet, tar shards, chat, COCO, detection and recognition labels, and pictures."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import annotations as an
from ..functions import geometry as g
from .archives import write_tar

INSTRUCTION = "Transcribe this document to Markdown, preserving its structure."


def record(id: Column, page: Column, image_path: Column, provenance: Column | None = None) -> Column:
    """One page as JSON, absent fields left out."""
    fields = [id.alias("id"), page.alias("page"), image_path.alias("image_path"), *([provenance.alias("provenance")] if provenance is not None else []), an.page_text(page).alias("text"), an.page_markdown(page).alias("markdown"), an.page_html(page).alias("html")]
    return F.to_json(F.struct(*fields))


def write_jsonl(df: DataFrame, path: str, value: str = "value") -> None:
    df.select(F.col(value).alias("value")).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Shards as partitions; a shard without rows has no file."""
    df.write.mode("overwrite").partitionBy("shard").parquet(path)


def chat(id: Column, image: Column, answer: Column, instruction: str = INSTRUCTION) -> Column:
    """A conversation about one picture: it and the instruction from the user, the answer from the assistant."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    said = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))
    user = said("user", part("image", F.lit(None).cast("string")), part("text", F.lit(instruction)))
    return F.to_json(F.struct(id.alias("id"), image.alias("image"), F.array(user, said("assistant", part("text", answer))).alias("messages")))


CATEGORIES = {name: i for i, name in enumerate(("word", "line", *an.REGION_TYPES), 1)}


def coco_annotations(pages: DataFrame) -> DataFrame:
    """``shard``, ``annotation_id``, ``image_id``, ``id``, ``category_id``, ``bbox``, ``area``, ``iscrowd``, ``segmentation``, ``text`` of regions, lines and words in their order.

    Numbers run through a shard, which is what one file holds.
    """
    regions = pages.select("shard", "id", F.posexplode(an.ordered_regions(F.col("page"))).alias("r", "region"))
    category = F.lit(None).cast("int")
    for name, number in CATEGORIES.items():
        category = F.when(F.col("region")["type"] == name, number).otherwise(category)
    row = lambda line, word, kind, x, text: F.struct(
        line.cast("int").alias("l"), word.cast("int").alias("w"), kind.cast("int").alias("category_id"), x["bbox"].alias("box"), text.alias("text"), (F.lit(None).cast("array<double>") if kind is category else x["polygon"]).alias("polygon")
    )
    lines = F.flatten(
        F.transform(
            F.col("region")["lines"],
            lambda x, i: F.concat(F.array(row(i, F.lit(-1), F.lit(CATEGORIES["line"]), x, x["text"])), F.transform(x["words"], lambda w, j: row(i, j, F.lit(CATEGORIES["word"]), w, w["text"]))),
        )
    )
    every = regions.select("shard", "id", "r", F.explode(F.concat(F.array(row(F.lit(-1), F.lit(-1), category, F.col("region"), an.region_text(F.col("region")))), lines)).alias("a"))
    images = coco_images(pages).select("shard", "id", "image_id")
    number = F.row_number().over(Window.partitionBy("shard").orderBy("id", "r", "a.l", "a.w"))
    box = F.transform(g.as_xywh(F.col("a.box")), lambda v: F.round(v, 2))
    outline = F.when(F.col("a.polygon").isNull(), F.array().cast("array<array<double>>")).otherwise(F.array("a.polygon"))
    made = every.select("shard", number.alias("annotation_id"), "id", "a.category_id", box.alias("bbox"), F.round(g.area(F.col("a.box")), 2).alias("area"), F.lit(0).alias("iscrowd"), outline.alias("segmentation"), "a.text")
    return made.join(images, ["shard", "id"]).select("shard", "annotation_id", "image_id", "id", "category_id", "bbox", "area", "iscrowd", "segmentation", "text")


def coco_images(pages: DataFrame, extension: str = "png") -> DataFrame:
    """``shard``, ``image_id``, ``id``, ``file_name``, ``width``, ``height``, numbered within a shard."""
    number = F.row_number().over(Window.partitionBy("shard").orderBy("id"))
    return pages.select("shard", number.alias("image_id"), "id", F.format_string(f"images/%s.{extension}", "id").alias("file_name"), "page.width", "page.height")


def coco_parts(pages: DataFrame, extension: str = "png") -> DataFrame:
    """``shard``, ``place``, ``piece``: the JSON of each shard's file in pieces; in the order of places they are the whole."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    image = F.to_json(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height"))
    note = F.to_json(F.struct(F.col("annotation_id").alias("id"), "image_id", "category_id", "bbox", "area", "iscrowd", "segmentation", "text"))
    comma = lambda n: F.when(F.col(n) > 1, ",").otherwise("")
    place = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("bigint").alias("n")).alias("place")
    kinds = "[" + ",".join(f'{{"id":{i},"name":"{n}"}}' for n, i in CATEGORIES.items()) + "]"
    shards = pages.select("shard").distinct()
    fixed = [shards.select("shard", place(k, F.lit(0)), F.lit(x).alias("piece")) for k, x in ((0, '{"images":['), (2, '],"annotations":['), (4, f'],"categories":{kinds}}}'))]
    found = coco_images(pages, extension).select("shard", place(1, F.col("image_id")), text(comma("image_id"), image).alias("piece"))
    found = found.unionByName(coco_annotations(pages).select("shard", place(3, F.col("annotation_id")), text(comma("annotation_id"), note).alias("piece")))
    for x in fixed:
        found = found.unionByName(x)
    return found


def write_pieces(pieces: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes the pieces of each shard into one file, as they come; ``shard``, ``pieces``. A file gets its name when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        now, out, part, n, done = None, None, "", 0, []

        def close() -> None:
            out.close()
            system.move(part, f"{path}/{name.format(now)}")
            done.append((now, n))

        for b in batches:
            for shard, piece in zip(b.column("shard").to_pylist(), b.column("piece").to_pylist()):
                if shard != now:
                    if out is not None:
                        close()
                    part, now, n = f"{path}/.{TaskContext.get().taskAttemptId()}-{shard}", shard, 0
                    out = system.open_output_stream(part)
                out.write(piece.encode())
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64())], names=["shard", "pieces"])

    rows = pieces.select(F.col("shard").cast("int").alias("shard"), "place", "piece").repartition("shard").sortWithinPartitions("shard", "place")
    return rows.select("shard", "piece").mapInArrow(run, "shard int, pieces bigint")


# pictures


def png(grey: np.ndarray) -> bytes:
    """A grey picture as PNG."""
    h, w = grey.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = grey
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray | None:
    """The grey values of a PNG of 8 bits a channel without interlacing; None where it is something else or damaged."""
    try:
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, packed, head = 8, b"", None
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            packed += body if kind == b"IDAT" else b""
            at += 12 + n
        w, h, depth, colour, _, _, interlaced = head
        channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
        if depth != 8 or interlaced or channels is None:
            return None
        rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * channels)
        out = np.zeros((h, w * channels), np.uint8)
        before = np.zeros(w * channels, np.uint8)
        for y, row in enumerate(rows):
            before = out[y] = _unfiltered(int(row[0]), row[1:], before, channels)
        x = out.reshape(h, w, channels).astype(float)
        return np.rint(x[..., :3] @ [0.299, 0.587, 0.114] if channels > 2 else x[..., 0]).astype(np.uint8)
    except (zlib.error, struct.error, ValueError, TypeError):
        return None


def _unfiltered(kind: int, row: np.ndarray, before: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + before
    out = np.zeros(len(row) + step, np.uint8)
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    for i, v in enumerate(row.tolist()):
        a, b, c = int(out[i]), int(before[i]), int(before[i - step]) if i >= step else 0
        p = a + b - c
        guess = (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i + step] = (v + guess) & 255
    return out[step:]


def read_images(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """``id`` (the path), ``width``, ``height``, ``pixels`` of the pictures under a folder, in the order of their paths.

    PNG files can be decoded here; files of other kinds and damaged ones have null pixels and are left out by ``where``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.where(F.lower("path").rlike(r"\.(png|jpe?g|webp|bmp|tiff?)$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                x = read_png(data.as_py() or b"")
                values = [path, None, None, None] if x is None else [path, x.shape[1], x.shape[0], x.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["id", "width", "height", "pixels"])

    found = named.select("path", "content").mapInArrow(run, "id string, width int, height int, pixels binary").where("pixels is not null")
    return found if not limit else found.orderBy("id").limit(limit)


def encode_png(pages: DataFrame) -> DataFrame:
    """``id``, ``image`` of rows of id, width, height and grey pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if x is None else png(np.frombuffer(x, np.uint8).reshape(h, w)) for w, h, x in zip(*(b.column(c).to_pylist() for c in ("width", "height", "pixels")))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(made, pa.binary())], names=["id", "image"])

    return pages.select(F.col("id").cast("string").alias("id"), "width", "height", "pixels").mapInArrow(run, "id string, image binary")


def write_images(images: DataFrame, folder: str, extension: str = "png") -> DataFrame:
    """Writes ``images/<id>.<ext>`` of rows of id and image; ``id``, ``path`` of what was written. A task that runs twice leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{path}/images", recursive=True)
        for b in batches:
            ids, names = b.column("id").to_pylist(), []
            for i, data in zip(ids, b.column("image")):
                names.append(f"images/{i}.{extension}")
                with system.open_output_stream(f"{path}/{names[-1]}") as out:
                    out.write(data.as_py())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.string())], names=["id", "path"])

    return images.where("image is not null").select(F.col("id").cast("string").alias("id"), F.col("image").cast("binary").alias("image")).mapInArrow(run, "id string, path string")


def recognition_labels(pages: DataFrame) -> DataFrame:
    """``id``, ``crop_id``, ``label``, ``crop``: a line of a label file and the box of its picture for every line that is not blank and has two pixels a side; the number counts all lines."""
    lines = pages.select("id", F.col("page.width").alias("w"), F.col("page.height").alias("h"), F.posexplode(an.page_lines(F.col("page"))).alias("n", "line"))
    cut = lines.withColumn("crop", g.clip(F.col("line.bbox"), 0, 0, F.col("w"), F.col("h")))
    kept = cut.where((F.trim("line.text") != "") & (g.width(F.col("crop")) >= 2) & (g.height(F.col("crop")) >= 2))
    name = F.format_string("%s_%04d", "id", "n")
    return kept.select("id", name.alias("crop_id"), F.concat(F.lit("line_crops/"), name, F.lit(".png\t"), F.col("line.text")).alias("label"), "crop")


def crop_pictures(pages: DataFrame) -> DataFrame:
    """``id`` (of the crop), ``image``: the pictures of the lines of pages with id, page, width, height and pixels."""
    crops = recognition_labels(pages).groupBy("id").agg(F.collect_list(F.struct("crop_id", "crop")).alias("crops"))
    rows = pages.select("id", "width", "height", "pixels").join(crops, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, h, pixels, found in zip(*(b.column(c).to_pylist() for c in ("width", "height", "pixels", "crops"))):
                if pixels is None or len(pixels) != w * h:
                    continue
                x, made = np.frombuffer(pixels, np.uint8).reshape(h, w), []
                for c in found:
                    part = x[int(np.floor(c["crop"]["y0"])) : int(np.ceil(c["crop"]["y1"])), int(np.floor(c["crop"]["x0"])) : int(np.ceil(c["crop"]["x1"]))]
                    if part.size:
                        made.append((c["crop_id"], png(part)))
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["id", "image"])

    return rows.mapInArrow(run, "id string, image binary")


# sinks by name


def _jsonl(pages: DataFrame, folder: str, extension: str, instruction: str) -> DataFrame:
    return _lines(pages, record(F.col("id"), F.col("page"), _path(extension), F.col("provenance")), folder, "annotations-{:05d}.jsonl")


def _chat(pages: DataFrame, folder: str, extension: str, instruction: str) -> DataFrame:
    return _lines(pages, chat(F.col("id"), _path(extension), an.page_markdown(F.col("page")), instruction), folder, "chat-{:05d}.jsonl")


def _paddle(pages: DataFrame, folder: str, extension: str, instruction: str) -> DataFrame:
    labels = recognition_labels(pages).join(pages.select("id", "shard"), "id").select("shard", F.col("crop_id").alias("place"), F.concat("label", F.lit("\n")).alias("piece"))
    write_pieces(labels, folder, "rec_label-{:05d}.txt").collect()
    if {"pixels", "width", "height"} <= set(pages.columns):
        write_images(crop_pictures(pages), folder + "/line_crops").count()
    return _lines(pages, detection_label(_path(extension), F.col("page")), folder, "det_label-{:05d}.txt")


def _tar(pages: DataFrame, folder: str, extension: str, instruction: str) -> DataFrame:
    image = F.col("image") if "image" in pages.columns else F.lit(None).cast("binary")
    rows = pages.select("shard", "id", image.alias("image"), record(F.col("id"), F.col("page"), F.lit(None).cast("string"), F.col("provenance")).alias("record"))
    return write_tar(rows, folder, extension).withColumnRenamed("pages", "pieces")


def _parquet(pages: DataFrame, folder: str, extension: str, instruction: str) -> DataFrame:
    x = F.col("page")
    flat = pages.select("shard", "id", _path(extension).alias("image_path"), x["width"].alias("width"), x["height"].alias("height"), x["direction"].alias("direction"), an.page_text(x).alias("text"), an.page_markdown(x).alias("markdown"), an.page_html(x).alias("html"), F.to_json(x).alias("page"), F.to_json("provenance").alias("provenance"))
    write_parquet(flat, folder)
    return pages.sparkSession.read.parquet(folder).groupBy("shard").agg(F.count("*").alias("pieces"))


def _coco(pages: DataFrame, folder: str, extension: str, instruction: str) -> DataFrame:
    return write_pieces(coco_parts(pages, extension), folder, "instances-{:05d}.json")


def _path(extension: str) -> Column:
    return F.format_string(f"images/%s.{extension}", "id")


def _lines(pages: DataFrame, value: Column, folder: str, name: str) -> DataFrame:
    return write_pieces(pages.select("shard", F.col("id").alias("place"), F.concat(value, F.lit("\n")).alias("piece")), folder, name)


SINKS: dict[str, Callable[..., DataFrame]] = {"chat": _chat, "coco": _coco, "jsonl": _jsonl, "paddleocr": _paddle, "parquet": _parquet, "webdataset": _tar}


def sink_names() -> tuple[str, ...]:
    return tuple(sorted(SINKS))


def register_sink(name: str, sink: Callable[..., DataFrame]) -> None:
    """Adds a sink: a function of pages, folder, extension and instruction that writes, and gives ``shard``, ``pieces``."""
    SINKS[name] = sink


def write(name: str, pages: DataFrame, folder: str, extension: str = "png", instruction: str = INSTRUCTION) -> DataFrame:
    """Writes pages (shard, id, page, provenance, and image where there is one) in a format; what was written by shard.

    An empty shard has no file. Pictures go to ``images/``, but for tar shards, which hold them.
    """
    if name not in SINKS:
        raise ValueError(f"unknown format {name!r}; one of {', '.join(sink_names())}")
    if "image" in pages.columns and name != "webdataset":
        write_images(pages.select("id", "image"), folder, extension).count()
    return SINKS[name](pages, folder, extension, instruction)


def detection_label(image_path: Column, page: Column) -> Column:
    """``path<TAB>JSON`` of the lines that are not blank, with four corners each."""
    lines = F.filter(an.page_lines(page), lambda x: F.trim(x["text"]) != "")
    corners = lambda x: F.transform(F.coalesce(x["polygon"], g.polygon(x["bbox"])), lambda v: F.round(v, 1))
    quad = lambda p: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.get(p, 2 * i), F.get(p, 2 * i + 1)))
    return F.concat_ws("\t", image_path, F.to_json(F.transform(lines, lambda x: F.struct(x["text"].alias("transcription"), quad(corners(x)).alias("points")))))


def line_crops(pages: DataFrame, pad: float = 3, least: float = 12) -> DataFrame:
    """Crop boxes of lines, padded, within the page, of a least size; the number counts all lines."""
    lines = pages.select("id", "page.width", "page.height", F.posexplode(an.page_lines(F.col("page"))).alias("n", "line"))
    box = g.clip(g.pad(F.col("line.bbox"), pad), 0, 0, F.col("width"), F.col("height"))
    found = lines.withColumn("crop", box).where((g.width(F.col("crop")) >= least) & (g.height(F.col("crop")) >= least))
    return found.select("id", F.format_string("%s_%04d", "id", "n").alias("crop_id"), F.col("line.text").alias("text"), F.col("line.direction").alias("direction"), "crop")
