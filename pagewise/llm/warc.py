"""Zstandard-compressed WARC archives with a dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or compressed itself;
every record is one frame after that. Reading walks the frames by their block headers, which tell their lengths
without decompression, and deals ranges of frames of about ``RANGE_BYTES`` to tasks, so that one long archive is read
in parallel. Each frame is decoded on its own and its record's version line, headers, Content-Length and payload
digest are validated.

Defined results: a damaged or truncated dictionary gives such a row for every frame of its archive; a damaged frame, header or length gives a row with ``valid`` false and the ``error``, and reading
goes on with the next frame; a truncated archive gives such a row for its last frame; an empty archive has no rows;
records are rows in any order with ``archive`` and ``offset`` naming their place. ``write_archives`` writes a null
html as an empty payload with the header ``X-Null``, null ids and urls as missing headers; texts may be of any length.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, sample_texts

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
RANGE_BYTES, MOST_TASKS = 8 << 20, 20_000
DICTIONARY_BYTES, SAMPLED_PAGES = 64 << 10, 2000
RECORD = "archive string, offset bigint, record_id string, record_type string, target_uri string, content_length bigint, payload binary, valid boolean, error string, headers map<string,string>"
_TYPES = pa.schema(
    [
        ("archive", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("content_length", pa.int64()), ("payload", pa.binary()), ("valid", pa.bool_()), ("error", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
    ]
)


class _Reader:
    """Bytes of a file at any place, with a window of what was read last."""

    def __init__(self, f, window: int = 1 << 18):
        self.f, self.window, self.at, self.held, self.size = f, window, 0, b"", f.size()

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.f.seek(at)
            self.at, self.held = at, self.f.read(max(n, self.window))
        return self.held[at - self.at : at - self.at + n]


def frame_length(r: _Reader, at: int) -> int:
    """Length of the frame at a place, from its headers alone; raises ValueError if it is none or goes past the end."""
    magic = r.get(at, 8)
    if len(magic) < 5:
        raise ValueError("truncated frame")
    number = struct.unpack("<I", magic[:4])[0]
    if 0x184D2A50 <= number <= 0x184D2A5F:
        if len(magic) < 8:
            raise ValueError("truncated frame")
        n = 8 + struct.unpack("<I", magic[4:8])[0]
        if at + n > r.size:
            raise ValueError("truncated frame")
        return n
    if number != FRAME:
        raise ValueError("no frame magic")
    flags = magic[4]
    single, content, checksum, dictionary = flags >> 5 & 1, flags >> 6, flags >> 2 & 1, flags & 3
    p = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[dictionary] + ((1 if single else 0), 2, 4, 8)[content]
    while True:
        head = r.get(p, 3)
        if len(head) < 3:
            raise ValueError("truncated frame")
        block = head[0] | head[1] << 8 | head[2] << 16
        p += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    p += 4 * checksum
    if p > r.size:
        raise ValueError("truncated frame")
    return p - at


def read_dictionary(r: _Reader) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of the leading skippable frame, which may be compressed; None if there is no such frame.

    Raises ValueError if it is damaged or truncated.
    """
    head = r.get(0, 8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        return None
    n = struct.unpack("<I", head[4:])[0]
    data = r.get(8, n)
    if len(data) < n:
        raise ValueError("truncated dictionary")
    try:
        if data[:4] == struct.pack("<I", FRAME):
            unpack = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
            data = unpack.decompress(data)
            if not unpack.eof:
                raise ValueError("truncated dictionary")
        made = zstandard.ZstdCompressionDict(data)
        zstandard.ZstdDecompressor(dict_data=made)
        return made
    except zstandard.ZstdError as e:
        raise ValueError(f"dictionary: {e}") from e


def build_record(record_id: str | None, uri: str | None, payload: bytes, record_type: str = "resource", extra: dict[str, str] | None = None) -> bytes:
    head = {"WARC-Type": record_type, "WARC-Record-ID": record_id, "WARC-Target-URI": uri, "WARC-Date": "2000-01-01T00:00:00Z", "Content-Type": "text/html; charset=utf-8"}
    head |= (extra or {}) | {"WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(), "Content-Length": str(len(payload))}
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Headers, payload and what is wrong, if anything."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0:
        return {}, b"", "no end of headers"
    first, *rest = data[:cut].split(b"\r\n")
    if first not in (b"WARC/1.0", b"WARC/1.1"):
        return {}, b"", "no version line"
    headers: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return headers, b"", "bad header line"
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdecimal():
        return headers, b"", "no content length"
    body = data[cut + 4 :]
    payload = body[: int(length)]
    if body[int(length) :] != b"\r\n\r\n" or len(payload) != int(length):
        return headers, payload, "content length does not match"
    if "warc-type" not in headers:
        return headers, payload, "no record type"
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
        return headers, payload, "payload digest does not match"
    return headers, payload, None


def train_dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES, sampled: int = SAMPLED_PAGES) -> bytes:
    """A dictionary trained on a bounded sample of payloads; empty if there are too few to train one."""
    try:
        return zstandard.train_dictionary(size, [t.encode() for t in sample_texts(pages, "html", sampled)]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, level: int = 3) -> DataFrame:
    """Writes one archive for each partition of (page_id, url, html); ``archive``, ``records`` of what was written.

    An archive is moved to its name when it is complete, and the name is that of the partition, so that a task that
    runs twice leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"{path}/part-{context.partitionId():05d}.warc.zst"
        part, records = f"{path}/.{context.taskAttemptId()}-{context.partitionId()}", 0
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
        with system.open_output_stream(part) as out:
            packed = zstandard.ZstdCompressor(level=level, write_checksum=True).compress(dictionary)
            if dictionary:
                out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
            for b in batches:
                for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    extra = {"X-Null": "html"} if html is None else {}
                    out.write(press.compress(build_record(None if page is None else f"<urn:page:{page}>", url, (html or "").encode(), extra=extra)))
                    records += 1
        system.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["archive", "records"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "archive string, records bigint")


def _archives(folder: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives of a folder."""
    from pyarrow import fs

    system, path = file_system(folder)
    return sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".warc.zst"))


def ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``archive``, ``start``, ``end``: ranges of whole frames, and ranges that are no frames with an ``error``."""
    names = [name for name, _ in _archives(folder)]
    schema = "archive string, start bigint, end bigint, error string"
    if not names:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                found, at, start = [], 0, 0
                with system.open_input_file(name) as f:
                    r = _Reader(f)
                    while at < r.size:
                        try:
                            n = frame_length(r, at)
                        except ValueError as e:
                            if at > start:
                                found.append((name, start, at, None))
                            begin = at
                            at = _next_frame(r, at + 1)
                            found.append((name, begin, at, str(e)))
                            start = at
                            continue
                        at += n
                        if at - start >= range_bytes:
                            found.append((name, start, at, None))
                            start = at
                    if at > start:
                        found.append((name, start, at, None))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["archive", "start", "end", "error"])

    listed = spark.createDataFrame([(n,) for n in names], "archive string").repartition(min(len(names), MOST_TASKS))
    return listed.mapInArrow(run, schema)


def _next_frame(r: _Reader, at: int) -> int:
    """The next place that holds a frame's magic, or the end."""
    magic, step = struct.pack("<I", FRAME), 1 << 16
    while at < r.size:
        k = r.get(at, step + 3).find(magic)
        if k >= 0:
            return at + k
        at += step
    return r.size


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives ``*.warc.zst`` of a folder; see ``RECORD`` for the columns."""

    def row(name: str, at: int, headers: dict, payload: bytes | None, error: str | None) -> tuple:
        length = headers.get("content-length", "")
        return name, at, headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), int(length) if length.isdecimal() else None, payload, error is None, error, list(headers.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for b in batches:
            for name, start, end, error in zip(*(b.column(c).to_pylist() for c in ("archive", "start", "end", "error"))):
                rows, held = [], 0
                if error is not None:
                    rows.append(row(name, start, {}, None, error))
                else:
                    with system.open_input_file(name) as f:
                        r, at, broken = _Reader(f, 1 << 20), start, None
                        try:  # the window's size limits what a damaged header can ask for
                            unpack = zstandard.ZstdDecompressor(dict_data=read_dictionary(r), max_window_size=1 << 31)
                        except ValueError as e:
                            broken = str(e)
                        while at < end:
                            n = frame_length(r, at)
                            data = r.get(at, n)
                            if struct.unpack("<I", data[:4])[0] == FRAME:
                                try:
                                    if broken is not None:
                                        raise zstandard.ZstdError(broken)
                                    headers, payload, wrong = parse_record(unpack.decompressobj().decompress(data))
                                except zstandard.ZstdError as e:
                                    headers, payload, wrong = {}, None, f"frame: {e}"
                                rows.append(row(name, at, headers, payload, wrong))
                                held += len(payload or b"")
                            at += n
                            if held > 1 << 22:
                                yield _records(rows)
                                rows, held = [], 0
                if rows:
                    yield _records(rows)

    # a number of its own, as ranges are small rows that would be put together in one task otherwise
    tasks = min(MOST_TASKS, max(1, sum(-(-size // range_bytes) for _, size in _archives(folder))))
    return ranges(spark, folder, range_bytes).repartition(tasks).mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.types)], schema=_TYPES)


def pages(records: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``content_length``, ``valid`` of the records that ``write_archives`` made."""
    return records.select(
        F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint").alias("page_id"),
        F.col("target_uri").alias("url"),
        F.when(F.try_element_at("headers", F.lit("x-null")).isNull(), F.col("payload").cast("string")).alias("html"),
        "content_length",
        "valid",
    )
