"""Scores of predictions against references: edit distances, tables, boxes, and a report over an id join.

Predictions without a reference are ignored; a reference without a prediction is scored against an empty one and
counted as missing. Where a reference id repeats, the last by the given order wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import annotations as an
from ..functions import geometry as g
from ..functions.text import collapse_white, strip_marks, tokens


def prepare(text: Column, ignore_marks: bool = False, ignore_case: bool = False) -> Column:
    out = strip_marks(text) if ignore_marks else text
    return collapse_white(F.lower(out) if ignore_case else out)


def _rate(distance: Column, n: Column, m: Column) -> Column:
    return F.when(n > 0, distance / n).otherwise(F.when(m > 0, 1.0).otherwise(0.0))


def cer(reference: Column, hypothesis: Column, **flags) -> Column:
    """Edits for each character of the reference; it may exceed 1."""
    r, h = prepare(reference, **flags), prepare(hypothesis, **flags)
    return _rate(F.levenshtein(r, h), F.char_length(r), F.char_length(h))


def token_distance(left: Column, right: Column) -> Column:
    """Edit distance of two arrays of strings: each different token becomes one character of a private plane."""
    words = F.array_distinct(F.concat(left, right))
    # characters from U+4E00 on: one string of them is built on the JVM and indexed by the word's place
    code = lambda a: F.array_join(F.transform(a, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, w) + 0x4DFF), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(code(left), code(right))


def wer(reference: Column, hypothesis: Column, **flags) -> Column:
    r, h = tokens(prepare(reference, **flags)), tokens(prepare(hypothesis, **flags))
    return _rate(token_distance(r, h), F.size(r), F.size(h))


def similarity(reference: Column, hypothesis: Column) -> Column:
    """1 less the edits for each character of the longer text, flags left aside."""
    r, h = prepare(reference), prepare(hypothesis)
    longest = F.greatest(F.char_length(r), F.char_length(h))
    return F.when(longest > 0, F.greatest(F.lit(0.0), 1 - F.levenshtein(r, h) / longest)).otherwise(1.0)


def table_similarity(reference: Column, hypothesis: Column) -> Column:
    """Mean of structure and content; 0 if one side is null, 1 if both have no cells."""
    rows, cols = reference["rows"], reference["cols"]
    delta = F.abs(rows - hypothesis["rows"]) + F.abs(cols - hypothesis["cols"])
    structure = F.greatest(F.lit(0.0), 1 - delta / F.greatest(rows + cols, F.lit(1)))
    origins = F.filter(reference["cells"], lambda x: (x["row"] < rows) & (x["col"] < cols))
    scores = F.transform(origins, lambda x: F.coalesce(similarity(x["text"], an.cell_at(hypothesis, x["row"], x["col"])["text"]), F.lit(0.0)))
    content = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(1.0)
    both_empty = (F.size(reference["cells"]) == 0) & (F.size(hypothesis["cells"]) == 0)
    return F.when(reference.isNull() | hypothesis.isNull(), 0.0).when(both_empty, 1.0).otherwise((structure + content) / 2)


def detection(references: Column, predictions: Column, threshold: float = 0.5) -> Column:
    """Greedy one-to-one matches in the order of predictions: tp, fp, fn, precision, recall, f1."""

    # a place of the references is struck off once it is taken; the best place is found once for each prediction
    def step(state: Column, p: Column) -> Column:
        scored = F.transform(state["free"], lambda i: F.struct(g.iou(F.get(references, i), p).alias("iou"), (-i).alias("i")))
        hits = F.filter(F.array(F.array_max(scored)), lambda b: (b["iou"] > 0) & (b["iou"] >= threshold))
        taken = F.transform(hits, lambda b: -b["i"])
        return F.struct(F.array_except(state["free"], taken).alias("free"), (state["tp"] + F.size(taken)).alias("tp"))

    places = F.when(F.size(references) > 0, F.sequence(F.lit(0), F.size(references) - 1)).otherwise(F.array().cast("array<int>"))
    tp = F.aggregate(predictions, F.struct(places.alias("free"), F.lit(0).alias("tp")), step, lambda s: s["tp"])
    return F.struct(*(c.alias(k) for k, c in _found(tp, F.size(references), F.size(predictions)).items()))


def _found(tp: Column, references: Column, predictions: Column) -> dict[str, Column]:
    precision, recall = F.when(predictions > 0, tp / predictions).otherwise(0.0), F.when(references > 0, tp / references).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"tp": tp, "fp": predictions - tp, "fn": references - tp, "precision": precision, "recall": recall, "f1": f1}


_SIDES = ("reference", "prediction")
_CORNERS = ("x0", "y0", "x1", "y1")


def _greedy(r: np.ndarray, p: np.ndarray, threshold: float) -> np.ndarray:
    """Matches of each of some groups of one size: boxes are groups x places x corners, nan where there is none."""
    free, tp, each = ~np.isnan(r[:, :, 0]), np.zeros(len(r), np.int32), np.arange(len(r))
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    whole = area(r)
    for k in range(p.shape[1]):
        b = p[:, k, None]
        wide, high = (np.minimum(r[:, :, c + 2], b[..., c + 2]) - np.maximum(r[:, :, c], b[..., c]) for c in (0, 1))
        shared = np.where((wide > 0) & (high > 0), wide * high, 0.0)
        total = whole + area(b) - shared
        iou = np.where(free & (shared > 0) & (total > 0), shared / np.where(total > 0, total, 1.0), 0.0)
        best = iou.argmax(1)  # the first of equal ones
        most = iou[each, best]
        hit = (most > 0) & (most >= threshold)
        free[each[hit], best[hit]] = False
        tp += hit
    return tp


def detections(rows: DataFrame, *order: str, threshold: float = 0.5, **made: Callable[[Column, Column], Column]) -> DataFrame:
    """``id`` and what ``detection`` finds, for rows of ``id``, ``reference`` and ``prediction``: boxes of one place each, or null.

    Rows are ordered within their id; ``prediction`` may be given as a function of the reference and its place from 0.
    Groups of one size are matched together, so that a group costs no more than its boxes.
    """
    by = Window.partitionBy("id").orderBy(*order)  # leaves the rows of an id together and in order
    placed = rows.withColumn("_at", F.row_number().over(by) - 1)
    placed = placed.withColumns({k: f(F.col("reference"), F.col("_at")) for k, f in made.items()})
    # the place goes along, as a window whose column nobody reads is left out, and its order with it
    flat = placed.select("id", "_at", *(F.col(s)[c].alias(s + c) for s in _SIDES for c in _CORNERS))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if b.num_rows:
                table = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
                ids = table["id"].combine_chunks()
                last = _starts(ids)[-1]  # its id may go on in the next batch
                if last:
                    yield matched(table.slice(0, last))
                rest = table.slice(last)
        if rest is not None:
            yield matched(rest)

    def matched(table: pa.Table) -> pa.RecordBatch:
        ids = table["id"].combine_chunks()
        starts = _starts(ids)
        sizes = np.diff(np.append(starts, len(ids)))
        r, p = (np.stack([table[s + c].to_numpy() for c in _CORNERS], 1) for s in _SIDES)
        tp, counts = np.zeros(len(starts), np.int32), [np.add.reduceat(~np.isnan(x[:, 0]), starts, dtype=np.int32) for x in (r, p)]
        for n in np.unique(sizes):
            some = np.flatnonzero(sizes == n)
            at = starts[some][:, None] + np.arange(n)
            tp[some] = _greedy(r[at], p[at], threshold)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), *map(pa.array, (tp, *counts))], names=["id", "tp", "references", "predictions"])

    out = flat.mapInArrow(run, f"id {kind}, tp int, references int, predictions int")
    return out.select("id", *(c.alias(k) for k, c in _found(F.col("tp"), F.col("references"), F.col("predictions")).items()))


def _starts(ids: pa.Array) -> np.ndarray:
    """Where runs of one id begin; nulls are one id."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def last_of_each(references: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("id").orderBy(*[o.desc() for o in order])
    return references.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pair_scores(references: DataFrame, predictions: DataFrame, **flags) -> DataFrame:
    """``id``, ``cer``, ``wer``, ``similarity``, ``n_chars`` (of the reference as it is), ``missing``.

    ``references`` has id and reference, ``predictions`` id and prediction, with ids once.
    """
    joined = references.join(predictions.select("id", "prediction"), "id", "left")
    r, h = F.col("reference"), F.coalesce(F.col("prediction"), F.lit(""))
    return joined.select("id", cer(r, h, **flags).alias("cer"), wer(r, h, **flags).alias("wer"), similarity(r, h).alias("similarity"), F.char_length(r).alias("n_chars"), F.col("prediction").isNull().alias("missing"))


def report(scores: DataFrame) -> DataFrame:
    """One row: samples, missing, macro CER, WER and similarity, and micro CER by reference length."""
    zero = F.lit(0.0)
    return scores.agg(
        F.count("*").alias("samples"),
        F.count_if("missing").alias("missing"),
        F.coalesce(F.avg("cer"), zero).alias("cer_macro"),
        F.coalesce(F.sum(F.col("cer") * F.col("n_chars")) / F.nullif(F.sum("n_chars"), F.lit(0)), zero).alias("cer_micro"),
        F.coalesce(F.avg("wer"), zero).alias("wer"),
        F.coalesce(F.avg("similarity"), zero).alias("similarity"),
    )


def worst(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("cer"), "id").limit(n)


def prediction_text(fields: Column) -> Column:
    """The first of text, markdown, html, prediction, output that a map of strings has, whatever its value; else empty."""
    names = ("text", "markdown", "html", "prediction", "output")
    return reduce(lambda rest, n: F.when(F.map_contains_key(fields, n), F.coalesce(F.try_element_at(fields, F.lit(n)), F.lit(""))).otherwise(rest), reversed(names), F.lit(""))
