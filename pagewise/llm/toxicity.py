"""Toxic spans: a linear-chain conditional random field over tokens.

Labels exist for documents only, so labelled tokens are made first: in documents labelled toxic, a token is taken
as toxic where its word or a beginning of it is found in many of those documents and in next to none of the clean
ones. The field (two labels, features: word, first four and first five bytes) is fitted to these tokens in one task,
on a sample bounded by ``max_toxic`` and ``max_clean`` documents of at most ``max_chars`` characters each; the driver
receives no text, only the field. The score from which a document is toxic is calibrated on documents held out: each
half of the sample is scored by a field fitted to the other. Scoring needs no shuffle: one pass over the scan runs the
exact forward-backward recursion on whole texts. A document's score is the sum, over its different words, of their
largest marginals, where these are ``LEAST_MARGINAL`` or more: what is less says nothing, and would add up in a long
text.

Defined results: a null or empty text has score 0, no spans and is clean; every input row gives one output row,
repeated rows too; a null id stays null; without labelled documents of both kinds nothing is toxic; offsets count
code points of the text; extra columns play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import release

BITS = 18
SIZE = 1 << BITS
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 600, 1200, 200_000
LEAST_MARGINAL = 0.05
SCHEMA = "doc_id bigint, score double, toxic int, spans array<struct<start:int,end:int,marginal:double>>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("score", pa.float64()),
        ("toxic", pa.int32()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))),
    ]
)


@dataclass
class Field:
    """Weights of the toxic label against the other one; ``move`` holds log potentials from row to column."""

    weight: np.ndarray
    bias: float
    begin: float
    move: np.ndarray
    threshold: float
    keys: list[np.ndarray]


def features(w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """Three slots a token: its word, its first four and its first five bytes (SIZE * 3 where it is shorter); their keys."""
    out = np.full((3, len(w.starts)), 3 * SIZE, np.int64)
    keys = np.zeros((3, len(w.starts)), np.uint64)
    keys[0] = w.hashes
    out[0] = (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    length = w.ends - w.starts
    for k, n in ((1, 4), (2, 5)):
        at = np.flatnonzero(length > n)
        h = np.zeros(len(at), np.uint64)
        for b in range(n):
            h = (h << np.uint64(8)) | w.data[w.starts[at] + b].astype(np.uint64)
        keys[k, at] = tb.mix(h + np.uint64(n))
        out[k, at] = (keys[k, at] >> np.uint64(64 - BITS)).astype(np.int64) + k * SIZE
    return out, keys


def _apart(f: np.ndarray, keys: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """Moves tokens off the slots of known toxic keys where their own key is another one."""
    for k in range(3):
        if len(known[k]):
            taken = np.zeros(3 * SIZE + 1, bool)
            taken[(known[k] >> np.uint64(64 - BITS)).astype(np.int64) + k * SIZE] = True
            at = np.flatnonzero(taken[f[k]])
            found = np.searchsorted(known[k], keys[k, at])
            f[k, at[known[k][np.minimum(found, len(known[k]) - 1)] != keys[k, at]]] = 3 * SIZE
    return f


def _blocks(x: np.ndarray, rows: int, fill: float) -> np.ndarray:
    cols = -(-len(x) // rows)
    padded = np.full(rows * cols, fill)
    padded[: len(x)] = x
    return np.ascontiguousarray(padded.reshape(cols, rows).T)


def forward_backward(emission: np.ndarray, first: np.ndarray, begin: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact forward and backward messages as ratios of the two labels.

    The tokens of all sequences form one chain whose links into a ``first`` token forget what came before. The chain is
    cut into blocks that advance side by side: products of 2x2 matrices give the state at each block's edge, and a
    second sweep fills in the messages.
    """
    n = len(emission)
    if not n:
        return np.empty(0), np.empty(0)
    rows = max(1, int(np.sqrt(n)))
    e = np.exp(np.clip(emission, -40, 40))
    t00, t01, t10, t11 = np.exp(move).ravel()
    s = np.exp(begin)
    E, head = _blocks(e, rows, 1.0), _blocks(first.astype(float), rows, 1.0) > 0
    a00, a10 = np.where(head, 1.0, t00), np.where(head, 1.0, t10)
    a01, a11 = np.where(head, s, t01) * E, np.where(head, s, t11) * E
    cols = E.shape[1]

    def sweep(order: range, left: bool) -> np.ndarray:
        m = [np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)]
        for i in order:
            x, y = (m, (a00[i], a01[i], a10[i], a11[i])) if left else ((a00[i], a01[i], a10[i], a11[i]), m)
            m = [x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3]]
            scale = 1.0 / (m[0] + m[1] + m[2] + m[3])
            m = [v * scale for v in m]
        return np.array(m)

    M = sweep(range(rows), True)
    edge, r = np.ones(cols), 1.0
    for c in range(cols):
        edge[c] = r
        r = (M[1, c] + M[3, c] * r) / (M[0, c] + M[2, c] * r)
    forward, r = np.empty_like(E), edge
    for i in range(rows):
        r = (a01[i] + a11[i] * r) / (a00[i] + a10[i] * r)
        forward[i] = r
    M = sweep(range(rows - 1, -1, -1), False)
    edge, q = np.ones(cols), 1.0
    for c in range(cols - 1, -1, -1):
        edge[c] = q
        q = (M[2, c] + M[3, c] * q) / (M[0, c] + M[1, c] * q)
    backward, q = np.empty_like(E), edge
    for i in range(rows - 1, -1, -1):
        backward[i] = q
        q = (a10[i] + a11[i] * q) / (a00[i] + a01[i] * q)
    return forward.T.ravel()[:n], backward.T.ravel()[:n]


def emissions(f: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    return weight[f[0]] + weight[f[1]] + weight[f[2]] + bias


def marginals(field: Field, w: tb.Words) -> np.ndarray:
    """Probability of the toxic label for each token."""
    first = np.zeros(len(w.starts), bool)
    first[w.offsets[:-1][np.diff(w.offsets) > 0]] = True
    slots = _apart(*features(w), field.keys)
    f, b = forward_backward(emissions(slots, field.weight, field.bias), first, field.begin, field.move)
    x = f * b
    return x / (1.0 + x)


def document_scores(p: np.ndarray, w: tb.Words, least: float = LEAST_MARGINAL) -> np.ndarray:
    """The expected number of different toxic words of each row: of a word that repeats, the largest marginal counts."""
    out = np.zeros(len(w.offsets) - 1)
    at = np.flatnonzero(p >= least)
    if len(at):
        order = at[np.lexsort((-p[at], w.hashes[at], w.rows[at]))]
        row, word = w.rows[order], w.hashes[order]
        first = np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])])
        np.add.at(out, row[first], p[order[first]])
    return out


def _singles(w: tb.Words, keys: int = 6) -> np.ndarray:
    """Which rows to keep so that copies, near ones too, do not count as evidence more than once.

    A row goes if one of its minima over hashed word triples was seen in a row before.
    """
    keep, seen = np.ones(len(w.offsets) - 1, bool), [set() for _ in range(keys)]
    h = w.hashes
    for i, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:])):
        if a == b:
            continue
        triples = h[a : b - 2] * np.uint64(3) + h[a + 1 : b - 1] * np.uint64(5) + h[a + 2 : b] * np.uint64(7) if b - a > 2 else h[a:b]
        least = [int(tb.mix(triples ^ np.uint64(k * 0x9E3779B1)).min()) for k in range(keys)]
        keep[i] = not any(x in s for x, s in zip(least, seen))
        for x, s in zip(least, seen):
            s.add(x)
    return keep


def token_labels(f: np.ndarray, keys: np.ndarray, w: tb.Words, toxic: np.ndarray, share: float = 0.9, log_odds: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Labelled tokens from labelled documents; see the module.

    A slot must be in so many toxic documents that, were the labels drawn at random, fewer than exp(-log_odds) slots
    of its kind would be in as many without being in clean ones. Where documents share a passage, its words count
    once: documents count no more than the different pairs of neighbours do. A beginning counts without its most
    frequent word, which is a feature itself.
    """
    rows, total = w.rows, 3 * SIZE + 1
    strong = np.zeros(total, bool)
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    near = np.zeros(len(rows), np.uint64)
    near[1:] += w.hashes[:-1] * np.uint64(3)
    near[:-1] += w.hashes[1:] * np.uint64(5)
    inside, found = toxic[rows], np.zeros(len(rows), bool)
    for k in range(3):
        pair = np.unique(rows * np.int64(total) + f[k])
        slot, t = pair % total, toxic[pair // total]
        hit, miss = np.bincount(slot[t], minlength=total), np.bincount(slot[~t], minlength=total)
        place = np.unique(np.stack([f[k][inside].astype(np.uint64), near[inside]], 1), axis=0)[:, 0]
        hit = np.minimum(hit, np.bincount(place.astype(np.int64), minlength=total))
        if k:
            word = np.unique(np.stack([f[k][inside], f[0][inside], rows[inside]], 1), axis=0)[:, :2]
            word, count = np.unique(word, axis=0, return_counts=True)
            most = np.zeros(total, np.int64)
            np.maximum.at(most, word[:, 0], count)
            hit = np.maximum(hit - most, 0)
        rate_hit, rate_miss = hit / n_toxic, miss / n_clean
        least = (np.log(max(1, np.count_nonzero(hit))) + log_odds) / np.log((n_toxic + n_clean) / n_toxic)
        strong |= (hit >= least) & (rate_hit >= share * (rate_hit + rate_miss + 1e-12))
        at = np.flatnonzero(inside & strong[f[k]] & (f[k] < 3 * SIZE))
        if len(at):  # where keys share a slot, only those that are frequent themselves
            pair = np.unique(np.stack([keys[k][at], rows[at].astype(np.uint64)], 1), axis=0)[:, 0]
            key, count = np.unique(pair, return_counts=True)
            found |= np.isin(keys[k], key[count >= least / 2]) & inside & strong[f[k]]
    strong[3 * SIZE] = False
    return found, strong


def fit(texts: list[str], toxic: list[int], rounds: int = 100, rate: float = 0.5, decay: float = 1e-3) -> Field | None:
    """Fits the field by Adam on the log likelihood of the labelled tokens; None without both kinds of documents."""
    y_doc = np.array(toxic, bool)
    if not y_doc.any() or y_doc.all():
        return None
    single = _singles(tb.words(pa.array([t or "" for t in texts], pa.large_string())))
    texts, y_doc = [t for t, s in zip(texts, single) if s], y_doc[single]
    field = _fit(texts, y_doc, rounds, rate, decay)
    if field is not None:
        held = np.full(len(texts), np.nan)
        for half in (0, 1):
            side = np.cumsum(y_doc) % 2 == half
            side[~y_doc] = (np.cumsum(~y_doc) % 2 == half)[~y_doc]
            other = _fit([t for t, s in zip(texts, side) if not s], y_doc[~side], rounds, rate, decay)
            if other is not None and side.any():
                w = tb.words(pa.array([t or "" for t, s in zip(texts, side) if s], pa.large_string()))
                held[side] = document_scores(marginals(other, w), w)
        known = ~np.isnan(held)
        if y_doc[known].any():
            field.threshold = _threshold(held[known], y_doc[known])
    return field


def _fit(texts: list[str], y_doc: np.ndarray, rounds: int, rate: float, decay: float) -> Field | None:
    if not y_doc.any() or y_doc.all():
        return None
    w = tb.words(pa.array([t or "" for t in texts], pa.large_string()))
    f, keys = features(w)
    y, strong = token_labels(f, keys, w, y_doc)
    if not y.any():
        return None
    mute = ~strong
    mute[:SIZE] = False
    known = [np.unique(keys[k][y & (strong[f[k]] if k else True)]) for k in range(3)]
    f = _apart(f, keys, known)
    first = np.zeros(len(y), bool)
    first[w.offsets[:-1][np.diff(w.offsets) > 0]] = True
    later = np.flatnonzero(~first)
    pair = 2 * y[later - 1].astype(int) + y[later]
    seen_move = np.bincount(pair, minlength=4).astype(float)
    seen_begin = float(y[first].sum())
    del w, keys
    slots = np.flatnonzero(np.bincount(f.ravel(), minlength=3 * SIZE + 1)[:-1])  # the weights of all others stay 0
    n, place = len(slots), np.full(3 * SIZE + 1, len(slots))
    place[slots] = np.arange(n)
    f, mute = place[f], mute[slots]
    empirical = np.concatenate([sum(np.bincount(f[k], weights=y, minlength=n + 1) for k in range(3)), [y.sum(), seen_begin], seen_move])
    theta, m, v = np.zeros(len(empirical)), np.zeros(len(empirical)), np.zeros(len(empirical))
    theta[-6] = -3.0
    for step in range(1, rounds + 1):
        weight, bias, begin, move = theta[: n + 1], theta[-6], theta[-5], theta[-4:].reshape(2, 2)
        e = emissions(f, weight, bias)
        fw, bw = forward_backward(e, first, begin, move)
        p = fw * bw / (1.0 + fw * bw)
        E, T = np.exp(np.clip(e[later], -40, 40)), np.exp(move)
        r, q = fw[later - 1], bw[later]
        cell = np.stack([np.full(len(later), T[0, 0]), T[0, 1] * E * q, r * T[1, 0], r * T[1, 1] * E * q])
        cell /= cell.sum(0)
        expected = np.concatenate([sum(np.bincount(f[k], weights=p, minlength=n + 1) for k in range(3)), [p.sum(), p[first].sum()], cell.sum(1)])
        grad = empirical - expected - decay * theta
        grad[n] = 0.0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate / np.sqrt(step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta[n] = 0.0
        theta[:n][mute] = np.minimum(theta[:n][mute], 0.0)
    weight = np.zeros(3 * SIZE + 1, np.float32)
    weight[slots] = theta[:n]
    return Field(weight, float(theta[-6]), float(theta[-5]), theta[-4:].reshape(2, 2).copy(), 0.5, known)


def _threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The score of best F1, between the two scores next to it, kept within 0.5 and 2."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + toxic.sum())
    k = int(np.argmax(f1))
    low = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return float(np.clip((score[order[k]] + low) / 2, 0.5, 2.0))


def train(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> Field | None:
    """Fits the field to a bounded sample of labelled rows, drawn by a hash of the id; each id is drawn with one text."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda kind, n: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = part(1, max_toxic).unionByName(part(0, max_clean))
    texts = documents.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = sorted((r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist())
        fitted = pickle.dumps(fit([x for _, x, _ in drawn], [x for _, _, x in drawn]))
        release()
        yield pa.RecordBatch.from_pydict({"field": pa.array([fitted], pa.binary())})

    made = rows.repartition(1).mapInArrow(run, "field binary").collect()
    return pickle.loads(bytes(made[0]["field"])) if made else None


def _spans(w: tb.Words, p: np.ndarray, least: float) -> tuple[np.ndarray, pa.Array]:
    """Spans of neighbouring toxic tokens: the number in each row, and the spans."""
    hit = p >= least
    row = w.rows
    link = np.zeros(len(p), bool)
    if len(p):
        link[1:] = hit[:-1] & (row[1:] == row[:-1])
    begin = np.flatnonzero(hit & ~link)
    goes_on = np.zeros(len(p), bool)
    if len(p):
        goes_on[:-1] = hit[1:] & link[1:]
    end = np.flatnonzero(hit & ~goes_on)
    if not len(begin):
        return np.zeros(len(w.offsets) - 1, np.int64), pa.array([], _ARROW.field("spans").type.value_type)
    chars = tb.code_points_before(w.data)
    base = chars[w.row_bytes[row[begin]]]
    top = np.maximum.reduceat(p, np.stack([begin, end + 1], 1).ravel()[: 2 * len(begin) - (end[-1] + 1 >= len(p))])[::2]
    spans = pa.StructArray.from_arrays(
        [pa.array((chars[w.starts[begin]] - base).astype(np.int32)), pa.array((chars[w.ends[end]] - base).astype(np.int32)), pa.array(top.astype(float))],
        names=["start", "end", "marginal"],
    )
    return np.bincount(row[begin], minlength=len(w.offsets) - 1), spans


def score(documents: DataFrame, field: Field | None, span_marginal: float = 0.5) -> DataFrame:
    """Score, verdict and offending offsets of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in tb.chunks(batches, "text"):
            n = part.num_rows
            if model is None:
                top, count, spans = np.zeros(n), np.zeros(n, np.int64), pa.array([], _ARROW.field("spans").type.value_type)
                limit = 1.0
            else:
                w = tb.words(part.column("text"))
                p = marginals(model, w)
                top, limit = document_scores(p, w), model.threshold
                count, spans = _spans(w, p, span_marginal)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(top), pa.array((top >= limit).astype(np.int32) if model is not None else np.zeros(n, np.int32)), lists], schema=_ARROW)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_clean(documents: DataFrame, field: Field | None) -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(field)
    if field is None:
        return documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.chunks(batches, "text"):
            w = tb.words(part.column("text"))
            top = document_scores(marginals(shared.value, w), w)
            kept = part.filter(pa.array(top < shared.value.threshold))
            if kept.num_rows:
                yield kept

    return documents.mapInArrow(run, documents.schema)
