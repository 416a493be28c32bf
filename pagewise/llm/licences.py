"""Licence notices: a trained classifier of paragraphs, window by window, confirmed by comparison with templates.

A paragraph is a run of lines that have words; a line without words ends it, so a notice that is wrapped over lines is
seen whole. The classifier is multinomial logistic regression over hashed word unigrams, bigrams and trigrams of the
paragraph's windows of ``WINDOW`` words, as a notice may stand among other words. Its classes are the families below,
what is no licence, and licences that are none of the families. It is trained here, on notices made from the templates
and from texts of other licences (words left out and added, cut, amid words of the corpus) and on a bounded sample of
the corpus itself. Its temperature, the bar from which a window counts and the probability that a family needs are
calibrated on windows held out; the last one on licences that were not trained on, which must come out as unknown.

Neighbouring windows that count are one place. A prediction is confirmed where the place holds enough of a template of
its family, word for word in order, and the words that only this family's template has; of templates that lie across
each other, the one of which more words are found stays. Where no template confirms a family, the place is ``unknown``;
such a place has at least ``UNKNOWN_WORDS`` different words of licences, so that words that repeat make none.

Scoring is one pass without a shuffle. Defined results: null and empty texts have no notices; each notice of each row
gives one row, repeated rows too; a null id stays null; ties between families go to the first by name; extra columns
play no part; an empty table gives an empty result. Offsets count code points; ``paragraph`` counts them in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .licence_texts import OTHER, TEMPLATES
from .shared import release, sample_texts

FAMILIES = ("none", *sorted(TEMPLATES), "other")
BITS, SAMPLED_PARAGRAPHS, NOTICES = 18, 6_000, 90
WINDOW, STRIDE = 12, 4
#: A template must be found with this share of its words, in order; templates of up to SHORT words with all words of their own.
COVERAGE, SHORT = 0.75, 16
UNKNOWN_WORDS = 4
SCHEMA = "doc_id bigint, paragraph int, start int, end int, family string, probability double, template string, coverage double"
_FIELDS = [
    ("doc_id", pa.int64()), ("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
    ("family", pa.string()), ("probability", pa.float64()), ("template", pa.string()), ("coverage", pa.float64()),
]


@dataclass
class Model:
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    bar: float
    sure: float


@dataclass
class Paragraphs:
    """Tokens of some rows grouped by paragraph."""

    w: tb.Words
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray
    number: np.ndarray


def paragraphs(texts: pa.Array) -> Paragraphs:
    """Runs of lines that have words: their tokens, rows and numbers in the row."""
    w = tb.words(texts)
    rows, line = w.rows, np.searchsorted(np.flatnonzero(w.data == 10), w.starts)
    begin = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (np.diff(line) > 1)])) if len(line) else np.empty(0, np.int64)
    row = rows[begin]
    return Paragraphs(w, begin, np.append(begin[1:], len(line)).astype(np.int64), row, np.arange(len(row)) - np.searchsorted(row, row))


def windows(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraph, first and last token of the windows that cover paragraphs; a short paragraph is one."""
    size = last - first
    count = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
    which = np.repeat(np.arange(len(first)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(first[which] + STRIDE * step, np.maximum(last - WINDOW, first)[which])
    return which, begin, np.minimum(begin + WINDOW, last[which])


def features(p: Paragraphs) -> np.ndarray:
    """Slots of each token's unigram, bigram and trigram; the last slot where the paragraph ends before."""
    h, n = p.w.hashes, len(p.w.hashes)
    left = np.repeat(p.last, p.last - p.first) - np.arange(n)
    second, third = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    second[:-1], third[:-2] = h[1:], h[2:]
    two = h * np.uint64(3) + second * np.uint64(5)
    out = np.stack([h, tb.mix(two), tb.mix(two + third * np.uint64(7))])
    out = (out >> np.uint64(64 - BITS)).astype(np.int64)
    out[1, left < 2], out[2, left < 3] = 1 << BITS, 1 << BITS
    return out


def probabilities(p: Paragraphs, begin: np.ndarray, end: np.ndarray, m: Model) -> np.ndarray:
    """Of each window and class: sums of weights divided by the root of the window's length, as odds."""
    f = features(p)
    total = np.zeros((len(p.w.hashes) + 1, len(m.bias)))
    np.cumsum(m.weight[f[0]] + m.weight[f[1]] + m.weight[f[2]], axis=0, dtype=float, out=total[1:])
    return _softmax(((total[end] - total[begin]) / np.sqrt(end - begin)[:, None] + m.bias) / m.temperature)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


# templates


@dataclass
class Template:
    name: str
    words: list[int]
    places: dict[int, int]
    own: set[int]


_TEMPLATES: dict[str, list[Template]] = {}


@lru_cache(maxsize=1)
def vocabulary() -> np.ndarray:
    """The words of all licence texts."""
    return np.unique(tb.words(pa.array([*(t for f in TEMPLATES.values() for t in f), *OTHER], pa.large_string())).hashes)


def templates(family: str) -> list[Template]:
    """The templates of a family: their words, the places of each as bits, and the words that no other family's short ones have."""
    if not _TEMPLATES:
        made, held = {}, {}
        for name, texts in TEMPLATES.items():
            w = tb.words(pa.array(texts, pa.large_string()))
            made[name] = [(t, w.hashes[a:b].tolist()) for t, a, b in zip(texts, w.offsets[:-1], w.offsets[1:])]
            for _, words in made[name]:
                for x in words if len(words) <= SHORT else ():
                    held.setdefault(x, set()).add(name)
        for name, texts in made.items():
            _TEMPLATES[name] = []
            for text, words in texts:
                places: dict[int, int] = {}
                for k, x in enumerate(words):
                    places[x] = places.get(x, 0) | 1 << k
                own = {x for x in words if held.get(x) == {name}} if len(words) <= SHORT else set()
                title = " ".join(text.split()[:12])
                _TEMPLATES[name].append(Template(title + " ..." * (len(words) > SHORT), words, places, own))
    return _TEMPLATES[family]


def common(words: list[int], t: Template) -> int:
    """Length of the longest common subsequence with a template; its row is the bits of one integer."""
    full = (1 << len(t.words)) - 1
    row = full
    for x in words:
        hit = row & t.places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(t.words) - row.bit_count()


def matches(words: np.ndarray, t: Template, coverage: float = COVERAGE) -> list[tuple[int, int, int]]:
    """Matched words, first and last word of the places that hold a template; they do not overlap."""
    m, least = len(t.words), int(np.ceil(coverage * len(t.words) - 1e-9))
    size = m + m // 4 + 3
    inside = np.concatenate([[0], np.cumsum(np.isin(words, np.array(t.words, np.uint64)))])
    begin = np.arange(0, max(1, len(words) - size + 1), max(1, m // 8))
    if len(words) > size and begin[-1] != len(words) - size:
        begin = np.append(begin, len(words) - size)
    begin = begin[inside[np.minimum(begin + size, len(words))] - inside[begin] >= least]
    found = [(common(words[a : a + size].tolist(), t), int(a)) for a in begin]
    taken: list[tuple[int, int, int]] = []
    for n, a in sorted((x for x in found if x[0] >= least), key=lambda x: (-x[0], x[1])):
        part = words[a : a + size].tolist()
        lo, hi = 0, len(part)
        while common(part[lo + 1 : hi], t) == n:
            lo += 1
        while common(part[lo : hi - 1], t) == n:
            hi -= 1
        if t.own <= set(part[lo:hi]) and all(a + hi <= s or a + lo >= e for _, s, e in taken):
            taken.append((n, a + lo, a + hi))
    return taken


# training


def notices(rng: np.random.Generator, fillers: list[str], texts: list[str], many: int) -> Iterator[tuple[str, int, int]]:
    """Notices made from some texts, among other words; the first and last word that are the notice's."""
    for i in range(many):
        words = texts[i % len(texts)].split()
        if len(words) > 30 and i % 2:
            n = int(rng.integers(20, len(words)))
            a = int(rng.integers(len(words) - n))
            words = words[a : a + n]
        if len(words) > 4 and i % 3:
            words = [x for x in words if rng.random() > 0.06]
        if i % 4 == 1:
            at = int(rng.integers(len(words) + 1))
            words[at:at] = [fillers[int(k)] for k in rng.integers(len(fillers), size=int(rng.integers(1, 4)))]
        before, after = ([fillers[int(k)] for k in rng.integers(len(fillers), size=int(rng.integers(0, 20)) * int(rng.random() < 0.6))] for _ in range(2))
        yield " ".join([*before, *words, *after]), len(before), len(before) + len(words)


def invented(rng: np.random.Generator, fillers: list[str], many: int) -> list[str]:
    """Notices of licences that nobody knows."""
    forms = ["Licensed under the {} License", "Released under the {} Public License version {}", "This work is licensed under the {} License {}", "Distributed under the terms of the {} licence"]
    names = [" ".join(fillers[int(k)].strip(".,;:!?").capitalize() for k in rng.integers(len(fillers), size=int(rng.integers(1, 3)))) for _ in range(many)]
    return [forms[i % len(forms)].format(name, int(rng.integers(1, 4))) for i, name in enumerate(names)]


def train(documents: DataFrame, sampled: int = SAMPLED_PARAGRAPHS, each: int = NOTICES, rounds: int = 40, seed: int = 7) -> Model:
    """Fits the classifier on notices and a bounded hash sample of the corpus's lines."""
    rows = [x for t in sample_texts(documents, "text", max(1, sampled // 10)) for x in t.split("\n") if x.strip()][:sampled]
    rng = np.random.default_rng(seed)
    fillers = sorted({w for x in rows[:2000] for w in x.split()[:20]}) or ["and"]
    made, kinds, spans, unseen = [], [], [], []
    for k, family in enumerate(FAMILIES):
        if k == 0:
            continue
        strange = family == "other"
        parts = [(OTHER[::2] + invented(rng, fillers, 40), False), (OTHER[1::2] + invented(rng, fillers, 40), True)] if strange else [(TEMPLATES[family], False)]
        for texts, apart in parts:
            for text, a, b in notices(rng, fillers, texts, each * (3 if strange else 1)):
                made.append(text), kinds.append(k), spans.append((a, b)), unseen.append(apart)
    known = np.unique(features(paragraphs(pa.array([t for f in TEMPLATES.values() for t in f] + OTHER, pa.large_string())))[2])
    p = paragraphs(pa.array(rows, pa.large_string()))
    like = np.add.reduceat(np.isin(features(p)[2], known[known < 1 << BITS]), p.first) if len(p.first) else np.empty(0, np.int64)
    plain = [rows[r] for r, n in zip(p.row, like) if not n]
    pieces = [(x.split(), int(rng.integers(1, 14))) for x in plain]
    short = [" ".join(x[a : a + n]) for x, n in pieces for a in [int(rng.integers(0, max(1, len(x) - n + 1)))]]
    stray = [w for f in (*TEMPLATES.values(), OTHER) for t in f for w in t.split()[::3]]
    mixed = [" ".join([*(fillers[int(k)] for k in rng.integers(len(fillers), size=5)), w, *(fillers[int(k)] for k in rng.integers(len(fillers), size=6))]) for w in stray]
    texts = made + plain + short + mixed
    p = paragraphs(pa.array(texts, pa.large_string()))
    which, begin, end = windows(p.first, p.last)
    row = p.row[which]
    kinds, unseen = np.array(kinds + [0] * (len(texts) - len(kinds))), np.array(unseen + [False] * (len(texts) - len(unseen)))
    words = [np.concatenate([[0], np.cumsum([sum(1 for _ in _tokens(x)) for x in t.split()])]) for t in made]
    low = np.array([words[i][a] for i, (a, _) in enumerate(spans)] + [0] * (len(texts) - len(made)))
    high = np.array([words[i][b] for i, (_, b) in enumerate(spans)] + [0] * (len(texts) - len(made)))
    base = p.w.offsets[:-1][row]
    own = np.maximum(0, np.minimum(end - base, high[row]) - np.maximum(begin - base, low[row]))
    y = np.where(own > 0, kinds[row], 0)
    use = (own == 0) | (own >= np.minimum(5, (high - low)[row]))  # windows that just touch a notice teach nothing
    turn = rng.random(len(y))
    use &= turn < np.where(y > 0, 0.4, min(1.0, 15_000 / max(1, int((y == 0).sum()))))
    begin, end, y, apart = begin[use], end[use], y[use], unseen[row[use]] & (y[use] > 0)
    held = (np.random.default_rng(seed + 1).random(len(y)) < 0.2) | apart
    f = features(p)
    size = end - begin
    token = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    part, fit = np.repeat(np.arange(len(y)), size), ~held
    used, slot = np.unique(f[:, token], return_inverse=True)
    slot = slot.reshape(3, len(token))
    edge = np.cumsum(size) - size
    classes = len(FAMILIES)
    small, grad_square, bias = np.zeros((len(used), classes), np.float32), np.full((len(used), classes), 1e-6, np.float32), np.zeros(classes)
    scale, target = 1 / np.sqrt(size), np.eye(classes)[y]
    counts = np.bincount(y[fit], minlength=classes)
    share = np.where(held, 0.0, 1 / np.maximum(counts[y], 1))[:, None] * len(y) / classes
    for _ in range(rounds):
        s = np.add.reduceat(small[slot[0]] + small[slot[1]] + small[slot[2]], edge, axis=0) * scale[:, None] + bias
        d = (_softmax(s) - target) * share
        spread = (d * scale[:, None])[part]
        g = 1e-4 * small
        for c in range(classes):
            for k in range(3):
                g[:, c] += np.bincount(slot[k], weights=spread[:, c], minlength=len(used))
        g[used == 1 << BITS] = 0
        grad_square += g * g
        small -= 0.5 * g / np.sqrt(grad_square)
        bias -= 0.05 * d.sum(0) / np.sqrt(len(y))
    weight = np.zeros(((1 << BITS) + 1, classes), np.float32)
    weight[used] = small
    weight[1 << BITS] = 0
    m = Model(weight, bias, 1.0, 0.5, 0.5)
    begin, end, y, apart = begin[held], end[held], y[held], apart[held]
    odds = np.log(probabilities(p, begin, end, m) + 1e-30)
    m.temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -float(np.log(_softmax(odds / t)[np.arange(len(y)), y] + 1e-12).mean()))
    q = _softmax(odds / m.temperature)
    some = 1 - q[:, 0]
    true, noise = np.sort(some[(y > 0) & ~apart]), np.sort(some[y == 0])
    low, high = (float(true[int(0.02 * len(true))]) if len(true) else 0.5), float(noise[int(0.998 * len(noise))]) if len(noise) else 0.0
    m.bar = float(np.clip((low + high) / 2, 0.5, 0.9))
    strange = np.sort(q[apart, 1:-1].max(1)) if apart.any() else np.array([0.5])
    m.sure = float(np.clip(strange[int(0.8 * len(strange))], 0.3, 0.8))
    release()
    return m


def _tokens(text: str) -> Iterator[str]:
    """The tokens of a word as ``textbatch`` has them."""
    run = "".join(c if ord(c) > 127 or c.isalnum() or c == "_" else " " for c in text)
    yield from run.split()


# scanning


def _regions(which: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of windows of one paragraph that overlap or touch."""
    if len(which):
        edge = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (begin[1:] > end[:-1])]))
        yield from (np.arange(a, b) for a, b in zip(edge, np.append(edge[1:], len(which))))


def find(p: Paragraphs, m: Model, coverage: float = COVERAGE) -> list[tuple[int, int, int, str, float, str | None, float]]:
    """Paragraph, first and last token, family, probability, template and coverage of the notices of some paragraphs."""
    which, begin, end = windows(p.first, p.last)
    q = probabilities(p, begin, end, m)
    hit = np.flatnonzero(1 - q[:, 0] >= m.bar)
    which, begin, end, q, out = which[hit], begin[hit], end[hit], q[hit], []
    for part in _regions(which, begin, end):
        k, a, b = int(which[part[0]]), int(begin[part[0]]), int(end[part[-1]])
        lo, hi = max(int(p.first[k]), a - WINDOW), min(int(p.last[k]), b + WINDOW)
        words, best = p.w.hashes[lo:hi], q[part].max(0)
        found = []
        for c in np.argsort(-best[1:-1], kind="stable")[:5] + 1:
            if best[c] < 0.02:
                break
            for t in templates(FAMILIES[c]):
                for n, s, e in matches(words, t, coverage):
                    near = best[c] if len(part) == 1 else q[part[(begin[part] < lo + e) & (end[part] > lo + s)], c].max(initial=0.0)
                    found.append((-n, -n / len(t.words), FAMILIES[c], lo + s, lo + e, float(near), t.name))
        taken = []
        for n, cover, family, s, e, chance, name in sorted(found):
            if all(e <= x[1] or s >= x[2] for x in taken):
                taken.append((k, s, e, family, chance, name, -cover))
        kept = [x if x[4] >= m.sure else (*x[:3], "unknown", *x[4:]) for x in taken]
        free = np.array([all(begin[i] >= x[2] + WINDOW or end[i] <= x[1] - WINDOW for x in taken) for i in part])
        for rest in _regions(which[part[free]], begin[part[free]], end[part[free]]):
            rest = part[free][rest]
            if len(np.intersect1d(p.w.hashes[begin[rest[0]] : end[rest[-1]]], vocabulary())) < UNKNOWN_WORDS:
                continue
            kept.append((k, int(begin[rest[0]]), int(end[rest[-1]]), "unknown", float((1 - q[rest, 0]).max()), None, 0.0))
        out += sorted(kept, key=lambda x: x[1:3])
    return out


def scan(documents: DataFrame, model: Model, coverage: float = COVERAGE) -> DataFrame:
    """A row for each notice; ``family`` is ``unknown``, without a template, where none confirms one."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.chunks(batches, "text", 1 << 20):
            p = paragraphs(pc.fill_null(part.column("text"), ""))
            found = find(p, shared.value, coverage) if len(p.first) else []
            if not found:
                continue
            chars, ids, made = tb.code_points_before(p.w.data), part.column("doc_id").to_pylist(), []
            for k, a, b, family, chance, template, cover in found:
                base = chars[p.w.row_bytes[p.row[k]]]
                made.append((ids[p.row[k]], int(p.number[k]), int(chars[p.w.starts[a]] - base), int(chars[p.w.ends[b - 1]] - base), family, chance, template, cover))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*made), _FIELDS)], names=[n for n, _ in _FIELDS])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
