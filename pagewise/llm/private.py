"""Personal data: candidates by rules, a boosted forest over their format and context, calibrated thresholds.

Generators of high recall propose overlapping spans (addresses, numbers, dotted numbers, keys, assignments). Boosted
trees on features of a span and of the words around it give the probability that it is private; where accepted spans
overlap, the more probable, then the longer, the earlier and the first kind by name stays. The trees are trained here on
spans made by templates in sentences of a bounded sample of the corpus, half of them look-alikes that are not private
(versions, dates, prices, order numbers, hashes in paths, decorators). Each kind's threshold is calibrated on
held-out spans: the least probability with a precision of ``PRECISION``.

Only lines with a digit of any script, an at sign, an equals sign or a colon can hold a candidate, so others are
skipped at once. Generators take time in proportion to a line, however long it is.

Defined results: null and empty texts have no spans; each accepted span of each row gives one row, repeated rows
too; a null id stays null; extra columns play no part; an empty table gives an empty result. Offsets count code points.
"""

from __future__ import annotations

import bisect
import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import sample_texts

SAMPLED_TEXTS, MADE, PRECISION = 300, 9000, 0.98
SCHEMA = "doc_id bigint, start int, end int, kind string, text string, probability double"
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("probability", pa.float64())]

GENERATORS: dict[str, re.Pattern] = {
    "card": re.compile(r"(?<![\w.])\d(?:[ -]?\d){11,18}(?!\w)"),
    "email": re.compile(r"@[\w-]++(?:\.[\w-]++)++"),  # what is before the sign is looked for from there
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.]*\d)"),
    "ipv6": re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,39}?(?:::|(?::[0-9A-Fa-f]{1,4}){5}))(?:[0-9A-Fa-f]{1,4}|:)(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?![\w:])"),
    "key": re.compile(r"\b(?=[A-Za-z0-9_]*\d)(?=[A-Za-z0-9_]*[A-Za-z])[A-Za-z0-9_]{16,}\b"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w.]*\d)"),
    "phone_plain": re.compile(r"(?<![\w.])(?:\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}|\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|0\d(?:[ .]?\d\d){4})(?![\w.]*+\d)(?!\w)"),
    "secret": re.compile(r"(?<=[=:])[ ]?[\"']?[^\s\"']{6,}"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
}
KINDS = tuple(sorted(GENERATORS))
#: Kinds under the name that results have for them.
NAMES = {"phone_plain": "phone", "ipv6": "ip"}
_USER = re.compile(r"[\w.+%-]")
_HINTS = {
    "secret": ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "auth", "credential"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "number": ("version", "order", "isbn", "doi", "invoice", "release", "chapter", "page", "price", "id", "no", "ref", "section", "figure", "item", "sku", "build"),
    "bank": ("card", "visa", "mastercard", "iban", "account", "ssn", "social"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def candidates(text: str) -> list[tuple[int, int, str]]:
    """All spans that a generator proposes, overlapping ones too, in the order of their kinds and places."""
    found = []
    for kind in KINDS:
        for m in GENERATORS[kind].finditer(text):
            a, b = m.span()
            if kind == "email":
                while a and _USER.match(text[a - 1]):
                    a -= 1
                if a == m.start():
                    continue
            if kind == "secret":
                while a < b and text[a] in " \"'":
                    a += 1
            while b > a and text[b - 1] in ".,;:!?)*#$%&" and kind != "phone":
                b -= 1
            if b > a:
                found.append((a, b, kind))
    return found


def describe(text: str, a: int, b: int, kind: str) -> list[float]:
    """Features of the format of a span and of the words around it."""
    span, before, after = text[a:b], text[max(0, a - 40) : a].lower(), text[b : b + 20].lower()
    digits = "".join(str(int(c)) for c in re.findall(r"\d", span))
    counts = {c: span.count(c) for c in set(span)}
    entropy = -sum(n / len(span) * math.log2(n / len(span)) for n in counts.values())
    words = re.findall(r"[a-z_]+", before)
    groups = re.findall(r"\d+", span)
    parts = [int(g) for g in groups[:4]] if groups else []
    tail = words[-3:]
    return [
        KINDS.index(kind),
        len(span),
        len(digits) / len(span),
        sum(c.isupper() for c in span) / len(span),
        sum(c.islower() for c in span) / len(span),
        entropy,
        float(bool(digits) and luhn(digits)),
        len(digits),
        len(groups),
        float(max(parts, default=0) <= 255),
        float(parts[0] if parts else -1),
        float(span.startswith("+")),
        float("(" in span),
        span.count("."),
        span.count("-"),
        span.count("@"),
        span.count(":"),
        float(span[:1].isalpha() and span[-1:].isdigit()),
        float(len(set(span) - set(string.ascii_letters + string.digits + " .-:"))),
        float(bool(re.fullmatch(r"[0-9a-f]+", span))),
        float(bool(re.match(r"(AKIA|ghp_|sk_|sk-|xox|eyJ|AIza)", span))),
        float(before[-1:] == "="),
        float(before[-1:] in "\"'" and before != ""),
        float(before[-1:] in "/\\#@$€£v" and before != ""),
        float(after[:1] in "%°€/" and after != ""),
        *(float(any(w in hints for w in tail)) for hints in _HINTS.values()),
        float(bool(span) and span.rsplit(".", 1)[-1].isalpha() and "@" in span),
    ]


@dataclass
class Forest:
    """Boosted regression trees of one depth, stored level by level, over quantile bins of the features."""

    edges: list[np.ndarray]
    base: float = 0.0
    features: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.int64))
    cuts: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.int64))
    leaves: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    thresholds: dict[str, float] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        b, rows, total = self.bins(x), np.arange(len(x)), np.full(len(x), self.base)
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            while (node < len(f)).all():
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, most_bins: int = 32, ridge: float = 1.0) -> Forest:
    """Gradient boosting of the logistic loss with histograms and Newton leaves."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    forest = Forest(edges, math.log(share / (1 - share)))
    b, score = forest.bins(x), np.full(len(y), forest.base)
    inner, width = (1 << depth) - 1, most_bins + 1
    all_f, all_c, all_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c, node = np.zeros(inner, np.int64), np.full(inner, width), np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, n = (1 << level) - 1, 1 << level
            gain, place = np.full(n, 1e-9), node - lo
            for j in range(x.shape[1]):
                at = place * width + b[:, j]
                G, H = (np.bincount(at, weights=v, minlength=n * width).reshape(n, width) for v in (g, h))
                left_g, left_h = np.cumsum(G, 1)[:, :-1], np.cumsum(H, 1)[:, :-1]
                sum_g, sum_h = G.sum(1)[:, None], H.sum(1)[:, None]
                value = left_g**2 / (left_h + ridge) + (sum_g - left_g) ** 2 / (sum_h - left_h + ridge) - sum_g**2 / (sum_h + ridge)
                best = value.argmax(1)
                better = value[np.arange(n), best] > gain
                gain[better] = value[np.arange(n), best][better]
                f[lo : lo + n][better], c[lo : lo + n][better] = j, best[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), f[node]] > c[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        score += value[leaf]
        all_f.append(f), all_c.append(c), all_l.append(value)
    forest.features, forest.cuts, forest.leaves = np.array(all_f), np.array(all_c), np.array(all_l)
    return forest


def _pick(rng: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[int(k)] for k in rng.integers(len(letters), size=n))


def _number(rng: np.random.Generator, low: int, high: int) -> str:
    return str(int(rng.integers(low, high)))


def private_span(rng: np.random.Generator, kind: str) -> tuple[str, str]:
    """Words before a private span, and the span."""
    digits, hexes, lower = string.digits, "0123456789abcdef", string.ascii_lowercase
    if kind == "email":
        user = _pick(rng, lower, int(rng.integers(2, 10))) + str(rng.choice(["", ".", "_"])) + _pick(rng, lower + digits, int(rng.integers(1, 5)))
        return "", f"{user}@{_pick(rng, lower + digits, int(rng.integers(3, 9)))}.{rng.choice(['example.com', 'com', 'org', 'net', 'de', 'co.uk', 'io'])}"
    if kind == "phone":
        form = int(rng.integers(5))
        a, b, c = _number(rng, 200, 999), _number(rng, 200, 999), _pick(rng, digits, 4)
        return str(rng.choice(["", "", "tel ", "phone: ", "call "])), [f"+{_number(rng, 1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{_number(rng, 1, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"+{_number(rng, 1, 99)}-{a}-{b}-{c}"][form]
    if kind == "phone_plain":
        form = int(rng.integers(6))
        a, b, c = _number(rng, 200, 999), _number(rng, 200, 999), _pick(rng, digits, 4)
        lead = str(rng.choice(["tel ", "phone: ", "call ", "mobile ", "Tel.: ", "fax "]))
        if form < 3:
            span = [f"+{_number(rng, 1, 99)}{a}{b}{c}", f"+33 {_number(rng, 1, 9)} " + " ".join(_pick(rng, digits, 2) for _ in range(4)), f"+{_number(rng, 1, 99)} {_number(rng, 1, 99)} {_pick(rng, digits, 4)} {c}"][form]
            return str(rng.choice(["", lead])), span
        return lead, [f"{a}{b}{c}", f"{a}.{b}.{c}", "0" + _number(rng, 1, 9) + " " + " ".join(_pick(rng, digits, 2) for _ in range(4))][form - 3]
    if kind == "ipv6":
        words = [_pick(rng, hexes, int(rng.integers(1, 5))) for _ in range(8)]
        cut = int(rng.integers(1, 6))
        return str(rng.choice(["", "from ", "host ", "addr: "])), [":".join(words), ":".join(["2001", "db8", *words[2:]]), "fe80::" + ":".join(words[:cut]), ":".join(words[:cut]) + "::" + words[7]][int(rng.integers(4))]
    if kind == "ip":
        return str(rng.choice(["", "", "from ", "host "])), ".".join(_number(rng, 1, 255) for _ in range(4))
    if kind == "card":
        body = str(rng.choice(["4", "51", "52", "55", "37", "6011"]))
        body += _pick(rng, digits, 15 - len(body))
        whole = next(body + d for d in digits if luhn(body + d)) if rng.random() < 0.5 else body + _pick(rng, digits, 1)
        return str(rng.choice(["", "", "card "])), whole if rng.random() < 0.7 else " ".join(whole[i : i + 4] for i in range(0, 16, 4))
    if kind == "iban":
        whole = _pick(rng, "DEFRGBESITNL", 2) + _pick(rng, digits, 2) + _pick(rng, digits, 18)
        return str(rng.choice(["", "iban "])), whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))
    if kind == "ssn":
        return str(rng.choice(["", "ssn "])), f"{_number(rng, 100, 899)}-{_number(rng, 10, 99)}-{_number(rng, 1000, 9999)}"
    if kind == "key":
        return "", [f"AKIA{_pick(rng, string.ascii_uppercase + digits, 16)}", f"ghp_{_pick(rng, string.ascii_letters + digits, 36)}", f"sk_live_{_pick(rng, string.ascii_letters + digits, 24)}"][int(rng.integers(3))]
    chosen = _pick(rng, lower, int(rng.integers(4, 9))) + str(rng.choice(["", "", "", "!", "_"])) + _pick(rng, digits, int(rng.integers(1, 5)))
    value = [_pick(rng, hexes, int(rng.integers(16, 41))), _pick(rng, string.ascii_letters + digits, int(rng.integers(8, 33))), chosen][int(rng.integers(3))]
    name = str(rng.choice(["password", "token", "secret", "api_key", "pwd", "auth_token"]))
    return str(rng.choice([f"{name}=", f'{name} = "', f"{name}: ", f"{name}='"])), value


def public_span(rng: np.random.Generator) -> tuple[str, str]:
    """Words before a look-alike that is not private, and the look-alike."""
    digits, hexes = string.digits, "0123456789abcdef"
    form = int(rng.integers(20))
    clock = f"{int(rng.integers(24)):02d}:{int(rng.integers(60)):02d}:{int(rng.integers(60)):02d}"
    year, month, day = _number(rng, 1900, 2030), f"{int(rng.integers(1, 13)):02d}", f"{int(rng.integers(1, 29)):02d}"
    return [
        ("version ", ".".join(_number(rng, 0, 30) for _ in range(4))),
        ("section ", ".".join(_number(rng, 0, 9) for _ in range(4))),
        (str(rng.choice(["", "on "])), f"{year}-{month}-{day}"),
        (str(rng.choice(["", "from "])), f"{year}-{_number(rng, 1900, 2030)}"),
        ("order ", _pick(rng, digits, 13)),
        ("isbn ", f"978-{_number(rng, 0, 9)}-{_number(rng, 100, 999)}-{_pick(rng, digits, 5)}-{_pick(rng, digits, 1)}"),
        ("build ", _pick(rng, hexes, 40)),
        ("/objects/", _pick(rng, hexes, 40)),
        ("width=", f"{_number(rng, 100000, 999999)}"),
        ("class=", _pick(rng, string.ascii_lowercase, int(rng.integers(6, 12)))),
        ("scores ", f"{_number(rng, 10, 99)} {_number(rng, 10, 99)} {_number(rng, 10, 99)}"),
        ("ratio: ", f"{_number(rng, 10, 99)}.{_pick(rng, digits, 5)}"),
        (str(rng.choice(["order ", "invoice ", "ref ", "item ", "", "", "id "])), _pick(rng, digits, 10)),
        (str(rng.choice(["at ", "", "since "])), clock),
        ("on ", f"{year}-{month}-{day} {clock}"),
        (str(rng.choice(["note: ", "see: ", "he said: ", "token: ", "password: "])), _pick(rng, string.ascii_lowercase, int(rng.integers(6, 12)))),
        (str(rng.choice(["chapter ", "verses ", ""])), f"{_number(rng, 1, 150)}:{_number(rng, 1, 60)}:{_number(rng, 1, 60)}"),
        (str(rng.choice(["", "about ", "some "])), f"{_number(rng, 1, 999)} {_pick(rng, digits, 3)} {_pick(rng, digits, 3)} {_pick(rng, digits, 3)}"),
        (str(rng.choice(["timestamp ", "seed ", "build ", "page "])), f"1{_pick(rng, digits, 9)}"),
        (str(rng.choice(["std", "boost", "a"])) + "::", str(rng.choice(["abc", "fade", "cafe", "vector", "dead::beef"]))),
    ][form]


def train(documents: DataFrame, sampled: int = SAMPLED_TEXTS, made: int = MADE, seed: int = 11) -> Forest:
    """Fits the trees on made spans in sentences of a bounded hash sample of texts; without texts, in a few plain words."""
    rng = np.random.default_rng(seed)
    words = [w for t in sample_texts(documents, "text", sampled) for w in t.split() if not re.search(r"[\d@=:]", w)] or ["one", "of", "the", "words"]
    x, y, kinds = [], [], []
    for i in range(made):
        kind = KINDS[i // 2 % len(KINDS)]
        lead, span = private_span(rng, kind) if i % 2 == 0 else public_span(rng)
        at = int(rng.integers(max(1, len(words) - 20)))
        text = " ".join(words[at : at + 6]) + " " + lead + span
        end = len(text)
        text += str(rng.choice(["", ".", ",", "***", '"' if lead.endswith('"') else ""])) + " " + " ".join(words[at + 6 : at + 12])
        for a, b, found in candidates(text):
            if a < end and b > end - len(span):  # parts of a private span are not private spans themselves
                x.append(describe(text, a, b, found))
                y.append(float(i % 2 == 0 and a == end - len(span) and b == end and (NAMES.get(found, found) == NAMES.get(kind, kind) or kind == "key" and found == "secret")))
                kinds.append(found)
    x, y, kinds = np.array(x), np.array(y), np.array(kinds)
    held = rng.random(len(y)) < 0.25
    forest = boost(x[~held], y[~held])
    p = forest.probability(x[held])
    for kind in KINDS:
        mine = kinds[held] == kind
        forest.thresholds[kind] = _threshold(p[mine], y[held][mine])
    return forest


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Between the least probability from which the precision is ``PRECISION`` and the next one, from 0.2 on; 0.5 if there is none."""
    order = np.argsort(-p, kind="stable")
    precision = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    ranked = np.append(p[order], 0.0)
    return float(max(0.2, (ranked[good[-1]] + ranked[good[-1] + 1]) / 2)) if len(good) else 0.5


def _accept(found: list[tuple[int, int, str]], p: np.ndarray, thresholds: dict[str, float]) -> list[tuple[int, int, str, float]]:
    """The spans of one line that reach their thresholds, without overlaps, in the order of their places."""
    best = sorted(((a, b, k, float(v)) for (a, b, k), v in zip(found, p) if v >= thresholds[k]), key=lambda s: (-s[3], s[0] - s[1], s[0], s[2]))
    taken: list[tuple[int, int, str, float]] = []
    for s in best:
        k = bisect.bisect(taken, s)
        if (not k or taken[k - 1][1] <= s[0]) and (k == len(taken) or s[1] <= taken[k][0]):
            taken.insert(k, s)
    return [(a, b, NAMES.get(k, k), p) for a, b, k, p in taken]


_MAYBE = re.compile(r"[\d@=:]")


def _lines(text: str) -> Iterator[tuple[int, str]]:
    """Places and lines of a text that may hold a candidate."""
    m = _MAYBE.search(text)
    while m:
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        b = len(text) if b < 0 else b
        yield a, text[a:b]
        m = _MAYBE.search(text, b)


def find(text: str, forest: Forest) -> list[tuple[int, int, str, float]]:
    """Accepted spans of a text, in the order of their places; they do not overlap."""
    return [(a + s, b + s, k, p) for _, s, spans in find_all([text], forest) for a, b, k, p in spans]


def find_all(texts: list[str | None], forest: Forest) -> list[tuple[int, int, list[tuple[int, int, str, float]]]]:
    """Text, place and accepted spans of the lines that have some; all candidates go through the trees together."""
    lines = [(i, at, line, found) for i, text in enumerate(texts) for at, line in _lines(text or "") if (found := candidates(line))]
    if not lines:
        return []
    p = forest.probability(np.array([describe(line, *c) for _, _, line, found in lines for c in found]))
    out, n = [], 0
    for i, at, _, found in lines:
        spans = _accept(found, p[n : n + len(found)], forest.thresholds)
        n += len(found)
        if spans:
            out.append((i, at, spans))
    return out


def scan(documents: DataFrame, forest: Forest) -> DataFrame:
    """A row for each private span of each document."""
    shared = documents.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in tb.chunks(batches, "text"):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            made = [(ids[i], at + a, at + b, k, texts[i][at + a : at + b], p) for i, at, spans in find_all(texts, model) for a, b, k, p in spans]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*made), _FIELDS)], names=[n for n, _ in _FIELDS])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """The text with each span replaced by the name of its kind in brackets."""
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])
