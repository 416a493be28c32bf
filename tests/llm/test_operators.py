import random
import re
import textwrap
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewise.llm import bpe, graph, leaks, lengths, licences, lines, nearcopies, private, textbatch as tb, topk, toxicity, warc

from .cases import HARD, LONG, documents, prose


def pairs(df):
    return {tuple(r) for r in df.collect()}


# near copies


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join("zzz" if rng.random() < share else w for w in text.split())


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    n = 300
    got = []
    for trial in range(30):
        f = rng.integers(1 << 40, size=n).astype(np.uint64)
        a, b = rng.integers(0, 6, n), rng.integers(0, 6, n)
        row = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
        sig = nearcopies.signatures(row, np.concatenate([f[a > 0], f[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        got.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(got)) < 0.02


def test_near_copies_against_brute_force(spark):
    texts = [(i, prose(i, 60 + i)) for i in range(40)]
    texts += [(100 + i, changed(prose(i, 60 + i), 0.02 * (i % 8), i)) for i in range(40)]
    texts += [(200, texts[0][1]), (201, texts[0][1])]
    found = {r.doc_id: r.kept_id for r in nearcopies.groups(documents(spark, texts)).collect()}
    sets = {i: nearcopies._multisets(pa.array([t]))[0] for i, t in texts}
    near = [(a, b) for a in sets for b in sets if a < b and nearcopies.similarity(sets[a], sets[b]) >= 0.5]
    root = lambda x: found.get(x, x)
    assert sum(root(a) == root(b) for a, b in near) >= 0.9 * len(near)
    for d, k in found.items():
        assert k < d and k not in found
    assert {200: 0, 201: 0}.items() <= found.items()
    wide = {r.doc_id: r.kept_id for r in nearcopies.groups(documents(spark, texts), local_triples=0).collect()}
    assert wide == found


def test_near_copies_that_share_a_passage(spark):
    passage = " ".join(f"hot{i}" for i in range(60))
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    texts = [(i, f"{passage} {own(i, 46)}") for i in range(400)]
    twins = [(k, 400 + k) for k in range(0, 400, 10)]
    texts += [(b, f"{passage} {own(a, 13)} {own(b, 33)}") for a, b in twins]
    sets = {i: nearcopies._multisets(pa.array([t]))[0] for i, t in texts}
    assert all(0.5 <= nearcopies.similarity(sets[a], sets[b]) < 0.55 for a, b in twins) and nearcopies.similarity(sets[0], sets[1]) < 0.45
    df = documents(spark, texts)
    banded = {}
    for r in nearcopies.sketch(df).select("doc_id", F.explode("bands").alias("band")).collect():
        banded.setdefault(r.band, set()).add(r.doc_id)
    met = {(b, a) for a, b in twins if any({a, b} <= m for m in banded.values())}
    found = pairs(nearcopies.groups(df))
    assert len(met) > 20 and met <= found <= {(b, a) for a, b in twins}
    assert pairs(nearcopies.groups(df, local_triples=0)) == found


def test_pairs_able_to_be_near_hold_all_that_are():
    rng = np.random.default_rng(3)
    for n in (12, 60):
        texts = pa.array([" ".join(rng.choice(list("abcdef"), rng.integers(3, 40), p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05])) for _ in range(n)])
        sets = nearcopies._multisets(texts)
        for t in (0.3, 0.5, 0.8):
            able = list(nearcopies._able(sets, lambda: np.arange(n), t))  # noqa: B023
            assert len(able) == len(set(able))
            assert {(i, j) for j in range(n) for i in range(j) if nearcopies.similarity(sets[i], sets[j]) >= t} <= {(min(p), max(p)) for p in able}


def test_near_copies_hard_cases(spark):
    df = documents(spark, HARD)
    assert pairs(nearcopies.groups(df)) == {(6, 5)}
    kept = nearcopies.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "None", "None", "7", "8", "9", "9"])
    assert nearcopies.groups(df.limit(0)).count() == 0
    again = documents(spark, [(1, "a b c d"), (1, "a b c d"), (2, "e f g h i")])
    assert sorted(r.doc_id for r in nearcopies.keep_one(again).collect()) == [1, 2]
    ties = again.withColumn("extra", F.create_map(F.lit("k"), F.monotonically_increasing_id()))
    kept = {str(r) for k in (1, 3) for r in nearcopies.keep_one(ties.repartition(k)).where("doc_id = 1").collect()}
    assert len(kept) == 1


def test_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 40), (40, 41)], "a bigint, b bigint")
    assert pairs(graph.components(df)) == {(1, 1), (2, 1), (3, 1), (40, 1), (41, 1), (7, 7), (8, 7), (9, 7)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r.root for r in graph.components(chain).collect()} == {0}


# token counts


def test_token_counts(spark):
    df = documents(spark, HARD)
    report = lengths.context_report(lengths.histogram(df)).cache()
    encoded = [len(r.tokens) for r in bpe.encode(df, cached_words=0).collect() if r.tokens is not None]
    rows = {r.length: r for r in report.collect()}
    assert sum(r.n_docs for r in rows.values()) == len(encoded)
    for limit in (0, 1, 5, 50, 10**7):
        assert lengths.truncated_tokens(report, limit) == sum(min(limit, n) for n in encoded)
    for r in rows.values():
        assert (r.n_longer, r.total_tokens) == (sum(n > r.length for n in encoded), sum(encoded))
        assert r.truncated_tokens == sum(min(r.length, n) for n in encoded)
        assert r.quantile == pytest.approx(sum(n <= r.length for n in encoded) / len(encoded))
    assert lengths.quantile_length(report, 0.5) == sorted(encoded)[-(-len(encoded) // 2) - 1]
    empty = lengths.context_report(lengths.histogram(df.limit(0)))
    assert empty.count() == 0 and lengths.quantile_length(empty, 0.5) is None


def test_token_counts_of_white_space_without_end(spark):
    n = 2_000_000
    report = lengths.context_report(lengths.histogram(documents(spark, [(1, " " * n), (2, "\n" * n + "x"), (3, "a" * n)])))
    assert {r.length for r in report.collect()} == {len(bpe.merge_long(w, bpe.load_ranks())) + k for w, k in ((b" " * n, 0), (b"\n" * (n - 1), 2), (b"a" * n, 0))}


# licences


def test_licences(spark):
    texts = [(i, prose(i, 120)) for i in range(30)]
    model = licences.train(documents(spark, texts))
    rng = np.random.default_rng(5)
    named = right = 0
    for family in licences.TEMPLATES:
        for text, a, b in licences.notices(rng, ["balein", "tores", "quzon"], licences.TEMPLATES[family], 12):
            found = licences.find(licences.paragraphs(pa.array([text])), model)
            named, right = named + bool(found), right + (family in {x[3] for x in found})
    assert named >= 0.93 * 12 * len(licences.TEMPLATES) and right >= 0.85 * 12 * len(licences.TEMPLATES)
    wrap = lambda text, n: "\n".join(textwrap.wrap(text, n))
    mit, bsd, gpl = licences.TEMPLATES["mit"][3], licences.TEMPLATES["bsd"][4], licences.TEMPLATES["gpl"][4]
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance\nwith the License."
    long = prose(3, 300).replace("\n", " ")
    for text, family in ((wrap(mit, 75), "mit"), (mit, "mit"), (f"{long} {mit} {long}", "mit"), (wrap(bsd, 60), "bsd"), (apache, "apache-2.0"), ("# " + wrap(gpl, 70).replace("\n", "\n# "), "gpl"), ("CC BY-ND 4.0 holds: Licensed under CC BY-ND 4.0", "cc-by-nd")):
        assert [x[3] for x in licences.find(licences.paragraphs(pa.array([text])), model)] == [family]
    for text in (wrap(licences.OTHER[0], 70), wrap(licences.OTHER[1], 70), "Licensed under the Foo License"):
        assert [x[3] for x in licences.find(licences.paragraphs(pa.array([text])), model)] == ["unknown"]
    notice = "Released under the MIT License."
    df = documents(spark, [*HARD, (50, prose(5, 40) + "\n" + notice + "\nbale"), (51, notice), (51, notice), (None, "Licensed under CC BY-NC 4.0.")])
    rows = licences.scan(df, model).collect()
    assert {r.doc_id for r in rows} <= {50, 51, None}
    found = [r for r in rows if r.family != "unknown"]
    assert sorted((str(r.doc_id), r.family) for r in found) == [("50", "mit"), ("51", "mit"), ("51", "mit"), ("None", "cc-by-nc")]
    (row,) = [r for r in found if r.doc_id == 50]
    text = prose(5, 40) + "\n" + notice + "\nbale"
    assert text[row.start : row.end] == notice[:-1] and row.coverage == 1.0
    assert licences.scan(df.limit(0), licences.train(df.limit(0))).count() == 0


def test_licence_paragraphs_and_common_words_by_brute_force():
    text = "a b\nc\n\n \nd e\n***\nf\n\n" + "g " * 40
    p = licences.paragraphs(pa.array([text, None, "x"]))
    words = [w for t in (text, "", "x") for w in t.split() if w.isalnum()]
    assert [words[a:b] for a, b in zip(p.first, p.last)] == [["a", "b", "c"], ["d", "e"], ["f"], ["g"] * 40, ["x"]]
    assert p.row.tolist() == [0, 0, 0, 0, 2] and p.number.tolist() == [0, 1, 2, 3, 0]
    which, begin, end = licences.windows(p.first, p.last)
    for k, (a, b) in enumerate(zip(p.first, p.last)):
        mine = which == k
        assert begin[mine].min() == a and end[mine].max() == b and (end - begin)[mine].max() <= licences.WINDOW
    rng = np.random.default_rng(1)
    t = licences.templates("bsd")[4]
    for _ in range(50):
        some = [int(x) for x in rng.choice(t.words, 25)]
        best = [0] * (len(t.words) + 1)
        for x in some:
            before = best[:]
            for j, y in enumerate(t.words, 1):
                best[j] = before[j - 1] + 1 if x == y else max(before[j], best[j - 1])
        assert licences.common(some, t) == best[-1]


# BPE


PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def reference_bpe(text, ranks):
    import tiktoken

    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def test_bpe_hard_cases(spark):
    ranks = bpe.load_ranks()
    tricky = ["don't you're I'LL 's 'twas ''ll x'x", " \n\n a  b\t\tc d　e ", "=" * 300 + " " + "ab" * 100, "aaaaaaa aaaaa", "½ Ⅷ 12345!!??", "'", " ", "\r\n x"]
    texts = [*HARD, *((1000 + i, t) for i, t in enumerate(tricky))]
    for cached in (0, 1 << 10):
        rows = bpe.encode(documents(spark, texts), chunk_bytes=100_000, cached_words=cached).collect()
        assert len(rows) == len(texts)
        assert sorted((str(r.doc_id), r.decoded or "") for r in rows) == sorted((str(i), t or "") for i, t in texts)
        for r in rows:
            if r.decoded is None:
                assert r.tokens is None and r.n_tokens is None
            else:
                assert r.tokens == reference_bpe(r.decoded, ranks) and r.n_tokens == len(r.tokens)
    back = bpe.decode(bpe.encode(documents(spark, texts)).where("tokens is not null"))
    assert sorted(r.text for r in back.collect()) == sorted(t for _, t in texts if t is not None)
    assert bpe.encode(documents(spark, HARD).limit(0)).count() == 0


def test_long_words_merge_as_short_ones(spark):
    ranks = bpe.load_ranks()
    for word in (b"a", b"aaaaaaaaa", b"internationalisation" * 3, bytes(range(256))):
        assert bpe.merge_long(word, ranks) == [*_by_rank(word, ranks)]


def _by_rank(word, ranks):
    part = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in part]
        part[best[1] : best[1] + 2] = [part[best[1]] + part[best[1] + 1]]


# toxicity


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    e, move, begin = rng.normal(size=6), rng.normal(size=(2, 2)), 0.4
    first = np.array([True, False, False, True, False, False])
    fw, bw = toxicity.forward_backward(e, first, begin, move)
    p = fw * bw / (1 + fw * bw)
    for lo in (0, 3):
        total, hit = 0.0, np.zeros(3)
        for k in range(8):
            y = [k >> j & 1 for j in range(3)]
            s = y[0] * begin + sum(e[lo + j] * y[j] for j in range(3)) + sum(move[y[j], y[j + 1]] for j in range(2))
            total += np.exp(s)
            hit += np.exp(s) * np.array(y)
        assert np.allclose(p[lo : lo + 3], hit / total)


def naive_toxicity(field, text):
    w = tb.words(pa.array([text]))
    e = np.exp(np.clip(toxicity.emissions(toxicity._apart(*toxicity.features(w), field.keys), field.weight, field.bias), -40, 40))
    move, n = np.exp(field.move), len(e)
    f, b = np.zeros((n, 2)), np.ones((n, 2))
    for i in range(n):
        f[i] = np.array([1.0, np.exp(field.begin) * e[0]]) if i == 0 else (f[i - 1] @ move) * [1.0, e[i]]
        f[i] /= f[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = move @ (b[i + 1] * [1.0, e[i + 1]])
        b[i] /= b[i].sum()
    p, best = f * b, {}
    for x, (no, yes) in zip(re.findall(r"[a-z0-9_]+", text.lower()), p):
        best[x] = max(best.get(x, 0.0), yes / (no + yes))
    return sum(v for v in best.values() if v >= toxicity.LEAST_MARGINAL)


def test_toxicity(spark):
    bad = ["vilex", "krumbo", "snarfy"]
    texts = [(i, prose(i, 60) + (" " + " ".join(f"{prose(i * 31 + k, 2)} {w}" for k, w in enumerate(bad)) if i % 4 == 0 else "")) for i in range(160)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id bigint, quality int, toxic int")
    df = documents(spark, texts)
    field = toxicity.train(df, labels)
    rows = {r.doc_id: r for r in toxicity.score(df, field).collect()}
    held = [i for i in range(120, 160)]
    assert sum(rows[i].toxic == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    spans = {texts[124][1][s.start : s.end] for s in rows[124].spans}
    assert set(bad) <= spans
    hard = documents(spark, HARD)
    scored = toxicity.score(hard, field).collect()
    assert len(scored) == len(HARD) and all(r.toxic == 0 for r in scored if r.doc_id in (1, 2, 3))
    assert toxicity.keep_clean(hard, field).columns == hard.columns
    assert {r.doc_id for r in toxicity.keep_clean(df, field).collect()} == {i for i in rows if not rows[i].toxic}
    for i in (4, 5, 120, 124, 131):
        assert rows[i].score == pytest.approx(naive_toxicity(field, texts[i][1]), abs=1e-6)
    assert toxicity.train(df, labels.limit(0)) is None
    assert {r.toxic for r in toxicity.score(hard, None).collect()} == {0}
    assert toxicity.score(hard.limit(0), field).count() == 0


# personal data


def test_private_data(spark):
    forest = private.train(documents(spark, [(i, prose(i, 200)) for i in range(30)]))
    rng = np.random.default_rng(77)
    right = wrong = 0
    for i in range(300):
        kind = private.KINDS[i % len(private.KINDS)]
        lead, span = private.private_span(rng, kind)
        text = f"{prose(i, 6)} {lead}{span} {prose(i + 1, 5)}"
        right += any(text[a:b] == span for a, b, _, _ in private.find(text, forest))
        lead, span = private.public_span(rng)
        wrong += bool(private.find(f"{prose(i, 6)} {lead}{span} {prose(i + 1, 5)}", forest))
    assert right >= 0.93 * 300 and wrong <= 0.06 * 300
    usual = {
        "password: hunter22": "hunter22", "phone ٠٦١٢-٣٤٥-٦٧٨٩": "٠٦١٢-٣٤٥-٦٧٨٩", "call +14155552671 now": "+14155552671", "tel 4155552671": "4155552671",
        "at +33 6 12 34 56 78 ok": "+33 6 12 34 56 78", "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 x": "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
    }
    for text, span in usual.items():
        assert [text[a:b] for a, b, _, _ in private.find(text, forest)] == [span]
    for text in ("at 12:34:56", "see std::cafe", "version 1.2.3.4", "on 2020-01-02"):
        assert private.find(text, forest) == []
    text = "mail ab.cd@mail.example.com ok"
    rows = private.scan(documents(spark, [*HARD, (60, text), (60, text), (None, "x\nfrom 12.34.56.78 so")]), forest).collect()
    got = sorted((str(r.doc_id), r.text, r.kind) for r in rows)
    assert got == [("60", "ab.cd@mail.example.com", "email")] * 2 + [("None", "12.34.56.78", "ip")]
    assert private.redact(text, private.find(text, forest)) == "mail [email] ok"
    assert private.scan(documents(spark, HARD).limit(0), private.train(documents(spark, HARD).limit(0))).count() == 0


def test_private_data_by_brute_force(spark):
    texts = [(i, f"{prose(i, 30)}\nmail u{i}.x@host{i}.org and call +1 (212) 555-{1000 + i}, v1.2.3.{i}\n{prose(i, 9)}") for i in range(25)]
    forest = private.train(documents(spark, texts))
    want = []
    for i, text in texts:
        at = 0
        for line in text.split("\n"):
            spans = [(a, b, k, forest.probability(np.array([private.describe(line, a, b, k)]))[0]) for a, b, k in private.candidates(line)]
            taken = []
            for a, b, k, p in sorted((s for s in spans if s[3] >= forest.thresholds[s[2]]), key=lambda s: (-s[3], s[0] - s[1], s[0], s[2])):
                if not any(a < t[1] and t[0] < b for t in taken):
                    taken.append((a, b))
                    want.append((i, at + a, at + b, private.NAMES.get(k, k)))
            at += len(line) + 1
    assert sorted((r.doc_id, r.start, r.end, r.kind) for r in private.scan(documents(spark, texts), forest).collect()) == sorted(want)
    assert len(want) >= 50


def test_private_data_takes_linear_time():
    n = 1 << 20
    for piece in ("a", "a@", "@", "1", "1 ", "1.", "=", "a:", "::", "x@y.z "):
        began = time.process_time()
        private.candidates(piece * (n // len(piece)))
        assert time.process_time() - began < 6
    spans = [(8 * i, 8 * i + 5, "email") for i in range(100_000)]
    assert len(private._accept(spans, np.full(len(spans), 0.9), {"email": 0.5})) == len(spans)


# decontamination


def test_decontamination_against_brute_force(spark):
    items = [(i, prose(1000 + i, 30)) for i in range(10)] + [(20, "one two three four five six seven eight nine"), (21, "too short"), (22, None), (None, "null id of an item with enough words in it here")]
    docs = [(i, prose(i, 200)) for i in range(20)]
    for i in range(10):
        w = items[i][1].split()
        if i % 2:
            w[7], w[20] = "other", "words"
        docs.append((100 + i, prose(i, 40) + " " + " ".join(w) + " " + prose(i + 5, 40)))
    docs += [(120, "start " + items[10][1] + " end"), (121, items[11][1]), (130, items[10][1].replace("five", "fifth")), (131, "so alpha beta gamma delta it is"), (132, "alpha beta gamma epsilon")]
    items.append((23, "alpha beta gamma delta"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = leaks.overlaps(documents(spark, docs + HARD), bench)
    rows = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(rows) == {(100 + i, i) for i in range(10)} | {(120, 20), (121, 21), (130, 20), (131, 23)}
    assert rows[(100, 0)].matched == 30 and rows[(101, 1)].matched == 28
    text = docs[20][1]
    assert text[rows[(100, 0)].start : rows[(100, 0)].end].split() == items[0][1].split()
    parts = leaks.overlaps(documents(spark, docs), bench, part_tokens=40)
    assert {(r.doc_id, r.item_id) for r in parts.collect()} == set(rows)
    df = documents(spark, docs + HARD)
    kept = leaks.keep_clean(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 14
    assert leaks.overlaps(df, bench.limit(0)).count() == 0 and leaks.keep_clean(df, bench.limit(0)).count() == df.count()
    assert leaks.overlaps(df.limit(0), bench).count() == 0


def test_overlaps_are_those_of_every_diagonal():
    rng = np.random.default_rng(4)
    items = [(i, " ".join(rng.choice(list("abcdefghij"), rng.integers(12, 25)))) for i in range(12)]
    texts = [" ".join([*rng.choice(list("abcdefghij"), 15), *(x if rng.random() > 0.1 else "z" for x in items[i % 12][1].split()), *rng.choice(list("abcdefghij"), 9)]) for i in range(40)]
    w, s = tb.words(pa.array(texts)), leaks.seeds(items)
    found, hits, true = {(r, i): (m, n) for r, i, _, _, m, n in leaks.find(w, s)}, 0, 0
    for r, text in enumerate(texts):
        t = text.split()
        for i, (_, item) in enumerate(items):
            u = item.split()
            best, seeded = (0, 0), False
            for d in range(1 - len(u), len(t)):
                same = [0 <= d + k < len(t) and t[d + k] == u[k] for k in range(len(u))]
                seeded |= any(all(same[k + j] for j, b in enumerate(mask) if b == "1") for mask in leaks.MASKS for k in range(len(u) - len(mask) + 1))
                score = max(((3 * sum(same[a:b]) - 2 * (b - a), sum(same[a:b]), -a, b - a) for a in range(len(u)) for b in range(a + 1, len(u) + 1) if same[a] and same[b - 1]), default=(0, 0, 0, 0))
                best = max(best, (score[1], score[3]))
            if best[0] >= 12:
                true, hits = true + 1, hits + ((r, i) in found)
                assert not seeded or (r, i) in found
            elif (r, i) in found:
                assert found[r, i][0] >= leaks.SHARE * len(u)
    assert hits >= 0.9 * true > 0


# line dedup


def brute_lines(texts):
    seen, out = set(), {}
    for i, t in sorted(texts):
        all_lines = t.split("\n")
        kept = [x for x in all_lines if x.strip(" ") and not (x in seen or seen.add(x))]
        n = sum(bool(x.strip(" ")) for x in all_lines)
        out[i] = (t if len(kept) == n else "\n".join(kept), n, n - len(kept))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, "\n".join(rng.choice(["", f"line {rng.randint(0, 60)}", " "]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup(documents(spark, texts)).collect()}
    assert got == brute_lines(texts)


def test_line_index_is_reversible(spark):
    first, second = [(i, f"a{i}\nshared\nb{i % 3}") for i in range(30)], [(100 + i, f"c{i}\nshared\nb{i % 5}\na{i}") for i in range(30)]
    a, b = documents(spark, first), documents(spark, second)
    index = lines.LineIndex(spark, 3).insert(a)
    before = pairs(index.counts())
    both = index.insert(b)
    cleaned = {r.doc_id: r.text for r in lines.dedup(b, index).collect()}
    assert cleaned[100] == "c0" and cleaned[103] == "c3\nb3"
    assert sum(r[2] for r in pairs(both.counts())) == 30 * 3 + 30 * 4
    assert pairs(both.delete(b).counts()) == before
    assert pairs(both.delete(a).delete(b).counts()) == set()
    assert {r.doc_id: r.text for r in lines.dedup(b, both.delete(a).delete(b)).collect()} == {r.doc_id: r.text for r in lines.dedup(b).collect()}
    with pytest.raises(Exception, match="not inserted"):
        index.delete(b)


def test_line_index_grows_its_shards(spark):
    a, b = documents(spark, [(1, "a\nb\nshared")]), documents(spark, [(2, "\n".join(f"x{i}" for i in range(300)) + "\nshared")])
    small = lines.LineIndex(spark, 1, lines_per_shard=20).insert(a)
    grown = small.insert(b)
    assert small.shards == 1 and grown.shards >= 15 and grown.counts().count() == 303
    assert {r.refs for r in grown.counts().collect()} == {1, 2}
    assert pairs(grown.delete(b).counts()) == pairs(small.counts())
    assert lines.dedup(b, small).first().n_removed == 1


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 20_000)
    f = lines.Cuckoo.of(keys[:15_000])
    assert f.contains(keys[:15_000]).all() and f.contains(keys[15_000:]).mean() < 0.01
    f.delete(keys[:5_000])
    assert f.contains(keys[5_000:15_000]).all() and f.contains(keys[:5_000]).mean() < 0.01
    f.delete(keys[5_000:15_000])
    assert not f.slots.any()


def test_line_dedup_hard_cases(spark):
    df = documents(spark, HARD)
    rows = lines.dedup(df).collect()
    assert len(rows) == len(HARD)
    assert [r.text for r in rows if r.doc_id == 1] == [None] and [r.text for r in rows if r.doc_id == 2] == [""]
    assert {r.text for r in rows if r.doc_id == 6} == {""}
    kept = lines.keep(df)
    assert kept.columns == df.columns and 6 not in {r.doc_id for r in kept.collect()}
    assert kept.where("doc_id = 4").first().text == "\n".join(brute_lines([(4, LONG)])[4][0].split("\n"))
    assert lines.dedup(df.limit(0)).count() == 0


# WARC


def test_warc_round_trip_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{prose(i, 200)}</p>" * 3) for i in range(60)] + [(None, None, None), (100, "u", ""), (100, "u", ""), (101, None, LONG)], "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    dictionary = warc.train_dictionary(pages, size=4096)
    assert dictionary
    assert sum(r.records for r in warc.write_archives(pages, folder, dictionary).collect()) == 64
    records = warc.read_archives(spark, folder, range_bytes=5000)
    assert sorted(map(str, warc.pages(records).select("page_id", "url", "html").collect())) == sorted(map(str, pages.collect()))
    assert records.where("not valid").count() == 0
    import glob

    path = max(glob.glob(f"{tmp_path}/w/*.warc.zst"))
    raw = bytearray(open(path, "rb").read())
    n = records.where(F.col("archive").endswith(path.rsplit("/", 1)[1])).count()
    rows = sorted(r.offset for r in records.where(F.col("archive").endswith(path.rsplit("/", 1)[1])).collect())
    raw[rows[3] : rows[3] + 4] = b"XXXX"
    raw[(rows[5] + rows[6]) // 2] ^= 0xFF
    open(path, "wb").write(bytes(raw[:-7]))
    damaged = warc.read_archives(spark, folder).where(F.col("archive").endswith(path.rsplit("/", 1)[1]))
    assert damaged.where("valid").count() == n - 3 and damaged.where("not valid and error is not null").count() >= 3
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0
    assert warc.read_archives(spark, folder, range_bytes=5000).rdd.getNumPartitions() > 8


def test_warc_damaged_dictionary_and_clashing_names(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", prose(i, 300), 1, "x", 2) for i in range(40)], "page_id bigint, url string, html string, archive int, records string, offset int").coalesce(1)
    dictionary = warc.train_dictionary(pages, size=4096)
    for k, harm in enumerate((lambda raw, n: raw[:20] + bytes([raw[20] ^ 0xFF]) + raw[21:], lambda raw, n: raw[: 4 + n // 2], lambda raw, n: raw)):
        folder = f"file://{tmp_path}/{k}"
        (made,) = warc.write_archives(pages, folder, dictionary).collect()
        raw = open(made.archive, "rb").read()
        open(made.archive, "wb").write(harm(raw, int.from_bytes(raw[4:8], "little")))
        rows = warc.read_archives(spark, folder).collect()
        assert len(rows) >= (40, 1, 40)[k] and {r.valid for r in rows} == {k == 2}
        assert all(("dictionary" in r.error, "truncated" in r.error, False)[k] for r in rows if r.error)


def test_warc_validates_headers():
    good = warc.build_record("<x>", "u", b"abc")
    assert warc.parse_record(good)[2] is None
    assert warc.parse_record(good.replace(b"WARC/1.1", b"HTTP/1.1"))[2] == "no version line"
    assert warc.parse_record(good.replace(b"Content-Length: 3", b"Content-Length: 4"))[2] == "content length does not match"
    assert warc.parse_record(good.replace(b"abc", b"abd"))[2] == "payload digest does not match"
    assert warc.parse_record(good[:10])[2] == "no end of headers"


def test_lines_of_one_first_hash_are_different(spark):
    one, two, four, five, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, (1 << 64) - 1
    turn = lambda x, n: (x << n | x >> (64 - n)) & full
    word = lambda x: turn(int.from_bytes(x, "little") * two & full, 31) * one & full
    state = lambda x: (turn((42 + five + 16) & full ^ word(x), 27) * one + four) & full
    target = state(b"line no.") ^ word(b" is one.")
    for k in range(1 << 20):
        head = b"%08d" % k
        tail = (turn((target ^ state(head)) * pow(one, -1, 1 << 64) & full, 33) * pow(two, -1, 1 << 64) & full).to_bytes(8, "little")
        if all(32 < c < 127 for c in tail):
            break
    texts = [(1, "line no. is one."), (2, (head + tail).decode())]
    df = documents(spark, texts)
    assert len({r.k1 for r in lines.lines(df).collect()}) == 1 and len({r.k2 for r in lines.lines(df).collect()}) == 2
    assert sorted((r.doc_id, r.text) for r in lines.keep(df).collect()) == texts


# top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)).astype(np.float32) * rng.uniform(0.1, 4, (300, 1)).astype(np.float32)
    x[7], x[8] = x[3], x[3]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (None, x[0].tolist(), 0), (901, [1.0, None] + [0.0] * 10, 0), (902, [1.0], 0), (903, [float("nan")] * 12, 0), (50, x[50].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = {}
    for r in topk.top_k(df, k=5, block_rows=64).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id, r.score))
    ids, m = [*range(300), 50], np.vstack([x, x[50:51]]).astype(float)
    s = m @ m.T
    for i in range(300):
        order = sorted((-round(float(s[i, j]), 9), ids[j]) for j in range(301) if j != i)[:5]
        mine = sorted(got[i])
        if i == 50:
            mine = mine[::2]
        assert [n for _, n, _ in mine] == [n for _, n in order]
    assert set(got) == set(range(300))
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id < 3"), k=5).count() == 6
    some = {(r.vec_id, r["rank"], r.neighbour_id) for r in topk.top_k(df, k=5, queries="id % 50 = 0", block_rows=64).where("vec_id <> 50").collect()}
    assert some == {(i, n, j) for i in range(0, 300, 50) if i != 50 for n, j, _ in got[i]}
    shorter = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(3)], "vec_id bigint, embedding array<float>, rank int")
    mixed = [(r.vec_id, r["rank"], r.neighbour_id, r.score) for r in topk.top_k(df.where("vec_id < 20").unionByName(shorter), k=1).collect()]
    assert len(mixed) == 23 and {(0, 1, 1, 1.0), (1, 1, 2, 3.0), (2, 1, 1, 3.0)} <= set(mixed)


def test_blocks_are_in_the_order_of_their_numbers():
    names = [f"x/part-{p:05d}-9a-c{n}.snappy.parquet" for p in (0, 2, 11) for n in ("000", "101", "999", "1000", "1001")]
    assert sorted(random.Random(1).sample(names, len(names)), key=topk.block_order) == names


def test_tokens_of_batches():
    w = tb.words(pa.array(["Ab cd", None, "", "é-x"]))
    assert np.diff(w.offsets).tolist() == [2, 0, 0, 2]


def test_different_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(tb, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    data = np.frombuffer(b"abcdabxycdab", np.uint8)
    starts = np.arange(0, 12, 2)
    _, at, place = tb.distinct(data, starts, starts + 2)
    assert [data[2 * i : 2 * i + 2].tobytes() for i in at] == [b"ab", b"cd", b"xy"] and place.tolist() == [0, 1, 0, 2, 1, 0]
    text = "the cat, the dog, the don't\n\n x"
    rows = next(bpe._chunk_rows(iter([pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": pa.array([text])})]), 1 << 20, bpe.VOCABULARY, None))
    words, ranks = rows.column("words").to_pylist()[0], bpe.load_ranks()
    spelled = [bytes(b for s in w for b in [next(p for p, r in ranks.items() if r == s & 65535)[0]]) for w in words]
    assert b"".join(spelled[i] for i in rows.column("docs").to_pylist()[0][0]).decode() == text
    assert lengths.WordCounter().lengths(pa.array([text])).tolist() == [len(reference_bpe(text, ranks))]
