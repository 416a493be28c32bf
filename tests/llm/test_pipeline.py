import tracemalloc

import corpus_pipeline
import pyarrow as pa
from pagewise.llm import leaks, nearcopies, textbatch as tb, toxicity
from pagewise.llm.shared import table

from .cases import documents, prose


def test_pipeline_is_its_stages_by_brute_force(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near copies", "decontamination", "byte-level bpe"]
    documents = table(spark, data, "documents")
    field = toxicity.train(documents, table(spark, data, "labels"))
    bad = {r.doc_id for r in toxicity.score(documents, field).where("toxic = 1").collect()}
    left = sorted((r.doc_id, r.text) for r in documents.collect() if r.doc_id not in bad)
    seen, cleaned = set(), {}
    for i, t in left:
        kept = [x for x in t.split("\n") if x.strip(" ") and not (x in seen or seen.add(x))]
        n = sum(bool(x.strip(" ")) for x in t.split("\n"))
        if kept or not n:
            cleaned[i] = t if len(kept) == n else "\n".join(kept)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    gone = set(cleaned) - set(rows)
    assert set(rows) <= set(cleaned)
    sets = {i: nearcopies._multisets(pa.array([t]))[0] for i, t in cleaned.items()}
    items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    seeds = leaks.seeds(items)
    for i in gone:
        near = any(nearcopies.similarity(sets[i], sets[j]) >= nearcopies.THRESHOLD for j in cleaned if j != i)
        assert near or leaks.find(tb.words(pa.array([cleaned[i]])), seeds)
    for i, r in rows.items():
        assert r.decoded == cleaned[i] and r.n_tokens == len(r.tokens)
    left = sorted(rows)
    for k, i in enumerate(left):
        assert not leaks.find(tb.words(pa.array([cleaned[i]])), seeds)
        for j in left[:k]:
            assert not nearcopies.similarity(sets[i], sets[j]) >= 0.65
    assert len(gone) > 5


def test_pipeline_with_an_empty_table(spark, data, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, data, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_driver_fits_nothing(spark):
    bad = ["vilex", "krumbo", "snarfy"]
    docs = documents(spark, [(i, prose(i, 60) + (" " + " ".join(f"{prose(i * 31 + k, 2)} {w}" for k, w in enumerate(bad)) if i % 4 == 0 else "")) for i in range(120)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id bigint, quality int, toxic int")
    tracemalloc.start()
    try:
        field = toxicity.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert field.weight.shape == (3 * toxicity.SIZE + 1,) and field.weight.any() and peak < 8 * field.weight.nbytes
