"""Documents that every operator has to bear: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from __future__ import annotations

import random

EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept_id bigint, a bigint, b string, row int, pos int, __n int, shard int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ba", "le", "tor", "in", "es", "qu", "zon", "ri"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("\n" if i % 17 == 16 else "") for i, w in enumerate(words))


LONG = prose(99, 60_000)


def rows(texts: list[tuple[int | None, str | None]]) -> list[tuple]:
    return [(i, t, "en", "s", None if t is None else len(t), 7, i, "x", 1, 2, 3, 4) for i, t in texts]


HARD: list[tuple[int | None, str | None]] = [
    (1, None), (2, ""), (3, "   \n\n \t"), (4, LONG), (5, prose(1, 80)), (6, prose(1, 80)), (6, prose(1, 80)),
    (None, prose(2, 50)), (None, None), (7, "***"), (8, "naïve 漢字 🙂 ÀÉ"), (9, prose(3, 3)), (9, prose(4, 30)),
]


def documents(spark, texts):
    return spark.createDataFrame(rows(texts), EXTRA)
