"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with names that operators use inside.
EXTRA = ", row long, key string, size long, shard string, score string, h string, fp string, node string, `__row` string"


def words(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def awkward(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, shared passages, near copies, one long text, nulls in every column and repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = [words(rng, rng.randrange(5, 120)) for _ in range(n)]
    passage = words(rng, 60)
    for k in range(0, n, 7):
        texts[k] = f"{texts[k]} {passage} {words(rng, 5)}"
    for k in range(3, n, 11):
        texts[k] = texts[3]
    near = texts[5].split()
    near[2] = "changed"
    texts[6] = " ".join(near)
    texts += [None, "", " \t\n\x0b\x0c\r ", "one", "Ünïcode ÀÉ wörds 漢字 " * 12, words(rng, 9000), "ABC def " * 40]
    rows: list[tuple] = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, "no id " + words(rng, 30), None, None, None), (None, None, None, None, None), (1000, passage, None, None, 3), (1001, passage, "en", "s0", 3)]
    return rows


def frame(spark, rows=None, extra: bool = False, seed: int = 1):
    rows = awkward(seed) if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, DOCS)
    return spark.createDataFrame([(*r, 1, "k", 2, "x", "y", "z", "f", "n", "r") for r in rows], DOCS + EXTRA)


def saved(df, path: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
