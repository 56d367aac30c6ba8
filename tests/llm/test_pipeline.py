from __future__ import annotations

import random

import corpus_pipeline as P
from splitforge.llm import registry

from .helpers import DOCS, saved, words

COLUMNS = [c.split()[0] for c in DOCS.split(", ")]


def tables(spark, path):
    """Good prose, junk, near copies and a benchmark passage, with labels that say so."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ko", "li", "mu", "ter") for b in ("ran", "sil", "dor", "pen") for c in ("a", "en", "is", "or", "u", "ing")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    junk = lambda n: " ".join(rng.choice(["BUY", "$$$", "now!!!", "CLICK", "####", "win", "777"]) for _ in range(n))
    rows = [(k, prose(120), "en", f"s{k % 4}", 1) for k in range(240)]
    rows += [(1000 + k, junk(80), "en", f"s{k % 4}", 1) for k in range(120)]
    near = rows[7][1].split()
    near[60] = "changed"
    passage = words(rng, 20)
    rows += [(2000, " ".join(near), "en", "s1", 1), (2001, rows[8][1], "en", "s1", 1), (2002, f"{prose(60)} {passage} {prose(60)}", "en", "s2", 1), (None, prose(90), None, None, None)]
    saved(spark.createDataFrame(rows, DOCS), path, "documents")
    saved(spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows if r[0] is not None and r[0] < 2000], "doc_id long, quality int, toxic int"), path, "labels")
    saved(spark.createDataFrame([("b1", passage), ("b2", words(rng, 30))], "item_id string, text string"), path, "benchmark")
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([r.doc_id for r in docs.collect()])
    quality, dedup, clean, mixed, sharded = kept
    good = {r[0] for r in rows if r[0] is not None and r[0] < 1000}
    assert good <= set(quality) and not any(d is not None and 1000 <= d < 2000 for d in quality)
    assert {7, 8} <= set(dedup) and not {2000, 2001} & set(dedup) and good <= set(dedup)
    assert set(dedup) - set(clean) == {2002}
    assert set(mixed) <= set(clean) and max(mixed.count(d) for d in set(mixed)) <= 2
    assert sorted(map(str, mixed)) == sorted(map(str, sharded))


def test_clashing_columns_repeated_ids_and_long_texts(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    good = [r for r in rows if r[0] is not None and r[0] < 1000]
    # one doc_id with two texts, rows without an id, and a text of many pages
    rows += [(0, good[1][1] + " " + good[2][1], "en", "s1", 1), (None, good[3][1] + " " + good[4][1], None, None, None), (3000, " ".join(r[1] for r in good[:200]), "en", "s2", 1)]
    extra = [(*r, 5.0, 2, "t", "e", "d", 9, "k") for r in rows]
    docs = spark.createDataFrame(extra, DOCS + ", score double, `__size` int, time string, epochs string, doc string, row int, key string")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert {(r.score, r["__size"], r.time, r.epochs, r.doc, r.row, r.key) for r in docs.collect()} == {(5.0, 2, "t", "e", "d", 9, "k")}
        if k == 1:
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert {t for d, t in kept if d == 0} == {good[0][1], rows[-3][1]} and (None, rows[-2][1]) in kept and (3000, rows[-1][1]) in kept


def test_run_equals_the_stages_and_empty(spark, tmp_path):
    tables(spark, str(tmp_path / "a"))
    got = P.run(spark, str(tmp_path / "a"))
    assert {"doc_id", "shard", "slot"} <= set(got.columns) and got.count() > 240
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        saved(spark.createDataFrame([], schema), str(tmp_path / "b"), name)
    assert P.run(spark, str(tmp_path / "b")).count() == 0


def test_registry():
    assert [int(n[2:].split("_")[0]) for n in registry.QUERIES] == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_near_duplicates_come_from_fingerprints_and_trees(spark, monkeypatch):
    """Candidates of the stage come from BK-trees over fingerprints; an exact check follows, so equal fingerprints alone drop nothing."""
    from splitforge.llm import simhash_bktree as H

    calls, link = [], H.link_edges
    monkeypatch.setattr(H, "link_edges", lambda *a, **k: calls.append(a) or link(*a, **k))
    monkeypatch.setattr(H, "SHARD_TEXTS", 7)  # groups are cut
    rng = random.Random(5)
    base, line = words(rng, 400, 10_000).split(), "this one line comes again "
    own = [line * 400 + " ".join(f"{c}{i}" for i in range(150)) for c in "abcd"]
    rows = [(k, " ".join([*base[: 9 * k], f"n{k}", *base[9 * k + 1 :]]), "en", "s", 1) for k in range(40)]
    rows += [(100 + k, t, "en", "s", 1) for k, t in enumerate(own)] + [(200, own[2].replace("c70 ", "changed "), "en", "s", 1)]
    kept = {r.doc_id for r in P.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert calls and kept == {0, 100, 101, 102, 103}
