from __future__ import annotations

import hashlib
from collections import defaultdict

import tiktoken

from splitforge.llm import token_rollup as T

from .helpers import awkward, frame, saved

SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def as_dict(df):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in df.collect()}


def test_commits_are_idempotent(spark, tmp_path):
    roll = T.Rollup(spark, str(tmp_path / "r"))
    assert roll.totals().count() == 0
    rows = [("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 5), (None, None, "v1", 1, 7), ("b", "en", "v1", None, None)]
    first = spark.createDataFrame(rows, SCHEMA)
    assert roll.commit(1, first) and not roll.commit(1, first)
    assert roll.commit(2, spark.createDataFrame([("a", "en", "v1", -1, -5), ("a", "en", "v1", 0, 3)], SCHEMA))
    want = {("a", "en", "v1"): (1, 13), (None, None, "v1"): (1, 7), ("b", "en", "v1"): (0, 0)}
    assert as_dict(roll.totals()) == want
    new = roll.compact(str(tmp_path / "c"))
    assert as_dict(new.totals()) == want and {r.id for r in new.committed().collect()} == {1, 2}
    assert len(list((tmp_path / "c" / "totals").iterdir())) == len(list((tmp_path / "c" / "committed").iterdir())) == 1
    assert not new.commit(2, first)
    assert new.commit(3, first) and as_dict(new.totals())["a", "en", "v1"] == (3, 28)
    assert roll.commit(3, spark.createDataFrame([], SCHEMA)) and as_dict(roll.totals()) == want


def test_a_batch_that_died_half_way_counts_once(spark, tmp_path):
    roll = T.Rollup(spark, str(tmp_path / "r"))
    changes = spark.createDataFrame([("a", "en", "v1", 1, 10)], SCHEMA)
    changes.groupBy(*T.KEYS).agg({"docs": "sum"}).withColumnRenamed("sum(docs)", "docs").selectExpr("*", "10L as tokens").write.parquet(f"{roll.path}/totals/batch=5")
    assert roll.totals().count() == 0  # not marked, so not counted
    assert roll.commit(5, changes)
    assert as_dict(roll.totals()) == {("a", "en", "v1"): (1, 10)}


def test_query_equals_a_full_recount(spark, tmp_path):
    rows = awkward(4)
    saved(frame(spark, rows, extra=True), str(tmp_path), "documents")
    with open(T.VOCABULARY, "rb") as f:
        enc: tiktoken.Encoding = T._encoder(f.read())
    want = defaultdict(lambda: [0, 0])
    for doc_id, text, lang, source, _ in rows:
        fate = hashlib.md5(str(doc_id).encode()).hexdigest()[0] if doc_id is not None else "-"
        if fate == "1":
            text = "\n".join(x for x in (text, source) if x is not None)
        for name, n in (("byte_bpe_50k", len(enc.encode_ordinary(text or ""))), ("bytes", len((text or "").encode()))):
            total = want[source, lang, name]
            total[0] += fate != "0"
            total[1] += n * (fate != "0")
    got = as_dict(T.op3_token_rollup(spark, str(tmp_path)))
    assert got == {k: tuple(v) for k, v in want.items()}


def test_long_runs(spark):
    with open(T.VOCABULARY, "rb") as f:
        enc: tiktoken.Encoding = T._encoder(f.read())
    for run in (" " * 20_000, "\n" * 20_000, " \n\t\u00a0\u3000" * 4000, "\x1c" * 20_000):
        for text in (run, f"{run}a", f"a{run}", f"a {run}#b{run}\n7 {run}"):
            assert T.n_tokens(enc, text) == len(enc.encode_ordinary(text))
    n = 4_000_000
    rows = [(k, f"x{ch * n}y", "en", "s", 1) for k, ch in enumerate(" a7#")]
    got = {r.doc_id: r.n for r in T.count_tokens(frame(spark, rows).repartition(4, "doc_id"), "text", "n").collect()}
    assert got[0] == 1 + len(enc._encode_single_piece(" " * (n - 1))) + len(enc.encode_ordinary(" y"))
    assert got[1] == len(enc._encode_single_piece(f"x{'a' * n}y"))
    assert got[2] == len(enc._encode_single_piece("7" * n)) + 2 and got[3] == len(enc._encode_single_piece("#" * n)) + 2


def test_empty(spark, tmp_path):
    saved(frame(spark, []), str(tmp_path), "documents")
    assert T.op3_token_rollup(spark, str(tmp_path)).count() == 0
