from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from splitforge.llm import importance_chunks as I

from .helpers import DOCS, awkward, frame, saved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(0, "w1 w2 w3 w4 W5 é w7"), (1, None), (None, "w10 w11, w10"), (1, "漢字 w1")]


def brute(rows, items, order, buckets, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: WORD.findall((t or "").translate(lower))
    hashed = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    docs = [(r[0], words(r[1])) for r in rows]
    s, t = Counter(b for _, w in docs for b in hashed(w)), Counter(b for _, x in items for b in hashed(words(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for k, (id_, w) in enumerate(docs):
        f = hashed(w)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        out.append([id_, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20, k])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[5]))
    rank = {x[5]: i + 1 for i, x in enumerate(able[: percent * len(able) // 100])}
    return sorted(((x[0], x[1], x[2], x[3], rank.get(x[5])) for x in out), key=str)


@pytest.mark.parametrize(("order", "buckets", "chunk", "percent"), [(1, 10_000, 1 << 14, 10), (3, 500, 64, 40), (2, 64, 1, 100), (4, 7, 1 << 20, 0)])
def test_equals_brute_force(spark, order, buckets, chunk, percent):
    rows = awkward(3)
    out = I.resample(frame(spark, rows, extra=True), spark.createDataFrame(ITEMS, "item_id long, text string"), order=order, buckets=buckets, chunk_bytes=chunk, percent=percent)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=str)
    assert got == brute(rows, ITEMS, order, buckets, percent)
    assert chunk > 64 or out.agg({"n_chunks": "max"}).first()[0] > 100


def test_equals_sql(spark, tmp_path):
    rows = [r for r in awkward(4) if r[0] is not None]
    saved(frame(spark, rows, extra=True), str(tmp_path), "documents")
    saved(spark.createDataFrame(ITEMS, "item_id long, text string"), str(tmp_path), "benchmark")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    con.execute(f"create view q as {I.OP12_SQL}")
    out = I.op12_importance_chunks(spark, str(tmp_path))
    want = con.execute(f"select {', '.join(f'"{c}"' for c in out.columns)} from q").fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert any(r[4] for r in want)


def test_checksums():
    texts = [b"", b"a", b"hello", "é漢字".encode(), b"x" * 64, b"y" * 65, bytes(range(256)) * 9]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    assert I.crc32(buf, np.append(0, end[:-1]), end).tolist() == [zlib.crc32(t) for t in texts]


def test_empty_tables(spark):
    empty, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert I.resample(empty, items).count() == 0
    rows = awkward(5)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in I.resample(frame(spark, rows), items).collect()), key=str)
    assert got == brute(rows, [], 1, 10_000, 10)
