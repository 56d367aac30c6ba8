from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from splitforge.llm import suffix_dedup as S

from .helpers import DOCS, frame, saved, words


def brute(rows: list[tuple], length: int = 100) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by a dictionary of first starts; rows of one doc_id, or without one, in their order."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen: set[bytes] = set()
    out = []
    for row in order:
        b = (row[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((row[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(spark, rows, tmp_path, extra=False):
    saved(frame(spark, rows, extra).coalesce(1), str(tmp_path), "documents")
    return sorted((tuple(r) for r in S.op2_suffix_dedup(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, tmp_path, seed):
    from .helpers import awkward

    rng = random.Random(seed)
    rows = awkward(seed)
    line = words(rng, 40)
    rows += [(2000 + k, f"{words(rng, 3)} {line} {words(rng, 3)}", "en", "s", 1) for k in range(150)]  # a crowded line
    rows += [(3000, "a" * 500, "en", "s", 1), (3001, "ab" * 300, "en", "s", 1), (3002, "xa" + "a" * 120, "en", "s", 1), (3003, "z" * 99, "en", "s", 1), (3004, "z" * 100, "en", "s", 1)]
    passage = words(rng, 50)
    rows += [(i, f"{words(rng, 30)} {passage} {words(rng, 4)} {passage}" if k % 2 else words(rng, 80), "en", "s", 1) for k in range(4) for i in (None, 7)]  # rows share an id
    want = sorted(brute(rows), key=str)
    assert sum(r[2] for r in want) > 5000
    assert result(spark, rows, tmp_path, extra=seed == 2) == want


def test_a_line_in_many_contexts(spark, monkeypatch):
    rng = random.Random(4)
    line = words(rng, 18)
    rows = [(k, f"{words(rng, 12)} {line} {words(rng, 12)}", "en", "s", 1) for k in range(2000)]
    rows += [(5000 + k, rows[k][1], "en", "s", 1) for k in range(0, 2000, 100)]
    want = sorted((r[0], r[1], r[2], r[3], r[4]) for r in brute(rows))
    n_removed = S.F.aggregate("spans", S.F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    docs = frame(spark, rows).repartition(4, "doc_id")
    for crowd in (64, 10**9):  # by shared bytes, and all in one key
        out = S.dedup_substrings(docs, crowd=crowd).select("doc_id", "n_bytes", n_removed, S.F.size("spans"), "kept_sha256")
        assert sorted(tuple(r) for r in out.collect()) == want


def windows_of(texts: list[tuple], length: int) -> list:
    """A sorted bucket, in small batches."""
    import pyarrow as pa

    columns = list(zip(*texts))
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "doc", "row", "lo", "body"])
    return [whole.slice(k, 7) for k in range(0, whole.num_rows, 7)]


def test_buckets_compare_across_boundaries(monkeypatch):
    """One key over several buckets and longer than a fold: ranges and edges together find what one set finds."""
    rng, length = random.Random(6), 12
    keys = {b"k1": b"ab", b"k2": b"cd", b"k3": b"ef"}
    rows = sorted((key, k, k, 0, bytes(rng.choice(keys[key]) for _ in range(20))) for k, key in ((k, rng.choice(list(keys))) for k in range(300)))
    for fold in (10, 50, 20_000):
        monkeypatch.setattr(S, "RUN_ROWS", fold)
        found, edges = set(), {}
        for lo, hi in ((0, 90), (90, 97), (97, 220), (220, 300)):
            for batch in S._bucket(length)(iter(windows_of([(r[0], r[1], r[2], r[3], r[0] + r[4]) for r in rows[lo:hi]], length))):
                for w, doc, row, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                    if w is None:
                        found |= {(row, x) for x in range(a, b)}
                    else:
                        edges.setdefault(w, []).append((doc, row, a))
        found |= {(row, x) for places in edges.values() for _, row, a in sorted(places)[1:] for x in range(a, a + length)}
        first, want = {}, set()
        for key, doc, row, _, body in sorted(rows, key=lambda r: r[1]):
            text = key + body
            for a in range(len(text) - length + 1):
                if first.setdefault(text[a : a + length], (row, a)) != (row, a):
                    want |= {(row, x) for x in range(a, a + length)}
        assert found == want


def test_long_texts_are_cut_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 1000)
    rng = random.Random(5)
    long = words(rng, 2000)
    rows = [(1, long, "en", "s", 1), (2, words(rng, 100) + long[3000:8000], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    # the module is shipped by reference, so the parts are tested on the driver as well
    buf = np.frombuffer(long.encode(), np.uint8)
    parts = list(S._segments(buf, np.array([0, len(buf)]), 100))
    assert len(parts) > 5 and sum(p[4] for p in parts) >= len(buf)
    got = sorted(tuple(r) for r in S.dedup_substrings(docs, keep_text=False).select("doc_id", "n_bytes", "kept_sha256").collect())
    assert got == sorted((r[0], r[1], r[4]) for r in brute(rows))


def test_repeated_rows_and_empty(spark, tmp_path):
    rng = random.Random(9)
    t = words(rng, 60)
    docs = spark.createDataFrame([(1, t, "", "", 1), (1, t, "", "", 1), (2, t, "", "", 1)], DOCS)
    got = sorted((r.doc_id, len(r.spans)) for r in S.dedup_substrings(docs).collect())
    assert got == [(1, 0), (1, 1), (2, 1)]
    assert S.dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0
    nothing = S.dedup_substrings(spark.createDataFrame([(1, None, None, None, None)], DOCS)).first()
    assert (nothing.n_bytes, nothing.kept) == (0, b"")


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    start = rng.integers(0, 2980, 800)
    order, run = S.multikey_quicksort(buf, start, 12)
    groups: dict[bytes, set[int]] = {}
    for i, s in enumerate(start):
        groups.setdefault(buf[s : s + 12].tobytes(), set()).add(i)
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert sorted(sorted(order[run == k].tolist()) for k in np.unique(run)) == want
