from __future__ import annotations

import re
from itertools import permutations

import duckdb
import pytest

from splitforge.llm import filter_audit as A

from .helpers import DOCS, awkward, frame, saved

LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labels(rows):
    return [(r[0], k % 2, k % 3 == 0 and 1 or None) for k, r in enumerate(rows) if k % 4] + [(rows[0][0], 0, 1), (rows[0][0], 1, None), (None, 1, 1), (987654, 1, 1)]


def brute(rows, marks):
    good, toxic = ({d for d, *v in marks if d is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    failed = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and least[t] < r[0]}
        failed.append((r[3] or "", {k for k, v in f.items() if v}, r[0] in good, r[0] in toxic))
    out = []
    for part in {f[0] for f in failed}:
        mine, removed, shapley = [f for f in failed if f[0] == part], {}, dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for i, x in enumerate(order):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shapley[x] += len(gone)
                fails = [f for f in mine if x in f[1]]
                removed["".join(order), i + 1] = (len(left), len(gone), len(fails) - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone))
        out += [(part, o, i, *v, shapley[o[i - 1]]) for (o, i), v in removed.items()]
    return sorted(out)


def case(seed=6):
    rows = awkward(seed)
    many = " ".join(f"Word{k}" for k in range(70))
    long_ = "start of a long text " * 400
    rows += [(1100 + k, t, "en", "s0", 1) for k, t in enumerate([many, many, many + " 100%", long_, long_ + "x", long_ + "y", long_, "", None])]
    return [*rows, (1101, many, "en", "s1", 1), (5, "another text", "en", "s1", 1)]


@pytest.mark.parametrize("keep", [64, 1])
def test_equals_brute_force(spark, keep):
    """With one bit a hash, classes hold texts that differ and must be compared."""
    rows = case()
    docs, marks = frame(spark, rows, extra=True), spark.createDataFrame(labels(rows), LABELS)
    got = sorted(tuple(r) for r in A.audit(A.masks(docs, marks, keep=keep)).collect())
    assert got == brute(rows, labels(rows))


def test_equals_sql(spark, tmp_path):
    rows = case(7)
    saved(frame(spark, rows, extra=True), str(tmp_path), "documents")
    saved(spark.createDataFrame(labels(rows), LABELS), str(tmp_path), "labels")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    con.execute(f"create view q as {A.OP13_SQL}")
    out = A.op13_filter_audit(spark, str(tmp_path))
    got, want = sorted(map(tuple, out.collect())), sorted(con.execute(f"select {', '.join(out.columns)} from q").fetchall())
    assert got == want == brute(rows, labels(rows))


def test_singletons_drop_out(spark):
    rows = [(1, "aa", None, "s", 0), (2, "bb", None, "s", 0), (3, "aa", None, "s", 0), (4, "x" * 2000, None, "s", 0), (5, "x" * 1999 + "y", None, "s", 0), (6, "ccc", None, "s", 0)]
    docs = frame(spark, rows)
    kept = {r.doc_id for r in A.refined(A.profiles(docs)).collect()}
    assert kept == {1, 3}
    assert [r.doc_id for r in A.duplicates(docs, A.profiles(docs)).collect()] == [3]


def test_empty_tables(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert A.audit(A.masks(empty, none)).count() == 0
    rows = case()
    assert sorted(tuple(r) for r in A.audit(A.masks(frame(spark, rows), none)).collect()) == brute(rows, [])
