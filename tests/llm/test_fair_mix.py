from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from splitforge.llm import fair_mix as M

from .helpers import DOCS, awkward, frame, saved, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, target, left = share * sum(sizes.values()), {}, set(names)
    while left:
        unit = budget / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * unit > most * sizes[s]]
        if not over:
            return target | {s: weight[s] * unit for s in left}
        for s in over:
            target[s] = float(most * sizes[s])
            budget -= target[s]
            left.remove(s)
    return target


def test_targets_and_taken(spark, tmp_path):
    rng = random.Random(1)
    rows = awkward(8) + [(2000 + k, words(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "a", "a", "b", "Z", "ä", None]), 1) for k in range(800)]
    saved(frame(spark, rows, extra=True), str(tmp_path), "documents")
    got = M.op8_fair_mix(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * max(largest.values()) + 1, s
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = M.op8_fair_mix(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_repeats_documents(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, 20), "en", "s" + str(k % 2), 1) for k in range(100)] + [(3, None, None, None, None)]
    plan = {(r.doc_id, r.source): r.epochs for r in M.mix(frame(spark, rows)).collect()}
    out = M.mixed(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id, r.source] += 1
    assert {k: v for k, v in plan.items() if v} == dict(count)


def test_ends_of_sources_equal_the_join_by_row(spark):
    rng = random.Random(9)
    equal = [(7, "a b c d e f g", "en", "s", 1)] * 60 + [(None, "a b c d e f g", None, "s", 1)] * 40 + [(None, None, None, "s", 0), (None, "", None, None, 1), (-(2**63), "x", "en", None, 1)] * 5
    rows = awkward(4) + equal + [(2000 + k, words(rng, rng.randrange(0, 60)), "en", rng.choice(["a", "a", "b", "ä", "", None]), 1) for k in range(300)]
    for max_epochs, share in ((2, 1.5), (1, 0.4), (3, 2.2)):
        a, b = (sorted(map(str, M.mixed(frame(spark, rows, extra=True), share, max_epochs, broadcast_bytes=n).collect())) for n in (8_000_000, -1))
        assert a == b and len(a) > 50


def test_ties_at_the_cut_and_finer_histograms(spark):
    # 400 equal rows, and rows without an id: all of one source, so the budget ends among them
    text = "a b c d e f g"
    rows = [(7, text, "en", "s", 1)] * 400 + [(None, text, None, "s", 1)] * 300 + [(None, None, None, "s", 0)] * 20
    for last_rows in (5, 50_000):
        docs = frame(spark, rows).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source")
        got = M._mix(docs, 1.5, 2, (3, 1, 2), "x", last_rows).collect()
        assert sum(r["size"] * r.epochs for r in got) == 7 * 1050 and {r.epochs for r in got if r["size"]} == {1, 2}
    rng = random.Random(5)
    rows = awkward(3) + [(2000 + k, words(rng, rng.randrange(1, 60)), "en", rng.choice("aab"), 1) for k in range(300)]
    docs = frame(spark, rows).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source")
    plans = [sorted(map(str, M._mix(docs, 1.5, 2, (3, 1, 2), "x", n).collect())) for n in (1, 50_000)]
    assert plans[0] == plans[1]


def test_clashing_columns_stay(spark):
    docs = frame(spark, awkward(2), extra=True).withColumns({"__size": F.lit(9), "row": F.lit(-1), "time": F.lit("t"), "epochs": F.lit("e")})
    out = M.mixed(docs)
    assert out.columns == docs.columns
    assert {(r["__size"], r.row, r.time, r.epochs, r.key) for r in out.collect()} == {(9, -1, "t", "e", "k")}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    out = M.op8_fair_mix(spark, "/root/testdata/sf0.001").toPandas()
    want = con.execute(M.OP8_SQL).df()[list(out.columns)]
    assert out.sort_values("doc_id").round(6).to_dict("list") == want.sort_values("doc_id").round(6).to_dict("list")


def test_native_plan_and_empty(spark, tmp_path):
    assert M.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert M.mixed(spark.createDataFrame([], DOCS)).count() == 0
    assert M.mix(frame(spark, [(1, None, None, None, None), (1, "", None, "a", 0)])).count() == 2
    saved(frame(spark, awkward(1)), str(tmp_path), "documents")
    plan = M.op8_fair_mix(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
