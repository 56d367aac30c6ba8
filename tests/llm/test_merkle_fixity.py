from __future__ import annotations

import hashlib

import duckdb
from pyspark.sql import functions as F

from splitforge.llm import merkle_fixity as K

from .helpers import saved

PAGES = "page_id long, url string, html string, node string, level string, hash string"


def pages(n=300):
    rows = [(k, f"http://h/{k}", f"<p>{'x' * (k * 37 % 900)}{k}</p>", None, None, None) for k in range(n)]
    return rows + [(None, "http://none", None, None, None, None), (n + 1, None, None, None, None, None), (5, "http://h/5", "<p>again</p>", "", "", ""), (5, "http://h/5", "<p>again</p>", "", "", "")]


def brute(a, b):
    left, right = ({(r.file, r.offset): (r.digest, r.length) for r in x.collect()} for x in (a, b))
    out = []
    for k in left.keys() | right.keys():
        if left.get(k) != right.get(k):
            out.append((*k, "missing" if k not in right else "extra" if k not in left else "corrupt"))
    return sorted(out)


def test_audit_equals_a_full_comparison(spark):
    good = K.records(spark.createDataFrame(pages(), PAGES), 50)
    bad = good.filter("page_id is null or page_id % 41 <> 3").withColumn("digest", F.when(F.col("page_id") % 67 == 1, F.lit("0")).otherwise(F.col("digest")))
    bad = bad.unionByName(bad.filter("page_id = 7").withColumn("offset", F.col("offset") + 1))
    for size, fanout in ((1 << 10, 2), (1 << 13, 4), (1 << 16, 16)):
        got = sorted((r.file, r.offset, r.status) for r in K.audit(good, bad, size, fanout).collect())
        assert got == brute(good, bad) and {s for *_, s in got} == {"missing", "extra", "corrupt"}


def test_equal_replicas_and_empty(spark):
    good = K.records(spark.createDataFrame(pages(40), PAGES), 10)
    assert K.audit(good, good, 1 << 10, 2).count() == 0
    none = good.limit(0)
    assert K.audit(none, none).count() == 0
    assert K.audit(good, none).filter("status = 'missing'").count() == good.select("file", "offset").count()


def test_only_suspect_nodes_differ(spark):
    good = K.records(spark.createDataFrame(pages(200), PAGES), 100)
    bad = good.withColumn("digest", F.when(F.col("page_id") == 150, F.lit("0")).otherwise(F.col("digest")))
    a, b = (K.merkle_tree(x, 5, 1 << 11, 4) for x in (good, bad))
    differ = a.alias("a").join(b.alias("b"), ["level", "file", "node"]).filter("a.hash <> b.hash").groupBy("level").count().collect()
    assert {r["count"] for r in differ} == {1} and len(differ) == 6


def test_query(spark, tmp_path):
    hits = {h: [k for k in range(40_000) if hashlib.md5(str(k).encode()).hexdigest()[:2] == h][:12] for h in ("00", "01", "02")}
    rows = pages(600)
    for ids in hits.values():  # hit by damage: null, empty and one-letter pages, repeated rows, a long page, as many pages of one id
        rows += [(ids[k], f"u{k}", html, None, None, None) for k, html in enumerate((None, "", "x", "ab", "ab", "é" * 3))]
        rows += [(ids[6], "same", "<p>same</p>", None, None, None)] * 3 + [(ids[7], "u", f"<p>{k}</p>", None, None, None) for k in range(4)] + [(ids[8], None, "long " * 400_000, None, None, None)]
    rows += [(None, "u1", "<p>no id</p>", None, None, None), (None, "u1", None, None, None, None), (None, None, "y", None, None, None)]
    saved(spark.createDataFrame(rows, PAGES), str(tmp_path), "pages")
    got = sorted((tuple(r) for r in K.op1_merkle_fixity(spark, str(tmp_path)).select("file", "offset", "status", "expected", "found").collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(K.OP1_SQL).fetchall(), key=str)
    assert got == want and {r[2] for r in got} == {"missing", "corrupt"} and len(got) > 25
    saved(spark.createDataFrame([], PAGES), str(tmp_path), "pages")
    assert K.op1_merkle_fixity(spark, str(tmp_path)).count() == 0
