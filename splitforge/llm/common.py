"""Small pieces that the operators share: paths, tables cut from lineage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links that a task makes a forest of at once, and bytes of a table that is sent to all tasks.
LINKS, FEW_BYTES = 1 << 20, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset and the master is local (tests) a temporary one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='splitforge-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as Parquet table in the shared folder: lineage is cut and a lost executor costs nothing.

    Tables that a result still reads stay in the folder; its owner clears it when the session ends.
    """
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that no plan reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row even if body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def few(rows: DataFrame, width: int, most: int | None = None) -> DataFrame:
    """The rows, of ``width`` bytes each or so, sent to all tasks if they are within ``most`` bytes: what they are joined with stays where it is."""
    return F.broadcast(rows) if width * rows.count() <= (FEW_BYTES if most is None else most) else rows


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; root stays flat, each set named by its least member."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) -> links (v, u) of the same components: ``LINKS`` at a time, each node and the least one that these links lead to."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = pa.Table.from_batches(held)
        node, at = np.unique(np.concatenate([links.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
        root = np.arange(len(node))
        united(root, at[: links.num_rows], at[links.num_rows :])
        low = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[low]), pa.array(node[root[low]])], names=["v", "u"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= LINKS:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected edges (u, v) of longs; component is the least node reachable, and no node is its own.

    Links are made a forest where they are read, so a node has one lower node for each
    ``LINKS`` links at most, however many it had.  A round gathers these lower nodes,
    joins them and the node to the least of them, and that one's least in its place
    (small-star and pointer jumping), until each node has one and that has none.  A round
    is one shuffle, and a join that needs none up to ``FEW_BYTES``; it is written to the
    shared folder, so the plan stays short and a join at a hub can be split.
    """
    links, before = edges.filter("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")), None
    while True:
        lower = links.mapInArrow(_forest, "v long, u long").groupBy("v").agg(F.collect_set("u").alias("all"))
        now = written(lower.select("v", F.array_min("all").alias("u"), F.filter("all", lambda x: x != F.array_min("all")).alias("more")))
        if before is not None:
            removed(before)
        least = now.select(F.col("v").alias("at"), F.col("u").alias("least"))
        stepped = now.join(few(least, 16), F.expr("u = at"), "left")
        if stepped.filter("at is not null or size(more) > 0").isEmpty():
            return now.select(F.col("v").alias("node"), F.col("u").alias("component"))
        links, before = stepped.select(F.coalesce("least", "u").alias("u"), F.explode(F.concat(F.array("v"), "more")).alias("v")), now
