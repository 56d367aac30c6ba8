from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import clean_text
from ..operators.shared import saved


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_labelled(spark: SparkSession, path: str | list[str], schema: str | StructType, key: str, exclude: tuple[str, ...] = (), corrupt: str | None = None) -> DataFrame:
    """CSV (also .gz, globs, several files) with an explicit schema, and ``dataset`` (file stem), ``row_idx`` and ``status``.

    row_idx counts a file's rows from zero in their order, without gaps, also where files
    share a task or a file is read in parts; the rows are written once, so it stays the
    same.  status is missing where the key has no value, else valid.  Blank cells, NA,
    nan and null are NULL.  ``corrupt`` names a string column of the schema that gets the
    text of lines with too few or too many cells.
    """
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    rows = (reader.option("columnNameOfCorruptRecord", corrupt) if corrupt else reader).csv(path)
    require_columns(rows, key)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.csv)?(\.gz)?$", 1)
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    rows = saved(rows.select("*", stem.alias("dataset"), place.alias("__at")))
    # one row for each part of a file: where it begins, and how many rows the parts before it have
    parts = rows.groupBy("__at.path", "__at.start").agg(F.min("__at.n").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("path").orderBy("start")) - F.col("__n")
    parts = parts.select(F.col("path").alias("__path"), F.col("start").alias("__start"), "__first", before.alias("__before"))
    rows = rows.join(parts, (F.col("__at.path") == F.col("__path")) & (F.col("__at.start") == F.col("__start")))
    rows = rows.withColumn("row_idx", F.col("__at.n") - F.col("__first") + F.col("__before")).drop("__at", "__path", "__start", "__first", "__before")
    rows = rows.select(*[F.when(~F.col(c).isin("NA", "nan", "null", "NULL", "NaN"), F.col(c)).alias(c) if t == "string" and c not in (key, "dataset", corrupt) else F.col(c) for c, t in rows.dtypes])
    rows = rows.withColumn(key, clean_text(F.col(key))).withColumn("status", F.when(F.col(key).isNull(), "missing").otherwise("valid"))
    return rows.filter(~F.col("dataset").isin(*exclude)) if exclude else rows


def load_table(spark: SparkSession, path: str | list[str], schema: str, key: str, invalid: str = "drop", exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of labelled CSV files; with ``invalid="raise"`` any failure is an error, and so are files without a valid row.

    rows: dataset, row_idx and the typed columns of what is valid, in the files' numbering.
    failures: dataset, row_idx, status (malformed: too few or too many cells; missing: no key;
    invalid: a cell that is not of its type), message and record, the line or its cells as JSON.
    """
    if invalid not in ("drop", "raise"):
        raise ValueError("invalid must be drop or raise")
    fields = spark.createDataFrame([], schema).schema.fields
    text = StructType([StructField(f.name, StringType()) for f in fields] + [StructField("__corrupt", StringType())])
    read = read_labelled(spark, path, text, key, exclude, "__corrupt")
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    wrong = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.concat(F.lit(f"{c}: "), F.col(c), F.lit(f" is not {t}"))) for c, t in kinds.items()]
    message = F.concat_ws("; ", *wrong)
    status = F.when(F.col("__corrupt").isNotNull(), "malformed").when(F.col(key).isNull(), "missing").when(message != "", "invalid").otherwise("valid")
    told = F.when(F.col("status") == "malformed", F.lit("not as many cells as columns")).when(F.col("status") == "missing", F.lit(f"{key} has no value")).otherwise(message)
    judged = saved(read.withColumn("status", status).withColumn("message", told))
    failures = judged.filter("status <> 'valid'").select("dataset", "row_idx", "status", "message", F.coalesce("__corrupt", F.to_json(F.struct(*kinds))).alias("record"))
    rows = judged.filter("status = 'valid'").select("dataset", "row_idx", *[F.col(c).try_cast(t).alias(c) for c, t in kinds.items()])
    if invalid == "raise" and (found := failures.orderBy("dataset", "row_idx").limit(5).collect()):
        raise ValueError("; ".join(f"{r.dataset} row {r.row_idx}: {r.status}, {r.message}" for r in found))
    if rows.isEmpty():
        raise ValueError("no valid row was read")
    return rows, failures


def read_summary(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A table of run summaries: key columns as text, all others as numbers; an absent or empty file, or an absent key, is an error."""
    rows = spark.read.option("header", True).csv(path)
    require_columns(rows, *keys)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows.select(*[F.col(c) if c in keys or not c.endswith(("_mean", "_std", "_count")) else F.col(c).try_cast("double").alias(c) for c in rows.columns])


def read_catalog(spark: SparkSession, root: str, file_name: str = "*.csv") -> DataFrame:
    """(dataset, method, run, path) from a tree root/dataset/method/run/file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", file_name).option("recursiveFileLookup", True).load(root).select("path")
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)/[^/]+$", k)
    return files.select(part(1).alias("dataset"), part(2).alias("method"), part(3).alias("run"), "path").filter("dataset <> ''")


def file_signatures(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, signature): modification time and size of each file; the key of caches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.concat_ws("-", F.unix_micros("modificationTime"), "length").alias("signature"))


def input_signature(df: DataFrame) -> str:
    """A fingerprint of a frame's rows, whatever their order."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{n}-{total or 0}"


def read_split_indices(spark: SparkSession, path: str) -> DataFrame:
    """(run, split, idx) from JSON files with train_idx, val_idx and test_idx, one file a run."""
    wide = spark.read.schema("train_idx array<long>, val_idx array<long>, test_idx array<long>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    splits = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"{s}_idx").alias("idx")) for s in ("train", "val", "test")])
    return wide.select(run.alias("run"), F.explode(splits).alias("s")).select("run", "s.split", F.explode("s.idx").alias("idx"))
