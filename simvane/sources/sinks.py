"""Sinks: published runs, manifests, matrices and reports."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.operators.integrity import IntegrityError


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One JSON document, written aside and renamed; NaN is refused, an existing file too."""
    text = json.dumps(value, sort_keys=True, allow_nan=False, ensure_ascii=False, indent=1)
    fs, final = _fs(spark, path)
    if fs.exists(final):
        raise FileExistsError(path)
    _, aside = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(aside, False)
    try:
        out.write(bytearray((text + "\n").encode()))
    finally:
        out.close()
    if not fs.rename(aside, final):
        raise OSError(f"can't publish {path}")


class Run:
    """A folder that appears whole or not at all: tables are written to `.incomplete-*`, hashed, listed in manifest.json and renamed."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.final = spark, f"{root.rstrip('/')}/{name}"
        self.folder = f"{root.rstrip('/')}/.incomplete-{name}-{uuid.uuid4().hex[:8]}"
        fs, path = _fs(spark, self.final)
        if fs.exists(path):
            raise FileExistsError(self.final)
        self._tables: dict[str, dict] = {}

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("errorifexists").parquet(f"{self.folder}/{name}")
        held = self.spark.read.parquet(f"{self.folder}/{name}")
        r = held.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*held.columns)).alias("x")).first()
        self._tables[name] = {"rows": r["n"], "content": f"{(r['x'] or 0) & (2**64 - 1):016x}", "schema": held.schema.simpleString()}

    def publish(self, **facts: object) -> str:
        write_json(self.spark, f"{self.folder}/manifest.json", {"status": "completed", "tables": self._tables} | facts)
        fs, aside = _fs(self.spark, self.folder)
        _, final = _fs(self.spark, self.final)
        if fs.exists(final) or not fs.rename(aside, final):
            raise FileExistsError(self.final)
        return self.final


def read_table(spark: SparkSession, run: str, name: str) -> DataFrame:
    """A table of a published run; fails if it isn't what the manifest lists."""
    held = json.loads("\n".join(r[0] for r in spark.read.text(f"{run}/manifest.json", wholetext=True).collect()))
    df = spark.read.parquet(f"{run}/{name}")
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
    if {"rows": r["n"], "content": f"{(r['x'] or 0) & (2**64 - 1):016x}"} != {k: held["tables"][name][k] for k in ("rows", "content")}:
        raise IntegrityError(f"{name} differs from the manifest")
    return df


def write_embedding_csv(df: DataFrame, path: str, dimensions: int, id_col: str = "cell_id", vector: str = "v") -> None:
    df.select(id_col, *(F.get(vector, F.lit(i)).alias(f"dim_{i + 1}") for i in range(dimensions))).write.mode("errorifexists").option("header", True).csv(path)


def write_manifest_csv(df: DataFrame, path: str, columns: Sequence[str], key: str) -> None:
    """A CSV with a header; a repeated key is refused."""
    if df.groupBy(key).count().filter("count > 1").limit(1).count():
        raise IntegrityError(f"repeated {key}")
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def write_panel(df: DataFrame, path: str) -> None:
    """Compact JSON lines in gzip: one class a line, columns in the order of their names; an existing panel is refused."""
    df.select(*sorted(df.columns)).orderBy(sorted(df.columns)[0]).write.mode("errorifexists").option("compression", "gzip").json(path)


def markdown(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """line: the rows of a report table in Markdown, in order, under their header."""
    spark = df.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "at long, line string")
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    rows = df.orderBy(*order).select(body.alias("line")).withColumn("at", F.monotonically_increasing_id() + 2)
    return head.unionByName(rows).orderBy("at").select("line")


def latex(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """line: the rows of a report table in LaTeX."""
    safe = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("--")), r"([&%$#_{}])", r"\\$1") for c in df.columns]
    return df.orderBy(*order).select(F.concat(F.concat_ws(" & ", *safe), F.lit(r" \\")).alias("line"))


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local master may leave it unset; it gets a temporary one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
    if not root:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="simvane-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below shared_root, removed when the driver ends."""
    fs, path = _fs(spark, f"{shared_root(spark)}/simvane-{uuid.uuid4().hex}")
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes checkpoint() work."""
    root = shared_root(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
