"""Strict readers: fixed schemas, ids as text, and failures instead of repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simvane.operators.integrity import IntegrityError

POSITIONS = "barcode string, in_tissue int, array_row bigint, array_col bigint, pxl_row bigint, pxl_col bigint"
LAYERS = "barcode string, section string, label string"
SCALE_FIELDS = ("spot_diameter_fullres", "tissue_hires_scalef", "fiducial_diameter_fullres", "tissue_lowres_scalef")


def _fail_on(df: DataFrame, bad, what: str) -> DataFrame:
    """df; a row where bad holds fails the query when it is read, without a pass of its own."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(what)).cast(df.schema[first].dataType)).otherwise(F.col(first)))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if twice:
        raise IntegrityError(f"repeated keys {list(keys)}: {[tuple(r)[:-1] for r in twice]}")
    return df


def embedding_csv(spark: SparkSession, path: str, dimensions: int, canonical: DataFrame | None = None, id_name: str = "cell_id") -> DataFrame:
    """cell_id (text as written, leading zeros kept) and v (doubles) of a CSV of an id and `dimensions` numbers with a header line.

    A width other than that, a field that is no number, a component that is not finite, a blank or
    repeated id fails; with `canonical` (a column of that name) so do missing and further ids.
    """
    lines = spark.read.text(path).limit(1).collect()
    if not lines or len(lines[0][0].lstrip("﻿").split(",")) != dimensions + 1:
        raise IntegrityError(f"the header must have {dimensions + 1} fields")
    schema = T.StructType([T.StructField(id_name, T.StringType()), *(T.StructField(f"c{i}", T.DoubleType()) for i in range(dimensions))])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)
    names = [f"c{i}" for i in range(dimensions)]
    bad = F.col(id_name).isNull() | (F.trim(id_name) == "")
    for c in names:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    out = require_unique(_fail_on(raw, bad, "a row has no id or a field that is no finite number").select(id_name, F.array(*names).alias("v")), [id_name])
    if canonical is not None:
        for a, b, what in ((canonical, out, "missing"), (out, canonical, "unknown")):
            if a.select(id_name).join(b.select(id_name), id_name, "left_anti").limit(1).count():
                raise IntegrityError(f"{what} ids")
    return out


def headerless_csv(spark: SparkSession, path: str, schema: str, keys: Sequence[str], sep: str = ",") -> DataFrame:
    """A CSV or TSV without a header; a NULL anywhere or a repeated key fails."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("sep", sep).csv(path)
    bad = F.lit(False)
    for c in df.columns:
        bad = bad | F.col(c).isNull()
    return require_unique(_fail_on(df, bad, "a field is empty"), keys)


def spot_positions(spark: SparkSession, path: str) -> DataFrame:
    return headerless_csv(spark, path, POSITIONS, ["barcode"])


def layer_map(spark: SparkSession, path: str) -> DataFrame:
    return headerless_csv(spark, path, LAYERS, ["section", "barcode"], sep="\t")


def scale_factors(spark: SparkSession, path: str, fields: Sequence[str] = SCALE_FIELDS) -> DataFrame:
    """One row of a JSON object with exactly these fields, all finite and above 0."""
    text = spark.read.text(path, wholetext=True)
    keys = F.array_sort(F.json_object_keys("value"))
    out = text.withColumn("keys", keys).withColumn("x", F.from_json("value", ", ".join(f"`{f}` double" for f in fields))).select("x.*", "keys")
    bad = ~F.coalesce(F.col("keys") == F.array(*[F.lit(f) for f in sorted(fields)]), F.lit(False))
    for f in fields:
        bad = bad | F.col(f).isNull() | (F.col(f) <= 0) | F.isnan(f) | (F.col(f) == float("inf"))
    return _fail_on(out, bad, "scale factors must be these fields, finite and above 0").drop("keys")


#: Names of the human species, and the token that stands for it in a list.
HUMAN_NAMES, HUMAN_TOKEN = ("human", "homo sapiens", "homo sapiens sapiens"), "hs"
#: Flags of a canonical marker.
CANONICAL = ("1", "true", "yes", "y", "canonical marker")


def marker_tsv(spark: SparkSession, path: str, names: Sequence[str] = HUMAN_NAMES, token: str = HUMAN_TOKEN) -> DataFrame:
    """symbol and cell_type of a marker table (plain or gzip TSV): rows of the species, by a name or a token among its letters in any case, flagged canonical, with a plausible symbol as written. Headers are matched without case and punctuation; a table without such a row fails."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    headers = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in raw.columns}

    def column(*aliases: str):
        for a in aliases:
            if a in headers:
                return F.col(f"`{headers[a]}`")
        raise IntegrityError(f"no column {aliases[0]}")

    species = F.lower(F.trim(column("species")))
    human = species.isin(*names) | F.array_contains(F.split(species, "[^a-z]+"), token)
    flagged = F.lower(F.trim(column("canonicalmarker", "canonical"))).isin(*CANONICAL)
    symbol, cell_type = F.trim(column("officialgenesymbol", "genesymbol", "symbol")), F.trim(column("celltype"))
    rows = raw.filter(human & flagged & symbol.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.\-]*$") & (cell_type != ""))
    out = rows.select(symbol.alias("symbol"), cell_type.alias("cell_type")).distinct()
    if out.limit(1).count() == 0:
        raise IntegrityError("no canonical marker of the species")
    return out


def ontology_obo(spark: SparkSession, path: str) -> DataFrame:
    """id, name, synonyms, obsolete of the terms of an OBO file with ids CL:ddddddd."""
    stanzas = spark.read.option("lineSep", "[Term]").text(path)
    body = F.regexp_replace("value", r"(?s)\n\[[A-Z][a-z]+\].*", "\n")  # a stanza of another kind ends the term
    out = stanzas.select(body.alias("value")).select(
        F.regexp_extract("value", r"(?m)^id:\s*(CL:\d{7})\s*$", 1).alias("id"),
        F.regexp_extract("value", r"(?m)^name:\s*(.+?)\s*$", 1).alias("name"),
        F.regexp_extract_all("value", F.lit(r'(?m)^synonym:\s*"([^"]+)"'), F.lit(1)).alias("synonyms"),
        F.col("value").rlike(r"(?m)^is_obsolete:\s*true\s*$").alias("obsolete"),
    )
    return out.filter("id <> ''")


def ontology_owl(spark: SparkSession, path: str) -> DataFrame:
    """As ontology_obo, of the classes of an OWL file in XML."""
    raw = spark.read.format("xml").option("rowTag", "owl:Class").option("ignoreNamespace", False).schema("`_rdf:about` string, `rdfs:label` string, `oboInOwl:hasExactSynonym` array<string>, `owl:deprecated` string").load(path)
    term = F.regexp_extract("`_rdf:about`", r"(CL_\d{7})$", 1)
    return raw.select(F.regexp_replace(term, "_", ":").alias("id"), F.col("`rdfs:label`").alias("name"), F.coalesce("`oboInOwl:hasExactSynonym`", F.array().cast("array<string>")).alias("synonyms"), F.coalesce(F.col("`owl:deprecated`") == "true", F.lit(False)).alias("obsolete")).filter("id <> ''")


def resolve_names(labels: DataFrame, ontology: DataFrame, label: str) -> DataFrame:
    """labels with the id of the one term, not obsolete, of exactly that name; NULL if none or several."""
    one = ontology.filter(~F.col("obsolete")).groupBy("name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("term_id")).filter("n = 1")
    return labels.join(one.select(F.col("name").alias(label), "term_id"), label, "left")


def png_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height of PNG files; another format fails."""
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 24))

    def number(at: int):
        return F.conv(F.substring(head, at, 8), 16, 10).cast("int")

    sound = (F.substring(head, 1, 16) == "89504E470D0A1A0A") & (F.substring(head, 25, 8) == F.hex(F.lit("IHDR")))
    return _fail_on(files.select("path", number(33).alias("width"), number(41).alias("height"), sound.alias("sound")), ~F.col("sound"), "not a PNG image").drop("sound")


def union_parts(parts: Sequence[DataFrame], row: str) -> DataFrame:
    """Parts in their order with part_no: (part_no, row) identifies a row, however Spark splits the input."""
    out = None
    for k, p in enumerate(parts):
        one = p.withColumn("part_no", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return require_unique(out, ["part_no", row])


def synthetic_ids(df: DataFrame, row: str, batch: str) -> DataFrame:
    """cell_id as Cell-<row>-Batch-<batch>."""
    return df.withColumn("cell_id", F.concat(F.lit("Cell-"), F.col(row), F.lit("-Batch-"), F.col(batch)))


def annotation_frame(frame: DataFrame, categories: DataFrame | None = None, code: str | None = None, index: str = "_index") -> DataFrame:
    """A staged annotation table with its index required and unique, NaN as NULL, infinities refused, and a category code resolved (-1 is NULL). categories: code, name."""
    if index not in frame.columns:
        raise IntegrityError(f"no column {index}")
    out = frame
    for f in frame.schema:
        if isinstance(f.dataType, T.FloatType | T.DoubleType):
            x = F.nanvl(f.name, F.lit(None).cast(f.dataType))
            out = out.withColumn(f.name, F.when(F.abs(x) == float("inf"), F.raise_error(F.lit("an annotation is infinite")).cast(f.dataType)).otherwise(x))
    if categories is not None and code is not None:
        out = out.join(F.broadcast(categories.select(F.col("code").alias("code_"), "name")) if categories.limit(65_537).count() <= 65_536 else categories.select(F.col("code").alias("code_"), "name"), F.col(code) == F.col("code_"), "left").drop("code_", code).withColumnRenamed("name", code)
    return require_unique(out, [index])


def sparse_counts(coo: DataFrame, cell: str = "cell", gene: str = "gene", value: str = "value") -> DataFrame:
    """Counts as ints: a repeated coordinate, a negative or fractional or missing value fails."""
    bad = F.col(value).isNull() | (F.col(value) < 0) | (F.col(value) != F.floor(value))
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a count is not a whole number from 0")).cast("int")).otherwise(F.col(value).cast("int"))
    return require_unique(coo, [cell, gene]).withColumn(value, checked)


def run_catalog(spark: SparkSession, pattern: str, status: str = "completed") -> DataFrame:
    """Rows of all run summaries (JSON) that match pattern, with the run's folder, of one status."""
    raw = spark.read.option("multiLine", True).json(pattern)
    rows = raw.withColumn("run", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))
    return rows.filter(F.col("status") == status) if "status" in raw.columns else rows


def verify_files(spark: SparkSession, pattern: str, expected: DataFrame) -> DataFrame:
    """Files whose sha256 or size differs from expected (name, sha256, bytes), or that are missing: name and problem."""
    files = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("f"), F.sha2("content", 256).alias("h"), "length")
    joined = expected.join(files, F.col("name") == F.col("f"), "left")
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("h") != F.col("sha256"), "hash")
    return joined.select("name", problem.alias("problem")).filter("problem is not null")


def loss_log(spark: SparkSession, path: str, value: str = "loss") -> DataFrame:
    """n, first, last, min and mean of a JSON-lines log with a step."""
    rows = spark.read.schema(f"step bigint, `{value}` double").option("mode", "FAILFAST").json(path)
    return rows.agg(F.count(value).alias("n"), F.min_by(value, "step").alias("first"), F.max_by(value, "step").alias("last"), F.min(value).alias("least"), F.avg(value).alias("mean"))
