"""Sources (S1-S8): driver parquet tables, the reference's CSV files,
prediction-file folders and the keyed vector store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from admitflow import schemas
from admitflow.functions.keys import stem

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One driver table; parquet gives column pruning and filter pushdown."""
    return spark.read.parquet(f"{d}/{name}.parquet")


def _read_csv(spark: SparkSession, path: str, columns: list[str], **options) -> DataFrame:
    """A CSV file with a header, all columns as text, chosen by name. Malformed
    rows fail the read, and so does a column that the header lacks."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", **options)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(raw.columns)}")
    return raw.select(*[F.col(f"`{c}`") for c in columns])


def _number(c: str, kind: str, path: str) -> Column:
    """Text to ``kind``; null stays null, any other text that is no such number
    fails the job. ``1.0`` is the integer 1."""
    text = F.trim(F.col(c))
    value = text.try_cast("double")
    ok = value.isNotNull() if kind == "double" else value.isNotNull() & (value == F.floor(value))
    bad = F.raise_error(F.concat(F.lit(f"{path}: column {c} is no {kind}: "), text))
    return F.when(text.isNull() | (text == ""), F.lit(None)).when(ok, value.cast(kind)).otherwise(bad.cast(kind))


def read_label_csv(spark: SparkSession, path: str, label_col: str = "readmitted_within_30days") -> DataFrame:
    """Train.csv / valid.csv by header name, in any column order; the label
    column becomes the integer ``label``."""
    return _read_csv(spark, path, ["id", label_col]).select("id", _number(label_col, "int", path).alias("label"))


def read_id_csv(spark: SparkSession, path: str) -> DataFrame:
    """Test.csv - only ``id`` is used."""
    return _read_csv(spark, path, ["id"])


def read_notes_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: notes.csv by header name - multi-line quoted text."""
    return _read_csv(spark, path, [f.name for f in schemas.NOTES_FILE.fields], multiLine=True, quote='"', escape='"')


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """The sequence store ``(id, day_idx, features)``."""
    return spark.read.schema(schemas.SEQUENCE_STORE).parquet(path)


def read_vectors(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """The note vector store; with ``ids`` only those notes (a semi
    join, so the scan is pruned to ``note_id, vec`` and filtered by key)."""
    v = spark.read.schema(schemas.VECTOR_STORE).parquet(path)
    return v if ids is None else v.join(ids.select("note_id").distinct(), "note_id", "left_semi")


def numeric_columns(df: DataFrame) -> list[str]:
    """The numeric columns of a frame."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def read_prediction_files(spark: SparkSession, folder: str, exclude: str = "ensemble",
                          score_col: str = "readmitted_within_30days") -> DataFrame:
    """S7 + S8: every ``*.csv`` prediction table right under a result folder -
    a plain file or a folder of part files, as the sinks write them - as one
    long table ``(model_id, id, score)``. Tables whose name contains ``exclude``
    are skipped; ``model_id`` is the name before the first dot. A folder without
    predictions is an error."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(top, "*.csv"))
    paths = sorted(f.getPath().toString() for f in found or [])
    paths = [p for p in paths if not exclude or exclude not in p.rsplit("/", 1)[-1]]
    if not paths:
        raise FileNotFoundError(f"no prediction file in {folder}")
    out = None
    for path in paths:  # one per model
        raw = _read_csv(spark, path, ["id", score_col])
        one = raw.select(stem(F.lit(path.rsplit("/", 1)[-1])).alias("model_id"), "id", _number(score_col, "double", path).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out
