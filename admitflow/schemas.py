"""Declared schemas (D1-D11); no schema inference anywhere."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType,
                               StringType, StructField, StructType)


def label_file(label_col: str = "readmitted_within_30days") -> StructType:
    """Train.csv / valid.csv."""
    return StructType([StructField("id", StringType()), StructField(label_col, IntegerType())])


def prediction_file(score_col: str = "readmitted_within_30days") -> StructType:
    """One model's prediction file."""
    return StructType([StructField("id", StringType()), StructField(score_col, DoubleType())])


ID_FILE = StructType([StructField("id", StringType())])                       # D2
NOTES_FILE = StructType([                                                      # D4
    StructField("id", StringType()), StructField("subject_id", StringType()),
    StructField("hadm_id", StringType()), StructField("note_seq", StringType()),
    StructField("text", StringType())])
SEQUENCE_STORE = StructType([                                                  # D3
    StructField("id", StringType()), StructField("day_idx", IntegerType()),
    StructField("features", ArrayType(DoubleType()))])
VECTOR_STORE = StructType([                                                    # D5
    StructField("note_id", StringType()), StructField("vec", ArrayType(FloatType()))])
NOTE_LABELS = StructType([                                                     # D6
    StructField("note_id", StringType()), StructField("subject", StringType()),
    StructField("hadm", StringType()), StructField("note_seq", LongType())])
STATS = StructType([                                                           # D7 / D13
    StructField("mean", ArrayType(DoubleType())), StructField("std", ArrayType(DoubleType())),
    StructField("n", LongType())])
PREDICTIONS = StructType([                                                     # D11 (long form)
    StructField("model_id", StringType()), StructField("id", StringType()),
    StructField("score", DoubleType())])
MASK = ArrayType(BooleanType())                                                # D9
