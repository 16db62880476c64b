"""Table layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

FRAMES = T.StructType([
    T.StructField("episode_index", T.LongType()),
    T.StructField("frame_index", T.LongType()),
    T.StructField("task_index", T.LongType()),
    T.StructField("action", T.ArrayType(T.DoubleType())),
    T.StructField("state", T.ArrayType(T.DoubleType())),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("index", T.LongType()),
    T.StructField("image", T.BinaryType()),
    T.StructField("image2", T.BinaryType()),
])

BOUNDS = T.StructType([
    T.StructField("dim", T.IntegerType()),
    T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()),
])

METRICS = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("step", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
