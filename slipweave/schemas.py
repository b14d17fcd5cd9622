"""Explicit schemas; nothing is ever inferred."""

from pyspark.sql import types as T

TEXT_LINE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("confidence", T.DoubleType()),
])
FRAGMENTS = T.StructType([
    T.StructField("receipt_id", T.LongType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("text", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2", "confidence")],
])
PREPROCESSING = T.StructType([
    T.StructField("original_size", T.ArrayType(T.IntegerType())),
    T.StructField("final_size", T.ArrayType(T.IntegerType())),
    T.StructField("exif_transposed", T.BooleanType()),
    T.StructField("resized", T.BooleanType()),
    T.StructField("upscaled", T.BooleanType()),
    T.StructField("contrast_enhanced", T.BooleanType()),
    T.StructField("rotation_applied_degrees", T.IntegerType()),
    T.StructField("notes", T.ArrayType(T.StringType())),
])
RAW = T.StructType([
    T.StructField("source_image", T.StringType()),
    T.StructField("preprocessing", PREPROCESSING),
    T.StructField("text_lines", T.ArrayType(TEXT_LINE)),
])
MANIFEST = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("output_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("num_lines", T.IntegerType()),
    T.StructField("avg_confidence", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("duration_s", T.DoubleType()),
    # Order columns of our own: the run, and the place in it.
    T.StructField("run", T.LongType()),
    T.StructField("place", T.LongType()),
])
RESULT = T.StructType([
    T.StructField("output_id", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("num_lines", T.IntegerType()),
    T.StructField("avg_confidence", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("output_paths", T.MapType(T.StringType(), T.StringType())),
])
DETECTIONS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("output_id", T.StringType()),
    T.StructField("chunk", T.LongType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("preprocessing", PREPROCESSING),
    T.StructField("text_lines", T.ArrayType(TEXT_LINE)),
    T.StructField("error", T.StringType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("peak_memory", T.LongType()),
])
DATASET = T.StructType([T.StructField("input", T.StringType())])
LISTING = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("folder", T.BooleanType()),
])
BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
