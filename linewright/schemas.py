"""Explicit schemas; nothing is inferred from data."""

from pyspark.sql import types as T

LOG_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("raw_text", T.StringType(), False),
        T.StructField("normalized_text", T.StringType()),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("line_number", T.LongType(), False),
    ]
)

EVAL_RECORD = T.StructType(
    [
        T.StructField("index", T.LongType(), False),
        T.StructField("raw_text", T.StringType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("expected_template", T.StringType()),
        T.StructField("expected_group_id", T.StringType()),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("index", T.LongType(), False),
        T.StructField("predicted_group_id", T.StringType(), False),
        T.StructField("predicted_template", T.StringType(), False),
    ]
)


def _label_file(*keys: T.StructField) -> T.StructType:
    record = T.StructType(
        [
            *keys,
            T.StructField("expected_group_id", T.StringType()),
            T.StructField("expected_template", T.StringType()),
        ]
    )
    return T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("records", T.ArrayType(record))]
    )


# Line ids are read as text because label files may quote them; they are cast afterwards.
LABEL_FILE = _label_file(T.StructField("line_index", T.StringType()))
MANIFEST_FILE = _label_file(
    T.StructField("file", T.StringType()), T.StructField("line_number", T.StringType())
)
