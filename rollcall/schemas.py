"""Fixed table schemas shared by operators, sinks and tests."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(text: str) -> T.StructType:
    pairs = (part.split() for part in text.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


ERROR_SCHEMA = _schema(
    "field string, row_num long, raw_value string, problem string, detail string"
)
FINDING_SCHEMA = _schema(
    "path string, row_num long, first_value string, raw_value string, problem string"
)
SPEC_SCHEMA = _schema(
    "spec_id string, name string, attr_code string, category string, type string, sub_type string, "
    "dict_id string, regex string, required boolean, max_length int, ord long"
)
DICT_SCHEMA = _schema("dict_id string, code string, label string, label_key string, ord long")
METRIC_SCHEMA = _schema(
    "stage string, success long, fail long, skip long, message string, ts timestamp"
)
RUN_SCHEMA = _schema(
    "run_id string, event_time timestamp, status string, start_time timestamp, end_time timestamp, "
    "inputs map<string,string>, total_records long, output_records long, error_records long, "
    "duplicate_count long, summary string, output_dir string"
)
STAGE_LOG_SCHEMA = _schema(
    "run_id string, module string, phase string, status string, message string, detail string, "
    "elapsed_ms long, created_at timestamp"
)
JOURNAL_SCHEMA = _schema(
    "run_id string, attempt string, stage string, status string, elapsed_ms long, folder string, facts string, "
    "message string, created_at timestamp"
)
VERSION_SCHEMA = _schema(
    "run_id string, dict_file string, file_name string, md5_hash string, recorded_at timestamp"
)
SETTING_SCHEMA = _schema("key string, value string, description string, updated_at timestamp")
CELL_SCHEMA = _schema("path string, sheet_pos int, sheet string, row_idx long, cells array<string>")
