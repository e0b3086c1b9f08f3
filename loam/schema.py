"""The one fact row, and its forms on disk."""

from pyspark.sql import types as T

#: ``seq`` gives the order of rows, which has meaning: first wins.
ENTRY = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("app_name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ts", T.TimestampType()),
])
#: JSON lines; the timestamp counts seconds since 2001-01-01 UTC.
WIRE = "appName string, text string, timestamp double"
STATUS = "file_name string, import_date timestamp, jsonl_file_name string, last_modified timestamp"
NODE = "node_id long, parent_id long, depth int, role string, subrole string, title string, value array<string>, description string, selected_text string"
