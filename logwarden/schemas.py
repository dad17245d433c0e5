"""The normalized event schema (silver) and the record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and types of the normalized event.
SILVER_FIELDS = {
    "timestamp": "double",
    "source_ip": "string",
    "source_port": "bigint",
    "dest_ip": "string",
    "dest_port": "bigint",
    "protocol": "string",
    "action": "string",
    "status": "string",
    "severity": "string",
    "event_type": "string",
    "user": "string",
    "hostname": "string",
    "process": "string",
    "command": "string",
    "duration": "double",
    "bytes_in": "bigint",
    "bytes_out": "bigint",
    "url": "string",
    "domain": "string",
    "method": "string",
    "status_code": "bigint",
    "user_agent": "string",
    "session_id": "string",
    "source_location": "string",
    "dest_location": "string",
}
# The eight fields of the detection-side schema.
MINI_FIELDS = ["timestamp", "source_ip", "dest_ip", "username", "action", "status", "resource", "severity"]


EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
