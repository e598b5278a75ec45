"""Schemas and fixed values shared by every part of the package."""

from __future__ import annotations

from pyspark.sql import types as T

LINK = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("source", T.LongType(), False),
        T.StructField("target", T.LongType(), False),
    ]
)

# NULL in a pattern position means "any".
PATTERN = T.StructType(
    [
        T.StructField("pid", T.LongType(), False),
        T.StructField("p_id", T.LongType(), True),
        T.StructField("p_source", T.LongType(), True),
        T.StructField("p_target", T.LongType(), True),
    ]
)

COMMAND = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("id", T.LongType(), False),
        T.StructField("source", T.LongType(), True),
        T.StructField("target", T.LongType(), True),
    ]
)

# One row per command with its fate; "nothing" is zeros in the image columns.
OUTCOME = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("id", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("before_source", T.LongType(), False),
        T.StructField("before_target", T.LongType(), False),
        T.StructField("after_source", T.LongType(), False),
        T.StructField("after_target", T.LongType(), False),
    ]
)

LINK_COLUMNS = ["id", "source", "target"]
PATTERN_COLUMNS = ["p_id", "p_source", "p_target"]
IMAGE_COLUMNS = ["before_source", "before_target", "after_source", "after_target"]
FEED_COLUMNS = ["seq", "id", "op", *IMAGE_COLUMNS]

# Commands. CREATE makes a point link (id, id, id); CREATE_EMPTY makes (id, 0, 0).
CREATE = "create"
CREATE_EMPTY = "create_empty"
UPDATE = "update"
DELETE = "delete"
# A row of a base table that enters a fold ahead of every command.
LOAD = "load"

APPLIED = "applied"
ALREADY_EXISTS = "already_exists"
NOT_EXISTS = "not_exists"
UNKNOWN_OP = "unknown_op"
# Streaming only: a command at or below the last one handled for its id.
LATE = "late"

MIN_LONG = -(2**63)
MAX_LONG = 2**63 - 1
