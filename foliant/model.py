"""Schemas of the library's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def _schema(fields: str) -> T.StructType:
    """A flat schema; unlike Spark's own parser it needs no session, so executors may import it."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


LINE = "struct<line_no:int,line:string>"
TABLE_BLOCK = "struct<start_line:int,end_line:int,markdown:string,kind:string>"
IMAGE_BLOCK = "struct<alt:string,src:string,line_no:int,raw:string>"
CAPTION = "struct<line_index:int,text:string,position:string>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
MESSAGE_PART = "struct<type:string,text:string,image:string>"
MESSAGE = f"struct<role:string,content:array<{MESSAGE_PART}>>"
QUALITY_CHECK = "struct<score:int,need_rerun:boolean,ocr_quality:string,table_accuracy:string,page_images:boolean,raw:string>"

FILE = _schema("path string, modificationTime timestamp, length long, content binary")
PAGE = _schema("path string, page_no int, body string, failed boolean")

JOB = _schema(
    "job_id string, owner_username string, role_snapshot string, original_filename string, status string, input_file string, "
    "output_file string, error_message string, cancel_requested int, attempt_count int, created_at string, started_at string, "
    "finished_at string, progress_percent int, progress_note string, progress_pages_done int, progress_pages_total int, "
    "result_extra string, current_file_name string, is_directory int, input_root string, output_root string, total_files int, "
    "processed_files int, succeeded_files int, failed_files int"
)
USER = _schema("id long, username string, password_hash string, role string, created_at timestamp")
#: What happened to a job: every change of state is a row, and nothing is ever updated in place.
JOB_EVENT = _schema(
    "job_id string, seq long, at string, action string, owner_username string, original_filename string, error_message string, "
    "progress_percent int, progress_note string, progress_pages_done int, progress_pages_total int, result_extra string"
)
