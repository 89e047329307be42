"""Schemas of the data model, and its closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed vocabularies.
JOB_STATES = ("queued", "running", "done", "error")
LIBRARY_STATES = ("missing", "partial", "uploaded", "indexing", "ready", "stale", "error")
FOOTAGE_STATES = ("uploading", "indexing", "ready", "stale", "error")
STAGE_STATES = ("pending", "running", "done", "error")
STAGES = ("shots", "visual", "transcribe", "ocr", "captions", "text", "index")

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "vector": T.ArrayType(T.FloatType())}


def _struct(text: str) -> T.StructType:
    """A schema from "name kind" pairs; needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in text.split(","))])


CONTENTS = _struct("content_id string, signature string, config string, fps double, duration double, language string, n_shots int, built_at string, build string, n_tokens long")
SHOTS = _struct(
    "content_id string, shot_id int, scene_id int, start_time double, end_time double, transcript string, dialogue_en string, dialogue_src string, has_dialogue boolean, "
    "entities strings, emotions strings, ocr_text string, caption string, caption_conf double, v vector, d vector, d_mask boolean, c vector"
)
SEGMENTS = _struct("content_id string, lang string, seg_id int, start double, end double, text string").add("words", T.ArrayType(_struct("word string, start double, end double")))
REGISTRY = _struct(
    "footage_key string, path string, content_id string, size long, mtime_ns long, item_id long, frame_rate double, format_version int, state string, shot_count int, duration_s double, "
    "pending_size long, pending_mtime_ns long, pending_hits int"
)
SNAPSHOT = _struct("path string, size long, mtime_ns long, item_id long, frame_rate double")
JOBS = _struct("job_id string, content_id string, state string").add("stages", T.ArrayType(_struct("name string, state string, done long, total long"))).add("error", "string").add("created_at", "double")


#: What is stored of a content beside its shots: its blocks, its terms, and the statistics of its vectors.
BLOCKS = T.StructType([T.StructField(c, T.BinaryType()) for c in ("rest", "v", "d", "c")])
TERMS = _struct("term string, df long")
STATISTICS = _struct("kind string, part long").add("sums", T.BinaryType())
