"""From the stages' tables to a searchable index: entities, shot rows, frames, and the order of shots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions import text as T

from . import entities, intervals

#: Codes of the languages that the recogniser of on-screen text knows, each with English beside it.
OCR_CODES = {
    "ar": "ar", "ja": "ja", "ko": "ko", "zh": "ch_sim", "fr": "fr", "es": "es", "de": "de", "it": "it", "pt": "pt", "ru": "ru",
    "tr": "tr", "hi": "hi", "fa": "fa", "ur": "ur", "nl": "nl", "id": "id", "vi": "vi", "th": "th", "pl": "pl", "uk": "uk",
}
NO_SPEECH, LOW_PROBABILITY, TOP_EMOTIONS = 0.6, -1.0, 3


def clean_entities(spans: DataFrame, texts: DataFrame, key: str, least: float = 0.60) -> DataFrame:
    """key, pos and entity: spans (key, start, end, score) that touch are one; of those that score enough, the text they
    cover, if a name is left of it. texts: key, text. Spans without a start are left out."""
    merged = intervals.merge_spans(spans.filter("start IS NOT NULL").select(key, "start", "end", F.col("score").cast("double").alias("score")), key)
    named = merged.filter(F.col("score") >= least).join(texts.select(key, "text"), key)
    named = named.withColumn("entity", T.entity_form(F.col("text"), F.col("start"), F.col("end"))).filter("entity IS NOT NULL")
    order = Window.partitionBy(key).orderBy("start")
    return named.select(key, (F.row_number().over(order) - 1).cast("int").alias("pos"), "entity")


def spoken(segments: DataFrame) -> DataFrame:
    """Segments without what a recogniser makes up over silence, and without blank ones."""
    made_up = (F.col("no_speech_prob") > NO_SPEECH) & (F.col("avg_logprob") < LOW_PROBABILITY)
    return segments.filter(~F.coalesce(made_up, F.lit(False)) & (T.strip(F.coalesce("text", F.lit(""))) != ""))


def top_emotions(found: Column, has_dialogue: Column, least: float = 0.30) -> Column:
    """Labels of the three best (score, label) that score more than the least; none without dialogue."""
    best = F.slice(F.sort_array(found, asc=False), 1, TOP_EMOTIONS)
    return F.when(has_dialogue, F.transform(F.filter(best, lambda x: x["score"] > least), lambda x: x["label"])).otherwise(F.array().cast("array<string>"))


def ocr_codes(lang: Column) -> Column:
    """Codes of the languages to read on-screen text in: the text's own, if known, and English."""
    known = F.create_map(*(F.lit(x) for kv in OCR_CODES.items() for x in kv))
    own = F.element_at(known, F.coalesce(lang, F.lit("")))
    return F.array_compact(F.array(own, F.lit("en")))


def ocr_text(tokens: Column, edges: Column, least_edges: float = 0.02, least: float = 0.40) -> Column:
    """What was read off a frame: distinct tokens (text, conf) of two characters and enough confidence, in order; "" for a
    frame with hardly any edges, or none at all."""
    kept = F.filter(F.transform(F.filter(tokens, lambda t: t["conf"] >= least), lambda t: T.strip(t["text"])), lambda t: F.length(t) >= 2)
    return F.when(edges >= least_edges, F.coalesce(F.array_join(F.array_distinct(kept), " "), F.lit(""))).otherwise("")


def keyframes(frames: DataFrame) -> DataFrame:
    """content_id, shot_id and frame: the sharpest frame of each shot, the first of equals; unread ones (null) never win."""
    best = F.max(F.struct("sharpness", (-F.col("frame")).alias("f")))
    return frames.filter("sharpness IS NOT NULL").groupBy("content_id", "shot_id").agg(best.alias("b")).select("content_id", "shot_id", (-F.col("b.f")).alias("frame"))


def sharpness(pixels: Column) -> Column:
    """The variance of the Laplacian of a grey frame (rows of pixels), mirrored at its edges; null for an empty one."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frames in batches:
            out = []
            for frame in frames:
                grey = None if frame is None or len(frame) == 0 else np.array([np.asarray(r, np.float64) for r in frame])
                if grey is None or grey.size == 0:
                    out.append(None)
                    continue
                around = np.pad(grey, [(1, 1) if n > 1 else (0, 0) for n in grey.shape], mode="reflect")
                around = np.pad(around, [(0, 0) if n > 1 else (1, 1) for n in grey.shape], mode="edge")
                out.append(float((around[:-2, 1:-1] + around[2:, 1:-1] + around[1:-1, :-2] + around[1:-1, 2:] - 4 * grey).var()))
            yield pd.Series(out, dtype="float64")

    return run(pixels)


def edge_fraction(pixels: Column, low: float = 100.0, high: float = 200.0) -> Column:
    """The share of a grey frame's pixels that are edges: ridges of the gradient (3 x 3 Sobel, |x| + |y|) above `low` that are
    joined, over all eight neighbours, to one above `high`; 0 for an empty frame, null for none."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frames in batches:
            out = [None if f is None else 0.0 if len(f) == 0 or len(f[0]) == 0 else float(edges(np.array([np.asarray(r, np.float64) for r in f]), low, high).mean()) for f in frames]
            yield pd.Series(out, dtype="float64")

    return run(pixels)


def edges(grey: np.ndarray, low: float, high: float) -> np.ndarray:
    """Which pixels are edges."""
    p = np.pad(grey, 1, mode="edge")
    smooth = lambda a, b, c: a + 2 * b + c
    dx = smooth(p[:-2, 2:], p[1:-1, 2:], p[2:, 2:]) - smooth(p[:-2, :-2], p[1:-1, :-2], p[2:, :-2])
    dy = smooth(p[2:, :-2], p[2:, 1:-1], p[2:, 2:]) - smooth(p[:-2, :-2], p[:-2, 1:-1], p[:-2, 2:])
    steep = np.pad(np.abs(dx) + np.abs(dy), 1)
    at = lambda y, x: steep[1 + y : steep.shape[0] - 1 + y, 1 + x : steep.shape[1] - 1 + x]
    here, ratio = at(0, 0), np.tan(np.pi / 8)
    flat, upright = np.abs(dy) < ratio * np.abs(dx), np.abs(dy) * ratio > np.abs(dx)
    same = dx * dy >= 0  # the gradient runs along this diagonal, or the other
    across = np.where(same, (here > at(-1, -1)) & (here > at(1, 1)), (here > at(-1, 1)) & (here > at(1, -1)))
    ridge = (here > low) & np.where(flat, (here > at(0, -1)) & (here >= at(0, 1)), np.where(upright, (here > at(-1, 0)) & (here >= at(1, 0)), across))
    found = ridge & (here > high)
    while True:  # grow along ridges
        q = np.pad(found, 1)
        grown = ridge & np.any([q[1 + y : q.shape[0] - 1 + y, 1 + x : q.shape[1] - 1 + x] for y in (-1, 0, 1) for x in (-1, 0, 1)], axis=0)
        if (grown == found).all():
            return found
        found = grown


def shot_rows(shots: DataFrame, contents: DataFrame, segments: DataFrame, segment_entities: DataFrame, ocr_entities: DataFrame, pad: float = 3.0, least_words: int = 3) -> DataFrame:
    """content_id, shot_id, transcript, dialogue_en, dialogue_src, has_dialogue and entities of each shot.

    shots: content_id, shot_id, start_time, end_time; contents: content_id, language; segments: content_id, track (en or
    src), seg_id, start, end, text, words; entities: content_id, seg_id or shot_id, pos, entity. The transcript is what is
    said within a shot, dialogue what is said within `pad` seconds of it. Entities are shown in their content's most
    frequent casing: those of segments that touch the wider window, then those read off the frame.
    """
    exact = shots.select("content_id", "shot_id", F.col("start_time").alias("t0"), F.col("end_time").alias("t1"))
    wide = exact.withColumns({"t0": F.col("t0") - pad, "t1": F.col("t1") + pad})
    english, source = (segments.filter(F.col("track") == t).drop("track") for t in ("en", "src"))
    said = lambda spans, of, name: intervals.text_in_window(spans, of, "content_id", ("shot_id",)).withColumnRenamed("said", name)
    texts = said(exact, source, "transcript").join(said(wide, english, "dialogue_en"), ["content_id", "shot_id"]).join(said(wide, source, "wide_src"), ["content_id", "shot_id"])
    place = lambda base, n: (F.lit(base).cast("long") + F.shiftleft(F.col(n).cast("long"), 20) + F.col("pos")).alias("place")
    of_segments = segment_entities.select("content_id", "seg_id", place(0, "seg_id"), "entity")
    of_frames = ocr_entities.select("content_id", "shot_id", place(1 << 52, "shot_id"), "entity")
    forms = of_segments.drop("seg_id").unionByName(of_frames.drop("shot_id")).select("content_id", F.col("place").alias("pos"), F.col("entity").alias("form"))
    shown = entities.vocabulary(forms).select("content_id", "key", "form")
    met = intervals.overlap(wide, english.select("content_id", "seg_id", "start", "end"), "content_id", closed=True).select("content_id", "shot_id", "seg_id")
    named = met.join(of_segments, ["content_id", "seg_id"]).select("content_id", "shot_id", "place", "entity").unionByName(of_frames)
    named = named.withColumn("key", F.lower("entity")).join(shown, ["content_id", "key"])
    listed = named.groupBy("content_id", "shot_id").agg(F.array_sort(F.collect_list(F.struct("place", "form"))).alias("e"))
    listed = listed.select("content_id", "shot_id", F.array_distinct(F.transform("e", lambda x: x["form"])).alias("entities"))
    out = texts.join(contents.select("content_id", "language"), "content_id", "left").join(listed, ["content_id", "shot_id"], "left")
    return out.select(
        "content_id", "shot_id", "transcript", "dialogue_en",
        F.when(F.col("language") == "en", F.col("dialogue_en")).otherwise(F.col("wide_src")).alias("dialogue_src"),
        (T.word_count(F.col("dialogue_en")) >= least_words).alias("has_dialogue"),
        F.coalesce("entities", F.array().cast("array<string>")).alias("entities"),
    )


def assembled(shots: DataFrame, *stages: DataFrame) -> DataFrame:
    """Shots with the columns of each stage; every stage has one row for each shot, by content_id and shot_id."""
    for stage in stages:
        shots = shots.join(stage, ["content_id", "shot_id"])
    return shots


def wanted_contents(content_ids: str | None, ready: DataFrame) -> DataFrame:
    """place and content_id of the ready contents of a comma-separated list, in its order, each as often as it is named;
    of all, by id, where the list is empty or null. Blank elements and unknown or malformed ids are left out."""
    valid = ready.filter(T.valid_content_id(F.col("content_id"))).select("content_id")
    if not content_ids:
        return valid.select(F.row_number().over(Window.orderBy("content_id")).cast("long").alias("place"), "content_id")  # a row per content
    named = ready.sparkSession.createDataFrame([(i, c) for i, c in enumerate(content_ids.split(",")) if c], "place long, content_id string")
    return named.join(valid, "content_id").select("place", "content_id")


def ordinals(shots: DataFrame, contents: DataFrame) -> DataFrame:
    """Shots with `row`, their place in the order of contents (place, content_id) and shot_id, from 0.

    Shots are counted and numbered by content; only the contents' counts come together in one task.
    """
    counts = shots.groupBy("content_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    starts = contents.join(counts, "content_id").select("place", "content_id", F.coalesce(before, F.lit(0)).alias("begin"))
    order = Window.partitionBy("place").orderBy("shot_id")
    return shots.join(starts, "content_id").withColumn("row", F.col("begin") + F.row_number().over(order) - 1).drop("begin", "place")


def layers(found: DataFrame, playhead: Column) -> DataFrame:
    """Where found shots go in a composition: a layer that starts so that the shot's first frame is at the playhead."""
    length = F.col("end_s") - F.col("start_s")
    placed = found.filter("end_s > start_s")
    return placed.withColumns({"layer_start": playhead - F.col("start_s"), "layer_in": playhead, "layer_out": playhead + length})


def canonical(names: Column, shown: Column) -> Column:
    """Names in the vocabulary's casing (a map from lower case), or as they are."""
    return F.transform(names, lambda e: F.coalesce(F.element_at(shown, e), e))


def cards(results: DataFrame) -> DataFrame:
    """The text of a result's card: its caption, or else its transcript, and its length in seconds."""
    return results.withColumns({"card": F.coalesce(T.unless_empty(F.col("caption")), T.unless_empty(F.col("transcript")), F.lit("")), "seconds": F.format_string("%.1f", F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s")))})


def summaries(shots: DataFrame, least_words: int = 3) -> DataFrame:
    """content_id and how many of its shots have dialogue, entities, dialogue vectors, and text read off their frames."""
    return shots.groupBy("content_id").agg(
        F.count_if(T.word_count(F.col("dialogue_en")) >= least_words).alias("with_dialogue"), F.count_if(F.size("entities") > 0).alias("with_entities"),
        F.count_if("d_mask").alias("masked"), F.count_if(F.coalesce(T.unless_empty(T.strip(F.col("ocr_text"))).isNotNull(), F.lit(False))).alias("with_ocr"),
    )


def also_failed(registry: DataFrame) -> DataFrame:
    """footage_key and others: of each failed footage, how many others failed too."""
    failed = registry.filter("state = 'error'").select("footage_key")
    return failed.join(F.broadcast(failed.agg((F.count("*") - 1).alias("others"))), how="cross")  # one row


def footage_list(registry: DataFrame) -> DataFrame:
    """What a client sees of the registry, with defaults for what an entry lacks."""
    value = lambda c, default: (F.coalesce(F.col(c), F.lit(default)) if c in registry.columns else F.lit(default)).alias(c)
    missing = F.col("indexed_at") if "indexed_at" in registry.columns else F.lit(None).cast("string").alias("indexed_at")
    return registry.select("footage_key", value("path", ""), value("content_id", ""), value("shot_count", 0), value("duration_s", 0.0), missing, value("state", "indexing"), value("reused", False))


def project_snapshot(listed: DataFrame) -> DataFrame:
    """A project's footage as it is listed, with the defaults of what could not be read."""
    return listed.select("path", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("mtime_ns", F.lit(0)).cast("long").alias("mtime_ns"), F.col("item_id").cast("long").alias("item_id"), F.coalesce("frame_rate", F.lit(25.0)).cast("double").alias("frame_rate"))
