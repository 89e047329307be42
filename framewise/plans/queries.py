"""One query per operator, over the tables that the adapters derive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.config import Settings
from framewise.functions import text as T
from framewise.functions import vectors as V
from framewise.operators import blockmax, build, captions, clusters, cuts, entities, fusion, intervals, jobs, lexical, nearest, sync
from framewise.operators.corpus import Corpus
from framewise.sources import adapters as A
from framewise.sources import files

#: Rows whose vectors are the visual and the text query, the item whose text is asked, and the vectors' size.
VISUAL_ROW, TEXT_ROW, ITEM, SIZE = 7, 11, 0, 64
TYPOS = ("anvli", "widgte", "glzmo", "boltt", "plaet", "smalll", "zz", "xxxxxx", "ring", "hott", "gera", "widdgett", "gizzmoo", "annvill", "pllatee", "wigdtee", "wxdgexy")


def _vector(spark: SparkSession, sf_dir: str, row: int):
    found = A.vectors(spark, sf_dir).filter(F.col("row") == row).first()
    return V.literal(found.v)


def _item_tokens(spark: SparkSession, sf_dir: str) -> list[str]:
    item = A.table(spark, sf_dir, "benchmark").filter(F.col("item_id") == ITEM).select(T.tokenize(F.col("text")).alias("t"))
    return item.first().t


def _term(shots: DataFrame) -> list[str]:
    """The first entity of the first shot that has one."""
    found = shots.filter(F.size("entities") > 0).orderBy("row").select(F.lower(F.col("entities")[0]).alias("e")).first()
    return [found.e] if found else []


def _r(c: str):
    return F.round(F.col(c), 6).alias(c)


def fn1_tokenize(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def fn2_bm25_doc(spark, d):
    docs = A.table(spark, d, "documents")
    none = F.array().cast("array<string>")
    doc = T.search_text(F.col("text"), F.col("lang"), F.col("source"), F.array("lang", "source"), none, F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("other source"))
    return docs.select("doc_id", F.array_join(T.tokenize(doc), " ").alias("tokens"))


def fn5_clean_caption(spark, d):
    raw = F.concat(F.lit("<s>"), "text", F.lit(" </s>"))
    return A.table(spark, d, "documents").select("doc_id", T.clean_caption(raw).alias("caption"))


def fn6_l2norm(spark, d):
    scaled = A.vectors(spark, d).select("row", V.l2norm(F.transform("v", lambda x: x * 3)).alias("u"))
    return scaled.select("row", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


def fn8_zscore(spark, d, masked: bool = False):
    q = _vector(spark, d, VISUAL_ROW)
    shots = A.plain_shots(spark, d).select("row", V.dot(F.col("v"), q).alias("x"), "d_mask")
    if masked:
        shots = shots.withColumn("x", F.when(F.col("d_mask"), F.col("x")))
    m = shots.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))
    z = V.clipped_z(F.col("x"), F.col("mean"), F.col("sd"), F.col("n"))
    return shots.join(F.broadcast(m), how="cross").select("row", F.round(z, 6).alias("z"))


def fn8_zscore_masked(spark, d):
    return fn8_zscore(spark, d, True)


def fn11_content_id(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.content_id(F.col("text").cast("binary")).alias("content_id"))


def fn12_footage_key(spark, d):
    return A.registry(spark, d).select("footage_key", "path")


def fn14_safe_extension(spark, d):
    name = F.concat("p_name", F.lit("."), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, "MP4").otherwise(""))
    return A.table(spark, d, "part").select("p_partkey", T.safe_extension(name).alias("ext"))


def fn16_timecode(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 3.0).cast("double").alias("s"), F.when(F.col("l_linenumber") == 1, 0.0).otherwise(23.0 + F.col("l_linenumber")).alias("fps"))
    return li.select("l_orderkey", "l_linenumber", T.timecode(F.col("s"), F.col("fps")).alias("tc"), T.clock(F.col("s")).alias("clock"))


def fn18_step_number(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(F.lit("transcribe"), F.lit("upload"), F.lit("ocr")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("name"), (F.col("o_orderkey") % 900).cast("double").alias("done"), F.when(F.col("o_orderkey") % 4 == 0, 0.0).otherwise(1000.0).alias("total"))
    mb = F.when(F.col("name") == "upload", 1048576.0).otherwise(1.0)
    return o.select("o_orderkey", T.step_number(F.col("name"), F.col("done") * mb, F.col("total") * mb).alias("step"))


def fn19_names(spark, d):
    p = A.table(spark, d, "part")
    return p.select("p_partkey", T.base_name(F.concat(F.lit(r"C:\x/"), F.col("p_name"))).alias("base"), T.clamp(F.col("p_name"), 20).alias("short"), T.escape_html(F.concat(F.lit("<'"), F.col("p_name"), F.lit('&">'))).alias("html"))


def win7_bigrams(spark, d):
    return A.table(spark, d, "part").select("p_partkey", F.array_join(T.bigrams(F.element_at(F.split("p_name", " "), 1)), "|").alias("pairs"))


def agg2_moments(spark, d):
    q = _vector(spark, d, VISUAL_ROW)
    x = A.vectors(spark, d).select(V.dot(F.col("v"), q).alias("x"))
    return x.agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"))


def agg4_bm25_stats(spark, d):
    docs = _texts(spark, d)
    post = lexical.postings_of_text(docs)
    return lexical.inverse_frequencies(post, lexical.statistics_of_postings(docs, post)).select("term", "df", _r("idf"))


def _texts(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("row"), "text")


def _bm25(spark, d):
    docs = _texts(spark, d)
    post = lexical.postings_of_text(docs).persist()  # an index: read for the frequencies of all terms, then for those asked
    stats = lexical.statistics_of_postings(docs, post)
    return lexical.scores(post, stats, lexical.inverse_frequencies(post, stats), _item_terms(spark, d))


def _item_terms(spark, d):
    return A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokenize(F.concat_ws(" ", "text", F.substring("text", 1, 20)))).alias("term"))


def j6_bm25(spark, d):
    return _bm25(spark, d).select("query_id", "row", _r("bm25"))


def agg7_bm25_norm(spark, d):
    return lexical.normalised(_bm25(spark, d).persist()).select("query_id", "row", _r("bm25"))


def agg5_vector_sum(spark, d):
    frames = A.vectors(spark, d).withColumn("shot", F.floor(F.col("row") / 3).cast("long"))
    summed = frames.groupBy("shot").agg(V.l2norm(V.sum_vector("v", SIZE)).alias("u"))
    return summed.select("shot", *(F.round(F.col("u")[i], 6).alias(f"u{i}") for i in (0, 1, 63)))


def agg6_centroid(spark, d):
    shots = A.plain_shots(spark, d)
    scored = shots.join(entities.scores(shots, _term(shots)), "row")
    return fusion.centroid(scored, SIZE).select(*(F.round(F.col("center")[i], 6).alias(f"u{i}") for i in (0, 1, 63)))


def agg16_summaries(spark, d):
    return build.summaries(A.text_shots(spark, d).withColumn("ocr_text", F.when(F.col("row") % 3 != 0, F.col("ocr_text")).otherwise(" ")))


def agg16_also_failed(spark, d):
    return build.also_failed(A.registry(spark, d))


def _asked_vectors(spark, d):
    return A.vectors(spark, d).filter(F.col("row") % 50 == 0).select(F.col("row").alias("query_id"), F.col("v").alias("q"))


def j12_knn(spark, d):
    return nearest.of_each(A.vectors(spark, d), _asked_vectors(spark, d), 10).select("query_id", "row", _r("cosine"))


def j12_knn_masked(spark, d):
    shots = A.plain_shots(spark, d).filter("d_mask").select("row", F.col("d").alias("v"))
    return nearest.of_each(shots, _asked_vectors(spark, d), 10).select("query_id", "row", _r("cosine"))


def j7_entity_score(spark, d):
    shots = A.text_shots(spark, d)
    return entities.scores(shots, [*_term(shots), "entirely unknown"]).select("row", _r("entity"))


def agg8_vocab(spark, d):
    docs = A.text_shots(spark, d).select("content_id", "row", F.posexplode("entities").alias("i", "e"))
    forms = docs.select("content_id", (F.shiftleft(F.col("row").cast("long"), 31) + F.col("i")).alias("pos"), F.when(F.col("row") % 3 == 0, F.upper("e")).otherwise(F.col("e")).alias("form"))
    return entities.vocabulary(forms)


def agg9_merged_vocab(spark, d):
    vocab = agg8_vocab(spark, d)
    contents = vocab.select("content_id").distinct().withColumn("place", F.substring("content_id", 2, 15).cast("long"))
    return entities.merged(vocab, contents).select("key", "form", F.col("place").cast("long").alias("place"))


def _part_keys(spark, d):
    words = A.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("key")).distinct()
    return words.withColumn("pos", F.row_number().over(Window.orderBy("key")))  # at most a vocabulary of a few dozen words


def j8_fuzzy(spark, d):
    terms = spark.createDataFrame([(t,) for t in TYPOS], "term string")
    return entities.corrected(terms, _part_keys(spark, d)).select("term", "key", F.col("d").cast("long").alias("d"))


def _mistyped(spark, d):
    """Words of the benchmark with two neighbours swapped, the longer ones with a later character missing too."""
    words = A.table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w")).filter(F.length("w") >= 4).distinct()
    swapped = F.concat(F.substring("w", 1, 1), F.substring("w", 3, 1), F.substring("w", 2, 1), F.expr("substring(w, 4)"))
    shorter = F.concat(F.substring(swapped, 1, 5), F.expr("substring(w, 7)"))
    return words.select(F.explode(F.when(F.length("w") >= 8, F.array(swapped, shorter)).otherwise(F.array(swapped))).alias("term")).distinct()


def j8_fuzzy_words(spark, d):
    """Mistyped words looked up among all words of the documents; of equally near ones the first in order."""
    keys = A.table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("key")).distinct().withColumn("pos", F.col("key"))
    return entities.corrected(_mistyped(spark, d), keys).select("term", "key", F.col("d").cast("long").alias("d"))


def fn4_query_entities(spark, d):
    found = entities.query_entities("Show the widgte anvli and Gizmo", _part_keys(spark, d), lambda ts: [["Gizmo"] if "Gizmo" in t else [] for t in ts])
    return spark.createDataFrame(list(enumerate(found)), "pos int, entity string")


def win6_ngrams(spark, d):
    b = A.table(spark, d, "benchmark")
    return b.select("item_id", F.posexplode(T.ngrams(T.words(F.col("text")))).alias("pos", "gram")).withColumn("pos", F.col("pos").cast("long"))


def _numbers(spark, d, row):
    return A.vectors(spark, d).filter(F.col("row") == row).first().v


def _flat(ranked):
    parts = [_r("score")] + [F.round(F.col(f"w_{c}"), 6).alias(f"w_{c}") for c in fusion.COMPONENTS]
    return ranked.select("row", "content_id", "shot_id", "scene_id", *parts, F.round("visual_raw", 6).alias("raw_visual"), F.round("dialogue_raw", 6).alias("raw_dialogue"), F.round("caption_raw", 6).alias("raw_caption"))


def _asked(spark, d):
    """The corpus of all shots, and the query: tokens, terms, visual and text vector."""
    corpus = Corpus(A.shots(spark, d))
    return corpus, (_item_tokens(spark, d), _term(corpus.shots), _numbers(spark, d, VISUAL_ROW), _numbers(spark, d, TEXT_ROW))


def fused_search(spark, d):
    """The flagship: eight shots for one query, with contributions and raw cosines."""
    corpus, query = _asked(spark, d)
    return _flat(corpus.rank(*query))


def batch_fused_search(spark, d):
    """All six signals for every benchmark item at once: the best three shots of each. An item asks with its text, the vectors of
    its number and the next one, and the first entity of the shot of its number."""
    corpus = Corpus(A.shots(spark, d))
    emb = A.vectors(spark, d)
    items = A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.tokenize(F.col("text")).alias("tokens"))
    items = items.join(emb.select(F.col("row").alias("query_id"), F.col("v").alias("qv")), "query_id").join(emb.select((F.col("row") - 1).alias("query_id"), F.col("v").alias("qt")), "query_id")
    named = corpus.shots.filter(F.size("entities") > 0).select(F.col("row").alias("query_id"), F.array(F.lower(F.col("entities")[0])).alias("keys"))
    queries = items.join(named, "query_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    found = corpus.batch(queries, top_k=3)
    return found.select("query_id", "place", "row", _r("score"), *(F.round(F.col(f"w_{c}"), 6).alias(f"w_{c}") for c in fusion.COMPONENTS))


def fused_search_candidates(spark, d):
    corpus, query = _asked(spark, d)
    return _flat(corpus.rank(*query, Settings(candidates=60), exhaustive=False, top_k=5))


def set1_candidates(spark, d):
    corpus, query = _asked(spark, d)
    return corpus.candidates(*query, 20)


def agg1_key_stats(spark, d):
    """Count, mean and Gram matrix of the visual vectors: their first dimensions."""
    corpus = Corpus(A.shots(spark, d))
    corpus.packed()
    s = corpus.stats["v"]
    rows = [(i, j, int(s.count), round(float(s.mean[i]), 6), round(float(s.gram[i, j]), 6)) for i in range(8) for j in range(8)]
    return spark.createDataFrame(rows, "i int, j int, n long, mean double, gram double")


def srt3_top_scored(spark, d):
    scored = A.table(spark, d, "documents").select(F.col("doc_id").alias("row"), (F.col("n_chars") % 7).cast("double").alias("s"), (F.col("n_chars") % 1000 / 1000.0).alias("t"))
    return fusion.top_scored(scored, "s", 50, "t").select("row", "s")


def win1_scene_dedupe(spark, d):
    q = _vector(spark, d, VISUAL_ROW)
    scored = A.plain_shots(spark, d).select("row", "content_id", "scene_id", V.dot(F.col("v"), q).alias("score"))
    return fusion.best_per_scene(scored).select("row", "content_id", "scene_id", _r("score"))


def batch_search(spark, d):
    """The lexical signal of many queries at once: the best three rows of each."""
    scored = lexical.normalised(_bm25(spark, d).persist())  # read for each query's greatest, then for its rows
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "row")
    return scored.withColumn("place", F.row_number().over(order)).filter("place <= 3").select("query_id", "place", "row", _r("bm25"))


def srt3_block_max(spark, d):
    """The ten best rows of each query by blocks of rows: those whose greatest shares cannot reach the tenth stay closed."""
    return blockmax.best_of_texts(_texts(spark, d), _item_terms(spark, d), 10).select("query_id", "place", "row", _r("bm25"))


def j1_transcript_window(spark, d):
    return intervals.text_in_window(A.grid(spark, d), A.segments(spark, d), "conv_id", ("shot_id",))


def j1_dialogue_window(spark, d):
    return intervals.text_in_window(A.grid(spark, d, 3.0), A.segments(spark, d), "conv_id", ("shot_id",))


def j2_entity_window(spark, d):
    met = intervals.overlap(A.grid(spark, d, 3.0), A.segments(spark, d).select("conv_id", "seg_id", "start", "end"), "conv_id", closed=True)
    return met.groupBy("conv_id", "shot_id").agg(F.count("*").alias("n"), F.min("seg_id").alias("first"), F.max("seg_id").alias("last"))


def win2_span_merge(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10.0).alias("start"), (F.col("l_linenumber") * 10.0 + F.col("l_quantity") / 3.0).cast("double").alias("end"), F.col("l_discount").cast("double").alias("score"))
    return intervals.merge_spans(li, "k").select("k", _r("start"), _r("end"), _r("score"))


def win10_split_spans(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.lit(2.0).alias("start"), (2.0 + F.col("o_totalprice") / 5000.0).cast("double").alias("end"))
    return intervals.split_spans(o).select("o_orderkey", "part", F.round("t0", 8).alias("t0"), F.round("t1", 8).alias("t1"))


def j4_propagate(spark, d):
    return captions.propagate(A.vectors(spark, d), A.representatives(spark, d)).select("row", "rep", _r("confidence"))


def agg12_medoid(spark, d):
    labelled = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("v"), "label")
    return captions.medoids(labelled, SIZE)


def agg11_representatives(spark, d):
    """Representatives of every content: 16 clusters each, of a hundred shots a content; starts are drawn from hashes, so there is no SQL."""
    shots = A.vectors(spark, d).withColumn("content_id", F.concat(F.lit("c"), F.lpad(F.floor(F.col("row") / A.PER_CONTENT).cast("string"), 15, "0")))
    return clusters.representatives(shots, 16)


def j10_sync_diff(spark, d):
    return sync.diff(A.snapshot(spark, d), A.registry(spark, d))


def j11_apply_sync(spark, d):
    snap, reg = A.snapshot(spark, d), A.registry(spark, d)
    return sync.apply(snap, sync.diff(snap, reg), reg)


def flt11_wanted_owners(spark, d):
    registry = A.registry(spark, d)
    return sync.owners(registry, registry.filter("item_id % 2 = 0").select("footage_key")).select("content_id", "footage_key")


def flt13_prune(spark, d):
    return sync.pruned(A.registry(spark, d)).select("footage_key", "state")


def set3_removed(spark, d):
    return sync.diff(A.snapshot(spark, d), A.registry(spark, d)).filter("bucket = 'removed'").select("footage_key")


def j9_owner(spark, d):
    return sync.owners(A.registry(spark, d))


def prj3_owned_results(spark, d):
    hits = A.text_shots(spark, d).select("row", F.concat(F.lit("c"), F.lpad((F.col("row") % 60).cast("string"), 15, "0")).alias("content_id"))
    return sync.owned(hits, A.registry(spark, d))


def win5_debounce(spark, d):
    return sync.debounced(A.observations(spark, d)).select("event_id", "footage", "size", "confirmed")


def agg13_quota(spark, d):
    reg = A.registry(spark, d)
    buckets = sync.diff(A.snapshot(spark, d), reg)
    work = buckets.join(reg.select("footage_key", "state", "duration_s", "item_id"), "footage_key", "left")
    work = work.withColumn("tenant", F.coalesce(F.col("item_id"), F.lit(0)) % 97)
    plans = A.table(spark, d, "customer").filter("c_custkey < 97").select(F.col("c_custkey").alias("tenant"), F.element_at(F.create_map(F.lit("BUILDING"), F.lit("pro"), F.lit("MACHINERY"), F.lit("free"), F.lit("FURNITURE"), F.lit("studio")), F.col("c_mktsegment")).alias("plan"))
    return sync.allowed_work(work, plans).select("tenant", "n_active", _r("minutes"), "allowed")


def j16_stranded(spark, d):
    busy = A.jobs(spark, d).filter("state = 'running'").select(T.footage_key(F.concat(F.lit("/footage/Customer#"), F.lpad(F.col("content_id").cast("string"), 9, "0"))).alias("footage_key"))
    return sync.stranded(A.registry(spark, d).select("footage_key", "state"), busy)


def win3_latest_job(spark, d):
    return jobs.latest(A.jobs(spark, d))


def win3_live_job(spark, d):
    return jobs.latest(A.jobs(spark, d), live=True)


def st4_upload(spark, d):
    return jobs.received(A.chunks(spark, d))


def st9_recover(spark, d):
    stages = F.array(*(F.struct(F.lit(n).alias("name"), F.when(F.col("created_at") % 4 > i, "done").when(F.col("created_at") % 4 == i, "running").otherwise("pending").alias("state"), (F.col("created_at") + i).cast("long").alias("done"), F.lit(100).cast("long").alias("total")) for i, n in enumerate(("shots", "visual", "ocr"))))
    out = jobs.recover(A.jobs(spark, d).withColumn("stages", stages))
    return out.select("job_id", "state", F.array_join(F.transform("stages", lambda s: F.concat_ws(":", s["name"], s["state"], s["done"].cast("string"))), ",").alias("stages"))


def st10_library_state(spark, d):
    job = jobs.latest(A.jobs(spark, d)).select("content_id", "state")
    live = jobs.latest(A.jobs(spark, d), live=True).select("content_id", F.lit(True).alias("live"))
    up = jobs.received(A.chunks(spark, d)).select("content_id", "received", "complete")
    k = F.col("content_id")
    rows = A.table(spark, d, "customer").select((F.col("c_custkey") - 1).cast("long").alias("content_id"))
    joined = rows.join(job, "content_id", "left").join(live, "content_id", "left").join(up, "content_id", "left")
    index = F.when(k % 6 == 0, "ready").when(k % 6 == 1, "stale")
    state = jobs.library_state(F.col("live") & (k % 2 == 0), index, F.col("state") == "error", F.col("complete"), F.col("received"))
    return joined.select("content_id", state.alias("library_state"))


def srt7_step_order(spark, d):
    li = A.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    name = F.element_at(F.array(*map(F.lit, ("shots", "visual", "transcribe", "ocr", "captions", "text", "extra"))), F.col("l_linenumber"))
    state = F.element_at(F.array(*map(F.lit, ("pending", "running", "done", "error"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    declared = F.when(F.col("l_linenumber") < 7, F.col("l_linenumber").cast("int"))
    stages = li.select(F.col("l_orderkey").alias("job_id"), name.alias("name"), state.alias("state"), F.col("l_linenumber").cast("int").alias("pos"), declared.alias("declared"))
    return jobs.step_order(stages).select("job_id", "name", "state", F.col("place").cast("long").alias("place"))


def st11_screen(spark, d):
    k = F.col("o_orderkey")
    s = jobs.screen(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0, k % 4)
    return A.table(spark, d, "orders").select("o_orderkey", s.alias("screen"))


def flt2_valid_ids(spark, d):
    p = A.text_shots(spark, d).select("row", F.when(F.col("row") % 3 == 0, F.col("content_id")).when(F.col("row") % 3 == 1, F.upper("content_id")).otherwise(F.concat("content_id", F.lit("\n"))).alias("cid"))
    return p.filter(T.valid_content_id(F.col("cid"))).select("row")


def flt4_hallucination(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).cast("double").alias("no_speech_prob"), (-F.col("l_tax") * 20).cast("double").alias("avg_logprob"), F.when(F.col("l_linenumber") == 2, "  ").otherwise("said").alias("text"))
    return build.spoken(li).select("l_orderkey", "l_linenumber")


def flt5_ocr_text(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    k = F.col("doc_id")
    tokens = F.transform(words, lambda w, i: F.struct(w.alias("text"), (((k + i * 7) % 100) / 100.0).alias("conf")))
    docs = A.table(spark, d, "documents").select("doc_id", build.ocr_text(tokens, (k % 50) / 1000.0).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


def flt7_emotions(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.array(*(F.struct(((F.col("o_orderkey") * m) % 100 / 100.0).alias("score"), F.lit(n).alias("label")) for m, n in ((7, "joy"), (13, "fear"), (29, "anger"), (31, "surprise")))).alias("found"))
    return o.select("o_orderkey", F.array_join(build.top_emotions(F.col("found"), F.col("o_orderkey") % 9 != 4, Settings().emotion_min_score), ",").alias("emotions"))


def flt12_ner_input(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.length(T.ner_input(F.col("text"))).cast("long").alias("n"))


def fn3_clean_entities(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    k, i = F.col("doc_id"), F.col("i")
    spans = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    spans = spans.select("doc_id", (i * 9 + k % 4).cast("int").alias("start"), (i * 9 + k % 4 + 6 + (i % 3) * 2).cast("int").alias("end"), ((k * 13 + i * 29) % 100 / 100.0).alias("score"))
    return build.clean_entities(spans, docs, "doc_id")


def fn20_prompt(spark, d):
    return A.table(spark, d, "part").select("p_partkey", T.prompt(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))).alias("prompt"), T.search_prompt(F.col("p_name")).alias("asked"))


def fn23_utc_stamp(spark, d):
    return A.table(spark, d, "events").select("event_id", T.utc_stamp(F.col("ts")).alias("stamp"), T.number(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("value"))


def j17_ocr_codes(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(build.ocr_codes(F.when(F.col("doc_id") % 5 == 0, "zh").otherwise(F.col("lang")))), "+").alias("ocr"))


def agg14_keyframe(spark, d):
    li = A.table(spark, d, "lineitem")
    frames = li.select(F.col("l_orderkey").alias("content_id"), (F.col("l_linenumber") % 2).alias("shot_id"), F.col("l_linenumber").alias("frame"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity").cast("double")).alias("sharpness"))
    return build.keyframes(frames).select("content_id", "shot_id", F.col("frame").cast("long").alias("frame"))


def agg15_sharpness(spark, d):
    pixels = F.array(*(F.array(*(((F.col("o_orderkey") * (4 * i + j + 1)) % 251).cast("int") for j in range(4))) for i in range(4)))
    return A.table(spark, d, "orders").select("o_orderkey", F.round(build.sharpness(pixels), 4).alias("sharpness"))


def agg15_edges(spark, d):
    """The share of edge pixels of small frames, half of them with a bright corner."""
    k = F.col("o_orderkey")
    pixels = F.array(*(F.array(*(F.when((k % 2 == 0) & F.lit(i > 2 and j > 2), 250).otherwise((k * (6 * i + j + 1)) % 97).cast("int") for j in range(6))) for i in range(6)))
    return A.table(spark, d, "orders").select("o_orderkey", F.round(build.edge_fraction(pixels), 6).alias("edges"))


def src1_cut_scenes(spark, d):
    """Scenes of contents of 4,000 frames each: a frame per event, its score the event's value, every tenth one eight times over."""
    e = A.table(spark, d, "events")
    score = F.when(F.col("event_id") % 10 == 3, F.col("value") * 8).otherwise(F.col("value"))
    frames = e.select(F.floor(F.col("event_id") / 4000).alias("content_id"), (F.col("event_id") % 4000).alias("frame"), score.alias("score"))
    return cuts.scenes(frames, chunk=512)


def _stage_tables(spark, d):
    """Shots, contents, both tracks of segments, and entities, from the conversations."""
    shots = A.grid(spark, d).select(F.col("conv_id").alias("content_id"), F.col("shot_id"), F.col("t0").alias("start_time"), F.col("t1").alias("end_time"))
    contents = shots.select("content_id").distinct().withColumn("language", F.when(F.col("content_id") % 2 == 0, "en").otherwise("fr"))
    english = A.segments(spark, d).withColumnRenamed("conv_id", "content_id").withColumn("track", F.lit("en"))
    source = english.withColumns({"track": F.lit("src"), "text": F.concat(F.lit("src "), "text"), "words": F.lit(None).cast(english.schema["words"].dataType)})
    names = english.select("content_id", "seg_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("pos", "entity"))
    named = names.withColumn("entity", F.when(F.col("seg_id") % 3 == 0, F.upper("entity")).otherwise(F.col("entity")))
    frames = shots.filter("shot_id % 2 = 0").select("content_id", "shot_id", F.lit(0).alias("pos"), F.when(F.col("shot_id") % 4 == 0, "Paris").otherwise("PARIS").alias("entity"))
    return shots, contents, english.unionByName(source), named, frames


def prj1_shot_rows(spark, d):
    rows = build.shot_rows(*_stage_tables(spark, d))
    return rows.select("content_id", "shot_id", "transcript", "dialogue_en", "dialogue_src", "has_dialogue", F.array_join("entities", ",").alias("entities"))


def j3_assembled(spark, d):
    shots, contents, segments, named, frames = _stage_tables(spark, d)
    rows = build.shot_rows(shots, contents, segments, named, frames).select("content_id", "shot_id", "has_dialogue")
    read = frames.groupBy("content_id", "shot_id").agg(F.count("*").alias("n"))
    texts = shots.join(read, ["content_id", "shot_id"], "left").select("content_id", "shot_id", F.coalesce("n", F.lit(0)).alias("n_ocr"))
    return build.assembled(shots, rows, texts).select("content_id", "shot_id", "start_time", "end_time", "has_dialogue", "n_ocr")


def prj4_footage(spark, d):
    entries = A.registry(spark, d).select("footage_key", F.when(F.col("item_id") % 4 != 0, F.col("path")).alias("path"), F.when(F.col("item_id") % 5 != 0, F.col("content_id")).alias("content_id"), F.when(F.col("item_id") % 6 != 0, F.col("shot_count")).alias("shot_count"), F.when(F.col("item_id") % 8 != 0, F.col("state")).alias("state"))
    return build.footage_list(entries)


def prj6_status(spark, d):
    stages = F.array(F.struct(F.lit("upload").alias("name"), F.col("state").alias("state"), F.lit(1).cast("long").alias("done"), F.lit(2).cast("long").alias("total")))
    j = A.jobs(spark, d).select("job_id", F.concat(F.lit("k"), "content_id").alias("footage_key"), "state", F.when(F.col("content_id") % 2 == 0, True).alias("reused"), stages.alias("stages"), F.when(F.col("state") == "error", jobs.clipped_error(F.repeat(F.lit("x"), 700))).alias("error"), F.lit(None).cast("string").alias("reason"))
    out = jobs.statuses(j)
    return out.select("job_id", "footage_key", "state", "reused", F.col("stages")[0]["state"].alias("upload"), F.length("error").alias("n_error"))


def prj8_canonical(spark, d):
    shown = F.create_map(F.lit("anvil"), F.lit("Anvil"), F.lit("gizmo"), F.lit("GIZMO"))
    return A.table(spark, d, "part").select("p_partkey", F.array_join(build.canonical(F.split("p_name", " "), shown), " ").alias("shown"))


def prj9_cards(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "a caption").alias("caption"), F.when(F.col("o_orderkey") % 2 == 0, "said").alias("transcript"), F.lit(2.0).alias("start_s"), (F.col("o_custkey") % 9).cast("double").alias("end_s"))
    return build.cards(o).select("o_orderkey", "card", "seconds")


def src6_corpus_order(spark, d):
    shots = A.text_shots(spark, d).select("content_id", "shot_id")
    ready = shots.select("content_id").distinct()
    wanted = ",".join([f"c{n:015d}" for n in (3, 1, 0, 3)] + ["", "nonsense", "d" + "0" * 15])
    return build.ordinals(shots, build.wanted_contents(wanted, ready)).select("content_id", "shot_id", F.col("row").cast("long").alias("ordinal"))


def st2_lifecycle(spark, d):
    """Events of a job per order, as many as a remainder of its key says."""
    k, done = F.col("o_orderkey") % 6, (F.col("o_custkey") % 100).cast("long")
    none = F.lit(None)

    def event(when, seq, kind, stage=none, n=none, total=none):
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), stage.cast("string").alias("stage"), n.cast("long").alias("done"), total.cast("long").alias("total"), F.when(F.lit(kind == "fail"), F.repeat(F.lit("e"), 600)).alias("error")))

    shots, visual, m = F.lit("shots"), F.lit("visual"), F.col("o_orderkey") % 7
    listed = F.array_compact(F.array(
        event(F.lit(True), 1, "submit"), event(k >= 1, 2, "start"), event(k >= 2, 3, "progress", shots, done, F.lit(100)), event(k >= 3, 4, "stage_done", shots),
        event(k >= 3, 5, "progress", visual, F.lit(1), F.lit(3)), event(k == 4, 6, "fail"), event(k == 5, 6, "finish"), event((m == 0) & (k <= 1), 7, "cancel"), event((m == 2) & (k == 3), 8, "restart"),
    ))
    events = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.explode(listed).alias("e")).select("job_id", "e.*")
    out = jobs.lifecycle(events, ("shots", "visual", "ocr"))
    shown = F.array_join(F.transform("stages", lambda s: F.concat_ws(":", s["name"], s["state"], s["done"].cast("string"), s["total"].cast("string"))), ",")
    return out.select("job_id", "state", F.length("error").alias("n_error"), shown.alias("stages"))


def st3_cancel(spark, d):
    j = A.jobs(spark, d)
    return j.select("job_id", jobs.cancelled(F.when(F.col("created_at") % 10 == 0, None).otherwise(F.col("state"))).alias("outcome"))


def st5_handoff(spark, d):
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*map(F.lit, ("ready", "indexing", "partial", "missing", "stale"))), (k % 5 + 1).cast("int"))
    step = jobs.handed_off(state, F.when(k % 2 == 0, F.lit("j")), k % 3 == 0, F.col("o_custkey"))
    return A.table(spark, d, "orders").select("o_orderkey", step.alias("s")).select("o_orderkey", "s.action", "s.offset")


def st6_calls(spark, d):
    code = F.element_at(F.array(*map(F.lit, ("ASLEEP", "TIMEOUT", "UNREACHABLE", "ASLEEP", "TIMEOUT", "TIMEOUT", "OK"))), (F.col("l_partkey") % 7 + 1).cast("int"))
    replies = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", code.alias("c")))), lambda x: x["c"]).alias("r"))
    return replies.select("l_orderkey", jobs.called(F.col("r"), 3).alias("outcome"))


def win4_first_owner(spark, d):
    return sync.owners(A.registry(spark, d)).select("content_id", "footage_key")


def win8_sentences(spark, d):
    text = F.concat("text", F.lit(" "), F.upper("text"))
    return A.table(spark, d, "benchmark").select("item_id", T.clean_caption(text, 2).alias("kept"))


def win9_ordinal(spark, d):
    s = A.text_shots(spark, d).select("row", "content_id", "shot_id").withColumnRenamed("row", "doc")
    contents = build.wanted_contents("", s.select("content_id").distinct())
    return build.ordinals(s, contents).select(F.col("doc").alias("row"), "content_id", "shot_id", F.col("row").cast("long").alias("ordinal"))


def snk9_layers(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).cast("double").alias("start_s"), ((F.col("o_orderkey") % 100) + (F.col("o_custkey") % 9) - 1).cast("double").alias("end_s"))
    return build.layers(o, F.lit(60.0)).select("o_orderkey", "layer_start", "layer_in", "layer_out")


def src7_ready_contents(spark, d):
    s = A.text_shots(spark, d)
    contents = s.groupBy("content_id").agg(F.count("*").alias("n_shots")).withColumn("signature", F.when(F.substring("content_id", 16, 1) == "1", "older").otherwise(Settings().signature()))
    return files.ready(contents, Settings().signature()).select("content_id", "n_shots")


QUERIES = {
    f.__name__: f
    for f in (
        agg1_key_stats, agg16_also_failed, flt11_wanted_owners, fused_search, fused_search_candidates, batch_fused_search, batch_search, srt3_block_max, set1_candidates, srt3_top_scored, win1_scene_dedupe,
        fn1_tokenize, fn2_bm25_doc, fn4_query_entities, fn5_clean_caption, fn6_l2norm, fn8_zscore, fn8_zscore_masked, fn11_content_id,
        fn12_footage_key, fn14_safe_extension, fn16_timecode, fn18_step_number, fn19_names, win6_ngrams, win7_bigrams, win8_sentences,
        agg2_moments, agg4_bm25_stats, agg5_vector_sum, agg6_centroid, agg7_bm25_norm, agg8_vocab, agg9_merged_vocab, agg11_representatives,
        agg12_medoid, agg13_quota, agg16_summaries, j1_transcript_window, j1_dialogue_window, j2_entity_window, j4_propagate, j6_bm25,
        j7_entity_score, j8_fuzzy, j8_fuzzy_words, j9_owner, j10_sync_diff, j11_apply_sync, j12_knn, j12_knn_masked, j16_stranded, j17_ocr_codes,
        prj3_owned_results, set3_removed, flt2_valid_ids, flt4_hallucination, flt7_emotions, flt12_ner_input, flt13_prune,
        win2_span_merge, win3_latest_job, win3_live_job, win4_first_owner, win5_debounce, win9_ordinal, win10_split_spans,
        fn3_clean_entities, fn20_prompt, fn23_utc_stamp, flt5_ocr_text, agg14_keyframe, agg15_sharpness, agg15_edges, src1_cut_scenes, prj1_shot_rows, j3_assembled, prj4_footage,
        prj6_status, prj8_canonical, prj9_cards, src6_corpus_order, st2_lifecycle, st3_cancel, st5_handoff, st6_calls, st4_upload, st9_recover, st10_library_state, st11_screen, srt7_step_order, snk9_layers, src7_ready_contents,
    )
}
