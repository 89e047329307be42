import pytest
from framewise.functions import text as T
from framewise.functions import vectors as V
from pyspark.sql import functions as F


def one(spark, expr, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,tokens", [("Where did the Harbour Lights go?", ["harbour", "lights", "go"]), ("x 3 of 19 q", ["3", "19"]), ("大阪城", ["大阪", "阪城"]), ("犬 and 山", ["犬", "山"]), ("snake_case-word", ["snake_case", "word"]), (None, []), ("", [])])
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize(F.lit(text).cast("string"))) == tokens


def test_search_text(spark):
    args = [F.lit("turn left at the mill"), F.lit("two cyclists"), F.lit("EXIT 4"), F.array(F.lit("Odense")), F.array(F.lit("surprise"))]
    base = ["turn", "left", "mill", "two", "cyclists", "exit", "4", "odense", "surprise"]
    assert one(spark, T.tokenize(T.search_text(*args, F.lit("turn left at the mill")))) == base
    assert one(spark, T.tokenize(T.search_text(*args, F.lit("drej til venstre")))) == [*base, "drej", "til", "venstre"]


def test_clean_caption(spark):
    raw = "<p>'Two boats drift by. TWO BOATS DRIFT BY.  Gulls follow! Nobody waves? The tide turns.'</p>"
    assert one(spark, T.clean_caption(F.lit(raw))) == "Two boats drift by. Gulls follow! Nobody waves?"
    assert one(spark, T.clean_caption(F.lit("one line only"))) == "one line only"
    assert one(spark, T.clean_caption(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("start,end,want", [(0, 6, "Odense"), (6, 15, "old-town"), (0, 15, "Odense,old-town"), (15, 21, None), (21, 27, "K9"), (27, 30, None)])
def test_entity_form(spark, start, end, want):
    assert one(spark, T.entity_form(F.lit("Odense,old-town (77)  _K9_  x "), F.lit(start), F.lit(end))) == want


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa_distance(spark):
    words = ["lamp", "lmap", "lampp", "", "harbour", "habrour", "harbourside", "ao", "oa", "oar", "river mouth", "rivermouth"]
    pairs = [(a, b) for a in words for b in words]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.osa_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert {(r.a, r.b): r.d for r in rows} == {(a, b): osa(a, b) for a, b in pairs}


def test_formats(spark):
    assert one(spark, T.timecode(F.lit(7325.2), F.lit(50.0))) == "02:02:05:10"
    assert one(spark, T.timecode(F.lit(-1.0), F.lit(0.0))) == "00:00:00:00"
    assert one(spark, T.clock(F.lit(130.5))) == "2:11"
    assert one(spark, T.base_name(F.lit(r"D:\takes/day two\pier.mov"))) == "pier.mov"
    assert one(spark, T.clamp(F.lit("x" * 200))) == "x" * 159 + "…"
    assert one(spark, T.escape_html(F.lit("a<b & 'c' > \"d\""))) == "a&lt;b &amp; &#39;c&#39; &gt; &quot;d&quot;"
    assert [one(spark, T.safe_extension(F.lit(n))) for n in ("Pier.MOV", "pier", "pier.m ov", ".mov", "pier.old.mkv", "pier.verylongsuffix")] == [".mov", ".bin", ".bin", ".bin", ".mkv", ".bin"]
    assert [one(spark, T.step_number(F.lit(n), F.lit(d), F.lit(t))) for n, d, t in (("visual", 4.0, 0.0), ("visual", 2.0, 3.0), ("transcribe", 95.0, 600.0), ("upload", 2621440.0, 10485760.0))] == ["", "67%", "1:35 / 10:00", "2.5/10.0 MB"]


def test_identities(spark):
    import hashlib

    for size in (10, 1000, 1500, 5000):
        data = bytes(i % 251 for i in range(size))
        want = hashlib.sha1(str(size).encode() + data[:1000] + (data[-1000:] if size > 1000 else b"")).hexdigest()[:16]
        assert one(spark, T.content_id(F.lit(data), 1000)) == want
    assert [one(spark, T.valid_content_id(F.lit(x).cast("string"))) for x in ("0" * 16, "0" * 16 + "\n", "G" * 16, None)] == [True, False, False, False]


@pytest.mark.parametrize("values,mask,want", [([2.25], [1], [0]), ([7.0] * 4, [1] * 4, [0] * 4), ([-1.0, 1, 9], [1, 1, 0], [0, 1 / 3, 0]), ([0.0] * 15 + [16], [1] * 16, [0] * 15 + [1])])
def test_clipped_z(spark, values, mask, want):
    df = spark.createDataFrame([(i, float(v) if m else None) for i, (v, m) in enumerate(zip(values, mask, strict=True))], "i int, x double")
    m = df.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("x").alias("n"))
    got = [r.z for r in df.join(m, how="cross").select("i", V.clipped_z(F.col("x"), F.col("m"), F.col("s"), F.col("n")).alias("z")).orderBy("i").collect()]
    assert got == pytest.approx(want)


def test_stamps_prompts_and_cards(spark):
    assert one(spark, T.utc_stamp(F.lit("2031-05-06 07:08:09.9").cast("timestamp"))) == "2031-05-06T07:08:09Z"
    assert one(spark, T.prompt(F.lit("  Boats At DAWN "))) == "this is a photo of boats at dawn."
    assert [one(spark, T.unless_empty(F.lit(x).cast("string"))) for x in ("", None, "a")] == [None, None, "a"]
    assert [one(spark, T.number(F.lit(x).cast("string"))) for x in ("2.5", None)] == [2.5, 0.0]
