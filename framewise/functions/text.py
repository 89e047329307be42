"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no search terms, the ranges of scripts without word spaces, and limits.
STOPWORDS = (
    "a an the and or but of to in on at for with without is are was were be been being it its this that these those "
    "as by from into over under up down out about i you he she we they me him her us them my your his their our what "
    "which who whom when where why how do does did doing have has had not no so than too very can will just then there "
    "here all any some"
).split()
CJK = "[぀-ヿ㐀-䶿一-鿿가-힯]"
NER_MAX_CHARS, FUZZY_MIN_LEN, FUZZY_SHORT_LEN, NGRAM_MAX, UNIGRAM_MIN_LEN, MAX_SENTENCES = 1000, 4, 6, 3, 3, 3
SEARCH_PROMPT = "Represent this sentence for searching relevant passages: "
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def bigrams(token: Column) -> Column:
    """Overlapping pairs of characters; a single character alone."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(token) - 1)), lambda i: F.substring(token, i, F.lit(2)))


def is_term(word: Column) -> Column:
    """Whether a word is a search term: no stop word nor a lone letter."""
    return ~word.isin(*STOPWORDS) & ((F.length(word) > 1) | word.rlike(r"^\p{Nd}$"))


def tokenize(text: Column) -> Column:
    """Search terms: words that are terms, and character pairs of CJK runs."""
    term = lambda t: F.when(t.rlike(CJK), bigrams(t)).when(is_term(t), F.array(t)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words(text), term))


def search_text(dialogue: Column, caption: Column, ocr: Column, entities: Column, emotions: Column, source: Column) -> Column:
    """What a shot is found by: its texts and labels, and the source dialogue where it differs."""
    base = F.concat_ws(" ", dialogue, caption, ocr, F.concat_ws(" ", entities), F.concat_ws(" ", emotions))
    return F.when(source.eqNullSafe(dialogue), base).otherwise(F.concat_ws(" ", base, source))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_caption(text: Column, most: int = MAX_SENTENCES) -> Column:
    """Tags and outer quotes removed, blanks collapsed, the first distinct sentences kept."""
    plain = strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), r"(?U)\s+", " "))
    plain = F.regexp_replace(plain, "^['\" ]+|['\" ]+$", "")
    sentences = F.filter(F.transform(F.split(plain, r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    fresh = lambda out, s: (F.size(out) < most) & ~F.exists(out, lambda o: F.lower(o) == F.lower(s))
    first = F.aggregate(sentences, F.array().cast("array<string>"), lambda out, s: F.when(fresh(out, s), F.concat(out, F.array(s))).otherwise(out))
    return F.concat_ws(" ", first)


def word_count(text: Column) -> Column:
    """Words between blanks of any kind."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def osa_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: edits and swaps of neighbours, by rows of the usual table.

    The state holds the last two rows, so that a swap can look two rows back.
    """
    n = F.length(b)
    start = F.sequence(F.lit(0), n)
    zero = F.struct(F.transform(F.sequence(F.lit(0), n), lambda _: F.lit(1 << 20)).alias("before"), start.alias("last"))

    def row(state: Column, i: Column) -> Column:
        c, p = F.substring(a, i, F.lit(1)), F.substring(a, i - 1, F.lit(1))

        def cell(out: Column, j: Column) -> Column:
            d = F.substring(b, j, F.lit(1))
            cost = F.when(c == d, 0).otherwise(1)
            best = F.least(F.element_at(out, j) + 1, F.element_at(state["last"], j + 1) + 1, F.element_at(state["last"], j) + cost)
            swap = (i > 1) & (j > 1) & (c == F.substring(b, j - 1, F.lit(1))) & (p == d)
            best = F.when(swap, F.least(best, F.get(state["before"], j - 2) + 1)).otherwise(best)
            return F.concat(out, F.array(best))

        columns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.struct(state["last"].alias("before"), F.aggregate(columns, F.array(i), cell).alias("last"))

    rows = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rows, zero, row, lambda s: F.element_at(s["last"], -1))


def fuzzy_limit(term: Column) -> Column:
    """Edits that a misspelt term may have; null for terms too short to be corrected."""
    return F.when(F.length(term) >= FUZZY_MIN_LEN, F.when(F.length(term) <= FUZZY_SHORT_LEN, 1).otherwise(2))


def _run_of(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, n), " ")


def ngrams(tokens: Column, most: int = NGRAM_MAX) -> Column:
    """Runs of `most` words down to one; single stop words and very short ones are left out."""
    parts = []
    for n in range(most, 0, -1):
        at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams = F.transform(at, _run_of(tokens, n))
        if n == 1:
            grams = F.filter(grams, lambda g: ~g.isin(*STOPWORDS) & (F.length(g) >= UNIGRAM_MIN_LEN))
        parts.append(grams)
    return F.concat(*parts)


def entity_form(text: Column, start: Column, end: Column) -> Column:
    """The name that the characters from start up to end spell: blanks collapsed, no marks around it; null if none is left."""
    raw = strip(F.regexp_replace(F.substring(text, start + 1, end - start), r"(?U)\s+", " "))
    name = F.regexp_replace(raw, r"(?U)^[\W_]+|[\W_]+$", "")
    return F.when((F.length(name) >= 2) & name.rlike(r"\p{L}"), name)


def search_prompt(query: Column) -> Column:
    """A query as the text encoder is asked; passages go in as they are."""
    return F.concat(F.lit(SEARCH_PROMPT), query)


def unless_empty(text: Column) -> Column:
    return F.when(text != "", text)


def number(value: Column) -> Column:
    """A number, 0 where there is none."""
    return F.coalesce(value.cast("double"), F.lit(0.0))


def utc_stamp(moment: Column) -> Column:
    """A UTC timestamp as text, to the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ner_input(text: Column) -> Column:
    """The part of a text that a recogniser sees; null where there is nothing to see."""
    clipped = F.substring(F.coalesce(text, F.lit("")), 1, NER_MAX_CHARS)
    return F.when(clipped.rlike(r"(?U)\S"), clipped)


def prompt(text: Column) -> Column:
    return F.concat(F.lit("this is a photo of "), F.lower(strip(text)), F.lit("."))


# formats


def timecode(seconds: Column, fps: Column) -> Column:
    """HH:MM:SS:FF at a whole number of frames a second, one at least."""
    rate = F.greatest(F.lit(1), F.floor(F.when(F.coalesce(fps, F.lit(0.0)) == 0, 25.0).otherwise(fps) + 0.5).cast("long"))
    total = F.greatest(F.lit(0), F.floor(seconds * rate + 1e-6).cast("long"))
    s = F.floor(total / rate).cast("long")
    pad = lambda x: F.when(F.length(x.cast("string")) < 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat_ws(":", pad(F.floor(s / 3600)), pad(F.floor(s / 60) % 60), pad(s % 60), pad(total % rate))


def clock(seconds: Column) -> Column:
    """m:ss of a rounded number of seconds."""
    t = F.greatest(F.lit(0), F.floor(F.coalesce(seconds, F.lit(0.0)) + 0.5).cast("long"))
    return F.concat(F.floor(t / 60).cast("string"), F.lit(":"), F.lpad((t % 60).cast("string"), 2, "0"))


def step_number(name: Column, done: Column, total: Column) -> Column:
    """A stage's progress: empty without a total, else clocks, megabytes or a percentage."""
    mb = lambda x: F.format_string("%.1f", x / F.lit(1048576.0))
    safe = F.when(total == 0, None).otherwise(total)
    return (
        F.when(F.coalesce(total, F.lit(0)) == 0, "")
        .when(name == "transcribe", F.concat(clock(done), F.lit(" / "), clock(total)))
        .when(name == "upload", F.concat(mb(done), F.lit("/"), mb(total), F.lit(" MB")))
        .otherwise(F.concat(F.floor(done / safe * 100 + 0.5).cast("string"), F.lit("%")))
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def clamp(text: Column, most: int = 160) -> Column:
    """At most so many characters, the last of them an ellipsis where text was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def safe_extension(name: Column) -> Column:
    """The lower-case suffix if it is a plain one, else .bin."""
    suffix = F.regexp_extract(F.lower(name), r"(?s)[^.\\/](\.[^.\\/]*)\z", 1)
    return F.when(suffix.rlike(r"\A\.[a-z0-9]{1,8}\z"), suffix).otherwise(".bin")


# identities


def footage_key(path: Column) -> Column:
    return F.substring(F.sha1(path.cast("binary")), 1, 10)


def content_id(content: Column, chunk: int = 4 << 20) -> Column:
    """Sixteen hex digits over the size, the first and (beyond one chunk) the last bytes of a file's content."""
    size = F.length(content)
    head = F.substring(content, F.lit(1), F.lit(chunk))
    tail = F.when(size > chunk, F.substring(content, F.greatest(F.lit(1), size - chunk + 1), F.lit(chunk))).otherwise(F.lit(b""))
    return F.substring(F.sha1(F.concat(size.cast("string").cast("binary"), head, tail)), 1, 16)


def valid_content_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9a-f]{16}\z"), F.lit(False))
