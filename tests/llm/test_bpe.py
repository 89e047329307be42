import hashlib
import random

import pytest
from framewise.llm import bpe

tokenizers = pytest.importorskip("tokenizers")

PIECES = ["a", "e", "é", "é", "Σ", "ΑΣ", "İ", "ß", " ", "  ", "\n", "\x1c", "\x85", " ", "'", "'s", "'RE", "1", "½", "東京", "<|endoftext|>", "<|startoftext|>", "<|", "🙂", "̀", "ﬁ", "the", "ing", "_", "\x00", "가", "가", "ſ", "K", "supercalifragilistic"]


def _texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(1500)]
    return [*out, "a" * 5000, "!?" * 3000, "the" * 2000, "abc🙂" * 900, "", "x" * 127, "x" * 128, "x" * 129]


def test_equals_the_library():
    library = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    own, texts = bpe.load(bpe.tokenizer_path()), _texts()
    for text, reference, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.entries(texts), strict=True):
        assert [int(x) for ids, _, _ in found for x in ids.split(" ")] == reference.ids, text
        assert " ".join(d for _, d, _ in found) == library.decode(reference.ids, skip_special_tokens=False)


def test_the_scan_equals_the_heap(monkeypatch):
    own = bpe.RankArrayTokenizer.from_file(bpe.tokenizer_path())
    words = ["antidisestablishment", "a", "ab", "zzzzzz", "é🙂é", "inging" * 9]
    assert own.encode_pieces(words) == {w: own.encode_piece(w) for w in words}
    monkeypatch.setattr(bpe, "SCAN_LIMIT", 0)
    assert own.encode_pieces(words) == {w: own.encode_piece(w) for w in words}


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    own = bpe.RankArrayTokenizer.from_file(bpe.tokenizer_path())
    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(20)) + " the"
        assert own.encode(text) == bpe.load(bpe.tokenizer_path()).encode(text)
        assert len(own.cache) <= 71


def test_documents(spark):
    library = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    rows = [(1, "Hello, World's end"), (1, "Hello"), (None, "x"), (2, None), (3, ""), (4, "long " * 50_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    expect = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False) if ids else ""
        expect.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_documents(df).collect()), key=repr) == sorted(expect, key=repr)
    assert bpe.encode_documents(df.limit(0)).collect() == []
