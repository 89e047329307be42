import hashlib
import itertools
import random

import pytest
from framewise.llm import sentencepiece_bpe as S

sentencepiece = pytest.importorskip("sentencepiece")

PIECES = ["a", "e", "é", "é", "Σ", " ", "  ", "    ", "\n", "\n\n", "\t", "▁", "▁▁", "1", "234", "½", "東京", "🙂", "̀", "the", " the", "ing", "_", "\x00", "가", " ", "<s>", "</s>", "<0x0A>", "<unk>", "Supercali", "fragil", "==", "//", "​"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.model_path())


@pytest.fixture(scope="module")
def own():
    with open(S.model_path(), "rb") as f:
        return S.loaded(f.read())


def _texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    letters = ["".join(rng.choice("abcdeinrst ") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return [*out, *letters, *(" " * n for n in range(40)), "a" * 5000, "!?" * 3000, "the" * 2000, "abc🙂" * 900, "", "▁", "x" * 201]


def test_equals_the_library(own, library):
    for text in _texts():
        expect = library.encode(text)
        assert own.encode(text) == expect, text
        assert own.decode(expect) == library.decode(expect), text
        assert own.digests(text) == (len(expect), hashlib.sha256(",".join(map(str, expect)).encode()).hexdigest(), hashlib.sha256(library.decode(expect).encode()).hexdigest())


def test_pairs_stay_apart_as_the_merges_leave_them(own):
    """Against plain merging of both tokens' characters."""

    def merged(text):
        parts = list(text)
        while len(parts) > 1:
            best, at = min((own.rank.get(a + b, S._NEVER), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
            if best == S._NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    rng, tokens = random.Random(3), sorted(own.right)
    short = [t for t in tokens if len(t) < 4 and t.isascii()]
    for _ in range(20_000):
        a, b = rng.choice(short), rng.choice(short if rng.random() < 0.7 else tokens)
        assert own.stay_apart(a, b) == (merged(a + b) == [a, b]), (a, b)


def test_caches_stay_bounded(own, library, monkeypatch):
    monkeypatch.setattr(S, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(S, "PAIR_ENTRIES", 50)
    own.cache.clear()
    own.apart.clear()
    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(20)) + " the"
        assert own.encode(text) == library.encode(text)
        assert len(own.cache) <= 50 and len(own.apart) <= 50


def test_words_are_encoded_apart_from_the_marks_around_them(own, library, monkeypatch):
    words, marks = [f"w{a}{b}" for a in "abcdefghij" for b in "klmno"], [".", ",", "!", "%%%", "###", "(", '"', "…", "7", "東"]
    seen, encode_part = [], own.encode_part
    monkeypatch.setattr(own, "encode_part", lambda part: seen.append(part) or encode_part(part))
    own.cache.clear()
    for mark in marks:
        text = " ".join(w + mark for w in words)
        assert own.encode(text) == library.encode(text)
    assert len(seen) == len(words) + len(marks)


def test_no_piece_reaches_across_a_cut(own, library):
    assert all(own.cut.findall(p) == [p] for p in own.ids)
    rng = random.Random(11)
    signs = ["a", "er", "É", "ß", "ж", "ии", "г", "ω", "ا", "ال", "取获", "一个", "据数", "가", "🙂", "\u0301", "\u00a0", "1", "20", ".", "...", "])", "-", "^", "\\", "&&", "||", "~~", "’", "…", "·", " ", "   ", "▁", "\n", "\r\n", "\t"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 40)))
        assert "".join(own.cut.findall(text)) == text
        assert own.encode(text) == library.encode(text), text
        assert own.decode(own.encode(text)) == library.decode(library.encode(text)), text


def test_alphabets():
    assert S.alphabets(["ab", "c", "bc", "x", "yz", "z"]) == ["abc", "yz"]
    chain = "".join(map(chr, range(0x100, 0x300)))
    pairs = [a + b for a, b in itertools.pairwise(chain)]
    random.Random(1).shuffle(pairs)
    assert S.alphabets(pairs) == [chain]
    assert S.alphabets([]) == []


def test_other_models_are_refused(own):
    with pytest.raises(ValueError):
        S.PrefixTokenizer(b"\x0a\x05\x0a\x01a\x18\x01")


def test_documents(spark, library):
    rows = [(1, "Hello, World's end"), (1, "Hello"), (None, "x"), (2, None), (3, ""), (4, "long 東 " * 300_000), (5, "y" * 2_000_000), (1, "Hello")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    expect = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        expect.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, S.encode_documents(df).collect()), key=repr) == sorted(expect, key=repr)
    assert S.encode_documents(df.limit(0)).collect() == []
