import random

import pytest
from framewise.llm import token_counts as tc
from framewise.llm.bpe import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PIECES = ["a", "the ", "'s", "'", " ", "  ", "\n", "\n\n ", "été", "123", "!!", " ?", "x@y.org ", "1234567890", "東京", "🙂", "'re", "word", " word", "\t"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(tokenizer_path(tc.TOKENIZER_FILE))
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_edits_equal_a_full_count(library, monkeypatch):
    rng = random.Random(8)
    counter = tc.Counter(tokenizer_path(tc.TOKENIZER_FILE), tc.split_pattern())
    for leaf in (1, 3, 48):
        monkeypatch.setattr(tc, "LEAF", leaf)
        for _ in range(60):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 80)))
            tree = tc.TokenTree(counter.split(text), counter)
            assert tree.total == library(text)
            for _ in range(8):
                a = rng.randint(0, len(text))
                b = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 30]))
                new = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 1, 3])))
                tree.edit(a, b, new)
                text = text[:a] + new + text[b:]
                assert tree.text() == text and tree.total == library(text)


def test_an_edit_reencodes_little(library):
    counter = tc.Counter(tokenizer_path(tc.TOKENIZER_FILE), tc.split_pattern())
    text = "some words of a long text, " * 4000
    tree = tc.TokenTree(counter.split(text), counter)
    tree.edit(50_000, 50_010, "other")
    assert tree.total == library(text[:50_000] + "other" + text[50_010:]) and tree.reencoded < 2_000


def test_documents(spark, library):
    rows = [(1, "write to me.you@example.org or 1234567890123!"), (1, "plain"), (2, None), (3, ""), (None, "x@y.org"), (4, "long a@b.cd " * 4_000), (5, "<|endoftext|> 999999999")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    expect = []
    for doc_id, text in rows:
        edits = tc.mask_edits(text) if text else []
        new = text or ""
        for a, b, r in reversed(edits):
            new = new[:a] + r + new[b:]
        expect.append((doc_id, library(text or ""), len(edits), library(new)))
    assert sorted((tuple(r)[:4] for r in tc.count_documents(df).collect()), key=repr) == sorted(expect, key=repr)
    assert tc.count_documents(df.limit(0)).collect() == []


def test_overlapping_or_outside_edits():
    counter = tc.Counter(tokenizer_path(tc.TOKENIZER_FILE), tc.split_pattern())
    with pytest.raises(ValueError):
        tc.TokenTree(["abc"], counter).edit(2, 9, "")
    edits = tc.mask_edits("123456789012@example.org 5555555555")
    assert [e[2] for e in edits] == ["<email>", "<number>"]
