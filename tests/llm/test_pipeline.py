import hashlib
import random

import corpus_pipeline
import pytest
from framewise.llm import bpe, quality_classifier

from .test_decontamination import WORD, words
from .test_jaccard_join import brute as components
from .test_suffix_dedup import sd

tokenizers = pytest.importorskip("tokenizers")


def _brute_repeats(rows):
    seen, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - sd.LENGTH + 1):
            g = b[p : p + sd.LENGTH]
            seen[g] = min(seen.get(g, d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = set()
        for p in range(len(b) - sd.LENGTH + 1):
            if seen[b[p : p + sd.LENGTH]] < d:
                gone.update(range(p, p + sd.LENGTH))
        out.append((d, None if t is None else bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")))
    return out


def _brute_clean(text, grams, size=10, most=0.5):
    """The text without windows, cut again until none is left; False if too much of it goes."""
    total, lost = len(words(text)), 0
    while text:
        found = list(WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)})))
        own = [m.group() for m in found]
        hit = sorted({j for i in range(len(own)) if tuple(own[i : i + size]) in grams for j in range(i, i + size)})
        if not hit:
            break
        lost += len(hit)
        if lost > most * total:
            return False
        runs = [[hit[0], hit[0]]]
        for j in hit[1:]:
            if j == runs[-1][1] + 1:
                runs[-1][1] = j
            else:
                runs.append([j, j])
        for first, last in reversed(runs):
            text = text[: found[first].start()] + text[found[last].end() :]
    return text


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    vocab = [rng.choice("bdfgklm") + rng.choice("aeiou") + rng.choice("nrst") + str(i) for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, passage = text(14), text(40)
    rows = []
    for i in range(90):
        t = text(rng.randint(20, 70))
        if i % 9 == 4:
            t = rows[i - 1][1] + " tail"
        if i % 10 == 7:
            t = t + " " + passage
        if i % 11 == 5:
            t = t + "\n" + item.upper() + "! " + text(30)
        if i % 6 == 1:
            t = " | ".join(f"###{w}$$$" for w in t.split())
        rows.append((i, t))
    rows += [(200, None), (201, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 0 if i % 6 == 1 else 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    good = {r.doc_id for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).filter("predicted = 1").collect()}
    assert not good & {i for i in range(90) if i % 6 == 1} and len(good) > 70
    kept = [r for r in rows if r[0] in good]
    head = {d: c for d, _, c in components(kept)}
    kept = _brute_repeats([r for r in kept if head[r[0]] == r[0]])
    grams = {tuple(words(item)[i : i + 10]) for i in range(5)}
    assert any(tuple(words(t)[i : i + 10]) in grams for _, t in kept for i in range(len(words(t))))
    kept = [(d, c) for d, c in ((d, _brute_clean(t, grams)) for d, t in kept) if c is not False]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    library = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    assert set(out) == {d for d, _ in kept}
    for d, t in kept:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[d].n_tokens == len(ids)
        assert out[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, str(tmp_path))
        assert before.columns == docs.columns
    assert not any(tuple(words(r.text)[i : i + 10]) in grams for r in before.collect() for i in range(len(words(r.text))))


def test_empty_tables_repeated_ids_and_clashing_names(spark, tmp_path):
    clash = ["id", "key", "row", "mark", "gone", "block", "data", "answers", "n", "lost", "cuts", "quality_score", "component_id", "n_bytes"]
    fields = ", ".join(f"{c} string" for c in clash)
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(d, t, *(["v"] * len(clash))) for d, t in ((1, text), (1, text), (2, text + " tail"), (None, text), (3, None), (3, ""), (4, "other " * 400))]
    for folder, held in (("full", rows), ("empty", [])):
        path = f"{tmp_path}/{folder}"
        spark.createDataFrame(held, f"doc_id long, text string, {fields}").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 1, 0)] if held else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == ["doc_id", "text", *clash]
        assert all(r[c] == "v" for r in docs.collect() for c in clash)
        out = corpus_pipeline.run(spark, path).collect()
        assert sorted(str(r.doc_id) for r in out) == (["1", "3", "3", "4", "None"] if held else [])


def test_stages_leave_only_their_tables(spark, tmp_path):
    """After a run of the middle stages the shared folder holds what the last result reads, and no more."""
    import os

    from framewise.llm import common

    root = common.scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3} " * 9) for i in range(12)], "doc_id long, text string").repartition(2)
    found = corpus_pipeline.one_of_each_group(spark, docs, "")
    kept = common.materialize(found, "kept")
    common.release(found)
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before} == {"kept"}
    found = corpus_pipeline.without_repeats(spark, kept, "")
    last = common.materialize(found, "last")
    common.release(found)
    common.discard(kept)
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before} == {"last"}
    assert last.count() == 3
