from framewise.llm import quality_rules as qr


def test_every_language_has_a_reference(spark, monkeypatch):
    rows = []
    for k in range(70):
        text = " ".join(f"w{k}x{i % 9}" for i in range(60 + (k < 69) * 20))
        rows += [(2 * k, f"l{k:02}", text), (2 * k + 1, None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    known = qr.references(docs)
    assert known.names == [f"l{k:02}" for k in range(70)]
    ask = lambda: sorted(map(tuple, qr.judge_all(docs).collect()))
    whole = ask()
    assert len(whole) == 140 and all(abs(r[-1]) < 1e-6 and abs(r[-2]) < 1e-6 for r in whole)
    monkeypatch.setattr(qr, "BLOCK", 30)
    assert ask() == whole
