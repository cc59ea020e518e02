"""The pipeline's stages on the smallest tables, each against what it promises."""

import corpus_pipeline

from haplospark.llm import mixing, queries, shared

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.store(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        if name != "mix_sources":
            assert out.exceptAll(docs).isEmpty() and 0 < out.count() <= docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    rows = sorted((r.start, r.n_tokens) for r in last.collect())
    assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "mix_sources", "token_files"]


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage's rows on a small corpus of its own, against plain Python (or SQL, for the mix)."""
    from test_llm_operators import brute_components, brute_leaks, documents, edited, expected_tokens, oracle, prose

    items = [(i, prose(30, 700 + i)) for i in range(4)]
    rows = [(i, prose(60 + i % 9, i), f"s{i % 3}") for i in range(40)] + [(100 + i, edited(prose(90, i), 60, i), "s1") for i in range(6)] + [(200 + i, prose(90, i), "s0") for i in range(6)]
    rows += [(300 + i, prose(20, 50 + i) + " " + text + " " + prose(20, 60 + i), "s2") for i, text in items]
    rows += [(400 + i, "| BUY NOW !!! " * 20, "s2") for i in range(20)] + [(500, None, "s0"), (501, "a few words", "s1")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, int("BUY" not in (t or ""))) for d, t, _ in rows if d % 4], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, stages = queries.table(spark, str(tmp_path), "documents"), dict(corpus_pipeline.STAGES)
    held = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    def after(name, docs):
        return shared.store(stages[name](spark, docs, str(tmp_path)), name)

    good = after("quality_classifier", docs)
    assert {d for d, _ in held(good)} >= {d for d, t, _ in rows if len(t or "") > 100 and "BUY" not in t} and not any("BUY" in (t or "") for _, t in held(good))
    own = held(good)
    one = after("ngram_jaccard_join", good)
    assert held(one) == [(d, t) for d, t in own if brute_components(own)[d][1] == d] and len(own) > one.count()
    own = held(one)
    leaks = {d for d, _ in brute_leaks(own, items)}
    clean = after("benchmark_decontamination", one)
    assert held(clean) == [(d, t) for d, t in own if d not in leaks] and leaks == {300, 301, 302, 303}
    mixed = after("mix_sources", clean)
    columns, want = oracle(mixing.ORACLE_SQL, documents=clean.select("doc_id", "text", "source"))
    taken = {r[columns.index("doc_id")]: (r[columns.index("taken")], r[columns.index("size")]) for r in want}
    assert held(mixed) == sorted((d, t) for d, t in held(clean) for _ in range(taken[d][0] // taken[d][1] if taken[d][1] else sum(x == (d, t) for x in held(mixed))))
    got = sorted(tuple(r) for r in stages["token_files"](spark, mixed, str(tmp_path)).collect())
    assert got == sorted(expected_tokens(held(mixed)))
