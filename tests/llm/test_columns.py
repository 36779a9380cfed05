"""Documents with further columns, some named like the operators' own, pass through every stage."""

import corpus_pipeline as cp

EXTRA = ["fp", "_fp", "n_words", "_spans", "items", "score", "_lang", "ambiguous", "ids", "length", "kept_fp", "component_id", "rank", "bucket"]


def test_stages_keep_further_columns(spark, tmp_path):
    texts = ["the quick brown fox jumps over the lazy dog again and again", None, "", "der schnelle braune Fuchs springt", "mail a.b@example.org now"]
    rows = [(i, t, "en" if i % 2 == 0 else "de", "s", 0, *range(len(EXTRA))) for i, t in enumerate(texts * 3)] + [(None, "no id here", None, None, None, *[None] * len(EXTRA))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)
    docs = spark.createDataFrame(rows, schema)
    bench = [(1, texts[0]), (2, texts[0].upper())]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.where("component_id is not null and rank <> 12").count() == 0, name
    kept = {r.text for r in cp.decontamination(spark, docs, str(tmp_path)).collect()}
    assert texts[0] not in kept and None in kept
    assert cp.packing(spark, docs, str(tmp_path)).count() == len(rows)
