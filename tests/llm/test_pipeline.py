from __future__ import annotations

import corpus_pipeline
from helpers import awkward, prose


def test_stages_take_effect(spark, tmp_path):
    item = prose(1234, 40).replace("\n", " ")
    line = prose(77, 60).replace("\n", " ")
    clean = [(k, prose(3000 + k, 200 + k)) for k in range(20, 40)]
    words = clean[0][1].split(" ")
    words[50] = "changed"
    near = " ".join(words)
    rows = [*awkward(), *clean, (50, near), (51, clean[1][1]), (52, prose(9, 100) + "\n" + item), (53, prose(10, 90) + "\n" + line), (54, prose(11, 90) + "\n" + line), (55, "junk " * 300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i, _ in clean} <= set(out) and not {2, 3, 5, 8, 9, 50, 51, 52, 55} & set(out) and {4, 7, 53, 54} <= set(out)
    assert out[54].n_chars == len(prose(11, 90)) and out[53].n_chars == len(rows[-3][1])
    assert all(r.round_trip for r in out.values())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        assert (stage(spark, docs, str(tmp_path)).columns == docs.columns) == (name != corpus_pipeline.STAGES[-1][0])
