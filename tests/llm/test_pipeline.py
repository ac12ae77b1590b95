"""The pipeline against brute force."""

import re

from llm_plain import contaminated, deduped, fingerprint_classes

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline
    from docweave.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = stored(stage(spark, now, SF))
        if name == "packing":
            assert {r["doc_id"] for r in now.collect()} == set(before)
            break
        assert now.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "quality":
            assert set(after) < set(before) and all(len(re.findall(r"\S+", t)) >= 10 for t in after.values())
        elif name == "line_dedup":
            want = deduped(list(before.items()))
            assert {d: "\n".join(x) for d, x in want.items()} == {d: t or "" for d, t in after.items()}
        elif name == "near_dedup":
            assert set(after) == set(fingerprint_classes(before).values())
        else:
            assert set(after) == {d for d, t in before.items() if not contaminated(t, items)}
    assert corpus_pipeline.run(spark, SF).count() == now.count()


CLASHING = ("n_words", "kept", "base_failed", "n_lines", "n_dropped", "class_distance", "size", "fp", "row", "text_hash", "matches", "h1", "id", "key", "shard", "lang_pred", "component_id", "row_a")


def test_pipeline_odd(spark, odd, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents = odd.withColumns({c: F.lit(f"mine {c}") for c in CLASHING})
    for frame in (documents, documents.where("false")):
        now, ids = frame, {r["doc_id"] for r in frame.select("doc_id").collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids
            if name != "packing":
                assert out.columns == frame.columns and not out.where(" or ".join(f"{c} <> 'mine {c}'" for c in CLASHING)).count()
                now = stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns
    want = {"quality": [4], "line_dedup": [1, 2, 3, 3, 4, 5, 6, 7, None], "near_dedup": [1, 3, 4, 5, 6, 7], "decontamination": [1, 2, 3, 3, 4, 5, 6, 7, None]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = [r["doc_id"] for r in stage(spark, documents, str(tmp_path)).collect()]
        if name == "near_dedup":  # null and empty texts are one group, the repeated rows another, two texts share a few words only
            assert set(got) - {None} == set(want[name])
        else:
            assert sorted(got, key=lambda d: (d is None, d)) == want[name]


def test_run_deletes_what_it_stored(spark, tmp_path):
    import corpus_pipeline
    from docweave.llm import common

    mark = common.written()
    corpus_pipeline.run(spark, SF).count()
    left = common._written[mark:]
    assert len(left) <= 3  # the last stage's input and its own


def test_near_dedup_keeps_one_row_of_each_group(spark, docs_of):
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    # Groups without ids, a copy without an id of a row that has one, ids on unrelated texts, equal rows.
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (5, text(3)), (7, text(4)), (7, text(5)), (8, text(5)), (9, text(6)), (9, text(6)), (4, text(7)), (9, text(7)), (4, text(8)), (2, None), (None, "")]
    want = sorted([(None, text(1)), (None, text(2)), (5, text(3)), (7, text(4)), (7, text(5)), (9, text(6)), (4, text(7)), (4, text(8)), (2, None)], key=str)
    docs = docs_of(*rows)
    for frame in (docs, docs.repartition(3, "text")):
        out = corpus_pipeline.near_dedup(spark, frame, "")
        assert out.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == want
