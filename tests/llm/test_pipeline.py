"""The pipeline stage by stage over the smallest tables, each held against what it should have kept."""

import os
import random

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{k}")
        before, docs = docs, spark.read.parquet(f"{at}/{k}")
        out.append((name, before, docs))
    return out


def test_columns(stages):
    first = stages[0][1].columns
    assert all(after.columns == first for _, _, after in stages[:-1])


def test_quality(spark, stages):
    from foliograph.llm.quality import quality_rules

    _, before, after = stages[0]
    want = {r["doc_id"] for r in quality_rules(before).where("quality.kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == want


def test_lines(stages):
    from test_tables import brute_dedup

    _, before, after = stages[1]
    want = brute_dedup([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {(r["doc_id"], r["text"]) for r in after.collect()} == set(want)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_duplicates(stages):
    from test_tables import brute_classes

    _, before, after = stages[2]
    want = {c for _, c, _ in brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])}
    got = [r["doc_id"] for r in after.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_mixing(spark, stages):
    _, before, after = stages[3]
    ids = {r["doc_id"] for r in after.collect()}
    assert ids <= {r["doc_id"] for r in before.collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()} & {r["doc_id"] for r in before.collect()}
    assert len(clean & ids) >= 0.8 * len(clean)


def test_pieces(stages):
    import sentencepiece

    from foliograph.llm.sentencepieces import MODEL

    _, before, after = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["round_trip"]


def test_run(spark, stages):
    import corpus_pipeline

    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in stages[-1][2].collect())


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    """Nulls, empties, repeats, a long text and further columns go through all stages; an empty table stays empty."""
    import corpus_pipeline

    rnd = random.Random(11)
    clean = lambda n: ". ".join(" ".join(rnd.choice(["ba", "lo", "mi", "tu", "re"]) + rnd.choice(["nor", "stel", "vick", "drum"]) + str(rnd.randrange(99)) for _ in range(9)) for _ in range(n // 9))
    plain, long = clean(200), clean(30_000)
    rows = [(1, plain), (2, clean(180)), (2, None), (None, clean(160)), (None, None), (4, ""), (5, long), (6, plain), (7, "x" * 40_000), (8, " \n\t "), (9, clean(120)), (9, clean(90))]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality int, mix string, own string"
    for name, table in (("odd", rows), ("none", [])):
        at = tmp_path / name
        spark.createDataFrame([(i, t, "en", None, len(t or ""), 1, "m", "o") for i, t in table], kind).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        docs = spark.read.parquet(str(at / "documents.parquet"))
        for stage, run in corpus_pipeline.STAGES[:-1]:
            assert run(spark, docs, str(at)).columns == docs.columns, stage
        got = corpus_pipeline.run(spark, str(at)).collect()
        ids = [r["doc_id"] for r in got]
        assert ids == [] if name == "none" else {1, 5, None} <= set(ids) and not {4, 7, 8} & set(ids) and len(ids) == len(set(ids)) + ids.count(9) - (9 in ids)
        assert all(r["n_pieces"] == 0 for r in got if r["doc_id"] == 6)  # a copy, of which the line dedup leaves nothing
        assert all(r["round_trip"] for r in got)
