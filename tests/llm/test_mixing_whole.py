"""The mixing stage of the pipeline keeps clean documents, however scarce toxic ones are."""

import random
from collections import Counter

import pytest

N = 2000


def corpus(spark, at, n_toxic, labelled=True):
    rnd = random.Random(8)
    rows = []
    for i in range(N):
        words = [rnd.choice(["lorem", "ipsum", "dolor", "amet", "sit", "elit"]) for _ in range(rnd.randrange(20, 80))]
        if i < n_toxic:
            words[:3] = ["foul", "nasty", "vile"]
        rows.append((i, " ".join(words), int(i < n_toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(2)
    df.where("true" if labelled else "false").select("doc_id", "toxic").write.parquet(f"{at}/labels.parquet")
    return df.drop("toxic"), {i: len(t.split()) for i, t, _ in rows}


@pytest.mark.parametrize("n_toxic, labelled", [(0, True), (2, True), (N // 10, True), (2, False)])
def test_clean_documents_stay_once(spark, tmp_path, n_toxic, labelled):
    import corpus_pipeline

    docs, n = corpus(spark, str(tmp_path), n_toxic, labelled)
    got = Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, str(tmp_path)).select("doc_id").collect())
    assert all(got[i] == 1 for i in range(n_toxic, N))
    toxic = sum(got[i] * n[i] for i in range(n_toxic))
    if n_toxic == N // 10:
        assert toxic <= 0.015 * sum(got[i] * n[i] for i in got)
    else:  # below its share: nothing goes, nothing is repeated
        assert all(got[i] == 1 for i in range(n_toxic))
