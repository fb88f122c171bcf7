"""A hot group of copies doesn't hide links at the threshold."""

import random

from foliograph.llm import near_duplicates as N

PAIRS = 500


def changed(words, at, mark):
    return [f"{mark}{i}" if i in at else w for i, w in enumerate(words)]


def test_links_at_the_threshold_beside_a_hot_group(spark):
    rnd = random.Random(12)
    docs = []
    for i in range(PAIRS):  # 90 shingles, 80 of them in both: 80 / 100
        w = [f"p{i}w{rnd.randrange(1 << 40)}" for _ in range(94)]
        docs += [" ".join(w), " ".join(changed(w, {30, 60}, f"other{i}"))]
    hot = [f"hot{i}" for i in range(204)]
    docs += [" ".join(changed(hot, {rnd.randrange(10, 190)}, f"copy{k}")) for k in range(400)]
    got = N.ngram_jaccard_join(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"))
    classes = {r["doc_id"]: r["class_id"] for r in got.where(f"doc_id < {2 * PAIRS}").collect()}
    assert [i for i in range(PAIRS) if classes[2 * i] != classes[2 * i + 1]] == []


def test_prefix():
    for threshold, target, start in ((0.8, 0.9995, 6), (0.5, 0.9, 6), (0.95, 0.9995, 6), (0.1, 0.9999, 6)):
        d = N.prefix(threshold, target, start)
        chance = lambda k: 1 - (1 - threshold**k) ** N.TREES
        assert (d == 1 or chance(d) >= target) and (d == start or chance(d + 1) < target)
