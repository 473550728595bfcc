"""A group of near copies whose buckets are large: classes equal brute force."""

import numpy as np
import pyarrow as pa

from rankloom.llm.neardup import SIMILARITY, aligned_similarity, labelled_shingles, near_duplicates
from rankloom.llm.texts import text_bytes, word_hashes


def test_large_group_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    texts = []
    for _ in range(70):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            words[at] = f"x{at % 7}-{rng.integers(0, 3)}"
        texts.append(" ".join(words))
    hashes, rows = word_hashes(*text_bytes(pa.array(texts)))
    shingles = [labelled_shingles(hashes[a:b].astype(np.uint32)) for a, b in zip(rows[:-1], rows[1:])]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if aligned_similarity(shingles[i], shingles[j]) >= SIMILARITY - 1e-12 and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    assert 1 < len(set(least)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()} == dict(enumerate(least))
