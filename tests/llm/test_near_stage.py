"""The pipeline's near-dedup stage against brute force at 0.8, and the tables that a threshold needs."""

from collections import defaultdict

import pytest

import corpus_pipeline
from pavelake.llm import near_dedup

from .test_dedup import LOWER, split


def numbered(*ids):
    return " ".join(f"n{i}" for i in ids)


#: 100 words; with one word changed in the middle 5 of 96 shingles differ (0.90), with two 10 (0.81), with three 15 (0.73)
PLAIN = list(range(100))
TEXTS = {
    1: numbered(*PLAIN), 2: numbered(*PLAIN[:30], 900, *PLAIN[31:60], 901, *PLAIN[61:]),
    3: numbered(*(i + 1000 for i in PLAIN)), 4: numbered(*(i + 1000 for i in PLAIN[:30]), 902, *(i + 1000 for i in PLAIN[31:])),
    5: numbered(*(i + 2000 for i in PLAIN)), 6: numbered(*(903 if i in (20, 50, 80) else i + 2000 for i in PLAIN)),
    7: None, 8: "",
}


def truth(texts, threshold):
    sets = {}
    for i, t in texts.items():
        w = split((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in texts:
        groups[find(i)].append(i)
    return sorted(min(g) for g in groups.values())


def test_stage_takes_copies_from_0_80(spark):
    d = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, d, "").collect())
    assert kept == truth(TEXTS, 80) == [1, 3, 5, 6, 7, 8]
    assert truth(TEXTS, 85) == [1, 2, 3, 5, 6, 7, 8]


@pytest.mark.parametrize("threshold,tables", [(85, 10), (80, 14)])
def test_tables_follow_from_the_threshold(threshold, tables):
    assert near_dedup.tables_for(threshold) == tables
    met = lambda n: (1 - (1 - (threshold / 100) ** near_dedup.PER_KEY) ** n) ** 2
    assert 1 - met(tables) <= near_dedup.MISS < 1 - met(tables - 1)
