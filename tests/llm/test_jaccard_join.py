"""The join's components against brute force."""

import random

import numpy as np
import pytest

from nimbora.llm import jaccard_join as J

from .conftest import text


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    ids = sorted({k for k, _ in rows}, key=lambda k: (k is None, k))
    sets = [(k, shingles(t)) for k, t in rows]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                up[root(i)] = root(j)
    out = set()
    for i, (k, s) in enumerate(sets):
        group = [sets[j][0] for j in range(len(sets)) if root(j) == root(i) and sets[j][0] is not None]
        out.add((k, len(s), (min(group) if group else None) if s else k))
    assert ids
    return out


def found(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in J.similarity_classes(df).collect()}


def test_odd_documents(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found(odd_documents) == brute(rows)
    assert J.similarity_classes(odd_documents).count() == len(rows)


def test_empty_table(no_documents):
    assert found(no_documents) == set() and J.keep_one_of_each(no_documents).count() == 0


def test_edited_copies(spark):
    rng = random.Random(4)
    rows = []
    for group in range(12):
        words = [rng.randrange(2000) for _ in range(rng.choice([6, 12, 40, 150]))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.randrange(2000)
            rows.append((len(rows), text(*copy)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_blocks_of_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 4)
    rng, rows = random.Random(9), []
    base = list(range(60))
    for _ in range(40):  # a chain: near copies drift away from the first, so that the leader doesn't reach all
        rows.append((len(rows), text(*base)))
        base[rng.randrange(60)] = rng.randrange(3000)
    rows += [(len(rows) + i, text(*range(56), *range(1000 + 40 * i, 1040 + 40 * i))) for i in range(20)]  # share a passage only
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_keep_one_of_each(odd_documents):
    kept = J.keep_one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in kept.collect()) == [(False, 1, False), (False, 4, False), (False, 5, True), (False, 6, False), (False, 8, False), (False, 10, False), (False, 11, False), (True, 0, True)]


@pytest.mark.parametrize("seed", range(3))
def test_tree_finds_what_all_pairs_find(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64) if not sets or rng.random() < 0.5 else np.concatenate([sets[rng.integers(len(sets))], rng.integers(0, 2**63, 5).astype(np.uint64)])
        sets.append(np.unique(base))

    def classes(links):
        joined = J.Joined(len(sets))
        for i, j in links:
            joined.up[joined.root(i)] = joined.root(j)
        return {frozenset(i for i in range(len(sets)) if joined.root(i) == r) for r in {joined.root(i) for i in range(len(sets))}}

    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if J.similar(sets[i], sets[j])]
    assert classes(J.links_among(sets)) == classes(pairs)
