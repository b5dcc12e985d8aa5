import random

import numpy as np
import pytest
from test_duplicates import brute_print
from texts import SCHEMA, documents

import corpus_pipeline
from hearlog.llm import shingles


def text(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(words))


def edited(base: str, *places: int) -> str:
    words = base.split()
    for place in places:
        words[place] = f"other{place}"
    return " ".join(words)


def brute_set(t):
    words = (t or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def similarity(a, b):
    a, b = brute_set(a), brute_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            near = (brute_print(rows[a][1]) ^ brute_print(rows[b][1])).bit_count() <= 2
            if near or similarity(rows[a][1], rows[b][1]) >= 0.8:
                root[find(a)] = find(b)
    best = {}
    for place, (i, t) in enumerate(rows):
        key = i is None, i or 0, shingles_digest(t)
        best[find(place)] = min(key, best.get(find(place), key))
    return [best[find(place)] == (i is None, i or 0, shingles_digest(t)) for place, (i, t) in enumerate(rows)]


def shingles_digest(t):
    import hashlib

    return hashlib.sha256((t or "").encode()).hexdigest()


def corpus():
    rows = [(i, t) for i, t, *_ in documents()]
    for n in range(8):
        base = text(n, 60 + 20 * n)
        rows += [(1000 + n, base), (2000 + n, edited(base, 30)), (3000 + n, edited(base, 10, 40)), (None, edited(base, 5, 20, 50))]
    base = text(99, 120)
    rows += [(4000 + n, edited(base, *random.Random(n).sample(range(120), 3))) for n in range(40)]
    line = text(77, 12)
    rows += [(5000 + n, f"{line} {text(500 + n, 20)}") for n in range(30)]
    return rows


@pytest.mark.parametrize("chunk", [512, 3])
def test_near_copies_equal_brute_force(spark, chunk):
    """Also where groups are cut into many chunks (chunk=3)."""
    rows = corpus()
    got = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk=chunk).collect()
    want = sorted((str(i), shingles_digest(t), kept) for (i, t), kept in zip(rows, brute_kept(rows), strict=True))
    assert sorted((str(r.doc_id), r.text_sha256, r.kept) for r in got) == want
    assert 0 < sum(r.kept for r in got) < len(got)


def test_common_shingles_come_last(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SAMPLED", 1)
    rows = corpus()
    got = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), gathered=8).collect()
    want = sorted((str(i), shingles_digest(t), kept) for (i, t), kept in zip(rows, brute_kept(rows), strict=True))
    assert sorted((str(r.doc_id), r.text_sha256, r.kept) for r in got) == want


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for size in (1, 40, 64, 65, 500, 9000):
        pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        for _ in range(20):
            one, two = (np.unique(rng.choice(pool, rng.integers(1, size + 1))) for _ in range(2))
            a, b = shingles.sketch(one), shingles.sketch(two)
            width = min(len(a), len(b))
            differ = np.bitwise_count(shingles.folded(a[None], width) ^ shingles.folded(b[None], width)).sum()
            assert differ <= len(np.setxor1d(one, two))


def groups_of(spark, rows, **settings):
    """Texts that stay, and how many rows were compared exactly."""
    compared = []
    before = shingles._compared

    def counting(pairs, sets, similarity):
        compared.append(pairs.count())
        return before(pairs, sets, similarity)

    shingles._compared = counting
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        kept = [r.doc_id for r in shingles.near_copies(frame, **settings).where("kept").collect()]
    finally:
        shingles._compared = before
    return sorted(kept), sum(compared)


def test_a_large_group_of_near_copies_costs_few_comparisons(spark):
    base = text(5, 150)
    rows = [(n, edited(base, *random.Random(n).sample(range(150), 2))) for n in range(2000)]
    kept, compared = groups_of(spark, rows)
    assert kept == [0] and compared < 5 * len(rows)


def test_texts_that_share_a_third_of_their_words_are_not_compared(spark):
    shared = text(6, 40)
    rows = [(n, f"{shared} {text(10_000 + n, 80)}") for n in range(2000)]
    kept, compared = groups_of(spark, rows)
    assert kept == list(range(2000)) and compared < len(rows)


def test_stage_removes_a_copy_of_four_fifths(spark, tmp_path):
    """Far outside two of 64 bits, but similar by 0.8."""
    base = text(1, 204)
    copy = edited(base, 40, 80, 120, 160)
    less = edited(text(2, 204), 40, 80, 120, 160, 190)
    assert 0.8 <= similarity(base, copy) < 0.82 and similarity(text(2, 204), less) < 0.8
    assert (brute_print(base) ^ brute_print(copy)).bit_count() > 2
    rows = [(1, base), (2, copy), (3, text(2, 204)), (4, less), (5, text(3, 50))]
    docs = spark.createDataFrame([(*r, "en", "a", 1, "x", "y", "z") for r in rows], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4, 5]
