"""Vector operators (11 to 13) against plain restatements, on awkward and on random rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from hearlog.llm.covertree import assign, codes, cover_tree
from hearlog.llm.descent import near_vectors
from hearlog.llm.dictionaries import clustered, dictionaries, nearest, sums

NAN, INF = float("nan"), float("inf")


def schema(component=DoubleType):
    names = [(name, StringType()) for name in ("id", "vector", "node", "root", "code", "cluster", "n", "space")]
    return StructType([
        StructField("vec_id", LongType()), StructField("embedding", ArrayType(component())), StructField("label", IntegerType()),
        *[StructField(*name) for name in names],
    ])


def frame(spark, rows):
    return spark.createDataFrame([(*row, *"abcdefgh") for row in rows], schema()).repartition(3)


def vectors(size, count=150, seed=0):
    """Random rows with copies, ties, huge components, equal and null ids, and unusable vectors."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count, size)) / 4
    base[20:40] = base[0]
    base[40:60] = np.round(base[40:60] * 4) / 4
    rows = [(int(i), [float(x) for x in v], int(i) % 3 if i % 7 else None) for i, v in enumerate(base)]
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1], 1), (None, rows[8][1], None), (None, rows[8][1], 2)]
    rows += [(900, [1e300] * size, 1), (901, [-3e5] + [0.0] * (size - 1), 2)]
    unusable = [None, [], [NAN] * size, [INF] + [0.0] * (size - 1), [None] + [1.0] * (size - 1)]
    return rows, [(1000 + i, v, i % 2) for i, v in enumerate(unusable)]


def whole(vector):
    return [int(min(max(math.floor(min(max(256 * x, -1e18), 1e18)), -(1 << 26)), 1 << 26)) for x in vector]


def lloyd(points, centres, rounds):
    """(nearest, squared distance) per point, and the centres, after so many rounds."""
    def closest(point):
        return min((sum((a - b) ** 2 for a, b in zip(point, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for point in points:
            groups.setdefault(closest(point)[1], []).append(point)
        centres = [
            [sum(column) // len(groups[k]) for column in zip(*groups[k], strict=True)] if k in groups else c
            for k, c in enumerate(centres)
        ]
    return [closest(point) for point in points], centres


def sha(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


@pytest.mark.parametrize("block", [40, 8192])
def test_codes_equal_plain_lloyd(spark, block):
    kept, unusable = vectors(8)
    entries, parts = 6, 4
    got = codes(frame(spark, kept + unusable + [(5, [1.0] * 4, 0), (6, [1.0] * 7, 0)]), parts=parts, entries=entries, rounds=2, block=block, leaf=3)
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))
    points = [whole(v) for _, v, _ in kept]
    names, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        cut = [point[2 * p:2 * p + 2] for point in points]
        found, book = lloyd(cut, [cut[r] for r in order[:entries]], 2)
        books += [x for entry in book for x in entry]
        for r, (distance, code) in enumerate(found):
            names[r] += f"{code:02x}"
            errors[r] += distance
    by_label = Counter()
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] += error
    want = Counter(
        (i, name, error, by_label[label], sha(books)) for (i, _, label), name, error in zip(kept, names, errors, strict=True)
    )
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == want


def test_cover_tree_assigns_like_comparing_all():
    rng = np.random.default_rng(1)
    for size, spread in ((4, 30), (4, 3), (2, 1000), (1, 5)):
        rows = rng.integers(-spread, spread, (700, size))
        entries = np.concatenate((rows[:15], rows[:5], rng.integers(-spread, spread, (9, size))))
        tree, place = cover_tree(rows, leaf=4)
        assert (tree.points[place] == rows).all()
        assert (tree.sums[0] == rows.sum(axis=0)).all() and tree.counts[0] == len(rows)
        found, total, counts = assign(tree, entries)
        apart = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (found[place] == apart.argmin(axis=1)).all()
        for entry in range(len(entries)):
            assert (total[entry] == rows[found[place] == entry].sum(axis=0)).all()
        assert (counts == np.bincount(found[place], minlength=len(entries))).all()
    tight = np.repeat(np.array([[0, 0], [1000, 1000]]), 500, axis=0) + rng.integers(0, 9, (1000, 2))
    tree, place = cover_tree(tight, leaf=4)
    assert (assign(tree, np.array([[0, 0], [1000, 1000]]))[0][place] == np.repeat([0, 1], 500)).all()


@pytest.mark.parametrize("block", [40, 8192])
def test_clusters_equal_plain_lloyd(spark, block):
    kept, unusable = vectors(6, seed=3)
    clusters = 7
    got = clustered(frame(spark, kept + unusable + [(7, [1.0] * 5, 0)]), size=6, clusters=clusters, rounds=3, block=block)
    draws = {r: hashlib.sha256(f"2:{kept[r][0]}".encode()).hexdigest() for r in range(len(kept)) if kept[r][0] is not None}
    order = sorted(draws, key=lambda r: (draws[r], kept[r][1]))
    points = [whole(v) for _, v, _ in kept]
    found, centres = lloyd(points, [points[r] for r in order[:clusters]], 3)
    inertia, top = Counter(), (1 << 63) - 1
    for distance, k in found:
        inertia[k] += distance
    want = Counter(
        (i, k, distance, min(inertia[k], top), min(sum(inertia.values()), top), sha(centres[k]))
        for (i, _, _), (distance, k) in zip(kept, found, strict=True)
    )
    got = Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect())
    assert got == want


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(4)
    rows = rng.integers(-4, 4, (500, 7))
    encoded = dictionaries(rows, 2)
    assert (np.concatenate([distinct[at] for distinct, at in encoded], axis=1) == rows).all()
    centroids = rng.integers(-4, 4, (9, 7))
    best, apart = nearest(encoded, centroids)
    distances = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == distances.argmin(axis=1)).all() and (apart == distances.min(axis=1)).all()
    assert (sums(encoded, best, 9) == np.stack([rows[best == k].sum(axis=0) for k in range(9)])).all()


def links(rows, threshold):
    """(id, n_links, component_id, kept) of every row, from all pairs."""
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def unit(vector):
        if vector is None or not vector or not all(x is not None and math.isfinite(x) for x in vector) or not any(vector):
            return None
        v = np.array(vector, np.float64)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    use = [unit(v) if label is not None else None for _, v, label in rows]
    for a in range(len(rows)):
        for b in range(a):
            if use[a] is None or use[b] is None or rows[a][2] != rows[b][2] or len(use[a]) != len(use[b]):
                continue
            if rows[a][1] == rows[b][1] or use[a] @ use[b] >= threshold:
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    groups = {}
    for r in range(len(rows)):
        groups.setdefault(find(r), []).append(rows[r][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((row[0], n[r], least[find(r)], row[0] == least[find(r)]) for r, row in enumerate(rows))


def near_links(spark, rows, **settings):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(frame(spark, rows), **settings).collect())


def test_near_vectors_on_awkward_rows(spark):
    kept, unusable = vectors(8, count=90, seed=5)
    rows = kept + unusable + [(2000, [0.0] * 8, 1), (2001, [-0.0] * 8, 1), (2002, [1.0] * 5, 1), (2003, [2.0] * 5, 1),
                              (2004, [1.0] * 8, None), (2005, [1e-310] * 8, 1)]
    assert near_links(spark, rows) == links(rows, 0.93)


def test_near_vectors_enlarge_lists_and_compare_dense_components(spark):
    rng = np.random.default_rng(6)
    rows, at = [], 0
    for label in range(2):
        for group, noise in ((70, 0.2), (30, 0.3), (12, 0.33), (9, 0.35), (200, 3.0), (40, 0.02)):
            centre = rng.normal(size=16)
            for _ in range(group):
                rows.append((at * 7919 % 100003, [float(x) for x in centre + noise * rng.normal(size=16)], label))
                at += 1
    want = links(rows, 0.93)
    assert max(n for _, n, _, _ in want) > 60
    for settings in ({}, {"neighbours": 4, "longest": 8, "trees": 3, "leaf": 16, "chunk": 16}):
        assert near_links(spark, rows, **settings) == want


def test_descent_finds_what_the_start_misses(spark):
    """From one tree with tiny runs, rounds of neighbours of neighbours find nearly all links."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 12))
    rows = [(i, [float(x) for x in centres[i % 60] + 0.18 * rng.normal(size=12)], 0) for i in range(600)]
    want, start, got = (
        sum(n * times for (_, n, _, _), times in found.items())
        for found in (
            links(rows, 0.93),
            near_links(spark, rows, trees=1, leaf=8, rounds=0, attempts=1),
            near_links(spark, rows, trees=1, leaf=8, attempts=1),
        )
    )
    assert start < 0.6 * want and 0.97 * want <= got <= want


def test_vectors_of_empty_tables(spark):
    empty = frame(spark, [(1, None, 0)]).where("vec_id = 0")
    for result in (codes(empty), clustered(empty), near_vectors(empty)):
        assert result.count() == 0
    only = frame(spark, [(1, None, 0), (2, [NAN], None)])
    assert codes(only).count() == clustered(only).count() == 0
    assert Counter(near_vectors(only).collect()) == Counter([(1, 0, 1, True), (2, 0, 2, True)])
