import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from texts import SCHEMA, documents, prose

from hearlog.llm import simhash
from hearlog.llm.components import components
from hearlog.llm.exact import content_sort
from hearlog.llm.substrings import without_repeats


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_content_sort_equals_grouping(docs):
    groups = defaultdict(list)
    for i, text, *_ in documents():
        groups[text or ""].append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        got = content_sort(docs, keep=keep).collect()
        assert len(got) == len(documents())
        want = Counter()
        for text, ids in groups.items():
            known = [i for i in ids if i is not None]
            for i in ids:
                want[i, best(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_content_sort_normalises_and_takes_empty_tables(spark, docs):
    from pyspark.sql import functions as F

    sizes = {r.doc_id: r.group_size for r in content_sort(docs, normalise=F.lower).collect()}
    assert sizes[8] == sizes[9] == 2
    assert content_sort(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        content_sort(docs, keep="any")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(items, near):
    """Smallest id that links reach, per place in ``items`` of (id, print)."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if near(items[a][1], items[b][1]):
                root[find(a)] = find(b)
    least = {}
    for place, (i, _) in enumerate(items):
        if i is not None:
            r = find(place)
            least[r] = min(i, least.get(r, i))
    return [least.get(find(place)) for place in range(len(items))]


def test_near_duplicates_equal_brute_force(spark, docs):
    items = [(i, brute_print(t)) for i, t, *_ in documents()]
    roots = brute_roots(items, lambda a, b: (a ^ b).bit_count() <= 2)
    want = Counter((i, f"{p:016x}", r) for (i, p), r in zip(items, roots, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("paired", [64, 2])
def test_links_connect_all_near_prints(spark, monkeypatch, distance, paired):
    """Also where groups count as large (paired=2)."""
    import random

    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            prints.add(base ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) * (1 << rng.randrange(64)))
            prints.add(base)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    links = simhash.near_links(table, distance)
    for row in links.collect():
        assert ((row.a ^ row.b) & (1 << 64) - 1).bit_count() <= distance
    got = {r.node: r.root for r in components(links).collect()}
    items = [(p, p) for p in signed]
    roots = brute_roots(items, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= distance)
    assert [got.get(p, p) for p in signed] == roots


def test_link_settings_are_checked(spark):
    table = spark.createDataFrame([(1,)], "print long")
    for settings in ({"distance": 3}, {"distance": 2, "parts": 2}):
        with pytest.raises(ValueError):
            simhash.near_links(table, **settings)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 150), (150, 170)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100}
    assert got[200] == got[170] == got[150] == 150
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_without_repeats(rows, length):
    counts = Counter(t[k:k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = Counter()
    for i, t in rows:
        kept, removed, spans, reach, before = bytearray(), 0, 0, 0, False
        for k in range(len(t)):
            if k + length <= len(t) and counts[t[k:k + length]] > 1:
                reach = k + length
            gone = k < reach
            removed += gone
            spans += gone and not before
            before = gone
            if not gone:
                kept.append(t[k])
        out[i, len(t), removed, spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length", [200, 40])
def test_substrings_equal_brute_force(spark, docs, length):
    rows = [(i, (t or "").encode()) for i, t, *_ in documents()]
    assert Counter(map(tuple, without_repeats(docs, length=length).collect())) == brute_without_repeats(rows, length)
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_substrings_across_blocks(spark, tmp_path):
    """A passage in many contexts, and edited copies, in blocks of few documents."""
    passage = prose(8, 90)
    rows = [(n, f"{prose(100 + n, 50)} {passage} {prose(200 + n, 50)}") for n in range(25)]
    copy = prose(9, 400)
    rows += [(50 + n, copy[:300 * n] + "#" + copy[300 * n + 5:]) for n in range(6)]
    path = str(tmp_path / "edited.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    got = without_repeats(spark.read.parquet(path), keep_text=True, block_bytes=5_000).collect()
    want = brute_without_repeats([(i, t.encode()) for i, t in rows], 200)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_runs_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    from hearlog.llm import substrings

    text = (prose(8, 300) + prose(9, 200) + prose(8, 300)).encode()
    data, ends = np.frombuffer(text, np.uint8), np.array([1000, len(text)])
    places, whole = substrings.strings(data, np.ones(len(data), bool), 100)
    monkeypatch.setattr(substrings, "PIECE", 333)
    again, cut = substrings.strings(data, np.ones(len(data), bool), 100)
    assert (places == again).all() and (whole == cut).all()
    first, last, _, _ = substrings.runs(data, ends, 100)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    inside = [i for i in range(len(text) - 199) if not 1000 - 200 < i < 1000]
    assert covered.tolist() == inside
