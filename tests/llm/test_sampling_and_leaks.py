import os
import random
import re
import subprocess
import sys
from collections import defaultdict

import pytest
from texts import SCHEMA, documents, prose

from hearlog.llm.common import running_total
from hearlog.llm.decontaminate import UNITS, contaminated, leaks
from hearlog.llm.mixing import pareto_mix


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    target, left = {}, float(sum(sizes.values()))
    rest = list(names)
    while rest:
        total = sum(weight[s] for s in rest)
        full = [s for s in rest if left * weight[s] / total > most * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in rest}
            break
        for s in full:
            target[s] = float(most * sizes[s])
            rest.remove(s)
        left -= sum(target[s] for s in full)
    return target


def check_mix(rows, sizes, slack=1):
    target, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - target[source]) <= slack


def test_mix_meets_targets(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    sizes = defaultdict(int)
    for _, text, _, source, *_ in documents():
        sizes[source] += len((text or "").split())
    rows = pareto_mix(docs).collect()
    assert len(rows) == len(documents())
    check_mix(rows, sizes)
    assert sorted(map(str, rows)) == sorted(map(str, pareto_mix(docs.repartition(5)).collect()))
    assert pareto_mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix_of_a_hot_source_and_many_small_ones(spark):
    rows = [(n, prose(n, 1 + n % 40), "big" if n % 3 else f"s{n % 20}") for n in range(900)]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pareto_mix(docs).collect()
    check_mix(got, sizes)
    big = [r for r in got if r.source == "big"]
    share = sum(r.taken for r in big) / sum(r.size for r in big)
    # whole copies for all, one more for some, at most one document cut
    assert sum(r.taken not in (int(share) * r.size, (int(share) + 1) * r.size) for r in big) <= 1
    short, long = [[r for r in big if (r.size < 20) == small] for small in (True, False)]
    for part in (short, long):
        assert sum(r.taken for r in part) / sum(r.size for r in part) == pytest.approx(share, abs=0.12)


def test_mix_prefers(spark):
    rows = [(n, "one two three four", "a", 3.0 if n < 100 else 1.0) for n in range(400)]
    rows += [(1000 + n, "one two three four", "b", None) for n in range(400)]
    got = pareto_mix(
        spark.createDataFrame(rows, "doc_id long, text string, source string, p double"), weights=(1, 3), preference_col="p"
    ).collect()
    a = [r for r in got if r.source == "a"]
    assert sum(r.taken for r in a) == 800
    liked, others = [[r.taken for r in a if (r.doc_id < 100) == first] for first in (True, False)]
    assert sum(liked) / 100 > 1.7 * sum(others) / 300


def test_mix_without_words(spark):
    rows = [(1, None, "a"), (2, " ", None)]
    got = pareto_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in got} == {(0, 0, 0.0, 0)}


def test_running_total_is_exact(spark):
    from pyspark.sql import functions as F

    rows = [("hot" if n % 3 else None, n * 7919 % 1000, n % 5) for n in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    got = {(r.g, r.o): r.before for r in running_total(df, ["g"], ["o"], F.col("v")).collect()}
    for group in ("hot", None):
        before = 0
        for g, o, v in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
            assert got[g, o] == before
            before += v


ITEMS = [
    (1, "A train leaves the old station at 9 and travels 120 km to Paris before it stops for 15 minutes there."),
    (2, "What is the boiling point of water at sea level"),
    (3, "two words"),
    (4, None),
    (5, "Mix 3 kg of flour with 3 kg of sugar and 5 kg of butter, then bake it slowly for hours."),
]


def test_leaks(spark):
    docs = [
        (0, prose(1, 50) + " " + ITEMS[0][1] + " " + prose(2, 50)),
        # new numbers and names, consistently
        (1, "Intro. A train leaves the old station at 7 and travels 340 km to Rome before it stops for 20 minutes there. End."),
        (2, "so: WHAT is the boiling point, of water (at sea level)"),
        (3, prose(3, 200)),
        (4, None), (5, ""), (6, "two words"),
        # 3 stands for 4 and for 6: another recipe
        (7, "Mix 4 kg of flour with 6 kg of sugar and 5 kg of butter, then bake it slowly for hours."),
        (8, "Mix 4 kg of flour with 4 kg of sugar and 9 kg of butter, then bake it slowly for hours."),
        (9, "A train leaves the old station at 9 and then nothing happens " + prose(4, 30)),
        (10, ITEMS[1][1] + ". " + ITEMS[4][1]), (10, ITEMS[1][1] + ". " + ITEMS[4][1]),
        (None, ITEMS[1][1]), (None, "clean"),
    ]
    frame = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, item string, item_id long")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc long")
    got = contaminated(frame, items).collect()
    assert len(got) == len(docs)
    flagged = {(r.doc_id, r.item_id, r.n_items) for r in got if r.contaminated}
    assert flagged == {(0, 1, 1), (1, 1, 1), (2, 2, 1), (6, 3, 1), (8, 5, 1), (10, 2, 2), (None, 2, 1)}
    assert sum(r.doc_id == 10 for r in got) == 2
    assert all(r.coverage >= 0.5 for r in got if r.contaminated)


def test_rows_that_share_an_id_leak_on_their_own(spark):
    import corpus_pipeline

    rows = [(None, ITEMS[1][1]), (None, "clean"), (7, ITEMS[1][1]), (7, "clean as well"), (8, "more")]
    # one item's windows in two recipes of one id, each with values of its own
    rows += [(9, ITEMS[4][1].replace("3", n)) for n in "46"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contaminated(docs, items).collect()
    assert sorted(map(str, [(r.doc_id, r.contaminated) for r in got])) == sorted(map(str, [
        (None, True), (None, False), (7, True), (7, False), (8, False), (9, True), (9, True),
    ]))
    table, corpus_pipeline.queries.table = corpus_pipeline.queries.table, lambda *_: items
    try:
        kept = corpus_pipeline.decontaminate(spark, docs, "").collect()
    finally:
        corpus_pipeline.queries.table = table
    assert sorted(r.text for r in kept) == ["clean", "clean as well", "more"]


def test_leaks_without_broadcast(spark, monkeypatch):
    from hearlog.llm import decontaminate

    docs = spark.createDataFrame([(0, ITEMS[0][1]), (1, prose(1, 90))], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = leaks(docs, items).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert leaks(docs, items).collect() == want and len(want) == 1


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(0, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(none, items).count() == 0
    assert [r.contaminated for r in contaminated(docs, empty).collect()] == [False]


def brute_tokens(text):
    """(type, value) of the tokens of an ASCII text; the type of a plain word is the word."""
    found = []
    for match in re.finditer(r"\d+(?:[.,]\d+)*|[A-Za-z]+", text or ""):
        word, start = match[0], match.start()
        if word[0].isdigit():
            found.append(("#", word))
        elif found and found[-1][0] == "#" and word in UNITS and text[:start].rstrip(" ")[-1:].isdigit():
            found.append(("%", word))
        elif re.fullmatch(r"[A-Z][a-z]+", word) and re.search(r"[a-z\d,;:] $", text[:start]):
            found.append(("@", word))
        else:
            found.append((word.lower(), word))
    return found


def brute_leaks(docs, items, window=8, least=4):
    """(doc, item, covered share) of everything held, by trying every window at every place."""
    held = set()
    for doc, text in docs:
        tokens = brute_tokens(text)
        for item, item_text in items:
            own = brute_tokens(item_text)
            n = min(window, len(own))
            shifts = {}
            for a in range(len(own) - n + 1 if own else 0):
                cut = own[a:a + n]
                plain = sum(t not in "#@%" for t, _ in cut)
                exact = plain < least or 2 * plain < n
                for b in range(len(tokens) - n + 1):
                    other = tokens[b:b + n]
                    column = 1 if exact else 0
                    if [t[column].lower() for t in cut] == [t[column].lower() for t in other]:
                        shifts.setdefault(b - a, []).append((a, list(zip(cut, other, strict=True))))
            covered = set()
            for matches in shifts.values():
                stands_for = {}
                for _, pairs in matches:
                    for (kind, value), (_, other) in pairs:
                        if kind in "#@%":
                            stands_for.setdefault((kind, value.lower()), set()).add(other.lower())
                if all(len(values) == 1 for values in stands_for.values()):
                    covered |= {a for a, _ in matches}
            if own and len(covered) >= 0.5 * (len(own) - n + 1):
                held.add((doc, item, round(len(covered) / (len(own) - n + 1), 9)))
    return held


def test_leaks_equal_trying_every_window(spark):
    rng = random.Random(9)
    words = "add the of and to Rome Ann km kg 3 4 7.5 1,250 12 3 sum is a what".split()

    def text(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "?"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 5, 8, 9, 14]))) for i in range(40)] + [(90, ""), (91, None), (92, "?!")]
    docs = []
    for d in range(120):
        held = rng.choice(items)[1] or ""
        changed = re.sub(r"\b3\b", rng.choice(["3", "9", "2.25"]), held)
        docs.append((d, f"{text(rng.randrange(12))} {rng.choice([held, changed, changed.upper()])} {text(rng.randrange(12))}"))
    want = brute_leaks(docs, items)
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc, r.item, round(r.coverage, 9)) for r in got} == want and len(got) == len(want)
    assert len(want) > 150 and len({item for _, item, _ in want}) > 25


def test_leaks_over_the_borders_of_pieces(spark, monkeypatch):
    from hearlog.llm import decontaminate

    item = ITEMS[0][1]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(n, f"{prose(n, n)} {item} {prose(n, 9)}") for n in range(decontaminate.PIECE - 25, decontaminate.PIECE + 5)]
    docs.append((0, f"{prose(1, 300)} {item}"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc, r.coverage) for r in leaks(frame, items).collect()} == {(n, 1.0) for n, _ in docs}
    rng = random.Random(4)
    held = [(i, " ".join(rng.choice("a sum of 3 kg and Rome".split()) for _ in range(n))) for i, n in enumerate((1, 3, 8, 13))]
    docs = [(d, f"{prose(d, d % 11)} {rng.choice(held)[1]} {prose(d, 3)} {rng.choice(held)[1]}") for d in range(40)] + [(90, ""), (91, None)]
    want = brute_leaks(docs, held)
    assert len(want) > 40
    for places in (1, 5):
        monkeypatch.setattr(decontaminate, "PIECE", places)
        got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(held, "item_id long, text string"))
        assert {(r.doc, r.item, round(r.coverage, 9)) for r in got.collect()} == want


_LONG = """
from pyspark.sql import SparkSession
from hearlog.llm.decontaminate import contaminated
spark = (
    SparkSession.builder.master("local[1]").config("spark.driver.memory", "600m").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC")
    .config("spark.checkpoint.dir", "shared").config("spark.sql.warehouse.dir", "tables").getOrCreate()
)
item = "A train leaves the old station at 9 and travels 120 km to Paris before it stops for 15 minutes there."
docs = spark.createDataFrame([(0, " ".join([item] * 600)), (1, "clean")], "doc_id long, text string")
items = spark.createDataFrame([(1, item)], "item_id long, text string")
print([(r.doc_id, r.n_items) for r in contaminated(docs, items).collect()])
"""


def test_a_long_document_of_matching_places_needs_little_memory(tmp_path):
    """12,000 tokens, each a place where a window of the item begins; with the whole text beside each it took GBs."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    ran = subprocess.run([sys.executable, "-c", _LONG], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert ran.stdout.strip() == "[(0, 1), (1, 0)]", ran.stderr[-2000:]


@pytest.mark.parametrize("item, held, clean", [
    ("What is 3 + 4 * 5?", "x What is 3 + 4 * 5? y", "x What is 3 + 4 * 6? y"),
    ("Capital of France", "Capital of France", "Capital of Spain, France"),
    ("She ran 5 km and then 3 km before lunch on Monday.", "She ran 7.5 km and then 2.5 km before lunch on Monday.",
     "She ran 7.5 km or even 2.5 km after lunch on Monday."),
    ("Pay 1,250 euros of 2,000 euros that you owe by the end.", "Pay 10.50 euros of 20 euros that you owe by the end.",
     "Pay 10.50 euros of 20 kg that you owe by the end."),
])
def test_short_numeric_and_decimal_items(spark, item, held, clean):
    docs = spark.createDataFrame([(1, held), (2, clean)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in contaminated(docs, items).collect() if r.contaminated] == [1]
