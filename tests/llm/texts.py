"""Small document tables with the awkward cases: nulls, empties, long texts, ties, repeats."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, content string, r string"
WORDS = "the sun rises over a quiet town and people walk along its narrow old streets before work begins".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(words))


def documents() -> list[tuple]:
    long = prose(1, 4000)
    rows = [
        (0, prose(2, 60), "en", "a"),
        (1, prose(2, 60), "en", "b"),
        (2, prose(3, 60), "en", "a"),
        (2, prose(3, 60), "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n", "en", "b"),
        (6, long, "en", "c"),
        (7, long + " end", "en", "c"),
        (8, "Word", "en", "é"),
        (9, "word", "de", "Z"),
        (None, prose(2, 60), "en", None),
        (None, "unlike any", "en", "a"),
        (10, prose(4, 80) + " Ünïcödé 字 \U0001f600 " + prose(5, 30), "en", "a"),
        (11, prose(5, 30) + " " + prose(4, 80), None, "a"),
        (12, "a" * 700, "en", "b"),
        (13, "ab" * 300 + "c", "en", "b"),
    ]
    return [(i, t, lang, source, len(t) if t else None, "x", "y", "z") for i, t, lang, source in rows]
