import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import SCHEMA, documents, prose

from hearlog.llm import html, pii
from hearlog.llm.quotes import link_quotes

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(part) <= 255 for part in text.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute_spans(text):
    found = [
        (m.start(), number, m.end(), kind)
        for number, (kind, pattern) in enumerate(PATTERNS.items()) for m in re.finditer(pattern, text) if passes(kind, m[0])
    ]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


CASES = [
    "mail a.b+c@x-y.example.com, or a@b or @c.d or a@b@c.de", "ip 1.2.3.4.5.6.7.8 256.1.1.1 000.01.2.255 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4465758382889437 4465758382889437", "+1 (743) 555-3824 +12 +1-2-3-4-5-6-7-8-9-0.",
    "字 x@y.z \U0001f600 +49 30 1234567 ", "@@..@a.b.@c.d", "1" * 50, "a" * 3000 + "@", "",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_of_cases(text):
    assert pii.base_spans(text) == brute_spans(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1240+@.- (\n%_é", max_size=60))
def test_base_spans_equal_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_find_on_awkward_rows(spark):
    rows = documents() + [(50 + n, text, "en", "a", 1, "d", "c", "r") for n, text in enumerate(CASES)]
    got = pii.find(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, text, *_ in rows:
        spans = brute_spans(text or "")
        listed = ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
        want[i, hashlib.sha256(listed.encode()).hexdigest()] = [sum(s[2] == kind for s in spans) for kind in PATTERNS]
    for r in got:
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == want[r.doc_id, r.base_sha256]
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture(scope="module")
def disclosed(spark):
    """ann@x.org always stands near "zephyrine", which hardly occurs elsewhere, and near "the"."""
    rows = [(n, f"{prose(n, 30)} the zephyrine Quark77 wrote to ann@x.org {prose(900 + n, 30)}") for n in range(8)]
    rows += [(100 + n, prose(100 + n, 200)) for n in range(40)]
    rows += [(200 + n, "exactly the same context of bob@y.org before work begins") for n in range(9)]  # copies
    rows += [(300, "zephyrine without the address"), (301, None), (302, f"{prose(7, 50)} Li and the Ottoline +1 555 123 4567 walk")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_disclose(spark, disclosed):
    got = {r.doc_id: r for r in pii.find(disclosed).collect()}
    text = {r.doc_id: r.text for r in disclosed.collect()}
    for i in range(8):
        words = {text[i][int(a):int(b)] for kind, a, b in (s.split(":") for s in got[i].spans.split(",")) if kind == "term"}
        assert {"zephyrine", "Quark77", "wrote"} <= words and "the" not in words
        assert got[i].n_term == len(words)
        starts = [int(s.split(":")[1]) for s in got[i].spans.split(",")]
        assert starts == sorted(starts)
    def terms(i):
        return {text[i][int(a):int(b)] for kind, a, b in (s.split(":") for s in got[i].spans.split(",")) if kind == "term"}

    assert all(terms(200 + n) == {"exactly", "same", "context", "of"} and got[200 + n].n_email == 1 for n in range(9))
    assert terms(302) == {"Li", "Ottoline"}  # beside a number that is seen once; "and", "the" and "walk" are common
    assert got[300].spans == got[301].spans == ""


def test_disclosure_equals_brute_force_count(spark):
    """Random words around few entities, entities beside each other and repeated in a text."""
    rng = random.Random(5)
    entities = ["ann@x.org", "Ann@X.org", "10.0.0.1", "+49 30 1234 5678", "bo@y.de"]
    vocabulary = ["the"] * 40 + ["and"] * 20 + [f"w{n}" for n in range(300)] + ["x", "É"]
    texts = [None, ""]
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words.insert(rng.randint(0, len(words)), rng.choice(entities))
        texts.append(" ".join(words))
    texts += texts[-10:]
    reach, least = 4, 0.4
    together, mentions, frequency = Counter(), Counter(), Counter()
    for text in (t or "" for t in texts):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        frequency.update(text[a:b].lower() for a, b in words)
        spans = brute_spans(text)
        near = set()
        for a, b, kind in spans:
            entity = (kind, re.sub("[^0-9.]", "", text[a:b]) if kind != "email" else text[a:b].lower())
            mentions[entity] += 1
            around = [w for w in words if w[1] <= a][-reach:] + [w for w in words if w[0] >= b][:reach]
            near |= {(entity, w) for w in around if all(w[1] <= c or w[0] >= d for c, d, _ in spans)}
        together.update((entity, text[a:b].lower()) for entity, (a, b) in near)
    windows = sum(frequency.values()) / (2 * reach)
    want = {}
    for (entity, word), k in together.items():
        information = math.log2(min(1, k / (frequency[word] + 0.5)) / (mentions[entity] / windows))
        share = information / math.log2(windows / mentions[entity])
        if share >= least:
            want[pii._digest(*entity), pii.term_digest(word)] = share
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    near = [(n["entity"], n["mentions"], n["terms"]) for (t,) in docs.collect()
            for n in pii.occurrences(t or "", pii.base_spans(t or ""), reach)]
    near = spark.createDataFrame(near, "entity long, mentions long, terms array<struct<term:long,start:int,end:int>>")
    got = {(r.entity, r.term): r.share for r in pii.disclosing_terms(near, docs, reach, least).collect()}
    assert got == pytest.approx(want) and len(got) > 20 and len(got) < len(together)


def test_terms_without_broadcast(disclosed, monkeypatch):
    want = sorted(map(tuple, pii.find(disclosed).collect()))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, pii.find(disclosed).collect())) == want


def test_sanitise(disclosed):
    text = {r.doc_id: r.text for r in pii.sanitise(disclosed).collect()}
    assert "ann@x.org" not in text[3] and "[EMAIL]" in text[3] and "zephyrine" not in text[3] and "[NUMBER]" in text[3]
    assert text[300] == "zephyrine without the address" and text[301] == ""


def test_occurrences_reach_past_long_words():
    text = "one two " + "x" * 900 + " a@b.cd " + "y" * 900 + " three"
    near = list(pii.occurrences(text, pii.base_spans(text), 3))
    assert [text[t["start"]:t["end"]][:3] for t in near[0]["terms"]] == ["one", "two", "xxx", "yyy", "thr"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><h1>Site</h1><nav><a href="/">Home</a></nav></header>
<div class="cookie-banner"><p>We use cookies, as all do. Accept, please.</p></div>
<div id="wrap"><div class="content"><h1>My  Story</h1><div class="body">
<p>First paragraph, with <b>some</b> text &amp; more; long enough, one may hope.
<p>Second &mdash; with <a href="x">a link</a>, yes.<br>And a break.
<!-- <p>no</p> --><ul><li>One<li>Two</ul><script>var a = "<p>never</p>";</script>
<aside><p>Read also: another, quite different story, with commas, and more.</p></aside>
<div class="share">Share this!</div><table><tr><td>a<td>b</table></div></div>
<div class="sidebar"><ul><li><a href="/1">Related story one, with punctuation.</a></li></ul></div></div>
<section id="comments"><p>Great post! I liked it, very much. Thank you, author.</p></section>
<form>Name: <input></form><footer>(c) 2020 foo, bar. All rights reserved.</footer></body></html>"""


def test_main_text_of_a_page_without_article_element():
    assert html.main_text(PAGE).split("\n") == [
        "My Story", "First paragraph, with some text & more; long enough, one may hope.",
        "Second — with a link, yes. And a break.", "One", "Two", "a", "b",
    ]


def test_main_text_of_an_article_element():
    page = (
        "<body><nav>Menu, of course. And more, and more, and more.</nav><main><article><header><h1>Title</h1><p>By Ann</p></header>"
        "<p>Short.</p><div class='ad'>Buy, buy, buy! Now, at once.</div><p>Les.</p><footer>Filed, under, things.</footer></article></main>"
        "<p>A long text outside, with many words, and commas, too; it is longer than all of the article.</p></body>"
    )
    assert html.main_text(page) == "Title\nShort.\nLes."


@pytest.mark.parametrize("page", [
    None, "", "   ", "<", "<p", "</p></div>", "<!--", "<script>", "<p>" * 3000, "<a href='x>y", "<div hidden>secret, text.</div>",
])
def test_main_text_of_nothing(page):
    assert html.main_text(page) in ("", "<", "<p", "<a href='x>y", "y")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pbdiv'\"=! a&;-\n", max_size=80))
def test_main_text_never_fails(page):
    text = html.main_text(page)
    assert text == text.strip() and "\n\n" not in text


def test_extract_table(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "<p>Ünï \U0001f600 &#233;</p>", "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert {(r.page_id, r.url, r.text) for r in got if r.page_id != 1} == {(2, None, ""), (None, "v", "Ünï \U0001f600 é")}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


MESSAGES = [
    (1, 0, "a", "Hello there my friend.\nHow are you today?"),
    (1, 1, "b", "> Hello there my friend.\nGood day to you.\n"),
    (1, 2, "c", "New topic: we start again."),
    (1, 3, "a", "On Monday, Ann wrote:\n> > Hello there my friend.\n> Good day to you.\nThanks a lot really."),
    (1, 4, "d", ">new topic, we START again\nYes do that please."),
    (1, 5, "e", "> Nobody ever said these words\nWhat?"),
    (1, 6, "f", None),
    (1, None, "z", "> Hello there my friend."),
    (None, 0, "x", "Null conversation speaks here"), (None, 1, "y", "> null conversation speaks here\nok"),
    (2, 0, "a", ""), (2, 0, "a", ""),
]


def test_quotes(spark):
    frame = spark.createDataFrame([(*m, 9, "x") for m in MESSAGES], "conv_id long, turn long, role string, text string, thread long, g string")
    got = link_quotes(frame).collect()
    assert len(got) == len(MESSAGES)
    rows = {(r.conv_id, r.turn, r.role): r for r in got}
    assert {k[1]: r.reply_to for k, r in rows.items() if k[0] == 1} == {0: None, 1: 0, 2: None, 3: 1, 4: 2, 5: None, 6: None, None: None}
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)] == [0, 1, 3, 2, 4, 5, 6, None]
    assert [rows[1, t, k].thread for t, k in ((0, "a"), (1, "b"), (3, "a"), (4, "d"))] == [0, 0, 0, 2]
    assert rows[1, 3, "a"].body == "Thanks a lot really." and rows[1, 3, "a"].quote_depth == 2 and rows[1, 3, "a"].n_linked == 2
    assert rows[1, 1, "b"].body == "Good day to you." and rows[1, 6, "f"].body == ""
    assert rows[None, 1, "y"].reply_to == 0
    assert sorted(r.position for r in got if r.conv_id == 2) == [0, 1]
    assert link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


LONG = "The old harbour lies behind the mill, and nobody has sailed from it in years. Shall we go and see it?"


@pytest.mark.parametrize("quotation, answered, found", [
    ("> The old harbour lies behind\n> the mill, and nobody has sailed\n> from it in years. Shall we go\n> and see it?", 0, 2),  # wrapped anew
    ("> shall we go and see it", 0, 1),  # one sentence of a longer line
    ("> behind the mill, and\n> nobody has sailed", 0, 1),  # a part of a sentence
    ("> Ok.", 1, 1), ("> Fine\n> by me", 1, 1),  # short ones
    ("> Ok. The old harbour lies behind the mill", 0, 2),  # the original with most of it
    ("> Ok.\n>\n> by me", 1, 2),  # lines that a mark without words parts
    (">> The old harbour lies behind\n> Ok.", 1, 2),  # deeper levels are the original's own
    ("> the mill behind lies harbour old\n> in years sailed nobody it", None, 0),
])
def test_quotes_wrapped_anew_and_in_part(spark, quotation, answered, found):
    rows = [(1, 0, "a", LONG), (1, 1, "b", "Ok.\n\nFine\nby me"), (1, 2, "c", quotation + "\nmy own words")]
    rows += [(2, 0, "a", "elsewhere"), (2, 1, "b", quotation)]
    got = {(r.conv_id, r.turn): r for r in link_quotes(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2].reply_to == answered and got[1, 2].n_linked == found and got[1, 2].body == "my own words"
    assert got[2, 1].reply_to is None and got[2, 1].n_linked == 0 and got[2, 1].n_quoted >= found


def test_quotes_in_a_long_hot_conversation(spark):
    """Each message quotes the one before: a chain as long as the conversation."""
    rows = [(1, n, "a", (f"> message number {n - 1} of this talk\n" if n else "") + f"Message number {n} of this talk") for n in range(70)]
    rows += [(2, n, "a", "> a passage that all of them quote\nmine is different" if n else "A passage that all of them quote") for n in range(50)]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.thread == 0 and r.position == r.turn for r in got)
    assert all(r.reply_to == (r.turn - 1 if r.conv_id == 1 else 0) for r in got if r.turn)


def test_main_text_in_layouts_and_comments():
    page = (
        "<body class='has-sidebar'><div class='layout with-sidebar'><div id='content'><h1>Title</h1><p>First, with text.</p>"
        "<p>Second, with more of it.</p></div><div class='sidebar'><p>Side.</p></div></div>"
        "<article class='comment'><p>What a long comment, really; it never ends, does it? No.</p></article></body>"
    )
    assert html.main_text(page) == "Title\nFirst, with text.\nSecond, with more of it."


@pytest.mark.parametrize("page", [
    '<a ' + '"' * 5_000, "<a" * 100_000, "<p " * 50_000 + ">", "<!-- " * 50_000, '<p x="' * 3_000 + ">end", "<div>" * 2_000 + "deep",
    "<div>" * 100_000 + "text, here.", "<article><p>a b c.</p></article>" * 20_000, "<div>" * 20_000 + "<li>x</li>" * 20_000,
    "<div><h2>x</h2>" * 20_000 + "<p>body text, long.</p>",
])
def test_hostile_pages_take_linear_time(page):
    import time

    started = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - started < 5


BODY = "".join(f"<p>This is paragraph {n} of the article itself, with text, commas, and more words.</p>" for n in range(5))
READERS = "".join(f"<article class='comment'><p>I, too, am a reader, number {n}, and I have words to add.</p></article>" for n in range(30))


@pytest.mark.parametrize("page", [
    "<article class='post category-popular'>{}</article>", "<div class='site comments-open'><nav>a b</nav><article>{}</article></div>",
    "<div id='page' class='has-ads'>{}</div>", "<main><div class='popular-post'>{}</div></main>",
    "<div class='trending'><main>{}</main></div>",
])
def test_words_of_other_parts_weigh_less_than_the_text(page):
    assert html.main_text(f"<body>{page.format(BODY)}</body>").count("article itself") == 5


@pytest.mark.parametrize("page", [
    "<article>{}</article><div class='comments'>{}</div>", "<article>{}<div id='comments'>{}</div></article>",
    "<div>{}</div><div id='comments'>{}</div>", "<main>{}</main><div class='related'>{}</div>",
    "<main><article>{}</article><section class='replies'>{}</section></main>",
])
def test_readers_stay_out_however_much_they_write(page):
    text = html.main_text(f"<body>{page.format(BODY, READERS)}</body>")
    assert text.count("article itself") == 5 and "reader" not in text


def test_path_scores_by_definition():
    """Text and marks per leaf of each path, smoothed over neighbours and fused."""
    page = "<body><div class='a'><p>One, two. <a href='x'>three</a></p><p>Four</p></div><ul><li><a href='y'>Five, six</a><li>Seven.</ul><p>Eight; nine!</p></body>"
    elements, leaves = html.parse(page)

    def path(number):
        element = elements[number]
        return () if element.parent < 0 else (*path(element.parent), element.path)

    own = [path(leaf.element) for leaf in leaves]
    ratios = []
    for mine in own:
        same = [leaf for leaf, other in zip(leaves, own, strict=True) if other == mine]
        text = sum(len(leaf.text) - leaf.linked for leaf in same) / len(same)
        marks = sum(sum(c in ".,;:!?" for c in leaf.text) for leaf in same if 2 * leaf.linked < len(leaf.text)) / len(same)
        ratios.append((text, marks))
    smoothed = []
    for n in range(len(own)):
        around = [ratios[max(0, n - 1)], ratios[n], ratios[n], ratios[min(len(own) - 1, n + 1)]]
        smoothed.append([sum(r[k] for r in around) / 4 for k in range(2)])
    assert html.path_scores(elements, leaves) == pytest.approx([text * (1 + marks) for text, marks in smoothed])
    assert len(leaves) == 5 and len(set(own)) == 3
