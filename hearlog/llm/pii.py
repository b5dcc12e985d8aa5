"""Personal data: base patterns, and terms that give them away (operator 6).

Information-theoretic sanitisation: an entity (a mail address, a number) is protected. A
term near it discloses the entity as far as its pointwise mutual information with it,
estimated from co-occurrence in the corpus, comes near the entity's own information. An
entity that is seen once counts too: then the term's frequency in the corpus decides.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearlog.llm.common import record_batches
from hearlog.session import durable

#: Kinds in the order in which spans with the same start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "term")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")

#: Candidate terms up to which they are sent to every executor (64 MB at most); beyond it,
#: the corpus counts of all words are joined by shuffling.
BROADCAST_TERMS = 4_000_000

Span = tuple[int, int, str]


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    A match has one @, with all that may stand before it; so each @ is tried once, and a
    long run of letters costs no more than its length.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind; offsets are code points, the end is exclusive."""
    spans = list(emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                spans.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                    spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _digest(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts), 42) - (1 << 63)


def term_digest(term: str) -> int:
    """Equal to Spark's xxhash64 of the lower-cased term."""
    value = xxhash.xxh64_intdigest(term.lower(), 42)
    return value - (1 << 64) if value >> 63 else value


def occurrences(text: str, spans: list[Span], reach: int) -> Iterator[dict]:
    """Per protected entity in the text: its mentions, and the words near any of them.

    Near are the words up to ``reach`` places before and behind a mention; words that are
    part of a base span are none. A word near two mentions of an entity is listed once.
    """
    covered = sorted((a, b) for a, b, _ in spans)
    opens = [a for a, _ in covered]
    reached = list(accumulate((b for _, b in covered), max))

    def free(start: int, end: int) -> bool:
        ahead = bisect_left(opens, end)
        return not ahead or reached[ahead - 1] <= start

    entities: dict[int, tuple[list, set]] = {}
    for start, end, kind in spans:
        value = text[start:end].lower() if kind == "email" else re.sub(r"[^0-9.]", "", text[start:end])
        # A word is at least one character and rarely over 40; more text is taken where that fails.
        width = 40 * reach
        while True:
            before = list(_TERM.finditer(text, max(0, start - width), start))
            behind = list(_TERM.finditer(text, end, min(len(text), end + width)))
            whole = width >= max(start, len(text) - end)
            if whole or (len(before) > reach and len(behind) > reach):
                break
            width *= 4
        mentions, near = entities.setdefault(_digest(kind, value), ([], set()))
        mentions.append(start)
        near.update((m.start(), m.end()) for m in before[-reach:] + behind[:reach] if free(m.start(), m.end()))
    for entity, (mentions, near) in entities.items():
        terms = [{"term": term_digest(text[a:b]), "start": a, "end": b} for a, b in sorted(near)]
        yield {"entity": entity, "mentions": len(mentions), "terms": terms}


_TERMS = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.schema([
    ("row", pa.int64()), ("doc", pa.int64()),
    ("base", pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))),
    ("near", pa.list_(pa.struct([("entity", pa.int64()), ("mentions", pa.int64()), ("terms", _TERMS)]))),
    ("text", pa.string()),
])
_FOUND_DDL = (
    "row long, doc long, base array<struct<start:int,rank:int,end:int>>, "
    "near array<struct<entity:long,mentions:long,terms:array<struct<term:long,start:int,end:int>>>>, text string"
)


def _find(reach: int, keep_text: bool):
    def rows(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                spans = base_spans(text)
                base = [{"start": a, "rank": KINDS.index(kind), "end": b} for a, b, kind in spans]
                yield number, doc.as_py(), base, list(occurrences(text, spans, reach)), text if keep_text else None
                number += 1

    return lambda batches: record_batches(rows(batches), _FOUND, 1024)


def disclosing_terms(near: DataFrame, texts: DataFrame, reach: int, disclosure: float) -> DataFrame | None:
    """``(entity, term, share)``, share >= ``disclosure``: terms that disclose an entity; None if nothing can.

    The corpus has W = words / (2 ``reach``) windows. An entity with m mentions has the
    information log2(W / m), as p(entity) = m / W. Of a term that occurs f times, k of them
    near the entity, p(entity | term) is estimated as k / (f + 1/2), at most 1, and its
    mutual information with the entity is log2(p(entity | term) / p(entity)). ``share`` is
    the ratio of the two. Copies of a document raise k, f and m alike, so they neither
    hide a term nor make it evidence. An entity in every window has no information and is
    not disclosed.
    """
    pairs = durable(
        near.select("entity", F.explode("terms.term").alias("term"))
        .groupBy("entity", "term").agg(F.count("*").alias("together"))
    )
    terms = durable(pairs.groupBy("term").agg(F.max("together").alias("least")))
    known = terms.count()
    if not known:
        return None
    entities = near.groupBy(F.col("entity").alias("e")).agg(F.sum("mentions").alias("m"))
    words = texts.select(
        F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")
    ).where("word <> ''").select(F.xxhash64("word").alias("word"))
    if known <= BROADCAST_TERMS:
        # words that are no candidates meet in one null, whose count completes the total
        counted = (
            words.join(F.broadcast(terms.select("term")), F.col("word") == F.col("term"), "left")
            .groupBy("term").agg(F.count("*").alias("frequency"))
        )
    else:
        counted = words.groupBy("word").agg(F.count("*").alias("frequency")).withColumnRenamed("word", "term")
    counted = durable(counted)
    windows = counted.agg((F.sum("frequency") / (2.0 * reach)).alias("windows"))
    # A term that lower-cases otherwise in the two languages is counted by its mentions.
    frequent = terms.join(counted.withColumnRenamed("term", "t"), F.col("term") == F.col("t"), "left").select(
        F.col("term").alias("t"), F.greatest("frequency", "least").alias("f")
    )
    given = F.least(F.lit(1.0), F.col("together") / (F.col("f") + 0.5))
    own = F.log2(F.col("windows") / F.col("m"))
    # What would not disclose even an entity of one mention does not meet the entities.
    possible = F.log2(given) >= (disclosure - 1) * F.log2("windows") - 1e-9
    return (
        pairs.join(frequent, F.col("term") == F.col("t"))
        .crossJoin(F.broadcast(windows))  # one row
        .where(possible)
        .join(entities, F.col("entity") == F.col("e"))
        .where(F.col("windows") > F.col("m"))
        .select("entity", "term", (1 + F.log2(given) / own).alias("share"))
        .where(F.col("share") >= disclosure)
    )


def find(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    reach: int = 10,
    disclosure: float = 0.9,
    keep_text: bool = False,
) -> DataFrame:
    """One row per document: counts of the base kinds, ``base_sha256``, ``spans``, ``n_term``.

    Base spans are ``base_spans``; the method adds spans of kind ``term``, words near an
    entity that disclose at least the share ``disclosure`` of its information (see
    ``disclosing_terms``). ``spans`` lists all as kind:start:end, by start, then kind;
    ``base_sha256`` is the digest of the same list of base spans only. With ``keep_text``
    the text stays beside them, for ``sanitise``.

    A null text is empty. Rows with equal ids are rows of their own, a null id stays null.
    Extra columns are not read. Entities of any frequency are spread over tasks: pairs are
    counted with partial sums, and joins are on (entity, term).
    """
    found = durable(
        docs.select(F.col(id_col).cast("long"), F.col(text_col))
        .mapInArrow(_find(reach, keep_text), _FOUND_DDL)
    )
    near = found.select("row", F.explode("near").alias("n")).select("row", "n.*")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = disclosing_terms(near, texts, reach, disclosure)
    rank = KINDS.index("term")
    if pairs is None:
        whole = found.withColumn("all", F.col("base"))
    else:
        pairs = durable(pairs.select("entity", "term"))
        added = (
            near.select("row", "entity", F.explode("terms").alias("t"))
            .select("row", "entity", "t.term", "t.start", "t.end")
            .join(pairs, ["entity", "term"])
            .groupBy("row")
            .agg(F.collect_set(F.struct("start", F.lit(rank).alias("rank"), "end")).alias("added"))
            .withColumnRenamed("row", "r")
        )
        whole = found.join(added, F.col("row") == F.col("r"), "left").withColumn(
            "all", F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")))
        )
    names = F.array(*[F.lit(kind) for kind in KINDS])

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ","
        )

    def number(kind: str):
        return F.size(F.filter("all", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return whole.select(
        F.col("doc").alias(id_col),
        *[number(kind) for kind in BASE_KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("all")).alias("spans"),
        number("term"),
        *([F.col("text").alias(text_col)] if keep_text else []),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents' ids and texts with every span of ``find`` generalised or removed.

    Entities become the name of their kind in brackets, as [EMAIL]. Of terms, those with a
    digit become [NUMBER], capitalised ones [NAME]; others are removed.
    """
    found = find(docs, id_col, text_col, keep_text=True, **settings)
    arrow = pa.schema([("doc", pa.int64()), ("text", pa.string())])

    def clean(text: str, spans: str) -> str:
        parts, at = [], 0
        for span in spans.split(",") if spans else []:
            kind, start, end = span.split(":")
            start, end = int(start), int(end)
            if start < at:
                at = max(at, end)
                continue
            word = text[start:end]
            put = f"[{kind.upper()}]"
            if kind == "term":
                put = "[NUMBER]" if _DIGIT.search(word) else "[NAME]" if word[0].isupper() else ""
            parts += [text[at:start], put]
            at = end
        return "".join([*parts, text[at:]])

    def rows(batches):
        for batch in batches:
            for doc, text, spans in zip(*[batch.column(i) for i in range(3)], strict=True):
                yield doc.as_py(), clean(text.as_py(), spans.as_py())

    return found.select(id_col, text_col, "spans").mapInArrow(
        lambda batches: record_batches(rows(batches), arrow, 1024), "doc long, text string"
    ).select(F.col("doc").alias(id_col), F.col("text").alias(text_col))
