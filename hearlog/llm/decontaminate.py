"""Benchmark decontamination by template canonicalisation (operator 5).

Only DataFrame functions: texts become template tokens, windows of tokens are hashed, and
the hashes of benchmark items find the documents.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearlog.session import durable

#: Units of measurement that are typed when they follow a number.
UNITS = (
    "km cm mm m kg mg g ml cl l h min s ms kmh mph kwh mb gb tb "
    "hour hours minute minutes second seconds day days week weeks month months year years "
    "mile miles foot feet inch inches pound pounds dollar dollars euro euros cent cents percent degrees"
).split()

#: Types of placeholders, and the mark that a typed token begins with.
NUMBER, NAME, UNIT = "#", "@", "%"
_MARKS = NUMBER + NAME + UNIT

#: What a point or comma between two digits becomes, so that a number is one token.
_POINT = "\x1f"

#: Benchmark windows up to which their hashes are sent to every executor (16 bytes each, 64
#: MB at most); beyond it, windows of documents and benchmark are joined by shuffling both.
BROADCAST_WINDOWS = 4_000_000


#: Tokens by which a place is tested before its windows are hashed.
OPENING = 4

#: Places that a text is cut into pieces of. A row per place carries its piece, and Spark holds
#: the rows that it makes of one row at once: with pieces, that is no more for longer texts.
PIECE = 128


def marked_tokens(text: Column) -> Column:
    """The words of a text in order; numbers, names and units keep their value behind a mark.

    Numbers are runs of digits, with points or commas (alike) between digits. Names are capitalised words that follow a lower-case
    letter, a digit or a comma, semicolon or colon, so words that begin a sentence are
    none. Units are known words behind a number.
    """
    bare = F.translate(F.coalesce(text, F.lit("")), _MARKS + _POINT, "    ")
    # The capital comes first in the pattern, so that few places look back.
    named = F.regexp_replace(
        bare, r"(\p{Lu})(?<=[\p{Ll}\p{Nd},;:] \p{Lu})(\p{Ll}+)(?![\p{L}\p{N}])", f"{NAME}$1$2"
    )
    joined = F.regexp_replace(named, r"[.,](?<=\p{Nd}[.,])(?=\p{Nd})", _POINT)
    counted = F.regexp_replace(joined, rf"(\p{{Nd}}[\p{{Nd}}{_POINT}]*)", f" {NUMBER}$1 ")
    measured = F.regexp_replace(
        counted, rf"({NUMBER}[\p{{Nd}}{_POINT}]+) +({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2"
    )
    return F.filter(F.split(measured, rf"[^\p{{L}}\p{{N}}\p{{M}}{_MARKS}{_POINT}]+"), lambda token: token != "")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _is_slot(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(*_MARKS)


def _template_hashes(tokens: Column) -> Column:
    """One number per token: of the mark for a slot, of the lower-cased word otherwise."""
    return F.transform(
        tokens, lambda token: F.xxhash64(F.when(_is_slot(token), F.substring(token, 1, 1)).otherwise(F.lower(token)))
    )


def _bare(token: Column) -> Column:
    """A token as it is compared by itself: in lower case, whatever its type."""
    return F.lower(F.translate(token, _MARKS, ""))


def _opening(hashes: str, at: Column, n: int) -> Column:
    """A hash of the ``n`` tokens that a window begins with."""
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + k) for k in range(n)])


def _window(tokens: Column, hashes: Column, at: Column, n: Column, exact: Column) -> Column:
    """A hash of the window of ``n`` tokens: of the tokens themselves if ``exact``, else of its template."""
    words = F.transform(F.slice(tokens, at + 1, n), _bare)
    return F.when(exact, F.xxhash64(F.lit("exact"), words)).otherwise(F.xxhash64(F.slice(hashes, at + 1, n)))


def _pieces(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(doc, text_sha256, start, tokens)``: the tokens of ``PIECE`` places of a text, and ``window - 1`` more.

    A window of up to ``window`` tokens lies whole in the piece that holds its first one.
    Texts without tokens have no piece.
    """
    tokens = docs.select(
        F.col(id_col).alias("doc"), _digest(F.col(text_col)).alias("text_sha256"),
        marked_tokens(F.col(text_col)).alias("tokens"),
    )
    # A filter on the tokens would be moved ahead of them, and every text be tokenised twice.
    starts = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(PIECE)))
    return tokens.select("doc", "text_sha256", F.explode(F.transform(starts, lambda start: F.struct(
        start.alias("start"), F.slice("tokens", start + 1, F.lit(PIECE + window - 1)).alias("tokens")
    ))).alias("piece")).select("doc", "text_sha256", "piece.start", "piece.tokens")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    coverage: float = 0.5,
    least_words: int = 4,
) -> DataFrame:
    """``(doc, text_sha256, item, coverage)``: the document of that id and text holds the item.

    Both sides are windows of ``window`` template tokens; an item shorter than that is one
    window of its own length. A window with fewer than ``least_words`` plain words, or fewer
    than half as many as it has tokens, says too little as a template: it is matched by its
    tokens themselves, in lower case. Items without any token are held by no document.

    A document and an item are aligned by the distance between matching windows. An
    alignment counts if its slots are consistent: one value of the item (a number, name or
    unit) always stands for the same value in the document. The document holds the item if
    consistent alignments cover at least ``coverage`` of the item's windows.

    Null texts are empty; empty texts hold nothing. Rows are told apart by id and text, so
    rows with equal or null ids hold what their own text does.

    A text is tokenised once and cut into pieces of ``PIECE`` places, which overlap by what a
    window needs. Places are tested for how a window may begin, and only windows at places
    that pass are hashed. So a task's memory does not depend on how many of them pass.
    """
    word_hashes = F.transform("tokens", lambda token: F.xxhash64(_bare(token)))
    items = (
        benchmark.select(F.col(item_col).alias("item"), marked_tokens(F.col(item_text_col)).alias("tokens"))
        .where(F.size("tokens") > 0).distinct().withColumns({"hashes": _template_hashes(F.col("tokens")), "words": word_hashes})
    )
    n = F.least(F.size("tokens"), F.lit(window))
    placed = items.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("tokens") - n)).alias("item_at"))
    item_tokens = F.slice("tokens", F.col("item_at") + 1, F.col("n"))
    placed = placed.withColumn("item_tokens", item_tokens)
    plain = F.size(F.filter("item_tokens", lambda token: ~_is_slot(token)))
    placed = placed.withColumn("exact", (plain < least_words) | (plain * 2 < F.col("n")))
    own = durable(placed.select(
        "item", "item_at", "n", "exact", "item_tokens",
        F.coalesce(*[
            F.when((F.col("n") >= k) & (F.col("exact") == exact), _opening("words" if exact else "hashes", F.col("item_at"), k))
            for k in range(OPENING, 0, -1) for exact in (True, False)
        ]).alias("opening"),
        _window(F.col("tokens"), F.col("hashes"), F.col("item_at"), F.col("n"), F.col("exact")).alias("window"),
    ))
    # There are at most ``window`` lengths, matched in two ways.
    kinds = sorted((row["n"], row["exact"]) for row in own.select("n", "exact").distinct().collect())

    def known(column: str) -> DataFrame:
        found = own.select(column).distinct()
        return F.broadcast(found) if found.count() <= BROADCAST_WINDOWS else found

    prepared = _pieces(docs, id_col, text_col, window).withColumn("hashes", _template_hashes(F.col("tokens")))
    if any(exact for _, exact in kinds):
        prepared = prepared.withColumn("words", word_hashes)
    openings = [
        _opening("words" if exact else "hashes", F.col("at"), k) for k, exact in sorted({(min(n, OPENING), exact) for n, exact in kinds})
    ] or [F.lit(0).cast("long")]
    places = prepared.select(
        "*", F.explode(F.sequence(F.lit(0), F.least(F.size("tokens"), F.lit(PIECE)) - 1)).alias("at")
    )
    if len(openings) == 1:
        places = places.withColumn("opening", openings[0])
    else:
        places = places.withColumn("opening", F.explode(F.array(*openings)))
    places = places.join(known("opening"), "opening", "left_semi")
    windows = [
        F.when(F.size("tokens") >= F.col("at") + n, F.struct(
            F.lit(n).alias("n"), _window(F.col("tokens"), F.col("hashes"), F.col("at"), F.lit(n), F.lit(exact)).alias("window")
        )) for n, exact in kinds
    ] or [F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("window"))]
    every = places.select(
        "doc", "text_sha256", "start", "tokens", "at", F.explode(F.filter(F.array(*windows), lambda w: w.isNotNull())).alias("w")
    ).select(
        "doc", "text_sha256", (F.col("start") + F.col("at")).alias("at"), F.col("w.window").alias("window"),
        F.slice("tokens", F.col("at") + 1, F.col("w.n")).alias("doc_tokens"),
    )
    # A place may pass by several openings.
    found = every.join(known("window"), "window", "left_semi").distinct()
    pairs = F.filter(F.arrays_zip("item_tokens", "doc_tokens"), lambda pair: _is_slot(pair["item_tokens"]))
    slots = F.transform(pairs, lambda pair: F.struct(
        F.lower(pair["item_tokens"]).alias("item_tokens"), _bare(pair["doc_tokens"]).alias("doc_tokens")
    ))
    alignments = (
        found.join(own.select("item", "item_at", "item_tokens", "window"), "window")
        .groupBy("doc", "text_sha256", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(
            F.collect_set("item_at").alias("places"),
            F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"),
        )
        .where(
            F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda pair: pair["item_tokens"])))
        )
    )
    windows_of = own.groupBy("item").agg(F.count("*").alias("windows"))
    return (
        alignments.groupBy("doc", "text_sha256", "item")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("covered"))
        .join(windows_of, "item")
        .select("doc", "text_sha256", "item", (F.col("covered") / F.col("windows")).alias("coverage"))
        .where(F.col("coverage") >= coverage)
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """One row per document: ``contaminated``, its number of items, and the best of them.

    The best item is the one covered most, the smallest id among equals. Without benchmark
    rows every document is clean. Settings are those of ``leaks``.
    """
    best = leaks(docs, benchmark, id_col=id_col, **settings).groupBy("doc", "text_sha256").agg(
        F.count("*").alias("n_items"),
        F.min(F.struct(-F.col("coverage"), F.col("item"), F.col("coverage"))).alias("best"),
    )
    return (
        docs.select(F.col(id_col).alias("id"), _digest(F.col(settings.get("text_col", "text"))).alias("digest"))
        .join(best, F.col("id").eqNullSafe(F.col("doc")) & (F.col("digest") == F.col("text_sha256")), "left")
        .select(
            F.col("id").alias(id_col),
            F.col("best").isNotNull().alias("contaminated"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.col("best.item").alias("item_id"),
            F.col("best.coverage").alias("coverage"),
        )
    )
