"""Conversations without quotations, in reply order (operator 3).

Only DataFrame functions: lines are parsed for nested quote marks, neighbouring lines of one
depth are joined to passages, their sentences and word windows are normalised and hashed,
the hashes find the messages that said them first, and the links from answer to original
give the order. How a mail client wraps the lines of a quotation makes no difference.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearlog.llm.common import running_total
from hearlog.session import durable

_MARKS = r"^\s{0,3}((?:>\s{0,3})+)"
#: A line that only introduces a quotation, as "On Monday, Ann wrote:".
_LEAD_IN = r"(?i)^.{0,200}\b(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$"

_SENTENCE_END = r"[.!?…]+[\"')\]]*(\s|$)"
#: Words of a window. Longer sentences are compared by their windows, others as a whole.
WINDOW = 5
_NEXT, _OF = "\x01", "\x02"  # between passages or sentences, and behind a passage's depth


def _depth(line: Column) -> Column:
    """How many quote marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"[^>]", ""))


def _normalised(line: Column) -> Column:
    """What is compared: lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds to ``messages(text)`` its ``lines``: array of (depth, said, words, line), without the text."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), r"\r\n|\r|\n")
    said = lambda line: F.translate(F.regexp_replace(line, _MARKS, ""), _NEXT + _OF, "  ")
    return messages.withColumn("lines", F.transform(
        lines,
        lambda line: F.struct(
            _depth(line).alias("depth"), said(line).alias("said"), _normalised(said(line)).alias("words"), line.alias("line"),
        ),
    ))


def _passages() -> Column:
    """Neighbouring lines of one depth joined by a space; lines without a word part them."""

    def with_border(line: Column, at: Column) -> Column:
        above = F.get("lines", at - 1)
        goes_on = (above["depth"] == line["depth"]) & (above["words"] != "") & (line["words"] != "")
        return F.concat(
            F.when(goes_on, F.lit(" ")).otherwise(F.concat(F.lit(_NEXT), line["depth"].cast("string"), F.lit(_OF))),
            line["said"],
        )

    cut = F.slice(F.split(F.array_join(F.transform("lines", with_border), ""), _NEXT), 2, 1 << 30)
    return F.transform(cut, lambda passage: F.struct(
        F.substring_index(passage, _OF, 1).cast("int").alias("depth"), F.substring_index(passage, _OF, -1).alias("said"),
    ))


def _sentences(said: Column) -> Column:
    """The normalised sentences of a passage that have a word."""
    cut = F.split(F.regexp_replace(said, _SENTENCE_END, _NEXT), _NEXT)
    return F.filter(F.transform(cut, _normalised), lambda words: words != "")


def _units(words: Column) -> Column:
    """Hashes of the windows of a normalised sentence, or of the sentence where it has no more words."""
    each = F.split(words, " ")
    texts = F.when(F.size(each) <= WINDOW, F.array(words)).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(each) - (WINDOW - 1))),
        lambda at: F.array_join(F.slice(each, at, WINDOW), " "),
    ))
    return F.transform(texts, lambda text: F.xxhash64(F.lit("passage"), text))


def _body() -> Column:
    """The message's own lines; a line that only introduces the quotation below it goes too."""
    own = F.transform(
        F.filter(
            F.transform(
                "lines",
                lambda line, at: F.struct(
                    line["line"].alias("line"), line["depth"].alias("depth"),
                    F.coalesce(F.get("lines", at + 1)["depth"], F.lit(0)).alias("next"),
                ),
            ),
            lambda line: (line["depth"] == 0) & ~((line["next"] > 0) & line["line"].rlike(_LEAD_IN)),
        ),
        lambda line: line["line"],
    )
    joined = F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def link_quotes(
    messages: DataFrame,
    group_col: str = "conv_id",
    order_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per message, in reply order: ``position`` within its conversation, ``thread``.

    Columns: group, order and role as given, ``body`` (the text without quotations),
    ``quote_depth`` (deepest level), ``n_quoted`` and ``n_linked`` (different quoted sentences
    per level, and those of them found), ``reply_to`` (the order of the message answered),
    ``thread`` (the order of the message where the chain of answers begins), ``position``
    (from 0).

    Quote marks are > at the start of a line, as often as the level is deep. A passage is
    neighbouring lines of one level without their marks; its sentences are normalised to
    lower-case words. A sentence of up to five words is compared whole, also with such a
    sentence of one line; a longer one by its windows of five words, so part of a sentence
    is found too. The original of a window is the earliest message of the conversation that
    has it in its own text. A message answers the original from which it quotes most windows
    (of equals the latest) at level 1, or at the least level where none is found at level 1,
    among those that come before it; deeper levels are quoted by the original itself. A
    conversation is ordered by the start of the thread, then by order, so each answer
    follows what it answers.

    A null text is empty. Messages with equal group and order are one place in the
    conversation: links lead to all of them, their rows follow in the order of role and
    text. A null group is a conversation, a null order comes last and neither answers nor
    is answered. Extra columns are not read; an empty table gives no rows.

    A conversation may hold any share of the rows. Only conversations with quotations are
    taken apart, originals are one row per window before they are joined, threads are followed by doubling steps, and positions are sums over
    ranges (``running_total``).
    """
    rows = parsed(messages.select(
        F.col(group_col).alias("g"), F.col(order_col).alias("o"), F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    ))
    told = rows.where("o IS NOT NULL")
    quoted = durable(
        told.where(F.exists("lines", lambda line: line["depth"] > 0))
        .select("g", "o", F.explode(_passages()).alias("p")).where("p.depth > 0")
        .select("g", "o", F.col("p.depth").alias("depth"), F.explode(_sentences(F.col("p.said"))).alias("words"))
        .select("g", "o", "depth", F.xxhash64("words").alias("sentence"), F.explode(_units(F.col("words"))).alias("unit"))
        .distinct()
    )
    talks = quoted.select(F.col("g").alias("qg")).distinct()
    own = told.join(talks, F.col("g").eqNullSafe(F.col("qg")), "left_semi")
    joined_lines = own.select("g", "o", F.explode(F.filter(_passages(), lambda p: p["depth"] == 0)).alias("p"))
    single_lines = own.select("g", "o", F.explode(F.filter("lines", lambda line: line["depth"] == 0)).alias("p"))
    short = F.filter(_sentences(F.col("p.said")), lambda words: F.size(F.split(words, " ")) <= WINDOW)
    said = (
        joined_lines.select("g", "o", F.explode(_sentences(F.col("p.said"))).alias("words"))
        .union(single_lines.select("g", "o", F.explode(short).alias("words")))
        .select("g", "o", F.explode(_units(F.col("words"))).alias("unit"))
    )
    wanted = quoted.select(F.col("g").alias("qg"), F.col("unit").alias("qu")).distinct()
    same = F.col("g").eqNullSafe(F.col("qg")) & (F.col("unit") == F.col("qu"))
    originals = durable(
        said.join(wanted, same, "left_semi").groupBy("g", "unit").agg(F.min("o").alias("source"))
        .withColumnsRenamed({"g": "qg", "unit": "qu"})
    )
    found = durable(
        quoted.join(originals, same).where(F.col("source") < F.col("o")).select("g", "o", "depth", "sentence", "unit", "source")
    )
    linked = found.select("g", "o", "depth", "sentence").distinct().groupBy("g", "o").agg(F.count("*").alias("n_linked"))
    # The least level, of its originals the one with most windows, of these the latest.
    answered = (
        found.select("g", "o", "depth", "unit", "source").distinct()
        .groupBy("g", "o", "depth", "source").agg(F.count("*").alias("units")).groupBy("g", "o")
        .agg(F.max(F.struct(-F.col("depth"), "units", "source")).getField("source").alias("reply_to"))
        .withColumnsRenamed({"g": "qg", "o": "qo"})
    )
    per_message = durable(
        linked.join(answered, F.col("g").eqNullSafe(F.col("qg")) & (F.col("o") == F.col("qo")))
        .select("g", "o", "n_linked", "reply_to")
    )
    threads = _threads(per_message.select("g", "o", "reply_to"))
    links = per_message.join(
        threads.withColumnsRenamed({"g": "tg", "o": "to"}),
        F.col("g").eqNullSafe(F.col("tg")) & (F.col("o") == F.col("to")),
    ).select(F.col("g").alias("lg"), F.col("o").alias("lo"), "n_linked", "reply_to", "root")

    joined = rows.select(
        "g", "o", "role", _body().alias("body"), F.xxhash64("text").alias("_text"),
        F.array_max(F.transform("lines", lambda line: line["depth"])).alias("quote_depth"),
        F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(_passages(), lambda p: p["depth"] > 0),
            lambda p: F.transform(_sentences(p["said"]), lambda words: F.struct(p["depth"], words)),
        )))).alias("n_quoted"),
    ).join(links, F.col("g").eqNullSafe(F.col("lg")) & (F.col("o") == F.col("lo")), "left").select(
        "g", "o", "role", "body", "_text", "quote_depth", "n_quoted",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", F.coalesce("root", "o").alias("thread"),
        F.col("o").isNull().alias("_last"),
    )
    ordered = running_total(joined, ["g"], ["_last", "thread", "o", "role", "_text"], F.lit(1))
    return ordered.select(
        F.col("g").alias(group_col), F.col("o").alias(order_col), F.col("role").alias(role_col), "body",
        "quote_depth", "n_quoted", "n_linked", "reply_to", "thread", F.col("before").cast("long").alias("position"),
    )


def _threads(links: DataFrame) -> DataFrame:
    """``(g, o, root)``: where the chain of answers from each linked message begins.

    Each round replaces a message's pointer by its pointer's, so the number of rounds is
    the logarithm of the longest chain. A pointer always leads to an earlier message.
    """
    state = durable(links.select("g", "o", F.col("reply_to").alias("root")))
    while True:
        above = state.select(F.col("g").alias("ag"), F.col("o").alias("ao"), F.col("root").alias("next"))
        stepped = durable(
            state.join(above, F.col("g").eqNullSafe(F.col("ag")) & (F.col("root") == F.col("ao")), "left")
            .select("g", "o", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
        state = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return state
