"""Sessions kept up to date: stored with their borders, merged with plays that arrive later.

A session that no new play falls into is one unit, as a play is: where it starts, where it
ends, and its totals. So sessions over stored ones and new plays come from the same scan as
those over plays, at the cost of the sessions, not of the plays. Only sessions that a late
play falls into are taken apart again, as what breaks a session is the play just before.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearlog.functions.rounding import minutes
from hearlog.operators.sequence import session_scan
from hearlog.params import Params
from hearlog.session import durable

#: Span of the buckets in which plays and sessions meet. A session is in each it touches.
BUCKET_MS = 86_400_000

TOTALS = ["plays", "ms_total"]
BORDERS = ["first_start", "first_id", "last_start", "last_id", "last_end"]


def _key(start: str, identity: str) -> Column:
    """What plays are ordered by: unknown starts first."""
    return F.struct(F.col(start).isNotNull().alias("known"), F.col(start).alias("start"), F.col(identity).alias("id"))


def _units(plays: DataFrame, keys: list[str]) -> DataFrame:
    end = F.col("start_ms") + F.col("ms_played")
    return plays.select(
        *keys, F.col("start_ms").alias("first_start"), F.col("play_id").alias("first_id"), F.col("start_ms").alias("last_start"),
        F.col("play_id").alias("last_id"), end.alias("last_end"), F.lit(1).cast("bigint").alias("plays"),
        F.col("ms_played").cast("bigint").alias("ms_total"),
    )


def _joined(units: DataFrame, params: Params) -> DataFrame:
    """Units that follow each other without a break, as sessions numbered per listener."""
    keys = list(params.listener_keys)
    scanned = session_scan(
        units, start=F.col("first_start"), end=F.col("last_end"), gap_ms=params.session_gap_ms, tie_break="first_id",
        listener_keys=params.listener_keys, block_rows=params.session_block_rows,
    )
    first, last = _key("first_start", "first_id"), _key("last_start", "last_id")
    sessions = scanned.groupBy(*keys, "session_id").agg(
        F.min(first).alias("first"), F.max(last).alias("last"), F.max_by("last_end", last).alias("last_end"),
        F.sum("plays").alias("plays"), F.sum("ms_total").alias("ms_total"),
    )
    return sessions.select(
        *keys, "session_id", F.col("first.start").alias("first_start"), F.col("first.id").alias("first_id"),
        F.col("last.start").alias("last_start"), F.col("last.id").alias("last_id"), "last_end", *TOTALS,
    )


def sessions_of(plays: DataFrame, params: Params = Params()) -> DataFrame:
    """Sessions of all plays, with totals and borders: what ``merged`` goes on from."""
    return _joined(_units(plays, list(params.listener_keys)), params)


def session_detail(sessions: DataFrame, params: Params = Params()) -> DataFrame:
    """The mart of sessions, from stored ones."""
    return sessions.select(*params.listener_keys, "session_id", *TOTALS, minutes(F.col("ms_total")).alias("minutes"))


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys], F.lit(True))


def _in_buckets(sessions: DataFrame) -> DataFrame:
    """Sessions once per bucket. Those of one play, or without a start, hold no others."""
    spans = F.sequence(F.floor(F.col("first_start") / BUCKET_MS), F.floor(F.col("last_start") / BUCKET_MS))
    return sessions.where("first_start IS NOT NULL AND plays > 1").withColumn("bucket", F.explode(spans))


def _inside(plays: DataFrame, sessions: DataFrame, keys: list[str], how: str, borders: bool) -> DataFrame:
    """``plays`` that fall into ``sessions`` (``how`` left_semi), or these sessions (inner)."""
    plays = plays.where("start_ms IS NOT NULL").withColumn("bucket", F.floor(F.col("start_ms") / BUCKET_MS))
    held = _in_buckets(sessions)
    key, first, last = _key("p.start_ms", "p.play_id"), _key("s.first_start", "s.first_id"), _key("s.last_start", "s.last_id")
    within = (key >= first) & (key <= last) if borders else (key > first) & (key < last)
    on = _same(keys, "p", "s") & (F.col("p.bucket") == F.col("s.bucket")) & within
    if how == "left_semi":
        return plays.alias("p").join(held.alias("s"), on, "left_semi").drop("bucket")
    return plays.alias("p").join(held.alias("s"), on).select(*[F.col(f"s.{k}").alias(k) for k in keys], "s.session_id").distinct()


def merged(sessions: DataFrame, plays: DataFrame, new_plays: DataFrame, params: Params = Params()) -> DataFrame:
    """Sessions over ``plays``, whose ``sessions`` are known, and ``new_plays`` together.

    Equal to ``sessions_of`` both, whatever the order in which plays arrive. Listeners
    without new plays keep their rows; of ``plays`` only those in sessions that a late play
    falls into are read on. Plays are told apart by ``play_id``, and none is in both.
    """
    keys = list(params.listener_keys)
    columns = [*keys, "play_id", "start_ms", "ms_played"]
    new_plays, plays = durable(new_plays.select(*columns)), plays.select(*columns)
    torn = durable(_inside(new_plays, sessions, keys, "inner", borders=False))
    listeners = new_plays.select(*keys).distinct()
    number = F.col("u.session_id") == F.col("t.session_id")
    own = sessions.alias("u").join(torn.alias("t"), _same(keys, "u", "t") & number, "left_semi")
    rest = sessions.alias("u").join(torn.alias("t"), _same(keys, "u", "t") & number, "left_anti")
    apart = _units(_inside(plays, durable(own), keys, "left_semi", borders=True), keys)
    if keys:
        untouched = sessions.alias("u").join(listeners.alias("n"), _same(keys, "u", "n"), "left_anti")
        rest = rest.alias("u").join(listeners.alias("n"), _same(keys, "u", "n"), "left_semi")
    units = rest.select(*keys, *BORDERS, *TOTALS).unionByName(apart).unionByName(_units(new_plays, keys))
    found = _joined(durable(units), params)
    return found.unionByName(untouched) if keys else found
