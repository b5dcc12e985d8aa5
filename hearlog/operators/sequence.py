"""Session numbering and in-session features over plays in time order.

A plain window over the time order puts all plays of a listener, or of everyone, into
one task. Here the plays are range-partitioned on (listener, start, identity) instead,
each range block is scanned on its own, and what a block needs from the blocks before it
comes from one row per block. Range bounds come from a sample of the full sort key, so a
listener, a day or even one instant with a third of all plays is cut into even blocks.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearlog.functions import labels
from hearlog.functions.calendar import ten_minute_bucket
from hearlog.params import Params
from hearlog.session import durable


def _breaks(start: Column, previous_end: Column, gap_ms: int) -> Column:
    """1 when a play opens a session: after a long gap, and wherever the gap is unknown."""
    return F.coalesce(start - previous_end > gap_ms, F.lit(True)).cast("bigint")


def session_scan(
    plays: DataFrame,
    start: Column,
    end: Column,
    gap_ms: int,
    tie_break: str = "play_id",
    listener_keys: tuple[str, ...] = (),
    running: dict[str, Column] | None = None,
    blocks: int | None = None,
    block_rows: int = 2_000_000,
    streaks: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``session_id``, from 1 per listener in time order, to every play.

    A session opens at the first play, and wherever the gap between a start and the end of
    the play just before exceeds ``gap_ms`` or is null. Plays without a start come first,
    each as a session of its own. ``running`` asks for more: ``position``
    (from 0 in the session) and, per entry, the sum of an expression over the earlier
    plays of the session. ``streaks`` asks, per entry, for how many plays just before this
    one, in the session, a condition held without a break (null breaks it).

    The plays are cut into ``blocks``; without that, into as many as keep a block at about
    ``block_rows``, and no fewer than the session has shuffle partitions.
    """
    running, streaks = running or {}, streaks or {}
    keys = list(listener_keys)
    sums = {f"_sum_{name}": name for name in running}
    values = {f"_value_{name}": F.coalesce(value, F.lit(0)) for name, value in running.items()}
    holds = {f"_holds_{name}": F.coalesce(condition, F.lit(False)) for name, condition in streaks.items()}
    order = [F.col("_start").asc_nulls_first(), F.col(tie_break).asc_nulls_first()]

    sort_key = [F.col(k).asc_nulls_first() for k in keys] + order
    if not blocks:
        partitions = int(plays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(partitions, -(-plays.count() // block_rows))
    rows = (
        plays.withColumns({"_start": start, "_end": end} | values | holds)
        .repartitionByRange(blocks, *sort_key)
        .withColumn("_block", F.spark_partition_id())
    )

    in_block = Window.partitionBy("_block", *keys).orderBy(*order)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_row", F.row_number().over(in_block)).withColumn(
        "_opens",
        F.when(F.col("_row") == 1, F.lit(0).cast("bigint")).otherwise(
            _breaks(F.col("_start"), F.lag("_end").over(in_block), gap_ms)
        ),
    )
    rows = rows.withColumn("_inner", F.sum("_opens").over(so_far))
    if running or streaks:
        in_piece = Window.partitionBy("_block", *keys, "_inner").orderBy(*order)
        earlier = in_piece.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns(
            {"_position": (F.row_number().over(in_piece) - 1).cast("bigint")}
            | {s: F.coalesce(F.sum(f"_value_{name}").over(earlier), F.lit(0).cast("bigint"))
               for s, name in sums.items()}
        )
        rows = rows.withColumns({
            f"_break_{name}": F.max(F.when(~F.col(f"_holds_{name}"), F.col("_position"))).over(earlier) for name in streaks
        })
    # Block numbers are fixed here, so both uses below see the same blocks even when
    # an executor is lost in between.
    rows = durable(rows)

    carry = _carry(rows, keys, gap_ms, sums, list(streaks))
    same_listener = reduce(
        lambda a, b: a & b,
        [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys],
        F.col("r._block") == F.col("c._block"),
    )
    joined = rows.alias("r").join(F.broadcast(carry).alias("c"), same_listener, "left")
    output = [F.col(f"r.{c}") for c in plays.columns]
    output.append((F.col("r._inner") + F.coalesce("c._offset", F.lit(1))).alias("session_id"))

    def carried(column: str) -> Column:
        continues = (F.col("r._inner") == 0) & F.col(f"c.{column}").isNotNull()
        return F.when(continues, F.col(f"c.{column}")).otherwise(0)

    if running or streaks:
        output.append((F.col("r._position") + carried("_position")).alias("position"))
        output += [(F.col(f"r.{s}") + carried(s)).alias(name) for s, name in sums.items()]
        for name in streaks:
            # Only a streak that reaches back to the border goes on from the blocks before.
            since = F.col("r._position") - 1 - F.col(f"r._break_{name}")
            output.append(F.coalesce(since, F.col("r._position") + carried(f"_streak_{name}")).alias(name))
    return joined.select(*output)


def _carry(rows: DataFrame, keys: list[str], gap_ms: int, sums: dict[str, str], streaks: list[str]) -> DataFrame:
    """What a block's first listener brings from earlier blocks.

    Blocks are ranges of the sort key, so at most one listener crosses a block border:
    this has fewer rows than there are blocks, however many plays or listeners exist.
    """
    tails = {"_position": F.max_by(F.col("_position") + 1, "_row")} if sums or streaks else {}
    tails |= {s: F.max_by(F.col(s) + F.col(f"_value_{name}"), "_row") for s, name in sums.items()}
    ends = {}
    for name in streaks:
        since = F.coalesce("_break_" + name, F.lit(-1))
        unbroken = F.col(f"_holds_{name}")
        ends[f"_streak_{name}"] = F.max_by(F.when(unbroken, F.col("_position") - since).otherwise(0), "_row")
        ends[f"_open_{name}"] = F.max_by(unbroken & F.col(f"_break_{name}").isNull(), "_row")
    pieces = rows.groupBy("_block", *keys).agg(
        F.max(F.when(F.col("_row") == 1, F.col("_start"))).alias("_head_start"),
        F.max_by("_end", "_row").alias("_last_end"),
        F.max("_inner").alias("_inner_breaks"),
        *[tail.alias(name) for name, tail in (tails | ends).items()],
    )
    along = Window.partitionBy(*keys).orderBy("_block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    up_to = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = (
        pieces.withColumn("_nth", F.row_number().over(along))
        .withColumn(
            "_head",
            F.when(F.col("_nth") == 1, F.lit(1).cast("bigint")).otherwise(
                _breaks(F.col("_head_start"), F.lag("_last_end").over(along), gap_ms)
            ),
        )
        .withColumn("_new", F.col("_inner_breaks") + F.col("_head"))
        .withColumn("_offset", F.coalesce(F.sum("_new").over(before), F.lit(0)) + F.col("_head"))
        .withColumn("_run", F.sum((F.col("_new") > 0).cast("int")).over(up_to))
    )
    carried = []
    if tails:
        in_run = Window.partitionBy(*keys, "_run").orderBy("_block")
        in_run = in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pieces = pieces.withColumns({f"{t}_total": F.sum(t).over(in_run) for t in tails})
        pieces = pieces.withColumns({f"{t}_in": F.lag(f"{t}_total").over(along) for t in tails})
        # A block in which a streak breaks starts the count anew for the blocks behind it.
        for name in streaks:
            broken = F.sum((~F.col(f"_open_{name}")).cast("int")).over(in_run)
            pieces = pieces.withColumn(f"_part_{name}", broken)
            in_part = Window.partitionBy(*keys, "_run", f"_part_{name}").orderBy("_block")
            in_part = in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            pieces = pieces.withColumn(f"_streak_{name}_total", F.sum(f"_streak_{name}").over(in_part))
            pieces = pieces.withColumn(f"_streak_{name}_in", F.lag(f"_streak_{name}_total").over(along))
        carried = [F.when(F.col("_head") == 0, F.col(f"{t}_in")).alias(t) for t in [*tails, *[f"_streak_{n}" for n in streaks]]]
    return pieces.filter(F.col("_nth") > 1).select("_block", *keys, "_offset", *carried)


def play_sessions(plays: DataFrame, params: Params = Params(), blocks: int | None = None) -> DataFrame:
    """Sessions by the pause between the end of a play and the start of the next one."""
    return session_scan(
        plays,
        start=F.col("start_ms"),
        end=F.col("start_ms") + F.col("ms_played"),
        gap_ms=params.session_gap_ms,
        listener_keys=params.listener_keys,
        blocks=blocks,
        block_rows=params.session_block_rows,
    )


def skip_context(fact: DataFrame, params: Params = Params(), blocks: int | None = None) -> DataFrame:
    """Music plays with what came before them in their session.

    Sessions here are by the gap between starts. ``skips_before`` counts all earlier
    skips of the session, ``skip_streak`` the unbroken run of skips just before the play.
    """
    music = fact.filter(
        (F.col("content_type") == "music")
        & F.col("ms_played").isNotNull()
        & F.col("hour").isNotNull()
        & F.col("weekday").isNotNull()
    ).select(
        *params.listener_keys,
        "play_id",
        "start_ms",
        "ms_played",
        labels.flag(F.col("skipped")).alias("skip"),
        labels.flag(F.col("shuffle")).alias("shuffle_on"),
        labels.is_active(F.col("reason_start")).alias("active"),
        "hour",
        "weekday",
        "month",
    )
    scanned = session_scan(
        music,
        start=F.col("start_ms"),
        end=F.col("start_ms"),
        gap_ms=params.session_gap_ms,
        listener_keys=params.listener_keys,
        running={
            "ms_before": F.col("ms_played"),
            "skips_before": F.col("skip").cast("bigint"),
        },
        streaks={"skip_streak": F.col("skip") == 1},
        blocks=blocks,
        block_rows=params.session_block_rows,
    )
    return scanned.withColumns({
        "minutes_before": F.col("ms_before") / 60_000,
        "minute_bucket": ten_minute_bucket(F.col("ms_before")),
    })
