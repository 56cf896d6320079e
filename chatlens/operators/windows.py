"""Event-time windows over the chat log. Every function takes a batch or a streaming frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions import average_text, count_words, delivery_delay_ms, instant_text, window_text
from chatlens.plans import with_running

# Fixed values of the delay job and of the words job.
DELAY_SIZE, DELAY_SLIDE, DELAY_WATERMARK = "1 minute", "30 seconds", "30 seconds"
WORDS_SIZE, WORDS_GRACE = "60 seconds", "5 milliseconds"


def windowed(
    df: DataFrame,
    size: str,
    aggs: Mapping[str, Column],
    keys: Sequence[Column | str] = (),
    slide: str | None = None,
    grace: str | None = None,
    ts: str = "server_time",
) -> DataFrame:
    """Aggregate per window ``[start, end)`` and ``keys``; null keys form their own group.

    ``grace`` is the watermark delay; it only acts on a stream.
    """
    if grace is not None and df.isStreaming:
        df = df.withWatermark(ts, grace)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(window, *keys).agg(*[expr.alias(name) for name, expr in aggs.items()])


def split_window(df: DataFrame, text: bool = False) -> DataFrame:
    """Replace the window struct by its two bounds, as timestamps or as text."""
    bound = window_text if text else (lambda column: column)
    rest = [name for name in df.columns if name != "window"]
    return df.select(
        bound(F.col("window.start")).alias("window_start"), bound(F.col("window.end")).alias("window_end"), *rest
    )


# --- delivery delay -------------------------------------------------------------------


def with_delay(messages: DataFrame, *keep: str) -> DataFrame:
    return messages.select(*keep, "server_time", delivery_delay_ms().alias("diff_time_ms"))


def _delay(messages: DataFrame, *keys: str) -> DataFrame:
    return windowed(
        with_delay(messages, *keys),
        DELAY_SIZE,
        {"avg_diff_time_ms": F.avg("diff_time_ms")},
        keys,
        DELAY_SLIDE,
        DELAY_WATERMARK,
    )


def avg_delay(messages: DataFrame) -> DataFrame:
    return split_window(_delay(messages), text=True)


def avg_delay_by_user(messages: DataFrame) -> DataFrame:
    return split_window(_delay(messages, "user_id"))


def avg_delay_by_zone(messages: DataFrame) -> DataFrame:
    return split_window(_delay(messages, "zone_id"))


def num_messages(messages: DataFrame) -> DataFrame:
    return split_window(
        windowed(
            messages.select("server_time"),
            DELAY_SIZE,
            {"num_of_messages_per_time": F.count(F.lit(1))},
            slide=DELAY_SLIDE,
            grace=DELAY_WATERMARK,
        )
    )


# A sliding window is a whole number of panes: each pane is added up once, and windows are put together from panes.


def delay_panes(messages: DataFrame, *keys: str) -> DataFrame:
    """Sums per pane of one slide and ``keys``: (pane, *keys, diff_sum, messages, delays).

    One table by all keys feeds every metric by some of them; store it where several are wanted.
    """
    pane = F.window("server_time", DELAY_SLIDE)
    sums = with_delay(messages, *keys).groupBy(pane.alias("_pane"), *keys).agg(
        F.sum("diff_time_ms").alias("diff_sum"), F.count("diff_time_ms").alias("delays"), F.count(F.lit(1)).alias("messages")
    )
    return sums.select(F.col("_pane.start").alias("pane"), *keys, "diff_sum", "delays", "messages")


def _from_panes(panes: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    # Panes are few beside messages, so only they are doubled.
    summed = panes.groupBy("pane", *keys).agg(*[F.sum(name).alias(name) for name in ("diff_sum", "delays", "messages")])
    starts = F.array(F.col("pane"), F.col("pane") - F.expr(f"INTERVAL {DELAY_SLIDE}"))
    spread = summed.select(*keys, "diff_sum", "delays", "messages", F.explode(starts).alias("window_start"))
    totals = spread.groupBy("window_start", *keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    end = (F.col("window_start") + F.expr(f"INTERVAL {DELAY_SIZE}")).alias("window_end")
    return totals.select("window_start", end, *keys, *aggs)


def delay_from_panes(panes: DataFrame, *keys: str) -> DataFrame:
    """``avg_delay_by_user`` and its like from a table of panes."""
    average = F.sum("diff_sum").cast("double") / F.nullif(F.sum("delays"), F.lit(0))
    return _from_panes(panes, keys, {"avg_diff_time_ms": average})


def num_messages_from_panes(panes: DataFrame) -> DataFrame:
    return _from_panes(panes, (), {"num_of_messages_per_time": F.sum("messages")})


def delays_by(messages: DataFrame, metrics: Mapping[str, str | None]) -> DataFrame:
    """Several delay metrics from one read: (window_start, window_end, metric, key, avg_diff_time_ms, messages).

    ``metrics`` maps a metric's name to its key column, or to None for one over all messages. Rows
    multiply by the number of metrics before the partial aggregate, so little of that is shuffled.
    """
    keyed = with_delay(messages, *{name for name in metrics.values() if name})
    aggs = {"avg_diff_time_ms": F.avg("diff_time_ms"), "messages": F.count(F.lit(1))}
    spread = _per_metric(keyed, metrics)
    return split_window(windowed(spread, DELAY_SIZE, aggs, ["metric", "key"], DELAY_SLIDE, DELAY_WATERMARK))


def _per_metric(df: DataFrame, metrics: Mapping[str, str | None]) -> DataFrame:
    """Each row once per metric, with the metric's name and its key as text."""
    pairs = [
        F.struct(F.lit(name).alias("metric"), (F.col(key) if key else F.lit(None)).cast("string").alias("key"))
        for name, key in metrics.items()
    ]
    return df.select("*", F.inline(F.array(*pairs)))


# --- words per message ----------------------------------------------------------------


def _word_aggs() -> dict[str, Column]:
    # One sum and one count, so partial results merge on the map side.
    return {"words": F.sum("_words"), "messages": F.count("_words")}


def avg_words(messages: DataFrame, key: str) -> DataFrame:
    """Average words per message per ``key``, over everything seen so far."""
    aggs = [expr.alias(name) for name, expr in _word_aggs().items()]
    counted = messages.select(key, count_words("content").alias("_words"))
    return counted.groupBy(key).agg(*aggs).withColumn("avg_words", average_text("words", "messages"))


def avg_words_windowed(
    messages: DataFrame, key: str, size: str = WORDS_SIZE, grace: str = WORDS_GRACE
) -> DataFrame:
    """The same per tumbling window."""
    counted = messages.select(key, "server_time", count_words("content").alias("_words"))
    return windowed(counted, size, _word_aggs(), [key], grace=grace).withColumn(
        "avg_words", average_text("words", "messages")
    )


def words_by(messages: DataFrame, metrics: Mapping[str, str], size: str = WORDS_SIZE, grace: str = WORDS_GRACE) -> DataFrame:
    """Words per message for several keys from one read: window bounds, metric, key and the averages.

    ``metrics`` maps a metric's name to its key column. Takes a stream as well, so one query feeds all sinks.
    """
    counted = messages.select(*dict.fromkeys(metrics.values()), "server_time", count_words("content").alias("_words"))
    spread = _per_metric(counted, metrics)
    totals = windowed(spread, size, _word_aggs(), ["metric", "key"], grace=grace)
    return split_window(totals.withColumn("avg_words", average_text("words", "messages")))


def keyed_result(df: DataFrame, key: str, value: str) -> DataFrame:
    """A windowed result as a text pair: ``{window start}___{key}`` and the value."""
    return df.select(
        F.concat(instant_text("window.start"), F.lit("___"), F.col(key).cast("string")).alias("key"),
        F.col(value).cast("string").alias("value"),
    )


# --- message counts -------------------------------------------------------------------


def msg_count(
    messages: DataFrame,
    key: Column | str | None = None,
    size: str = "2 seconds",
    grace: str = "250 milliseconds",
) -> DataFrame:
    """Messages per tumbling window, in total or per ``key``."""
    keys = [] if key is None else [key]
    return split_window(windowed(messages, size, {"messages": F.count(F.lit(1))}, keys, grace=grace))


def chat_type() -> Column:
    """1 for a group chat, 0 for a direct chat."""
    return F.col("group_chat").cast("int").cast("short").alias("chat_type")


# --- late records ---------------------------------------------------------------------


def with_lateness(
    messages: DataFrame,
    arrival: str,
    key_space: Sequence[str] = (),
    size_ms: int = 60_000,
    grace_ms: int = 5,
    ts: str = "server_time",
    rows_per_block: int = 65_536,
    blocks_per_span: int = 1_024,
) -> DataFrame:
    """Mark the records a per-record grace rule drops.

    Stream time is the largest event time seen so far in arrival order within a key space.
    A record is late when its window's end plus the grace is not after stream time.
    ``arrival`` is a whole number; a key space is scanned in blocks of ``rows_per_block`` of it, and
    blocks are chained in spans of ``blocks_per_span``, so no task sees more than one of either.
    """
    timed = messages.withColumn("_ts_ms", F.unix_millis(ts)).withColumn("_block", F.floor(F.col(arrival) / F.lit(rows_per_block)))
    levels = [["_block"]]
    if not key_space:
        timed = timed.withColumn("_span", F.floor(F.col("_block") / F.lit(blocks_per_span)))
        levels = [["_span"], ["_block"]]
    seen = with_running(timed, list(key_space), levels, [arrival], {"stream_time_ms": ("max", "_ts_ms")})
    window_end = F.col("_ts_ms") - F.pmod("_ts_ms", F.lit(size_ms)) + F.lit(size_ms)
    return (
        seen.withColumn("window_end_ms", window_end)
        .withColumn("late", F.col("window_end_ms") + F.lit(grace_ms) <= F.col("stream_time_ms"))
        .drop("_ts_ms", "_block", "_span")
    )


def late_records(messages: DataFrame, arrival: str, **options) -> DataFrame:
    return with_lateness(messages, arrival, **options).filter("late").drop("late")


def on_time(messages: DataFrame, arrival: str, **options) -> DataFrame:
    """The records the grace rule keeps, ready for any windowed aggregate."""
    marked = with_lateness(messages, arrival, **options)
    return marked.filter(~F.col("late")).select(*messages.columns)
