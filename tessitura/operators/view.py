"""What a view shows, derived from its state: flags, headings, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.expr import label

HEADINGS = {"likes": "LIKES", "search": "SEARCH", "stations": "STATIONS", "history": "HISTORY", "experiment": "MIX"}


def derived_state(states: DataFrame) -> DataFrame:
    """Derived columns of rows of state.

    In: ``view, title, status`` of a page, ``auth_busy``, ``wave`` (a station or empty), ``queued``, ``playback``,
    ``current_id``, ``repeat``, ``shuffle``, ``rating``, ``history_at, history_size``, ``previous_pos`` (-1 for none),
    ``available_after, available_any``. Added: heading, kind, busy, can_pause, finite_queue, repeat_mode,
    shuffled, can_previous, can_next, own_rating. Null flags count as false.
    """
    wave = F.coalesce("wave", F.lit("")) != ""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    heading = F.coalesce(F.nullif(label("view", HEADINGS), F.lit("")), "title", F.lit("CATALOGUE"))
    return states.select(
        "*", heading.alias("heading"), F.split_part("view", F.lit(":"), F.lit(1)).alias("kind"),
        ((F.col("status") == "loading") | flag("auth_busy")).alias("busy"),
        ((F.coalesce("current_id", F.lit("")) != "") & ~F.col("playback").isin("error", "empty")).alias("can_pause"),
        ((F.col("queued") > 0) & ~wave).alias("finite_queue"),
        F.when(wave, "off").otherwise(F.col("repeat")).alias("repeat_mode"), (~wave & flag("shuffle")).alias("shuffled"),
        (~wave & ((F.col("history_at") > 0) | (F.col("previous_pos") >= 0))).alias("can_previous"),
        (wave | (F.col("history_at") < F.col("history_size") - 1) | flag("available_after") | ((F.col("repeat") == "all") & flag("available_any"))).alias("can_next"),
        F.coalesce("rating", F.lit(0)).alias("own_rating"),
    )
