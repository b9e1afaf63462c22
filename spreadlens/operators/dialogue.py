"""Routing the turns of many conversations, each with its memory of drafts and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spreadlens.functions.messages import ordinal, pasted_text, rule_route


def route_messages(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, tool, index, text) for user turns (conv_id, turn, text).

    Memory only ever switches on: a conversation has drafts after its first draft, and a post after its first
    shipping that followed one. Before a post, `learn` is off, so both switches come from the stateless routes
    by two minima per conversation, windows over one shuffle of turns that are routed once.
    """
    routed = turns.select(
        "conv_id",
        "turn",
        "text",
        rule_route(F.col("text"), learn=False).alias("before_post"),
        rule_route(F.col("text"), learn=True).alias("after_post"),
    )
    of_conversation = Window.partitionBy("conv_id")
    drafted = F.min(F.when(F.col("before_post") == "draft", F.col("turn"))).over(of_conversation)
    ships = (F.col("before_post") == "ship") & (F.col("turn") > F.col("drafted"))
    posted = F.min(F.when(ships, F.col("turn"))).over(of_conversation)
    known = routed.withColumn("drafted", drafted).withColumn("posted", posted)
    has_post = F.coalesce(F.col("turn") > F.col("posted"), F.lit(False))
    has_draft = F.coalesce(F.col("turn") > F.col("drafted"), F.lit(False))
    tool = F.when(has_post, F.col("after_post")).otherwise(F.col("before_post"))
    tooled = known.withColumns({"tool": tool, "has_draft": has_draft})
    points = F.col("tool").isin("render", "ship") | ((F.col("tool") == "score") & F.col("has_draft"))
    quotes = F.col("tool").isin("draft", "score") & ~points
    return tooled.select(
        "conv_id",
        "turn",
        "tool",
        F.when(points, ordinal(F.col("text"))).alias("index"),
        F.when(F.col("tool") == "explain", pasted_text(F.col("text"))).when(quotes, F.col("text")).alias("text"),
    )
