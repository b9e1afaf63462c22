"""Publishing rules over tables: validity, price and admission under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spreadlens.functions.text import validated

# Fixed values, in thousandths of a dollar so that sums stay exact.
COST_WITH_LINK = 200
COST_PLAIN = 15


def validate_posts(posts: DataFrame) -> DataFrame:
    """(id, cleaned, ok, reason)."""
    return posts.select("id", validated(F.col("text")).alias("v")).select("id", "v.*")


def post_cost(text):
    return F.when(text.contains("http"), F.lit(COST_WITH_LINK)).otherwise(F.lit(COST_PLAIN)).cast("bigint")


# Why a valid post isn't published.
OVER_BUDGET = "posting would cross the budget"


def publish_queue(posts: DataFrame, budget: int) -> DataFrame:
    """(id, author_id, cost, admitted, spent, reason) for (id, author_id, created_at, text): checked, priced, then admitted.

    A post that can't be published is refused before it is priced and spends nothing. `spent` is what its author has
    spent with an admitted post, the ledger's running figure; an author has at most budget / price of those.
    """
    checked = posts.select("id", "author_id", "created_at", validated(F.col("text")).alias("v"))
    priced = _admitted(checked.where("v.ok").select("id", "author_id", "created_at", F.col("v.cleaned").alias("text")), budget)
    ledger = Window.partitionBy("author_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.lit(None).cast("bigint")
    paid = priced.where("admitted").select("id", "author_id", "cost", "admitted", F.sum("cost").over(ledger).alias("spent"), F.lit(None).cast("string").alias("reason"))
    refused = priced.where("not admitted").select("id", "author_id", "cost", "admitted", none.alias("spent"), F.lit(OVER_BUDGET).alias("reason"))
    invalid = checked.where("not v.ok").select("id", "author_id", none.alias("cost"), F.lit(False).alias("admitted"), none.alias("spent"), F.col("v.reason").alias("reason"))
    return paid.unionByName(refused).unionByName(invalid)


def budget_admission(posts: DataFrame, budget: int) -> DataFrame:
    """(id, author_id, cost, admitted) for (id, author_id, created_at, text): each author's queue, in order."""
    return _admitted(posts, budget).drop("created_at")


def _admitted(posts: DataFrame, budget: int) -> DataFrame:
    """(id, author_id, created_at, cost, admitted).

    A post is admitted if what is spent plus its cost stays within `budget`; a refusal spends nothing. Spending
    only grows, so once a price is refused it stays refused: at each price the admitted posts are the first few,
    at most budget / price of them. Only those few per author and price are kept (before the shuffle already)
    and folded in order; the last one admitted at each price then decides all the author's posts.
    """
    priced = posts.select("id", "author_id", "created_at", post_cost(F.col("text")).alias("cost"))
    queue = Window.partitionBy("author_id", "cost").orderBy("created_at", "id")
    most = budget // min(COST_WITH_LINK, COST_PLAIN)
    first = priced.withColumn("place", F.row_number().over(queue)).where(F.col("place") <= F.lit(max(most, 1)))
    # At most 2 * (budget / 15) entries per author.
    entries = F.sort_array(F.collect_list(F.struct("created_at", "id", "cost")))
    start = F.struct(
        F.lit(0).cast("bigint").alias("spent"),
        F.lit(None).cast("struct<created_at: timestamp, id: string>").alias("plain"),
        F.lit(None).cast("struct<created_at: timestamp, id: string>").alias("linked"),
    )

    def admit(state, post):
        fits = state["spent"] + post["cost"] <= budget
        here = F.struct(post["created_at"].alias("created_at"), post["id"].alias("id"))
        return F.struct(
            F.when(fits, state["spent"] + post["cost"]).otherwise(state["spent"]).alias("spent"),
            F.when(fits & (post["cost"] == COST_PLAIN), here).otherwise(state["plain"]).alias("plain"),
            F.when(fits & (post["cost"] == COST_WITH_LINK), here).otherwise(state["linked"]).alias("linked"),
        )

    # Posts without an author are one queue, as they are in a stream.
    last = first.groupBy(F.col("author_id").alias("_author")).agg(F.aggregate(entries, start, admit).alias("last"))
    here = F.struct(F.col("created_at"), F.col("id"))
    limit = F.when(F.col("cost") == COST_PLAIN, F.col("last.plain")).otherwise(F.col("last.linked"))
    return priced.join(last, F.col("author_id").eqNullSafe(F.col("_author"))).select(
        "id", "author_id", "created_at", "cost", F.coalesce(here <= limit, F.lit(False)).alias("admitted")
    )
