"""URL filters as a sort-merge range join.

A rule (host, path, verdict) fits its host and all subdomains, if the url's path starts with the rule's. With the host's
labels reversed, a rule's key is a prefix of the key of every url it fits, for one of the host's parent domains: it opens an
interval in the order of keys, and intervals nest. Urls (one point for each parent domain, as many as rules reach) and rules
are sorted together in key ranges; a sweep over each range keeps the stack of the rules that are open. The rules open at the
start of a range are those whose key is a prefix of its first key; they are found by a join on the prefixes of the range
bounds, whose number is the number of ranges. Points carry a hash of the page, so equal urls spread over ranges.

The longest rule wins (host and path in code points, then the longer host); of equal rules, block wins. Defined cases: a NULL
url or one without `://` has empty host and path and no rule; the default verdict is the method's; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlens.llm import common as c

SAMPLE_PER_RANGE = 100


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    return c.lower_ascii(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Reversed labels, a slash that no host holds, the path."""
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page (page_id, url): page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    ruled = rules.select(
        _key(F.reverse(F.split("host", "\\.")), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"),
        F.size(F.split("host", "\\.")).alias("labels"), "verdict",
    ).groupBy("key").agg(F.min("rule").alias("rule"), F.min("host_chars").alias("host_chars"), F.max("labels").alias("labels"), F.max("verdict").alias("verdict"))
    depth = ruled.agg(F.max("labels")).first()[0] or 1
    urls = pages.select("page_id", F.col("url").alias("_url")).select("page_id", F.col("_url").alias("url"), url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    labels = F.reverse(F.split("host", "\\."))
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda n: _key(F.slice(labels, 1, n), F.col("path")))
    # \x00 sorts before all else, so a rule comes before the urls that it is a prefix of; the hash spreads equal urls.
    points = urls.select("page_id", "url", "host", "path", F.posexplode(parents).alias("nth", "key")).select(
        F.concat("key", F.lit("\x001"), F.hex(F.xxhash64("page_id", "url"))).alias("at"), "key", "nth", "page_id", "url", "host", "path"
    )
    ranges = 4 * c.shuffle_partitions(spark)
    n = points.count()
    wanted = ranges * SAMPLE_PER_RANGE
    sampled = points.select("at").sample(fraction=min(1.0, wanted / max(n, 1)), seed=7).limit(4 * wanted).collect()
    order = sorted((r["at"] for r in sampled), key=lambda s: s.encode())
    bounds = [order[i * len(order) // ranges] for i in range(1, ranges)] if order else []
    bounds = sorted(set(bounds), key=lambda s: s.encode())
    carried = _open_at(ruled, bounds)
    both = points.unionByName(
        ruled.select(F.concat("key", F.lit("\x000")).alias("at"), "key", F.lit(-1).alias("nth"), "rule", "host_chars", "verdict"), allowMissingColumns=True
    )
    edges = np.array([b.encode() for b in bounds], dtype=object)

    @F.pandas_udf("int")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, np.array([s.encode() for s in at], dtype=object), side="right").astype("int32"))

    swept = (
        both.withColumn("range", range_of("at"))
        .repartition(c.shuffle_partitions(spark), "range")
        .sortWithinPartitions("range", "at")
        .mapInPandas(_sweep(carried), f"page_id {dict(points.dtypes)['page_id']}, url string, host string, path string, nth int, chars int, host_chars int, rule string, verdict string")
    )
    fits = F.max(F.when(F.col("rule").isNotNull(), F.struct("chars", "host_chars", "rule", "verdict"))).alias("best")
    best = swept.groupBy("page_id", "url", "host", "path").agg(fits, F.sum((F.col("nth") == 0).cast("int")).alias("rows"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), "rows")).alias("_row")
    ).drop("_row")


def _open_at(ruled: DataFrame, bounds: list[str]) -> dict[int, list[tuple]]:
    """For each range, the rules that began before its bound and whose keys are prefixes of it, shortest first.

    The distinct prefixes of all bounds are joined to the rules: at most the number of ranges times the length of a key.
    """
    if not bounds:
        return {}
    keys = ruled.sparkSession.createDataFrame([(b.split("\x00")[0],) for b in bounds], "bound string")
    prefix = F.transform(F.sequence(F.lit(1), F.length("bound")), lambda n: F.substring(F.col("bound"), F.lit(1), n))
    prefixes = keys.where("bound <> ''").select(F.explode(prefix).alias("key")).distinct()
    found = {r["key"]: (r["key"], r["rule"], r["host_chars"], r["verdict"]) for r in ruled.join(prefixes, "key", "left_semi").collect()}
    out = {}
    for n, bound in enumerate(bounds, 1):
        key = bound.split("\x00")[0]
        nested = [found[key[:k]] for k in range(1, len(key) + 1) if key[:k] in found]
        out[n] = [r for r in nested if (r[0] + "\x000").encode() < bound.encode()]
    return out


def _sweep(carried: dict[int, list[tuple]]):
    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stack = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.range != now:
                    now, stack = r.range, list(carried.get(r.range, ()))
                while stack and not r.key.startswith(stack[-1][0]):
                    stack.pop()
                if r.nth < 0:
                    stack.append((r.key, r.rule, int(r.host_chars), r.verdict))
                elif stack:
                    _, rule, host_chars, verdict = stack[-1]
                    out.append((r.page_id, r.url, r.host, r.path, r.nth, len(rule), host_chars, rule, verdict))
                elif r.nth == 0:
                    out.append((r.page_id, r.url, r.host, r.path, 0, None, None, None, None))
            yield pd.DataFrame(out, columns=["page_id", "url", "host", "path", "nth", "chars", "host_chars", "rule", "verdict"]).astype({"chars": "Int32", "host_chars": "Int32"})

    return sweep
