"""State per key that ends: a post's read counter, an author's ledger, a conversation's two switches.

The operators are processors over a RocksDB store, so the state of all keys need not fit in an executor's heap. Each one ends:
a post's counter by an event-time timer, a ledger and a conversation by a time to live since their last change.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from spreadlens.operators.publishing import OVER_BUDGET

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Processors need this store; queries that a session starts later use it too."""
    spark.conf.set(STORE, ROCKSDB)


class PollState(StatefulProcessor):
    """Numbers the reads of a bucket of posts until each has had its fill; a post's counter goes when no read of its lifetime can
    come any more.

    The counters of a bucket are one value, so a call works on arrays of posts instead of one post. One timer stands at the earliest
    end of the bucket's posts; what it finds past its end it drops.
    """

    def __init__(self, max_reads: int, lifetime_ms: int | None):
        self.max_reads = max_reads
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "ids array<string>, reads array<bigint>, ends array<bigint>")

    def _known(self) -> dict[str | None, tuple[int, int | None]]:
        if not self.counters.exists():
            return {}
        ids, reads, ends = self.counters.get()
        return {i: (n, end) for i, n, end in zip(ids, reads, ends)}

    def _keep(self, known: dict[str | None, tuple[int, int | None]]) -> int | None:
        """Store the counters; the earliest of their ends."""
        if not known:
            self.counters.clear()
            return None
        reads, ends = zip(*known.values())
        self.counters.update((list(known), list(reads), list(ends)))
        return min((end for end in ends if end is not None), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        timer = min((end for _, end in known.values() if end is not None), default=None)
        first = born = None
        for chunk in rows:
            chunk = chunk.assign(id=[i if isinstance(i, str) else None for i in chunk["id"]])
            last = chunk.groupby("id", dropna=False)["created_at"].max()
            born = last if born is None else pd.concat([born, last]).groupby(level=0, dropna=False).max()
            # Never more than one chunk and the reads still wanted.
            pool = chunk if first is None else pd.concat([first, chunk])
            pool = pool.sort_values(["id", "version", "likes", "created_at"], na_position="first")
            first = pool[pool.groupby("id", dropna=False).cumcount() < self.max_reads]
        if first is None:
            return
        ids = [i if isinstance(i, str) else None for i in first["id"]]
        read = first.groupby("id", dropna=False).cumcount() + 1 + np.array([known.get(i, (0, None))[0] for i in ids], np.int64)
        wanted = (read <= self.max_reads).to_numpy()
        first, read = first[wanted], read[wanted]
        fresh = Counter(i for i, new in zip(ids, wanted) if new)
        for i, at in born.items():
            i = i if isinstance(i, str) else None
            done, ends = known.get(i, (0, None))
            if self.lifetime_ms is not None and not pd.isna(at):
                # In epoch milliseconds; the end moves on only if a later publication time is seen.
                end = int(at.value // 1_000_000) + self.lifetime_ms
                ends = end if ends is None else max(ends, end)
            known[i] = (done + fresh[i], ends)
        earliest = self._keep(known)
        if earliest != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(earliest)
        elapsed = (first["version"].dt.floor("s") - first["created_at"].dt.floor("s")).dt.total_seconds() / 60.0
        yield pd.DataFrame({"id": first["id"], "read": read, "minutes": elapsed.round(2), "likes": first["likes"].astype("Int64")})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        earliest = self._keep({i: (n, end) for i, (n, end) in self._known().items() if end is None or end > past})
        if earliest is not None:
            self.handle.registerTimer(earliest)
        return iter(())


class LedgerState(StatefulProcessor):
    """Admits an author's posts in order while the budget lasts; a refusal spends nothing.

    Spending only grows, so of each price at most what is left divided by the price can be admitted: those first posts are
    held while a batch's chunks pass, all others are refused as they come.
    """

    def __init__(self, budget: int, ttl_ms: int | None):
        self.budget = budget
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ledger = handle.getValueState("ledger", "spent bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.ledger.get()[0] if self.ledger.exists() else 0
        held = None
        for chunk in rows:
            invalid = chunk["reason"].notna()
            if invalid.any():
                bad = chunk[invalid]
                yield self._rows(key, bad, reason=bad["reason"], cost=None)
            pool = chunk[~invalid] if held is None else pd.concat([held, chunk[~invalid]])
            pool = pool.sort_values(["created_at", "id"], na_position="first")
            possible = pool.groupby("cost").cumcount() < (self.budget - before) // pool["cost"]
            if not possible.all():
                yield self._rows(key, pool[~possible], reason=OVER_BUDGET, cost=pool["cost"][~possible])
            held = pool[possible]
        if held is None or not len(held):
            return
        spent, fits, running = before, [], []
        for cost in held["cost"]:
            fits.append(spent + cost <= self.budget)
            spent += int(cost) if fits[-1] else 0
            running.append(spent if fits[-1] else None)
        if spent != before:
            self.ledger.update((spent,))
        reasons = [None if fit else OVER_BUDGET for fit in fits]
        yield self._rows(key, held, reason=reasons, cost=held["cost"], admitted=fits, spent=running)

    @staticmethod
    def _rows(key, rows: pd.DataFrame, reason, cost, admitted=False, spent=None) -> pd.DataFrame:
        n = len(rows)
        return pd.DataFrame(
            {
                "id": rows["id"].to_numpy(),
                "author_id": [key[0]] * n,
                "cost": pd.array([None] * n if cost is None else list(cost), dtype="Int64"),
                "admitted": admitted,
                "spent": pd.array([None] * n if spent is None else spent, dtype="Int64"),
                "reason": [reason] * n if isinstance(reason, str) else list(reason),
            }
        )


class TalkState(StatefulProcessor):
    """Routes turns by two switches: a conversation has drafts after its first draft, a post after it shipped one.

    The turns a conversation brings in one batch are ordered together: a number and two tool names each.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.switches = handle.getValueState("switches", "drafted boolean, posted boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        drafted, posted = self.switches.get() if self.switches.exists() else (False, False)
        turns = pd.concat(list(rows)).sort_values("turn", na_position="first")
        plain = turns["before_post"].to_numpy()
        # After turn i, something has been drafted if it was before or if a turn up to i drafts.
        drafts = np.logical_or.accumulate(plain == "draft") | drafted
        had_draft = np.r_[drafted, drafts[:-1]]
        ships = np.logical_or.accumulate((plain == "ship") & had_draft) | posted
        had_post = np.r_[posted, ships[:-1]]
        tools = np.where(had_post, turns["after_post"].to_numpy(), plain)
        self.switches.update((bool(drafts[-1]), bool(ships[-1])))
        yield pd.DataFrame({"conv_id": key[0], "turn": turns["turn"].to_numpy(), "tool": tools})
