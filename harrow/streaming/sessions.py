"""Structured Streaming forms of the stateful operators: page baselines, requests in flight, windowed verdict counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harrow.functions import pages, urls
from harrow.operators.relevance import SIMILAR



def _timeout(idle_ms: int | None) -> str:
    """idle_ms is how long the state of a session that is heard of no more is kept. A query with such a time limit runs
    batches without new data too, so it never ends by itself; without a limit (None) it can be run to the end of its input."""
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def full_analyses(views: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of views (conv_id, turn, text) with whether each needs a full analysis: it differs by more than a fifth
    from the last one analysed in full, which is the state of a conversation. Turns of one batch are taken in order. The
    state goes after idle_ms without a turn (None: never); the next turn is then analysed in full."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        base = Counter((state.get[0] or "").split()) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for text in rows["text"].fillna(""):
            own = Counter(text.split())
            total = sum((own | base).values()) if base is not None else 0
            full = base is None or (sum((own & base).values()) / total if total else 1.0) < SIMILAR
            if full:
                base = own
                state.update((text,))
            out.append(full)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": key[0], "turn": rows["turn"], "full": out})

    return views.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, full boolean", "text string", "append", _timeout(idle_ms))


def closed_requests(log: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of request events (session_id, ts, kind, method, url) as closed requests with their duration; starts wait
    in the state of their session, which is dropped when nothing waits, or after idle_ms (None: never)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(*state.get)) if state.exists else {}
        out = []
        for r in pd.concat(list(batches)).sort_values("ts").itertuples():
            name = f"{r.method}:{r.url}"
            if r.kind == "started":
                held[name] = r.ts
            else:
                began = held.pop(name, None)
                if began is not None or r.kind == "failed":
                    out.append((key[0], r.method, r.url, "failed" if r.kind == "failed" else "completed", None if began is None else r.ts - began))
        if held:
            state.update((list(held), list(held.values())))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "method", "url", "state", "duration"])

    schema = "session_id long, method string, url string, state string, duration double"
    return log.select("session_id", F.col("ts").cast("double").alias("ts"), "kind", "method", "url").groupBy("session_id").applyInPandasWithState(step, schema, "names array<string>, starts array<double>", "append", _timeout(idle_ms))


def verdict_counts(captures: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """A stream of captures (ts, url, target_url, status, html) as numbers of verdicts by time window and host."""
    verdict = pages.verify_page(F.col("status"), F.col("url"), F.col("html"), None, None, F.col("target_url"))
    seen = captures.withWatermark("ts", late).select("ts", urls.host(F.col("target_url")).alias("host"), verdict.alias("verdict"))
    return seen.groupBy(F.window("ts", every).alias("w"), "host", "verdict").agg(F.count("*").alias("n")).select("w.start", "w.end", "host", "verdict", "n")
