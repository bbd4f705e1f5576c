"""Parse tasks and page windows, as batch relations and as stateful streams.

A task log has rows (task_id, submit_order, status, ts). Batch functions take the whole log; the streams keep the last status of each task with
a time to live, and gather the pages of a document until all are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Pages that one window holds, seconds that an ended task is kept.
WINDOW_PAGES, RETENTION = 64, 86_400
ENDED = ("completed", "failed")


def last_status(log: DataFrame) -> DataFrame:
    """task_id, status, submit_order, ts: the newest row of each task (ties: the later status by name)."""
    newest = F.max_by(F.struct("status", "ts"), F.struct("ts", "status"))
    return log.groupBy("task_id").agg(newest.alias("n"), F.min("submit_order").alias("submit_order")).select("task_id", "n.status", "submit_order", "n.ts")


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def queued_ahead(tasks: DataFrame, keys: tuple[str, ...] = ("worker",)) -> DataFrame:
    """tasks with ahead: how many pending tasks of the same queue were submitted before."""
    before = Window.partitionBy(*keys).orderBy("submit_order").rowsBetween(Window.unboundedPreceding, -1)
    return tasks.withColumn("ahead", F.coalesce(F.sum((F.col("status") == "pending").cast("long")).over(before), F.lit(0)))


def is_expired(status: Column, ended: Column, now: Column, retention: int = RETENTION) -> Column:
    return status.isin(*ENDED) & (F.unix_timestamp(now) - F.unix_timestamp(ended) >= retention)


def live(tasks: DataFrame, now: Column, retention: int = RETENTION) -> DataFrame:
    return tasks.where(~is_expired(F.col("status"), F.col("ts"), now, retention))


def page_windows(documents: DataFrame, keys: tuple[str, ...] = (), size: int = WINDOW_PAGES) -> DataFrame:
    """keys, doc_id, window, first_page, last_page: pages of documents, in order of doc_id, cut into windows of `size` pages across documents.

    documents: keys, doc_id, pages. A document without pages has no row. Without keys all documents are one queue, numbered in one task: their
    count is that of a batch, not of the corpus.
    """
    before = Window.partitionBy(*keys).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = documents.where("pages > 0").withColumn("start", F.coalesce(F.sum("pages").over(before), F.lit(0)))
    rows = rows.withColumn("window", F.explode(F.expr(f"sequence(start div {size}, (start + pages - 1) div {size})")))
    return rows.select(*keys, "doc_id", "window", F.greatest(F.lit(0), F.col("window") * size - F.col("start")).alias("first_page"), (F.least(F.col("pages"), (F.col("window") + 1) * size - F.col("start")) - 1).alias("last_page"))


def pack_documents(documents: DataFrame, key: str, size: int = WINDOW_PAGES) -> DataFrame:
    """key, doc_id, pages, bin: by falling pages each document goes to the least filled bin that it fits; one of more than `size` pages is alone.

    A batch (one value of key) is one group.
    """
    kind = dict(documents.dtypes)

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["pages", "doc_id"], ascending=[False, True])
        filled: list[int] = []
        out = []
        for pages in batch["pages"]:
            fits = [(n, i) for i, n in enumerate(filled) if n + pages <= size] if pages <= size else []
            i = min(fits)[1] if fits else len(filled)
            if not fits:
                filled.append(0)
            filled[i] += int(pages)
            out.append(i)
        return batch.assign(bin=out)

    return documents.select(key, "doc_id", "pages").groupBy(key).applyInPandas(work, f"{key} {kind[key]}, doc_id {kind['doc_id']}, pages {kind['pages']}, bin int")


def task_stream(log: DataFrame, retention: int = RETENTION) -> DataFrame:
    """A stream of log rows -> task_id, status, ts at every change; an ended task's state goes `retention` seconds of event time after its end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, at = state.get if state.exists else ("", pd.Timestamp(0).value // 1000)
        changed = False
        for batch in batches:
            for s, ts in sorted(zip(batch["status"], batch["ts"].astype("int64") // 1000, strict=True), key=lambda x: (x[1], x[0])):
                if ts >= at and s != status:
                    status, at, changed = s, int(ts), True
        state.update((status, at))
        if status in ENDED:
            state.setTimeoutTimestamp(max(at // 1000 + retention * 1000, state.getCurrentWatermarkMs() + 1))
        if changed:
            yield pd.DataFrame({"task_id": [key[0]], "status": [status], "ts": [pd.Timestamp(at, unit="us")]})

    kind = dict(log.dtypes)["task_id"]
    return log.withWatermark("ts", "1 hour").groupBy("task_id").applyInPandasWithState(step, f"task_id {kind}, status string, ts timestamp", "status string, at long", "update", GroupStateTimeout.EventTimeTimeout)


def complete_documents(pages: DataFrame) -> DataFrame:
    """A stream of (doc_id, page_idx, page_count) -> doc_id, pages once every page of a document has come; a document of no pages has one row with page_idx null."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        count = 0
        for batch in batches:
            seen |= {int(p) for p in batch["page_idx"].dropna()}
            count = int(batch["page_count"].max())
        if len(seen) >= count:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "pages": [len(seen)]})
        else:
            state.update((sorted(seen),))

    kind = dict(pages.dtypes)["doc_id"]
    return pages.groupBy("doc_id").applyInPandasWithState(step, f"doc_id {kind}, pages int", "seen array<int>", "append", GroupStateTimeout.NoTimeout)
