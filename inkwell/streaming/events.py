"""Change events as a stream: debounced bursts, dirty states that fire, and batches applied to a published index."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.operators import maintenance
from inkwell.sources import publish


def debounced(events: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """A stream of events (path, ts, seq) to one row per burst, when the watermark has passed its gap."""
    windows = events.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap).alias("w"))
    return windows.agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("events")).select("path", F.col("w.end").alias("fires_at"), "last_seq", "events")


FIRES = "path string, dirty_since timestamp, fires_at timestamp, events long"


def scheduled(events: DataFrame, quiet_s: int, cap_s: int, late: str = "10 seconds") -> DataFrame:
    """A stream of events (path, ts, kind) to when each path's dirty state fires: FIRES.

    A state fires a quiet time after its last event, or a longest time after its first. kind is null for
    a change; pause holds a path's fires back, resume lets them go on, and manual fires at once, which
    re-arms the state. Each path keeps four numbers and no events.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n, paused = state.get if state.exists else (None, None, 0, False)
        found = []

        def due() -> int:
            return min(last + quiet_s * 1000, start + cap_s * 1000)

        def fire(at: int) -> None:
            nonlocal start, n
            found.append((key[0], pd.Timestamp(start, unit="ms"), pd.Timestamp(at, unit="ms"), n))
            start, n = None, 0

        if state.hasTimedOut:
            if start is not None and not paused:
                fire(due())
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")  # of one path and one batch
            for ts, kind in zip(rows["ts"], rows["kind"]):
                now = int(ts.timestamp() * 1000)
                if start is not None and not paused and now >= due():
                    fire(due())
                if kind == "pause":
                    paused = True
                elif kind == "resume":
                    paused = False
                    if start is not None and now >= due():
                        fire(now)
                elif kind == "manual":
                    if start is not None:
                        fire(now)
                else:
                    start, last, n = now if start is None else start, now, n + 1
        if start is None and not paused:
            if state.exists:
                state.remove()
        else:
            state.update((start, last, n, paused))
            if start is not None and not paused:
                state.setTimeoutTimestamp(max(due(), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["path", "dirty_since", "fires_at", "events"])

    marked = events.select("path", "ts", "kind").withWatermark("ts", late)
    return marked.groupBy("path").applyInPandasWithState(step, FIRES, "start long, last long, n long, paused boolean", "append", GroupStateTimeout.EventTimeTimeout)


class Diagnostics(StreamingQueryListener):
    """The last fifty things that streams reported, oldest first."""

    def __init__(self, most: int = 50) -> None:
        self.last: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        self.last.append(("started", str(event.id), None))

    def onQueryProgress(self, event) -> None:
        self.last.append(("progress", str(event.progress.id), event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        self.last.append(("idle", str(event.id), None))

    def onQueryTerminated(self, event) -> None:
        self.last.append(("ended", str(event.id), event.exception))


@dataclass(frozen=True)
class Rules:
    """What isn't indexed, by path and by text, and how notes (path, text) become chunks (path, …)."""

    excluded: Column
    content_excluded: Column
    chunk: Callable[[DataFrame], DataFrame]


#: Paths, some 100 bytes each, up to which a batch finds their notes and chunks by broadcast, so that no text is shuffled for it; more are joined by a shuffle.
BROADCAST_PATHS = 1_000_000

Mark = Callable[[DataFrame], DataFrame]


def marked(n: int) -> Mark:
    """Marks tables of about n paths for a broadcast, if these are few."""
    return F.broadcast if n <= BROADCAST_PATHS else lambda paths: paths


def rebuild(own: publish.Writer, vault: DataFrame, rules: Rules) -> dict:
    """Publish the index and chunks of all notes of vault (path, hash, text, …) that aren't excluded, as one version; returns the counts.

    The index has the vault's columns but text. Readers see the version before until all of it is written.
    """
    flags = vault.withColumn("_p", F.coalesce(rules.excluded, F.lit(False))).withColumn("_c", F.coalesce(rules.content_excluded, F.lit(False)))
    totals = flags.agg(F.count_if(~F.col("_p") & ~F.col("_c")).alias("notes"), F.count_if("_p").alias("excluded_by_path"), F.count_if(~F.col("_p") & F.col("_c")).alias("excluded_by_content")).first().asDict()
    kept = flags.where("not _p and not _c").drop("_p", "_c")
    now = own.publish({"index": kept.drop("text"), "chunks": rules.chunk(kept.select("path", "text"))}, {"index": "path", "chunks": "path"}, {"text": totals})
    return totals | {"chunks": now.manifest["rows"]["chunks"]}


def apply_changes(own: publish.Writer, changes: DataFrame, vault: DataFrame | Callable[[DataFrame, Mark], DataFrame], rules: Rules) -> int:
    """Bring the published index and chunks up to date with coalesced changes (type, path, old_path), as one version; returns how many paths changed.

    vault (path, hash, text, …), or a function of distinct paths (path) and a Mark for tables about as long as these that gives their notes, is read once, for the changed paths only, and pinned down, so that index and
    chunks come from the same texts whatever happens to the vault meanwhile. Only paths whose row changed are chunked again;
    all others' chunks are carried over. Without a changed path nothing is published. Chunks of a path are those of its text in
    the index: after any batch both are what a rebuild of the notes in the index would give.
    """
    spark, index, chunks = own.spark, own.read("index"), own.read("chunks")
    with publish.staged(spark, own.root) as folder:

        def pinned(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        changes = pinned(changes.select("type", "path", "old_path"), "changes")
        wanted = pinned(changes.where("type <> 'delete'").select("path").distinct(), "wanted")
        mark = marked(wanted.count())  # from the files' footers
        found = vault(wanted, mark) if callable(vault) else vault.join(mark(wanted), "path", "left_semi")
        texts = pinned(found.select(*index.columns, "text"), "texts")
        after = maintenance.apply_batch(index, changes, texts, rules.excluded, rules.content_excluded)
        changed = pinned(maintenance.changed_paths(index, after), "changed")
        n = changed.count()
        if n:
            changed = marked(n)(changed)
            stays = texts.join(changed.where("stays"), "path", "left_semi").select("path", "text")
            own.publish({"index": after, "chunks": maintenance.replace_chunks(chunks, changed, rules.chunk(stays))}, {"index": "path", "chunks": "path"})
    return n


def catch_up(own: publish.Writer, vault: DataFrame, rules: Rules, reread: bool = False) -> dict:
    """Reconcile the published index with the vault (path, hash, size, mtime, text) before a stream starts; returns counts of events and of changed paths.

    Paths, sizes and times are compared; notes that are new or changed, and deletes of what is gone or excluded by
    path, go through apply_changes() like a batch of events, so nothing that is excluded by its text gets in. With reread the texts of
    all notes are held against the rules as well: that is for rules that have changed. Events that came before are
    compacted to this one reconciliation: what they led to is in the vault.
    """
    banned = F.coalesce(rules.excluded, F.lit(False))
    if reread:
        banned = banned | F.coalesce(rules.content_excluded, F.lit(False))
    plan = maintenance.reconcile(vault.where(~banned), own.read("index")).select(F.col("change_type").alias("type"), "path", F.lit(None).cast("string").alias("old_path"))
    with publish.staged(own.spark, own.root) as folder:
        plan.write.parquet(f"{folder}/plan")
        plan = own.spark.read.schema(plan.schema).parquet(f"{folder}/plan")
        counts = dict.fromkeys(("create", "modify", "delete"), 0) | {r["type"]: r["n"] for r in plan.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
        return counts | {"changed": apply_changes(own, plan, vault, rules) if any(counts.values()) else 0}


def apply_stream(events: DataFrame, root: str, vault: DataFrame | Callable[[DataFrame, Mark], DataFrame], rules: Rules, checkpoint: str, role: publish.Role = publish.Role()) -> DataStreamWriter:
    """Coalesce each micro-batch of events (seq, type, path, old_path) and publish the index and chunks that result, in one version.

    A batch that fails, as one does that another writer came before, is retried by the engine with the same events;
    applying them again gives the same index, since created, modified and moved notes are rebuilt from the vault.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            with publish.writer(batch.sparkSession, root, "automatic-batch", role) as own:
                apply_changes(own, maintenance.coalesce_events(batch), vault, rules)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
