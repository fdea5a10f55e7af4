"""Sinks whose batches can be replayed: each batch writes its own folder, a replay the same one again."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

#: The folder level of a batch; readers see it as a column.
BATCH = "batch_id"


def by_batch(path: str, kind: str = "parquet", **options: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch to ``path``/batch_id=<id>, in place of what a run of that batch that did not end has left there."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.format(kind).options(**options).mode("overwrite").save(f"{path.rstrip('/')}/{BATCH}={batch}")

    return write


def start(stream: DataFrame, path: str, checkpoint: str, audit: Callable[[DataFrame], DataFrame] | None = None, audit_path: str | None = None, kind: str = "parquet", **trigger: object) -> StreamingQuery:
    """Results of a stream to ``path`` and, if asked for, audit events made of them to ``audit_path``, both by batch.

    Results first; a failure of the audit is told in the log and changes nothing else.  The batch is kept in memory or on
    the executors' disks between the two, so that its rows are made once.
    """
    results, events = by_batch(path, kind), by_batch(audit_path, "json") if audit_path else None

    def write(df: DataFrame, batch: int) -> None:
        if events is None or audit is None:
            results(df, batch)
            return
        df.persist()
        try:
            results(df, batch)
            try:
                events(audit(df), batch)
            except Exception:
                logging.getLogger(__name__).warning("audit events of batch %s are not written", batch, exc_info=True)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
