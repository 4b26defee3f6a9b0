"""Progress of streaming runs, for the log."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("argolith")


class Progress(StreamingQueryListener):
    """Logs how many conversations each micro-batch took and how many there have been."""

    def __init__(self) -> None:
        self.done = 0

    def onQueryStarted(self, event) -> None:
        log.info("started %s", event.name or event.id)

    def onQueryProgress(self, event) -> None:
        self.done += event.progress.numInputRows
        log.info("batch %d: %d conversations, %d in all", event.progress.batchId, event.progress.numInputRows, self.done)

    def onQueryTerminated(self, event) -> None:
        log.info("ended %s%s", event.id, f": {event.exception}" if event.exception else "")


def watch(spark: SparkSession) -> Progress:
    p = Progress()
    spark.streams.addListener(p)
    return p
