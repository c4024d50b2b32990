"""Running searches and builds as jobs: they can be watched and cancelled, and caches are dropped with the index they are of."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .query import MEDIA, SORTS

VERSION = "1"


@contextmanager
def job(spark: SparkSession, tag: str):
    """What runs inside can be cancelled, and watched, by its tag."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    """Cancel what runs under a tag; a new search of a client does so to its old one."""
    return spark.interruptTag(tag)


def progress(spark: SparkSession) -> dict[str, int]:
    """Tasks of the running stages: all, done, running and failed."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    return {"tasks": sum(s.numTasks for s in stages), "done": sum(s.numCompletedTasks for s in stages), "running": sum(s.numActiveTasks for s in stages), "failed": sum(s.numFailedTasks for s in stages)}


def emit(kind: str, text: str, lines: bool = True, out=None, **fields) -> None:
    """An event of a job as a line of JSON, or its text alone."""
    print(json.dumps({"type": kind, "text": text, **fields}, ensure_ascii=False) if lines else text, file=out or sys.stdout, flush=True)


class ResultCache:
    """Results of searches by their key, the oldest out first; all go when the index changes.

    What is kept are the keys and scores of the rows, not their texts, which are read for a page only.
    """

    def __init__(self, version: str, size: int = 16):
        self.version, self.size, self.held = version, size, {}

    def get(self, key: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
        if version != self.version:
            self.clear()
            self.version = version
        if key not in self.held:
            while len(self.held) >= self.size:
                self.held.pop(next(iter(self.held))).unpersist()
            self.held[key] = make().persist()
        self.held[key] = self.held.pop(key)
        return self.held[key]

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held = {}


def capabilities(analyzer_name: str) -> dict:
    """What this engine offers: media, orders, the analyzer, and the modes of known words."""
    return {"version": VERSION, "media": list(MEDIA), "sorts": list(SORTS), "analyzer": analyzer_name, "learn": ["first", "only"]}
