"""Where a resumable load stands: one JSON record, read with defaults, null if it is missing or broken.

With a session the record is a file of Spark's file systems, so a driver on another machine can go on; without one it is
a local file.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from stemma.store import put_text, read_text, remove


@dataclass
class Progress:
    phase: str = "names"
    type: str | None = None
    after: str | None = None
    windowStart: int | None = None
    searchOffset: int | None = None
    uriPrefix: str | None = None
    pendingPrefixes: list[str] = field(default_factory=list)
    completedTypes: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Progress | None:
        try:
            if spark:
                raw = json.loads(read_text(spark, path) or "null")
            else:
                with open(path, encoding="utf-8") as f:
                    raw = json.load(f)
        except (OSError, ValueError):
            return None
        if not isinstance(raw, dict):
            return None
        return cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__ and v is not None})

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        if spark:
            return put_text(spark, path, json.dumps(asdict(self)))
        part = path + ".part"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f)
        os.replace(part, path)

    @staticmethod
    def clear(path: str, spark: SparkSession | None = None) -> None:
        if spark:
            remove(spark, path)
        elif os.path.exists(path):
            os.remove(path)


def choose_input(dump: str | None = None, env: str | None = None, fixture: str | None = None, default: str | None = None, download: str | None = None) -> str:
    """The dictionary file to read; a downloaded one comes before all others. A missing file is an error."""
    path = next((p for p in (download, dump, env, fixture, default) if p), None)
    if path is None or not os.path.exists(path):
        raise FileNotFoundError(f"no dictionary file: {path}")
    return path
