"""Settings of the service: keyword, else the session's ``spark.lodestar.*`` conf, else ``LODESTAR_*`` in the environment, else a default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

OFF = ("0", "false", "no")


@dataclass(frozen=True)
class Settings:
    data: str = "data/documents.jsonl"
    semantic: bool = True
    encoder: str = "hashing"
    semantic_weight: float = 0.05


def settings(spark: SparkSession, **given: object) -> Settings:
    """All settings of a session; a keyword that is no setting raises TypeError."""
    found: dict[str, object] = {}
    for f in fields(Settings):
        raw = spark.conf.get(f"spark.lodestar.{f.name}", None) or os.environ.get(f"LODESTAR_{f.name.upper()}")
        if raw:
            found[f.name] = raw.lower() not in OFF if isinstance(f.default, bool) else type(f.default)(raw)
    return Settings(**(found | given))
