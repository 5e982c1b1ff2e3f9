"""Imports every binding module, so that all queries are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitsignal.bindings import episodes as _episodes
from pitsignal.bindings import options as _options  # noqa: F401
from pitsignal.bindings import policies as _policies  # noqa: F401
from pitsignal.bindings import records as _records  # noqa: F401
from pitsignal.bindings import research as _research  # noqa: F401
from pitsignal.bindings import streams as _streams  # noqa: F401
from pitsignal.bindings.base import ORACLES, QUERIES, flat
from pitsignal.session import use_utc

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_episodes.flagship(use_utc(spark), sf_dir))
