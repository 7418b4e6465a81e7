"""Registered queries; importing this package fills the registry."""

from plumbline.plans import (  # noqa: F401
    profiling, content, integrity, graph, storage, logs, corpus, report, repairs, streams, estate,
)
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
