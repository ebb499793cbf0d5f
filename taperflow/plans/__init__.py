"""The library's queries, by operator name."""

from . import evaluate, forecast, prepare, storage, studies  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
