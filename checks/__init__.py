"""Registered queries over the given tables, each with its SQL equivalent where SQL has one."""

from . import history, layout, profiles, scans, schemas, sinks, streams  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
