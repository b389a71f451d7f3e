"""Diagnostics of database fleets on Spark."""

from vitalgrid.fleet import Fleet, TableSource
from vitalgrid.session import build_session

__all__ = ["Fleet", "TableSource", "build_session"]
