"""flowwatch: network and port scan detection over packet tables, on PySpark."""

from flowwatch.rules import Rules

__all__ = ["Rules"]
