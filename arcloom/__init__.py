"""Set-at-a-time analytics over tables of links ``(id, source, target)`` on Spark."""

__version__ = "0.1.0"
