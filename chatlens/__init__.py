"""Chat analytics on Spark: delay and word metrics, read cursors, reports, graph rank."""

__version__ = "0.1.0"
