"""stopflow: stop-level timetable and delay analytics on Apache Spark."""

__version__ = "0.1.0"
