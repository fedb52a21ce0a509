"""Conversation memory at scale: sessions, long-term memory, journals and recall as Spark jobs."""

__version__ = "0.1.0"
