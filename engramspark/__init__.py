"""engramspark: long-term associative memory and graph retrieval as Spark jobs."""

from .config import MemoryConfig
from .session import get_session, materialize

__all__ = ["MemoryConfig", "get_session", "materialize"]
