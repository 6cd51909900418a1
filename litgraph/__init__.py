"""litgraph: a literature knowledge base as Spark jobs."""

from .model import Library
from .session import build_session

__all__ = ["Library", "build_session"]
