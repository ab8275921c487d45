"""vistrel: vector-retrieval evaluation and support selection as PySpark plans."""

from vistrel.session import session

__all__ = ["session"]
