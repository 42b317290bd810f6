"""All registered queries and their SQL."""

from . import chunking, compare, documents, nested, registry, relational, summaries
from .register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "chunking", "compare", "documents", "nested", "registry", "relational", "summaries"]
