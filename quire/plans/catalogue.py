"""All queries of the library's own operators, and the SQL that says the same."""

from . import books, imports, metadata, more, scalars
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "books", "imports", "metadata", "more", "scalars"]
