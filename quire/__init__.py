"""Document-corpus analytics on Spark: whole libraries of digital books as DataFrames.

``quire.operators`` has the operators, ``quire.functions`` scalar functions and predicates,
``quire.sources`` readers, ``quire.streaming`` keyed state, ``quire.plans`` the query catalogue.
"""

from quire.operators.archive import archived, containers, packed, restored, unpacked
from quire.operators.metadata import merge_plan, read, written
from quire.operators.modernize import Options, modernized
from quire.operators.structure import book, imported
from quire.sources.containers import entries
from quire.session import local_session

__all__ = ["Options", "archived", "book", "containers", "entries", "imported", "local_session", "merge_plan", "modernized", "packed", "read", "restored", "unpacked", "written"]
