"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import bpe, langid, linetree, packing, quality, spans, suffix, syncmers, voronoi, warc

_MODULES = (voronoi, packing, suffix, spans, quality, bpe, langid, linetree, syncmers, warc)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
