"""All queries of this subpackage and their SQL."""

from . import ann, benchmark, centroids, langid, lm, merkle, mixture, near, pii, quality, seekable, urls, warc

_MODULES = (quality, langid, near, benchmark, ann, warc, urls, seekable, lm, mixture, merkle, pii, centroids)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
