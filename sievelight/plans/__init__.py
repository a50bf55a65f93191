"""The library's queries."""

from . import analysis, base, intake, learning, policies, relational, scalars, screening, stores, streams, texts

QUERIES, SQL = base.QUERIES, base.SQL
