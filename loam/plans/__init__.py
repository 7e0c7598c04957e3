"""Registered queries over the test tables and their SQL counterparts."""

from . import analysis, corpus, store, vectors

QUERIES = vectors.QUERIES | corpus.QUERIES | analysis.QUERIES | store.QUERIES
ORACLE_SQL = vectors.ORACLE_SQL | corpus.ORACLE_SQL | analysis.ORACLE_SQL | store.ORACLE_SQL
