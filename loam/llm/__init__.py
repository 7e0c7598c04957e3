"""Operations of a training-data pipeline. Nothing else in the library imports this."""

from . import bpe, decontamination, html, jaccard, language_model, media, quality, repeats, sharding, toxicity

_MODULES = (sharding, jaccard, repeats, decontamination, html, bpe, media, toxicity, quality, language_model)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
