"""All queries of this subpackage with their SQL, by name."""

from larkspur.llm import hnsw, language, licenses, merkle, mixing, ngram, packing, quality, runs, secrets, sharding, simhash, whitening

_MODULES = (mixing, simhash, secrets, merkle, sharding, packing, ngram, hnsw, quality, licenses, runs, language, whitening)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
