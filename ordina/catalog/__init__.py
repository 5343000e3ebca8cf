"""All queries of the library's own operators, by id and name."""

from __future__ import annotations

from . import graphs, joins, sequences, spatial

CATALOGS = (sequences.CATALOG, graphs.CATALOG, spatial.CATALOG, joins.CATALOG)
QUERIES = {name: query for catalog in CATALOGS for name, query in catalog.queries.items()}
SQL = {name: sql for catalog in CATALOGS for name, sql in catalog.sql.items()}
