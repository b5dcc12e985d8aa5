"""All registered queries and oracles."""

from contract import landing, listeners, marts, models, published, refine, views

_PARTS = [landing, refine, marts, models, listeners, views, published]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
