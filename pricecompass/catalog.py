"""Registered queries of the library and their SQL; those of the corpus subpackage are added elsewhere."""

from .plans import ingest, outcomes, pages, progress, requests, search, web

#: All plans register with those of the search.
_PLANS = (search, web, pages, ingest, outcomes, requests, progress)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
