"""All registered queries and their SQL."""

from __future__ import annotations

from linkfold.plans import corpus_queries, star_queries, text_queries  # noqa: F401  (importing registers the queries)

QUERIES = star_queries.QUERIES
ORACLES = star_queries.ORACLES
