"""Whole queries, each with the SQL that must return the same rows."""

from docketmill.plans import claims, compare, documents, figures, messages, ordering, outgoing, packages, retrieval, review, rounds, routes, scope, state, steps, streams  # noqa: F401
from docketmill.plans.registry import ORACLES, QUERIES  # noqa: F401
