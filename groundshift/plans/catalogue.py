"""All queries outside the corpus subpackage."""

from . import queries_articles, queries_claims, queries_regions, queries_scenes, queries_scoring, queries_store  # noqa: F401
from . import queries_streams  # noqa: F401  after the others: it shares their SQL
from . import queries_entire  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
