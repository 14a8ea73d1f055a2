"""All registered queries: importing the theme modules fills the registry."""
from leadvane.catalog import datasets, features, metrics, operations, outcomes, studies, summaries  # noqa: F401
from leadvane.catalog.base import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
