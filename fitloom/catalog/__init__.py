"""All verified queries: importing the package registers them."""

from fitloom.catalog.base import ORACLES, QUERIES, Inputs, callables  # noqa: F401
from fitloom.catalog import profiles, texts, vectors, matching, stores, evaluation  # noqa: F401
