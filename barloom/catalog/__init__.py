"""All catalogued queries."""

from barloom import functions  # noqa: F401
from barloom.catalog import indicators, patterns, discovery, regimes, storage, evaluation, streams, models, rules, structure  # noqa: F401, I001
from barloom.catalog.base import QUERIES, SQL  # noqa: F401
