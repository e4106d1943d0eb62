"""Every operator as a query over the driver's tables, with its SQL twin."""

from tidemark.plans import history_queries, match_queries, misc_queries  # noqa: F401  they register themselves
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
