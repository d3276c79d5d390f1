"""Named queries over the given tables and what they must return."""

from sitegrain.plans import audits, content, facts, page_audit, page_checks  # noqa: F401
from sitegrain.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
