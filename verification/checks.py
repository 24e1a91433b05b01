"""All registered queries."""

from . import checks_access, checks_audit, checks_other, checks_search, checks_sql, checks_tree  # noqa: F401
from .registry import CHECKS

__all__ = ["CHECKS"]
