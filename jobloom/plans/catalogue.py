"""All queries over the job catalogue and the SQL they must agree with."""

from jobloom.plans import analytics, boards, identity, lifecycle, matching, operations, persist, text  # noqa: F401
from jobloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
