"""All registered queries and their SQL."""

from gridcast.plans import section_ab, section_cd, section_ef, section_g, section_h, section_ik, section_models, section_tables  # noqa: F401
from gridcast.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
