"""Imports every query module, so that the registry is complete."""

from rulewright.plans import (  # noqa: F401
    declaration_queries, file_rule_queries, finding_queries, flow_queries, line_queries, line_rule_queries,
    metric_queries)
from rulewright.plans.registry import ORACLES, QUERIES  # noqa: F401
