"""Find and mask sensitive values in text columns of Spark tables and streams."""

from maskwright.operators.many_rules import RuleTable
from maskwright.plans.sanitize import (
    raw_findings, register_sql, sanitize, sanitize_text, with_candidates, with_spans,
)
from maskwright.rules import (
    Detector, Rule, RuleSet, default_rules, profile_names, rules_for_profile,
)

__all__ = [
    "Detector", "Rule", "RuleSet", "RuleTable", "default_rules", "profile_names", "raw_findings", "register_sql",
    "rules_for_profile", "sanitize", "sanitize_text", "with_candidates", "with_spans",
]
