"""Spark operators that compact the console output of developer commands and measure the saving."""

from logcompact.plans.compact import compact, compact_plain
from logcompact.operators.rules import apply_rules, match_rule
from logcompact.operators.savings import savings_summary

__all__ = ["apply_rules", "compact", "compact_plain", "match_rule", "savings_summary"]
