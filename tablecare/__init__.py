"""Data quality and table repair on Spark: profile, calibrate, validate, repair, quarantine, version."""

from tablecare.spec import Fix, FixError, Rule, RuleError, RunOptions, TableSpec

__all__ = ["Fix", "FixError", "Rule", "RuleError", "RunOptions", "TableSpec"]
