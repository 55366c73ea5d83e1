"""User rules from a JSON array file: ``{pattern, replacement?, label?, confidence?}`` per entry."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from maskwright.functions.dialect import literal_prefix
from maskwright.functions.expr import lit
from maskwright.rules import PRIORITIES, Rule

# What an entry means when a field is missing.
DEFAULTS = {"replacement": "[CUSTOM]", "label": "custom", "confidence": 1.0}


def rules_from_entries(entries: list[dict]) -> list[Rule]:
    """Rules in file order. Raises ``KeyError`` without a pattern and ``re.error`` on a bad one."""
    return [_rule(**{**DEFAULTS, "pattern": entry["pattern"], **entry}) for entry in entries]


def _rule(pattern: str, replacement: str, label: str, confidence, **_ignored) -> Rule:
    re.compile(pattern)
    prefix = literal_prefix(pattern)
    gate = f"contains({{x}}, {lit(prefix)})" if prefix else None
    return Rule("custom", label, pattern, replacement, float(confidence), PRIORITIES["custom"], gate=gate)


def read_patterns(spark: SparkSession, path: str, on_error: str = "raise") -> list[Rule]:
    """Load a pattern file from any filesystem Spark reads; of a folder or glob all files, by path.

    ``on_error="drop_all"``: a missing file, bad JSON, a missing ``pattern`` or one bad expression
    gives no rules at all. ``"raise"`` reports it. A confidence that is no number, an entry that
    is no object, or storage that cannot be read, is an error either way.
    """
    if on_error not in ("raise", "drop_all"):
        raise ValueError(f"on_error must be 'raise' or 'drop_all', not {on_error!r}")
    try:
        return [rule for content in _read(spark, path) for rule in rules_from_entries(json.loads(content))]
    except (json.JSONDecodeError, FileNotFoundError, KeyError, re.error):
        if on_error == "raise":
            raise
        return []


def _read(spark: SparkSession, path: str) -> list[str]:
    """The contents of small files; Spark's reader resolves the path, so cluster storage works."""
    try:
        files = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value").orderBy("file_path").collect()
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from exc
        raise
    if not files:
        raise FileNotFoundError(path)
    return [f.value for f in files]
