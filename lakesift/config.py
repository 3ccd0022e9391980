"""Scan configuration, read from YAML on the driver.

A missing file gives the defaults. A file that is not YAML gives the defaults and a warning. Unknown keys are ignored. Patterns that are
not regular expressions and frameworks that are unknown are left out with a warning.
"""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import dataclass, field
from typing import Any

from lakesift.rules.sinks import KIND_ALIASES

LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go",
    "java": "java", "cs": "csharp",
}
DEFAULT_EXCLUDE = (
    "node_modules/** **/*.test.ts **/*.test.js **/*.spec.ts **/*.spec.js **/test_*.py **/*_test.py dist/** build/** .git/** __pycache__/**"
).split()
FRAMEWORK_NAMES = {"gdpr": "gdpr", "ccpa": "ccpa", "appi": "appi", "hipaa": "hipaa", "pci-dss": "pci_dss", "pcidss": "pci_dss", "pci_dss": "pci_dss"}


@dataclass
class CustomType:
    name: str
    patterns: list[str]
    severity: str = "high"


@dataclass
class CustomSink:
    pattern: str
    kind: str
    allowed: bool = False


@dataclass
class PathRule:
    """An exception for paths: ``skip``, ``reduce_severity`` (to ``max_severity``) or ``suppress_low``."""

    paths: list[str]
    action: str = "skip"
    max_severity: str | None = None


@dataclass
class Config:
    languages: list[str] = field(default_factory=lambda: ["typescript", "javascript", "python"])
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDE))
    include: list[str] = field(default_factory=list)
    max_file_size: int = 1_048_576
    frameworks: list[str] = field(default_factory=lambda: ["gdpr"])
    fail_on: str = "high"
    min_display: str = "low"
    allow: list[str] = field(default_factory=list)
    custom_sinks: list[CustomSink] = field(default_factory=list)
    exceptions: list[PathRule] = field(default_factory=list)
    custom_types: list[CustomType] = field(default_factory=list)
    ignore_types: list[str] = field(default_factory=list)


def parse_frameworks(names: list[str]) -> list[str]:
    """Known frameworks in the given order, each once; unknown names are warned about."""
    out: list[str] = []
    for n in names:
        known = FRAMEWORK_NAMES.get(str(n).strip().lower())
        if known is None:
            warnings.warn(f"unknown framework {n!r}", stacklevel=2)
        elif known not in out:
            out.append(known)
    return out


def valid_pattern(pattern: Any) -> bool:
    """Whether a pattern is a regular expression; warns if not."""
    try:
        re.compile(str(pattern))
        return True
    except re.error as e:
        warnings.warn(f"invalid pattern {pattern!r}: {e}", stacklevel=2)
        return False


def config_of(tree: Any) -> Config:
    """The configuration in a parsed YAML tree."""
    c = Config()
    if not isinstance(tree, dict):
        return c
    scan, rules, types, severity = ((tree.get(k) or {}) for k in ("scan", "rules", "pii_types", "severity"))
    c.languages = list(scan.get("languages", c.languages))
    c.exclude = list(scan.get("exclude", c.exclude))
    c.include = list(scan.get("include", c.include))
    c.max_file_size = int(scan.get("max_file_size", c.max_file_size))
    if "frameworks" in tree:
        c.frameworks = parse_frameworks(list(tree["frameworks"] or []))
    c.fail_on = str(severity.get("fail_on", c.fail_on)).lower()
    c.min_display = str(severity.get("min_display", c.min_display)).lower()
    c.allow = [str(a) for a in rules.get("allow_identifiers") or []]
    c.custom_sinks = [
        CustomSink(s["pattern"], KIND_ALIASES.get(str(s.get("kind", "")), "third_party_api"), bool(s.get("allowed", False)))
        for s in rules.get("custom_sinks") or []
        if valid_pattern(s.get("pattern", ""))
    ]
    c.exceptions = [PathRule(list(e.get("paths") or []), e.get("action", "skip"), e.get("max_severity")) for e in rules.get("exceptions") or []]
    for t in types.get("custom") or []:
        good = [p for p in t.get("patterns") or [] if valid_pattern(p)]
        if good:
            c.custom_types.append(CustomType(t["name"], good, str(t.get("severity") or "high").lower()))
    for d in rules.get("deny_identifiers") or []:
        if valid_pattern(d.get("pattern", "")):
            c.custom_types.append(CustomType(d.get("pii_type", "denied"), [d["pattern"]], str(d.get("severity") or "high").lower()))
    c.ignore_types = [str(t) for t in types.get("ignore") or []] + [str(t) for t in rules.get("ignore_findings") or []]
    return c


def read_config(path: str) -> Config:
    """The configuration in a YAML file."""
    if not os.path.exists(path):
        return Config()
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return config_of(yaml.safe_load(f))
    except Exception as e:  # noqa: BLE001 - whatever is wrong with the file, the scan goes on with the defaults
        warnings.warn(f"{path}: {e}; defaults are used", stacklevel=2)
        return Config()
