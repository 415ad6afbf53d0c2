"""Control data: rule files, project rules. Small by nature, read on the driver with a size check."""

from __future__ import annotations

import json
import logging
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcompact import schemas
from logcompact.functions.dialect import UnsupportedPattern, is_valid, translate

log = logging.getLogger(__name__)

# Rules become literal expressions of the plan, so there cannot be many; files beyond this are
# not rule files.
MAX_CONTROL_BYTES = 16 << 20


@dataclass(frozen=True)
class MatchOutput:
    pattern: str = ""
    message: str = ""
    unless: str = ""


@dataclass(frozen=True)
class Rule:
    """One rule; a zero limit and an empty text mean "not set"."""

    name: str
    match_command: str = ""
    strip_ansi: bool = False
    replace: tuple[tuple[str, str], ...] = ()
    match_output: tuple[MatchOutput, ...] = ()
    strip_lines: tuple[str, ...] = ()
    keep_lines: tuple[str, ...] = ()
    truncate_at: int = 0
    max_lines: int = 0
    tail_lines: int = 0
    on_empty: str = ""
    source: str = ""

    def patterns(self) -> list[str]:
        found = [self.match_command, *self.strip_lines, *self.keep_lines]
        found += [pattern for pattern, _ in self.replace]
        found += [p for entry in self.match_output for p in (entry.pattern, entry.unless)]
        return [p for p in found if p]


@dataclass(frozen=True)
class RuleTest:
    rule: str
    name: str
    input: str
    expected: str


@dataclass(frozen=True)
class RuleFile:
    rules: tuple[Rule, ...] = ()
    tests: tuple[RuleTest, ...] = field(default=())


def parse_rules(content: str, source: str = "") -> RuleFile:
    """Rules and inline tests of one TOML text.

    A text that is not valid gives no rules; a rule with an invalid pattern is dropped whole.
    """
    try:
        doc = tomllib.loads(content)
        rules = [_rule(name, spec, source) for name, spec in doc.get("filters", {}).items()]
        tests = [
            RuleTest(rule, case.get("name", ""), case.get("input", ""), case.get("expected", ""))
            for rule, cases in doc.get("tests", {}).items()
            for case in cases
        ]
    except (tomllib.TOMLDecodeError, TypeError, AttributeError, ValueError) as problem:
        log.warning("no rules from %s: %s", source or "text", problem)
        return RuleFile()
    valid = tuple(rule for rule in rules if all(map(is_valid, rule.patterns())))
    return RuleFile(valid, tuple(tests))


def _rule(name: str, spec: dict, source: str) -> Rule:
    return Rule(
        name=name,
        match_command=str(spec.get("match_command", "")),
        strip_ansi=bool(spec.get("strip_ansi", False)),
        replace=tuple(
            (r.get("pattern", ""), r.get("replacement", "")) for r in spec.get("replace", [])
        ),
        match_output=tuple(
            MatchOutput(m.get("pattern", ""), m.get("message", ""), m.get("unless", ""))
            for m in spec.get("match_output", [])
        ),
        strip_lines=tuple(spec.get("strip_lines_matching", [])),
        keep_lines=tuple(spec.get("keep_lines_matching", [])),
        truncate_at=int(spec.get("truncate_lines_at", 0)),
        max_lines=int(spec.get("max_lines", 0)),
        tail_lines=int(spec.get("tail_lines", 0)),
        on_empty=str(spec.get("on_empty", "")),
        source=source,
    )


def _contents(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(path, text) of the control files under a path, in name order; none when unreadable."""
    try:
        files = spark.read.format("binaryFile").load(path)
        total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        if total > MAX_CONTROL_BYTES:
            raise ValueError(f"{path} holds {total} bytes of control data")
        rows = files.orderBy("path").select("path", "content").collect()
    except ValueError:
        raise
    except Exception as problem:  # an absent or unreadable file gives no rules
        log.warning("cannot read %s: %s", path, type(problem).__name__)
        return []
    return [(row.path, bytes(row.content).decode("utf-8", "replace")) for row in rows]


def read_rules(spark: SparkSession, path: str) -> RuleFile:
    """Rules of a TOML file, or of a directory or glob of them in name order."""
    files = [parse_rules(text, source) for source, text in _contents(spark, path)]
    return RuleFile(
        tuple(rule for file in files for rule in file.rules),
        tuple(test for file in files for test in file.tests),
    )


def builtin_rules() -> RuleFile:
    """The rules that come with the package, in name order."""
    folder = Path(__file__).parent.parent / "data" / "rules"
    files = [parse_rules(f.read_text("utf-8"), f.name) for f in sorted(folder.glob("*.toml"))]
    rules = sorted((rule for file in files for rule in file.rules), key=lambda rule: rule.name)
    return RuleFile(tuple(rules), tuple(test for file in files for test in file.tests))


def merge_rules(*sources: Iterable[Rule]) -> tuple[Rule, ...]:
    """Rules of several sources, highest priority first; nothing is dropped."""
    return tuple(rule for source in sources for rule in source)


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [
        (
            priority, r.source, r.name, r.match_command, r.strip_ansi, list(r.replace),
            [(m.pattern, m.message, m.unless) for m in r.match_output],
            list(r.strip_lines), list(r.keep_lines),
            r.truncate_at, r.max_lines, r.tail_lines, r.on_empty,
        )
        for priority, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, schemas.RULES)


def rule_tests_table(spark: SparkSession, tests: Iterable[RuleTest]) -> DataFrame:
    rows = [(t.rule, t.name, t.input, t.expected) for t in tests]
    return spark.createDataFrame(rows, schemas.RULE_TESTS)


@dataclass(frozen=True)
class ProjectRule:
    match: str
    action: str


def parse_project_rules(content: str) -> tuple[ProjectRule, ...]:
    """``{"rules": [{"match": ..., "action": ...}]}``; an invalid pattern is skipped with a warning."""
    try:
        found = json.loads(content).get("rules") or []
        rules = [ProjectRule(str(r.get("match", "")), str(r.get("action", ""))) for r in found]
    except (ValueError, AttributeError, TypeError) as problem:
        log.warning("no project rules: %s", problem)
        return ()
    kept = []
    for rule in rules:
        try:
            translate(rule.match)
        except UnsupportedPattern as problem:
            log.warning("project rule %r skipped: %s", rule.match, problem)
        else:
            kept.append(rule)
    return tuple(kept)


def read_project_rules(spark: SparkSession, path: str) -> tuple[ProjectRule, ...]:
    return tuple(r for _, text in _contents(spark, path) for r in parse_project_rules(text))


def project_rules_table(spark: SparkSession, rules: Iterable[ProjectRule]) -> DataFrame:
    return spark.createDataFrame([(r.match, r.action) for r in rules], schemas.PROJECT_RULES)
