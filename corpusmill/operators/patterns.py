"""Configuration by path pattern.

Patterns are few and known on the driver: they compile into one expression per
option, evaluated in one pass, so that no nested-loop join is needed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths

#: Option -> type of its column.
OPTIONS = {
    "chunkOverlap": "int", "chunkProfile": "string", "exclude": "boolean", "maxChunkSize": "int", "minChunkSize": "int", "optional": "boolean", "priority": "int", "summarize": "boolean",
    "tags": "array<string>",
}


def specificity(pattern: str) -> int:
    """Letters and digits, 3 per slash, less 5 per star and 10 more per double star."""
    return len(re.findall("[A-Za-z0-9]", pattern)) - 5 * pattern.count("*") - 10 * pattern.count("**") + 3 * pattern.count("/")


@dataclass
class PatternSet:
    """V7: patterns with their options; the most specific that matches wins, option by option."""

    patterns: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for pattern, options in list(self.patterns.items()):
            self.add(pattern, options)

    def add(self, pattern: str, options: Mapping) -> None:
        unknown = set(options) - set(OPTIONS)
        if unknown:
            raise ValueError(f"unknown options for {pattern}: {', '.join(sorted(unknown))}")
        self.patterns[pattern] = dict(options)

    def remove(self, pattern: str) -> bool:
        return self.patterns.pop(pattern, None) is not None

    @classmethod
    def from_config(cls, config: Mapping) -> PatternSet:
        return cls(dict(config.get("patterns") or {}))

    @staticmethod
    def sample() -> dict:
        return {"patterns": {"api/**": {"chunkProfile": "code-heavy", "tags": ["api"]}, "faq/*.md": {"chunkProfile": "faq"}, "drafts/**": {"optional": True, "priority": -1}}}

    def ranked(self) -> list[tuple[str, dict]]:
        """Most specific first; ties in the order they were added."""
        return sorted(self.patterns.items(), key=lambda x: -specificity(x[0]))

    def matching(self, path: Column) -> Column:
        """the patterns that match, most specific first."""
        tests = [F.when(path.rlike(paths.glob_to_regex(p)), F.lit(p)) for p, _ in self.ranked()]
        return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")

    def matches_any(self, path: Column) -> Column:
        return F.size(self.matching(path)) > 0

    def option(self, path: Column, name: str) -> Column:
        """The value of one option; tags are united over all matching patterns."""
        rows = [(paths.glob_to_regex(p), o[name]) for p, o in self.ranked() if name in o]
        kind = OPTIONS[name]
        if name == "tags":
            each = [F.when(path.rlike(r), F.array(*map(F.lit, v))).otherwise(F.array().cast(kind)) for r, v in reversed(rows)]
            return F.array_distinct(F.concat(F.array().cast(kind), *each))
        return F.coalesce(F.lit(None).cast(kind), *(F.when(path.rlike(r), F.lit(v).cast(kind)) for r, v in rows))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with a column per option, named like the option after ``cfg_``."""
        return docs.withColumns({f"cfg_{name}": self.option(F.col("path"), name) for name in OPTIONS})
