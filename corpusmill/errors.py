"""Errors with exit codes and advice."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

EXIT = {"ok": 0, "generic": 1, "configuration": 2, "input": 3, "processing": 4, "output": 5, "validation": 6}


class BuildError(Exception):
    """Base of all errors of a build; ``kind`` sets the exit code."""

    kind = "generic"
    advice: tuple[str, ...] = ("run again with --verbose and read the last lines",)

    @property
    def exit_code(self) -> int:
        return EXIT[self.kind]


class ConfigurationError(BuildError):
    kind = "configuration"
    advice = ("check the names and types in the configuration file", "write a sample with --init-config")


class InputError(BuildError):
    kind = "input"
    advice = ("check that the input directory exists and can be read", "check the include and exclude globs")


class ProcessingError(BuildError):
    kind = "processing"
    advice = ("look at the listed files", "go on past failed files with --continue-on-error")


class OutputError(BuildError):
    kind = "output"
    advice = ("check that the output directory can be written and has room",)


class ValidationError(BuildError):
    kind = "validation"
    advice = ("look at the issues in the report",)


def categorize(error: BaseException) -> BuildError:
    """The error as one of the classes, by its type, then by its message."""
    if isinstance(error, BuildError):
        return error
    message = str(error)
    low = message.lower()
    if isinstance(error, (FileNotFoundError, NotADirectoryError)) or "path does not exist" in low:
        return InputError(message)
    if isinstance(error, PermissionError) or "permission denied" in low or "no space left" in low:
        return OutputError(message)
    if "config" in low or "option" in low:
        return ConfigurationError(message)
    if "valid" in low:
        return ValidationError(message)
    return ProcessingError(message)


@dataclass
class ErrorLog:
    """Errors and warnings of a run."""

    continue_on_error: bool = False
    errors: list[BuildError] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def handle(self, error: BaseException) -> None:
        """Keep the error; raise it unless the run goes on past errors."""
        known = categorize(error)
        self.errors.append(known)
        if not self.continue_on_error:
            raise known from error

    def warn(self, message: str) -> None:
        self.warnings.append(message)

    def summary(self) -> dict:
        """A16."""
        return {"errors": len(self.errors), "warnings": len(self.warnings), "by_kind": dict(Counter(e.kind for e in self.errors))}

    def fatal(self) -> bool:
        """errors that no run may pass over."""
        return any(e.kind in ("configuration", "input", "output") for e in self.errors)

    def clear(self) -> None:
        self.errors.clear()
        self.warnings.clear()
