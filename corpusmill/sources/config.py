"""Configuration: defaults, files, merging.

A value given on the command line beats one in a file, which beats the default; a
default never beats a file. Lists of the include, exclude and tag kind are united.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from corpusmill.errors import ConfigurationError

NAMES = tuple(f"corpusmill.config.{e}" for e in ("json", "yaml", "yml")) + tuple(f".corpusmillrc{e}" for e in ("", ".json", ".yaml", ".yml"))
UNITED = ("include", "exclude", "optional", "exclude_tokens")


@dataclass
class Options:
    input: str = "."
    output: str = "."
    base_url: str | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    exclude_tokens: list[str] = field(default_factory=list)
    sitemap: bool = False
    sitemap_strip_extensions: bool = True
    index: bool = False
    toc: bool = False
    ast: bool = False
    chunks: bool = False
    chunk_profile: str = "default"
    manifest: bool = False
    graph: bool = False
    graph_external: bool = True
    graph_sections: bool = False
    damping: float = 0.85
    rounds: int = 20
    tags: bool = False
    content_keywords: bool = True
    bundles: bool = False
    bundle_sizes: list[int] = field(default_factory=lambda: [2000, 8000, 32000])
    validate: bool = False
    validate_ai: bool = False
    mcp: bool = False
    single_files: bool = False
    incremental: bool = False
    cache_dir: str | None = None
    origin: str | None = None
    repo_ref: str | None = None
    continue_on_error: bool = False
    watch: bool = False
    silent: bool = False
    patterns: dict = field(default_factory=dict)


def snake(name: str) -> str:
    return re.sub("([A-Z])", lambda m: "_" + m[1].lower(), name.replace("-", "_"))


def camel(name: str) -> str:
    """X18."""
    return re.sub("[-_](.)", lambda m: m[1].upper(), name)


def find(folder: str) -> Path | None:
    """The first of NAMES in a directory."""
    return next((p for n in NAMES if (p := Path(folder, n)).is_file()), None)


def scalar(text: str) -> object:
    """Null, booleans, numbers, quoted and plain strings."""
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_yaml(text: str) -> object:
    """YAML, with PyYAML where it is there; else comments, scalars, dash lists and inline lists."""
    try:
        import yaml
    except ImportError:
        return _flat_yaml(text)
    return yaml.safe_load(text)


def _flat_yaml(text: str) -> dict:
    out: dict = {}
    key = None
    for number, raw in enumerate(text.split("\n"), 1):
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        if (m := re.match(r"\s*-\s+(.*)$", line)) and key is not None:
            out[key] = [*(out[key] or []), scalar(m[1].strip())]
        elif m := re.match(r"(\w[\w.-]*):\s*(.*)$", line):
            key, value = m[1], m[2].strip()
            out[key] = [scalar(x.strip()) for x in value[1:-1].split(",") if x.strip()] if value[:1] == "[" and value[-1:] == "]" else scalar(value)
        else:
            raise ConfigurationError(f"line {number} of the configuration cannot be read: {raw.strip()}")
    return out


def load_file(path: str | Path) -> dict:
    """A JSON or YAML file as options by their own names."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        data = json.loads(text) if str(path).endswith(".json") else parse_yaml(text)
    except ValueError as error:
        raise ConfigurationError(f"configuration {path}: {error}") from error
    if not isinstance(data, Mapping):
        raise ConfigurationError(f"configuration {path} is no mapping")
    return {snake(k): v for k, v in data.items()}


def merge(*layers: Mapping) -> Options:
    """Options from layers, weakest first; None in a layer says nothing."""
    known = {f.name for f in fields(Options)}
    values: dict = {}
    for layer in layers:
        for key, value in layer.items():
            if key not in known:
                raise ConfigurationError(f"unknown option {key}")
            if value is None:
                continue
            if key in UNITED:
                value = list(dict.fromkeys([*values.get(key, []), *value]))
            values[key] = value
    return normalized(Options(**values))


def normalized(options: Options) -> Options:
    """Sizes numeric, positive and ascending; an unknown profile is the default one; the base URL ends in a slash."""
    from corpusmill.operators.chunks import PROFILES

    try:
        options.bundle_sizes = sorted({int(x) for x in options.bundle_sizes if int(x) > 0})
    except (TypeError, ValueError) as error:
        raise ConfigurationError(f"bundle sizes: {error}") from error
    if options.chunk_profile not in PROFILES:
        options.chunk_profile = "default"
    if options.base_url and not options.base_url.endswith("/"):
        options.base_url += "/"
    return options


def load(folder: str, given: Mapping, path: str | None = None) -> Options:
    found = Path(path) if path else find(folder)
    if path and not found.is_file():
        raise ConfigurationError(f"configuration {path} does not exist")
    return merge(load_file(found) if found else {}, given)


def sample(kind: str = "json") -> str:
    """K20."""
    data = asdict(Options(input="docs", output="build", base_url="https://docs.example.org/", chunks=True, graph=True, tags=True, manifest=True, bundles=True))
    data = {camel(k): v for k, v in data.items() if v is not None and k not in ("watch", "patterns")}
    if kind == "json":
        return json.dumps(data, indent=2) + "\n"
    line = lambda v: "[" + ", ".join(map(str, v)) + "]" if isinstance(v, list) else json.dumps(v)
    return "".join(f"{k}: {line(v)}\n" for k, v in data.items())
