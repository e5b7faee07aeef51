"""Configuration of a crawl: sections with defaults, strict keys, and all problems told at once."""

from __future__ import annotations

import dataclasses
import difflib
import json
import os
import re
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from webloom.functions.urls import http_url_problem
from webloom.operators.filters import UrlFilter, clean_extensions, clean_patterns
from webloom.operators.politeness import Breaker, RetryPolicy
from webloom.plans.crawl import CrawlPlan

# Files that aren't pages.
# Extensions of files that a crawl of pages leaves out by default.
EXCLUDED_EXTENSIONS = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico",
    "zip", "gz", "tar", "rar", "7z",
    "mp3", "mp4", "avi", "mov", "webm",
    "exe", "dmg", "iso",
    "css", "js",
)


class ConfigError(ValueError):
    def __init__(self, problems: list[str], name: str = "config"):
        super().__init__(f"{name}:\n" + "\n".join(f"  {p}" for p in problems))
        self.problems = problems


def at_least(low: float):
    return lambda v: None if v is None or v >= low else f"has to be {low:g} or more, got {v!r}"


def above(low: float):
    return lambda v: None if v is None or v > low else f"has to be above {low:g}, got {v!r}"


def share(v):
    return None if v is None or 0 < v <= 1 else f"has to be above 0 and at most 1, got {v!r}"


def _tried(check):
    def problem(v):
        try:
            check(v)
        except (ValueError, TypeError) as error:
            return str(error)
        return None

    return problem


def opt(default: Any, check=None):
    return field(default=default, metadata={"check": check})


@dataclass(frozen=True)
class Crawler:
    max_pages: int = opt(100, at_least(1))
    max_pages_per_host: int | None = opt(None, at_least(1))
    max_depth: int = opt(2, at_least(0))
    rate_limit: float | None = opt(1.0, above(0))
    per_domain_rate: bool = True
    min_delay: float = opt(0.0, at_least(0))
    respect_robots: bool = True
    user_agent: str = "webloom"
    max_page_size: int | None = opt(3 << 20, at_least(1))
    total_timeout: float = opt(30.0, above(0))
    timeout_growth: float = opt(1.5, at_least(1))
    max_retry_after: float = opt(600.0, above(0))


@dataclass(frozen=True)
class Sitemaps:
    urls: tuple[str, ...] = opt((), lambda v: next((p for u in v if (p := http_url_problem(u))), None))
    from_robots: bool = False
    max_urls: int = opt(50_000, at_least(1))


@dataclass(frozen=True)
class Retry:
    max_retries: int = opt(3, at_least(0))
    backoff_factor: float = opt(2.0, at_least(1))
    base_delay: float = opt(1.0, above(0))
    max_delay: float = opt(30.0, above(0))


@dataclass(frozen=True)
class CircuitBreaker:
    failure_threshold: float | None = opt(0.5, share)
    min_requests: int = opt(5, at_least(1))
    window: float = opt(60.0, above(0))
    cooldown: float = opt(30.0, at_least(0))


@dataclass(frozen=True)
class Filters:
    same_domain_only: bool = True
    include: tuple[str, ...] = opt((), _tried(clean_patterns))
    exclude: tuple[str, ...] = opt((), _tried(clean_patterns))
    exclude_extensions: tuple[str, ...] = opt(EXCLUDED_EXTENSIONS, _tried(clean_extensions))


@dataclass(frozen=True)
class Storage:
    outputs: tuple[str, ...] = ()
    batch_size: int = opt(100, at_least(1))
    overwrite: bool = False


@dataclass(frozen=True)
class Report:
    stats_json: str | None = None
    html: str | None = None
    top_domains: int = opt(10, at_least(1))


@dataclass(frozen=True)
class Config:
    urls: tuple[str, ...] = opt((), lambda v: next((p for u in v if (p := http_url_problem(u))), None))
    crawler: Crawler = Crawler()
    sitemaps: Sitemaps = Sitemaps()
    retry: Retry = Retry()
    circuit_breaker: CircuitBreaker = CircuitBreaker()
    filters: Filters = Filters()
    storage: Storage = Storage()
    report: Report = Report()

    def plan(self) -> CrawlPlan:
        f = self.filters
        scope = UrlFilter(None, f.include, f.exclude, f.exclude_extensions, 2048)
        c = self.crawler
        return CrawlPlan(c.max_pages, c.max_depth, c.max_pages_per_host, f.same_domain_only, scope, c.user_agent, c.respect_robots)

    def retry_policy(self) -> RetryPolicy:
        r = self.retry
        return RetryPolicy(r.max_retries, r.backoff_factor, r.base_delay, r.max_delay)

    def breaker(self) -> Breaker | None:
        b = self.circuit_breaker
        return None if b.failure_threshold is None else Breaker(b.failure_threshold, b.min_requests, b.window, b.cooldown)


def _expanded(value: str, path: str, problems: list[str]) -> str:
    """${NAME} from the environment; $${ is a literal ${."""

    def put(m: re.Match[str]) -> str:
        if m[0] == "$${":
            return "${"
        if m[1] not in os.environ:
            problems.append(f"{path}: the environment has no {m[1]}")
            return ""
        return os.environ[m[1]]

    return re.sub(r"\$\$\{|\$\{(\w+)\}", put, value)


def _value(value: Any, kind: Any, path: str, problems: list[str]) -> Any:
    if dataclasses.is_dataclass(kind):
        return _section(value, kind, path, problems)
    options = typing.get_args(kind) if isinstance(kind, types.UnionType) else (kind,)
    if value is None and type(None) in options:
        return None
    kind = next(k for k in options if k is not type(None))
    if isinstance(value, str):
        value = _expanded(value, path, problems)
    if typing.get_origin(kind) is tuple:
        if isinstance(value, list | tuple) and all(isinstance(x, str) for x in value):
            return tuple(_expanded(x, path, problems) for x in value)
        problems.append(f"{path}: a list of texts is wanted, got {value!r}")
        return ()
    right = isinstance(value, kind) and (kind is bool or not isinstance(value, bool)) or (kind is float and isinstance(value, int) and not isinstance(value, bool))
    if not right:
        problems.append(f"{path}: {kind.__name__} is wanted, got {value!r}")
    return kind(value) if right else value


def _section(given: Any, kind: type, path: str, problems: list[str]) -> Any:
    if given is None:
        given = {}
    if not isinstance(given, dict):
        problems.append(f"{path or 'the file'}: a mapping is wanted")
        return kind()
    hints = typing.get_type_hints(kind)
    fields = {f.name: f for f in dataclasses.fields(kind)}
    for key in given:
        if key not in fields:
            near = difflib.get_close_matches(str(key), fields, 1)
            problems.append(f"{path}{key}: unknown key" + (f", did you mean {near[0]}?" if near else ""))
    values = {}
    for name, f in fields.items():
        if name in given:
            before = len(problems)
            at = f"{path}{name}"
            values[name] = _value(given[name], hints[name], f"{at}." if dataclasses.is_dataclass(hints[name]) else at, problems)
            check = f.metadata.get("check")
            if check and len(problems) == before and (problem := check(values[name])):
                problems.append(f"{at}: {problem}")
    return kind(**values)


def build(given: dict[str, Any], name: str = "config") -> Config:
    problems: list[str] = []
    config = _section(given, Config, "", problems)
    if not problems and config.retry.base_delay > config.retry.max_delay:
        problems.append("retry: base_delay is longer than max_delay")
    if problems:
        raise ConfigError(problems, name)
    return config


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """over laid on base, key by key."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def differences(a: Any, b: Any, path: str = "") -> list[str]:
    """Dotted keys at which two configurations differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [d for k in dict.fromkeys([*a, *b]) for d in differences(a.get(k), b.get(k), f"{path}.{k}" if path else str(k))]
    return [] if a == b else [path]


def load(path: str | Path, overrides: dict[str, Any] | None = None) -> Config:
    """A .json, .yaml or .yml file; a key given twice is an error."""
    path = Path(path)
    try:
        content = path.read_text(encoding="utf-8")
        given = json.loads(content, object_pairs_hook=_unique) if path.suffix.lower() == ".json" else _yaml(content)
    except (OSError, ValueError) as error:
        raise ConfigError([str(error)], str(path)) from error
    return build(merged(given or {}, overrides or {}), str(path))


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise ValueError(f"the key {next(k for k in keys if keys.count(k) > 1)!r} is given twice")
    return dict(pairs)


def _yaml(content: str) -> Any:
    try:
        import yaml
    except ModuleNotFoundError as error:
        raise ValueError("YAML files need PyYAML; write the configuration as JSON") from error

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("tag:yaml.org,2002:map", lambda loader, node: _unique([(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value]))
    try:
        return yaml.load(content, Loader)
    except yaml.YAMLError as error:
        raise ValueError(str(error)) from error
