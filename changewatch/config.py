"""Settings of a monitoring run: typed, checked, and read from YAML.

A settings tree is plain dataclasses; ``from_mapping`` builds it from parsed
YAML and reports every problem by the path of its key.
"""

from __future__ import annotations

import dataclasses
import typing
from dataclasses import dataclass, field
from pathlib import Path

#: Semantics version of stored baselines; a baseline of another version is recorded anew.
PIPELINE_VERSION = 2


class ConfigError(ValueError):
    """A settings file that is missing, unreadable, or holds a bad value."""


# fixed values: texts that mark an error or bot-check page instead of the document
FAILURE_SIGNATURES = [
    "This site can't be reached",
    "ERR_HTTP2_PROTOCOL_ERROR",
    "ERR_NO_SUPPORTED_PROXIES",
    "ERR_CONNECTION_",
    "ERR_TUNNEL_CONNECTION_FAILED",
    "ERR_NAME_NOT_RESOLVED",
    "might be temporarily down or it may have moved permanently",
    "Enable JavaScript and cookies to continue",
    "Checking if the site connection is secure",
    "Just a moment...",
    "Verifying you are human",
    "DDoS protection by Cloudflare",
    "Access denied",
    "Attention Required! | Cloudflare",
    "429 Too Many Requests",
]
# fixed values: terms whose appearance in a changed line is tagged
WATCHLIST = [
    "arbitration",
    "class action",
    "indemnify",
    "indemnification",
    "training data",
    "retention",
    "sub-processor",
    "subprocessor",
    "jurisdiction",
    "personal information",
    "government",
    "Australia",
    "liability",
    "warranty",
    "termination",
]
# fixed values: lines that some hosts insert and that say nothing of the document
NOISE_BY_HOST = {
    "www.perplexity.ai": [r"(?i)^.*we recently updated our (?:consumer )?privacy notice.*\n?"],
    "policies.google.com": [r"(?i)^effective\s+\w+\s+\d{1,2},\s+\d{4}\s*\|\s*archived versions.*\n?"],
}


def _above(low):
    return lambda v: v > low, f"must be above {low}"


def _at_least(low):
    return lambda v: v >= low, f"must be at least {low}"


def _setting(default, rule=None, factory=None):
    meta = {"rule": rule} if rule else {}
    return field(default_factory=factory, metadata=meta) if factory else field(default=default, metadata=meta)


_FILLED = (lambda v: bool(v.strip() if isinstance(v, str) else v), "must not be empty")


@dataclass(frozen=True)
class Fetch:
    timeout_seconds: int = _setting(30, _above(0))
    max_retries: int = _setting(2, _at_least(1))
    retry_delay_seconds: int = _setting(5, _at_least(0))
    page_load_timeout: int = _setting(25, _above(0))
    disable_conditional_get: bool = False
    user_agent: str = _setting("changewatch/1.0", _FILLED)


@dataclass(frozen=True)
class Validation:
    min_length: int = _setting(500, _at_least(0))
    shrink_ratio: float = _setting(0.6, (lambda v: 0 < v < 1, "must lie between 0 and 1"))
    growth_ratio: float = _setting(2.5, _above(1))
    failure_signatures: list[str] = _setting(None, _FILLED, lambda: list(FAILURE_SIGNATURES))


@dataclass(frozen=True)
class Normalisation:
    noise_patterns: list[str] = field(default_factory=list)
    per_source_noise: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in NOISE_BY_HOST.items()})


@dataclass(frozen=True)
class Diff:
    context_lines: int = _setting(3, _at_least(0))
    max_diff_chars: int = _setting(40000, _above(0))


@dataclass(frozen=True)
class Fingerprint:
    watchlist: list[str] = field(default_factory=lambda: list(WATCHLIST))


@dataclass(frozen=True)
class Health:
    consecutive_failure_threshold: int = _setting(3, _at_least(1))
    error_rate_threshold: float = _setting(0.3, (lambda v: 0 < v <= 1, "must lie above 0 and be at most 1"))
    schema_failure_threshold: int = _setting(2, _at_least(1))


@dataclass(frozen=True)
class Retention:
    log_days: int = _setting(365, _above(0))
    run_log_days: int = _setting(90, _above(0))


@dataclass(frozen=True)
class Config:
    model: str = _setting("stub", _FILLED)
    fetch: Fetch = field(default_factory=Fetch)
    validation: Validation = field(default_factory=Validation)
    normalisation: Normalisation = field(default_factory=Normalisation)
    diff: Diff = field(default_factory=Diff)
    fingerprint: Fingerprint = field(default_factory=Fingerprint)
    health: Health = field(default_factory=Health)
    retention: Retention = field(default_factory=Retention)

    def noise_for(self, host: str) -> list[str]:
        """Patterns for every host, then those of this one."""
        return [*self.normalisation.noise_patterns, *self.normalisation.per_source_noise.get(host, [])]


_SCALARS = {bool: "true or false", int: "a whole number", float: "a number", str: "a string"}


def _typed(value, kind, path: str):
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if dataclasses.is_dataclass(kind):
        return from_mapping(value, kind, path)
    if origin is list:
        if type(value) is not list:
            raise ConfigError(f"{path}: expected a list, not {value!r}")
        return [_typed(v, args[0], f"{path}[{i}]") for i, v in enumerate(value)]
    if origin is dict:
        if type(value) is not dict:
            raise ConfigError(f"{path}: expected a mapping, not {value!r}")
        return {_typed(k, args[0], f"{path} key"): _typed(v, args[1], f"{path}.{k}") for k, v in value.items()}
    # type() and not isinstance: true is no number
    if type(value) is kind:
        return value
    if kind is float and type(value) is int:
        return float(value)
    raise ConfigError(f"{path}: expected {_SCALARS[kind]}, not {value!r}")


def from_mapping(raw, kind=Config, path: str = ""):
    """A settings object from a parsed mapping; null stands for all defaults. Raises ConfigError."""
    raw = {} if raw is None else raw
    at = path or "settings"
    if type(raw) is not dict:
        raise ConfigError(f"{at}: expected a mapping, not {raw!r}")
    hints, own = typing.get_type_hints(kind), {f.name: f for f in dataclasses.fields(kind)}
    if strange := sorted(map(str, raw.keys() - own.keys())):
        raise ConfigError(f"{at}: unknown {', '.join(strange)}; known are {', '.join(sorted(own))}")
    values = {}
    for name, value in raw.items():
        key = f"{path}.{name}" if path else name
        values[name] = value = _typed(value, hints[name], key)
        test, says = own[name].metadata.get("rule", (None, ""))
        if test and not test(value):
            raise ConfigError(f"{key}: {says}, not {value!r}")
    return kind(**values)


def load(path: str | Path) -> Config:
    """Read a YAML settings file. Raises ConfigError."""
    import yaml

    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise ConfigError(f"{path}: no such file") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: not YAML: {e}") from e
    return from_mapping(raw)
