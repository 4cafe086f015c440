"""Settings from the environment; a value that is not a plain integer in range is an error."""

from __future__ import annotations

import os
import re
import secrets
from collections.abc import Mapping
from dataclasses import dataclass, field

UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}


def parse_byte_size(value: str) -> int:
    m = re.fullmatch(r"(\d+)(b|kb|mb|gb)?", value.strip().lower())
    if not m:
        raise ValueError(f"invalid byte size: {value}")
    return int(m[1]) * UNITS[m[2] or "b"]


def integer(env: Mapping[str, str], name: str, default: int, low: int, high: int) -> int:
    text = env.get(name, "")
    if text == "":
        return default
    if not re.fullmatch(r"[0-9]+", text) or not low <= int(text) <= high:
        raise ValueError(f"{name} must be an integer between {low} and {high}")
    return int(text)


@dataclass(frozen=True)
class EngineConfig:
    warehouse: str = "spark-warehouse/logs"
    body_limit: int = 4 * 1024**2
    cursor_secret: bytes = field(default_factory=lambda: secrets.token_bytes(32))
    retention_days: int = 30
    max_log_age_days: int = 0
    max_files_per_trigger: int = 1000
    deadline_seconds: int = 0
    promoted_attributes: tuple[str, ...] = ()
    searchable: bool = False

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        env = os.environ if env is None else env
        secret = env.get("CURSOR_SECRET", "")
        return cls(
            warehouse=env.get("LOG_WAREHOUSE", "") or cls.warehouse,
            body_limit=parse_byte_size(env.get("BODY_LIMIT", "") or "4mb"),
            cursor_secret=secret.encode() if secret else secrets.token_bytes(32),
            retention_days=integer(env, "RETENTION_DAYS", 30, 1, 3650),
            max_log_age_days=integer(env, "MAX_LOG_AGE_DAYS", 0, 0, 3650),
            max_files_per_trigger=integer(env, "MAX_FILES_PER_TRIGGER", 1000, 1, 1_000_000),
            deadline_seconds=integer(env, "DEADLINE_SECONDS", 0, 0, 86_400),
            searchable=integer(env, "SEARCHABLE", 0, 0, 1) == 1,
            promoted_attributes=tuple(k for k in env.get("PROMOTED_ATTRIBUTES", "").split(",") if k),
        )
