"""Settings and policies; plain Python, outside any plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from datetime import datetime, timedelta
from enum import Enum


@dataclass(frozen=True)
class Settings:
    """Defaults of the curation pipeline."""

    data_saving: bool = True
    avoid_apps: tuple[str, ...] = ("Finder",)
    polling_interval_s: int = 5
    save_line_threshold: int = 10
    save_interval_s: int = 30
    min_text_length: int = 3
    max_text_length: int = 1000
    auto_learning: bool = True
    auto_learning_hour: int = 3
    auto_learning_minute: int = 0
    memory_limit_mb: int = 2048
    memory_limit_percent: int = 50
    ngram_size: int = 5
    train_every: int = 500
    max_train_rows: int = 100_000
    minhash_size: int = 20
    minhash_threshold: float = 0.7
    shingle: int = 3

    def toggled(self, app: str) -> Settings:
        """With the app excluded if it wasn't, and the other way round."""
        apps = tuple(a for a in self.avoid_apps if a != app)
        return replace(self, avoid_apps=apps if app in self.avoid_apps else (*self.avoid_apps, app))

    def excludes(self, app: str) -> bool:
        return app in self.avoid_apps

    def is_default(self) -> bool:
        return self == Settings()

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Known fields of a JSON object; what can't be read gives the defaults."""
        try:
            given = json.loads(text)
            known = {f.name for f in fields(cls)}
            got = {k: v for k, v in given.items() if k in known}
        except (ValueError, AttributeError):
            return cls()
        if "avoid_apps" in got:
            got["avoid_apps"] = tuple(got["avoid_apps"])
        return cls(**got)

    def to_json(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self)})


def encode_apps(apps: list[str]) -> str:
    return json.dumps(apps, ensure_ascii=False)


def decode_apps(text: str) -> list[str]:
    """The list in a JSON array of strings; anything else is no list."""
    try:
        got = json.loads(text)
    except (TypeError, ValueError):
        return []
    return got if isinstance(got, list) and all(isinstance(x, str) for x in got) else []


class Strategy(Enum):
    SKIP = "skip"
    LIGHTWEIGHT = "lightweight"
    SECTIONED = "sectioned"
    PROGRESSIVE = "progressive"


class Level(Enum):
    NORMAL = "normal"
    MINIMAL = "minimal"
    FULL = "full"
    DISABLED = "disabled"


def choose_strategy(rows: int, memory_mb: float, seconds_since: float | None = None) -> Strategy:
    """How a purge would run. Every strategy has the same plan here; the policy says when to run it."""
    age, low = float("inf") if seconds_since is None else seconds_since, memory_mb < 4096
    bands = [
        (500, 60, Strategy.LIGHTWEIGHT),
        (2000, 300 if low else 120, Strategy.LIGHTWEIGHT if low else Strategy.SECTIONED),
        (10_000, 600 if low else 300, Strategy.SECTIONED),
        (float("inf"), 1800, Strategy.PROGRESSIVE),
    ]
    wait, strategy = next((w, s) for most, w, s in bands if rows <= most)
    return Strategy.SKIP if age < wait else strategy


def choose_level(rows: int, memory_mb: float) -> Level:
    if rows <= 50:
        return Level.NORMAL
    if rows <= 200 or (rows <= 500 and memory_mb > 8192):
        return Level.MINIMAL
    return Level.DISABLED


def section_size(level: Level, memory_mb: float) -> int:
    """Rows that a section would have; partitions take its place."""
    return {Level.NORMAL: 500, Level.MINIMAL: 300}.get(level, 200 if memory_mb > 8192 else 100)


#: Saved rows from purge to purge.
PURGE_EVERY = {Level.MINIMAL: 5000, Level.NORMAL: 2000, Level.FULL: 1000}


def purge_due(counter: int, level: Level) -> bool:
    """Whether a purge is due after so many saved rows."""
    every = PURGE_EVERY.get(level)
    return every is not None and counter % every == 0


def rate_limited(seconds_since: float | None, least: float = 30) -> bool:
    return seconds_since is not None and seconds_since < least


def flush_due(buffered: int, seconds_since: float | None, writing: bool, settings: Settings = Settings()) -> bool:
    """Whether the buffer is to be written: enough lines, long enough ago, or never yet; not during a write."""
    return not writing and (buffered >= settings.save_line_threshold or seconds_since is None or seconds_since > settings.save_interval_s)


def next_daily_run(now: datetime, settings: Settings = Settings()) -> datetime:
    """The next time of the daily training run."""
    at = now.replace(hour=settings.auto_learning_hour, minute=settings.auto_learning_minute, second=0, microsecond=0)
    return at if at > now else at + timedelta(days=1)


def poll_interval(idle_s: float, settings: Settings = Settings()) -> int:
    """Seconds to the next poll; three times as long after a minute without input."""
    return settings.polling_interval_s * (3 if idle_s >= 60 else 1)


def low_memory(used_mb: float, total_mb: float, settings: Settings = Settings()) -> bool:
    return used_mb > settings.memory_limit_mb or used_mb > total_mb * settings.memory_limit_percent / 100
