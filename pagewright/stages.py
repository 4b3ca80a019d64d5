"""An audit as stages over named frames: each takes the frames so far and adds to them.

A stage is a function from ``Frames`` to a dict of frames. Issues of a stage are added to the bag of all issues; the ``strategy`` stage's
replace it, if there are any. A stage that fails while its plan is built is noted and left out, as is one that asks to be skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from .operators.audits import combined, merged_issues


class Skip(Exception):
    """Raised by a stage that has nothing to work on."""


@dataclass
class Frames:
    """What an audit has so far."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    issues: dict[str, DataFrame] = field(default_factory=dict)
    fixes: dict[str, DataFrame] = field(default_factory=dict)
    ranked: DataFrame | None = None
    log: list[tuple[str, str, str]] = field(default_factory=list)  # stage, status, message

    def all_issues(self) -> DataFrame | None:
        """The bag of all issues, or the ranked ones in its place."""
        every = combined(self.issues) if self.issues else None
        return every if self.ranked is None or every is None else merged_issues(every, self.ranked)


class Stage(Protocol):
    def __call__(self, frames: Frames) -> dict[str, DataFrame]: ...


ANALYZERS: dict[str, Callable[[Frames], DataFrame]] = {}
APPLIERS: dict[str, Callable[..., DataFrame]] = {}


def analyzer(name: str):
    """Register a function from frames to issues under a name."""

    def add(f: Callable[[Frames], DataFrame]):
        ANALYZERS[name] = f
        return f

    return add


def applier(name: str):
    """Register a function that applies fixes to files under a name."""

    def add(f: Callable[..., DataFrame]):
        APPLIERS[name] = f
        return f

    return add


def applier_of(name: str) -> Callable[..., DataFrame]:
    if name not in APPLIERS:
        raise ValueError(f"unknown applier {name!r}; there are {sorted(APPLIERS)}")
    return APPLIERS[name]


def analyze(frames: Frames, names: list[str] | None = None) -> Frames:
    """Run registered analyzers; one that fails is noted and does not end the audit."""
    for name in names or list(ANALYZERS):
        try:
            frames.issues[name] = ANALYZERS[name](frames)
            frames.log.append((name, "completed", ""))
        except Skip as e:
            frames.log.append((name, "skipped", str(e)))
        except Exception as e:  # plans are built here, so this is a missing column or table
            frames.log.append((name, "failed", f"{type(e).__name__}: {e}"[:500]))
    return frames


def run(stages: list[tuple[str, Stage]], frames: Frames) -> Frames:
    """Run stages in order. Their frames go by name: ``issues`` into the bag, ``fixes`` beside it, all else into ``tables``."""
    for name, stage in stages:
        try:
            made = stage(frames)
        except Skip as e:
            frames.log.append((name, "skipped", str(e)))
            continue
        except Exception as e:
            frames.log.append((name, "failed", f"{type(e).__name__}: {e}"[:500]))
            continue
        made = dict(made)
        issues, fixes = made.pop("issues", None), made.pop("fixes", None)
        if issues is not None and name == "strategy":
            frames.ranked = issues
        elif issues is not None:
            frames.issues[name] = issues
        if fixes is not None:
            frames.fixes[name] = fixes
        frames.tables |= made
        frames.log.append((name, "completed", ""))
    return frames
