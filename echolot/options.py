"""Strictness levels, keep rules and scan options."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Level(str, Enum):
    """How alike two recordings must be."""

    PERFECT = "perfect"
    VERY_STRICT = "very-strict"
    STRICT = "strict"
    RELAXED = "relaxed"
    VERY_RELAXED = "very-relaxed"

    @classmethod
    def parse(cls, text: str) -> Level:
        return cls(text.strip().lower().replace("_", "-"))

    @property
    def label(self) -> str:
        return self.value.replace("-", " ").capitalize()


class KeepRule(str, Enum):
    """Which file of a group stays."""

    BEST_QUALITY = "best-quality"
    LARGEST = "largest"
    SMALLEST = "smallest"
    OLDEST = "oldest"
    NEWEST = "newest"
    SHALLOWEST = "shallowest"

    @classmethod
    def parse(cls, text: str) -> KeepRule:
        return cls(text.strip().lower().replace("_", "-"))

    @property
    def label(self) -> str:
        """The rule's name in reports."""
        # fixed output
        names = {"best-quality": "Best quality", "largest": "Largest file", "smallest": "Smallest file", "oldest": "Oldest file", "newest": "Newest file", "shallowest": "Shallowest folder"}
        return names[self.value]


@dataclass(frozen=True)
class MatchOptions:
    """Thresholds of the similar pass."""

    max_bit_error: float = 0.22
    max_shape_distance: float = 0.30
    whole_file: bool = False
    stationary_tolerance: float = 0.10
    min_frames: int = 64
    min_votes: int = 6
    max_entries_per_key: int = 400
    index_stride: int = 2
    min_overlap_seconds: float = 3.0
    whole_fraction: float = 0.95
    part_fraction: float = 0.25
    min_length_difference: float = 0.5
    stationary_flux: float = 0.10
    seconds_per_frame: float = 512 / 11025
    #: Index two values at a time: keys of 33 bits instead of 17, for collections whose short keys all have too many entries.
    joint_keys: bool = False

    @classmethod
    def for_level(cls, level: Level | str, **changes: object) -> MatchOptions:
        # fixed values: greatest bit error, greatest shape distance, whole file, tolerance of lengths
        presets = {
            Level.PERFECT: (0.12, 0.20, True, 0.05),
            Level.VERY_STRICT: (0.12, 0.20, False, 0.10),
            Level.STRICT: (0.18, 0.27, False, 0.10),
            Level.RELAXED: (0.24, 0.33, False, 0.10),
            Level.VERY_RELAXED: (0.30, 0.40, False, 0.10),
        }
        level = Level.parse(level) if isinstance(level, str) and not isinstance(level, Level) else level
        names = ("max_bit_error", "max_shape_distance", "whole_file", "stationary_tolerance")
        return cls(**(dict(zip(names, presets[level], strict=True)) | changes))  # type: ignore[arg-type]


@dataclass(frozen=True)
class ScanOptions:
    """What a scan reads and how it matches."""

    level: Level = Level.PERFECT
    include_subfolders: bool = True
    skip_hidden: bool = True
    find_exact: bool = True
    find_similar: bool = True
    minimum_duration: float = 2.0
    maximum_seconds: float = 120.0
    match: MatchOptions | None = None
    keep_rules: tuple[KeepRule, ...] = field(default_factory=lambda: tuple(KeepRule))

    @property
    def matching(self) -> MatchOptions:
        return self.match or MatchOptions.for_level(self.level)
