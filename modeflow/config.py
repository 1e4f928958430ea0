"""City configuration: a strict description of one deployment, from a mapping or a JSON or YAML file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class City:
    """Sections of a configuration; unknown ones are refused, so that a misspelled section cannot go unnoticed."""

    name: str
    classes: tuple[str, ...] = ("Still", "Walk", "Bus", "Car", "Train")
    label_map: dict[str, str] = field(default_factory=dict)
    session: dict[str, float] = field(default_factory=lambda: {"gap_s": 300.0, "min_duration_s": 60.0})
    window: dict[str, float] = field(default_factory=lambda: {"win_s": 120.0, "step_s": 60.0})
    quality: dict[str, float] = field(default_factory=lambda: {"max_accuracy_m": 50.0, "max_acc_g": 4.0})
    window_labeler: dict[str, float] = field(default_factory=dict)
    post_processing: dict = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    exclude_users: tuple[str, ...] = ()
    specialists: tuple[str, ...] = ()

    @classmethod
    def of(cls, sections: dict) -> City:
        unknown = set(sections) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in sections.items()})

    @classmethod
    def read(cls, path: str) -> City:
        text = Path(path).read_text()
        if path.endswith(".json"):
            return cls.of(json.loads(text))
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("YAML needs the yaml package; JSON does not") from missing
        return cls.of(yaml.safe_load(text))

    def smooth_windows(self) -> int:
        """Windows of the smoothing context."""
        return max(1, round(float(self.post_processing.get("smooth_min", 10.0)) * 60 / self.window["win_s"]))

    def min_windows(self) -> dict[str, int]:
        from .operators.smoothing import min_windows

        return min_windows(self.post_processing.get("min_segment_min"), self.window["win_s"])
