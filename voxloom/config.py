"""Engine settings: one frozen value that is passed to operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    # The default settings.
    frame_sec: float = 0.02
    sample_rate: int = 16000
    trim_silence: bool = True
    trim_min_silence_sec: float = 0.8
    trim_pad_sec: float = 0.25
    trim_pad_floor_sec: float = 0.05
    trim_sensitivity: float = 0.30
    trim_min_speech_sec: float = 0.10
    trim_min_dynamic_db: float = 12.0
    trim_highpass_hz: float = 80.0
    lang_windows: int = 5
    lang_silence_rms: float = 0.005
    chunk_sec: float = 3600.0
    stitch_threshold: float = 0.65
    merge_threshold: float = 0.65
    merge_min_overlap_sec: float = 0.5
    drop_hallucination: bool = True
    hallucination_min_score: float = 0.30
    drop_suspect: bool = False
    match_threshold: float = 0.60
    match_margin: float = 0.05
    min_speech_sec: float = 5.0
    max_voiceprints: int = 10
    clip_max_sec: float = 300.0

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> EngineConfig:
        """Settings from upper-case names; values that cannot be read leave the default."""
        found = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None:
                continue
            if isinstance(f.default, bool):
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            else:
                try:
                    found[f.name] = type(f.default)(raw)
                except ValueError:
                    pass
        return cls(**found)
