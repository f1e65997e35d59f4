"""The effective configuration: defaults, allowed keys, ranges."""

from __future__ import annotations

import dataclasses
import json
import math
import re

from lumaframe.errors import InvalidArgument

PROFILES = ("proxy", "lt", "standard", "hq", "4444", "4444xq")


@dataclasses.dataclass(frozen=True)
class Config:
    # The keys and their defaults. What concerns threads, devices and encoders is kept and checked, not used.
    schema_version: int = 1
    demosaic: str = "rcd"
    exposure_offset_stops: float = 0.0
    negative_policy: str = "preserve_by_curve"
    chroma_filter: str = "quality"
    capture_sharpening: float = 0.4
    capture_sharpening_threshold: float = 0.002
    deterministic_dither: bool = True
    preserve_source_timestamps: bool = True
    preserve_audio: bool = True
    max_frames: int = 0
    cpu_threads: int = 0
    max_parallel_frames: int = 0
    target_profile: str = "DaVinciIntermediate_DWG"
    prores_profile: str = "hq"
    backend: str = "cpu"
    gpu_selector: str = "auto"
    async_depth: int = 8
    fallback: str = "prores_ks"
    gpu_performance_mode: str = "precise"

    def validate(self) -> Config:
        checks = {
            "schema_version": self.schema_version == 1,
            "demosaic": self.demosaic in ("rcd", "amaze", "igv", "dcb", "lmmse"),
            "exposure_offset_stops": math.isfinite(self.exposure_offset_stops),
            "negative_policy": self.negative_policy in ("preserve_by_curve", "clamp_to_zero", "error"),
            "chroma_filter": self.chroma_filter in ("fast", "quality"),
            "capture_sharpening": 0 <= self.capture_sharpening <= 2,
            "capture_sharpening_threshold": 0 <= self.capture_sharpening_threshold <= 0.1,
            "preserve_source_timestamps": self.preserve_source_timestamps is True,
            "max_frames": self.max_frames >= 0,
            "cpu_threads": 0 <= self.cpu_threads <= 256,
            "max_parallel_frames": 0 <= self.max_parallel_frames <= 64,
            "target_profile": self.target_profile == "DaVinciIntermediate_DWG",
            "prores_profile": self.prores_profile in PROFILES,
            "backend": self.backend in ("cpu", "vulkan", "auto"),
            "gpu_selector": bool(self.gpu_selector),
            "async_depth": 1 <= self.async_depth <= 64,
            "fallback": self.fallback in ("none", "prores_ks"),
            "gpu_performance_mode": self.gpu_performance_mode in ("precise", "fast"),
        }
        if wrong := [k for k, ok in checks.items() if not ok]:
            raise InvalidArgument(f"out of range: {', '.join(wrong)}")
        return self


def load(text: str, **overrides) -> Config:
    """From JSON, in which // and /* */ comments are allowed; unknown keys raise."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    found = json.loads(bare or "{}") | {k: v for k, v in overrides.items() if v is not None}
    if unknown := sorted(set(found) - {f.name for f in dataclasses.fields(Config)}):
        raise InvalidArgument(f"unknown keys: {', '.join(unknown)}")
    return Config(**found).validate()
