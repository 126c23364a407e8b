"""Run settings: validated, hashed, and given as one row."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

CHOICES = {
    "encoding": ("spectral", "coordinate"),
    "residual": ("strong", "fem", "hybrid"),
    "sampling": ("random", "full"),
    "weighting": ("fixed", "balanced"),
    "well_model": ("closed_form", "predicted", "none"),
}


class SettingsError(ValueError):
    """Settings that can't be run."""


@dataclass(frozen=True)
class Settings:
    encoding: str = "spectral"
    residual: str = "fem"
    sampling: str = "full"
    weighting: str = "fixed"
    well_model: str = "closed_form"
    modes: int = 5
    width: int = 16
    blocks: int = 2
    iterations: int = 100
    log_every: int = 1
    snapshot_every: int = 2
    seed: int = 30
    weights: dict[str, float] = field(default_factory=lambda: {"pde": 1.0, "ic": 1.0, "data": 1.0, "well": 1.0})

    def problems(self) -> tuple[list[str], list[str]]:
        """(errors, warnings)."""
        errors = [f"{k} is {getattr(self, k)!r}, not one of {', '.join(v)}" for k, v in CHOICES.items() if getattr(self, k) not in v]
        errors += [f"{k} is under 1" for k in ("modes", "width", "blocks", "iterations", "log_every", "snapshot_every") if getattr(self, k) < 1]
        errors += [f"the weight of {k} is negative" for k, v in self.weights.items() if v < 0]
        if self.residual == "fem" and self.encoding != "spectral":
            errors.append("the fem residual needs the spectral encoding")
        warnings = ["log_every hides snapshots that aren't its multiples"] if self.snapshot_every % self.log_every else []
        if self.sampling == "full" and self.residual == "strong":
            warnings.append("a full batch of strong residuals is large")
        return errors, warnings

    def checked(self) -> Settings:
        errors, _ = self.problems()
        if errors:
            raise SettingsError("; ".join(errors))
        return self

    def digest(self) -> str:
        """SHA-1 of the canonical JSON."""
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def row(self, spark: SparkSession) -> DataFrame:
        flat = {k: v for k, v in asdict(self).items() if not isinstance(v, dict)} | {f"weight_{k}": v for k, v in self.weights.items()}
        return spark.createDataFrame([tuple(flat.values())], list(flat))

    @property
    def parameters(self) -> int:
        """Number of parameters of the network with 4 inputs more than modes and 4 outputs."""
        d, w = self.modes + 1, self.width
        return d * w + w + self.blocks * 4 * (d * w + w * w + w) + w * 4 + 4


PRESETS = {"small": Settings(), "large": Settings(modes=128, iterations=20_000)}
