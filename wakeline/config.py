"""Parameters with their defaults, as frozen dataclasses, and a short hash that stamps outputs."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from datetime import date

# Vessel groups in their order, the commercial ones, MMSI of ship stations; the defaults of the classes below.
GROUPS = ("cargo", "tanker", "passenger", "tug_tow", "fishing", "pleasure", "other", "unknown")
COMMERCIAL = ("cargo", "tanker", "passenger", "tug_tow", "fishing")
MMSI_RANGE = (201_000_000, 775_999_999)
EVENT_TYPES = ("gap", "jump", "loiter", "deviation", "rendezvous")


@dataclass(frozen=True)
class Region:
    lat_min: float = 41.40
    lat_max: float = 43.10
    lon_min: float = -83.60
    lon_max: float = -82.30

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self.lat_min, self.lat_max, self.lon_min, self.lon_max

    @property
    def origin(self) -> tuple[float, float]:
        return (self.lat_min + self.lat_max) / 2, (self.lon_min + self.lon_max) / 2


@dataclass(frozen=True)
class Clean:
    max_sog_kn: float = 102.2
    max_implied_kn: float = 60.0


@dataclass(frozen=True)
class Segment:
    max_gap_min: float = 30.0
    min_points: int = 10
    min_duration_min: float = 30.0


@dataclass(frozen=True)
class Context:
    reception_cell_m: float = 2000.0
    port_cell_m: float = 500.0
    traffic_cell_m: float = 500.0
    max_step_s: float = 1800.0  # between fixes that count for reception
    moving_kn: float = 2.0
    report_s: float = 60.0
    still_kn: float = 1.0
    max_still_h: float = 1.0
    port_min_hours: float = 12.0
    port_min_vessels: int = 3
    home_min_hours: float = 6.0
    course_min_fixes: int = 20
    bins: int = 12


@dataclass(frozen=True)
class Gap:
    min_gap_min: float = 30.0
    min_sog_kn: float = 1.0
    edge_buffer_km: float = 3.0
    min_reception: float = 0.8
    max_gap_h: float = 24.0


@dataclass(frozen=True)
class Jump:
    min_jump_m: float = 1000.0
    abs_kn: float = 40.0
    sog_factor: float = 2.0
    sog_margin_kn: float = 10.0
    merge_s: float = 600.0


@dataclass(frozen=True)
class Loiter:
    max_sog_kn: float = 2.0
    min_hours: float = 2.0
    max_port_frac: float = 0.2
    max_gap_min: float = 30.0


@dataclass(frozen=True)
class Deviation:
    min_sog_kn: float = 3.0
    max_cell_voyages: int = 2
    min_course_prob: float = 0.02
    min_cell_voyages_for_course: int = 10
    min_minutes: float = 10.0
    max_gap_min: float = 5.0
    bridge_min: float = 0.0
    skip_groups: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rendezvous:
    max_dist_m: float = 500.0
    max_sog_kn: float = 2.0
    min_hours: float = 1.0
    bin_min: float = 5.0


@dataclass(frozen=True)
class Prediction:
    horizons_min: tuple[int, ...] = (15, 30, 60, 120)
    history_min: float = 60.0
    anchor_every_min: float = 10.0
    min_sog_kn: float = 2.0
    bracket_s: float = 180.0
    n_boot: int = 1000
    pos_scale_m: float = 1200.0
    course_scale_deg: float = 30.0
    k: int = 80


@dataclass(frozen=True)
class Config:
    region: Region = field(default_factory=Region)
    clean: Clean = field(default_factory=Clean)
    segment: Segment = field(default_factory=Segment)
    context: Context = field(default_factory=Context)
    gap: Gap = field(default_factory=Gap)
    jump: Jump = field(default_factory=Jump)
    loiter: Loiter = field(default_factory=Loiter)
    deviation: Deviation = field(default_factory=Deviation)
    rendezvous: Rendezvous = field(default_factory=Rendezvous)
    prediction: Prediction = field(default_factory=Prediction)
    #: Inclusive UTC dates; days between splits are buffers. A voyage must lie inside a split as a whole.
    splits: tuple[tuple[str, str, str], ...] = (("train", "2023-05-01", "2023-08-31"), ("val", "2023-09-02", "2023-09-30"), ("test", "2023-10-02", "2023-10-31"))

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()[:12]

    @classmethod
    def load(cls, values: dict, base: Config | None = None) -> Config:
        """A nested dict over `base` (deep merge); unknown names are errors."""

        def merge(obj, new):
            for k in new:
                if k not in {f.name for f in dataclasses.fields(obj)}:
                    raise ValueError(f"unknown setting {k}")
            return dataclasses.replace(obj, **{k: merge(getattr(obj, k), v) if dataclasses.is_dataclass(getattr(obj, k)) else tuple(map(tuple, v)) if k == "splits" else v for k, v in new.items()})

        out = merge(base or cls(), values)
        for name, lo, hi in out.splits:
            if date.fromisoformat(str(lo)) > date.fromisoformat(str(hi)):
                raise ValueError(f"split {name} ends before it begins")
        return out
