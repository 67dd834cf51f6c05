"""Typed options of the end-to-end plans.

Options are plain values; whatever a run derives (longest track, most features
in a frame, start and end time) is computed as a result and never written back.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from driftfield.operators.tiles import Wrap

# fixed values: configuration names of existing setups and the options they set
CONFIG_NAMES = {
    "field_thresh": "field_range",
    "min_size": "min_area",
    "min_npix": "min_npix",
    "othresh": "othresh",
    "timegap": "timegap_h",
    "duration_range": "duration_range",
    "remove_shorttracks": "drop_short",
    "datatimeresolution": "dt_h",
    "pixel_radius": "pixel_km",
    "pbc_direction": "periodic",
    "pbc_max_domain_fraction": "wrap_fraction",
    "cloudtb_core": "tb_core",
    "cloudtb_cold": "tb_cold",
    "cloudtb_warm": "tb_warm",
    "cloudtb_cloud": "tb_cloud",
    "area_thresh": "cloud_area",
    "mincoldcorepix": "min_core_npix",
    "smoothwindowdimensions": "smooth_size",
    "warmanvilexpansion": "warm_expansion",
    "mcs_tb_area_thresh": "system_area",
    "mcs_tb_duration_thresh": "system_hours",
    "mcs_tb_split_duration": "split_hours",
    "mcs_tb_merge_duration": "merge_hours",
    "mcs_tb_gap": "system_gap",
    "mcs_pf_majoraxis_thresh": "axis_min",
    "max_pf_majoraxis_thresh": "axis_max",
    "mcs_pf_durationthresh": "rain_hours",
    "mcs_pf_gap": "rain_gap",
    "pf_rr_thres": "rain_min",
    "nmaxpf": "keep_features",
    "heavy_rainrate_thresh": "rain_heavy",
    "pf_link_area_thresh": "rain_area",
    "coefs_pf_area": "coef_area",
    "coefs_pf_rr": "coef_rate",
    "coefs_pf_skew": "coef_skew",
    "coefs_pf_heavyratio": "coef_heavy",
    "maintrack_area_thresh": "main_area",
    "maintrack_lifetime_thresh": "main_hours",
    "max_speed_thresh": "max_speed",
    "min_size_thresh_for_speed": "motion_npix",
}


class _FromConfig:
    @classmethod
    def from_config(cls, config: Mapping):
        """Options from a mapping with either option or configuration names; names that neither has are reported."""
        known = {f.name for f in fields(cls)}
        values = {}
        for name, value in config.items():
            option = name if name in known else CONFIG_NAMES.get(name)
            if option in known:
                values[option] = tuple(value) if isinstance(value, list) else value
            elif option is None:
                warnings.warn(f"{cls.__name__} has no option {name!r}", stacklevel=2)
        return cls(**values)

    @classmethod
    def from_file(cls, path: str):
        text = Path(path).read_text()
        if path.endswith(".json"):
            return cls.from_config(json.loads(text))
        try:
            import yaml
        except ImportError as missing:
            raise ImportError("reading YAML options needs the yaml package; JSON works without") from missing
        return cls.from_config(yaml.safe_load(text))


@dataclass(frozen=True)
class TrackingOptions(_FromConfig):
    shape: tuple[int, int] | None = None
    othresh: float = 0.5
    timegap_h: float = 3.1
    dt_h: float = 1.0
    duration_range: tuple[int, int] = (2, 20)
    drop_short: bool = True
    periodic: str = "none"
    wrap_fraction: float = 0.5
    pixel_km: float = 10.0
    tile: int = 256

    @property
    def periodic_x(self) -> bool:
        return self.periodic in ("x", "both")

    @property
    def periodic_y(self) -> bool:
        return self.periodic in ("y", "both")

    @property
    def wrap(self) -> Wrap | None:
        """The periodic edges, as the operators take them."""
        if not (self.periodic_y or self.periodic_x):
            return None
        if self.shape is None:
            raise ValueError("periodic edges need the grid's shape")
        return Wrap(self.shape, self.periodic_y, self.periodic_x)


@dataclass(frozen=True)
class GenericOptions(TrackingOptions):
    field_range: tuple[float, float] = (1.6, 1000.0)
    min_area: float | None = None
    min_npix: float | None = None
    main_area: float = 0.0
    main_hours: float = 0.0
    merge_hours: float = 12.0
    split_hours: float = 12.0


@dataclass(frozen=True)
class ConvectiveOptions(TrackingOptions):
    tb_core: float = 225.0
    tb_cold: float = 241.0
    tb_warm: float = 261.0
    tb_cloud: float = 261.0
    cloud_area: float = 800.0
    min_core_npix: int = 4
    smooth_size: int = 10
    warm_expansion: bool = False
    system_area: float = 40000.0
    system_hours: float = 4.0
    merge_hours: float = 12.0
    split_hours: float = 12.0
    system_gap: int = 1
    rain_min: float = 2.0
    rain_heavy: float = 10.0
    rain_area: float = 648.0
    keep_features: int | None = None
    link_rain: bool = False
    link_rain_min: float = 3.0
    link_rain_npix: int = 1
    axis_min: float = 100.0
    axis_max: float = 1800.0
    rain_hours: float = 4.0
    rain_gap: int = 1
    coef_area: tuple[float, float] = (2874.05, 89.825)
    coef_rate: tuple[float, float] = (3.01657, 0.0144461)
    coef_skew: tuple[float, float] = (0.194462, 0.0100072)
    coef_heavy: tuple[float, float] = (3.419024, 0.438709)
    land: tuple[float, float] = (90.0, 100.0)
    pcp_thresh: float = 1.0
    motion_npix: int = 10
    max_speed: float = 50.0


@dataclass(frozen=True)
class CellOptions(TrackingOptions):
    dx_m: float = 500.0
    dy_m: float = 500.0
    bkg_radius_m: float = 11000.0
    min_diff: float = 10.0
    abs_thresh: float = 60.0
    core_dbz: float = 60.0
    weak_dbz: float = 10.0
    min_core_km2: float = 4.0
    expand_km: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0, 5.0)
    steps: dict = field(default_factory=dict)
    echo_tops: tuple[int, ...] = (10, 20, 30, 40, 50)
    echotop_gap: int = 2
    sensitivity_dbz: float = 0.0
    advection: bool = False
    advect_dbz: float = 20.0
    advect_max_speed: float = 60.0
    advect_steps: int = 3
