"""Constants of the data model. Results depend on each of them."""

from __future__ import annotations

from dataclasses import dataclass

DISTANCE_MARK = "_distance_to_"
DISTANCE_PLATFORM = "bermuda"
UNKNOWN = "unknown"
NO_READING = ("", "unknown", "unavailable")
OFFLINE_STATES = ("", "unavailable", "unknown", "none", "off", "false", "not_home", "offline", "disconnected", "no")

#: Metres in a unit of length.
UNIT_METRES = {"m": 1.0, "ft": 0.3048, "cm": 0.01, "mm": 0.001, "km": 1000.0, "in": 0.0254, "yd": 0.9144, "mi": 1609.344}


@dataclass(frozen=True)
class Settings:
    tick_s: float = 1.0
    stale_s: float = 300.0
    offline_s: float = 30.0
    dump_every_s: float = 15.0
    least_sensors: int = 3
    # Kalman filter
    kf_meas_m: float = 1.5
    kf_accel: float = 0.5
    kf_init_vel: float = 1.0
    kf_max_dt: float = 10.0
    kf_min_dt: float = 1e-3
    kf_max_gap: float = 30.0
    # ranges and weights
    jump_tolerance: float = 0.5
    tracker_height_m: float = 1.0
    tracker_height_max: float = 5.0
    receiver_height_max: float = 10.0
    min_weight_radius_m: float = 0.5
    bounds_margin: float = 0.1
    # floor election
    candidates: int = 3
    smoothing: float = 0.7
    margin: float = 0.05
    switch_cycles: int = 3
    dark_grace: int = 3
    residual_scale_m: float = 2.0
    coverage_n: float = 5.0
    no_go_penalty: float = 0.15
    least_probability: float = 0.01
    # zones
    zone_buffer: float = 0.05
    snap_margin_px: float = 3.0
    # calibration
    sample_fresh_s: float = 30.0
    window: int = 720
    persisted: int = 200
    state_max_age_s: float = 21600.0
    manual_failures: int = 6
    solve_after_s: float = 300.0
    solve_every_s: float = 900.0
    selftest_every_s: float = 1800.0
    least_samples: int = 5
    least_true_m: float = 0.3
    least_pairs: int = 4
    factor_min: float = 0.2
    factor_max: float = 5.0
    write_epsilon: float = 0.01
    gauge_weight: float = 10.0
    diff_weight: float = 2.0
    positive_scale: float = 0.12
    negative_slope: float = 3.0
    negative_scale: float = 0.4
    selftest_samples: int = 3
    # zone clean-up
    tolerance_px: float = 22.0
    angle_deg: float = 8.0
    boxy_aligned: float = 0.85
    boxy_fill: float = 0.90
    min_edge_px: float = 3.0
    # traces and links
    trace_points: int = 5000
    trace_step_px: float = 1.0
    stale_least_m: float = 0.1
    stale_share: float = 0.02


DEFAULTS = Settings()
