"""Thresholds and weights shared by the stages.

Everything time-dependent (``run_ts``) is an argument of the stage itself, so
a run is a pure function of its inputs.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Anchor:
    lat: float
    lng: float
    label: str = "Anchor"


@dataclass(frozen=True)
class Settings:
    # The results depend on these exact numbers.
    hamming_max: int = 10
    area_tolerance: float = 0.1
    near_metres: float = 50.0
    far_metres: float = 2000.0
    stolen_min_shared: int = 3
    min_samples: int = 8
    overpriced_pct: float = 80.0
    deal_pct: float = 25.0
    weight_stolen: int = 40
    weight_red_phrase: int = 25
    weight_private_no_ico: int = 10
    weight_brand_new: int = 8
    suspicious_score: int = 30
    brand_new_days: int = 3
    min_drop_pct: float = 3.0
    #: Photos of a listing that are kept and hashed; None for all of them.
    max_images_per_listing: int | None = None
    per_page: int = 100
    feed_window_hours: int = 48
    feed_limit: int = 500
    near_train_km: float = 1.5
    bbox_lat: tuple[float, float] = (49.4, 50.6)
    bbox_lng: tuple[float, float] = (13.4, 15.5)
    centre: tuple[float, float] = (50.0875, 14.4213)
    capital_population: int = 1_357_000
    anchor: Anchor | None = None

    # Physical choices: they change the plan, never the result.
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 << 20
    hot_key_rows: int = 20_000
    #: Buckets of the stored listings; a table keeps the number it was begun with.
    buckets: int = 64


DEFAULTS = Settings()
