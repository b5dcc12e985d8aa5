"""Tunable thresholds of the marts and models, in one immutable record."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Thresholds and prices that results depend on.
    zone: str = "America/Mexico_City"
    complete_ms: int = 30_000
    session_gap_ms: int = 1_800_000
    min_artist_plays: int = 5
    min_week_plays: int = 5
    min_weeks: int = 10
    min_model_rows: int = 200
    min_bucket_plays: int = 10
    top_tracks: int = 50
    top_artists: int = 30
    top_shows: int = 20
    top_audiobooks: int = 10
    top_country_rank: int = 10
    top_positions: int = 30
    monthly_price: float = 99.0
    annual_price: float = 990.0
    annual_from_months: int = 10
    test_share: float = 0.2
    folds: int = 5
    seed: int = 42
    forest_trees: int = 200
    forest_depth: int = 6
    boost_rounds: int = 300
    boost_depth: int = 4
    boost_rate: float = 0.05
    boost_subsample: float = 0.8
    max_clusters: int = 6
    search_starts: int = 15
    final_starts: int = 20
    # Ours: plays in one block of the session scan, about.
    session_block_rows: int = 2_000_000
    # Ours: independent model fits that run at the same time.
    parallel_fits: int = 4
    # Ours: columns that separate one listener from another; () means one listener.
    listener_keys: tuple[str, ...] = ()
