"""Fixed values that results depend on, plus the default sampling protocol.

Times are integers: milliseconds in configuration, nanoseconds inside jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

MS = 1_000_000
SECOND = 1_000_000_000
DAY = 86_400 * SECOND

# Message flag bits.
FLAG_LAST = 128
FLAG_BAD_CLOCK = 8
FLAG_MAYBE_BAD_BOOK = 4

# Book depth and level weights of the multi-level imbalance.
LEVELS = 5
LEVEL_WEIGHTS = (1.0, 0.5, 0.33, 0.25, 0.2)

BID_PX = [f"bid_px_{i:02d}" for i in range(LEVELS)]
ASK_PX = [f"ask_px_{i:02d}" for i in range(LEVELS)]
BID_SZ = [f"bid_sz_{i:02d}" for i in range(LEVELS)]
ASK_SZ = [f"ask_sz_{i:02d}" for i in range(LEVELS)]
BOOK_COLUMNS = BID_PX + ASK_PX + BID_SZ + ASK_SZ
CLOCKS = ["recv_ns", "event_ns"]
MESSAGE_COLUMNS = CLOCKS + ["flags", "sequence", "instrument_id", "symbol"] + BOOK_COLUMNS

# The eleven base features and the three library feature groups.
BASE_FEATURES = [
    "spread", "rel_spread", "obi_l1", "obi_multi", "micro_dev",
    "ret_lag_1", "ret_lag_5", "ret_lag_10", "ret_lag_30", "vol_10", "vol_30",
]
FEATURE_GROUPS = {
    "price": [
        "ret_lag_1", "ret_lag_5", "ret_lag_10", "ret_lag_30",
        "vol_10", "vol_30", "mid_ma_rel_10", "mid_var_rel_10",
    ],
    "displayed_volume": [
        "displayed_depth", "depth_diff_1", "depth_ma_10", "depth_var_10",
        "depth_speed_5", "obi_l1", "obi_multi",
    ],
    "price_volume": [
        "price_diff_1_x_depth", "price_diff_1_div_depth", "micro_dev", "rel_spread",
    ],
}
LIBRARY_FEATURES = [c for group in FEATURE_GROUPS.values() for c in group]


@dataclass(frozen=True)
class Contract:
    """Money rules of one futures contract."""

    tick_size: float = 0.25
    point_value: float = 50.0
    commission: float = 1.25
    slippage_ticks: float = 0.5
    quantity: int = 1
    initial_capital: float = 100_000.0


@dataclass(frozen=True)
class Protocol:
    """Clock settings of a study, all in milliseconds."""

    interval_ms: int = 500
    ages_ms: tuple = (500, 1000, 2000)
    horizons_ms: tuple = (5000, 15000, 45000, 135000, 405000, 1215000, 3645000)
    purge_ms: int = 3_645_000
    latency_ms: int = 500
    period_ms: int = 300_000
    threshold: float = 1.5e-5
    history_counts: tuple = (1, 2)
    ridge_alpha: float = 1.0
    tree_depth: int = 4
    tree_min_leaf: int = 50
    tree_sample: int = 50_000
    seed: int = 42
    exploration: float = 1.0
    threshold_multipliers: tuple = (1, 2, 4)

    @property
    def interval_ns(self) -> int:
        return self.interval_ms * MS

    @property
    def max_age_ns(self) -> int:
        return max(self.ages_ms) * MS
