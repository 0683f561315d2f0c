"""Parameters of an analysis.

Everything a run needs is passed as plain function arguments grouped in
small frozen dataclasses; there is no config-file loader.  ``validate``
(see :mod:`vigil.operators.checks`) performs the cross-parameter checks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the published defaults of the analysis
# being reproduced (measure names, feature-family names and their output
# column templates, named feature sets, window sizes, constants, K values,
# scenario shapes).  They are stated here plainly and in their natural order.
# ---------------------------------------------------------------------------

RAW_COLUMNS = ("bytes", "logins", "hosts", "fails")

FAMILY_ORDER = ("self_z", "robust_z", "peer_z", "rolling", "diff", "ramp", "spearman")

# Columns of each family that enter a feature matrix ({c} = measure name).
FAMILY_MATRIX_COLUMNS = {
    "self_z": ("{c}_z_self",),
    "robust_z": ("{c}_rz_self",),
    "peer_z": ("{c}_z_peer_loo",),
    "rolling": ("{c}_roll7_max", "{c}_roll7_mean", "{c}_roll7_std"),
    "diff": ("{c}_diff1", "{c}_pct1"),
    "ramp": ("{c}_ramp_slope", "{c}_ramp_r2", "{c}_ramp_signal"),
    "spearman": ("{c}_spearman", "{c}_spearman_pos"),
}

# Families whose matrix columns are taken for the bytes measure only.
BYTES_ONLY_FAMILIES = ("ramp", "spearman")

# Named feature sets, in declared order.
FEATURE_SETS = {
    "baseline": (),
    "z_scores": ("self_z", "robust_z", "peer_z"),
    "z_plus_diff": ("self_z", "robust_z", "peer_z", "diff"),
    "z_plus_ramp": ("self_z", "robust_z", "peer_z", "ramp"),
    "z_plus_spearman": ("self_z", "robust_z", "peer_z", "spearman"),
    "z_plus_ramp_plus_spearman": ("self_z", "robust_z", "peer_z", "ramp", "spearman"),
    "everything": ("self_z", "robust_z", "peer_z", "rolling", "diff", "ramp", "spearman"),
}

EPSILON = 1e-6
MAD_CONSTANT = 1.4826
ROLLING_WINDOW = 7
RAMP_WINDOW = 7
SPEARMAN_WINDOW = 7
SPEARMAN_MIN_ROWS = 3
SPEARMAN_MIN_STD = 1e-9

N_TREES = 200
MAX_SAMPLES = 256
SEEDS = (0, 1, 2, 3, 4)

TOP_K_VALUES = (5, 10, 15, 20, 30, 50, 75, 100)
PRIMARY_TOP_K = 50
ATTACK_TYPES = ("exfil", "cred_theft", "lateral", "subtle_exfil", "slow_ramp")
AGGREGATIONS = ("sum", "max", "mean")
DEFAULT_AGGREGATION = "sum"
SUMMARY_DECIMALS = 3

# Default incident scenarios (name, target group, victims, shape), in the
# order they are applied.  Target groups are the reference's peer-group names.
DEFAULT_SCENARIOS = (
    dict(name="exfil", target_group="engineer", n_victims=10, duration_days=3,
         start_day_offset=0, bytes_multiplier=15.0),
    dict(name="cred_theft", target_group="finance", n_victims=10, duration_days=2,
         start_day_offset=0, logins_add=10, fails_add=5),
    dict(name="lateral", target_group="sales", n_victims=10, duration_days=3,
         start_day_offset=0, hosts_add=80),
    dict(name="subtle_exfil", target_group="finance", n_victims=10,
         days_offset=[4, 5], bytes_multiplier=5.0),
    dict(name="slow_ramp", target_group="exec", n_victims=10, start_day_offset=2,
         duration_days=5, ramp_start_multiplier=1.5, ramp_step=0.5),
)
DEFAULT_SCENARIO_SEED = 42

# ---------------------------------------------------------------------------
# Stand-in settings for the event tables shipped with this repository's test
# data: users are customers, peer groups are market segments, days count
# from the first day of the event log.  Not reference values.
# ---------------------------------------------------------------------------

EVENTS_DAY_ZERO = "2024-01-01"
EVENTS_TEST_WINDOW_START = 23

# Scenario shapes as above, aimed at market segments; each attack takes a
# share of its segment's users instead of an absolute count so that the same
# parameters serve every scale factor.
EVENTS_SCENARIOS = (
    dict(name="exfil", target_group="BUILDING", victim_share=0.05, duration_days=3,
         start_day_offset=0, bytes_multiplier=15.0),
    dict(name="cred_theft", target_group="HOUSEHOLD", victim_share=0.05, duration_days=2,
         start_day_offset=0, logins_add=10, fails_add=5),
    dict(name="lateral", target_group="MACHINERY", victim_share=0.05, duration_days=3,
         start_day_offset=0, hosts_add=80),
    dict(name="subtle_exfil", target_group="HOUSEHOLD", victim_share=0.05,
         days_offset=[4, 5], bytes_multiplier=5.0),
    dict(name="slow_ramp", target_group="FURNITURE", victim_share=0.05, start_day_offset=2,
         duration_days=5, ramp_start_multiplier=1.5, ramp_step=0.5),
)


@dataclass(frozen=True)
class FeatureParams:
    raw_columns: tuple = RAW_COLUMNS
    families: tuple = FAMILY_ORDER
    rolling_window: int = ROLLING_WINDOW
    ramp_window: int = RAMP_WINDOW
    spearman_window: int = SPEARMAN_WINDOW
    mad_constant: float = MAD_CONSTANT
    epsilon: float = EPSILON
    # Look-back in rows for self_z / robust_z; None keeps the whole history.  A
    # bound is another definition, not a cheaper way to the same answers.
    history_rows: int | None = None
    # Peer statistics are computed by a (group, day) aggregate joined back to
    # the rows.  The aggregate is broadcast when it has at most this many keys
    # (checked at run time); otherwise a shuffle join with AQE skew handling.
    peer_broadcast_max_keys: int = 2_000_000


@dataclass(frozen=True)
class ForestParams:
    n_trees: int = N_TREES
    max_samples: int = MAX_SAMPLES
    seeds: tuple = SEEDS
    # Oversampling factor of the hash pre-filter that draws each tree's rows.
    oversample: float = 2.0
    # Trees grown per Python call of the fit (amortises per-call overhead).
    trees_per_block: int = 10
    # Features enter the matrix rounded to so many decimals (None: as they are).
    decimals: int | None = 6


@dataclass(frozen=True)
class EvalParams:
    test_window_start: int = EVENTS_TEST_WINDOW_START
    top_k_values: tuple = TOP_K_VALUES
    primary_top_k: int = PRIMARY_TOP_K
    attack_types_tracked: tuple = ATTACK_TYPES
    aggregation: str = DEFAULT_AGGREGATION


@dataclass(frozen=True)
class AnalysisParams:
    features: FeatureParams = field(default_factory=FeatureParams)
    forest: ForestParams = field(default_factory=ForestParams)
    evaluation: EvalParams = field(default_factory=EvalParams)
    feature_sets: dict = field(default_factory=lambda: dict(FEATURE_SETS))
    scenarios: tuple = EVENTS_SCENARIOS
    scenario_seed: int = DEFAULT_SCENARIO_SEED
    day_zero: str = EVENTS_DAY_ZERO
