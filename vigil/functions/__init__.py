from vigil.functions.stats import (  # noqa: F401
    TrailingRankCorrelation,
    loo_peer_exact,
    loo_peer_float,
    regression_from_sums,
    regression_sums,
)
