"""Expressions used by the feature families, written as Spark SQL text.

Every expression is a built-in Spark expression (comparisons, arithmetic,
decimal math, window aggregates), so it runs inside whole-stage generated
code with no Python per row.  They are produced as SQL text because a
DataFrame projection given as text costs one JVM call, while the same
expression assembled from ``Column`` objects costs one call per node — with
~80 feature columns that difference is seconds of driver time per plan.

Helpers take and return SQL fragments; ``q`` quotes a column name.
"""

from __future__ import annotations

DEC = "DECIMAL(38,0)"


def q(name: str) -> str:
    """A quoted column reference."""
    return f"`{name}`"


def lit(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}D"


def sql_tree_sum(terms) -> str:
    """Balanced sum of SQL terms (shallow expression trees compile well)."""
    terms = [f"({t})" for t in terms]
    if not terms:
        return "0.0D"
    while len(terms) > 1:
        terms = [f"({terms[i]} + {terms[i + 1]})" if i + 1 < len(terms) else terms[i]
                 for i in range(0, len(terms), 2)]
    return terms[0]


class TrailingRankCorrelation:
    """Spearman correlation of position vs value over a short trailing window.

    The window's values are given oldest first (e.g. ``lag(x, n-1) ..
    lag(x, 1), x``); ``rows`` is the number of rows in the
    frame, so a lag before the user's first row is told from a null value: a
    window that holds a null value gives 0.0.  With average ranks,
    r_i - (k+1)/2 = 1/2 * sum_j sign(v_i - v_j), hence

        cov   = 1/2 * sum_{i<j} (i - j) * sign(v_i - v_j)
        var_r = 1/4 * sum_i (sum_{j != i} sign(v_i - v_j))^2
        var_p = k (k^2 - 1) / 12,     rho = cov / sqrt(var_p * var_r)

    — n(n-1)/2 sign terms, spread over three projection stages
    (``stage1`` → ``stage2`` → ``result``) so that the generated code stays
    small (one flat expression overflows the generated-method size limit,
    and array lambdas would be interpreted row by row).  Returns 0.0 for
    fewer than ``min_rows`` elements, a population std of the values at most
    ``min_std``, or an undefined value.
    """

    def __init__(self, name: str, n: int, min_rows: int = 3, min_std: float = 1e-9):
        self.t, self.n, self.min_rows, self.min_std = f"_{name}", n, min_rows, min_std
        self.pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]

    def stage1(self, values: list[str]) -> list[str]:
        """``values``: SQL of the n window values, oldest first."""
        assert len(values) == self.n
        t = self.t
        out = [f"coalesce(signum(({values[i]}) - ({values[j]})), 0.0D) AS {q(f'{t}_s{i}_{j}')}"
               for i, j in self.pairs]
        k = sql_tree_sum(f"CASE WHEN ({x}) IS NOT NULL THEN 1.0D ELSE 0.0D END" for x in values)
        tot = sql_tree_sum(f"coalesce(({x}), 0.0D)" for x in values)
        return out + [f"{k} AS {q(t + '_k')}", f"{tot} AS {q(t + '_tot')}"]

    def stage2(self, values: list[str]) -> list[str]:
        t, n = self.t, self.n
        s = {p: q(f"{t}_s{p[0]}_{p[1]}") for p in self.pairs}
        k = q(f"{t}_k")
        mean = f"try_divide({q(t + '_tot')}, {k})"
        row_sign = [sql_tree_sum([s[(i, j)] for j in range(i + 1, n)]
                                 + [f"-{s[(j, i)]}" for j in range(i)]) for i in range(n)]
        cov = f"{sql_tree_sum(f'{lit(i - j)} * {s[(i, j)]}' for i, j in self.pairs)} / 2.0D"
        var_r = f"{sql_tree_sum(f'({r}) * ({r})' for r in row_sign)} / 4.0D"
        square = sql_tree_sum(f"CASE WHEN ({x}) IS NOT NULL THEN (({x}) - {mean}) * (({x}) - {mean}) "
                              f"ELSE 0.0D END" for x in values)
        var_v = f"try_divide({square}, {k})"
        return [f"{k} AS {q(t + '_k2')}", f"{cov} AS {q(t + '_cov')}",
                f"{var_r} AS {q(t + '_vr')}", f"{var_v} AS {q(t + '_vv')}"]

    def result(self, rows: str) -> str:
        t = self.t
        k = q(f"{t}_k2")
        return (f"CASE WHEN {k} = {rows} AND {k} >= {int(self.min_rows)} AND sqrt({q(t + '_vv')}) > {lit(self.min_std)} "
                f"THEN coalesce(nanvl(try_divide({q(t + '_cov')}, sqrt(({k} * ({k} * {k} - 1.0D) / 12.0D) "
                f"* {q(t + '_vr')})), 0.0D), 0.0D) ELSE 0.0D END")


def loo_peer_exact(x: str, n: str, s1: str, s2: str, s1_d: str, s2_d: str) -> tuple[str, str]:
    """Leave-one-out mean and sample std of an integer measure among peers.

    ``n`` is the number of non-null peers including the row itself, ``s1``
    and ``s2`` the exact (decimal(38,0)) sum and sum of squares, ``s1_d`` and
    ``s2_d`` the same sums in double (used only if the exact form overflows).

    With m = n-1 others, T1 = s1 - x and T2 = s2 - x^2:
        mean_loo = T1 / m
        var_loo  = (m*T2 - T1^2) / (m*(m-1))
    The numerator is formed exactly, so all-equal peers give exactly 0.
    Undefined variances (n <= 2) become 0 and an undefined mean stays null,
    as in the published definition (sqrt(greatest(null, 0)) = 0).
    """
    xd = f"CAST({x} AS {DEC})"
    m = f"({n} - 1)"
    t1 = f"({s1} - {xd})"
    t2 = f"({s2} - {xd} * {xd})"
    mean = f"try_divide(CAST({t1} AS DOUBLE), CAST({m} AS DOUBLE))"
    num = f"try_subtract(try_multiply(CAST({m} AS {DEC}), {t2}), try_multiply({t1}, {t1}))"
    var_exact = f"try_divide(CAST({num} AS DOUBLE), CAST({m} * ({m} - 1) AS DOUBLE))"
    # overflow fallback: double sums of the others
    t1_d = f"({s1_d} - CAST({x} AS DOUBLE))"
    t2_d = f"({s2_d} - CAST({x} AS DOUBLE) * CAST({x} AS DOUBLE))"
    var_float = (f"try_divide({t2_d} - try_divide({t1_d} * {t1_d}, CAST({m} AS DOUBLE)), "
                 f"CAST({m} - 1 AS DOUBLE))")
    var = f"CASE WHEN {num} IS NULL THEN {var_float} ELSE {var_exact} END"
    return mean, f"sqrt(greatest({var}, 0.0D))"


def loo_peer_float(x: str, n: str, mean_g: str, m2_g: str) -> tuple[str, str]:
    """Leave-one-out mean and std for a floating measure (published formula).

    ``mean_g`` is the group mean and ``m2_g`` the group's sum of squared
    deviations; SSD_loo = M2 - n/(n-1) * (x - mean)^2.
    """
    xd, nd = f"CAST({x} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    mean = f"try_divide({nd} * {mean_g} - {xd}, {nd} - 1)"
    dev = f"({xd} - {mean_g})"
    ssd_loo = f"({m2_g} - try_divide({nd}, {nd} - 1) * {dev} * {dev})"
    return mean, f"sqrt(greatest(try_divide({ssd_loo}, {nd} - 2), 0.0D))"


REGRESSION_SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy")


def regression_sums(y: str, x: str) -> dict[str, str]:
    """Aggregates for an exact least-squares fit of integer y on integer x.

    Pairs with a null y (or x) are skipped, as in the SQL regression
    aggregates.  Products are formed in decimal(38,0), so every sum is exact.
    """
    ok = f"{y} IS NOT NULL AND {x} IS NOT NULL"
    xd, yd = f"CAST({x} AS {DEC})", f"CAST({y} AS {DEC})"
    return {
        "n": f"count(CASE WHEN {ok} THEN 1 END)",
        "sx": f"sum(CASE WHEN {ok} THEN {xd} END)",
        "sy": f"sum(CASE WHEN {ok} THEN {yd} END)",
        "sxy": f"sum(CASE WHEN {ok} THEN {xd} * {yd} END)",
        "sxx": f"sum(CASE WHEN {ok} THEN {xd} * {xd} END)",
        "syy": f"sum(CASE WHEN {ok} THEN {yd} * {yd} END)",
    }


def regression_from_sums(n: str, sx: str, sy: str, sxy: str, sxx: str, syy: str) -> tuple[str, str]:
    """Slope and R^2 of y on x from exact sums.

    cov = n*sxy - sx*sy, vx = n*sxx - sx^2, vy = n*syy - sy^2 are exact; one
    division each in double follows.  Conventions of the SQL aggregates:
    slope and R^2 are null when x has no spread, R^2 is 1 when y has none.
    (If an exact term overflows decimal(38,0) it becomes null.)
    """
    nd = f"CAST({n} AS {DEC})"
    cov = f"try_subtract(try_multiply({nd}, {sxy}), try_multiply({sx}, {sy}))"
    vx = f"try_subtract(try_multiply({nd}, {sxx}), try_multiply({sx}, {sx}))"
    vy = f"try_subtract(try_multiply({nd}, {syy}), try_multiply({sy}, {sy}))"
    cov_d, vx_d, vy_d = (f"CAST({e} AS DOUBLE)" for e in (cov, vx, vy))
    slope = f"CASE WHEN {vx} <> 0 THEN {cov_d} / {vx_d} END"
    r2 = (f"CASE WHEN {vx} = 0 THEN CAST(NULL AS DOUBLE) WHEN {vy} = 0 THEN 1.0D "
          f"ELSE {cov_d} * {cov_d} / ({vx_d} * {vy_d}) END")
    return slope, r2
