"""Built-in factors."""

from pyspark.sql import functions as F

from ..functions import cs, ts
from ..functions.numeric import div
from .panel import Factor


def case_momentum_vol(fast: int = 5, slow: int = 20, floor: float = 0.2, name: str = "case_momentum_vol") -> Factor:
    """(fast - slow return) / volatility where the liquidity rank reaches the floor."""
    need, p = max(3, slow // 2), f"_{name}_"

    def stages():
        vol = ts.ts_std(p + "ret1", slow, need)
        spread = F.col(p + "fast") - F.col(p + "slow")
        return [
            {
                p + "fast": ts.ts_return("close", fast),
                p + "slow": ts.ts_return("close", slow),
                p + "ret1": ts.ts_return("close", 1),
                p + "liq": ts.ts_mean("amount", slow, need),
            },
            {p + "vol": F.when(F.abs(vol) >= 1e-12, vol)},
            {name: F.when(cs.cs_pct_rank(p + "liq") >= floor, div(spread, p + "vol"))},
        ]

    return Factor(name, stages, slow + 1)


def momentum(n: int, name: str | None = None) -> Factor:
    name = name or f"mom_{n}"
    return Factor(name, lambda: [{name: ts.ts_return("close", n)}], n)


def mean_reversion(n: int = 10, name: str | None = None) -> Factor:
    name = name or f"rev_{n}"
    return Factor(name, lambda: [{name: -ts.ts_return("close", n)}], n)


def volatility(n: int, name: str | None = None) -> Factor:
    name = name or f"vol_{n}"
    ret = f"_{name}_ret"

    def stages():
        vol = ts.ts_std(ret, n, max(3, n // 2))
        return [{ret: ts.ts_return("close", 1)}, {name: F.when(F.abs(vol) >= 1e-12, vol)}]

    return Factor(name, stages, n + 1)


def liquidity(n: int, name: str | None = None) -> Factor:
    name = name or f"liq_{n}"
    return Factor(name, lambda: [{name: ts.ts_mean("amount", n, max(3, n // 2))}], n)


def liq_momentum(fast: int = 5, slow: int = 20, floor: float = 0.2, name: str = "liq_momentum") -> Factor:
    """Rank of the fast return times rank of the mean amount, where the latter reaches the floor."""
    p = f"_{name}_"

    def stages():
        liq = cs.cs_pct_rank(p + "amt")
        return [
            {p + "ret": ts.ts_return("close", fast), p + "amt": ts.ts_mean("amount", slow, max(3, slow // 2))},
            {name: F.when(liq >= floor, cs.cs_pct_rank(p + "ret") * liq)},
        ]

    return Factor(name, stages, slow)
