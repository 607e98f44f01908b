"""Column helpers and driver-side scalars that the operators share."""

from __future__ import annotations

import hashlib
import json
import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def rounded(value: Column, places: int = 6) -> Column:
    """Rounded for reports, without a negative zero."""
    return F.round(value, places) + F.lit(0.0)


def to_tick(price: Column, tick: float, places: int = 4) -> Column:
    """Nearest multiple of the tick, halves to the even multiple."""
    return F.round(F.rint(price / tick) * tick, places) if tick > 0 else price


def tick_price(price: float, tick: float, places: int = 4) -> float:
    return round(round(price / tick) * tick, places) if tick > 0 else price


def canonical_json(value) -> str:
    """JSON of sorted keys without spaces: what every content digest is taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def content_hash(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def binomial_tail(successes: int, trials: int, p: float) -> float:
    """P(X >= successes) of a binomial variable."""
    if p <= 0:
        return float(successes <= 0)
    if p >= 1:
        return 1.0
    if successes > trials:
        return 0.0
    if successes <= 0:
        return 1.0
    mode = min(trials, int((trials + 1) * p))
    if successes > mode:
        return _outward(successes, trials, p, up=True)
    return max(0.0, 1.0 - _outward(successes - 1, trials, p, up=False))


def _outward(first: int, trials: int, p: float, up: bool) -> float:
    """Sum of a binomial variable's probabilities from ``first`` away from the mode, where each
    is smaller than the one before by a ratio that falls: it ends where what is left cannot
    change the sum, after some multiple of the root of ``trials``."""
    k, odds = first, p / (1 - p)
    term = total = 1.0
    while k < trials if up else k > 0:
        ratio = (trials - k) / (k + 1) * odds if up else k / (trials - k + 1) / odds
        term *= ratio
        total += term
        k += 1 if up else -1
        if ratio < 1 and term * ratio / (1 - ratio) < total * 1e-17:
            break
    log = math.lgamma(trials + 1) - math.lgamma(first + 1) - math.lgamma(trials - first + 1) + first * math.log(p) + (trials - first) * math.log1p(-p)
    return min(1.0, math.exp(log + math.log(total)))


def _solve(f, low: float = 0.0, high: float = 1.0) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def binomial_upper(successes: int, trials: int, confidence: float = 0.95) -> float:
    """One-sided exact upper bound of a rate."""
    _check(successes, trials)
    return 1.0 if successes == trials else _solve(lambda p: binomial_tail(successes + 1, trials, p) - confidence)


def binomial_lower(successes: int, trials: int, confidence: float = 0.95) -> float:
    """One-sided exact lower bound of a rate."""
    _check(successes, trials)
    return 0.0 if successes == 0 else _solve(lambda p: binomial_tail(successes, trials, p) - (1 - confidence))


def _check(successes: int, trials: int) -> None:
    if trials <= 0 or not 0 <= successes <= trials:
        raise ValueError("invalid binomial counts")


def false_pass_gate(passes: int, runs: int, least_runs: int = 200, most: int = 4, limit: float = 0.05) -> bool:
    return runs >= least_runs and passes <= most and binomial_upper(passes, runs) <= limit


def detection_gate(found: int, runs: int, least_runs: int = 100, least: int = 87, limit: float = 0.80) -> bool:
    return runs >= least_runs and found >= least and binomial_lower(found, runs) >= limit


def expected_max_sharpe(sigma: float, effective_trials: float) -> float:
    """Expected largest Sharpe ratio of so many independent trials without skill."""
    if effective_trials <= 1 or sigma == 0:
        return 0.0
    z = NormalDist().inv_cdf
    return sigma * ((1 - EULER_GAMMA) * z(1 - 1 / effective_trials) + EULER_GAMMA * z(1 - 1 / (effective_trials * math.e)))
