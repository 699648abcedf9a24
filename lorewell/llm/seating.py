"""Numbers of tables in Pitman-Yor restaurants, drawn from their conditional distribution.

With d the discount, the seatings of a dish's n customers at t tables weigh S(n, t) together, S the generalised Stirling
number with S(n+1, t) = S(n, t-1) + (n - d t) S(n, t), and each further table is worth a factor that depends on the
restaurant and its parent. So a draw of t reseats all customers of the dish at once, however many they are.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Numbers of customers up to which the distribution is tabled exactly; beyond, S is taken in its asymptotic forms.
SMALL = 64
#: Candidates on either side of the mode, in steps of a quarter of a deviation.
SIDE = 24


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers, by Stirling's series after four steps up."""
    x = np.asarray(x, np.float64)
    y, inverse = x + 4, 1 / (x + 4)
    square = inverse * inverse
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + inverse * (1 / 12 - square * (1 / 360 - square / 1260)) - np.log(x * (x + 1) * (x + 2) * (x + 3))


@cache
def log_stirling(discount: float) -> np.ndarray:
    """log S(n, t) for n and t up to SMALL."""
    table = np.full((SMALL + 1, SMALL + 1), -np.inf)
    table[1, 1], t = 0.0, np.arange(1, SMALL + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(1, SMALL):
            grown = np.where(t <= n, np.log(np.maximum(n - discount * t, 1e-300)), -np.inf)
            table[n + 1, 1:] = np.logaddexp(table[n, :-1], table[n, 1:] + grown)
    return table


@cache
def _forms(discount: float) -> tuple[np.ndarray, ...]:
    """Tables for the chance that t Sibuya variables, whose generating function is 1 - (1 - z)^d, add up to n.

    While t is at most `top` x n^d and n / 5, n times the chance is a function of t / n^d: the integral below, which comes from
    drawing the contour round the cut of the generating function. Beyond it a saddle point is used, found by t / n.
    """
    d, turn = discount, np.pi * discount
    top = 8 ** (1 - d) / (d * -np.cos(turn)) if d > 0.55 else 4.0
    s = np.linspace(-40 / d, np.log(400.0), 4000)
    u = np.exp(s)
    x = np.exp(np.linspace(np.log(1e-9), np.log(top), 400))
    inner = -x[:, None] * u**d
    value = np.exp(inner * np.cos(turn) - u + s) * np.sin(-inner * np.sin(turn))
    h = np.log(np.maximum(value.sum(1) * (s[1] - s[0]) / np.pi, 1e-300))
    q = np.concatenate([np.exp(np.linspace(np.log(1e-18), np.log(0.5), 4000)), 1 - np.exp(np.linspace(np.log(0.5), np.log(1e-9), 2000))[1:]])
    share = -np.expm1(d * np.log(q)) / (d * (1 - q) * q ** (d - 1))
    return np.array([top]), np.log(x), h, np.log(share), np.log(q)


def log_chance(n: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log P that t Sibuya variables add up to n, up to a constant of n, for n beyond SMALL and t from 1 to n."""
    d = discount
    top, log_x, h, log_share, log_q = _forms(d)

    def near(t):
        x = np.log(t) - d * np.log(n)
        return np.interp(x, log_x, h) + np.minimum(x - log_x[0], 0)

    def far(t):
        q = np.exp(np.interp(np.log(np.minimum(t / n, 1 - 1e-9)), log_share, log_q))
        g = -np.expm1(d * np.log(q))
        first = (1 - q) * d * q ** (d - 1) / g
        spread = first + (1 - q) ** 2 * d * (1 - d) * q ** (d - 2) / g - first**2
        return t * np.log(g) - n * np.log1p(-q) - 0.5 * np.log(2 * np.pi * (t * np.maximum(spread, 0) + 1 / 6))

    bound = np.minimum(top[0] * n**d, n / 5)
    return np.where(t <= bound, near(t), far(t) + near(bound) - far(bound))


def gammas(shape: np.ndarray, units) -> np.ndarray:
    """A gamma variable of each shape from 1 on, by Marsaglia and Tsang; units(k, rows) are those rows' k-th numbers between 0 and 1."""
    d = shape - 1 / 3
    c, out, left, k = 1 / np.sqrt(9 * d), np.empty(len(d)), np.arange(len(d)), 0
    while len(left):
        x = np.sqrt(-2 * np.log(units(k, left))) * np.cos(2 * np.pi * units(k + 1, left))
        v = np.maximum(1 + c[left] * x, 1e-12) ** 3
        value = d[left] * v
        taken = (v > 1e-30) & (np.log(units(k + 2, left)) < 0.5 * x * x + d[left] - value + d[left] * np.log(v))
        out[left[taken]] = value[taken]
        left, k = left[~taken], k + 3
    return out


def draw(n: np.ndarray, log_rate: np.ndarray, others: np.ndarray | None, discount: float, rng: np.random.Generator) -> np.ndarray:
    """drawn() with numbers of a generator."""
    return drawn(n, log_rate, others, discount, rng.random(len(n)), rng.random(len(n)))


def drawn(n: np.ndarray, log_rate: np.ndarray, others: np.ndarray | None, discount: float, unit: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each dish with n > 0 customers the number of tables t, drawn from
    p(t) ~ S(n, t) x product over the tables j = 1 to t - 1 after the first of rate x (others + j).

    The parent seats a customer for each table, so that its own weight for the dish grows with each: `others` is that
    weight without this restaurant's tables. Where it is None the factor of each table is the rate alone. unit and
    second are even numbers between 0 and 1 for each dish; nothing else of a draw is random.
    """
    out = np.ones(len(n), np.int64)
    weigh = np.zeros(len(n)) if others is None else others
    small = np.flatnonzero((n > 1) & (n <= SMALL))
    small = small[np.argsort(n[small], kind="stable")]
    table = log_stirling(discount)
    for size in np.unique(n[small]).tolist():
        same = small[np.searchsorted(n[small], size) : np.searchsorted(n[small], size, side="right")]
        later = np.arange(1, size)
        for k in range(0, len(same), (1 << 20) // size + 1):
            at = same[k : k + (1 << 20) // size + 1]
            factor = log_rate[at, None] + (0 if others is None else np.log(weigh[at, None] + later))
            logits = table[size, 1 : size + 1] + np.concatenate([np.zeros((len(at), 1)), np.cumsum(np.broadcast_to(factor, (len(at), size - 1)), 1)], 1)
            weight = np.cumsum(np.exp(logits - logits.max(1, keepdims=True)), 1)
            out[at] += (weight < unit[at, None] * weight[:, -1:]).sum(1)
    large = np.flatnonzero(n > SMALL)
    for k in range(0, len(large), 1 << 14):
        at = large[k : k + (1 << 14)]
        out[at] = _draw_large(n[at].astype(np.float64), log_rate[at], None if others is None else weigh[at], discount, unit[at], second[at])
    return out


def _draw_large(n, log_rate, others, discount, unit, second) -> np.ndarray:
    """The same for many customers: the mode by sections of log t, then a draw among evenly spaced numbers round it."""

    def log_p(t, rows=slice(None)):
        size, rate = n[rows], log_rate[rows]
        if t.ndim > 1:
            size, rate = size[:, None], rate[:, None]
        value = log_chance(size, np.clip(t, 1, size), discount) - t * np.log(discount) - log_gamma(t + 1.0) + (t - 1) * rate
        if others is not None:
            own = others[rows][:, None] if t.ndim > 1 else others[rows]
            value = value + log_gamma(own + t) - log_gamma(own + 1)
        return np.where((t >= 1) & (t <= size), value, -np.inf)

    low, high = np.zeros(len(n)), np.log(n)
    for _ in range(26):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        up = log_p(np.exp(a)) < log_p(np.exp(b))
        low, high = np.where(up, a, low), np.where(up, high, b)
    mode = np.clip(np.rint(np.exp((low + high) / 2)), 1, n)
    gap = np.maximum(1.0, np.rint(mode / 50))
    middle = np.clip(mode, 1 + gap, np.maximum(n - gap, 1 + gap))
    bend = 2 * log_p(middle) - log_p(middle - gap) - log_p(middle + gap)
    deviation = gap / np.sqrt(np.clip(np.where(np.isfinite(bend), bend, 1.0), 1e-9, None))
    step = np.maximum(1.0, np.floor(np.minimum(deviation, np.sqrt(n)) / 4))
    offsets = np.arange(-SIDE, SIDE + 1)
    start = np.where(mode - SIDE * step < 1, 1 + SIDE * step, mode)
    candidates = start[:, None] + step[:, None] * offsets
    logits = log_p(candidates)
    weight = np.cumsum(np.exp(logits - logits.max(1, keepdims=True)), 1)
    pick = (weight < unit[:, None] * weight[:, -1:]).sum(1)
    chosen = candidates[np.arange(len(n)), pick] + np.floor((second - 0.5) * step + 0.5) * (step > 1)
    return np.clip(chosen, 1, n).astype(np.int64)


def share_discount(once: int, twice: int) -> float:
    """The usual estimate of a discount from how many dishes have one and two customers."""
    return float(np.round(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95), 4))
