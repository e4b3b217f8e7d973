"""Path kernels that go through time in chunks.

All paths of a block advance side by side: a chunk of draws, (steps, paths), moves the state
of each path on (balance, peak, deepest fall, ruin, first event of an evaluation account),
and nothing as long as a path is kept, but for permutations. Draws come from a source of
uniforms: a generator for each block, or the counter hash that the SQL forms use, so that both give the
same numbers. Results depend neither on the chunk nor on how blocks are dealt to tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from math import sqrt

import numpy as np
import pandas as pd

#: Step of the counter hash, and the distance between the seeds of two streams.
STEP, STREAM = 1831565813, 7919
#: Paths that advance side by side, draws of a chunk, and draws that a permutation holds.
PATHS_AT_ONCE, CHUNK, HELD = 512, 1 << 16, 1 << 22
#: Student draws at a time, layers of a Student density, and a share of a number that is no more than its rounding.
BATCH, LAYERS, NOTHING = 1 << 18, 1024, 1e-12
#: Results of a cell of a long permutation and of a part of a cell, at least (16 bits name both), and bits
#: of the share of cells that are looked at first.
CELL, PART, HEAD = 512, 32, 4
#: Results from which a history is drawn by its different values, if those are a share of them at most.
MANY, FEW = 1 << 16, 1 / 4
#: Regimes up to which each one's next regime is worked out at every step.
FEW_REGIMES = 8
#: Paths side by side below which numpy's own loops are faster than a call for each step.
NARROW = 64
SUMMARY = "sim_id long, final_balance double, max_drawdown double, ruined boolean, ev double, outcome string, steps long, event_step long"
OUTCOMES = np.array(["time", "drawdown", "consistency", "passed"], object)


@dataclass(frozen=True)
class Session:
    """Trading stops for a session after so many losses or so large a loss."""

    trades: int = 10
    max_losses: int = 3
    max_loss: float = 500.0


@dataclass(frozen=True)
class Config:
    """``rules``: trailing drawdown, target and consistency of an evaluation account.
    ``steps``: None for as many as the history has rows. ``counter``: draw as the SQL forms do.
    ``capped``: a drawdown is 1 at most, also of a balance below 0."""

    paths: int = 10_000
    steps: int | None = None
    capital: float = 10_000
    ruin_percent: float = 50
    seed: int = 42
    multiplicative: bool = False
    session: Session | None = None
    rules: tuple[float, float, float] | None = (600, 400, 40)
    counter: bool = False
    capped: bool = True


def counter_uniform(seed: int, k: np.ndarray) -> np.ndarray:
    """The uniform of each counter ``k`` (from 1), by 32-bit hashes; repeats after 2**32."""
    a = np.uint32(seed & 0xFFFFFFFF) + k.astype(np.uint32) * np.uint32(STEP)
    h = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    h ^= h + (h ^ (h >> np.uint32(7))) * (h | np.uint32(61))
    return (h ^ (h >> np.uint32(14))) / 4294967296.0


def running(op: np.ufunc, x: np.ndarray) -> np.ndarray:
    """``op.accumulate(x)`` over the first axis, in place. A call for each row is faster than
    numpy's own loop, which goes down one column after another, unless rows are short."""
    if x.shape[1] < NARROW:
        return op.accumulate(x, axis=0, out=x)
    rows = list(x)
    for before, row in zip(rows, rows[1:]):
        op(before, row, row)
    return x


class Source:
    """Draws of a block of paths, (steps, paths), by streams that do not touch each other."""

    paths: int

    def uniform(self, stream: int, t: int, k: int) -> np.ndarray:
        raise NotImplementedError

    def order(self, n: int) -> np.ndarray:
        """A random order of ``n`` for each path, (paths, n): by uniforms, equal ones as they stand."""
        at, out = np.arange(n, dtype=np.uint64), np.empty((self.paths, n), _index(n))
        for i in range(self.paths):
            keys = self.keys(i, n) | at
            keys.sort()
            out[i] = keys & np.uint64((1 << 32) - 1)
        return out

    def keys(self, path: int, n: int) -> np.ndarray:
        """Random whole numbers, whose low 32 bits are 0."""
        raise NotImplementedError

    def normal(self, stream: int, t: int, k: int) -> np.ndarray:
        """By polar coordinates, from two streams."""
        u = np.maximum(self.uniform(stream, t, k), 2.0**-33)
        return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * self.uniform(stream + 1, t, k))

    def student(self, stream: int, t: int, k: int, df: float) -> np.ndarray:
        """The same for a Student law of any ``df`` (Bailey's form), exact as that one is."""
        u = np.maximum(self.uniform(stream, t, k), 2.0**-33)
        return np.sqrt(df * (np.power(u, -2 / df) - 1)) * np.cos(2 * np.pi * self.uniform(stream + 1, t, k))


class Student:
    """Draws of a Student law by layers of equal area (Marsaglia and Tsang): nearly all lie where a
    layer is under the density all the way, which one comparison tells. The law is exact."""

    def __init__(self, df: float) -> None:
        self.df = df
        near, far = 0.5, 1.0
        while self._layers(far) is None:
            near, far = far, 2 * far
        while (mid := (near + far) / 2) not in (near, far):
            near, far = (mid, far) if self._layers(mid) is None else (near, mid)
        self.begin = far  # of the tail
        edges = np.array(self._layers(far))
        edges[-1] = 0.0
        self.at, self.least = self._density(edges[1:]), np.log1p(far * far / df)
        width, share = edges[:-1], edges[1:] / edges[:-1]
        self.width, self.share = np.concatenate((width, -width)), np.concatenate((share, share))

    def _density(self, x):
        return (1 + x * x / self.df) ** (-(self.df + 1) / 2)

    def _layers(self, begin: float) -> list[float] | None:
        """The edges of all layers, the last one 0, if the tail begins there; None if they do not fit
        under the density. The lowest one is as wide as if the tail were part of its rectangle."""
        df, height = self.df, float(self._density(begin))
        s, weight = _LAGUERRE
        least = np.log1p(begin * begin / df)
        tail = float(np.exp(-df / 2 * least) / np.sqrt(df) * (weight / np.sqrt(-np.expm1(-least - 2 * s / df))).sum())
        area = begin * height + tail
        edges = [area / height, begin]
        while len(edges) <= LAYERS:
            height += area / edges[-1]
            if height > 1:
                return None
            edges.append(sqrt(df * (height ** (-2 / (df + 1)) - 1)))
        return edges

    def _tail(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """By log(1 + x * x / df), whose density falls faster than an exponential one."""
        x = self.least + rng.standard_exponential(n) * (2 / self.df)
        bad = np.flatnonzero(rng.random(n) ** 2 * np.expm1(-x) < np.expm1(-self.least))
        x = np.sqrt(self.df * np.expm1(x))
        if bad.size:
            x[bad] = self._tail(rng, bad.size)
        return x

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out, late = np.empty(n), []
        for t in range(0, n, CHUNK):
            u = rng.random(min(CHUNK, n - t))
            u *= 2 * LAYERS
            layer = u.astype(np.intp)
            u -= layer
            x = np.multiply(self.width.take(layer, mode="clip"), u, out=out[t : t + CHUNK])
            some = np.flatnonzero(u >= self.share.take(layer, mode="clip"))
            late.append((some + t, layer[some], x[some]))
        late, layer, x = map(np.concatenate, zip(*late))
        if late.size:
            layer %= LAYERS
            top, bottom = self.at[layer], self.at[layer - 1]
            bad = bottom + rng.random(late.size) * (top - bottom) >= self._density(x)
            tail = np.flatnonzero(layer == 0)
            x[tail], bad[tail] = np.copysign(self._tail(rng, tail.size), x[tail]), False
            if bad.any():
                x[bad] = self.draw(rng, int(bad.sum()))
            out[late] = x
        return out


_LAGUERRE = np.polynomial.laguerre.laggauss(40)
student_law = cache(Student)


class Generators(Source):
    """A generator for each stream."""

    def __init__(self, rngs: Callable[[int], np.random.Generator], paths: int) -> None:
        self.paths, self._make, self._own, self._left = paths, rngs, {}, {}

    def _rng(self, stream: int) -> np.random.Generator:
        if stream not in self._own:
            self._own[stream] = self._make(stream)
        return self._own[stream]

    @property
    def generator(self) -> np.random.Generator:
        return self._rng(0)

    def uniform(self, stream: int, t: int, k: int) -> np.ndarray:
        return self._rng(stream).random((k, self.paths))

    def order(self, n: int) -> np.ndarray:
        return np.stack([self._rng(0).permutation(n) for _ in range(self.paths)])

    def normal(self, stream: int, t: int, k: int) -> np.ndarray:
        return self._rng(stream).standard_normal((k, self.paths))

    def student(self, stream: int, t: int, k: int, df: float) -> np.ndarray:
        """From draws of BATCH at a time, so that it does not matter how many are asked for at once."""
        have, n = [self._left.pop(stream, np.empty(0))], k * self.paths
        while sum(map(len, have)) < n:
            have.append(student_law(df).draw(self._rng(stream), BATCH))
        have = np.concatenate(have) if len(have) > 1 else have[0]
        self._left[stream] = have[n:]
        return have[:n].reshape(k, self.paths)

    def chi_square(self, stream: int, t: int, k: int, df: float) -> np.ndarray:
        return self._rng(stream).chisquare(df, (k, self.paths))


class Counters(Source):
    """The numbers of the SQL forms: draw ``t`` of path ``id`` has the counter id * n + t + 1."""

    def __init__(self, seed: int, ids: np.ndarray, n: int) -> None:
        self.paths, self.seed, self.base = len(ids), seed, ids.astype(np.int64) * n + 1

    def uniform(self, stream: int, t: int, k: int) -> np.ndarray:
        return counter_uniform(self.seed + STREAM * stream, (self.base + np.arange(t, t + k)[:, None]) & 0xFFFFFFFF)

    def keys(self, path: int, n: int) -> np.ndarray:
        u = counter_uniform(self.seed, (self.base[path] + np.arange(n)) & 0xFFFFFFFF)
        return (u * 4294967296.0).astype(np.uint64) << np.uint64(32)


class Once:
    """A history of which a path takes each result once, in random order."""

    def __init__(self, pool: np.ndarray) -> None:
        self.pool = pool

    @cached_property
    def sides(self) -> list[np.ndarray]:
        """Its losses and its gains."""
        return [self.pool[self.pool < 0], self.pool[self.pool >= 0]]

    @cached_property
    def total(self) -> float:
        """Its sum; not finite if it holds what is no number."""
        return float(sum(x.sum() for x in self.sides)) if np.isfinite(self.pool).all() else np.nan


@dataclass(frozen=True)
class Kernel:
    """``begin(source, n)``: the state of a block; ``draw(source, state, t, k)``: its draws of
    steps t to t + k, in order. ``whole``: it keeps all of a path, so fewer advance at once.
    ``once``: the history, if a path is a permutation of it."""

    begin: Callable[[Source, int], dict]
    draw: Callable[[Source, dict, int, int], np.ndarray]
    whole: bool = False
    once: Once | None = None

    def __call__(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """The draws of one path."""
        source = Generators(lambda _: rng, 1)
        return self.draw(source, self.begin(source, n), 0, n)[:, 0]


def _index(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


def _plain(draw: Callable[[Source, int, int], np.ndarray]) -> Kernel:
    return Kernel(lambda source, n: {}, lambda source, state, t, k: draw(source, t, k))


#: Results from which a history is drawn by its different values, if those are a share of them at most.
MANY, FEW = 1 << 16, 1 / 4


def _alias(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walker's tables: cell i stands for value 2 * i up to its limit, for value 2 * i + 1 beyond."""
    n = len(values)
    share, other, own = counts * (n / counts.sum()), np.arange(n), np.ones(n)
    low, high = (np.flatnonzero(x).tolist() for x in (share < 1, share >= 1))
    while low and high:
        i, j = low.pop(), high[-1]
        own[i], other[i] = share[i], j
        share[j] -= 1 - share[i]
        if share[j] < 1:
            low.append(high.pop())
    return np.arange(n) + own, np.stack((values, values[other]), axis=1).ravel()


def _tables(pools: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """How many different values each pool has, and their tables, one pool after another: they
    stay in the cache however long the history is. None if they would not help."""
    rows = sum(map(len, pools))
    if rows < MANY:
        return None
    found = [np.unique(pool, return_counts=True) for pool in pools]
    sizes = np.array([len(values) for values, _ in found])
    if sizes.sum() > FEW * rows:
        return None
    limits, values = zip(*(_alias(*x) for x in found))
    return sizes, np.concatenate(limits), np.concatenate(values)


def _from_tables(u: np.ndarray, first: np.ndarray | int, limits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values that ``u``, uniform up to the number of cells of a pool, stands for."""
    at = u.astype(np.intp)
    at += first
    beyond = u >= limits.take(at, mode="clip")
    at <<= 1
    at |= beyond
    return values.take(at, mode="clip")


def bootstrap(pool: np.ndarray) -> Kernel:
    """Counters name rows of the history; generators draw its values by how often they stand there."""
    tables = cache(lambda: _tables([pool]))

    def draw(source: Source, state: dict, t: int, k: int) -> np.ndarray:
        u = source.uniform(0, t, k)
        if isinstance(source, Counters) or tables() is None:
            u *= len(pool)
            return pool.take(u.astype(np.intp), mode="clip")
        sizes, limits, values = tables()
        u *= sizes[0]
        return _from_tables(u, 0, limits, values)

    return Kernel(lambda source, n: {}, draw)


def independent(pools: list[np.ndarray]) -> Kernel:
    """Sums of a draw from each of ``pools``; draw j of step t has the counter of the SQL form,
    (id * n + t) * pools + j + 1."""
    legs = len(pools)

    def draw(source: Counters, state: dict, t: int, k: int) -> np.ndarray:
        at = (source.base - 1 + np.arange(t, t + k)[:, None]) * legs + 1
        return sum(pool[(counter_uniform(source.seed, (at + j) & 0xFFFFFFFF) * len(pool)).astype(_index(len(pool)))] for j, pool in enumerate(pools))

    return Kernel(lambda source, n: {}, draw)


def permutation(pool: np.ndarray) -> Kernel:
    def begin(source: Source, n: int) -> dict:
        return {"order": source.order(len(pool))}

    def draw(source: Source, state: dict, t: int, k: int) -> np.ndarray:
        t, order = t % len(pool), state["order"]
        some = order[:, t : t + k] if t + k <= len(pool) else order[:, np.arange(t, t + k) % len(pool)]
        return np.ascontiguousarray(pool[some].T)

    return Kernel(begin, draw, whole=True, once=Once(pool))


def block_bootstrap(pool: np.ndarray, length: float) -> Kernel:
    """Stationary blocks of mean ``length`` on the circle of the history: a uniform starts one
    with probability 1 / length, and what is left of it places it."""
    length, n = max(1.0, float(length)), len(pool)

    def draw(source: Source, state: dict, t: int, k: int) -> np.ndarray:
        u = source.uniform(0, t, k)
        goes_on = u >= 1 / length
        if t == 0:
            goes_on[0], u[0] = False, u[0] / length
        u *= length * n
        start = u.astype(np.int64)
        at = np.arange(k)[:, None]
        start -= at
        before = state["at"]
        for stays, row in zip(goes_on, start):  # a row without a start goes on from the one before
            np.copyto(row, before, where=stays)
            before = row
        start += at
        state["at"] = (start[-1] + 1) % n
        return pool.take(start, mode="wrap")

    return Kernel(lambda source, n: {"at": np.zeros(source.paths, np.int64)}, draw)


def regime_switching(pools: dict[str, np.ndarray], transitions: np.ndarray) -> Kernel:
    """Markov regimes in the order of ``pools``, the first one uniform; draws come from the
    regime's pool."""
    sizes, upto = np.array([len(p) for p in pools.values()]), np.cumsum(transitions, axis=1)
    flat, first = np.concatenate(list(pools.values())), np.cumsum(sizes) - sizes
    tables = cache(lambda: _tables(list(pools.values())))

    def begin(source: Source, n: int) -> dict:
        return {"now": np.minimum(source.uniform(2, 0, 1)[0] * len(sizes), len(sizes) - 1).astype(np.int64)}

    def draw(source: Source, state: dict, t: int, k: int) -> np.ndarray:
        u, states = source.uniform(0, t, k), _states(source, state, t, k) if len(sizes) > 1 else np.zeros((k, source.paths), np.int64)
        if isinstance(source, Counters) or tables() is None:
            u *= sizes.take(states, mode="clip")
            at = u.astype(np.int64)
            at += first.take(states, mode="clip")
            return flat.take(at, mode="clip")
        cells, limits, values = tables()
        u *= cells.take(states, mode="clip")
        return _from_tables(u, (np.cumsum(cells) - cells).take(states, mode="clip"), limits, values)

    def _states(source: Source, state: dict, t: int, k: int) -> np.ndarray:
        v, now, paths = source.uniform(1, t, k), state["now"], source.paths
        states = np.empty(v.shape, np.int64)
        if len(sizes) <= FEW_REGIMES:  # where each regime would go on to, for all steps at once
            follow = np.zeros((k, len(sizes), paths), np.uint8)
            for a, b in np.ndindex(len(sizes), len(sizes) - 1):
                follow[:, a] += v >= upto[a, b]
            path = np.arange(paths)
            for i, row in enumerate(follow.reshape(k, -1)):
                states[i] = now
                now = row.take(now * paths + path, mode="clip").astype(np.int64)
        else:
            for i in range(k):
                states[i] = now
                now = np.minimum((upto[now] <= v[i, :, None]).sum(1), len(sizes) - 1)
        state["now"] = now
        return states

    return Kernel(begin, draw)


def parametric(mu: float, sigma: float, df: float | None) -> Kernel:

    def draw(source: Source, t: int, k: int) -> np.ndarray:
        z = source.normal(0, t, k) if df is None else source.student(0, t, k, df)
        z *= sigma
        z += mu
        return z

    return _plain(draw)


def garch(omega: float, alpha: float, beta: float, mu: float, df: float | None = None) -> Kernel:
    """Variances are held as shares of the variance of a draw. Where draws do not move them, as ``alpha``
    is nothing beside ``beta``, no recursion is run."""
    heavy = df is not None and 2 < df < 30
    first = omega / (1 - alpha - beta)
    if heavy:
        omega, alpha, first = (x * (df - 2) / df for x in (omega, alpha, first))

    def stays(z: np.ndarray, h: np.ndarray) -> bool:
        return alpha < NOTHING * beta and alpha * max(z.max(), -z.min()) ** 2 < NOTHING * beta and bool((np.abs(h - first) <= NOTHING * first).all())

    def draw(source: Source, state: dict, t: int, k: int) -> np.ndarray:
        z = source.student(0, t, k, df) if heavy else source.normal(0, t, k)
        if stays(z, state["h"]):
            z *= np.sqrt(first)
            z += mu
            return z
        h = z * z  # the next variance is omega + h * (alpha * z * z + beta)
        h *= alpha
        h += beta
        before, multiply, add = state["h"], np.multiply, np.add
        least = np.full(source.paths, omega)
        for row in list(h):
            multiply(row, before, row)
            add(row, least, row)
            before = row
        own = np.concatenate((state["h"][None], h[:-1]))
        state["h"] = before.copy()
        z *= np.sqrt(own, out=own)
        z += mu
        return z

    return Kernel(lambda source, n: {"h": np.full(source.paths, first)}, draw)


class Walk:
    """The state of some paths: all that their summary needs."""

    def __init__(self, paths: int, config: Config) -> None:
        self.config, self.steps = config, 0
        self.sum, self.factor = np.zeros(paths), np.ones(paths)
        self.balance = np.full(paths, float(config.capital))
        self.peak, self.fall, self.best = self.balance.copy(), np.zeros(paths), np.full(paths, -np.inf)
        self.ruined, self.outcome, self.event = np.zeros(paths, bool), np.zeros(paths, np.int8), np.full(paths, -1)
        self.losses, self.lost = np.zeros(paths), np.zeros(paths)
        if self.config.capital * (1 - config.ruin_percent / 100) >= config.capital:
            self.ruined[:] = True

    def balances(self, draws: np.ndarray) -> np.ndarray:
        """Balances after each of ``draws``, with the session rule and, for multiplicative
        results, a floor at nothing."""
        config, rule = self.config, self.config.session
        if rule:
            out = np.empty(draws.shape)
            last = self.balance
            for i, draw in enumerate(draws):
                if (self.steps + i) % max(1, rule.trades) == 0:
                    self.losses[:], self.lost[:] = 0, 0
                new = np.maximum(last * (1 + draw), 0) if config.multiplicative else last + draw
                new = np.where((self.losses >= rule.max_losses) | (self.lost <= -rule.max_loss), last, new)
                self.losses += new < last
                self.lost += new - last
                out[i] = last = new
            return out
        if config.multiplicative:
            out = np.maximum(1 + draws, 0)
            out[0] *= self.factor
            running(np.multiply, out)
            self.factor = out[-1].copy()
            out *= config.capital
        else:
            out = draws.copy()
            out[0] += self.sum
            running(np.add, out)
            self.sum = out[-1].copy()
            out += config.capital
        return out

    def go(self, draws: np.ndarray) -> None:
        """Takes in the draws of the next steps, and overwrites them."""
        config = self.config
        if not len(draws):
            return
        if config.session or config.multiplicative:
            return self.see(self.balances(draws))
        draws[0] += self.sum
        if draws.shape[1] >= NARROW and self._settled():  # the same sums, row after row
            self.sum = np.add.reduce(draws, axis=0)
            self.balance, self.steps = self.sum + config.capital, self.steps + len(draws)
            return
        running(np.add, draws)
        self.sum = draws[-1].copy()
        self._take(draws, float(config.capital))

    def see(self, balance: np.ndarray) -> None:
        """Takes in the balances of the next steps."""
        self._take(balance, 0.0)

    def _settled(self) -> bool:
        """Whether nothing but the balances can change any more: all ruined, fallen as deep as
        counts, and judged."""
        config = self.config
        return bool(config.capped and self.ruined.all() and (self.fall >= 1).all() and (not config.rules or self.outcome.all()))

    def _take(self, x: np.ndarray, base: float) -> None:
        """Takes in the balances ``x + base``. Only those paths are looked at step by step that
        have no event yet, or whose fall could be the deepest: none is deeper than from the
        highest peak to the lowest balance, as a share of the first peak."""
        config, low = self.config, x.min(0) + base
        high = np.maximum(self.peak, x.max(0) + base)
        with np.errstate(invalid="ignore"):
            closely = ~((high - low) / np.maximum(self.peak, 1e-8) <= self.fall)
        if config.capped:
            closely &= ~(self.fall >= 1)
        if config.rules:
            closely |= self.outcome == 0
        if (some := np.flatnonzero(closely)).size:
            self._look(x[:, some] + base if 2 * some.size < x.shape[1] else x + base, some if 2 * some.size < x.shape[1] else np.arange(x.shape[1]))
        self.ruined |= low <= config.capital * (1 - config.ruin_percent / 100)
        self.peak, self.balance, self.steps = high, x[-1] + base, self.steps + len(x)

    def _look(self, balance: np.ndarray, paths: np.ndarray) -> None:
        """Each step of some paths."""
        config = self.config
        peak = balance.copy()
        np.maximum(peak[0], self.peak[paths], out=peak[0])
        running(np.maximum, peak)
        under = peak - balance
        if config.rules and (alive := self.outcome[paths] == 0).any():
            self._judge(balance, under, paths, np.flatnonzero(alive))
        under /= np.maximum(peak, 1e-8, out=peak)
        self.fall[paths] = np.maximum(self.fall[paths], np.minimum(under.max(0), 1 if config.capped else np.inf))

    def _judge(self, balance: np.ndarray, under: np.ndarray, paths: np.ndarray, alive: np.ndarray) -> None:
        """The first event of each path without one: ``alive`` are the places of those in ``paths``."""
        drawdown, target, share = self.config.rules
        before = self.balance[paths]
        hit = ((under.max(0) >= drawdown) | (balance.max(0) - self.config.capital >= target))[alive]
        some, quiet = alive[hit], alive[~hit]
        if len(quiet):
            profit = np.maximum((balance[1:] - balance[:-1]).max(0, initial=-np.inf), balance[0] - before)
            self.best[paths[quiet]] = np.maximum(self.best[paths[quiet]], profit[quiet])
        if not len(some):
            return
        judged = paths[some]
        own, fell = balance[:, some], under[:, some] >= drawdown
        won = own - self.config.capital >= target
        at = (fell | won).argmax(0)
        column = np.arange(len(some))
        profit = np.diff(own, axis=0, prepend=before[None, some])
        np.maximum(profit[0], self.best[judged], out=profit[0])
        best = running(np.maximum, profit)[at, column]
        steady = best <= (own[at, column] - self.config.capital) * share / 100
        self.outcome[judged] = np.where(fell[at, column], 1, np.where(steady, 3, 2))
        self.event[judged] = self.steps + at + 1

    def frame(self, ids: np.ndarray) -> pd.DataFrame:
        """A row for each path; ``event_step`` (null without an event) counts from 1."""
        config, n = self.config, max(1, self.steps)
        final = self.balance
        ev = np.where(final > 0, np.maximum(final, 1e-300) / config.capital, 0) ** (1 / n) - 1 if config.multiplicative else (final - config.capital) / n
        return pd.DataFrame({
            "sim_id": ids, "final_balance": final, "max_drawdown": self.fall, "ruined": self.ruined, "ev": ev, "outcome": OUTCOMES[self.outcome],
            "steps": self.steps, "event_step": pd.Series(self.event).where(self.event > 0).astype("Int64"),
        })


def _random_bits(rng: np.random.Generator, n: int, bits: int) -> np.ndarray:
    """``n`` random numbers of so many bits, 16 at most."""
    out = rng.integers(0, 1 << 64, -(-n // 4), np.uint64).view(np.uint16)[:n]
    out >>= np.uint16(16 - bits)
    return out


def _sums(results: np.ndarray, part: np.ndarray, cells: int, shift: int) -> np.ndarray:
    """The sum of the ``results`` of each cell; the low bits of a ``part`` are its number in its cell."""
    sums, step = np.zeros(cells), max(CHUNK, 4 * cells)
    for t in range(0, len(results), step):
        sums += np.bincount(part[t : t + step] >> np.uint16(shift), results[t : t + step], cells)
    return sums


@dataclass
class _Bounds:
    """What the ``losses`` and ``gains`` of cells that follow one another say of a path: its balance
    and least peak as each begins, its least fall, whether it is surely ruined, how many cells hold
    its event, and which cells can change any of that."""

    losses: np.ndarray
    gains: np.ndarray
    config: Config

    def __post_init__(self) -> None:
        config, capital = self.config, float(self.config.capital)
        after = capital + np.cumsum(self.losses + self.gains)
        self.before = np.concatenate(([capital], after[:-1]))
        slack = 1e-9 * float(self.gains.sum() - self.losses.sum())  # more than sums can be off by
        low, high = self.before + self.losses - slack, self.before + self.gains + slack
        self.peak = np.maximum.accumulate(self.before)
        reached, top = np.maximum(self.peak, after), np.maximum.accumulate(high)
        most = 1.0 if config.capped else np.inf
        self.fall = min(most, max(0.0, float(((reached - after) / reached).max())))
        level = capital * (1 - config.ruin_percent / 100)
        self.ruined = bool(level >= capital or after.min() <= level)
        self.look = np.where(low > 0, 1 - low / top, most if config.capped else (top - low) / self.peak) > self.fall
        if not self.ruined:
            self.look |= low <= level
        if (closely := np.flatnonzero(self.look)).size:  # and the peak before one of these
            self.look |= high > np.append(self.peak[closely], np.inf)[np.searchsorted(closely, np.arange(len(low)), side="right")]
        self.judged, self.settled = 0, config.capped and self.fall >= 1 and self.ruined
        if config.rules:
            drawdown, target, _ = config.rules
            sure = (after - capital >= target + slack) | (reached - after >= drawdown + slack)
            self.judged = int(sure.argmax()) + 1 if sure.any() else len(low)
            self.look[: self.judged] = True
            self.settled &= bool(sure.any())


def _arranged(rng: np.random.Generator, sides: list[np.ndarray], config: Config) -> tuple[float, bool, int, int]:
    """Fall, ruin, outcome and event of a path that takes each of ``sides``, losses and gains, once.

    Each result falls into a random cell, cells follow one another, and the results of a cell stand
    in random order: all orders are equally likely. The losses and gains of a cell bound every
    balance in it. Cells that can hold the event, the ruin, the deepest fall or the peak before it are
    split, and the results of such parts are put in order; the order of the others changes nothing."""
    n = sum(map(len, sides))
    bits, whole = (min(16, max(0, (n // size).bit_length() - 1)) for size in (CELL, PART))
    shift = whole - bits
    pairs = [(x, _random_bits(rng, len(x), whole)) for x in sides]
    head, cells = [(x[at], c[at]) for x, c in pairs for at in [np.flatnonzero(c < 1 << whole >> HEAD)]], 1 << bits
    coarse = _Bounds(*(_sums(*pair, cells >> HEAD, shift) for pair in head), config)
    if coarse.settled:  # no cell after the first ones counts
        pairs = head
    else:
        coarse = _Bounds(*(_sums(*pair, cells, shift) for pair in pairs), config)
    if not coarse.look.any():
        return coarse.fall, coarse.ruined, 0, -1
    size = np.where(coarse.look, 1 << shift, 1)
    first = np.cumsum(size) - size
    x, part = zip(*(_of_cells(*pair, coarse.look, first, shift) for pair in pairs))
    fine = [np.bincount(p, y, size.sum()) for p, y in zip(part, x)]
    for y, z in zip(fine, (coarse.losses, coarse.gains)):
        y[first[~coarse.look]] = z[~coarse.look]
    bounds, split = _Bounds(*fine, config), np.repeat(coarse.look, size)
    look = bounds.look & split
    x, part = np.concatenate(x), np.concatenate(part)
    at = rng.permutation(np.flatnonzero(look[part]))
    at = at[np.argsort(part[at].astype(np.uint16), kind="stable")]
    x, part = x[at], part[at]
    fall, ruined, outcome, event = bounds.fall, bounds.ruined, 0, -1
    if bounds.judged:
        begun = Walk(1, config)
        begun.go(x[: np.searchsorted(part, bounds.judged), None].copy())
        outcome, event = int(begun.outcome[0]), int(begun.event[0])
    if len(x):
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        balance = np.cumsum(x)
        balance += np.repeat(bounds.before[part[begin]] - balance[begin] + x[begin], np.diff(begin, append=len(x)))
        peak = balance.copy()
        peak[begin] = np.maximum(peak[begin], bounds.peak[part[begin]])
        np.maximum.accumulate(peak, out=peak)
        fall = max(fall, float(((peak - balance) / peak).max()))
        ruined |= bool(balance.min() <= config.capital * (1 - config.ruin_percent / 100))
    return min(1.0, fall) if config.capped else fall, ruined, outcome, event


def _of_cells(results: np.ndarray, part: np.ndarray, look: np.ndarray, first: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The results of the cells to look at, with the number of their part: cells begin at ``first``."""
    at = np.flatnonzero(part <= ((int(np.flatnonzero(look)[-1]) + 1) << shift) - 1)
    own = part[at].astype(np.int64)
    use = look[own >> shift]
    at, own = at[use], own[use]
    return results[at], first[own >> shift] + (own & (1 << shift) - 1)


def arranged(once: Once, config: Config, rng: np.random.Generator, ids: np.ndarray) -> pd.DataFrame:
    """The paths ``ids`` that take each result of a long history once, reduced. All end with its sum."""
    out = Walk(len(ids), config)
    for i in range(len(ids)):
        out.fall[i], out.ruined[i], out.outcome[i], out.event[i] = _arranged(rng, once.sides, config)
    out.balance[:], out.steps = config.capital + once.total, config.steps
    return out.frame(ids)


def _in_cells(kernel: Kernel, config: Config) -> bool:
    """Whether paths can go by the cells of a permutation: they are as long as the history, which is
    long, and balances are sums."""
    if not kernel.once or config.counter or config.session or config.multiplicative or not config.capital > 0:
        return False
    return MANY <= config.steps == len(kernel.once.pool) and bool(np.isfinite(kernel.once.total))


def block_size(kernel: Kernel, n: int) -> int:
    """Paths that advance side by side: it follows from kernel and steps alone."""
    return max(1, min(PATHS_AT_ONCE, HELD // max(1, n))) if kernel.whole else PATHS_AT_ONCE


def blocks_of(paths: int, size: int) -> int:
    return -(-paths // size)


def source_of(config: Config, block: int, ids: np.ndarray) -> Source:
    """The draws of the paths ``ids`` of a block."""
    return Counters(config.seed, ids, config.steps) if config.counter else Generators(lambda s: np.random.Generator(np.random.SFC64([config.seed, s, block])), len(ids))


def walk(block: int, kernel: Kernel, config: Config, chunk: int = CHUNK) -> pd.DataFrame:
    """The paths of a block, ``config.steps`` long, reduced."""
    np.empty(3 << 20)  # once it is freed, glibc keeps the memory of smaller arrays, else it is new each time
    size, n = block_size(kernel, config.steps), config.steps
    ids = np.arange(block * size, min(config.paths, (block + 1) * size))
    source = source_of(config, block, ids)
    if _in_cells(kernel, config):
        return arranged(kernel.once, config, source.generator, ids)
    state, out = kernel.begin(source, n), Walk(len(ids), config)
    step = max(1, chunk // len(ids))
    for t in range(0, n, step):
        out.go(kernel.draw(source, state, t, min(step, n - t)))
    return out.frame(ids)


def paths_of(blocks: Iterator[int], kernel: Kernel, config: Config) -> Iterator[pd.DataFrame]:
    for block in blocks:
        yield walk(int(block), kernel, config)


__all__ = ["Config", "Kernel", "Session", "Walk", "bootstrap", "block_bootstrap", "garch", "parametric", "paths_of", "permutation", "regime_switching", "walk"]
