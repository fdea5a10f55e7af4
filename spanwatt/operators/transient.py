"""Conductor temperature in time: numpy over many rows or towers at once, inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwatt.config import SAFETY_FACTOR, Conductor

# Fixed values of the search.
STEP_S, MAX_STEPS, HOTTEST_C, RESIDUAL_W_M = 10.0, 1_000_000, 1004.0, 1e-6


def losses(c: Conductor, air: np.ndarray, wind: np.ndarray, angle: np.ndarray, elevation: np.ndarray, solar: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The loss in one weather as a function of the temperature; what the weather alone decides is computed once."""
    thick, flow = 1.293 - 1.525e-4 * elevation + 6.379e-9 * elevation**2, c.diameter * wind
    phi = np.mod(angle, 180.0)
    phi = np.radians(np.minimum(phi, 180 - phi))
    turn = np.where(wind == 0, 0.0, 1.194 - np.cos(phi) + 0.194 * np.cos(2 * phi) + 0.368 * np.sin(2 * phi))
    shine, calm = 17.8 * c.diameter * c.emissivity, 3.645 * c.diameter**0.75
    gain = shine * ((air + 273) / 100) ** 4 + c.absorptivity * solar * c.diameter

    def loss(t: np.ndarray) -> np.ndarray:
        film, gap = (t + air) / 2, t - air
        rho, warm = thick / (1 + 0.00367 * film), film + 273.15
        mu, k = 1.458e-6 * warm * np.sqrt(warm) / (film + 383.4), 2.424e-2 + (7.477e-5 - 4.407e-9 * film) * film
        re, hot = flow * rho / mu, (t + 273) / 100
        hot = hot * hot
        forced = turn * k * np.maximum(1.01 + 1.35 * re**0.52, 0.754 * re**0.6)
        return gap * np.maximum(calm * np.sqrt(rho) * np.sqrt(np.sqrt(np.abs(gap))), forced) + shine * (hot * hot) - gain

    return loss


def net_loss(c: Conductor, t: np.ndarray, air: np.ndarray, wind: np.ndarray, angle: np.ndarray, elevation: np.ndarray, solar: np.ndarray) -> np.ndarray:
    """W/m lost by convection and radiation less the solar gain; negative where heat flows in."""
    return losses(c, air, wind, angle, elevation, solar)(t)


def ohms(c: Conductor, t: np.ndarray) -> np.ndarray:
    low, high = (c.r75 - c.r25) / 50, (c.r200 - c.r25) / 175
    slope = np.where(t <= 100, low, high) if np.any(t > 100) else low
    return c.r25 + slope * (t - 25)


def steady(c: Conductor, current: np.ndarray, air: np.ndarray, *weather: np.ndarray) -> np.ndarray:
    """The temperature at which the loss equals the heat of the current; nan where none is
    found up to the hottest."""
    loss = losses(c, np.asarray(air, float), *weather)
    excess = lambda t: loss(t) - current**2 * ohms(c, t)
    low, high = np.array(air, float), np.maximum(200.0, air + 1)
    short = excess(high) < 0
    high = np.where(short, HOTTEST_C, high)
    lost = excess(high) < 0
    for _ in range(80):
        mid = (low + high) / 2
        below = excess(mid) < 0
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    mid = (low + high) / 2
    return np.where(lost | (np.abs(excess(mid)) > np.maximum(RESIDUAL_W_M, 1e-9 * current**2)), np.nan, mid)


def advance(c: Conductor, t: np.ndarray, current: np.ndarray, seconds: np.ndarray | float, *weather: np.ndarray) -> np.ndarray:
    """Temperature after ``seconds`` (of each row) at a constant current and weather: Euler
    steps of at most ten seconds.  Not finite or below absolute zero: nan."""
    return _advance(c, t, current, seconds, losses(c, *weather))


def _advance(c: Conductor, t: np.ndarray, current: np.ndarray, seconds: np.ndarray | float, loss: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    left, heat, capacity = np.array(np.broadcast_to(seconds, np.shape(t)), float), current**2, c.heat_capacity
    if left.max(initial=0) > STEP_S * MAX_STEPS:
        return np.full_like(t, np.nan)

    def step(t: np.ndarray, dt: np.ndarray | float) -> np.ndarray:
        t = t + dt * ((heat * ohms(c, t) - loss(t)) / capacity)
        lost = (t <= -273.15) | (t == np.inf)
        return np.where(lost, np.nan, t) if lost.any() else t

    whole = int(max(left.min(initial=left.max(initial=0)), 0) // STEP_S)  # steps that are whole in all rows
    for _ in range(whole):
        t = step(t, STEP_S)
    left = left - whole * STEP_S
    while (left > 0).any():
        dt = np.minimum(STEP_S, left)
        t, left = step(t, dt), left - dt
    return t


def time_to_limit(c: Conductor, t: np.ndarray, current: np.ndarray, limit: float, *weather: np.ndarray) -> np.ndarray:
    """Seconds until the limit, the safe side to within a step's 1e-6; 0 if reached already,
    infinite if the steady temperature stays below.

    Rows move in common steps of ten seconds; the last step of each row is cut by bisection.
    """
    out = np.where(t >= limit, 0.0, np.inf)
    end = steady(c, current, *weather)
    live = (t < limit) & ~(end <= limit)
    now, at = np.array(t, float), 0.0
    loss = losses(c, *(np.asarray(w, float) for w in weather))
    for _ in range(MAX_STEPS):
        if not live.any():
            break
        rate = (current**2 * ohms(c, now) - loss(now)) / c.heat_capacity
        after = now + STEP_S * rate
        hit = live & ~(after < limit)
        out = np.where(hit, at + np.floor((limit - now) / np.where(rate == 0, 1, rate) * 1e6) / 1e6, out)
        stuck = live & ~hit & (rate < 1e-9)
        live &= ~hit & ~stuck
        now, at = np.where(live, after, now), at + STEP_S
    return out


def window_rating(c: Conductor, seconds: np.ndarray, weather: list[np.ndarray], start: float, end: float, base: np.ndarray) -> np.ndarray:
    """For every tower the largest constant current that keeps the limit in [start, end].

    weather: arrays towers x times; the weather of an interval is that of its left edge.  The
    conductor is at the steady temperature of ``base`` at first and carries ``base`` before the
    window.  nan: not even no current is feasible; 0: the window doesn't meet the axis.
    """
    if end <= seconds[0] or start >= seconds[-1]:
        return np.zeros(len(base))
    t = steady(c, base, *[w[:, 0] for w in weather])
    t = np.where(np.isfinite(t), t, weather[0][:, 0])
    spans = [(max(a, start), min(b, end), k) for k, (a, b) in enumerate(zip(seconds[:-1], seconds[1:], strict=True)) if min(b, end) > max(a, start)]
    for k, (a, b) in enumerate(zip(seconds[:-1], seconds[1:], strict=True)):
        if min(b, start) > a:
            t = advance(c, t, base, min(b, start) - a, *[w[:, k] for w in weather])

    steps = [(a, b, losses(c, *[w[:, k] for w in weather])) for a, b, k in spans]

    def keeps(current: np.ndarray) -> np.ndarray:
        now, ok = t, t <= c.max_temp
        for a, b, loss in steps:
            for _ in range(int(np.ceil((b - a) / STEP_S))):
                dt = min(STEP_S, b - a)
                now = _advance(c, now, current, dt, loss)
                ok &= now <= c.max_temp
                a += dt
        return ok

    low, high = np.zeros(len(base)), np.maximum(base, 1.0)
    fits = keeps(low)
    for _ in range(40):
        more = keeps(high)
        if not more.any():
            break
        low, high = np.where(more, high, low), np.where(more, high * 2, high)
    for _ in range(15):
        mid = (low + high) / 2
        ok = keeps(mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid)
    return np.where(fits, low, np.nan)


WEATHER = ("ambient_temp_local", "wind_speed_local", "wind_angle_deg", "rated_elevation", "solar_radiation_local")


def with_steady_temperature(df: DataFrame, c: Conductor, current: str, solver: Callable = steady) -> DataFrame:
    """Adds conductor_temp_c of the current in column ``current``, null where there is none.
    solver: a function like ``steady``."""
    cols = [current, *WEATHER]

    @F.pandas_udf("double")
    def solve(*series: pd.Series) -> pd.Series:
        return pd.Series(solver(c, *[s.to_numpy(float) for s in series]))

    made = solve(*[F.col(x) for x in cols])
    return df.withColumn("conductor_temp_c", F.when(~F.isnan(made), made))


def with_time_to_limit(df: DataFrame, c: Conductor, start: str, current: str, limit: float | None = None) -> DataFrame:
    """Adds seconds_to_limit (infinite if never)."""
    limit = c.max_temp if limit is None else limit

    @F.pandas_udf("double")
    def solve(*series: pd.Series) -> pd.Series:
        t, amps, *weather = (s.to_numpy(float) for s in series)
        return pd.Series(time_to_limit(c, t, amps, limit, *weather))

    return df.withColumn("seconds_to_limit", solve(F.col(start), F.col(current), *[F.col(x) for x in WEATHER]))


def _towers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole towers out of rows sorted by tower."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch])
        cut = (held["tower_id"] == held["tower_id"].iloc[-1]).to_numpy().argmax()
        for _, one in held.iloc[:cut].groupby("tower_id", sort=False):
            yield one
        held = held.iloc[cut:]
    if held is not None:
        for _, one in held.groupby("tower_id", sort=False):
            yield one


def _seconds(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


def _packs(batches: Iterator[pd.DataFrame], most: int = 512, rows: int = 400_000) -> Iterator[list[pd.DataFrame]]:
    """Whole towers, several at a time, so that numpy has a row for each; at most ``rows`` with a tower's length times their number."""
    held: list[pd.DataFrame] = []
    longest = 0
    for one in _towers(batches):
        longest = max(longest, len(one))
        if held and (len(held) + 1) * longest > rows:
            yield held
            held, longest = [], len(one)
        held.append(one)
        if len(held) == most:
            yield held
            held, longest = [], 0
    if held:
        yield held


def _padded(towers: list[pd.DataFrame], column: str | None, values: list[np.ndarray] | None = None) -> np.ndarray:
    """Towers by times; a short series holds its last value."""
    rows = values or [t[column].to_numpy(float) for t in towers]
    return np.stack([np.pad(r, (0, max(map(len, rows)) - len(r)), mode="edge") for r in rows])


def profile(df: DataFrame, c: Conductor, current: str) -> DataFrame:
    """Temperature along each tower's series: the weather and current of an interval are those of
    its left edge; it begins at the steady temperature.  Every temperature needs the one
    before, so whole towers stream through tasks, several side by side."""
    cols = ["tower_id", "timestamp", current, *WEATHER]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for towers in _packs(batches):
            amps, *weather = (_padded(towers, x) for x in [current, *WEATHER])
            steps = np.diff(_padded(towers, None, [_seconds(t["timestamp"]) for t in towers]), axis=1)
            out = [steady(c, amps[:, 0], *[w[:, 0] for w in weather])]
            for k in range(steps.shape[1]):
                out.append(advance(c, out[-1], amps[:, k], steps[:, k], *[w[:, k] for w in weather]))
            made = np.stack(out, 1)
            for row, one in zip(made, towers, strict=True):
                yield pd.DataFrame({"tower_id": one["tower_id"].to_numpy(), "timestamp": one["timestamp"].to_numpy(), "conductor_temp_c": row[: len(one)]})

    rows = df.select(cols).repartition("tower_id").sortWithinPartitions("tower_id", "timestamp")
    return rows.mapInPandas(run, "tower_id string, timestamp timestamp_ntz, conductor_temp_c double").withColumn("conductor_temp_c", F.nanvl("conductor_temp_c", F.lit(None)))


def window_ratings(rated: DataFrame, c: Conductor, start_h: float, end_h: float) -> DataFrame:
    """Per tower the published window rating and why it is the steady one, if it is.

    rated: rows at equal steps with WEATHER and raw_rating_a; base is the tower's smallest
    steady rating.  On a failure the steady rating is published, with its one safety factor.
    """
    cols = ["tower_id", "timestamp", "raw_rating_a", *WEATHER]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for towers in _packs(batches):
            base = np.array([t["raw_rating_a"].min() for t in towers])
            at = [_seconds(t["timestamp"]) - _seconds(t["timestamp"].iloc[:1])[0] for t in towers]
            # only what leads up to the end of the window is needed
            need = [t[(s <= end_h * 3600) | (np.arange(len(s)) < 2)] for t, s in zip(towers, at, strict=True)]
            even = [len(s) >= 2 and len(set(np.diff(s[: len(n)]))) <= 1 for s, n in zip(at, need, strict=True)]
            value, reason = base.copy(), np.where(even, None, "transient_failed:ValueError")
            for axis in {tuple(s[: len(n)]) for s, n, e in zip(at, need, even, strict=True) if e}:
                who = [k for k, (s, n) in enumerate(zip(at, need, strict=True)) if even[k] and tuple(s[: len(n)]) == axis]
                weather = [_padded([need[k] for k in who], x) for x in WEATHER]
                found = window_rating(c, np.array(axis), weather, start_h * 3600, end_h * 3600, base[who])
                for k, v in zip(who, found, strict=True):
                    value[k], reason[k] = (v, None) if np.isfinite(v) else (base[k], "transient_failed:Infeasible")
            yield pd.DataFrame({"tower_id": [t["tower_id"].iloc[0] for t in towers], "steady_rating_a": base * SAFETY_FACTOR, "window_rating_a": value * SAFETY_FACTOR, "fallback_reason": reason})

    rows = rated.select(cols).repartition("tower_id").sortWithinPartitions("tower_id", "timestamp")
    return rows.mapInPandas(run, "tower_id string, steady_rating_a double, window_rating_a double, fallback_reason string")
