"""What must not grow with the number of steps, towers or files."""

import numpy as np
import pandas as pd

from spanwatt.config import Conductor
from spanwatt.operators import models, transient

WIRE = Conductor.named("ACSR Drake (795 kcmil)")


def test_weather_once_an_interval(monkeypatch):
    """What the weather alone decides is not computed again in each of the 180 steps of half an hour."""
    calls, cos = [], np.cos
    monkeypatch.setattr(np, "cos", lambda x: calls.append(1) or cos(x))
    weather = [np.array([v, v]) for v in (20.0, 3.0, 40.0, 900.0, 300.0)]
    got = transient.advance(WIRE, np.array([30.0, np.nan]), np.array([600.0, 600.0]), np.array([1800.0, 1795.0]), *weather)
    assert len(calls) <= 4 and np.isfinite(got[0]) and np.isnan(got[1])
    assert abs(transient.advance(WIRE, np.array([30.0]), np.array([600.0]), 1795.0, *[w[:1] for w in weather])[0] - got[0]) < 0.1


def test_packs_of_towers():
    """Hundreds of towers go side by side, but of long series only as many as a task holds."""
    rows = lambda towers, n: pd.DataFrame({"tower_id": np.repeat([f"{k:04}" for k in range(towers)], n)})
    assert [len(p) for p in transient._packs(iter([rows(600, 3)]))] == [512, 88]
    assert [len(p) for p in transient._packs(iter([rows(5, 40)]), 512, 100)] == [2, 2, 1]


def test_models_side_by_side(monkeypatch):
    """Keys of equally many rows are fitted in one go, and each model is what it is when fitted alone."""
    rng = np.random.default_rng(3)
    data = [(rng.uniform(-1, 1, (n, 13)).round(1), rng.normal(size=n).round(1)) for n in [1, 2, 9, 9, 30] + [40] * 50]
    calls, boosted = [], models._boosted
    monkeypatch.setattr(models, "_boosted", lambda x, y, base: calls.append(len(y)) or boosted(x, y, base))
    many = models.new_models(data)
    assert sum(calls) == len(data) - 1 and len(calls) <= 4  # one row is a constant
    for k in (1, 2, 4, 5, 54):
        alone = models.new_model(*data[k])
        assert np.array_equal(alone.predict(data[54][0]), many[k].predict(data[54][0])) and np.ptp(alone.predict(data[k][0])) > 0


def test_packs_of_keys(monkeypatch):
    """Keys stay whole across batches, many go together, and a long one alone."""
    monkeypatch.setattr(models, "PACK", 10)
    sizes = [3, 4, 25, 1, 2]
    rows = pd.DataFrame({"line_id": "l", "tower_id": np.repeat([f"{k}" for k in range(5)], sizes), "target": "wind_speed"})
    packs = list(models._packs(iter([rows.iloc[a : a + 6] for a in range(0, len(rows), 6)])))
    assert [s.stop - s.start for _, places in packs for s in places] == sizes and len(packs) < 5
    assert all(pdf["tower_id"].iloc[s].nunique() == 1 for pdf, places in packs for s in places)
