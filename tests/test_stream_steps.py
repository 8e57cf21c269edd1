"""A bar of the running indicators is stepped in plain floats: arrays of a dozen numbers cost more than the numbers."""

from __future__ import annotations

import math

from tickerloom.streaming import indicators as running


class _NoArrays:
    def __getattr__(self, name):
        raise AssertionError(f"numpy.{name} in a bar's step")


def test_a_bar_needs_no_arrays(monkeypatch):
    monkeypatch.setattr(running, "np", _NoArrays())
    s, nan = running._Symbol(None), float("nan")
    closes = [100 + 9 * math.sin(i / 3) for i in range(60)]
    for i, c in enumerate(closes):
        last = s.bar(c + 1, nan if i == 20 else c - 1, nan if i in (0, 31, 32) else c)
    assert all(x == x for x in last[:10]) and last[10] in (True, False) and last[11] in (True, False)
    # the EMA over nine bars, with weights that decay over missing closes
    avg, weight = None, 1.0
    for i, c in enumerate(closes):
        if i in (0, 31, 32):
            weight *= 0.8 if avg is not None else 1.0
        else:
            avg, weight = c if avg is None else (weight * 0.8 * avg + 0.2 * c) / (weight * 0.8 + 0.2), 1.0
    assert math.isclose(last[5], avg, rel_tol=1e-12)
    assert running._Symbol(s.kept()).kept() == s.kept()
