"""Histograms against numpy."""

import numpy as np
import pytest

from tidewake.operators.histograms import histogram, ticked_histogram

CASES = {
    "even": np.arange(60, 5000, 7), "lopsided": np.round(np.exp(np.linspace(4.1, 13, 700))), "two": [100, 200], "one": [500], "flat": [777] * 9,
    "outside": [1, 5, 59, 60, 61, 90, 10_000_000, 2_592_000, 3600], "ties": [60] * 5 + [70] * 50 + [1000] * 3, "small": [60, 61, 61, 62, 62, 62, 63],
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(g, int(x)) for g, xs in CASES.items() for x in xs] + [("even", None)], "g string, sample long")


def of(df, g):
    found = sorted((r for r in df if r.g == g), key=lambda r: r.idx)
    return [r.low for r in found] + [found[-1].high], [r.frequency for r in found], (found[0].q25, found[0].q75) if hasattr(found[0], "q25") else None


@pytest.mark.parametrize("log", [False, True])
def test_automatic_bins(rows, log):
    got = histogram(rows, ["g"], log=log).collect()
    for g, xs in CASES.items():
        x = np.clip(np.array(xs, np.int64), 60, 2592000)
        y = np.log(x) if log else x
        edges = max((np.histogram_bin_edges(y, bins=b) for b in ("fd", "doane")), key=len)
        frequency, edges = np.histogram(y, edges)
        low, n, iq = of(got, g)
        assert n == frequency.tolist(), g
        assert np.allclose(low, np.exp(edges) if log else edges)
        assert np.allclose(iq, np.quantile(x, [0.25, 0.75]))


def test_given_bins_and_ticks(rows):
    got = histogram(rows, ["g"], durations=False, bins=4).collect()
    ticked = ticked_histogram(rows, ["g"], [60, 100, 1000], durations=False).collect()
    for g, xs in CASES.items():
        frequency, edges = np.histogram(np.array(xs, float), 4)
        low, n, _ = of(got, g)
        assert n == frequency.tolist() and np.allclose(low, edges)
        x, ticks = np.array(xs, float), [60.0, 100.0, 1000.0]
        bars = [x.min()] * int(x.min() < 60) + ticks + [x.max()] * int(x.max() > 1000)
        low, n, _ = of(ticked, g)
        assert n == np.histogram(x, bars)[0].tolist() and low == bars


def test_a_log_scale_needs_positive_samples(spark):
    with pytest.raises(Exception, match="samples over 0"):
        histogram(spark.createDataFrame([("a", 0), ("a", 5)], "g string, sample long"), ["g"], durations=False, log=True).collect()
    assert histogram(spark.createDataFrame([], "g string, sample long"), ["g"]).count() == 0
