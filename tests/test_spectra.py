"""Spectra over shards equal those of the joined signal."""

import numpy as np
import pytest

from chronoloom.operators import spectra


def plain(y, width, hop):
    y = np.pad(y, (0, max(0, width - len(y))))
    frames = np.array([y[a : a + width] for a in range(0, len(y) - width + 1, hop)])
    return np.abs(np.fft.rfft(frames * np.hanning(width), axis=1))


def signals():
    r = np.random.default_rng(5)
    gap = r.normal(size=900)
    gap[200:700] = 0.0  # whole shards of silence, of which no row is there
    return {"long": r.normal(size=1000), "short": r.normal(size=9), None: r.normal(size=333), "gap": gap}


@pytest.mark.parametrize("width,hop,shard", [(64, 32, 4), (64, 16, 3), (32, 32, 5), (64, 8, 1)])
def test_shards_equal_the_whole(spark, width, hop, shard):
    held = signals()
    rows = [(k, i, float(v)) for k, y in held.items() for i, v in enumerate(y) if v != 0.0] + [("long", -3, 9.0), ("short", 9, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {(x.k, x.frame): np.array(x.magnitude) for x in spectra.long_spectrum(df, ["k"], "v", width, hop, shard).collect()}
    ups = {(x.k, x.frame): x.flux for x in spectra.flux(df, ["k"], "v", width, hop, shard).collect()}
    onset = {(x.k, x.i): x.onset for x in spectra.onsets(df, ["k"], "v", width, hop, shard).collect()}
    n = 0
    for k, y in held.items():
        want = plain(np.append(y, 0.0) if k == "short" else y, width, hop)
        up = np.concatenate([[0.0], np.maximum(np.diff(want, axis=0), 0).sum(axis=1)])
        smooth = np.convolve(up / up.max() if up.max() > 0 else up, [0.25, 0.5, 0.25], "same") if len(up) > 2 else None
        for f, m in enumerate(want):
            assert np.allclose(got[k, f], m, atol=1e-9) and abs(ups[k, f] - up[f]) < 1e-9
            assert smooth is None or abs(onset[k, f] - smooth[f]) < 2e-6
        n += len(want)
    assert n == len(got) == len(ups) == len(onset)
