import numpy as np
import pytest

from thalweg.operators import kernels as K
from thalweg.operators import spill as P


def cells(spark, z):
    return spark.createDataFrame([(r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1]) if not np.isnan(z[r, c])], "r int, c int, z double")


def grid(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.r, r.c] = r.filled
    return out


def terrain(kind):
    rng = np.random.default_rng(7)
    z = rng.integers(0, 12, (23, 19)).astype(float) if kind == "coarse" else rng.random((23, 19)) * 10
    if kind == "lake":  # one depression over many tiles, another inside it, a flat shore
        z = np.full((23, 19), 9.0)
        z[3:20, 3:16] = 2.0
        z[8:12, 6:10] = 0.0
        z[0, 5], z[1, 5], z[2, 5] = 4.0, 5.0, 6.0
    if kind == "holes":
        z[5:8, 5] = z[15, 9:12] = np.nan
    return z


@pytest.mark.parametrize("kind", ["lake", "holes"])
def test_levels_equal_the_tile_rounds(spark, kind):
    z = terrain(kind)
    got = grid(P.fill_by_passes(cells(spark, z), 19, tile=6), z.shape)
    want = K.flooded(z, 0.0, 1.0).astype(float)
    assert np.allclose(got, want, equal_nan=True, atol=1e-6)


@pytest.mark.parametrize("kind", ["lake", "coarse"])
def test_a_gradient_leaves_no_flat_and_no_pit(spark, kind):
    z = terrain(kind)
    slope = 1e-3
    got = grid(P.fill_by_passes(cells(spark, z), 19, slope, 1.0, tile=6), z.shape)
    level = K.flooded(z, 0.0, 1.0).astype(float)
    wide = np.pad(got, 1, constant_values=np.nan)
    near = np.stack([wide[1 + dr:wide.shape[0] - 1 + dr, 1 + dc:wide.shape[1] - 1 + dc] for dr, dc, _ in P.STEPS])
    open_ = np.isnan(near).any(axis=0)
    lower = (near < got).any(axis=0)
    there = ~np.isnan(z)
    assert (lower | open_)[there].all() and (got >= level - 1e-6)[there].all() and (got <= level + slope * z.size)[there].all()
    assert np.allclose(got[open_ & there], z[open_ & there])


def test_rounds_grow_with_the_logarithm_of_the_pits(spark, monkeypatch):
    rounds = [0]
    inner = P.walk

    def counted(*args):
        rounds[0] += 1
        return inner(*args)

    monkeypatch.setattr(P, "walk", counted)
    z = np.full((3, 66), 50.0)
    z[1, 1:-1] = np.where(np.arange(64) % 2, 20 - np.arange(64) / 10, 30 + np.random.default_rng(2).random(64))
    z[1, -1] = 1.0
    got = grid(P.fill_by_passes(cells(spark, z), 66, tile=4), z.shape)
    assert np.allclose(got, K.flooded(z, 0.0, 1.0)) and rounds[0] <= 6
