import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import incision as I
from thalweg.operators import kernels as K


def cells(spark, z, **more):
    rows = [(r, c, float(z[r, c]), *(float(m[r, c]) for m in more.values())) for r in range(z.shape[0]) for c in range(z.shape[1]) if not np.isnan(z[r, c])]
    return spark.createDataFrame(rows, "r int, c int, z double" + "".join(f", {x} double" for x in more))


def forest(rng, rows, cols):
    """Random receivers to neighbours that lie nearer to the south edge, heights that climb in places."""
    z = rng.random((rows, cols)) * 3 + np.linspace(rows / 4, 0, rows)[:, None]
    recv = np.arange(rows * cols).reshape(rows, cols)
    for r in range(rows - 1):
        for c in range(cols):
            to = [(r + 1, x) for x in (c - 1, c, c + 1) if 0 <= x < cols]
            recv[r, c] = np.ravel_multi_index(to[rng.integers(len(to))], z.shape)
    return z, recv


def plain(z, recv, e, n):
    new = z.copy().ravel()
    for i in reversed(range(len(new))):
        if recv.ravel()[i] != i:
            base = new[recv.ravel()[i]]
            new[i] = base + K.lowered(np.maximum(0.0, np.array([new[i] - base])), np.array([e.ravel()[i]]), n)[0]
    return new


@pytest.mark.parametrize("n, tile", [(1.0, 4), (1.5, 8)])
def test_a_step_over_a_forest_equals_a_walk_up(spark, n, tile):
    rng = np.random.default_rng(4)
    z, recv = forest(rng, 26, 14)
    e = rng.random(z.shape) * 5
    rows = [(int(i), int(i // 14), int(i % 14), float(z.ravel()[i]), int(recv.ravel()[i]), float(e.ravel()[i])) for i in range(z.size)]
    t = spark.createDataFrame(rows, "node long, r int, c int, z double, recv long, erosion double")
    got = {r.node: r.z for r in I.incise(t, 14, n, tile).collect()}
    want = plain(z, recv, e, n)
    assert len(got) == z.size and np.allclose([got[i] for i in range(z.size)], want, atol=1e-9)


def test_rounds_grow_with_the_logarithm_of_the_tiles(spark, monkeypatch):
    rounds = []
    inner = I.fixpoint

    def counted(df, step, open_rows):
        k = [0]

        def one(cur):
            k[0] += 1
            return step(cur)

        out = inner(df, one, open_rows)
        rounds.append(k[0])
        return out

    monkeypatch.setattr(I, "fixpoint", counted)
    size = 128
    rows = [(i, i, 0, float(size - i), min(i + 1, size - 1), 0.5) for i in range(size)]
    t = spark.createDataFrame(rows, "node long, r int, c int, z double, recv long, erosion double")
    got = [r.z for r in I.incise(t, 1, 1.0, 4).orderBy("node").collect()]
    want = plain(np.arange(size, 0, -1.0)[:, None], np.minimum(np.arange(size) + 1, size - 1), np.full(size, 0.5), 1.0)
    assert np.allclose(got, want) and max(rounds) <= 6  # 32 tiles in a row


def test_functions_compose():
    rng = np.random.default_rng(2)
    for _ in range(200):
        steps = [(rng.random() * 4, rng.random() * 3) for _ in range(6)]
        f = I.Pieces(0.0, 5.0, [], [0.0], [1.0])
        for z, e in steps:
            f = f.under(I.step_of(z, e, np.inf))
        for x in np.linspace(0, 5, 41):
            y = x
            for z, e in steps:
                y = max(y, (z + e * y) / (1 + e))
            assert abs(f.at(x) - y) < 1e-9
        assert len(f.a) <= 7 and all(p <= q for p, q in zip(f.cuts, f.cuts[1:]))


def test_many_tiles_evolve_as_one_raster(spark):
    n = 1.0
    rng = np.random.default_rng(1)
    z = rng.random((20, 17))
    z[[0, -1], :] = z[:, [0, -1]] = 0
    rates = 1e-4 * (1 + rng.random(z.shape))
    it = K.evolution(z, rates, n=n, cellsize=10.0, fixed=K.edges_of(z))
    for _ in range(2):
        want = next(it)
    got = I.evolve_tiled(cells(spark, z, k=rates), 2, 17, n=n, cellsize=10.0, tile=8)
    grid = np.full(z.shape, np.nan)
    for r in got.collect():
        grid[r.r, r.c] = r.z
    assert np.allclose(grid, want, atol=1e-6)


def test_masks_missing_cells_and_no_steps(spark):
    z = np.add.outer(np.arange(9.0), np.arange(9.0) * 0.1)
    z[4, 4] = np.nan
    fixed = np.zeros_like(z)
    fixed[0] = 1
    t = cells(spark, z, fixed=fixed).withColumn("fixed", F.col("fixed") > 0)
    it = K.evolution(z, 1e-3, uplift=1e-2, fixed=fixed)
    want = next(it)
    got = {(r.r, r.c): r.z for r in I.evolve_tiled(t, 1, 9, k=1e-3, uplift=1e-2, boundary="mask", tile=4).collect()}
    assert len(got) == 80 and all(abs(got[r, c] - want[r, c]) < 1e-6 for r, c in got)
    assert I.evolve_tiled(t, 0, 9, boundary=None).exceptAll(t.select("r", "c", "z")).count() == 0
    with pytest.raises(ValueError):
        I.evolve_tiled(t.drop("fixed"), 1, 9, boundary="mask")
