import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.test_reference import square
from zonaria import session
from zonaria.functions import geometry as G
from zonaria.operators import graph, score


def test_candidates_of_any_size(spark):
    """Boxes from a point to a continent: exactly the pairs that meet, once."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        x, y, w = *rng.uniform(-100, -99, 2), 2.0 ** rng.integers(-12, 1)
        rows.append((f"z{k:03d}", float(x), float(x + w), float(y), float(y + w / 2)))
    rows += [("huge", -120.0, -80.0, -120.0, -80.0), ("dot", -99.5, -99.5, -99.5, -99.5), ("dot2", -99.5, -99.5, -99.5, -99.5), ("far", 10.0, 11.0, 10.0, 11.0)]
    got = [tuple(r) for r in graph.candidates(spark.createDataFrame(rows, "id string, xmin double, xmax double, ymin double, ymax double")).collect()]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_small_zones_are_compared_in_small_cells(spark):
    """One huge zone doesn't bring the small ones of a city into one cell."""
    rows = [(f"s{k}", k * 0.01, k * 0.01 + 0.009, 0.0, 0.009) for k in range(400)]
    df = spark.createDataFrame([*rows, ("huge", -50.0, 50.0, -50.0, 50.0)], "id string, xmin double, xmax double, ymin double, ymax double")
    assert graph.candidates(df).count() == 400
    assert graph.candidates(df.limit(0)).count() == 0


def shape(cells, scale=1.0, shift=0.0):
    """Oriented integer edges of squares of a grid, as a region of several polygons."""
    geo = [square(i, j, side=0.01 * scale, x0=-99 + shift, y0=19 + shift)[0] for i, j in cells]
    return graph._oriented(geo)


@pytest.mark.parametrize(
    "a, b, want",
    [
        ([(0, 0)], [(1, 0)], (True, True)), ([(0, 0)], [(1, 1)], (True, False)), ([(0, 0)], [(2, 0)], (False, False)), ([(0, 0)], [(0, 0)], (False, False)),
        ([(0, 0), (2, 0)], [(1, 0)], (True, True)), ([(0, 0), (5, 5)], [(5, 5), (9, 9)], (False, False)),
    ],
)
@pytest.mark.parametrize("shift", [0.0, 0.123456789012])
def test_relate_exactly(a, b, want, shift):
    """The same verdicts on micro-degrees, which fit 64 bits, and on long decimals, which don't."""
    e, f = shape(a, shift=shift), shape(b, shift=shift)
    both = graph._exact(e + f)
    touches, common = graph.relate(both[: len(e)], both[len(e) :])
    assert (touches, common > 0) == want
    assert graph.relate([], both) == (False, 0.0)


def test_relate_overlaps():
    big, small = shape([(0, 0)], scale=9), shape([(3, 3)])
    both = graph._exact(big + small)
    assert graph.relate(both[: len(big)], both[len(big) :]) == (False, 0.0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=3, max_size=9, unique=True))
def test_rings_that_cross_themselves(points):
    ring = np.array(points, dtype=float)
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    e = list(zip(points, points[1:] + points[:1], strict=True))
    want = any(side(*a, b[0]) * side(*a, b[1]) < 0 and side(*b, a[0]) * side(*b, a[1]) < 0 for k, a in enumerate(e) for b in e[k + 1 :])
    assert G._crosses_itself(ring) == want == G._crosses_itself(ring, cells=3)


def test_a_long_ring_is_checked_in_little_memory():
    t = np.linspace(0, 2 * np.pi, 50_000, endpoint=False)
    ring = np.stack([np.cos(t) * (1 + 0.01 * np.sin(40 * t)), np.sin(t) * (1 + 0.01 * np.sin(40 * t))], axis=1)
    start = time.perf_counter()
    assert not G._crosses_itself(ring)
    ring[[10, 11]] = ring[[11, 10]]
    assert G._crosses_itself(ring) and time.perf_counter() - start < 20


def test_quantiles_by_places(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=1001)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    points = [0, 0.1, 0.333, 0.5, 0.99, 1]
    assert score.quantiles(df, "v", points) == pytest.approx(np.quantile(x, points))
    assert score.quantiles(df.limit(0), "v", points) == [] and score.percentiles(df.limit(0), "v").count() == 0
    assert "percentile" not in score.percentiles(df, "v")._jdf.queryExecution().toString()


def test_separate_executors_need_a_shared_folder(spark, monkeypatch):
    class Fake:
        applicationId, master = "none-such", "local-cluster[2,1,1024]"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Fake()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_written_tables_go_with_their_block(spark):
    import os

    before = set(os.listdir(session.shared_dir(spark)))
    with session.scratch(spark):
        d = session.materialise(spark.range(5))
        assert d.count() == 5 and len(set(os.listdir(session.shared_dir(spark))) - before) == 1
        with session.scratch(spark):
            session.materialise(spark.range(3))
        assert d.count() == 5
    assert set(os.listdir(session.shared_dir(spark))) == before
