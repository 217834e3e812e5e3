import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loamline.config import DAY, CouplingConfig
from loamline.functions import paths
from loamline.operators import coupling
from pyspark.sql import functions as F

BASE = 50 * 365 * DAY


def frame(spark, rows):
    return spark.createDataFrame([(f.split("/"), t) for f, t in set(rows)], "file array<string>, t long")


def result(df):
    return {("/".join(r.file), r.bucket_start): (r.activity_bursts, {"/".join(c.file): c["count"] for c in r.coupled_files}) for r in df.collect()}


def brute(rows, c):
    """The same by comparing every burst with every change."""
    times = defaultdict(set)
    for f, t in rows:
        times[f].add(t)
    if not times:
        return {}
    every = [t for x in times.values() for t in x]
    size, latest = c.bucket_days * DAY, max(every)
    count = (latest - min(every)) // size + 1
    first = latest - size * count + 1
    bursts, together = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for f, ts in times.items():
        runs = []
        for t in sorted(ts):
            if runs and t - runs[-1][1] <= c.gap:
                runs[-1][1] = t
            else:
                runs.append([t, t])
        for s, e in runs:
            key = (f, first + (s - first) // size * size)
            bursts[key] += 1
            for o, other in times.items():
                if o != f and any(s - c.overlap <= t < e + c.overlap for t in other):
                    together[key][o] += 1
    out = {}
    for key, n in bursts.items():
        if n >= c.min_bursts:
            a = key[0].split("/")
            kept = {}
            for o, k in together[key].items():
                b = o.split("/")
                common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                near = common > 0 and max(len(a), len(b)) - common < c.min_distance
                if k / n >= c.min_ratio and not near and not (c.max_common_roots is not None and common > c.max_common_roots):
                    kept[o] = k
            out[key] = (n, kept)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from([0, 1, 900, 3600]), st.sampled_from([0, 1, 600, 3600]), st.sampled_from([None, 1, 2]))
def test_coupling_equals_brute_force(spark, seed, gap, overlap, roots):
    rng = random.Random(seed)
    files = ["a/b/c", "a/b/d", "a/x", "e/f/g", "e/f/h", "z"]
    rows = [(rng.choice(files), BASE + rng.choice([0, 1, 600, 899, 900, 901, 3599, 3600, 3601]) * rng.randint(0, 60)) for _ in range(rng.randint(1, 60))]
    config = CouplingConfig(1, rng.randint(1, 3), rng.choice([0.1, 0.5, 1.0]), gap, overlap, rng.randint(1, 3), roots)
    assert result(coupling.coupling(frame(spark, rows), config)) == brute(rows, config)


def test_bursts_by_gap(spark):
    seconds = [0, 50, 100, 1000, 1059, 2000, 3000, 3001]
    found = coupling.bursts(spark.createDataFrame([("f", BASE + s) for s in seconds], "file string, t long"), 59).orderBy("burst").collect()
    assert [r.events for r in found] == [3, 2, 1, 2]
    assert (found[0].start, found[0].end) == (BASE, BASE + 100)


def test_last_bucket_ends_at_the_latest_change(spark):
    days = spark.createDataFrame([("f", BASE + d * DAY) for d in range(1, 30)], "file string, t long")
    one = coupling.layout(days, 20 * DAY).first()
    assert one.buckets == 2 and one.first_start == BASE + 29 * DAY - 40 * DAY + 1


def test_files_without_partners_stay(spark):
    rows = [("foo", BASE), ("foo", BASE + DAY), ("bar", BASE + 40 * DAY)]
    found = result(coupling.coupling(frame(spark, rows), CouplingConfig(100, 1, 0.1, 60, 60, 0)))
    assert {k[0]: v for k, v in found.items()} == {"foo": (2, {}), "bar": (1, {})}


def test_half_open_window_is_asymmetric(spark):
    rows = [("foo", BASE + 3600), ("bar", BASE + 7200)]
    found = result(coupling.coupling(frame(spark, rows), CouplingConfig(10, 1, 0.1, 60, 3600, 0)))
    assert {k[0]: v[1] for k, v in found.items()} == {"bar": {"foo": 1}, "foo": {}}


def test_no_changes(spark):
    assert coupling.coupling(frame(spark, []), CouplingConfig()).count() == 0


@pytest.mark.parametrize("a,b,common,distance", [("a/b/c", "a/b/d", 2, 1), ("a", "b", 0, None), ("a/b", "a/b", 2, 0), ("a/b/c/d", "a", 1, 3), ("foo/b", "foo-x/a", 0, None)])
def test_path_metrics(spark, a, b, common, distance):
    row = spark.createDataFrame([(a.split("/"), b.split("/"))], "a array<string>, b array<string>").select(paths.common_roots(F.col("a"), F.col("b")), paths.distance(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (common, distance)


def test_extract_changes_drops_files_without_code_and_empty_changes(spark):
    loc = spark.createDataFrame([(["a"], 3), (["b"], 0)], "file array<string>, code long")
    history = spark.createDataFrame([(["a"], 5, 1, 0), (["a"], 5, 0, 2), (["a"], 6, 0, 0), (["b"], 5, 1, 1), (["c"], 5, 1, 1)], "file array<string>, t long, added long, deleted long")
    assert [(r.file, r.t) for r in coupling.extract_changes(loc, history).collect()] == [(["a"], 5)]


def test_config_is_checked():
    from loamline.config import ScanConfig

    with pytest.raises(ValueError):
        ScanConfig(".", git=False, git_details=False, coupling=CouplingConfig())
    with pytest.raises(ValueError):
        ScanConfig(".", git=False)
    with pytest.raises(ValueError):
        ScanConfig(".", calculators=("loc",))
    with pytest.raises(ValueError):
        CouplingConfig(bucket_days=0)
    assert CouplingConfig.from_minutes(2, 3).gap == 120
