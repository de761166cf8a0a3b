"""The bootstrap operators against brute force, and the replicate counts of their queries."""

import hashlib
import inspect
import math

import numpy as np
import pytest

from stratawave import queries as q
from stratawave.operators import slices

SF = "/root/testdata/sf0.001"


def h32(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_replicate_counts(spark, monkeypatch):
    seen = {}
    for name, want in (("bootstrap", 2000), ("bootstrap_mean", 5000)):
        f = getattr(slices, name)
        assert inspect.signature(f).parameters["n_boot"].default == want

        def spy(*args, f=f, name=name, **more):
            bound = inspect.signature(f).bind(*args, **more)
            bound.apply_defaults()
            seen[name] = bound.arguments["n_boot"]
            return f(*args, **more)

        monkeypatch.setattr(slices, name, spy)
    q.QUERIES["bootstrap_ci_full"](spark, SF)
    q.QUERIES["regime_bootstrap"](spark, SF)
    assert seen == {"bootstrap": 2000, "bootstrap_mean": 5000}


def binomial(n, p, u):
    """The smallest count whose distribution function is above u, by summing exact terms."""
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if u < total:
            return k
    return n


def test_bootstrap_against_brute_force(spark):
    data = [(t, i, (i * 7 + k) % 3 % 2, (i * 5 + k) % 2) for k, t in enumerate(("A1", "B1", "C1")) for i in range(5 + 2 * k)] + [("all", i, 0, 1) for i in range(4)] + [("none", i, 1, 1) for i in range(3)]
    tasks = {}
    for t, _, a, b in data:
        tasks.setdefault(t, []).append(a - b)
    micro, macro = [], []
    for r in range(40):
        drawn = {}
        for t, x in tasks.items():
            n, lost, won = len(x), x.count(-1), x.count(1)
            minus = binomial(n, lost / n, h32("lost", r, t) / 2**32)
            drawn[t] = binomial(n - minus, won / (n - lost) if n > lost else 0.0, h32("won", r, t) / 2**32) - minus
        micro.append(sum(drawn.values()) / len(data))
        macro.append(np.mean([s / len(tasks[t]) for t, s in drawn.items()]))
    got = {r["metric"]: r for r in slices.bootstrap(spark.createDataFrame(data, "task_name string, id long, a int, b int"), 40).collect()}
    for name, v in (("micro", sorted(micro)), ("macro", sorted(macro))):
        assert [got[name][c] for c in ("mean", "low", "high")] == pytest.approx([np.mean(v), v[int(0.025 * 39)], v[int(0.975 * 39)]])


def test_draws_follow_resampling(spark):
    """Bounds and mean of 2000 replicates of many rows are those of resampling the rows themselves."""
    rng = np.random.default_rng(5)
    x = rng.choice([-1, 0, 1], 4000, p=[0.1, 0.6, 0.3])
    data = [("A1", i, int(v > 0), int(v < 0)) for i, v in enumerate(x)]
    got = {r["metric"]: r for r in slices.bootstrap(spark.createDataFrame(data, "task_name string, id long, a int, b int")).collect()}
    means = np.sort([rng.choice(x, len(x)).mean() for _ in range(2000)])
    assert got["micro"]["mean"] == pytest.approx(x.mean(), abs=1e-3)
    assert [got["micro"][c] for c in ("low", "high")] == pytest.approx([means[49], means[1949]], abs=3e-3)


def test_bootstrap_mean_against_brute_force(spark):
    groups = {"high": [0.1, 0.2, 0.4, 0.9], "low": [-0.3, 0.0, 0.5]}
    rows = spark.createDataFrame([(f"{g}{i}", g, x) for g, own in groups.items() for i, x in enumerate(own)], "tile string, g string, x double")
    got = {r["g"]: r for r in slices.bootstrap_mean(rows, "g", "x", 30).collect()}
    for g, x in groups.items():
        means = [np.mean([x[h32(r, g, k) % len(x)] for k in range(len(x))]) for r in range(30)]
        assert got[g]["n"] == len(x)
        assert [got[g][c] for c in ("mean", "low", "high")] == pytest.approx([np.mean(x), *np.percentile(means, [2.5, 97.5])])
