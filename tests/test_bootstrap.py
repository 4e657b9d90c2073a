"""The intervals against plain resampling with all replicates, and the number that the queries ask for."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from veracity.operators import analysis, metrics, resample
from veracity.operators.registry import BOOTSTRAP, SEED
from veracity.plans import reliability

SF = "/root/testdata/sf0.001"


def drawn(*parts) -> int:
    return int(hashlib.md5("-".join(map(str, (SEED, *parts))).encode()).hexdigest()[:8], 16)


def mixed(x: int) -> int:
    x &= 0xFFFFFFFF
    x = (x ^ x >> 16) * 0x21F0AAAD & 0xFFFFFFFF
    x = (x ^ x >> 15) * 0x735A2D97 & 0xFFFFFFFF
    return x ^ x >> 15


def share(node: str, rep: int, draws: int, left: int, size: int) -> int:
    """The binomial share of a node's left part: the least k whose distribution function reaches the node's number."""
    unit = (mixed(int(hashlib.md5(f"{SEED}-{node}".encode()).hexdigest()[:8], 16) + rep * 2654435769) + 0.5) / 2**32
    p, total = Fraction(left, size), Fraction(0)
    for k in range(draws + 1):
        total += math.comb(draws, k) * p**k * (1 - p) ** (draws - k)
        if total >= unit:
            return k
    return draws


def split(group: list, rep: int) -> list:
    """The rows of a replicate: draws split between the classes, then between halves of each."""
    group = sorted(group, key=lambda r: (r[0], r[2]))
    wrong, right = [r for r in group if not r[1]], [r for r in group if r[1]]
    name, out = f"{len(group)}-{len(wrong)}", []

    def walk(rows: list, node: int, low: int, draws: int) -> None:
        if len(rows) == 1:
            out.extend(rows * draws)
        elif rows and draws:
            half = (low + low + len(rows)) // 2 - low
            left = share(f"{name}-{node}-{low}-{low + len(rows)}", rep, draws, half, len(rows))
            walk(rows[:half], node, low, left)
            walk(rows[half:], node, low + half, draws - left)

    of_wrong = share(name, rep, len(group), len(wrong), len(group)) if 0 < len(wrong) < len(group) else len(wrong)
    walk(wrong, 0, 0, of_wrong)
    walk(right, 1, 0, len(group) - of_wrong)
    return out


def poisson(unit: float) -> int:
    k, p, total = 0, np.exp(-1.0), 0.0
    for i in range(1, 12):
        total, p = total + p, p / i
        k += unit >= total
    return k


def auroc(rows) -> float:
    right, wrong = [u for u, ok, _ in rows if ok], [u for u, ok, _ in rows if not ok]
    return np.nan if not right or not wrong else sum((w > r) + (w == r) / 2 for w in wrong for r in right) / (len(right) * len(wrong))


def aurc(rows) -> float:
    wrong = np.cumsum([not ok for _, ok, _ in sorted(rows, key=lambda r: (r[0], r[2]))])
    return float((wrong / np.arange(1, len(rows) + 1)).mean())


@pytest.mark.parametrize(("mode", "metric"), [("multinomial", "auroc"), ("multinomial", "aurc"), ("poisson", "auroc")])
def test_bootstrap_against_plain_resampling(spark, mode, metric):
    rnd = random.Random(7)
    rows = [(g, float(rnd.randint(0, 6)), rnd.random() < 0.6, hashlib.md5(f"{g}{i}".encode()).hexdigest()) for g, n in (("a", 11), ("b", 17)) for i in range(n)]
    found = metrics.bootstrap(spark.createDataFrame(rows, "g string, u double, ok boolean, pos string"), ["g"], mode=mode, metric=metric)
    for r in found.collect():
        group = sorted((x[1:] for x in rows if x[0] == r["g"]), key=lambda x: x[2])
        plain, values = {"auroc": auroc, "aurc": aurc}[metric], []
        for rep in range(1000):
            if mode == "multinomial":
                some = split(group, rep)
            else:
                some = [x for x in group for _ in range(poisson((drawn(rep, x[2]) + 0.5) / 2**32))]
            values.append(plain(some))
        values = [v for v in values if not np.isnan(v)]
        assert [r["value"], r["lower"], r["upper"]] == pytest.approx([plain(group), *np.quantile(values, [0.025, 0.975])])


@pytest.mark.parametrize("name", ["bootstrap_auroc_ci", "bootstrap_poisson", "interval_bars", "best_free_signal", "evaluations"])
def test_queries_draw_all_replicates(spark, monkeypatch, name):
    asked, whole = [], metrics.bootstrap

    def noted(*args, replicates=BOOTSTRAP, **options):
        asked.append(replicates)
        return whole(*args, replicates=replicates, **options)

    monkeypatch.setattr(metrics, "bootstrap", noted)
    monkeypatch.setattr(analysis.metrics, "bootstrap", noted)
    reliability.QUERIES[name](spark, SF)
    assert asked and set(asked) == {1000}


@pytest.mark.parametrize("metric", ["auroc", "aurc"])
def test_parts_add_up(spark, monkeypatch, metric):
    """Many small parts give what one part gives, ties across their edges included."""
    rnd = random.Random(5)
    rows = [("a", float(rnd.randint(0, 9)), rnd.random() < 0.5, hashlib.md5(str(i).encode()).hexdigest()) for i in range(200)] + [("one class", float(i), True, f"{i:03}") for i in range(5)] + [("single", 1.0, False, "0")]
    df = spark.createDataFrame([*rows, ("a", float("nan"), True, "x"), ("none", None, True, "y")], "g string, u double, ok boolean, pos string")
    found = lambda: sorted(metrics.bootstrap(df, ["g"], metric=metric, replicates=50).collect())
    whole = found()
    monkeypatch.setattr(resample, "PART", 7)
    parts = found()
    assert [r["g"] for r in whole] == ["a", "one class", "single"]
    for x, y in zip(whole, parts, strict=True):
        assert x[0] == y[0] and list(x)[1:] == pytest.approx(list(y)[1:], nan_ok=True)
    if metric == "auroc":
        assert all(math.isnan(v) for v in whole[1][1:])


def test_draws_are_multinomial():
    """Counts sum to n; each row's mean, variance and covariances are those of n draws with replacement, below and above TABLED."""
    for n, wrong in ((37, 11), (6000, 2500)):
        draws = resample.Draws(1, n, wrong, 4000)
        bad, none = draws.counts(0, 0, min(wrong, 20))
        assert not none.any()
        good, before = draws.counts(1, 5, 25)
        head, _ = draws.counts(1, 0, 5)
        assert (head.sum(1) == before).all() and (draws.roots[0] + draws.roots[1] == n).all()
        some = np.concatenate([bad, good], 1)
        assert abs(some.mean() - 1) < 0.02 and abs(some.var(0).mean() - (1 - 1 / n)) < 0.03
        assert abs((np.cov(some.T) - np.diag(some.var(0))).mean() + 1 / n) < 0.02
        if n == 37:
            assert (draws.counts(0, 0, 11)[0].sum(1) + draws.counts(1, 0, 26)[0].sum(1) == n).all()


def test_a_callers_metric(spark):
    """A metric that the library doesn't know, over a column that it doesn't know: the mean loss of a replicate."""
    rnd = random.Random(2)
    rows = [(g, rnd.random(), rnd.random() < 0.5, hashlib.md5(f"{g}{i}".encode()).hexdigest(), rnd.random()) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, u double, ok boolean, pos string, loss double")
    mean = resample.Metric("loss", 2, lambda p: p.counts @ np.stack([p.columns["loss"], np.ones(len(p.u))], 1), lambda s: s[0] / s[1], ("loss",))
    for r in metrics.bootstrap(df, ["g"], metric=mean).collect():
        losses = [x[4] for x in rows if x[0] == r["g"]]
        spread = np.std(losses) / np.sqrt(60)
        assert r["value"] == pytest.approx(np.mean(losses))
        assert r["lower"] == pytest.approx(np.mean(losses) - 1.96 * spread, abs=0.3 * spread) and r["upper"] == pytest.approx(np.mean(losses) + 1.96 * spread, abs=0.3 * spread)
    with pytest.raises(ValueError, match="unknown metric"):
        metrics.bootstrap(df, ["g"], metric="loss")
    with pytest.raises(ValueError, match="poisson"):
        metrics.bootstrap(df, ["g"], metric=mean, mode="poisson")


def test_harmonic():
    n = np.array([0, 1, 2, 99, 100, 101, 5000])
    assert resample.harmonic(n) == pytest.approx([sum(1 / i for i in range(1, k + 1)) for k in n], abs=1e-12)
