"""Mixed models, imputation, pooling, distributions and figures against dense numpy and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import dist as D
from panelwright.operators import figures as G
from panelwright.operators import impute as I
from panelwright.operators import mixed as M
from panelwright.operators import models as L
from panelwright.operators import survey as S


def invented(seed=3, regions=5, per=6, rows=(2, 9)):
    rng = np.random.default_rng(seed)
    out = []
    for r in range(regions):
        shift = rng.normal(0, 2)
        for c in range(per):
            a, b = rng.normal(0, 3), rng.normal(0, 1)
            for t in range(rng.integers(*rows)):
                x = float(rng.normal())
                out.append((f"r{r}", f"r{r}c{c}", float(t), x, float(5 + shift + a + (0.7 + b) * t - 1.5 * x + rng.normal(0, 1.3))))
    return out


SHAPE = "region string, country string, time double, x double, y double"


def dense(rows, terms, levels, fit):
    """Deviance of the fit's parameters from the whole covariance matrix, and the matrices."""
    columns = {"(Intercept)": np.ones(len(rows)), "time": np.array([r[2] for r in rows]), "x": np.array([r[3] for r in rows])}
    columns["time2"] = columns["time"] ** 2
    y = np.array([r[4] for r in rows])
    x = np.column_stack([columns[t] for t in terms])
    v = fit.sigma2 * np.eye(len(rows))
    for level, g in zip(levels, fit.g):
        name = np.array([r[0] if level.groups[-1] == "region" else r[1] for r in rows])
        z = np.column_stack([columns[t] for t in level.terms])
        v += (z @ g @ z.T) * (name[:, None] == name[None])
    w = np.linalg.inv(v)
    b = np.linalg.solve(x.T @ w @ x, x.T @ w @ y)
    r = y - x @ b
    return len(y) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ w @ r, x, y, v, b


SLOPE = M.Level(("country",), ("(Intercept)", "time"))
MODELS = {
    "slope": (["time", "x"], [SLOPE]),
    "diagonal": (["time", "x"], [M.Level(("country",), ("(Intercept)", "time"), diagonal=True)]),
    "covariate": (["time", "x"], [M.Level(("country",), ("(Intercept)", "x"))]),
    "nested": (["time", "x"], M.nested("region", "country")),
}


@pytest.mark.parametrize("name", MODELS)
def test_fit_is_the_optimum(spark, name):
    rows = invented()
    xs, levels = MODELS[name]
    model = M.Model(spark.createDataFrame(rows, SHAPE), "y", xs, levels)
    fit = model.fit()[""]
    assert fit.converged
    dev, x, y, v, b = dense(rows, fit.terms, levels, fit)
    assert abs(dev - fit.deviance) < 1e-6 and np.allclose(b, fit.beta, atol=1e-6)
    assert np.allclose(np.linalg.inv(x.T @ np.linalg.solve(v, x)), fit.vcov, rtol=1e-6)
    assert abs(model.deviances({"": (fit.beta, fit.sigma2, fit.g)})[""] - fit.deviance) < 1e-6
    import copy

    rng = np.random.default_rng(1)
    for _ in range(40):  # no parameters near by are better
        other = copy.copy(fit)
        other.sigma2 = fit.sigma2 * math.exp(rng.normal(0, 0.05))
        other.g = [m @ m.T if np.all(np.linalg.eigvalsh(g) > 1e-6) and (m := np.linalg.cholesky(g) * np.exp(rng.normal(0, 0.05, g.shape))) is not None else g for g in fit.g]
        assert dense(rows, fit.terms, levels, other)[0] >= dev - 1e-7


def test_nested_query_has_slopes_on_both_levels(spark):
    from types import SimpleNamespace

    from panelwright.plans.mixed import mm_3level

    steep = dict(zip((f"r{r}" for r in range(8)), np.random.default_rng(8).normal(0, 2, 8).tolist()))
    rows = [(*r[:4], r[4] + steep[r[0]] * r[2]) for r in invented(11, regions=8, per=5, rows=(4, 8))]
    found = {(r["part"], r["name"]): r["value"] for r in mm_3level(spark.createDataFrame(rows, SHAPE)).collect()}
    levels = M.nested("region", "country", ("(Intercept)", "time"))
    names = "(Intercept):(Intercept)", "time:(Intercept)", "time:time"
    got = [[found["covariance", f"{'/'.join(v.groups)}:{n}"] for n in names] for v in levels]
    fit = SimpleNamespace(sigma2=found["covariance", "residual::"], g=[np.array([[a, b], [b, c]]) for a, b, c in got])
    dev, _, _, _, beta = dense(rows, ["(Intercept)", "time"], levels, fit)
    assert found["fit", "converged"] == 1 and abs(dev - found["fit", "deviance"]) < 1e-6
    assert np.allclose(beta, [found["fixed", "(Intercept)"], found["fixed", "time"]], atol=1e-6)
    assert found["fit", "aic"] == pytest.approx(dev + 2 * 9)  # two coefficients, three covariances on each level, the residual
    rng = np.random.default_rng(2)
    roots = [np.linalg.cholesky(g) for g in fit.g]
    for _ in range(40):  # no parameters near by are better
        moved = [r * np.exp(rng.normal(0, 0.05, r.shape)) for r in roots]
        other = SimpleNamespace(sigma2=fit.sigma2 * math.exp(rng.normal(0, 0.05)), g=[m @ m.T for m in moved])
        assert dense(rows, ["(Intercept)", "time"], levels, other)[0] >= dev - 1e-7


def test_effects_influence_and_robust_errors(spark):
    rows = invented(5)
    df = spark.createDataFrame(rows, SHAPE)
    model = M.Model(df, "y", ["time", "x"], [SLOPE])
    fit = model.fit()[""]
    _, x, y, v, b = dense(rows, fit.terms, [SLOPE], fit)
    name = np.array([r[1] for r in rows])
    z, w = x[:, :2], np.linalg.inv(v)
    got = {r["country"]: (r["effect_0"], r["effect_1"]) for r in model.effects({"": fit}).collect()}
    for c in set(name):
        k = name == c
        assert np.allclose(got[c], fit.g[0] @ z[k].T @ (w @ (y - x @ b))[k], atol=1e-5)
    predicted = M.predict(df, model, {"": fit}).collect()
    assert all(abs(r["fixed"] + r["residual_fixed"] - r["y"]) < 1e-9 for r in predicted)
    for r in model.influence({"": fit}).collect():
        k = name != r["country"]
        u = np.linalg.inv(v[np.ix_(k, k)])
        one = np.linalg.solve(x[k].T @ u @ x[k], x[k].T @ u @ y[k])
        assert np.allclose(one, r["b"], atol=1e-5)
        assert abs((b - one) @ np.linalg.inv(fit.vcov) @ (b - one) / 3 - r["cooks"]) < 1e-5

    def sandwich(adjust):
        bread, meat = np.linalg.inv(x.T @ w @ x), 0
        for c in set(name):
            k = name == c
            vi, xi = v[np.ix_(k, k)], x[k]
            d = np.linalg.cholesky(vi).T  # another root of the working covariance gives the same adjustment up to rotation
            values, axes = np.linalg.eigh(vi)
            d = (axes * np.sqrt(values)) @ axes.T
            h = d @ (vi - xi @ bread @ xi.T) @ d.T
            values, axes = np.linalg.eigh(h)
            good = values > 1e-10 * values.max()
            a = d.T @ ((axes[:, good] / np.sqrt(values[good])) @ axes[:, good].T) @ d if adjust else np.eye(len(vi))
            s = xi.T @ np.linalg.solve(vi, a @ (y[k] - xi @ b))
            meat = meat + np.outer(s, s)
        return np.sqrt(np.diag(bread @ meat @ bread))

    robust = M.robust(df, model, fit).collect()
    assert np.allclose([r["se"] for r in robust], sandwich(True), rtol=1e-5) and robust[0]["n_plain"] == 0
    plain = M.robust(df, model, fit, bound=0).collect()
    n = len(set(name))
    assert np.allclose([r["se"] for r in plain], sandwich(False) * math.sqrt(n / (n - 1)), rtol=1e-5) and plain[0]["n_plain"] == n


def test_singular_fit_and_left_out_group(spark, sf):
    from panelwright.fixtures import shape

    pn = shape(spark, sf, "pn")
    model = M.Model(pn, "co2", ["time"], [M.Level(("country",), ("(Intercept)", "time"))])
    assert model.fit()[""].singular
    one = M.Model(pn, "co2", ["time"], [M.Level(("country",))])
    few = one.without(F.col("country") == "NATION_3").fit()[""]
    same = M.Model(pn.where("country <> 'NATION_3'"), "co2", ["time"], [M.Level(("country",))]).fit()[""]
    assert abs(few.deviance - same.deviance) < 1e-6 and np.allclose(few.beta, same.beta, atol=1e-6) and few.groups == same.groups


def stacked(spark, m=4):
    rows = [(k, *r[:3], r[3] + 0.1 * k * math.sin(7 * i), r[4]) for k in range(1, m + 1) for i, r in enumerate(invented(7))]
    return spark.createDataFrame(rows, "imp int, " + SHAPE), rows


def test_fits_over_imputations_and_d3(spark):
    df, rows = stacked(spark)
    small, large = (M.Model(df, "y", xs, [M.Level(("country",))], ["imp"]) for xs in (["time"], ["time", "x"]))
    fits = small.fit(), large.fit()
    alone = M.Model(df.where("imp = 2"), "y", ["time", "x"], [M.Level(("country",))]).fit()[""]
    assert abs(alone.deviance - fits[1]["2"].deviance) < 1e-6
    out = I.d3((small, fits[0]), (large, fits[1]))
    apart = []
    for model, fs in zip((small, large), fits):
        beta, s2 = np.mean([f.beta for f in fs.values()], 0), np.mean([f.sigma2 for f in fs.values()])
        g = np.mean([f.g[0] for f in fs.values()], 0)
        devs = []
        for k in range(1, 5):
            mine = [r[1:] for r in rows if r[0] == k]
            x = np.column_stack([np.ones(len(mine)), [r[2] for r in mine], *([[r[3] for r in mine]] if "x" in model.xs else [])])
            name = np.array([r[1] for r in mine])
            v = s2 * np.eye(len(mine)) + g[0, 0] * (name[:, None] == name[None])
            r = np.array([r[4] for r in mine]) - x @ beta
            devs.append(len(mine) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r))
        apart.append(np.mean(devs))
    assert abs(out["mean"] - (apart[0] - apart[1])) < 1e-6
    assert out["own"] >= out["mean"] - 1e-9 and 0 <= out["p"] <= 1
    parts, stats = I.pooled_components(M.components(spark, fits[1]), M.quality(spark, fits[1]))
    got = {r["level"]: r["covariance"] for r in parts.collect()}
    assert abs(got["residual"] - np.mean([f.sigma2 for f in fits[1].values()])) < 1e-9
    assert abs(stats.first()["deviance"] - np.mean([f.deviance for f in fits[1].values()])) < 1e-9


def test_imputation(spark, sf):
    from panelwright.fixtures import shape

    pn = shape(spark, sf, "pn").select("country", "year", "co2", "gdp", "sl_total", "gini", "left_right", "democracy").cache()
    targets = {"gini": ["co2", "gdp"], "left_right": ["co2", "gini"], "democracy": ["gdp"]}
    runs = []
    for n in (1, 200):
        out = I.impute(pn.repartition(n), targets, key=["country", "year"], group="country", m=3, cycles=2, seed=5, by_group=["democracy"])
        runs.append(sorted((r["imp"], r["country"], r["year"], *[r[c] for c in targets]) for r in out.collect()))
    assert all(a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-6) for a, b in zip(*runs, strict=True))
    seen = {(r["country"], r["year"]): r for r in pn.collect()}
    assert len(runs[0]) == 3 * len(seen)
    for _, country, year, *values in runs[0]:
        for c, v in zip(targets, values):
            assert v is not None and (seen[country, year][c] is None or abs(seen[country, year][c] - v) < 1e-4)
    gone = {v[3] for v in runs[0] if seen[v[1], v[2]]["gini"] is None}
    assert len(gone) > 10
    whole = {(v[0], v[1], v[5]) for v in runs[0] if seen[v[1], v[2]]["democracy"] is None}
    assert len(whole) == 3  # one value of the group in each copy


def test_pooled_intervals(spark):
    rows = [(k, "a", 1.0 + 0.1 * k, 0.5, 20.0) for k in range(10)]
    df = spark.createDataFrame(rows, "imp int, term string, estimate double, se double, df double")
    r = I.pooled(df, m=10).first()
    assert abs((r["low"] + r["high"]) / 2 - r["estimate"]) < 1e-9 and r["low"] < r["estimate"]
    assert abs(D.t_tail((r["high"] - r["estimate"]) / r["se"], r["dof"]) - 0.025) < 1e-9
    b = I.pooled_robust(df).first()
    gamma = 1.1 * np.var([x[2] for x in rows], ddof=1) / (0.25 + 1.1 * np.var([x[2] for x in rows], ddof=1))
    assert abs(b["df"] - 1 / (gamma ** 2 / 9 + 23 / (20 * 21 * (1 - gamma)))) < 1e-9


def test_distributions(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for df in (1.0, 2.5, 7.0, 173.0):
        for t in (-3.0, 0.0, 0.4, 2.2, 9.0):
            assert abs(D.t_tail(t, df) - (1 - jvm.TDistribution(df).cumulativeProbability(t))) < 1e-9
            assert abs(D.f_tail(abs(t), df, 9.0) - (1 - jvm.FDistribution(df, 9.0).cumulativeProbability(abs(t)))) < 1e-9
            assert abs(D.chi2_tail(abs(t) * 5, df) - (1 - jvm.ChiSquaredDistribution(df).cumulativeProbability(abs(t) * 5))) < 1e-9
        assert abs(D.t_quantile(0.975, df) - jvm.TDistribution(df).inverseCumulativeProbability(0.975)) < 1e-7
    assert abs(D.normal_quantile(0.975) - 1.959963984540054) < 1e-12
    row = spark.sql("SELECT CAST(NULL AS DOUBLE) AS z, 1e0 AS d").select(D.p_normal("z").alias("a"), D.p_t("d", "z").alias("b"), D.q_normal("d").alias("c")).first()
    assert row["a"] is None and row["b"] is None and row["c"] is None


def test_quantile_pairs_and_smooth(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(10, 3, 500), 1)
    got = sorted((r["theoretical"], r["sample"], r["line"]) for r in G.qq(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double"), "v").collect())
    assert [g[1] for g in got] == sorted(v.tolist())
    assert np.allclose([g[0] for g in got], D.normal_quantile((np.arange(500) + 0.5) / 500), atol=1e-9)
    q1, q3 = np.quantile(v, [0.25, 0.75])
    assert np.allclose([g[2] for g in got], [(q1 + q3) / 2 + (q3 - q1) / 2 / 0.6744897501960817 * g[0] for g in got])
    small = G.qq(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), "v").orderBy("sample").collect()
    assert abs(small[0]["theoretical"] - D.normal_quantile(0.625 / 3.25)) < 1e-9


def test_model_check_is_whole(spark):
    rows = [r for r in invented(9) for _ in range(2)]  # rows that come twice, and one without an outcome
    df = spark.createDataFrame([*rows, ("r0", "r0c0", 1.0, 0.5, None)], SHAPE)
    model = M.Model(df, "y", ["time", "x"], [SLOPE])
    fits = model.fit()
    n, groups, sigma = len(rows), len({r[1] for r in rows}), math.sqrt(fits[""].sigma2)
    runs = []
    for parts in (1, 7):
        panels = {}
        for r in G.model_check(df.repartition(parts), model, fits).collect():
            panels.setdefault(r["panel"], []).append((r["label"], r["x"], r["y"], r["line"]))
        runs.append(panels)
    for panel, (a, b) in {p: [sorted(run[p], key=str) for run in runs] for p in runs[0]}.items():
        assert [v[0] for v in a] == [v[0] for v in b]
        assert all(np.allclose([v[i] for v in a if v[i] is not None], [v[i] for v in b if v[i] is not None]) for i in (1, 2, 3)), panel
    panels = runs[0]
    assert set(panels) == {"fitted", "fixed", "linearity", "spread", "collinearity", "tolerance", "residuals", "effects", "predictive"}
    predicted = M.predict(df, model, fits).where("y IS NOT NULL").collect()
    for panel, x, y in (("fitted", "fitted", "residual"), ("fixed", "fixed", "residual_fixed")):
        assert np.allclose(sorted((v[1], v[2]) for v in panels[panel]), sorted((r[x], r[y]) for r in predicted)) and len(panels[panel]) == n
    residuals = sorted(v[1:] for v in panels["residuals"])
    assert np.allclose([v[0] for v in residuals], D.normal_quantile((np.arange(n) + 0.5) / n)) and np.allclose([v[1] for v in residuals], sorted(r["residual"] for r in predicted))
    q1, q3 = np.quantile([v[1] for v in residuals], [0.25, 0.75])
    assert np.allclose([v[2] for v in residuals], [(q1 + q3) / 2 + (q3 - q1) / 2 / 0.6744897501960817 * v[0] for v in residuals])
    effects = model.effects(fits).collect()
    for i, term in enumerate(SLOPE.terms):
        mine = sorted(v[1:] for v in panels["effects"] if v[0] == term)
        assert len(mine) == groups and np.allclose([v[1] for v in mine], sorted(r[f"effect_{i}"] for r in effects))
    inflated = {v[0]: v[2] for v in panels["collinearity"]}
    assert all(abs(v[2] * inflated[v[0]] - 1) < 1e-9 for v in panels["tolerance"]) and set(inflated) == {"time", "x"}
    y, fitted = np.array([r[4] for r in rows]), np.array([r["fitted"] for r in predicted])
    width = (y.max() - y.min()) / 30
    bins = {}
    for label, x, count, _ in panels["predictive"]:
        bins.setdefault(label, {})[round(x / width - 0.5)] = count
    assert bins["observed"] == {k: int((np.floor(y / width) == k).sum()) for k in set(np.floor(y / width))}
    assert set(bins) == {"observed", *(f"draw {k}" for k in range(1, 51))} and all(sum(b.values()) == n for b in bins.values())
    assert len({tuple(sorted(b.items())) for b in bins.values()}) == 51
    drawn = np.concatenate([np.repeat([(k + 0.5) * width for k in b], [int(c) for c in b.values()]) for label, b in bins.items() if label != "observed"])
    assert abs(drawn.mean() - fitted.mean()) < 4 * sigma / math.sqrt(50 * n) + width / 10
    assert abs(drawn.var() / (fitted.var() + sigma ** 2 + width ** 2 / 12) - 1) < 0.05


@pytest.mark.parametrize("p,r", [(5, 80), (10, 80), (1, 80), (3, 0)])
def test_many_plausible_values_and_replicates(spark, p, r):
    rng = np.random.default_rng(4)
    n = 300
    g, v, w = rng.integers(0, 3, n), rng.normal(500, 90, (n, max(p, 1))), rng.uniform(1, 5, n)
    rw = w[:, None] * rng.choice([0.5, 1.5], (n, r))
    names = [f"pv{i}" for i in range(p)], [f"rw{i}" for i in range(r)]
    rows = [(int(g[i]), *map(float, v[i]), float(w[i]), *map(float, rw[i])) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(["g int", *[f"{c} double" for c in [*names[0], "w", *names[1]]]]))
    for row in S.pv_se(df, ["g"], names[0], "w", names[1]).collect():
        k = g == row["g"]
        means = np.array([[np.average(v[k, i], weights=x) for x in (w[k], *rw[k].T)] for i in range(p)])
        sampling = ((means[:, 1:] - means[:, :1]) ** 2).sum() / (p * r * 0.25) if r else 0.0
        between = means[:, 0].var(ddof=1) if p > 1 else 0.0
        assert row["freq"] == k.sum() and abs(row["mean"] - means[:, 0].mean()) < 1e-9
        assert abs(row["se"] - math.sqrt(sampling + between * (1 + 1 / p))) < 1e-9


def test_ols_fits(spark):
    rows = [(k, float(x), float(3 + 2 * x + (x * 7 + k) % 3)) for k in (1, 2) for x in range(12)]
    fits = L.ols_fits(spark.createDataFrame(rows, "k int, x double, y double"), "y", ["x"], ["k"])
    x = np.column_stack([np.ones(12), range(12)])
    for k in (1, 2):
        y = np.array([r[2] for r in rows if r[0] == k])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose(fits[k,][0], b)
        assert np.allclose(fits[k,][1], ((y - x @ b) ** 2).sum() / 10 * np.linalg.inv(x.T @ x))
