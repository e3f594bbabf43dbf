"""Queries over mixed models, imputations, distributions and diagnostic figures.

Closed forms hold on the balanced panel: 25 groups of 6 periods, times 0 to 5.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import dist as D
from panelwright.operators import figures as G
from panelwright.operators import impute as I
from panelwright.operators import mixed as M
from panelwright.operators import models as L
from panelwright.plans.common import query

ONE = M.Level(("country",))
SLOPE = M.Level(("country",), (M.INTERCEPT, "time"))


def _fit(df, y, xs, level, by=()):
    model = M.Model(df, y, xs, [level] if isinstance(level, M.Level) else level, by)
    return model, model.fit()


# ---- random slopes -------------------------------------------------------------------------

_LINES = ("(SELECT country, regr_intercept(y, time) AS a, regr_slope(y, time) AS b, regr_syy(y, time) - pow(regr_sxy(y, time), 2) / regr_sxx(y, time) AS rss FROM pb GROUP BY country)")
_RS = f"""(SELECT avg(a) AS b0, avg(b) AS b1, sum(rss) / 100e0 AS s2, var_pop(a) AS saa, covar_pop(a, b) AS sab, var_pop(b) AS sbb,
 var_pop(a) - sum(rss) / 100e0 * (1 / 6e0 + 625e-2 / 175e-1) AS g00, covar_pop(a, b) + sum(rss) / 100e0 * 25e-1 / 175e-1 AS g01, var_pop(b) - sum(rss) / 100e0 / 175e-1 AS g11 FROM {_LINES} l)"""
_RI = """(SELECT slope AS b1, (SELECT avg(y) FROM pb) - slope * 25e-1 AS b0, (6 * between_ / 25 - s2) / 6 AS tau2, s2, within_ / 125 AS s2_null, (6 * between_ / 25 - within_ / 125) / 6 AS tau2_null FROM
 (SELECT slope, between_, within_, (within_ - slope * slope * 25 * 175e-1) / 125 AS s2 FROM (SELECT sum((time - 25e-1) * (y - m)) / (25 * 175e-1) AS slope, sum(pow(y - m, 2)) AS within_,
 max(b) AS between_ FROM (SELECT *, avg(y) OVER (PARTITION BY country) AS m FROM pb) p, (SELECT sum(pow(m - g, 2)) AS b FROM (SELECT avg(y) AS m FROM pb GROUP BY country) k, (SELECT avg(y) AS g FROM pb) a) q) r) u)"""
# effects of a group: covariance of the effects by the inverse covariance of the groups' own lines
_EFFECTS = f"""(SELECT country, b0, b1, s2, g00 * x + g01 * z AS e0, g01 * x + g11 * z AS e1 FROM
 (SELECT *, (sbb * (a - b0) - sab * (b - b1)) / (saa * sbb - sab * sab) AS x, (saa * (b - b1) - sab * (a - b0)) / (saa * sbb - sab * sab) AS z FROM {_LINES} l, {_RS} r) t)"""


@query("mm_rs", f"SELECT b0 AS intercept, b1 AS time, g00, g01, g11, s2 AS sigma2, false AS singular FROM {_RS} r", uses="pb", keys="singular", floats="intercept time g00 g01 g11 sigma2", digits=3)
def mm_rs(pb):
    _, fits = _fit(pb, "y", ["time"], SLOPE)
    f = fits[""]
    return pb.sparkSession.createDataFrame([(*map(float, (f.beta[0], f.beta[1], f.g[0][0, 0], f.g[0][0, 1], f.g[0][1, 1], f.sigma2)), bool(f.singular))],
                                           "intercept double, time double, g00 double, g01 double, g11 double, sigma2 double, singular boolean")


def _report(df, y, xs, level) -> DataFrame:
    """Coefficients, components and quality of one fit as ``part, name, value``."""
    _, fits = _fit(df, y, xs, level)
    spark = df.sparkSession
    fixed = M.estimates(spark, fits).select(F.lit("fixed").alias("part"), F.col("term").alias("name"), F.col("estimate").alias("value"))
    random = M.components(spark, fits).select(F.lit("covariance").alias("part"), F.concat_ws(":", "level", "term", "other").alias("name"), F.col("covariance").alias("value"))
    q = M.quality(spark, fits)
    facts = [q.select(F.lit("fit").alias("part"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("deviance", "aic", "bic", "n_groups")]
    flags = [q.select(F.lit("fit").alias("part"), F.lit(c).alias("name"), F.col(c).cast("int").cast("double").alias("value")) for c in ("converged", "singular")]
    return reduce(DataFrame.unionByName, [fixed, random, *facts, *flags])


@query("mm_uncor", uses="pb", digits=3)
def mm_uncor(pb):
    return _report(pb, "y", ["time"], M.Level(("country",), (M.INTERCEPT, "time"), diagonal=True))


@query("mm_quad", uses="pb", digits=3)
def mm_quad(pb):
    return _report(pb.withColumn("time2", F.col("time") * F.col("time")), "y", ["time", "time2"], M.Level(("country",), (M.INTERCEPT, "time", "time2")))


@query("mm_rx", uses="pb", digits=3)
def mm_rx(pb):
    return _report(pb, "y", ["time", "sl_total"], M.Level(("country",), (M.INTERCEPT, "time", "sl_total")))


@query("mm_cov", uses="pn", digits=3)
def mm_cov(pn):
    """Covariates, a dummy, an interaction and a logged outcome."""
    wide = pn.where("co2 > 0").withColumns({"co2_log": F.log("co2"), "oecd_1": (F.col("oecd") == "OECD").cast("double")})
    wide = wide.withColumn("oecd_sl", F.col("oecd_1") * F.col("sl_total"))
    return _report(wide, "co2_log", ["time", "sl_total", "gdp", "oecd_1", "oecd_sl"], ONE)


@query("mm_drop_group", uses="pn", digits=3)
def mm_drop_group(pn):
    """The fit without a group, whose record is left out."""
    whole = M.Model(pn, "co2", ["time"], [ONE])
    spark, out = pn.sparkSession, []
    for name, model in (("all", whole), ("without", whole.without(F.col("country") == "NATION_3"))):
        out.append(M.estimates(spark, model.fit()).withColumn("groups", F.lit(name)).drop("fit"))
    return reduce(DataFrame.unionByName, out)


@query("mm_3level", uses="pb", digits=3)
def mm_3level(pb):
    """``(time | region/country)``: intercepts and slopes of regions, and of countries in them."""
    return _report(pb, "y", ["time"], M.nested("region", "country", (M.INTERCEPT, "time")))


@query("mm_ranef_coef", f"SELECT country, e0 AS effect_0, b0 + e0 AS coef_0, e1 AS effect_1, b1 + e1 AS coef_1 FROM {_EFFECTS} e", uses="pb", keys="country", floats="effect_0 coef_0 effect_1 coef_1", digits=3)
def mm_ranef_coef(pb):
    model, fits = _fit(pb, "y", ["time"], SLOPE)
    return model.effects(fits)


@query("mm_predict", f"SELECT country, year, b0 + b1 * time AS fixed, b0 + e0 + (b1 + e1) * time AS fitted, y - b0 - b1 * time AS residual_fixed, y - b0 - e0 - (b1 + e1) * time AS residual FROM pb JOIN {_EFFECTS} e USING (country)",
       uses="pb", keys="country, year", floats="fixed fitted residual_fixed residual", digits=3)
def mm_predict(pb):
    model, fits = _fit(pb, "y", ["time"], SLOPE)
    return M.predict(pb, model, fits).select("country", "year", "fixed", "fitted", "residual_fixed", "residual")


@query("mm_r2", f"""SELECT f / (f + tau2 + s2) AS marginal, (f + tau2) / (f + tau2 + s2) AS conditional, 1 - s2 / s2_null AS level1, 1 - tau2 / tau2_null AS level2,
 1 - (s2 + tau2) / (s2_null + tau2_null) AS total FROM (SELECT *, b1 * b1 * 175e-1 / 6 AS f FROM {_RI} r) t""", uses="pb", floats="marginal conditional level1 level2 total")
def mm_r2(pb):
    model, fits = _fit(pb, "y", ["time"], ONE)
    _, null = _fit(pb, "y", [], ONE)
    shares = M.variance_shares(model, fits[""], null[""])
    return pb.sparkSession.createDataFrame([tuple(shares.values())], ", ".join(f"{k} double" for k in shares))


@query("mm_slope_share", f"SELECT g11 / (g00 + g11 + s2 + 2 * g01) AS share FROM {_RS} r", uses="pb", floats="share")
def mm_slope_share(pb):
    _, fits = _fit(pb, "y", ["time"], SLOPE)
    return pb.sparkSession.createDataFrame([(M.slope_share(fits[""], "time"),)], "share double")


# deviances of the two models at their optimum; with two degrees of freedom the tail of chi-square is exp(-x / 2)
_DEV = f"""(SELECT 25 * (5 * ln(i.s2) + ln(i.s2 + 6 * i.tau2)) - 25 * (4 * ln(s.s2) + ln(saa * sbb - sab * sab) + ln(6 * 175e-1)) AS chi2, 150 * ln(2 * pi()) + 150 + 25 * (5 * ln(i.s2) + ln(i.s2 + 6 * i.tau2)) AS dev_ri,
 150 * ln(2 * pi()) + 150 + 25 * (4 * ln(s.s2) + ln(saa * sbb - sab * sab) + ln(6 * 175e-1)) AS dev_rs FROM {_RI} i, {_RS} s)"""


@query("mm_lrt", f"SELECT chi2, CAST(2 AS INT) AS df, exp(-chi2 / 2) AS p, dev_ri + 2 * 4 AS aic_smaller, dev_rs + 2 * 6 AS aic_larger, dev_ri + ln(150) * 4 AS bic_smaller, dev_rs + ln(150) * 6 AS bic_larger FROM {_DEV} d", uses="pb",
       keys="df", floats="chi2 p aic_smaller aic_larger bic_smaller bic_larger", digits=3)
def mm_lrt(pb):
    _, small = _fit(pb, "y", ["time"], ONE)
    _, large = _fit(pb, "y", ["time"], SLOPE)
    spark = pb.sparkSession
    sides = [M.quality(spark, f).select(F.col("aic").alias(f"aic_{n}"), F.col("bic").alias(f"bic_{n}")) for f, n in ((small, "smaller"), (large, "larger"))]
    return M.likelihood_ratio(spark, small[""], large[""]).crossJoin(sides[0]).crossJoin(sides[1])  # one row each


@query("mm_influence", f"""SELECT country, (25 * b0 - a) / 24 AS intercept, (25 * b1 - b) / 24 AS time, 25 * (sbb * d0 * d0 - 2 * sab * d0 * d1 + saa * d1 * d1) / (saa * sbb - sab * sab) / 2 AS cooks FROM
 (SELECT *, (a - b0) / 24 AS d0, (b - b1) / 24 AS d1 FROM {_LINES} l, {_RS} r) t""", uses="pb", keys="country", floats="intercept time cooks", digits=3)
def mm_influence(pb):
    model, fits = _fit(pb, "y", ["time"], SLOPE)
    return model.influence(fits).select("country", F.col("b")[0].alias("intercept"), F.col("b")[1].alias("time"), "cooks")


@query("mm_robust", uses="pb", digits=3)
def mm_robust(pb):
    model, fits = _fit(pb, "y", ["time"], ONE)
    return M.robust(pb, model, fits[""])


@query("mm_summary", f"""SELECT 'fixed' AS part, '(Intercept)' AS name, b0 AS value, sqrt(saa / 25) AS se, b0 / sqrt(saa / 25) AS z FROM {_RS} r UNION ALL SELECT 'fixed', 'time', b1, sqrt(sbb / 25), b1 / sqrt(sbb / 25) FROM {_RS} r
 UNION ALL SELECT 'sd', '(Intercept)', sqrt(g00), NULL, NULL FROM {_RS} r UNION ALL SELECT 'sd', 'time', sqrt(g11), NULL, NULL FROM {_RS} r UNION ALL SELECT 'sd', 'residual', sqrt(s2), NULL, NULL FROM {_RS} r
 UNION ALL SELECT 'correlation', 'time:(Intercept)', g01 / sqrt(g00 * g11), NULL, NULL FROM {_RS} r""", uses="pb", keys="part, name", floats="value se z", digits=3)
def mm_summary(pb):
    return M.summary(pb.sparkSession, _fit(pb, "y", ["time"], SLOPE)[1]).drop("fit", "p")


@query("mm_table", f"""SELECT t.term, ri_estimate, ri_se, rs_estimate, rs_se FROM (SELECT '(Intercept)' AS term, b0 AS ri_estimate, sqrt((tau2 + s2 / 6 + s2 * 625e-2 / 175e-1) / 25) AS ri_se FROM {_RI} r
 UNION ALL SELECT 'time', b1, sqrt(s2 / 25 / 175e-1) FROM {_RI} r UNION ALL SELECT 'aic', dev_ri + 8, NULL FROM {_DEV} d UNION ALL SELECT 'deviance', dev_ri, NULL FROM {_DEV} d UNION ALL SELECT 'sigma2', s2, NULL FROM {_RI} r) t JOIN
 (SELECT '(Intercept)' AS term, b0 AS rs_estimate, sqrt(saa / 25) AS rs_se FROM {_RS} r UNION ALL SELECT 'time', b1, sqrt(sbb / 25) FROM {_RS} r UNION ALL SELECT 'aic', dev_rs + 12, NULL FROM {_DEV} d
 UNION ALL SELECT 'deviance', dev_rs, NULL FROM {_DEV} d UNION ALL SELECT 'sigma2', s2, NULL FROM {_RS} r) u ON t.term = u.term""", uses="pb", keys="term", floats="ri_estimate ri_se rs_estimate rs_se", digits=3)
def mm_table(pb):
    fits = {"ri": _fit(pb, "y", ["time"], ONE)[1][""], "rs": _fit(pb, "y", ["time"], SLOPE)[1][""]}
    return M.side_by_side(pb.sparkSession, fits)


@query("mm_check", uses="pb", digits=3)
def mm_check(pb):
    """Predictions, linearity, spread, collinearity, normality of residuals and effects, and the predictive check, tagged by panel."""
    model, fits = _fit(pb, "y", ["time", "sl_total"], ONE)
    return G.model_check(pb, model, fits)


# ---- fits over imputations -----------------------------------------------------------------

_OLS = "(SELECT imp, regr_slope(co2, gini) AS b, sqrt((regr_syy(co2, gini) - pow(regr_sxy(co2, gini), 2) / regr_sxx(co2, gini)) / (count(*) - 2) / regr_sxx(co2, gini)) AS se, count(*) - 2 AS df FROM mi {} GROUP BY imp)"
_POOL = "(SELECT avg(b) AS estimate, sqrt(avg(se * se) + 105e-2 * var_samp(b)) AS se FROM " + _OLS + " t)"


@query("mm_coef_ztest", f"SELECT 'gini' AS term, a.estimate AS estimate_a, b.estimate AS estimate_b, (a.estimate - b.estimate) / sqrt(a.se * a.se + b.se * b.se) AS z FROM {_POOL.format('')} a, "
       + _POOL.format("WHERE oecd = 'OECD'") + " b", uses="mi", keys="term", floats="estimate_a estimate_b z", digits=3)
def mm_coef_ztest(mi):
    sides = [L.pool(L.ols(d, "co2", ["gini"], ["imp"]).where("term = 'gini'"), m=20) for d in (mi, mi.where("oecd = 'OECD'"))]
    return M.coefficient_test(*sides).select("term", "estimate_a", "estimate_b", "z")


_GRID = (0.2, 0.4, 0.6)
# one line per level with a common residual variance is the model with an interaction
_GROUPED = """(SELECT imp, oecd, count(*) AS n, avg(gini) AS mx, avg(co2) AS my, regr_slope(co2, gini) AS b, regr_sxx(co2, gini) AS sxx, regr_syy(co2, gini) - pow(regr_sxy(co2, gini), 2) / regr_sxx(co2, gini) AS rss FROM mi GROUP BY imp, oecd)"""
_MEANS = f"""SELECT oecd, x, avg(my + b * (x - mx)) AS predicted, avg(sqrt(s2 * (1e0 / n + pow(x - mx, 2) / sxx))) AS se FROM (SELECT *, sum(rss) OVER (PARTITION BY imp) / (sum(n) OVER (PARTITION BY imp) - 4) AS s2 FROM {_GROUPED} g) t,
 (SELECT unnest([2e-1, 4e-1, 6e-1]) AS x) u GROUP BY oecd, x"""


def _means(mi):
    wide = mi.withColumn("oecd_1", (F.col("oecd") == "OECD").cast("double")).withColumn("both", F.col("oecd_1") * F.col("gini"))
    fits = L.ols_fits(wide, "co2", ["gini", "oecd_1", "both"], ["imp"])
    grid = [{"oecd": o, "x": x, "at": [1.0, x, d, d * x]} for o, d in (("OECD", 1.0), ("Non-OECD", 0.0)) for x in _GRID]
    return M.grid_means(mi.sparkSession, fits, grid, "oecd string, x double")


@query("mm_emmeans", _MEANS, uses="mi", keys="oecd", floats="x predicted se", digits=3)
def mm_emmeans(mi):
    return _means(mi)


@query("fig_band", f"SELECT oecd, x, predicted, predicted - se AS low, predicted + se AS high FROM ({_MEANS}) m", uses="mi", keys="oecd", floats="x predicted low high", digits=3)
def fig_band(mi):
    return _means(mi).select("oecd", "x", "predicted", (F.col("predicted") - F.col("se")).alias("low"), (F.col("predicted") + F.col("se")).alias("high"))


@query("mi_impute", uses="pn", digits=3)
def mi_impute(pn):
    targets = {"gini": ["co2", "gdp", "sl_total", "left_right"], "left_right": ["co2", "gini", "democracy"], "democracy": ["co2", "gdp"]}
    return I.impute(pn.drop("n_total", "pop"), targets, key=["country", "year"], group="country", m=5, cycles=3, seed=1983, by_group=["democracy"])


@query("mi_confint", uses="mi", digits=3)
def mi_confint(mi):
    return I.pooled(L.ols(mi, "co2", ["gini"], ["imp"]).where("term = 'gini'"), m=20).select("term", "estimate", "low", "high")


@query("mi_pool_robust", f"""SELECT 'gini' AS term, estimate, sqrt(total) AS se, estimate / sqrt(total) AS t, 1 / (gamma * gamma / 19 + (eta + 3) / (eta * (eta + 1) * (1 - gamma))) AS df, gamma FROM
 (SELECT *, 105e-2 * b / total AS gamma FROM (SELECT avg(b) AS estimate, var_samp(b) AS b, avg(df) AS eta, avg(se * se) + 105e-2 * var_samp(b) AS total FROM {_OLS.format('')} o) p) q""", uses="mi", keys="term", floats="estimate se t df gamma", digits=3)
def mi_pool_robust(mi):
    fits = L.ols(mi, "co2", ["gini"], ["imp"]).where("term = 'gini'")
    sizes = mi.groupBy("imp").agg((F.count("*") - 2).cast("double").alias("df"))
    return I.pooled_robust(fits.join(sizes, "imp")).select("term", "estimate", "se", "t", "df", "gamma")


@query("mi_pool_varcomp", uses="mi", digits=3)
def mi_pool_varcomp(mi):
    _, fits = _fit(mi, "co2_log", ["time", "gini"], ONE, ["imp"])
    parts, stats = I.pooled_components(M.components(mi.sparkSession, fits), M.quality(mi.sparkSession, fits))
    return parts.unionByName(stats.select(F.lit("fit").alias("level"), F.explode(F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("covariance")) for c in ("deviance", "aic", "bic")])).alias("s"), "m")
                             .select("level", "s.term", "s.covariance", "m"), allowMissingColumns=True)


@query("mi_d3", uses="mi", digits=3)
def mi_d3(mi):
    small, large = _fit(mi, "co2_log", ["time"], ONE, ["imp"]), _fit(mi, "co2_log", ["time", "gini"], ONE, ["imp"])
    out = I.d3(small, large)
    return mi.sparkSession.createDataFrame([tuple(float(v) for v in out.values())], ", ".join(f"{k} double" for k in out))


# ---- distributions and figures -------------------------------------------------------------


@query("fn_dist", """SELECT country, year, exp(-co2 / 200) AS chi2_2, exp(-co2 / 200) * (1 + co2 / 200) AS chi2_4, 1 - 2 * atan(abs(sl_total - 45) / 10) / pi() AS t_1, 1 - abs(sl_total - 45) / 10 / sqrt(2 + pow((sl_total - 45) / 10, 2)) AS t_2,
 pow(1 + 2 * (gdp / 10) / 30, -15) AS f_2_30, 45 + 10 * (2 * 25e-2 - 1) / sqrt(2 * 25e-2 * (1 - 25e-2)) AS q_2 FROM pn""", uses="pn", keys="country, year", floats="chi2_2 chi2_4 t_1 t_2 f_2_30 q_2")
def fn_dist(pn):
    t = (F.col("sl_total") - 45) / 10
    return pn.select("country", "year", D.p_chi2(F.col("co2") / 100, 2).alias("chi2_2"), D.p_chi2(F.col("co2") / 100, 4).alias("chi2_4"), D.p_t(t, 1).alias("t_1"), D.p_t(t, 2).alias("t_2"),
                     D.p_f(F.col("gdp") / 10, 2, 30).alias("f_2_30"), (45 + 10 * D.q_t(0.25, 2)).alias("q_2"))


@query("fig_qq", uses="pn")
def fig_qq(pn):
    return G.qq(pn, "co2")


_BINS = 8


@query("fig_smooth", f"SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, avg(gdp) AS x, avg(co2) AS y FROM (SELECT gdp, co2, ntile({_BINS}) OVER (ORDER BY gdp, n_nationkey, year) AS bin FROM pn) t GROUP BY 1", uses="pn", keys="bin, n", floats="x y")
def fig_smooth(pn):
    return G.smooth(pn, "gdp", "co2", _BINS, ["n_nationkey", "year"])


_ROOT = "residual / sqrt(sum(residual * residual) OVER (PARTITION BY model) / (count(*) OVER (PARTITION BY model) - 1))"


@query("fig_resid_fitted", f"""SELECT model, country, year, fitted, {_ROOT} AS residual FROM (SELECT 'ri' AS model, country, year, b0 + b1 * time + u AS fitted, y - b0 - b1 * time - u AS residual FROM
 (SELECT pb.*, b0, b1, 6 * tau2 / (6 * tau2 + s2) * (avg(y) OVER (PARTITION BY country) - b0 - b1 * 25e-1) AS u FROM pb, {_RI} r) i
 UNION ALL SELECT 'rs', country, year, b0 + e0 + (b1 + e1) * time, y - b0 - e0 - (b1 + e1) * time FROM pb JOIN {_EFFECTS} e USING (country)) t""", uses="pb", keys="model, country, year", floats="fitted residual", digits=3)
def fig_resid_fitted(pb):
    out = []
    for name, level in (("ri", ONE), ("rs", SLOPE)):
        model, fits = _fit(pb, "y", ["time"], level)
        out.append(M.predict(pb, model, fits).select(F.lit(name).alias("model"), "country", "year", "fitted", "residual"))
    return G.standardised(reduce(DataFrame.unionByName, out), "residual", ["model"])


