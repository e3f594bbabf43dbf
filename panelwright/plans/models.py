"""Queries over survey estimates, scales, linear and random-intercept models, and pooled imputations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.dist import p_t
from panelwright.operators import factors as FA
from panelwright.operators import models as L
from panelwright.operators import sets
from panelwright.operators import survey as S
from panelwright.operators import values as V
from panelwright.operators.windows import running_mean
from panelwright.plans.common import determinant_sql, query, t_p_sql

PVS, RWS = [f"pv{i}" for i in range(1, 6)], [f"rw{i}" for i in range(1, 5)]
_MEAN = "(" + " + ".join(f"sum(w*{v})/sum(w)" for v in PVS) + ")/5"
_FULL = dict(by=["cnt", "year"], values=PVS, weight="w")


@query("sv_pv_mean", f"SELECT cnt, year, count(*) AS freq, {_MEAN} AS mean FROM sv GROUP BY cnt, year", uses="sv", keys="cnt, year, freq", floats="mean")
def sv_pv_mean(sv):
    return S.pv_mean(sv, **_FULL)


_SE = ", ".join(f"sum({w}*{v})/sum({w}) AS m_{v}_{w}" for v in PVS for w in ["w", *RWS])
_U = "(" + " + ".join(f"pow(m_{v}_{w} - m_{v}_w, 2)" for v in PVS for w in RWS) + ")/(5*4*25e-2)"
_M = "(" + " + ".join(f"m_{v}_w" for v in PVS) + ")/5"
_B = "(" + " + ".join(f"pow(m_{v}_w - {_M}, 2)" for v in PVS) + ")/4"


@query("sv_pv_se", f"SELECT cnt, year, freq, {_M} AS mean, sqrt({_U} + 12e-1*{_B}) AS se FROM (SELECT cnt, year, count(*) AS freq, {_SE} FROM sv GROUP BY cnt, year) t",
       uses="sv", keys="cnt, year, freq", floats="mean se")
def sv_pv_se(sv):
    return S.pv_se(sv, replicates=RWS, **_FULL)


@query("sv_by_subgroup", f"SELECT cnt, gender, year, count(*) AS freq, {_MEAN} AS mean FROM sv WHERE gender <> 'NA' GROUP BY cnt, gender, year", uses="sv",
       keys="cnt, gender, year, freq", floats="mean")
def sv_by_subgroup(sv):
    return S.pv_mean(sv.where("gender <> 'NA'"), ["cnt", "gender", "year"], PVS, "w")


def _part(g):
    return "(" + " + ".join(f"sum(w*{v}) FILTER (gender = '{g}')/sum(w) FILTER (gender = '{g}')" for v in PVS) + ")/5"


@query("sv_cycle_stack", f"SELECT cnt, year, count(*) AS n_total, {_MEAN} AS total, {_part('Female')} AS female, {_part('Male')} AS male FROM sv GROUP BY cnt, year",
       uses="sv", keys="cnt, year, n_total", floats="total female male")
def sv_cycle_stack(sv):
    return S.cycle(sv, PVS, "w", entity="cnt", group="gender", levels=["Female", "Male"], period="year")


@query("sv_dim_weights", "SELECT DISTINCT cnt, oecd, year FROM sv", uses="sv", keys="cnt, oecd, year")
def sv_dim_weights(sv):
    return sv.select("cnt", "oecd", "year").distinct()


_YEARS = list(range(1995, 2002))


@query("sv_participation", "SELECT cnt, " + ", ".join(f"CAST(max(CASE WHEN year = {y} THEN 1 ELSE 0 END) AS INT) AS in_{y}" for y in _YEARS)
       + ", CAST(count(DISTINCT year) AS INT) AS times FROM (SELECT * FROM sv WHERE pv1 > 400) s GROUP BY cnt", uses="sv", keys="cnt, " + ", ".join(f"in_{y}" for y in _YEARS) + ", times")
def sv_participation(sv):
    return S.participation(sv.where("pv1 > 400"), "cnt", "year", _YEARS)


# ---- scales --------------------------------------------------------------------------------

_ITEMS = ["f118", "f120", "e033"]
_CLEAN = "(SELECT * FROM it WHERE f118 >= 0 AND f120 >= 0)"


def _clean(it):
    return it.select("country", "year", *[V.missing_codes(F.col(c)).cast("double").alias(c) for c in _ITEMS])


@query("sc_composite", """SELECT country, year, avg(score) AS score FROM (SELECT country, year, (coalesce(CASE WHEN f118 >= 0 THEN f118 END, 0) + coalesce(CASE WHEN f120 >= 0 THEN f120 END, 0) + e033)
 / CAST(CAST(f118 >= 0 AS INT) + CAST(f120 >= 0 AS INT) + 1 AS DOUBLE) AS score FROM it) t GROUP BY country, year""", uses="it", keys="country, year", floats="score")
def sc_composite(it):
    return _clean(it).withColumn("score", V.row_mean(*_ITEMS)).groupBy("country", "year").agg(F.avg("score").alias("score"))


@query("sc_alpha", f"SELECT 15e-1 * (1 - (var_samp(f118) + var_samp(f120) + var_samp(e033)) / var_samp(f118 + f120 + e033)) AS alpha, count(*) AS n FROM {_CLEAN} t", uses="it", keys="n", floats="alpha")
def sc_alpha(it):
    return S.alpha(_clean(it), _ITEMS)


_R = f"(SELECT count(*) AS n, corr(f118, f120) AS a, corr(f118, e033) AS b, corr(f120, e033) AS c FROM {_CLEAN} s)"


@query("sc_bartlett", f"SELECT -(n - 1 - 11/6e0) * ln(1 + 2*a*b*c - a*a - b*b - c*c) AS chi2, CAST(3 AS INT) AS df, n FROM {_R} t", uses="it", keys="df, n", floats="chi2", digits=3)
def sc_bartlett(it):
    return S.adequacy(_clean(it), _ITEMS).select("chi2", "df", "n")


@query("sc_kmo", f"""SELECT (a*a + b*b + c*c) / (a*a + b*b + c*c + pow(a - b*c, 2)/((1 - b*b)*(1 - c*c)) + pow(b - a*c, 2)/((1 - a*a)*(1 - c*c)) + pow(c - a*b, 2)/((1 - a*a)*(1 - b*b))) AS kmo FROM {_R} t""",
       uses="it", floats="kmo")
def sc_kmo(it):
    return S.adequacy(_clean(it), _ITEMS).select("kmo")


# the three roots of the characteristic polynomial, by angles
@query("sc_eigen", f"""SELECT CAST(k + 1 AS INT) AS factor, 1 + 2 * sqrt(q / 3) * cos(acos(a * b * c / pow(q / 3, 15e-1)) / 3 - 2 * pi() * k / 3) AS value
 FROM (SELECT *, a*a + b*b + c*c AS q FROM {_R} t) u, (SELECT unnest([0, 1, 2]) AS k) w""", uses="it", keys="factor", floats="value")
def sc_eigen(it):
    return S.eigenvalues(_clean(it), _ITEMS)


_MANY = ["f118", "f120", "c001", "e033", "e143", "e224"]


def _many(it):
    return it.select("l_orderkey", "l_linenumber", *[V.missing_codes(F.col(c)).cast("double").alias(c) for c in _MANY])


@query("sc_fa", uses="it", digits=3)
def sc_fa(it):
    return FA.loadings(it.sparkSession, FA.analyse(_many(it), _MANY, 2))


@query("sc_fa_scores", uses="it", digits=3)
def sc_fa_scores(it):
    items = _many(it)
    return FA.scores(items, FA.analyse(items, _MANY, 2)).select("l_orderkey", "l_linenumber", "score_1", "score_2")


@query("sc_fa_table", uses="it", digits=3)
def sc_fa_table(it):
    return FA.loading_table(FA.loadings(it.sparkSession, FA.analyse(_many(it), _MANY, 2)), 2)


# ---- linear models -------------------------------------------------------------------------


_SIMPLE = """(SELECT *, sqrt(rss / df / sxx) AS se1, sqrt(rss / df * (1e0 / n + mx * mx / sxx)) AS se0 FROM (SELECT count(*) AS n, count(*) - 2 AS df, regr_intercept(co2, gdp) AS b0, regr_slope(co2, gdp) AS b1, avg(gdp) AS mx, regr_sxx(co2, gdp) AS sxx,
 regr_syy(co2, gdp) - pow(regr_sxy(co2, gdp), 2) / regr_sxx(co2, gdp) AS rss FROM pn) s)"""


@query("lm_ols", f"SELECT term, estimate, se, t, {t_p_sql('t', 'df')} AS p FROM (SELECT '(Intercept)' AS term, b0 AS estimate, se0 AS se, b0 / se0 AS t, df FROM {_SIMPLE} a UNION ALL SELECT 'gdp', b1, se1, b1 / se1, df FROM {_SIMPLE} a) u",
       uses="pn", keys="term", floats="estimate se t p")
def lm_ols(pn):
    n = pn.dropna(subset=["co2", "gdp"]).agg((F.count("*") - 2).alias("df"))
    return L.ols(pn, "co2", ["gdp"]).crossJoin(F.broadcast(n)).withColumn("p", p_t("t", "df")).drop("df")  # one row


@query("lm_by_group", "SELECT country, regr_intercept(co2, time) AS intercept, regr_slope(co2, time) AS slope FROM pn GROUP BY country", uses="pn", keys="country", floats="intercept slope")
def lm_by_group(pn):
    fits = L.ols(pn, "co2", ["time"], ["country"])
    return fits.groupBy("country").agg(F.max(F.when(F.col("term") == "time", F.col("estimate"))).alias("slope"),
                                       F.max(F.when(F.col("term") != "time", F.col("estimate"))).alias("intercept"))


@query("lm_vif", """SELECT unnest(['gdp', 'gini', 'sl_total']) AS term, unnest([(1 - c*c)/d, (1 - b*b)/d, (1 - a*a)/d]) AS vif, unnest([d/(1 - c*c), d/(1 - b*b), d/(1 - a*a)]) AS tolerance FROM (SELECT *, 1 + 2*a*b*c - a*a - b*b - c*c AS d FROM
 (SELECT corr(gdp, gini) AS a, corr(gdp, sl_total) AS b, corr(gini, sl_total) AS c FROM pn WHERE gini IS NOT NULL) r) t""", uses="pn", keys="term", floats="vif tolerance")
def lm_vif(pn):
    return L.vif(pn, ["gdp", "gini", "sl_total"])


@query("lm_cond_index", uses="pn")
def lm_cond_index(pn):
    return L.condition_index(pn, ["gdp", "gini", "sl_total"])


_SPECS = {"a": ["gdp", "gini"], "b": ["gdp", "gini", "sl_total"], "c": ["gdp", "gini", "sl_total", "time"]}


def _vifs(name: str) -> str:
    xs = _SPECS[name]
    cells = [["1e0" if a == b else f"r_{min(a, b)}_{max(a, b)}" for b in xs] for a in xs]
    whole = determinant_sql(cells)
    minors = [determinant_sql([r[:i] + r[i + 1:] for k, r in enumerate(cells) if k != i]) for i in range(len(xs))]
    sums = ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for a in xs for b in xs if a < b)
    return f"(SELECT unnest([{', '.join(repr(x) for x in xs)}]) AS term, unnest([{', '.join(f'{m} / {whole}' for m in minors)}]) AS vif_{name} FROM (SELECT {sums} FROM pn WHERE gini IS NOT NULL) r)"


@query("lm_vif_compare", f"SELECT c.term, vif_a, vif_b, vif_c FROM {_vifs('c')} c LEFT JOIN {_vifs('b')} b ON b.term = c.term LEFT JOIN {_vifs('a')} a ON a.term = c.term", uses="pn", keys="term", floats="vif_a vif_b vif_c")
def lm_vif_compare(pn):
    out = None
    for name, xs in _SPECS.items():
        one = L.vif(pn, xs).select("term", F.col("vif").alias(f"vif_{name}"))
        out = one if out is None else out.join(one, "term", "full")
    return out


# ---- random intercept ----------------------------------------------------------------------

_RI = """SELECT slope AS time, (SELECT avg(y) FROM pb) - slope * 25e-1 AS intercept, (6 * between_ / 25 - s2) / 6 AS tau2, s2 AS sigma2 FROM
 (SELECT slope, between_, (within_ - slope * slope * 25 * 175e-1) / 125 AS s2 FROM (SELECT sum((time - 25e-1) * (y - m)) / (25 * 175e-1) AS slope, sum(pow(y - m, 2)) AS within_,
 max(b) AS between_ FROM (SELECT *, avg(y) OVER (PARTITION BY country) AS m FROM pb) p, (SELECT sum(pow(m - g, 2)) AS b FROM (SELECT avg(y) AS m FROM pb GROUP BY country) k, (SELECT avg(y) AS g FROM pb) a) q) r) u"""


@query("mm_ri", f"SELECT *, sqrt((tau2 + sigma2 / 6 + sigma2 * 625e-2 / 175e-1) / 25) AS se_intercept, sqrt(sigma2 / 25 / 175e-1) AS se_time FROM ({_RI}) f", uses="pb", floats="intercept time se_intercept se_time tau2 sigma2", digits=3)
def mm_ri(pb):
    return L.random_intercept(pb, "y", ["time"], "country").select("intercept", "time", "se_intercept", "se_time", "tau2", "sigma2")


@query("mm_icc", f"SELECT tau2 / (tau2 + sigma2) AS icc FROM ({_RI}) f", uses="pb", floats="icc")
def mm_icc(pb):
    return L.random_intercept(pb, "y", ["time"], "country").select((F.col("tau2") / (F.col("tau2") + F.col("sigma2"))).alias("icc"))


@query("mm_deff", f"SELECT 1 + 5 * tau2 / (tau2 + sigma2) AS deff FROM ({_RI}) f", uses="pb", floats="deff")
def mm_deff(pb):
    fit = L.random_intercept(pb, "y", ["time"], "country")
    return fit.select((1 + (F.col("n_rows") / F.col("n_groups") - 1) * F.col("tau2") / (F.col("tau2") + F.col("sigma2"))).alias("deff"))


@query("mm_plausible_interval", f"SELECT intercept - 196e-2 * sqrt(tau2) AS low, intercept + 196e-2 * sqrt(tau2) AS high FROM ({_RI}) f", uses="pb", floats="low high", digits=3)
def mm_plausible_interval(pb):
    reach = 1.96 * F.sqrt("tau2")
    return L.random_intercept(pb, "y", ["time"], "country").select((F.col("intercept") - reach).alias("low"), (F.col("intercept") + reach).alias("high"))


# ---- imputations ---------------------------------------------------------------------------


@query("mi_stack", "SELECT imp, country, year, gini FROM mi UNION ALL SELECT 0, country, year, gini FROM pn", uses="mi pn", keys="imp, country, year", floats="gini")
def mi_stack(mi, pn):
    observed = pn.select(F.lit(0).cast(mi.schema["imp"].dataType).alias("imp"), "country", "year", "gini")
    return sets.stack(mi.select("imp", "country", "year", "gini"), observed)


@query("mi_filter_rescale", "SELECT imp, country, year, gini * 100 AS gini FROM mi WHERE country <> 'NATION_3'", uses="mi", keys="imp, country, year", floats="gini")
def mi_filter_rescale(mi):
    return mi.where("country <> 'NATION_3'").select("imp", "country", "year", (F.col("gini") * 100).alias("gini"))


_FIT = "(SELECT imp, regr_slope(co2, gini) AS b, sqrt((regr_syy(co2, gini) - pow(regr_sxy(co2, gini), 2) / regr_sxx(co2, gini)) / (count(*) - 2) / regr_sxx(co2, gini)) AS se FROM mi GROUP BY imp)"


@query("mi_fit", f"SELECT imp, b AS estimate, se FROM {_FIT} t", uses="mi", keys="imp", floats="estimate se", digits=3)
def mi_fit(mi):
    return L.ols(mi, "co2", ["gini"], ["imp"]).where("term = 'gini'").select("imp", "estimate", "se")


@query("mi_pool", f"""SELECT estimate, se, estimate / se AS t, 19 * pow(1 + 1/riv, 2) AS dof, riv, (riv + 2 / (19 * pow(1 + 1/riv, 2) + 3)) / (riv + 1) AS fmi FROM (SELECT avg(b) AS estimate, sqrt(avg(se*se) + 105e-2 * var_samp(b)) AS se,
 105e-2 * var_samp(b) / avg(se*se) AS riv FROM {_FIT} t) p""", uses="mi", floats="estimate se t dof riv fmi", digits=3)
def mi_pool(mi):
    return L.pool(L.ols(mi, "co2", ["gini"], ["imp"]).where("term = 'gini'"), m=20).drop("term")


@query("mi_gr", """SELECT chains, sqrt(((len - 1) / len * w + b) / w) AS rhat FROM (SELECT count(*) AS chains, avg(v) AS w, var_samp(m) AS b, avg(n) AS len FROM
 (SELECT user_id, avg(value) AS m, var_samp(value) AS v, count(value) AS n FROM ev GROUP BY user_id HAVING count(value) > 1) c) t""", uses="ev", keys="chains", floats="rhat")
def mi_gr(ev):
    return L.gelman_rubin(ev, "user_id", "value")


_DRAWS = "(SELECT user_id, event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS so_far, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS draw FROM ev)"


def _draws(ev):
    return running_mean(ev, "value", ["user_id"], ["ts", "event_id"], name="so_far", position="draw")


@query("mi_mcerror", f"""SELECT user_id, batches, error / sd AS ratio FROM (SELECT user_id, count(*) AS batches, sqrt(var_samp(m) / count(*)) AS error FROM (SELECT user_id, (draw - 1) // 5 AS batch, avg(value) AS m FROM {_DRAWS} d GROUP BY 1, 2) b GROUP BY user_id
 HAVING count(*) > 1) e JOIN (SELECT user_id, stddev_samp(value) AS sd FROM ev GROUP BY user_id) s USING (user_id) WHERE sd > 0""", uses="ev", keys="user_id, batches", floats="ratio")
def mi_mcerror(ev):
    return L.monte_carlo_error(_draws(ev), "user_id", "value", "draw", 5)


@query("mi_trace", f"SELECT event_id, so_far, draw FROM {_DRAWS} d", uses="ev", keys="event_id, draw", floats="so_far")
def mi_trace(ev):
    """Every draw of a chain with the mean so far."""
    return _draws(ev).select("event_id", "so_far", "draw")


@query("mi_density", "SELECT user_id, CAST(floor(value / 20) AS BIGINT) AS bin, count(*) / (20e0 * sum(count(*)) OVER (PARTITION BY user_id)) AS density FROM ev WHERE value IS NOT NULL GROUP BY 1, 2", uses="ev", keys="user_id, bin", floats="density")
def mi_density(ev):
    """Density of a chain's draws in bins of one width."""
    return L.densities(ev, "user_id", "value", 20.0)
