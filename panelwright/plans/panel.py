"""Queries over joins, sets, aggregates, windows, reshaping, scalar functions, missing data and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import joins, reshape, sets, windows
from panelwright.operators import missing as M
from panelwright.operators import moments as A
from panelwright.operators import values as V
from panelwright.operators.order import quantiles, with_rank_avg
from panelwright.plans.common import query, t_p_sql
from panelwright.sources.tables import inline

_PN = dict(uses="pn", keys="country, year")
_EVEN = "SELECT country, year, gdp FROM pn WHERE year % 2 = 0"

# ---- joins ---------------------------------------------------------------------------------


@query("jn_left", f"SELECT p.country, p.year, p.co2, e.gdp FROM pn p LEFT JOIN ({_EVEN}) e ON p.country = e.country AND p.year = e.year",
       **_PN, floats="co2 gdp")
def jn_left(pn):
    even = pn.where("year % 2 = 0").select("country", "year", "gdp")
    return joins.left_join(pn.select("country", "year", "co2"), even, ["country", "year"])


@query("jn_left_renamed", "SELECT c_custkey, r_name FROM customer LEFT JOIN dim ON c_nationkey = n_nationkey", uses="@customer dim",
       keys="c_custkey, r_name")
def jn_left_renamed(customer, dim):
    return joins.left_join(customer.select("c_custkey", "c_nationkey"), dim.select("n_nationkey", "r_name"), {"c_nationkey": "n_nationkey"}).select(
        "c_custkey", "r_name")


@query("jn_natural", f"SELECT p.country, p.year, p.co2, e.gdp, 'country,year' AS used FROM pn p LEFT JOIN ({_EVEN}) e ON p.country = e.country AND p.year = e.year",
       uses="pn", keys="country, year, used", floats="co2 gdp")
def jn_natural(pn):
    out, used = joins.natural_left_join(pn.select("country", "year", "co2"), pn.where("year % 2 = 0").select("country", "year", "gdp"))
    return out.withColumn("used", F.lit(",".join(used)))


@query("jn_star", """SELECT g.country, g.year, a.co2, b.gini, c.region FROM (SELECT DISTINCT p.country, y.year FROM pn p, (SELECT DISTINCT year FROM pn) y) g
LEFT JOIN (SELECT country, year, co2 FROM pn WHERE year < 1999) a ON a.country = g.country AND a.year = g.year
LEFT JOIN (SELECT country, year, gini FROM pn WHERE gini IS NOT NULL) b ON b.country = g.country AND b.year = g.year
LEFT JOIN (SELECT DISTINCT country, region FROM pn) c ON c.country = g.country WHERE g.year BETWEEN 1995 AND 2001""", uses="pn", keys="country, year, region", floats="co2 gini")
def jn_star(pn):
    spine = joins.period_grid(pn, "country", "year", 1995, 2001)
    return joins.star(spine, pn.where("year < 1999").select("country", "year", "co2"), pn.where("gini IS NOT NULL").select("country", "year", "gini"),
                      pn.select("country", "region").distinct())


@query("jn_right", "SELECT n_name AS country, co2 FROM (SELECT country, co2 FROM pn WHERE year = 1996 AND oecd = 'OECD') p RIGHT JOIN dim ON n_name = country",
       uses="pn dim", keys="country", floats="co2")
def jn_right(pn, dim):
    some = pn.where("year = 1996 AND oecd = 'OECD'").select("country", "co2")
    return some.join(dim.select(F.col("n_name").alias("country")), "country", "right")


@query("jn_inner", "SELECT a.user_id, a.event_type FROM (SELECT DISTINCT user_id, event_type FROM ev WHERE value > 50) a JOIN "
       "(SELECT DISTINCT user_id, event_type FROM ev WHERE value <= 50) b USING (user_id, event_type)", uses="ev", keys="user_id, event_type")
def jn_inner(ev):
    def part(cond):
        return ev.where(cond).select("user_id", "event_type").distinct()

    return part("value > 50").join(part("value <= 50"), ["user_id", "event_type"])


@query("jn_full", "SELECT coalesce(a.country, b.country) AS country, a.lo, b.hi FROM (SELECT country, min(co2) AS lo FROM pn WHERE oecd = 'OECD' GROUP BY country) a "
       "FULL JOIN (SELECT country, max(gdp) AS hi FROM pn WHERE n_nationkey % 2 = 0 GROUP BY country) b ON a.country = b.country",
       uses="pn", keys="country", floats="lo hi")
def jn_full(pn):
    lo = pn.where("oecd = 'OECD'").groupBy("country").agg(F.min("co2").alias("lo"))
    return lo.join(pn.where("n_nationkey % 2 = 0").groupBy("country").agg(F.max("gdp").alias("hi")), "country", "full")


@query("jn_anti", "SELECT n_name, r_name FROM dim WHERE n_name NOT IN (SELECT country FROM pn WHERE gini > 0.5)", uses="dim pn", keys="n_name, r_name")
def jn_anti(dim, pn):
    return dim.join(pn.where("gini > 0.5").select(F.col("country").alias("n_name")), "n_name", "left_anti").select("n_name", "r_name")


@query("jn_semi", "SELECT n_name, r_name FROM dim WHERE n_name IN (SELECT country FROM pn WHERE gini > 0.5)", uses="dim pn", keys="n_name, r_name")
def jn_semi(dim, pn):
    return dim.join(pn.where("gini > 0.5").select(F.col("country").alias("n_name")), "n_name", "left_semi").select("n_name", "r_name")


@query("jn_cross", "SELECT DISTINCT country, CAST(y AS INT) AS year FROM pn, (SELECT unnest(range(1990, 2005, 3)) AS y) t", uses="pn", keys="country, year")
def jn_cross(pn):
    return joins.period_grid(pn, "country", "year", 1990, 2002, 3)


@query("jn_self", "SELECT a.region, a.year, a.v AS v_x, b.v AS v_y FROM (SELECT region, year, sum(gdp) AS v FROM pn WHERE oecd = 'OECD' GROUP BY region, year) a "
       "LEFT JOIN (SELECT region, year, sum(gdp) AS v FROM pn WHERE oecd = 'Non-OECD' GROUP BY region, year) b ON a.region = b.region AND a.year = b.year",
       uses="pn", keys="region, year", floats="v_x v_y")
def jn_self(pn):
    long = pn.groupBy("region", "year", "oecd").agg(F.sum("gdp").alias("v"))
    return joins.self_join(long, ["region", "year"], "v", "oecd", "OECD", "Non-OECD")


@query("jn_flag", "SELECT n_name, CASE WHEN n_name IN (SELECT country FROM pn WHERE gini > 0.5) THEN 'Included' ELSE 'Not included' END AS status FROM dim",
       uses="dim pn", keys="n_name, status")
def jn_flag(dim, pn):
    return joins.flag_presence(dim.select("n_name"), pn.where("gini > 0.5").select(F.col("country").alias("n_name")), ["n_name"], name="status",
                               present="Included", absent="Not included")


# ---- sets ----------------------------------------------------------------------------------


@query("set_rbind", "SELECT cnt, year, pv1 FROM sv WHERE year = 1996 UNION ALL SELECT cnt, year, pv1 FROM sv WHERE year = 1999", uses="sv", keys="cnt, year", floats="pv1")
def set_rbind(sv):
    return sets.stack(*[sv.where(F.col("year") == y).select("cnt", "year", "pv1") for y in (1996, 1999)])


@query("set_bindrows", "SELECT country, year, co2, NULL::DOUBLE AS gdp FROM pn WHERE year < 1998 UNION ALL SELECT country, year, NULL, gdp FROM pn WHERE year >= 1998",
       **_PN, floats="co2 gdp")
def set_bindrows(pn):
    return sets.stack(pn.where("year < 1998").select("country", "year", "co2"), pn.where("year >= 1998").select("country", "year", "gdp"), fill_missing=True)


@query("set_addrows", "SELECT country, year, co2 FROM pn UNION ALL SELECT 'ISLAND', year, co2 FROM pn WHERE country = 'NATION_5' UNION ALL SELECT 'REEF', 1995, 12.5e0",
       **_PN, floats="co2")
def set_addrows(pn):
    copied = sets.copy_entity(pn.select("country", "year", "co2"), "country", "NATION_5", "ISLAND")
    return sets.stack(copied, inline(pn.sparkSession, "country string, year int, co2 double", ("REEF", 1995, 12.5)))


@query("set_distinct", "SELECT DISTINCT cnt, oecd, gender FROM sv", uses="sv", keys="cnt, oecd, gender")
def set_distinct(sv):
    return sv.select("cnt", "oecd", "gender").distinct()


@query("set_distinct_first", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev) t WHERE rn = 1",
       uses="ev", keys="user_id, event_id, event_type", floats="value")
def set_distinct_first(ev):
    return sets.first_per_key(ev.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


# ---- aggregates ----------------------------------------------------------------------------


@query("agg_group_mean", "SELECT country, wave, year, avg(CASE WHEN f118 >= 0 THEN f118 END) AS f118, avg(CASE WHEN f120 >= 0 THEN f120 END) AS f120, avg(e033) AS e033 FROM it GROUP BY country, wave, year",
       uses="it", keys="country, wave, year", floats="f118 f120 e033")
def agg_group_mean(it):
    return it.groupBy("country", "wave", "year").agg(*[F.avg(V.missing_codes(F.col(c))).alias(c) for c in ("f118", "f120", "e033")])


@query("agg_all_mean", "SELECT imp, avg(co2) AS co2, avg(co2_log) AS co2_log, avg(sl_total) AS sl_total, avg(gdp) AS gdp, avg(gini) AS gini FROM mi GROUP BY imp",
       uses="mi", keys="imp", floats="co2 co2_log sl_total gdp gini")
def agg_all_mean(mi):
    return mi.groupBy("imp").agg(*[F.avg(c).alias(c) for c in ("co2", "co2_log", "sl_total", "gdp", "gini")])


@query("agg_scalar", "SELECT min(co2) AS lo, avg(co2) AS mean, max(co2) AS hi, median(co2) AS mid FROM pn", uses="pn", floats="lo mean hi mid")
def agg_scalar(pn):
    ends = pn.agg(F.min("co2").alias("lo"), F.avg("co2").alias("mean"), F.max("co2").alias("hi"))
    return ends.crossJoin(quantiles(pn, "co2", {"mid": 0.5}))  # one row each


@query("agg_count", "SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY user_id, event_type", uses="ev", keys="user_id, event_type, n")
def agg_count(ev):
    return ev.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("agg_count_of_counts", "SELECT participation, count(*) AS n FROM (SELECT user_id, count(*) AS participation FROM ev GROUP BY user_id) t GROUP BY participation",
       uses="ev", keys="participation, n")
def agg_count_of_counts(ev):
    return ev.groupBy("user_id").agg(F.count("*").alias("participation")).groupBy("participation").agg(F.count("*").alias("n"))


_CELLS = ", ".join(f"count(*) FILTER (oecd = '{o}') AS \"{o}\"" for o in ("OECD", "Non-OECD"))


@query("agg_crosstab", f"SELECT region, {_CELLS} FROM pn GROUP BY region", uses="pn", keys='region, "OECD", "Non-OECD"')
def agg_crosstab(pn):
    return A.crosstab(pn, "region", "oecd", ["OECD", "Non-OECD"])


@query("agg_totals", f"SELECT coalesce(region, 'Total') AS region, {_CELLS}, count(*) AS \"Total\" FROM pn GROUP BY ROLLUP (region)", uses="pn",
       keys='region, "OECD", "Non-OECD", "Total"')
def agg_totals(pn):
    return A.with_totals(A.crosstab(pn, "region", "oecd", ["OECD", "Non-OECD"]), "region")


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) / CAST(count(*) AS DOUBLE) AS complete_rate, avg({c}) AS mean, stddev_samp({c}) AS sd, min({c}) AS lo, "
    f"median({c}) AS mid, max({c}) AS hi, (SELECT concat_ws(',', " + ", ".join(f"count(*) FILTER ({{c}} IS NOT NULL AND least(floor((CAST({{c}} AS DOUBLE) - lo) / (hi - lo) * 8), 7) = {i})" for i in range(8)).replace("{c}", c)
    + f") FROM pn, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM pn) e) AS hist FROM pn" for c in ("co2", "gdp", "gini", "left_right"))


@query("agg_summary", _PROFILE, uses="pn", keys="variable, hist", floats="complete_rate mean sd lo mid hi")
def agg_summary(pn):
    return A.profile(pn, ["co2", "gdp", "gini", "left_right"])



@query("agg_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, (SELECT median(abs({c} - u.m)) * 1.4826e0 FROM pn, (SELECT median({c}) AS m FROM pn) u) AS mad, "
    f"median({c}) AS median, (SELECT avg(v) FROM (SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n FROM pn WHERE {c} IS NOT NULL) o WHERE i > floor(n * 1e-1) AND i <= n - floor(n * 1e-1)) AS trimmed, "
    f"min({c}) AS lo, max({c}) AS hi, max({c}) - min({c}) AS span, (SELECT avg(pow(({c} - u.a) / u.s, 3)) FROM pn, (SELECT avg({c}) AS a, stddev_pop({c}) AS s FROM pn) u) AS skew, "
    f"(SELECT avg(pow(({c} - u.a) / u.s, 4)) - 3 FROM pn, (SELECT avg({c}) AS a, stddev_pop({c}) AS s FROM pn) u) AS kurtosis, stddev_samp({c}) / sqrt(count({c})) AS se FROM pn"
    for c in ("co2", "gini")), uses="pn", keys="variable, n", floats="mean sd median trimmed mad lo hi span skew kurtosis se")
def agg_describe(pn):
    return A.describe(pn, ["co2", "gini"])


@query("agg_hist", "SELECT CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM ev WHERE value IS NOT NULL GROUP BY 1", uses="ev", keys="bin, n")
def agg_hist(ev):
    return A.histogram(ev, "value", 5.0)


@query("agg_range01", "SELECT l_orderkey, l_linenumber, (e033 - lo) / CAST(hi - lo AS DOUBLE) AS e033_scaled FROM it, (SELECT min(e033) AS lo, max(e033) AS hi FROM it) b",
       uses="it", keys="l_orderkey, l_linenumber", floats="e033_scaled")
def agg_range01(it):
    return V.min_max_scale(it.select("l_orderkey", "l_linenumber", "e033"), ["e033"]).drop("e033")


@query("agg_cor", "SELECT corr(co2, gini) AS r, count(*) FILTER (gini IS NOT NULL AND co2 IS NOT NULL) AS n FROM pn", uses="pn", keys="n", floats="r")
def agg_cor(pn):
    return A.correlations(pn, ["co2", "gini"]).select("r", "n")


_PAIRS = [(a, b) for i, a in enumerate(("co2", "gdp", "gini", "sl_total")) for b in ("co2", "gdp", "gini", "sl_total")[i + 1:]]


@query("agg_cor_matrix", "SELECT *, " + t_p_sql("t", "(n - 2)") + " AS p FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT count(*) AS n, corr({a}, {b}) AS r FROM pn WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t"
    for a, b in _PAIRS) + ") u", uses="pn", keys="x, y, n", floats="r t p")
def agg_cor_matrix(pn):
    return A.correlations(pn, ["co2", "gdp", "gini", "sl_total"])


@query("agg_cor_by_group_avg", "SELECT x, y, avg(r) AS r, avg(p) AS p FROM (SELECT *, " + t_p_sql("t", "(n - 2)") + " AS p FROM (SELECT x, y, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (" + " UNION ALL ".join(
    f"SELECT year, '{a}' AS x, '{b}' AS y, count(*) AS n, corr({a}, {b}) AS r FROM pn WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY year HAVING count(*) > 2 AND var_pop({a}) > 0 AND var_pop({b}) > 0" for a, b in _PAIRS)
    + ") c) d) e GROUP BY x, y", uses="pn", keys="x, y", floats="r p")
def agg_cor_by_group_avg(pn):
    per = A.correlations(pn, ["co2", "gdp", "gini", "sl_total"], by=["year"]).where("n > 2")
    return per.groupBy("x", "y").agg(F.avg("r").alias("r"), F.avg("p").alias("p"))


@query("agg_nested_cor", "SELECT avg(r) AS r FROM pn JOIN (SELECT region, corr(co2, gdp) AS r FROM pn GROUP BY region) c USING (region)", uses="pn", floats="r")
def agg_nested_cor(pn):
    return pn.join(A.correlations(pn, ["co2", "gdp"], by=["region"]).select("region", "r"), "region").agg(F.avg("r").alias("r"))


# ---- windows -------------------------------------------------------------------------------


@query("win_group_mean", "SELECT country, year, avg(sl_total) OVER (PARTITION BY country) AS sl_lvl2 FROM pn", **_PN, floats="sl_lvl2")
def win_group_mean(pn):
    return windows.group_stat(pn, ["country"], sl_lvl2=F.avg("sl_total")).select("country", "year", "sl_lvl2")


@query("win_within", "SELECT country, year, avg(sl_total) OVER (PARTITION BY country) AS lvl2, sl_total - avg(sl_total) OVER (PARTITION BY country) AS lvl1 FROM pn", **_PN, floats="lvl1 lvl2")
def win_within(pn):
    return windows.within_between(pn, "country", "sl_total", between="lvl2", within="lvl1").select("country", "year", "lvl1", "lvl2")


@query("win_grand_center", "SELECT country, year, co2 - avg(co2) OVER () AS co2_c, gini - avg(gini) OVER () AS gini_c FROM pn", **_PN, floats="co2_c gini_c")
def win_grand_center(pn):
    return windows.centre(pn, ["co2", "gini"]).select("country", "year", "co2_c", "gini_c")


@query("win_lead", "SELECT country, year, lead(co2, 1) OVER w AS co2_lead1, lead(co2, 3) OVER w AS co2_lead3 FROM pn WINDOW w AS (PARTITION BY country ORDER BY year)", **_PN,
       floats="co2_lead1 co2_lead3")
def win_lead(pn):
    return windows.lead(pn, "co2", ["country"], ["year"], (1, 3)).select("country", "year", "co2_lead1", "co2_lead3")


@query("win_fill", """SELECT country, year, coalesce(last_value(left_right IGNORE NULLS) OVER (PARTITION BY country ORDER BY year),
 first_value(left_right IGNORE NULLS) OVER (PARTITION BY country ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS left_right FROM pn""", **_PN, floats="left_right")
def win_fill(pn):
    return windows.fill(pn, ["left_right"], ["country"], ["year"]).select("country", "year", "left_right")


@query("win_add_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM ev", uses="ev", keys="event_id, n")
def win_add_count(ev):
    return windows.group_stat(ev, ["user_id"], n=F.count("*")).select("event_id", "n")


_RANKED = """SELECT user_id, mean, rank() OVER (ORDER BY mean DESC) + (count(*) OVER (PARTITION BY mean) - 1) / 2e0 AS rank
 FROM (SELECT user_id, avg(value) AS mean FROM ev GROUP BY user_id) t"""


@query("win_rank_avg", _RANKED, uses="ev", keys="user_id", floats="mean rank")
def win_rank_avg(ev):
    return with_rank_avg(ev.groupBy("user_id").agg(F.avg("value").alias("mean")), "mean")


@query("win_topk_flag", f"SELECT user_id, CASE WHEN rank <= 20 THEN user_id END AS shown FROM ({_RANKED}) r", uses="ev", keys="user_id, shown")
def win_topk_flag(ev):
    ranked = with_rank_avg(ev.groupBy("user_id").agg(F.avg("value").alias("mean")), "mean")
    return ranked.select("user_id", F.when(F.col("rank") <= 20, F.col("user_id")).alias("shown"))


@query("win_unfill", "SELECT country, year, CASE WHEN region IS DISTINCT FROM lag(region) OVER (ORDER BY region, country, year) THEN region END AS region FROM pn", uses="pn",
       keys="country, year, region")
def win_unfill(pn):
    return windows.unfill(pn.select("country", "year", "region", F.col("region").alias("r")), "region", ["r", "country", "year"]).drop("r")


@query("win_period_mean", "SELECT country, year, avg(co2) OVER (PARTITION BY year) AS mean FROM pn", **_PN, floats="mean")
def win_period_mean(pn):
    return windows.group_stat(pn, ["year"], mean=F.avg("co2")).select("country", "year", "mean")


@query("win_status_change", "SELECT event_id, CASE WHEN lo = hi THEN lo ELSE 'Both' END AS status FROM ev JOIN (SELECT user_id, min(event_type) AS lo, max(event_type) AS hi FROM ev GROUP BY user_id) g USING (user_id)",
       uses="ev", keys="event_id, status")
def win_status_change(ev):
    return ev.join(windows.constant_or(ev, ["user_id"], "event_type", "Both", name="status"), "user_id").select("event_id", "status")


# ---- sorts, reshape ------------------------------------------------------------------------


@query("srt_arrange", "SELECT country, year, co2 FROM pn ORDER BY country, year DESC", **_PN, floats="co2")
def srt_arrange(pn):
    return pn.select("country", "year", "co2").orderBy("country", F.desc("year"))


@query("srt_levels", "SELECT p.country, p.year, l.level FROM pn p JOIN (SELECT country, row_number() OVER (ORDER BY avg(sl_total), country) AS level FROM pn GROUP BY country) l ON p.country = l.country",
       uses="pn", keys="country, year, level")
def srt_levels(pn):
    return reshape.level_order(pn, "country", F.avg("sl_total")).select("country", "year", "level")




@query("rsh_longer", " UNION ALL ".join(f"SELECT country, 'x{y}' AS year, x{y} AS value FROM wd" for y in range(1995, 2002)), uses="wd", keys="country, year", floats="value")
def rsh_longer(wd):
    return reshape.longer(wd, [f"x{y}" for y in range(1995, 2002)], names_to="year")


@query("rsh_wider", "SELECT country, " + ", ".join(f"max(CASE WHEN year = {y} THEN {v} END) AS {v}_{y}" for v in ("co2", "gdp") for y in range(1995, 2002)) + " FROM pn GROUP BY country",
       uses="pn", keys="country", floats=" ".join(f"{v}_{y}" for v in ("co2", "gdp") for y in range(1995, 2002)))
def rsh_wider(pn):
    return reshape.wider(pn, ["country"], "year", list(range(1995, 2002)), ["co2", "gdp"])


@query("rsh_explode", "SELECT variable, unnest(string_split(categories, chr(10))) AS item FROM cb", uses="cb", keys="variable, item")
def rsh_explode(cb):
    return reshape.explode_cell(cb, "categories", "\n").withColumnRenamed("categories", "item")


@query("rsh_year_names", " UNION ALL ".join(f"SELECT country, CAST({y} AS INT) AS year, x{y} AS value FROM wd" for y in range(1996, 2001)), uses="wd", keys="country, year", floats="value")
def rsh_year_names(wd):
    return reshape.years_longer(wd, 1996, 2000)


# ---- scalar functions ----------------------------------------------------------------------


@query("fn_str", """SELECT n_nationkey, concat(n_name, '-', r_name) AS joined, replace(n_name, 'NATION_', '') AS cut, regexp_replace(r_name, '[AEIOU]', '*', 'g') AS masked,
 trim(regexp_replace('  ' || r_name || '   x ', '\\s+', ' ', 'g')) AS squished, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM dim""",
       uses="dim", keys="n_nationkey, joined, cut, masked, squished, title")
def fn_str(dim):
    r = F.col("r_name")
    return dim.select("n_nationkey", F.concat("n_name", F.lit("-"), r).alias("joined"), F.regexp_replace("n_name", "NATION_", "").alias("cut"),
                      F.regexp_replace(r, "[AEIOU]", "*").alias("masked"),
                      F.trim(F.regexp_replace(F.concat(F.lit("  "), r, F.lit("   x ")), r"\s+", " ")).alias("squished"), F.initcap(r).alias("title"))


@query("fn_num", "SELECT country, year, ln(co2) AS log_co2, exp(gini) AS exp_gini, sqrt(gdp) AS root, abs(sl_total - 40) AS off, pow(co2, 2) AS square FROM pn", **_PN,
       floats="log_co2 exp_gini root off square")
def fn_num(pn):
    return pn.select("country", "year", F.log("co2").alias("log_co2"), F.exp("gini").alias("exp_gini"), F.sqrt("gdp").alias("root"),
                     F.abs(F.col("sl_total") - 40).alias("off"), F.pow("co2", 2).alias("square"))


@query("fn_parse", "SELECT n_nationkey, CAST(regexp_extract(n_name, '[0-9]+') AS DOUBLE) AS num FROM dim", uses="dim", keys="n_nationkey", floats="num")
def fn_parse(dim):
    return dim.select("n_nationkey", reshape.parse_number(F.regexp_replace("n_name", "_", " ")).alias("num"))


@query("fn_cast", "SELECT country, year, CAST(year AS VARCHAR) AS text, TRY_CAST(country AS INT) AS no_number, CAST(n_total AS DOUBLE) AS n FROM pn", uses="pn",
       keys="country, year, text, no_number", floats="n")
def fn_cast(pn):
    return pn.select("country", "year", F.col("year").cast("string").alias("text"), F.col("country").try_cast("int").alias("no_number"),
                     F.col("n_total").cast("double").alias("n"))


@query("fn_fmt", "SELECT country, year, CAST(CAST(round(100 * gini) AS INT) AS VARCHAR) || '%' AS share, CASE WHEN gini < 0.3 THEN '< 0.3' ELSE 'more' END AS shown, "
       "format('{:,}', n_total * 1000) AS comma FROM pn", uses="pn", keys="country, year, share, shown, comma")
def fn_fmt(pn):
    return pn.select("country", "year", F.concat(F.round(F.col("gini") * 100).cast("int").cast("string"), F.lit("%")).alias("share"),
                     F.when(F.col("gini") < 0.3, "< 0.3").otherwise("more").alias("shown"), F.format_number(F.col("n_total") * 1000, 0).alias("comma"))


@query("fn_seq", "SELECT country, CAST(unnest(range(lo, hi + 1, 2)) AS INT) AS year FROM (SELECT country, min(year) AS lo, max(year) AS hi FROM pn GROUP BY country) t", uses="pn", keys="country, year")
def fn_seq(pn):
    ends = pn.groupBy("country").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return ends.select("country", F.explode(F.sequence("lo", "hi", F.lit(2))).alias("year"))


# ---- missing data --------------------------------------------------------------------------

_VARS = ("co2", "gini", "left_right", "democracy")


@query("na_glimpse", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS missing, 100e0 * (count(*) - count({c})) / count(*) AS percent FROM pn" for c in _VARS),
       uses="pn", keys="variable, n, missing", floats="percent")
def na_glimpse(pn):
    return M.glimpse(pn, _VARS)


@query("na_pattern", "SELECT " + ", ".join(f"CAST({c} IS NULL AS INT) AS {c}" for c in _VARS) + ", count(*) AS n FROM pn GROUP BY 1, 2, 3, 4", uses="pn", keys=", ".join(_VARS) + ", n")
def na_pattern(pn):
    return M.pattern(pn, _VARS)


@query("na_pairs", " UNION ALL ".join(
    f"SELECT '{x}' AS variable, '{y}' AS split_by, {y} IS NULL AS missing, count({x}) AS n, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS mid, quantile_cont({x}, 0.75) AS q3 FROM pn WHERE {x} IS NOT NULL GROUP BY {y} IS NULL"
    for x in ("co2", "gdp") for y in ("gini", "left_right")), uses="pn", keys="variable, split_by, missing, n", floats="q1 mid q3")
def na_pairs(pn):
    return M.pairs(pn, ["co2", "gdp"], ["gini", "left_right"])


@query("na_compare", " UNION ALL ".join(
    f"SELECT '{x}' AS variable, avg({x}) FILTER (gini IS NULL) AS mean_missing, avg({x}) FILTER (gini IS NOT NULL) AS mean_observed, "
    f"(avg({x}) FILTER (gini IS NULL) - avg({x}) FILTER (gini IS NOT NULL)) / sqrt(var_samp({x}) FILTER (gini IS NULL) / count({x}) FILTER (gini IS NULL) + "
    f"var_samp({x}) FILTER (gini IS NOT NULL) / count({x}) FILTER (gini IS NOT NULL)) AS t FROM pn" for x in ("co2", "gdp")), uses="pn", keys="variable", floats="mean_missing mean_observed t")
def na_compare(pn):
    return M.compare(pn, "gini", ["co2", "gdp"])


@query("na_compare_counts", """SELECT 'region' AS variable, chi2, df, exp(-chi2 / 2) * (1 + chi2 / 2) AS p FROM (SELECT sum(pow(gone - n * g / t, 2) / (n * g / t) + pow(gone - n * g / t, 2) / (n - n * g / t)) AS chi2, count(*) - 1 AS df FROM
 (SELECT region, count(*) FILTER (gini IS NULL) AS gone, count(*) AS n, sum(count(*) FILTER (gini IS NULL)) OVER () AS g, CAST(sum(count(*)) OVER () AS DOUBLE) AS t FROM pn GROUP BY region) c) x""", uses="pn", keys="variable, df", floats="chi2 p")
def na_compare_counts(pn):
    return M.compare_counts(pn, "gini", "region")


# ---- figures and texts ---------------------------------------------------------------------


@query("fig_mean_line", "SELECT year, country AS line, avg(co2) AS y FROM pn GROUP BY year, country UNION ALL SELECT year, 'all', avg(co2) FROM pn GROUP BY year", uses="pn", keys="year, line", floats="y")
def fig_mean_line(pn):
    lines = pn.groupBy("year", F.col("country").alias("line")).agg(F.avg("co2").alias("y"))
    return lines.unionByName(pn.groupBy("year").agg(F.avg("co2").alias("y")).withColumn("line", F.lit("all")))


@query("fig_scatter", "SELECT country, year, oecd, pop, co2 FROM pn WHERE co2 IS NOT NULL AND gini IS NOT NULL", uses="pn", keys="country, year, oecd, pop", floats="co2")
def fig_scatter(pn):
    return pn.dropna(subset=["co2", "gini"]).select("country", "year", "oecd", "pop", "co2")


_MEASURES = ("co2", "gdp", "gini")


@query("fig_scatter_pairs", " UNION ALL ".join(f"SELECT country, year, '{a}' AS x_name, '{b}' AS y_name, {a} AS x, {b} AS y FROM pn WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
       for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]), uses="pn", keys="country, year, x_name, y_name", floats="x y")
def fig_scatter_pairs(pn):
    """Points of every pair of measures, from one pass over the rows."""
    pairs = [F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]]
    return pn.select("country", "year", F.explode(F.array(*pairs)).alias("r")).select("country", "year", "r.*").dropna(subset=["x", "y"])


@query("fig_quadrant", "SELECT country, year, CASE WHEN co2 > mx THEN 'high' ELSE 'low' END || '-' || CASE WHEN gdp > my THEN 'high' ELSE 'low' END AS quadrant "
       "FROM pn, (SELECT avg(co2) AS mx, avg(gdp) AS my FROM pn) m", uses="pn", keys="country, year, quadrant")
def fig_quadrant(pn):
    centred = windows.centre(pn, ["co2", "gdp"])
    side = {c: F.when(F.col(f"{c}_c") > 0, "high").otherwise("low") for c in ("co2", "gdp")}
    return centred.select("country", "year", F.concat_ws("-", side["co2"], side["gdp"]).alias("quadrant"))


@query("fig_stacked_share", "SELECT region, oecd, count(*) / CAST(sum(count(*)) OVER (PARTITION BY region) AS DOUBLE) AS share FROM pn GROUP BY region, oecd", uses="pn", keys="region, oecd", floats="share")
def fig_stacked_share(pn):
    cells = pn.groupBy("region", "oecd").agg(F.count("*").alias("n"))
    return cells.join(cells.groupBy("region").agg(F.sum("n").alias("all")), "region").select("region", "oecd", (F.col("n") / F.col("all")).alias("share"))


@query("tx_extract_libs", r"""SELECT DISTINCT trim(regexp_replace(regexp_replace(line, '^.*token = "', ''), '".*$', '')) AS name FROM
 (SELECT unnest(string_split(text, chr(10))) AS line FROM tx) t WHERE regexp_matches(line, 'token = "')""", uses="tx", keys="name")
def tx_extract_libs(tx):
    lines = tx.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike('token = "'))
    return lines.select(F.trim(F.regexp_replace(F.regexp_replace("line", '^.*token = "', ""), '".*$', "")).alias("name")).distinct()


@query("tx_cited_only", """SELECT p_partkey FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS cite FROM part) p WHERE cite IN
 (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+')) FROM tx)""", uses="@part tx", keys="p_partkey")
def tx_cited_only(part, tx):
    cited = tx.select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("cite")).distinct()
    return part.select("p_partkey", F.col("p_partkey").cast("string").alias("cite")).join(cited, "cite", "left_semi").select("p_partkey")
