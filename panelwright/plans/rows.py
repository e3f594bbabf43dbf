"""Queries over sources, columns, row-wise values and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelwright.operators import columns as C
from panelwright.operators import filters, joins
from panelwright.operators import values as V
from panelwright.operators.order import with_position
from panelwright.operators.reshape import parse_number
from panelwright.plans.common import query
from panelwright.session import scratch_dir
from panelwright.sources.delimited import read_delimited
from panelwright.sources.tables import inline, load_table, read_lines, save_tables

YEARS = ["x1995", "x1996", "x1997", "x1998", "x1999", "x2000", "x2001"]


def _folder(df, name: str) -> str:
    return f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks ---------------------------------------------------------------------

@query("src_survey", "SELECT sv.*, n.n_name AS country FROM sv JOIN nation n ON n_nationkey = c_nationkey",
       uses="sv @nation", keys="l_orderkey, l_linenumber, country, year, gender, oecd", floats="w pv1 pv5")
def src_survey(sv, nation):
    labels = nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return V.decode(sv, "c_nationkey", labels, into="country").select(
        "l_orderkey", "l_linenumber", "country", "year", "gender", "oecd", "w", "pv1", "pv5"
    )


def _export(wd, name: str, *columns: str) -> str:
    """Write a frame the way the indicator files come: preamble, header, records, footer."""
    path = _folder(wd, name)
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("false")) for c in columns]
    records = wd.select(F.concat_ws(",", *cell).alias("value"))
    spark = wd.sparkSession
    frame = inline(spark, "value string", ("Data Source,World Development Indicators,",), ("",),
                   ("Last Updated Date,2022-01-01",), (",".join(columns),), ("Data source,survey office",))
    frame.unionByName(records).write.text(path)
    return path


@query("src_csv_skip", "SELECT country, x1995, x1996, x1997, x1998, x1999, "
       "CASE WHEN country = 'NATION_4' THEN NULL ELSE x2000 END AS x2000, x2001 FROM wd",
       uses="wd", keys="country", floats=" ".join(YEARS))
def src_csv_skip(wd):
    dirty = wd.withColumn("x2000", F.when(F.col("country") != "NATION_4", F.col("x2000")))
    path = _export(dirty, "csv_skip", "country", *YEARS)
    return read_delimited(wd.sparkSession, path, ["country", *YEARS], key="country", numbers=YEARS, header=["country", *YEARS])


@query("src_sheet", "SELECT country, x1997 AS coverage FROM wd WHERE x1997 IS NOT NULL",
       uses="wd", keys="country", floats="coverage")
def src_sheet(wd):
    path = _export(wd, "sheet", "country", *YEARS)
    sheet = read_delimited(wd.sparkSession, path, ["cnt", "cov"], key="cnt", numbers=["cov"], picks=[1, 4], header=["country", YEARS[2]])
    return C.rename_at(sheet, {1: "country", 2: "coverage"}).dropna(subset=["coverage"])


@query("src_inline", """
SELECT n_name, r_name, block FROM dim LEFT JOIN
 (VALUES ('AFRICA','South'),('AMERICA','North'),('ASIA','East'),('EUROPE','North')) b(region, block) ON r_name = region""",
       uses="dim", keys="n_name, r_name, block")
def src_inline(dim):
    blocks = inline(dim.sparkSession, "region string, block string",
                    ("AFRICA", "South"), ("AMERICA", "North"), ("ASIA", "East"), ("EUROPE", "North"))
    return joins.left_join(dim, blocks, {"r_name": "region"}).select("n_name", "r_name", "block")


@query("src_table", "SELECT * FROM pn", uses="pn", keys="country, region, oecd, year, n_total, pop",
       floats="co2 sl_total gini democracy")
def src_table(pn):
    folder = _folder(pn, "saved")
    save_tables(folder, {"panel": pn})
    return load_table(pn.sparkSession, folder, "panel").select(
        "country", "region", "oecd", "year", "n_total", "pop", "co2", "sl_total", "gini", "democracy"
    )


@query("sink_table", "SELECT p.country, p.year, p.co2, d.r_name FROM pn p JOIN dim d ON p.country = d.n_name",
       uses="pn dim", keys="country, year, r_name", floats="co2")
def sink_table(pn, dim):
    folder = _folder(pn, "final")
    save_tables(folder, {"panel": pn.limit(0).select("country", "year", "co2"), "dim": dim})
    save_tables(folder, {"panel": pn.select("country", "year", "co2"), "dim": dim}, partition_by=["year"])
    spark = pn.sparkSession
    panel = load_table(spark, folder, "panel")
    return joins.left_join(panel, load_table(spark, folder, "dim"), {"country": "n_name"}).select(
        "country", "year", "co2", "r_name"
    )


@query("src_text_glob", """
SELECT line, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) t
GROUP BY line""", uses="@documents", keys="line, n")
def src_text_glob(documents):
    path = _folder(documents, "lines")
    documents.select("text").write.option("lineSep", "\n").text(path)
    return read_lines(documents.sparkSession, f"{path}/*.txt", sep="\n").groupBy("line").agg(F.count("*").alias("n"))


@query("src_refdim", "SELECT r_name, n_name, c_custkey FROM dim JOIN customer ON n_nationkey = c_nationkey",
       uses="dim @customer", keys="r_name, n_name, c_custkey")
def src_refdim(dim, customer):
    return customer.join(dim, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "c_custkey")


# ---- columns -------------------------------------------------------------------------------

@query("prj_select", "SELECT year, gender, oecd, w, pv1, pv2, pv3, pv4, rw1, rw2, rw3, rw4 FROM sv", uses="sv",
       keys="year, gender, oecd", floats="w pv1 pv2 pv3 pv4 rw1 rw2 rw3 rw4")
def prj_select(sv):
    return C.select(sv, C.span(sv, "year", "w"), C.containing(sv, "pv"), C.everything_else(sv, ["cnt"]),
                    drop=["pv5", "l_orderkey", "l_linenumber", "l_suppkey", "c_nationkey"])


@query("prj_rename", "SELECT country AS entity, year AS period, co2 AS emissions FROM pn", uses="pn",
       keys="entity, period", floats="emissions")
def prj_rename(pn):
    return C.rename_at(C.rename(pn.select("country", "year", "co2"), emissions="co2", entity="country"), {2: "period"})


@query("prj_rename_suffix", "SELECT country, year, co2 AS co2_1, gdp AS gdp_1, gini AS gini_1 FROM pn", uses="pn",
       keys="country, year", floats="co2_1 gdp_1 gini_1")
def prj_rename_suffix(pn):
    picked = pn.select("country", "year", "co2", "gdp", "gini")
    return C.add_suffix(picked, C.at(picked, 3, 4, 5), "1")


@query("prj_clean_names", "SELECT country AS country_name, x1995, x1996, x1995 + x1996 AS x1995_2, x1997 AS pct_of_gdp "
       "FROM wd", uses="wd", keys="country_name", floats="x1995 x1996 x1995_2 pct_of_gdp")
def prj_clean_names(wd):
    raw = wd.select(F.col("country").alias("Country Name"), F.col("x1995").alias("1995"), F.col("x1996").alias("1996"),
                    (F.col("x1995") + F.col("x1996")).alias("1995 "), F.col("x1997").alias("Pct. of GDP"))
    return C.clean_names(raw)


@query("prj_relocate", "SELECT * FROM pn", uses="pn", keys="year, country, oecd, region", floats="co2")
def prj_relocate(pn):
    moved = C.relocate(pn.select("country", "region", "oecd", "year", "co2"), ["year"], before=1)
    return C.relocate(moved, ["oecd"], after="country")


@query("prj_mutate", "SELECT country, year, gdp/n_total AS gdp_per_order, time*time AS time2, "
       "concat(country, ' ', oecd) AS label FROM pn", uses="pn", keys="country, year, time2, label", floats="gdp_per_order")
def prj_mutate(pn):
    return pn.withColumns({
        "gdp_per_order": F.col("gdp") / F.col("n_total"),
        "time2": F.col("time") * F.col("time"),
        "label": F.concat_ws(" ", "country", "oecd"),
    }).select("country", "year", "gdp_per_order", "time2", "label")


@query("prj_across", """
SELECT country, year, round(co2,1) AS co2, round(sl_total,1) AS sl_total, round(gdp,1) AS gdp, round(gini,1) AS gini,
 co2/2 AS co2_half, gdp/2 AS gdp_half FROM pn""", uses="pn", keys="country, year",
       floats="co2 sl_total gdp gini co2_half gdp_half")
def prj_across(pn):
    picked = pn.select("country", "year", "co2", "sl_total", "gdp", "gini")
    halved = C.across(picked, ["co2", "gdp"], lambda c: c / 2, suffix="half")
    return C.across(halved, ["co2", "sl_total", "gdp", "gini"], lambda c: F.round(c, 1))


@query("prj_scale", "SELECT country, year, gdp/10000 AS gdp, pop/1e7 AS pop, gini*100 AS gini FROM pn", uses="pn",
       keys="country, year", floats="gdp pop gini", digits=6)
def prj_scale(pn):
    return pn.select("country", "year", (F.col("gdp") / 10000).alias("gdp"), (F.col("pop") / 1e7).alias("pop"),
                     (F.col("gini") * 100).alias("gini"))


@query("prj_casewhen", """
SELECT n_nationkey, CASE WHEN n_name = 'NATION_1' THEN 'Taiwan' WHEN contains(n_name, '_1') THEN 'Teens'
 WHEN n_name = 'NATION_10' THEN 'never' ELSE n_name END AS by_rule,
 coalesce(a.name, n_name) AS by_table FROM dim LEFT JOIN
 (VALUES ('NATION_2','Two'),('NATION_3','Three')) a(alias, name) ON n_name = alias""", uses="dim",
       keys="n_nationkey, by_rule, by_table")
def prj_casewhen(dim):
    name = F.col("n_name")
    aliases = inline(dim.sparkSession, "alias string, name string", ("NATION_2", "Two"), ("NATION_3", "Three"))
    ruled = dim.withColumn("by_rule", V.case_when(
        (name == "NATION_1", "Taiwan"), (name.contains("_1"), "Teens"), (name == "NATION_10", "never"), otherwise=name))
    return V.recode(ruled, "n_name", aliases, into="by_table").select("n_nationkey", "by_rule", "by_table")


@query("prj_ifelse", "SELECT country, year, CASE WHEN co2 > 150 THEN 'high' ELSE 'low' END AS level FROM pn", uses="pn",
       keys="country, year, level")
def prj_ifelse(pn):
    return pn.select("country", "year", F.when(F.col("co2") > 150, "high").otherwise("low").alias("level"))


@query("prj_patch", """
SELECT country, year, CASE WHEN country = 'NATION_3' AND year = 1995 THEN 7.25e0
 WHEN country = 'NATION_3' AND year = 1996 THEN 8.75e0 ELSE co2 END AS co2 FROM pn""", uses="pn", keys="country, year",
       floats="co2")
def prj_patch(pn):
    patches = inline(pn.sparkSession, "country string, year int, co2 double",
                     ("NATION_3", 1995, 7.25), ("NATION_3", 1996, 8.75))
    return V.patch(pn.select("country", "year", "co2"), "co2", patches, ["country", "year"])


@query("prj_coalesce", "SELECT country, year, coalesce(left_right, gini) AS score FROM pn", uses="pn",
       keys="country, year", floats="score")
def prj_coalesce(pn):
    return pn.select("country", "year", F.coalesce("left_right", "gini").alias("score"))


@query("prj_sentinel", """
SELECT l_orderkey, l_linenumber, CASE WHEN f118 >= 0 THEN f118 END AS f118, CASE WHEN f120 >= 0 THEN f120 END AS f120,
 CASE WHEN e224 >= 0 THEN e224 END AS e224 FROM it""", uses="it", keys="l_orderkey, l_linenumber, f118, f120, e224")
def prj_sentinel(it):
    return C.across(it.select("l_orderkey", "l_linenumber", "f118", "f120", "e224"), ["f118", "f120", "e224"],
                    V.missing_codes)


@query("prj_decode", "SELECT c_custkey, n_name AS country FROM customer JOIN dim ON n_nationkey = c_nationkey",
       uses="@customer dim", keys="c_custkey, country")
def prj_decode(customer, dim):
    labels = dim.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return V.decode(customer.select("c_custkey", "c_nationkey"), "c_nationkey", labels, into="country").drop("c_nationkey")


@query("prj_striplabel", "SELECT l_orderkey, l_linenumber, CAST(f118 AS DOUBLE) AS f118, CAST(c001 AS DOUBLE) AS c001, "
       "CAST(country AS VARCHAR) AS country FROM it", uses="it", keys="l_orderkey, l_linenumber, country", floats="f118 c001")
def prj_striplabel(it):
    picked = it.select("l_orderkey", "l_linenumber", "f118", "c001", F.col("country").cast("string").alias("country"))
    return C.across(picked, ["f118", "c001"], lambda c: c.cast("double"))


@query("prj_rowid", "SELECT country, year, co2, CAST(row_number() OVER (ORDER BY country, year) AS BIGINT) AS id FROM pn",
       uses="pn", keys="country, year, id", floats="co2")
def prj_rowid(pn):
    return with_position(pn.select("country", "year", "co2"), ["country", "year"], name="id")


@query("prj_rowwise", """
SELECT l_orderkey, l_linenumber, e033 + e143 + c001 AS total, CASE WHEN n > 0 THEN s/n END AS mean FROM (
 SELECT *, CASE WHEN f118 >= 0 THEN 1 ELSE 0 END + CASE WHEN f120 >= 0 THEN 1 ELSE 0 END
  + CASE WHEN e224 >= 0 THEN 1 ELSE 0 END AS n,
  CASE WHEN f118 >= 0 THEN f118 ELSE 0 END + CASE WHEN f120 >= 0 THEN f120 ELSE 0 END
  + CASE WHEN e224 >= 0 THEN e224 ELSE 0e0 END AS s FROM it) t""", uses="it",
       keys="l_orderkey, l_linenumber, total", floats="mean")
def prj_rowwise(it):
    items = ["f118", "f120", "e224"]
    clean = C.across(it, items, V.missing_codes)
    return clean.select("l_orderkey", "l_linenumber", (F.col("e033") + F.col("e143") + F.col("c001")).alias("total"),
                        V.row_mean(*items).alias("mean"))


@query("prj_separate", """
SELECT CAST(split_part(item, '  ', 1) AS DOUBLE) AS num, split_part(item, '  ', 2) AS segment, split_part(item, '  ', 3) AS span
FROM (SELECT unnest(string_split(categories, chr(10))) AS item FROM cb) t""", uses="cb", keys="segment, span", floats="num")
def prj_separate(cb):
    items = cb.select(F.explode(F.split("categories", "\n")).alias("item"))
    split = V.separate(items, "item", ["num", "segment", "span"], "  ")
    return split.withColumn("num", parse_number(F.col("num")))


@query("prj_dyncol", "SELECT country, year, gini AS value, 'gini' AS measure FROM pn WHERE gini IS NOT NULL UNION ALL "
       "SELECT country, year, democracy, 'democracy' FROM pn WHERE democracy IS NOT NULL", uses="pn",
       keys="country, year, measure", floats="value")
def prj_dyncol(pn):
    def one(name: str):
        return pn.where(F.col(name).isNotNull()).select("country", "year", F.col(name).alias("value"), F.lit(name).alias("measure"))

    return one("gini").unionByName(one("democracy"))


@query("prj_cbind", """
SELECT a.pos, a.country, b.n_name FROM (SELECT country, CAST(row_number() OVER (ORDER BY country) AS BIGINT) AS pos FROM wd) a
 JOIN (SELECT n_name, CAST(row_number() OVER (ORDER BY n_nationkey DESC) AS BIGINT) AS pos FROM dim) b ON a.pos = b.pos""",
       uses="wd dim", keys="pos, country, n_name")
def prj_cbind(wd, dim):
    left = with_position(wd.select("country"), ["country"])
    right = with_position(dim.select("n_name", (-F.col("n_nationkey")).alias("k")), ["k"]).drop("k")
    return left.join(right, "pos").select("pos", "country", "n_name")


@query("prj_dummy", """
SELECT country, year, CASE WHEN region = 'AMERICA' THEN 1e0 ELSE 0e0 END AS "regionAMERICA",
 CASE WHEN region = 'ASIA' THEN 1e0 ELSE 0e0 END AS "regionASIA", CASE WHEN region = 'EUROPE' THEN 1e0 ELSE 0e0 END AS "regionEUROPE",
 CASE WHEN region = 'MIDDLE EAST' THEN 1e0 ELSE 0e0 END AS "regionMIDDLE EAST", CASE WHEN oecd = 'OECD' THEN sl_total ELSE 0e0 END AS oecd_sl
 FROM pn""", uses="pn", keys="country, year", floats=["regionAMERICA", "regionASIA", "regionEUROPE", "regionMIDDLE EAST", "oecd_sl"])
def prj_dummy(pn):
    made = V.dummies("region", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], base="AFRICA")
    return pn.withColumns(made).select(
        "country", "year", *[F.col(f"`{c}`") for c in made], (F.when(F.col("oecd") == "OECD", 1.0).otherwise(0.0) * F.col("sl_total")).alias("oecd_sl"))


@query("prj_quad", "SELECT country, year, CAST(time*time AS DOUBLE) AS time2, ln(co2) AS co2_log, "
       "(exp(ln(co2)/100) - 1)*100 AS pct FROM pn", uses="pn", keys="country, year", floats="time2 co2_log pct")
def prj_quad(pn):
    log = F.log(F.when(F.col("co2") > 0, F.col("co2")))
    return pn.select("country", "year", F.pow(F.col("time"), 2).alias("time2"), log.alias("co2_log"),
                     ((F.exp(log / 100) - 1) * 100).alias("pct"))


@query("prj_revcode", """
SELECT l_orderkey, l_linenumber, CASE WHEN f118 >= 0 THEN 11 - f118 END AS f118_rev, CASE WHEN e224 >= 0 THEN 10 - e224 END AS e224_rev,
 CASE c001 WHEN 1 THEN 1e0 WHEN 3 THEN 5e-1 WHEN 2 THEN 0e0 END AS c001_rev FROM it""", uses="it",
       keys="l_orderkey, l_linenumber, f118_rev, e224_rev", floats="c001_rev")
def prj_revcode(it):
    return it.select(
        "l_orderkey", "l_linenumber",
        V.reverse_code(V.missing_codes(F.col("f118")), 1, 10).alias("f118_rev"),
        V.reverse_code(V.missing_codes(F.col("e224")), 0, 10).alias("e224_rev"),
        V.remap(F.col("c001"), {1: 1.0, 3: 0.5, 2: 0.0}).alias("c001_rev"))


# ---- filters -------------------------------------------------------------------------------

_PN_KEYS = dict(uses="pn", keys="country, year", floats="co2")


@query("flt_pred", "SELECT * FROM pn WHERE year >= 1997 AND country <> 'NATION_3' AND gini > 0.3", **_PN_KEYS)
def flt_pred(pn):
    return pn.where((F.col("year") >= 1997) & (F.col("country") != "NATION_3") & (F.col("gini") > 0.3)).select(
        "country", "year", "co2")


@query("flt_between", "SELECT * FROM pn WHERE year BETWEEN 1996 AND 1999", **_PN_KEYS)
def flt_between(pn):
    return pn.where(F.col("year").between(1996, 1999)).select("country", "year", "co2")


@query("flt_in", "SELECT * FROM pn WHERE year IN (1995, 1998) AND country IN (SELECT n_name FROM dim WHERE r_name = 'ASIA')",
       uses="pn dim", keys="country, year", floats="co2")
def flt_in(pn, dim):
    members = dim.where(F.col("r_name") == "ASIA").select(F.col("n_name").alias("country"))
    return filters.keep_in(pn, "year", [1995, 1998]).join(members, "country", "left_semi").select("country", "year", "co2")


@query("flt_notin", "SELECT * FROM pn WHERE country NOT IN ('NATION_1', 'NATION_7', 'NATION_24')", **_PN_KEYS)
def flt_notin(pn):
    return filters.keep_not_in(pn, "country", ["NATION_1", "NATION_7", "NATION_24"]).select("country", "year", "co2")


@query("flt_dropna", "SELECT * FROM pn WHERE gini IS NOT NULL AND democracy IS NOT NULL", **_PN_KEYS)
def flt_dropna(pn):
    return pn.dropna(subset=["gini", "democracy"]).select("country", "year", "co2")


@query("flt_isna", "SELECT country, year, 'gini' AS measure FROM pn WHERE gini IS NULL UNION ALL "
       "SELECT country, year, 'left_right' FROM pn WHERE left_right IS NULL", uses="pn", keys="country, year, measure")
def flt_isna(pn):
    def one(name: str):
        return filters.missing_rows(pn, name, ["country", "year"]).select("country", "year", F.lit(name).alias("measure"))

    return one("gini").unionByName(one("left_right"))


@query("flt_regex", "SELECT n_name, r_name, regexp_matches(r_name, '^A') AS a FROM dim WHERE regexp_matches(n_name, '_1[0-4]$|_2$')",
       uses="dim", keys="n_name, r_name, a")
def flt_regex(dim):
    return filters.matching(dim, "n_name", "_1[0-4]$|_2$").select("n_name", "r_name", F.col("r_name").rlike("^A").alias("a"))


@query("flt_slice", "SELECT country, year, co2 FROM (SELECT *, row_number() OVER (ORDER BY country, year) AS rn FROM pn) t "
       "WHERE rn NOT IN (1, 2, 3, 105)", **_PN_KEYS)
def flt_slice(pn):
    return filters.slice_rows(pn.select("country", "year", "co2"), ["country", "year"], drop=[1, 2, 3, 105])


@query("flt_strna", "SELECT * FROM sv WHERE gender <> 'NA'", uses="sv", keys="l_orderkey, l_linenumber, gender", floats="pv1")
def flt_strna(sv):
    return sv.where(F.col("gender") != "NA").select("l_orderkey", "l_linenumber", "gender", "pv1")
