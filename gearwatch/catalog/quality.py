"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog import labels as _labels
from gearwatch.catalog.base import E_SQL, L_SQL, R_SQL, SQL, query, rounded
from gearwatch.operators import quality as Q
from gearwatch.operators import rollups as U
from gearwatch.operators import splits as S
from gearwatch.sources.warehouse import EVENT_MEMBERS, PANEL_COLUMNS, events_panel, region_panel, supplier_panel, table


@query(
    "value_problems",
    E_SQL + """ SELECT count(*) AS rows, count(*) FILTER (d IS NULL OR entity IS NULL OR member IS NULL) AS null_keys, count(*) FILTER (flag NOT IN (0, 1)) AS bad_flags,
 count(*) FILTER (grade NOT IN ('A', 'B', 'C')) AS bad_grades, count(*) FILTER (isinf(m1) OR isinf(m2) OR isinf(m3) OR isinf(m4)) AS non_finite,
 count(*) FILTER (cost < 0) AS negative_cost, count(*) FILTER (qty < 0) AS negative_qty, count(*) FILTER (abs(cost * qty - amount) > 1e-8 + 1e-5 * abs(amount)) AS identity_breaks FROM panel""",
)
def value_problems(spark, sf):
    return Q.value_problems(events_panel(spark, sf))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_partkey, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    from gearwatch.operators.joins import duplicate_keys as dups

    return dups(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    "fd_audit",
    "WITH l AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, l_returnflag, l_discount, l_suppkey % 5 AS etype FROM lineitem), "
    + "g AS (SELECT count(DISTINCT l_returnflag) > 1 AS a, count(DISTINCT l_discount) > 1 AS b, count(DISTINCT etype) > 1 AS c FROM l GROUP BY l_suppkey, d) "
    + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) AS groups, count(*) FILTER ({k}) AS broken_groups FROM g" for n, k in (("l_returnflag", "a"), ("l_discount", "b"), ("etype", "c"))),
)
def fd_audit(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("d"), "l_returnflag", "l_discount", (F.col("l_suppkey") % 5).alias("etype")
    )
    return Q.dependency_breaks(rows, ["l_suppkey", "d"], ["l_returnflag", "l_discount", "etype"])


@query(
    "member_signatures",
    E_SQL + """, s AS (SELECT entity, d, list_sort(list(member || family || grade)) AS sig, count(*) AS n FROM panel WHERE observed = 1 GROUP BY entity, d)
 SELECT entity, count(DISTINCT sig) AS signatures, min(n) AS min_members, max(n) AS max_members FROM s GROUP BY entity""",
)
def member_signatures(spark, sf):
    return Q.member_signatures(events_panel(spark, sf).filter("observed = 1"))


@query("listed_values", """WITH w(x) AS (VALUES ('click'), ('deploy'), ('error'), ('purchase')), h AS (SELECT DISTINCT event_type AS x FROM events)
 SELECT (SELECT coalesce(string_agg(x, ';' ORDER BY x), '') FROM w WHERE x NOT IN (SELECT x FROM h)) AS missing,
 (SELECT coalesce(string_agg(x, ';' ORDER BY x), '') FROM h WHERE x NOT IN (SELECT x FROM w)) AS extra, (SELECT CAST(count(*) AS INTEGER) FROM h JOIN w USING (x)) AS matched""")
def listed_values(spark, sf):
    return Q.listed_values(table(spark, sf, "events"), "event_type", ["click", "deploy", "error", "purchase"])


@query(
    "incomplete_days",
    E_SQL + " SELECT d, entity, count(DISTINCT member) AS found FROM panel WHERE observed = 1 GROUP BY d, entity HAVING count(DISTINCT member) <> 5",
)
def incomplete_days(spark, sf):
    return Q.incomplete_days(events_panel(spark, sf).filter("observed = 1"), ["d", "entity"], "member", len(EVENT_MEMBERS))


@query(
    "daily_listed_values",
    """WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS d, event_type AS value FROM events), w AS (SELECT d, unnest(['click', 'deploy', 'error', 'purchase']) AS value FROM (SELECT DISTINCT d FROM e))
 SELECT d, value, 'missing' AS problem FROM (SELECT * FROM w EXCEPT SELECT * FROM e) UNION ALL SELECT d, value, 'extra' FROM e WHERE value NOT IN ('click', 'deploy', 'error', 'purchase')""",
)
def daily_listed_values(spark, sf):
    events = table(spark, sf, "events").select(F.col("ts").cast("date").alias("d"), "event_type")
    return Q.daily_listed_values(events, "event_type", ["click", "deploy", "error", "purchase"], ["d"])


@query(
    "family_completeness",
    E_SQL + """, o AS (SELECT * REPLACE (CASE WHEN member = 'view' AND entity % 7 = 3 AND day(d) % 2 = 0 THEN 'X' ELSE family END AS family) FROM panel WHERE observed = 1),
 c AS (SELECT DISTINCT entity, family, member FROM o), ex AS (SELECT entity, family, count(*) AS want FROM c GROUP BY ALL),
 tw AS (SELECT entity, count(*) FILTER (k > 1) AS twice FROM (SELECT entity, member, count(*) AS k FROM c GROUP BY ALL) GROUP BY entity),
 nf AS (SELECT entity, count(*) AS wf FROM ex GROUP BY entity), se AS (SELECT entity, family, d, count(DISTINCT member) AS found FROM o GROUP BY ALL),
 dd AS (SELECT se.entity, d, count(*) AS fams, count(*) FILTER (found < want) AS short FROM se JOIN ex USING (entity, family) GROUP BY ALL)
 SELECT dd.entity, CAST(sum(short) AS BIGINT) AS short_family_days, count(*) FILTER (fams < wf) AS days_missing_family, any_value(twice) AS parts_in_two_families FROM dd JOIN nf USING (entity) JOIN tw USING (entity) GROUP BY dd.entity""",
)
def family_completeness(spark, sf):
    """Some entities have a member that changes its family by the day."""
    moved = (F.col("member") == "view") & (F.col("entity") % 7 == 3) & (F.dayofmonth("d") % 2 == 0)
    rows = events_panel(spark, sf).filter("observed = 1").withColumn("family", F.when(moved, "X").otherwise(F.col("family")))
    return Q.family_completeness(rows)


@query(
    "calendar_audit",
    L_SQL + """, o AS (SELECT DISTINCT entity, member, d FROM panel WHERE observed = 1), g AS (SELECT date_diff('day', min(d), max(d)) + 1 - count(*) AS gap FROM o GROUP BY entity, member)
 SELECT CAST(sum(gap) AS BIGINT) AS missing_days, count(*) AS groups FROM g""",
)
def calendar_audit(spark, sf):
    return Q.calendar_audit(supplier_panel(spark, sf).filter("observed = 1"), ["entity", "member"], "d")


@query(
    "reverse_rows",
    """WITH r AS (SELECT l_shipdate < lag(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS back FROM lineitem) SELECT count(*) FILTER (back) AS reverse_rows FROM r""",
)
def reverse_rows(spark, sf):
    """Arrival order of shipments per supplier is the order and line number."""
    arrival = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", arrival.alias("arrival"))
    return Q.reverse_rows(rows, ["l_suppkey"], "l_shipdate", "arrival")


_PC = ", ".join(PANEL_COLUMNS)


@query(
    "quality_summary",
    E_SQL + f""", g AS (SELECT d, etype, entity, count(*) AS n, count(DISTINCT m1) <= 1 AND count(DISTINCT m2) <= 1 AND count(DISTINCT m3) <= 1 AND count(DISTINCT m4) <= 1 AS eq FROM panel GROUP BY ALL)
 SELECT count(*) AS rows, count(*) FILTER (category IS NULL) AS blank_category, min(d) AS period_start, max(d) AS period_end,
 (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM panel GROUP BY d, entity, member)) AS key_duplicates,
 (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM panel GROUP BY {_PC})) AS full_duplicates,
 (SELECT count(*) FROM g) AS group_count, (SELECT n FROM g ORDER BY d, etype, entity LIMIT 1) AS rows_per_group, (SELECT count(*) FILTER (eq) FROM g) AS identical_measure_groups,
 round(100 * (count(*) FILTER (category IS NULL) / count(*)), 2) AS blank_category_pct, CAST(date_diff('day', min(d), max(d)) + 1 AS INTEGER) AS period_days FROM panel""",
)
def quality_summary(spark, sf):
    return Q.quality_summary(events_panel(spark, sf))


@query(
    "null_dictionary",
    E_SQL + " " + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS type, '' AS unit, "
        + ("CASE WHEN count(*) < 0 THEN 0.0::DOUBLE END" if c == "category" else f"round(100 * (count(*) FILTER ({c} IS NULL) / count(*)), 2)") + " AS missing_pct FROM panel"
        for i, (c, t) in enumerate(
            zip(PANEL_COLUMNS, ("date", "bigint", "bigint", "bigint", "string", "string", "string", "int", "bigint", "double", "double", "string", "int", "double", "double", "double", "double"))
        )
    ),
)
def null_dictionary(spark, sf):
    return Q.data_dictionary(events_panel(spark, sf))


@query(
    "preparation_report",
    "WITH base AS (__ELIG__), " + R_SQL[len("WITH"):] + """, j AS (SELECT b.split, b.reason = 'used' AS used, p.flag, p.d, p.entity, p.member,
   max(p.flag) OVER (PARTITION BY p.entity, p.member ORDER BY p.d RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING) AS target FROM base b JOIN panel p ON p.d = b.d AND p.entity = b.entity AND p.member = b.member),
 mx AS (SELECT split, count(*) AS mixed_flag_days FROM (SELECT split, d, entity FROM j GROUP BY ALL HAVING min(flag) < max(flag)) GROUP BY split)
 SELECT j.split, count(*) AS rows, count(*) FILTER (used) AS eligible_rows, round(avg(CASE WHEN used THEN target END), 9) AS positive_rate, max(mixed_flag_days) AS mixed_flag_days FROM j JOIN mx ON mx.split = j.split GROUP BY j.split""",
)
def preparation_report(spark, sf):
    from gearwatch.catalog.labels import eligible_parts

    return rounded(Q.preparation_report(eligible_parts(region_panel(spark, sf))), ["positive_rate"])


@query(
    "threshold_monotonicity",
    R_SQL + """, r AS (SELECT t, avg(CAST(points >= t AS INTEGER)) AS rate FROM daily CROSS JOIN (VALUES (7), (10), (11), (12), (13), (14)) v(t) GROUP BY t),
 c AS (SELECT rate > lag(rate) OVER (ORDER BY t) AS rise FROM r) SELECT count(*) FILTER (rise) AS rises, count(*) AS thresholds FROM c""",
)
def threshold_monotonicity(spark, sf):
    from gearwatch.operators.labels import threshold_labels

    daily = threshold_labels(U.entity_daily(region_panel(spark, sf)), "points")
    names = [c for c in daily.columns if c.startswith("severity_")]
    rates = daily.agg(*[F.avg(n).alias(n) for n in names]).unpivot([], names, "label", "rate")
    return Q.threshold_monotonicity(rates.withColumn("t", F.substring_index("label", "_", -1).cast("int")), "t", "rate")


@query(
    "split_overlap",
    L_SQL + _labels._SPLIT.format(t="daily") + f""", x AS (SELECT {_labels._SPLIT_NAME} AS split, min(d) AS lo, max(d) AS hi, count(DISTINCT d) AS n FROM daily, lim GROUP BY 1)
 SELECT CASE WHEN max(hi) FILTER (split = 'train') >= max(lo) FILTER (split = 'valid') OR max(hi) FILTER (split = 'valid') >= max(lo) FILTER (split = 'test') THEN 'some' ELSE 'none' END AS overlap,
 CAST(sum(n) AS BIGINT) AS dates FROM x""",
)
def split_overlap(spark, sf):
    """An empty overlap table of a sound split, shown as a word next to the number of dates."""
    daily = S.date_share_split(U.entity_daily(supplier_panel(spark, sf)).select("d"), "d")
    found = S.split_overlap(daily, "d").agg(F.count(F.lit(1))).scalar()
    return daily.agg(F.countDistinct("d").alias("dates")).select(F.when(found == 0, "none").otherwise("some").alias("overlap"), "dates")


@query("source_info", E_SQL + " SELECT count(*) AS row_count, min(d) AS start_date, max(d) AS reference_date, CAST(17 AS INTEGER) AS col_count FROM panel")
def source_info(spark, sf):
    return Q.source_info(events_panel(spark, sf), "d")


@query("entity_catalog", L_SQL + " SELECT entity, min(etype) AS etype, min(site) AS site FROM panel GROUP BY entity")
def entity_catalog(spark, sf):
    return Q.entity_catalog(supplier_panel(spark, sf))


_CHANGES = {
    "shuffled": "SELECT * FROM lineitem ORDER BY l_partkey, l_comment",
    "one_row_less": "SELECT * FROM lineitem WHERE NOT (l_orderkey = (SELECT min(l_orderkey) FROM lineitem) AND l_linenumber = 1)",
    "one_value_more": "SELECT * REPLACE (CASE WHEN l_orderkey = (SELECT max(l_orderkey) FROM lineitem) AND l_linenumber = 1 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem",
    "one_row_twice": "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem) AND l_linenumber = 1",
}


@query(
    "table_fingerprint",
    " UNION ALL ".join(
        f"SELECT '{name}' AS copy, (SELECT count(*) FROM ({q})) AS rows, NOT EXISTS (SELECT * FROM lineitem EXCEPT ALL ({q})) AND NOT EXISTS (({q}) EXCEPT ALL SELECT * FROM lineitem) AS same" for name, q in _CHANGES.items()
    ).replace(", l_comment", ""),
)
def table_fingerprint(spark, sf):
    """The fingerprint of a table against copies: shuffled, one row less, one value changed, one row twice."""
    lines = table(spark, sf, "lineitem")
    ends = lines.agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high")).first()
    first, last = (F.col("l_orderkey") == ends["low"]) & (F.col("l_linenumber") == 1), (F.col("l_orderkey") == ends["high"]) & (F.col("l_linenumber") == 1)
    copies = {
        "shuffled": lines.repartition(13, "l_partkey"),
        "one_row_less": lines.filter(~first),
        "one_value_more": lines.withColumn("l_quantity", F.when(last, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))),
        "one_row_twice": lines.unionByName(lines.filter(last)),
    }
    own = Q.fingerprint(lines).select(F.struct("*")).scalar()
    out = None
    for name, copy in copies.items():
        one = Q.fingerprint(copy).select(F.lit(name).alias("copy"), "rows", (F.struct("rows", "hash_xor", "hash_sum") == own).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


SQL["preparation_report"] = SQL["preparation_report"].replace("__ELIG__", SQL["part_eligibility"])
