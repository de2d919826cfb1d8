"""Registered queries over the driver's tables, each with the SQL that a second engine runs to check it.

Most are written in the dialect and go through parser, compiler and Catalyst; those of sources, nested scans and
shredding use the DataFrame helpers. Times are cut to whole seconds where a table has fractions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.operators import helpers, shredding
from stratal.plans.engine import Engine
from stratal.sources import nested_scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nested(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Nested tables built from the flat ones: each order's lines as a list of structs; customers as structs."""
    if name == "baskets":
        line = table(spark, sf_dir, "lineitem")
        made = F.struct(F.col("l_linenumber").cast("bigint").alias("num"), F.col("l_quantity").alias("qty"), F.split("l_returnflag", "").alias("tags"), F.col("l_extendedprice").alias("price"))
        lines = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(made)).alias("items"))
        orders = table(spark, sf_dir, "orders")
        joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
        return joined.select("o_orderkey", "o_custkey", "items", F.transform("items", lambda x: x["num"]).alias("nums"), F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")).alias("detail")).alias("info"))
    return table(spark, sf_dir, name)


def dialect(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the dialect; oracle: its SQL for the second engine, the same text if None."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        low = text.lower()
        for t in (*TABLES, "baskets"):
            if t in low:
                engine.register(t, _nested(spark, sf_dir, t), timestamps="cut")
        return engine.sql(text)

    run.__name__, run.__doc__ = name, text
    QUERIES[name], ORACLES[name] = run, oracle or text


# scans and projections
dialect("scan_count", "SELECT COUNT(*) AS n FROM lineitem")
dialect("scan_filter_project", "SELECT o_orderkey, o_orderstatus AS status, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus != 'F'")
dialect("scan_arith", "SELECT l_orderkey, l_linenumber, l_quantity * 2 - 1 AS a, l_linenumber + 10 * l_linenumber AS b, l_linenumber / 4 AS c, -l_linenumber AS d FROM lineitem WHERE l_quantity <= 10", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity * 2 - 1 AS a, CAST(l_linenumber + 10 * l_linenumber AS BIGINT) AS b, l_linenumber / 4.0::DOUBLE AS c, CAST(-l_linenumber AS BIGINT) AS d FROM lineitem WHERE l_quantity <= 10")
dialect("star", "SELECT * FROM nation WHERE n_nationkey BETWEEN 3 AND 9", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_nationkey BETWEEN 3 AND 9")
dialect("default_names", "SELECT n.n_name, n_nationkey + 1 FROM nation n", "SELECT n_name, CAST(n_nationkey + 1 AS BIGINT) AS column2 FROM nation")
# predicates
dialect("pred_in_between_like_case", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IN (20, 30, 40) THEN 'round' ELSE 'other' END AS kind, p_type LIKE '%A_%' AS liked FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') AND NOT (p_size > 45)")
dialect("three_valued", "SELECT e.event_id, NULLIF(event_type, 'view') IN ('click', NULL) AS a, NOT (NULLIF(event_type, 'view') = 'click') AS b, NULLIF(event_type, 'view') IS NULL AS c, NULLIF(event_type, 'view') NOT IN ('click', 'error') AS d FROM events e")
dialect("empty_in", "SELECT r_name, r_name IN () AS a, NULLIF(r_regionkey, 1) NOT IN () AS b FROM region", "SELECT r_name, FALSE AS a, CASE WHEN r_regionkey <> 1 THEN TRUE END AS b FROM region")
# scalar functions
dialect("string_fns", "SELECT c_custkey, LOWER(c_name) AS lo, UPPER(c_mktsegment) AS up, LENGTH(c_name) AS n, SUBSTRING(c_name, 3, 4) AS s, SUBSTRING(c_name, -5, 3) AS clamped, SUBSTRING(c_name, 2, -1) AS none, CONCAT(c_mktsegment, '-', c_custkey) AS cc, CONCAT(c_name, NULL) AS nothing FROM customer", "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n, substr(c_name, 3, 4) AS s, substr(c_name, 1, 3) AS clamped, '' AS none, c_mktsegment || '-' || c_custkey AS cc, NULL::VARCHAR AS nothing FROM customer")
dialect("ascii_case_only", "SELECT doc_id, UPPER(text) AS up FROM documents", "SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up FROM documents")
dialect("coalesce_nullif_abs", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg, ABS(c_acctbal) AS bal, ABS(c_nationkey - 12) AS dist, COALESCE(NULL, c_nationkey) AS key FROM customer", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg, ABS(c_acctbal) AS bal, CAST(ABS(c_nationkey - 12) AS BIGINT) AS dist, CAST(c_nationkey AS BIGINT) AS key FROM customer")
dialect("casts", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST('12x' AS BIGINT) AS bad, CAST(' 12' AS BIGINT) AS blank, CAST('+7' AS BIGINT) AS seven, CAST('true' AS BOOLEAN) AS t, CAST(o_orderkey AS DOUBLE) AS d, CAST(o_orderkey AS DECIMAL(18,2)) AS m, CAST(CAST('2024-02-30' AS DATE) AS VARCHAR) AS nodate, CAST(CAST('2024-1-5' AS DATE) AS VARCHAR) AS loose, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS od FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS VARCHAR) AS s, NULL::BIGINT AS bad, NULL::BIGINT AS blank, 7::BIGINT AS seven, TRUE AS t, CAST(o_orderkey AS DOUBLE) AS d, CAST(o_orderkey AS DECIMAL(18,2)) AS m, NULL::VARCHAR AS nodate, NULL::VARCHAR AS loose, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS od FROM orders")
dialect("date_fns", "SELECT o_orderkey, EXTRACT(year FROM o_orderdate) AS y, EXTRACT(month FROM o_orderdate) AS m, EXTRACT(day FROM o_orderdate) AS d, CAST(DATE_TRUNC('month', DATE(o_orderdate)) AS VARCHAR) AS mo, CAST(DATE_TRUNC('hour', o_orderdate) AS VARCHAR) AS h FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00' AND DATE(o_orderdate) < DATE '1996-03-01'", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS mo, CAST(date_trunc('hour', o_orderdate) AS VARCHAR) AS h FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1996-03-01'")
dialect("interval_arith", "SELECT o_orderkey, CAST(DATE(o_orderdate) + INTERVAL '1 week' AS VARCHAR) AS w, CAST(DATE(o_orderdate) - INTERVAL '2 days' AS VARCHAR) AS b, CAST(DATE(o_orderdate) + INTERVAL '5 hours' AS VARCHAR) AS nothing, CAST(o_orderdate + INTERVAL '90 minutes' AS VARCHAR) AS t FROM orders", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE) AS VARCHAR) AS w, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 DAY AS DATE) AS VARCHAR) AS b, NULL::VARCHAR AS nothing, CAST(o_orderdate + INTERVAL 90 MINUTE AS VARCHAR) AS t FROM orders")
dialect("overflow_divzero_null", "SELECT r_regionkey, 9223372036854775807 + r_regionkey AS o, r_regionkey / 0 AS z, 9223372036854775807 * (r_regionkey + 1) AS p FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, CASE WHEN r_regionkey = 0 THEN 9223372036854775807 END AS o, NULL::DOUBLE AS z, CASE WHEN r_regionkey = 0 THEN 9223372036854775807 END AS p FROM region")
dialect("decimal_arith", "SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) * CAST('0.15' AS DECIMAL(18,2)) AS part, CAST(c_acctbal AS DECIMAL(18,2)) + 1 AS more, CAST(c_acctbal AS DECIMAL(18,2)) * 0.5 AS half FROM customer", "SELECT c_custkey, CAST(trunc(m * 15 / 100) / 100.0 AS DECIMAL(18,2)) AS part, CAST(m / 100.0 + 1 AS DECIMAL(18,2)) AS more, m / 100.0::DOUBLE * 0.5::DOUBLE AS half FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS m FROM customer)")
# aggregation
dialect("agg_pricing_summary", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, AVG(l_discount) AS avg_disc, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, AVG(l_discount) AS avg_disc, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
dialect("agg_global", "SELECT COUNT(*) AS n, COUNT(NULLIF(event_type, 'view')) AS k, SUM(user_id) AS s, MIN(event_type) AS a, MAX(event_type) AS z FROM events", "SELECT COUNT(*) AS n, COUNT(NULLIF(event_type, 'view')) AS k, CAST(SUM(user_id) AS BIGINT) AS s, MIN(event_type) AS a, MAX(event_type) AS z FROM events")
dialect("agg_empty", "SELECT COUNT(*) AS n, SUM(user_id) AS s, AVG(value) AS a, MAX(event_type) AS z FROM events WHERE event_id < 0", "SELECT COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s, AVG(value) AS a, MAX(event_type) AS z FROM events WHERE event_id < 0")
dialect("agg_multi_key", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_orderkey) AS m FROM orders GROUP BY o_orderstatus, o_orderpriority")
dialect("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_orderkey) NOT BETWEEN 0 AND 10 AND o_custkey IS NOT NULL")
dialect("agg_null_group", "SELECT seg, COUNT(*) AS n FROM (SELECT NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer) t GROUP BY seg")
dialect("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem")
dialect("sum_exact_bigint", "SELECT SUM(x) AS s FROM (SELECT CASE WHEN r_regionkey = 0 THEN 9223372036854775807 WHEN r_regionkey = 1 THEN 1 WHEN r_regionkey = 2 THEN -1 ELSE 0 END AS x FROM region) t", "SELECT 9223372036854775807 AS s")
dialect("sum_overflow_null", "SELECT SUM(x) AS s FROM (SELECT 9223372036854775807 + 0 * r_regionkey AS x FROM region) t", "SELECT NULL::BIGINT AS s")
dialect("decimal_sum_avg", "SELECT o_orderstatus, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS s, MAX(CAST(o_totalprice AS DECIMAL)) AS m FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS DECIMAL(18,2)) AS s, CAST(MAX(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS DECIMAL(18,2)) AS m FROM orders GROUP BY o_orderstatus")
# a mean of doubles depends on the order in which they are added: four digits are compared
QUERIES["agg_pricing_summary"] = (lambda run: lambda spark, sf_dir: run(spark, sf_dir).withColumn("avg_disc", F.round("avg_disc", 4)))(QUERIES["agg_pricing_summary"])
ORACLES["agg_pricing_summary"] = ORACLES["agg_pricing_summary"].replace("AVG(l_discount)", "round(AVG(l_discount), 4)")
# joins
dialect("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 5")
dialect("join_left", "SELECT c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
dialect("join_right", "SELECT c_custkey, s_suppkey, n_name FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000 RIGHT OUTER JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
dialect("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey")
dialect("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
dialect("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
dialect("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
dialect("join_multi", "SELECT r_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' GROUP BY r_name")
dialect("join_fact_dimension", "SELECT p_brand, AVG(l_quantity) AS q, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
dialect("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
dialect("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
dialect("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey)")
dialect("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
# subqueries
dialect("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)")
dialect("corr_scalar_subquery", "SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE o.o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
dialect("subquery_in_select", "SELECT n_name, (SELECT COUNT(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS k FROM nation n")
# windows
dialect("win_row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
dialect("win_rank_dense", "SELECT l_orderkey, l_linenumber, RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r, DENSE_RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r, DENSE_RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS d FROM lineitem")
dialect("win_lag_lead", "SELECT o_orderkey, LAG(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, LEAD(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later FROM orders")
dialect("win_partition_agg", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders")
dialect("win_running_rows", "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS s, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM orders", "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER w AS BIGINT) AS s, COUNT(*) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
dialect("win_nulls_in_expr", "SELECT event_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) = 1 THEN 'first' ELSE 'later' END AS which FROM (SELECT event_id, user_id, NULLIF(event_type, 'view') AS k FROM events) t", "SELECT event_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY NULLIF(event_type, 'view') DESC NULLS FIRST, event_id) = 1 THEN 'first' ELSE 'later' END AS which FROM events")
# order and limit
dialect("topk_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 20 OFFSET 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
dialect("sort_nulls", "SELECT k, event_id FROM (SELECT event_id, NULLIF(event_type, 'view') AS k FROM events) t ORDER BY k DESC LIMIT 30", "SELECT k, event_id FROM (SELECT event_id, NULLIF(event_type, 'view') AS k FROM events) t ORDER BY k DESC NULLS FIRST, event_id LIMIT 30")
dialect("sort_nulls_last", "SELECT k, event_id FROM (SELECT event_id, NULLIF(event_type, 'view') AS k FROM events) t ORDER BY k DESC NULLS LAST, event_id DESC LIMIT 30")
dialect("group_topk", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 3")
dialect("distinct_limit", "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 10 OFFSET 3")
# sets and CTEs
dialect("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region", "SELECT CAST(n_regionkey AS BIGINT) AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")
dialect("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 ORDER BY k LIMIT 7", "(SELECT CAST(n_regionkey AS BIGINT) AS k FROM nation UNION SELECT r_regionkey FROM region) UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey < 3 ORDER BY k LIMIT 7")
dialect("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM per GROUP BY n")
dialect("cte_join", "WITH o AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0) SELECT c.c_custkey, o.n FROM c LEFT JOIN o ON c.c_custkey = o.o_custkey")
dialect("derived_table", "SELECT t.seg, t.n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS t WHERE t.n > 10")
# nested data
_B = "WITH lines AS (SELECT l_orderkey, list({'num': l_linenumber::BIGINT, 'qty': l_quantity, 'price': l_extendedprice, 'flag': l_returnflag} ORDER BY l_linenumber, l_quantity) AS items FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, items FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey) "
_LINES = "WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS num, l_quantity AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_extendedprice) AS p FROM lineitem) "
dialect("struct_path", "SELECT b.o_orderkey, info.detail.priority, b.info.status AS st FROM baskets b WHERE info.detail.price > 100000", _B + "SELECT o_orderkey, priority, status AS st FROM b WHERE price > 100000")
dialect("struct_group", "SELECT info.status, COUNT(*) AS n, MAX(info.detail.price) AS m FROM baskets GROUP BY info.status", _B + "SELECT status, COUNT(*) AS n, MAX(price) AS m FROM b GROUP BY status")
dialect("list_cardinality", "SELECT o_orderkey, CARDINALITY(items) AS n FROM baskets", _B + "SELECT o_orderkey, len(items) AS n FROM b")
dialect("unnest_cross", "SELECT b.o_orderkey, u.value.num, u.value.qty AS q FROM baskets b CROSS JOIN UNNEST(b.items) AS u WHERE u.value.qty > 25", _B + "SELECT o_orderkey, i.num, i.qty AS q FROM (SELECT o_orderkey, unnest(items) AS i FROM b) WHERE i.qty > 25")
dialect("unnest_left_on", "SELECT b.o_orderkey, u.v.num AS num, u.p FROM baskets b LEFT JOIN UNNEST(b.items) WITH ORDINALITY AS u(v, p) ON u.v.qty > 40 AND u.p <= 3", _LINES + "SELECT o_orderkey, m.num, m.p FROM orders LEFT JOIN (SELECT * FROM x WHERE qty > 40 AND p <= 3) m ON o_orderkey = l_orderkey")
dialect("unnest_ordinality", "SELECT b.o_orderkey, u.value AS n, u.ordinality AS p FROM baskets b, UNNEST(nums) WITH ORDINALITY AS u WHERE u.value <> u.ordinality OR u.ordinality > 5", _B + "SELECT * FROM (SELECT o_orderkey, unnest(items).num AS n, generate_subscripts(items, 1) AS p FROM b) WHERE n <> p OR p > 5")
dialect("unnest_chain", "SELECT t.value AS tag, COUNT(*) AS n FROM baskets b CROSS JOIN UNNEST(b.items) AS u CROSS JOIN UNNEST(u.value.tags) AS t GROUP BY t.value", "SELECT l_returnflag AS tag, COUNT(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
dialect("unnest_product", "SELECT b.o_orderkey, x.value AS a, y.value AS b2 FROM baskets b CROSS JOIN UNNEST(nums) AS x INNER JOIN UNNEST(nums) AS y ON x.value < y.value", _B + "SELECT o_orderkey, a, b2 FROM (SELECT o_orderkey, x.num AS a, unnest(items).num AS b2 FROM (SELECT o_orderkey, items, unnest(items) AS x FROM b)) WHERE a < b2")
dialect("unnest_embeddings", "SELECT label, COUNT(*) AS n FROM embeddings CROSS JOIN UNNEST(embedding) AS u WHERE u.value > 0 GROUP BY label", "SELECT CAST(label AS BIGINT) AS label, COUNT(*) AS n FROM (SELECT label, unnest(embedding) AS v FROM embeddings) WHERE v > 0 GROUP BY label")
dialect("container_group", "SELECT CARDINALITY(nums) AS k, COUNT(*) AS n FROM baskets GROUP BY nums", _B + "SELECT len(items) AS k, COUNT(*) AS n FROM b GROUP BY list_transform(items, lambda x: x.num), len(items)")
dialect("container_minmax", "SELECT status, u.ordinality AS p, u.value AS hi FROM (SELECT st AS status, MIN(nums) AS least, MAX(nums) AS most FROM (SELECT info.status AS st, nums FROM baskets) t GROUP BY st) g CROSS JOIN UNNEST(most) WITH ORDINALITY AS u", _B + "SELECT status, unnest(range(1, len(most) + 1)) AS p, unnest(most) AS hi FROM (SELECT status, MAX(list_transform(items, lambda x: x.num)) AS most FROM b WHERE items IS NOT NULL GROUP BY 1)")
dialect("container_compare", "SELECT a.o_orderkey, a.nums = b.nums AS same, a.items = b.items AS whole, a.info != b.info AS other, a.nums IN (b.nums) AS listed FROM baskets a JOIN baskets b ON b.o_orderkey = a.o_orderkey + 1", _B + "SELECT a.o_orderkey, n1 = n2 AS same, a.items = b.items AS whole, NOT (a.status = b.status AND a.priority = b.priority AND a.price = b.price) AS other, n1 = n2 AS listed FROM (SELECT *, list_transform(items, lambda x: x.num) AS n1 FROM b) a JOIN (SELECT *, list_transform(items, lambda x: x.num) AS n2 FROM b) b ON b.o_orderkey = a.o_orderkey + 1")
dialect("container_order", "SELECT o_orderkey, nums FROM baskets ORDER BY nums DESC, o_orderkey LIMIT 12", _B + "SELECT o_orderkey, list_transform(items, lambda x: x.num) AS nums FROM b ORDER BY nums DESC NULLS FIRST, o_orderkey LIMIT 12")
QUERIES["container_order"] = (lambda run: lambda spark, sf_dir: run(spark, sf_dir).withColumn("nums", F.array_join("nums", "-")))(QUERIES["container_order"])
ORACLES["container_order"] = f"SELECT o_orderkey, array_to_string(nums, '-') AS nums FROM ({ORACLES['container_order']})"


# several windows, subqueries in HAVING and ON, whole sorts, early stops, values beyond their range
dialect("win_several", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS b, COUNT(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders")
dialect("win_offset_by_row", "SELECT l_orderkey, l_linenumber, LAG(l_quantity, l_linenumber - 2, -1.0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) AS x, LEAD(l_quantity, l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) AS y FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, LAG(l_quantity, CASE WHEN l_linenumber >= 2 THEN l_linenumber - 2 ELSE 1 END, -1.0) OVER w AS x, LEAD(l_quantity, l_linenumber) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey)")
dialect("having_subquery", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) FROM region)")
dialect("on_subquery", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name > 'ASIA')")
dialect("sort_whole", "SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey")
dialect("limit_early", "SELECT COUNT(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 1000) t")
dialect("time_overflow_null", "SELECT r_regionkey, CAST(9223372036854775807 - r_regionkey AS TIMESTAMP) AS a, CAST(CAST(9223372036854775807 - r_regionkey AS DATE) AS VARCHAR) AS b, CAST(DATE '2024-01-01' + INTERVAL '99999999999 days' AS VARCHAR) AS c, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '99999999999 days' AS d, CAST(DATE '2024-01-01' + INTERVAL '31 days' AS VARCHAR) AS e FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, NULL::TIMESTAMP AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c, NULL::TIMESTAMP AS d, '2024-02-01' AS e FROM region")
dialect("double_text", "SELECT r_regionkey, CAST(r_regionkey * 100000000.0 AS VARCHAR) AS a, CAST(r_regionkey * 0.000001 AS VARCHAR) AS b, CONCAT('<', r_regionkey * 12345678.5 - 1.0, '>') AS c FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, CASE r_regionkey WHEN 0 THEN '0' ELSE r_regionkey || '00000000' END AS a, CASE r_regionkey WHEN 0 THEN '0' ELSE '0.00000' || r_regionkey END AS b, CASE r_regionkey WHEN 0 THEN '<-1>' WHEN 1 THEN '<12345677.5>' WHEN 2 THEN '<24691356>' WHEN 3 THEN '<37037034.5>' ELSE '<49382713>' END AS c FROM region")
dialect("decimal_avg", "SELECT o_orderstatus, AVG(CAST(o_totalprice AS DECIMAL(18,2))) AS a FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS a FROM orders GROUP BY o_orderstatus")

# DataFrame helpers
def nested_scan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned scan: two columns of the file, the list kept as it is."""
    scan = nested_scan.scan(spark, f"{sf_dir}/embeddings.parquet", columns=["embedding", "vec_id"])
    return scan.select("vec_id", F.size("embedding").cast("long").alias("n"))


def row_group_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row group only."""
    return nested_scan.scan(spark, f"{sf_dir}/region.parquet", columns=["r_regionkey", "r_name"], row_groups=[0])


def shred_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as nested lists, striped into values with repetition and definition levels, by level."""
    nested = helpers.nest(table(spark, sf_dir, "events"))
    striped = shredding.shred(nested)
    return striped.groupBy("repetition", "definition").agg(F.count("*").alias("n"), F.count("value").alias("k"))


def top_k_helper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DataFrame form of ORDER BY with LIMIT and OFFSET."""
    return helpers.top_k(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", False)], limit=15, offset=2)


def unnest_helper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DataFrame form of LEFT JOIN UNNEST with an ON condition."""
    out = helpers.unnest(_nested(spark, sf_dir, "baskets"), "nums", how="left", on=lambda v, o: (v > 4) & (o > 1), names=("num", "pos"))
    return out.select("o_orderkey", "num", "pos")


QUERIES |= {f.__name__: f for f in (nested_scan_prune, row_group_select, shred_levels, top_k_helper, unnest_helper)}
ORACLES |= {
    "nested_scan_prune": "SELECT vec_id, len(embedding) AS n FROM embeddings",
    "row_group_select": "SELECT r_regionkey, r_name FROM region",
    "shred_levels": "WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS t FROM events) SELECT CASE WHEN i > 1 THEN 2 WHEN t > 1 THEN 1 ELSE 0 END AS repetition, CASE WHEN value IS NULL THEN 2 ELSE 3 END AS definition, COUNT(*) AS n, COUNT(value) AS k FROM e GROUP BY 1, 2",
    "top_k_helper": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 15 OFFSET 2",
    "unnest_helper": _LINES + "SELECT o_orderkey, m.num, m.p AS pos FROM orders LEFT JOIN (SELECT * FROM x WHERE num > 4 AND p > 1) m ON o_orderkey = l_orderkey",
}
