"""The inherited SQL surface: one query for each family, as Spark runs it and as DuckDB does.

A second text stands only where the dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .guard import ReadOnly, check_size

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages", "labels", "benchmark", "embeddings")

FAMILIES: dict[str, str | tuple[str, str]] = {
    "sql_group_order": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY n DESC",
    "sql_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12",
    "sql_inner_join": "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
    "sql_outer_joins": "SELECT coalesce(c.c_custkey, -1) AS custkey, coalesce(o.n, 0) AS n FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0) c FULL OUTER JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15) o ON c.c_custkey = o.o_custkey",
    "sql_left_right": "SELECT s.s_suppkey, n.n_name FROM nation n RIGHT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND n.n_regionkey = 1",
    "sql_semi_anti": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000)",
    "sql_theta_self_join": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_natural_using": "SELECT r_name, n_name FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) x JOIN region USING (r_regionkey)",
    "sql_lateral": "SELECT r_name, top.n_name AS n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name DESC LIMIT 2) top",
    "sql_range_join": "SELECT p.p_partkey, b.lo FROM part p JOIN (SELECT * FROM (VALUES (1, 10), (11, 30), (31, 50)) AS t(lo, hi)) b ON p.p_size BETWEEN b.lo AND b.hi",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "sql_rollup": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "sql_cube": "SELECT p_brand, p_size % 5 AS s, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size % 5)",
    "sql_statistics": "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_retailprice), 3) AS vp, round(corr(p_size, p_retailprice), 6) AS r, round(median(p_retailprice), 4) AS med FROM part GROUP BY p_brand",
    "sql_filter_aggregate": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) AS customers, bool_or(o_totalprice > 400000) AS big, bool_and(o_totalprice > 0) AS positive, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS open_orders FROM orders GROUP BY o_orderpriority",
    "sql_percentiles": ("SELECT l_returnflag, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p25, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag"),
    "sql_string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, array_join(array_sort(collect_set(substring(n_name, 1, 1))), '') AS firsts FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, array_to_string(list_sort(list_distinct(list(substring(n_name, 1, 1)))), '') AS firsts FROM nation GROUP BY n_regionkey"),
    "sql_window_ranks": "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)",
    "sql_window_frames": "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER w AS n2, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "sql_groups_frame": ("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY d RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d FROM customer)", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM customer"),
    "sql_top_k_per_group": "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3",
    "sql_set_operations": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT r_regionkey FROM region",
    "sql_except_all": "SELECT o_custkey % 7 AS k FROM orders EXCEPT ALL SELECT c_custkey % 7 FROM customer",
    "sql_subqueries": "SELECT p_partkey, (SELECT count(*) FROM lineitem l WHERE l.l_partkey = p.p_partkey) AS n FROM part p WHERE p_size = (SELECT max(p_size) FROM part) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1)",
    "sql_cte": "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), ranked AS (SELECT o_custkey, s, ntile(10) OVER (ORDER BY s DESC, o_custkey) AS decile FROM spend) SELECT CAST(decile AS BIGINT) AS decile, count(*) AS n, round(min(s), 2) AS least FROM ranked GROUP BY decile",
    "sql_recursive_cte": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "sql_strings": ("SELECT n_nationkey, lower(n_name) AS lo, initcap(n_name) AS ic, lpad(n_name, 12, '*') AS lp, reverse(n_name) AS rv, replace(n_name, 'A', '_') AS rp, CAST(instr(n_name, 'A') AS BIGINT) AS pos, split_part(n_name, 'A', 1) AS sp, concat_ws('-', n_name, n_regionkey) AS cw, CAST(length(n_name) AS BIGINT) AS ln, startswith(n_name, 'A') AS sw, substring(n_name, 2, 3) AS ss, trim(concat(' ', n_name, ' ')) AS tr, n_name LIKE '%A%' AS lk, n_name ILIKE '%a%' AS il FROM nation", "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name[1]) || lower(n_name[2:]) AS ic, lpad(n_name, 12, '*') AS lp, reverse(n_name) AS rv, replace(n_name, 'A', '_') AS rp, CAST(instr(n_name, 'A') AS BIGINT) AS pos, split_part(n_name, 'A', 1) AS sp, concat_ws('-', n_name, n_regionkey) AS cw, CAST(length(n_name) AS BIGINT) AS ln, starts_with(n_name, 'A') AS sw, substring(n_name, 2, 3) AS ss, trim(concat(' ', n_name, ' ')) AS tr, n_name LIKE '%A%' AS lk, n_name ILIKE '%a%' AS il FROM nation"),
    "sql_regex": (r"SELECT doc_id, regexp_like(text, '[0-9]{3}') AS has, regexp_extract(text, '([A-Za-z]+)', 1) AS word, CAST(regexp_count(text, '[.!?]') AS BIGINT) AS ends, regexp_replace(text, '[aeiou]', '_') AS rep, text RLIKE '\\|' AS pipe FROM documents", r"SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS has, regexp_extract(text, '([A-Za-z]+)', 1) AS word, CAST(len(regexp_extract_all(text, '[.!?]')) AS BIGINT) AS ends, regexp_replace(text, '[aeiou]', '_', 'g') AS rep, regexp_matches(text, '\|') AS pipe FROM documents"),
    "sql_dates": ("SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(date_part('month', o_orderdate) AS BIGINT) AS m, CAST(unix_timestamp(date_trunc('month', o_orderdate)) AS BIGINT) AS t, CAST(unix_timestamp(o_orderdate + INTERVAL 3 DAYS) AS BIGINT) AS later, CAST(floor(unix_timestamp(o_orderdate) / 604800) AS BIGINT) AS bin FROM orders", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(date_part('month', o_orderdate) AS BIGINT) AS m, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS t, CAST(epoch(o_orderdate + INTERVAL 3 DAYS) AS BIGINT) AS later, CAST(floor(epoch(o_orderdate) / 604800) AS BIGINT) AS bin FROM orders"),
    "sql_math": "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS sq, round(ln(p_retailprice), 6) AS l, round(power(p_size, 2), 2) AS pw, CAST(floor(p_retailprice / 7) AS BIGINT) AS fl, CAST(ceil(p_retailprice / 7) AS BIGINT) AS ce, p_size % 7 AS md, greatest(p_size, 20) AS g, least(p_size, 20) AS le, CAST(sign(p_size - 25) AS BIGINT) AS sg FROM part",
    "sql_arrays": ("SELECT l_orderkey, array_join(transform(array_sort(collect_list(l_linenumber)), x -> CAST(x AS STRING)), ',') AS lines, array_contains(collect_list(l_linenumber), 3) AS has3, CAST(size(collect_set(l_returnflag)) AS BIGINT) AS flags, CAST(aggregate(collect_list(l_linenumber), 0, (a, x) -> a + x) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS lines, list_contains(list(l_linenumber), 3) AS has3, CAST(len(list_distinct(list(l_returnflag))) AS BIGINT) AS flags, CAST(list_sum(list(l_linenumber)) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey"),
    "sql_unnest": ("SELECT vec_id, CAST(pos + 1 AS BIGINT) AS i, round(CAST(x AS DOUBLE), 5) AS x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(x AS DOUBLE), 5) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"),
    "sql_map_struct": ("SELECT r_regionkey, named_struct('k', r_regionkey, 'n', r_name).n AS n, element_at(map('a', r_regionkey, 'b', r_regionkey + 1), 'b') AS b FROM region", "SELECT r_regionkey, struct_pack(k := r_regionkey, n := r_name).n AS n, MAP {'a': r_regionkey, 'b': r_regionkey + 1}['b'] AS b FROM region"),
    "sql_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, props LIKE '%\"k\"%' AS has FROM events", "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k, props LIKE '%\"k\"%' AS has FROM events"),
    "sql_null_logic": ("SELECT doc_id, coalesce(nullif(lang, 'en'), 'x') AS l, lang <=> source AS same, CASE WHEN lang IS NULL THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END AS c, lang IS DISTINCT FROM 'fr' AS d FROM documents", "SELECT doc_id, coalesce(nullif(lang, 'en'), 'x') AS l, lang IS NOT DISTINCT FROM source AS same, CASE WHEN lang IS NULL THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END AS c, lang IS DISTINCT FROM 'fr' AS d FROM documents"),
    "sql_sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5",
    "sql_values_series": ("SELECT id AS n, id * id AS sq, t.name AS name FROM range(1, 11) JOIN (VALUES (1, 'one'), (4, 'four'), (9, 'nine')) AS t(k, name) ON id = t.k", "SELECT n, n * n AS sq, t.name AS name FROM generate_series(1, 10) AS g(n) JOIN (VALUES (1, 'one'), (4, 'four'), (9, 'nine')) AS t(k, name) ON n = t.k"),
    "sql_distinct": "SELECT DISTINCT l_shipdate IS NULL AS missing, l_returnflag, l_linestatus FROM lineitem",
    "sql_union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
}


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for name in TABLES:
        if name in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = FAMILIES[name]
    text = text if isinstance(text, str) else text[0]
    check_size(text)
    ReadOnly(spark, TABLES).statement(text)
    views(spark, sf_dir, text)
    return spark.sql(text)


def oracle(name: str) -> str:
    text = FAMILIES[name]
    return text if isinstance(text, str) else text[1]
