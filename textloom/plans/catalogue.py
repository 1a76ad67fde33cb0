"""Registered queries over the star-schema tables, with the DuckDB SQL that must agree.

Every query is text in the dialect, run by the engine over the tables' files:
names are resolved, operators and functions rewritten, and places that need
types settled, as for any user. The other text is what DuckDB runs on the same
tables; where both read a text alike, one string serves both.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.engine import Engine
from textloom.operators import sqltext

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _run(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialect's text over the files of a folder."""
    named, _ = sqltext.with_tables(text, lambda name: f"{sf_dir}/{name}.parquet" if name in TABLES else name)
    return Engine(spark).sql(named)


def both(name: str, text: str, oracle: str | None = None) -> None:
    QUERIES[name] = functools.partial(_run, text)
    ORACLE_SQL[name] = text if oracle is None else oracle


FLAGSHIP = """
select event_type, count(*) as cnt, round(sum(value) / 1024.0 / 1024, 6) as total
from events group by event_type order by total desc, event_type limit 3"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship shape (group, count, scaled sum, order, limit) through file-name SQL."""
    return _run(FLAGSHIP, spark, sf_dir)


both("sum_kb_group", FLAGSHIP)

# --- projection, filters, expressions
both("scan_project", "select c_custkey, c_name from customer")
both("project_star_alias", "select n.* from nation n where n.n_regionkey = 1")
both("select_no_from", "select 1 + 2 as a, 'x' as b, cast(null as text) as c", "select 1 + 2 as a, 'x' as b, cast(null as varchar) as c")
both("filter_pred", "select o_orderkey, o_orderpriority from orders where o_totalprice > 1000 and not (o_orderstatus = 'P') and o_orderpriority like '1%' and o_orderstatus in ('O', 'F') and o_custkey between 10 and 900")
both("filter_eq_forms", "select s_suppkey from supplier where s_nationkey = 3 or s_suppkey == 7 or (s_nationkey <> 4 and s_nationkey != 5 and s_acctbal < 0)")
both("filter_nulls", "select o_orderkey, nullif(o_orderstatus, 'P') is null as p, nullif(o_orderstatus, 'O') is not null as q from orders where nullif(o_orderstatus, 'F') is not null")
both("null_safe_eq", "select n_nationkey, (n_regionkey is 1) as one, (nullif(n_regionkey, 1) is not 2) as other from nation", "select n_nationkey, (n_regionkey is not distinct from 1) as one, (nullif(n_regionkey, 1) is distinct from 2) as other from nation")
both("like_nocase", "select n_name from nation where n_name like 'nation_1%' and n_name not like '%5'", "select n_name from nation where n_name ilike 'nation_1%' and n_name not ilike '%5'")
both("glob_as_regex", "select n_name, n_name glob 'n*' as small from nation where n_name glob 'N[A-Z_0-9]*[0-9]' and n_name not glob '*_?'", "select n_name, regexp_matches(n_name, '^n.*$') as small from nation where regexp_matches(n_name, '^N[A-Z_0-9].*[0-9]$') and not regexp_matches(n_name, '^.*_.$')")
both("collate_nocase", "select count(*) as n from nation where n_name = 'Nation_3' collate nocase", "select count(*) as n from nation where lower(n_name) = lower('Nation_3')")
both("case_null", "select o_orderkey, case when o_totalprice > 200000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as size, coalesce(nullif(o_orderstatus, 'O'), 'none') as st, ifnull(nullif(o_orderstatus, 'F'), '-') as i, iif(o_custkey > 100, 1, 0) as f from orders", "select o_orderkey, case when o_totalprice > 200000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as size, coalesce(nullif(o_orderstatus, 'O'), 'none') as st, ifnull(nullif(o_orderstatus, 'F'), '-') as i, if(o_custkey > 100, 1, 0) as f from orders")
both("int_div", "select l_orderkey, l_linenumber, l_partkey / 7 as d, l_partkey % 7 as m, -l_partkey / 7 as neg, l_partkey / 7.0 as real, (l_partkey + 1) / 2 / 3 as twice, l_quantity / 2 as half from lineitem", "select l_orderkey, l_linenumber, l_partkey // 7 as d, l_partkey % 7 as m, cast(trunc(-l_partkey / 7) as bigint) as neg, l_partkey / 7.0::double as real, (l_partkey + 1) // 2 // 3 as twice, l_quantity / 2 as half from lineitem")
both("divide_by_zero", "select n_nationkey, n_nationkey * 1.0 / n_regionkey as q, cast(n_nationkey / n_regionkey as integer) as i from nation", "select n_nationkey, case when n_regionkey = 0 then null else cast(n_nationkey as double) / n_regionkey end as q, case when n_regionkey = 0 then null else cast(n_nationkey // n_regionkey as bigint) end as i from nation")
both("bit_ops", "select n_nationkey, n_nationkey & 6 as a, n_nationkey | 8 as o, ~n_nationkey as n, n_nationkey << 2 as l, n_nationkey >> 1 as r from nation")
both("casts", "select c_custkey, cast(c_acctbal as text) is null as s, cast(c_acctbal as integer) as t, cast(c_mktsegment as integer) as none, cast(c_custkey || ' apples' as integer) as first, cast(c_custkey || '.5x' as real) as r from customer", "select c_custkey, cast(c_acctbal as varchar) is null as s, cast(trunc(c_acctbal) as bigint) as t, cast(0 as bigint) as none, c_custkey as first, c_custkey + 0.5::double as r from customer")
both("concat_op", "select n_nationkey, n_name || '-' || cast(n_regionkey as text) as s, n_name || nullif(n_name, n_name) as z from nation", "select n_nationkey, n_name || '-' || cast(n_regionkey as varchar) as s, n_name || nullif(n_name, n_name) as z from nation")
both("distinct_rows", "select distinct o_orderstatus, o_orderpriority from orders")
both("row_values", "select n_nationkey from nation where (n_regionkey, n_nationkey) in ((1, 1), (2, 8), (3, 3))")

# --- joins
both("inner_join", "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where o.o_totalprice > 300000")
both("left_join", "select c.c_custkey, count(o.o_orderkey) as n from customer c left join orders o on c.c_custkey = o.o_custkey group by c.c_custkey")
both("right_join", "select o.o_orderkey, n.n_name from orders o right join nation n on o.o_custkey = n.n_nationkey * 3")
both("full_outer", "select c.c_custkey, s.s_suppkey from customer c full outer join supplier s on c.c_custkey = s.s_suppkey * 20")
both("expr_equi_join", "select n.n_name, c.c_custkey from nation n join customer c on n.n_nationkey * 10 = c.c_custkey")
both("cross_join", "select r_name, n_name from region cross join nation")
both("comma_join", "select r.r_name, n.n_name from region r, nation n where r.r_regionkey = n.n_regionkey")
both("theta_join", "select a.n_name as a_name, b.n_name as b_name from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey")
both("range_join", "select s.s_suppkey, count(*) as n from supplier s join customer c on c.c_acctbal between s.s_acctbal - 5 and s.s_acctbal + 5 group by s.s_suppkey")
both("self_join3", "select a.n_name as x, b.n_name as y, c.n_name as z from nation a join nation b on a.n_regionkey = b.n_regionkey join nation c on b.n_nationkey = c.n_nationkey + 1")
both("using_join", "select n_regionkey, count(*) as n from nation a join nation b using (n_regionkey) group by n_regionkey")
both("natural_join", "select k, a_name, b_name from (select n_nationkey as k, n_name as a_name from nation) x natural join (select s_nationkey as k, s_name as b_name from supplier) y")
both("semi_exists", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 350000)")
both("in_subq", "select s_name from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
both("anti_not_exists", "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)")
both("not_in_subq", "select n_name from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)")
both("not_in_null_subq", "select count(*) as n from nation where n_nationkey not in (select nullif(s_nationkey, 3) from supplier)")

# --- aggregation
both("agg_basic", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 4) as q, round(avg(l_extendedprice), 4) as p, min(l_discount) as lo, max(l_tax) as hi from lineitem group by l_returnflag, l_linestatus")
both("pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as cnt from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as cnt from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus")
both("count_forms", "select count(*) as a, count(1) as b, count(nullif(o_orderstatus, 'O')) as c from orders")
both("count_distinct", "select o_orderstatus, count(distinct o_custkey) as n, count(distinct o_orderpriority) as m from orders group by o_orderstatus")
both("group_having_alias", "select o_custkey, count(*) as n from orders group by o_custkey having n > 12")
both("group_expr_ordinal", "select o_custkey % 10 as k, count(*) as n from orders group by 1")
both("filter_agg", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, round(sum(o_totalprice) filter (where o_custkey < 500), 2) as s from orders group by o_orderpriority")
both("total_agg", "select o_orderpriority, total(case when o_custkey < 0 then 1 end) as t, total(o_custkey) as u from orders group by o_orderpriority", "select o_orderpriority, cast(0 as double) as t, cast(sum(o_custkey) as double) as u from orders group by o_orderpriority")
both("group_concat", "select n_regionkey, length(group_concat(n_name)) as n, length(group_concat(n_name, ' and ')) as m, group_concat(distinct cast(n_regionkey as text)) as k from nation group by n_regionkey", "select n_regionkey, cast(length(string_agg(n_name, ',')) as int) as n, cast(length(string_agg(n_name, ' and ')) as int) as m, cast(n_regionkey as varchar) as k from nation group by n_regionkey")
both("group_array_json", "select n_regionkey, length(json_group_array(n_nationkey)) as n, max(json_array(n_regionkey, n_regionkey + 1)) as j from nation group by n_regionkey", "select n_regionkey, cast(length(cast(to_json(list(n_nationkey)) as varchar)) as int) as n, '[' || n_regionkey || ',' || (n_regionkey + 1) || ']' as j from nation group by n_regionkey")
both("bare_column_max", "select o_orderpriority, max(o_totalprice) as top, o_orderkey as k, o_orderdate from orders group by o_orderpriority", "select o_orderpriority, max(o_totalprice) as top, arg_max(o_orderkey, o_totalprice) as k, arg_max(o_orderdate, o_totalprice) as o_orderdate from orders group by o_orderpriority")
both("scalar_min_max", "select c_custkey, min(c_acctbal, 100.0) as lo, max(c_acctbal, 100.0, 50.5) as hi, max(nullif(c_acctbal, c_acctbal), 1.0) as none from customer", "select c_custkey, least(c_acctbal, 100::double) as lo, greatest(c_acctbal, 100::double) as hi, cast(null as double) as none from customer")
both("percentile", "select event_type, percentile(value, 0.5) as p50, percentile(value, 0.9) as p90, percentile(value, 1 - 0.75) as p25, percentile(value, 2) as none from events group by event_type", "select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.25) as p25, cast(null as double) as none from events group by event_type")
both("stddev", "select event_type, round(stddev_pop(value), 6) as p, round(stddev_sample(value), 6) as s from events group by event_type", "select event_type, round(stddev_pop(value), 6) as p, round(stddev_samp(value), 6) as s from events group by event_type")
both("grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
both("cube_rollup", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority) union all select o_orderstatus, o_orderpriority, -count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")

# --- windows
both("window_ranks", "select o_orderkey, cast(row_number() over w as bigint) as rn, cast(rank() over w as bigint) as rk, cast(dense_rank() over w as bigint) as dr, cast(ntile(4) over w as bigint) as nt, round(percent_rank() over w, 9) as pr, round(cume_dist() over w, 9) as cd from orders where o_custkey < 200 window w as (partition by o_orderstatus order by o_totalprice, o_orderkey)")
both("window_lag", "select o_orderkey, lag(o_totalprice) over w as prev, lead(o_totalprice, 2) over w as next2, first_value(o_orderkey) over w as f, last_value(o_orderkey) over w as l, nth_value(o_orderkey, 2) over w as n2 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
both("window_frame", "select l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between 1 preceding and 1 following), 4) as s, round(avg(l_quantity) over (partition by l_orderkey), 6) as a from lineitem")
both("window_range", "select o_orderkey, count(*) over (partition by o_custkey order by o_totalprice range between 50000 preceding and current row) as n from orders")
both("window_groups", "select n_nationkey, sum(n_nationkey) over (order by n_regionkey groups between 1 preceding and current row) as s, count(*) over w as c, max(n_nationkey) over w as m from nation window w as (partition by n_nationkey % 2 order by n_regionkey groups between current row and 2 following)", "select n_nationkey, cast(sum(n_nationkey) over (order by n_regionkey groups between 1 preceding and current row) as bigint) as s, count(*) over w as c, max(n_nationkey) over w as m from nation window w as (partition by n_nationkey % 2 order by n_regionkey groups between current row and 2 following)")
both("window_exclude", "select n_nationkey, sum(n_nationkey) over (partition by n_regionkey rows between unbounded preceding and unbounded following exclude current row) as s, count(*) over (partition by n_nationkey % 2 order by n_regionkey groups between 1 preceding and 1 following exclude group) as c, min(n_nationkey) over (partition by n_nationkey % 2 order by n_regionkey groups between 1 preceding and current row exclude ties) as m, round(avg(n_nationkey) over (order by n_nationkey rows between 2 preceding and 2 following exclude current row), 9) as a from nation", "select n_nationkey, cast(sum(n_nationkey) over (partition by n_regionkey rows between unbounded preceding and unbounded following exclude current row) as bigint) as s, count(*) over (partition by n_nationkey % 2 order by n_regionkey groups between 1 preceding and 1 following exclude group) as c, min(n_nationkey) over (partition by n_nationkey % 2 order by n_regionkey groups between 1 preceding and current row exclude ties) as m, round(avg(n_nationkey) over (order by n_nationkey rows between 2 preceding and 2 following exclude current row), 9) as a from nation")

# --- order, sets, subqueries
both("order_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5 offset 2")
both("order_nulls", "select o_orderkey, nullif(o_orderstatus, 'F') as st from orders order by st nulls first, o_orderkey limit 20")
both("union_all", "select n_name as name from nation union all select r_name as name from region union all select n_name as name from nation")
both("union_distinct", "select n_regionkey as k from nation union select r_regionkey as k from region")
both("except_rows", "select n_nationkey as k from nation except select s_nationkey as k from supplier where s_acctbal > 2000")
both("intersect_rows", "select s_nationkey as k from supplier intersect select n_nationkey as k from nation where n_regionkey < 3")
both("from_subq", "select k, count(*) as n from (select n_regionkey as k from nation union all select r_regionkey as k from region) u group by k")
both("scalar_subq", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
both("corr_scalar", "select c_custkey, (select max(o_totalprice) from orders o where o.o_custkey = c.c_custkey) as top from customer c")
both("cte", "with a as (select n_regionkey as k, count(*) as n from nation group by n_regionkey), b as (select max(n) as m from a) select a.k, a.n from a join b on a.n = b.m")
both("rec_cte", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 50) select n from t")
both("values_rows", "select a, b from (values (1, 'x'), (2, 'y'), (3, null)) as t(a, b)")

# --- functions
both("md5", "select n_nationkey, md5(n_name, 'utf-8') as h from nation", "select n_nationkey, md5(n_name) as h from nation")
both("sha1", "select n_nationkey, sha1(n_name) as h from nation")
both("sha256", "select n_nationkey, sha(n_name, 256, 'utf-8') as h, sha(n_name, 1, 'utf-8') as o from nation", "select n_nationkey, sha256(n_name) as h, sha1(n_name) as o from nation")
both("regexp", "select n_name, regexp('[0-4]$', n_name) as hit, regexp('^N', nullif(n_regionkey, 1) || n_name) as none from nation where n_name regexp '[0-8]$' and not nullif(n_name, 'NATION_7') regexp '2$'", "select n_name, cast(regexp_matches(n_name, '[0-4]$') as int) as hit, 0 as none from nation where regexp_matches(n_name, '[0-8]$') and not coalesce(regexp_matches(nullif(n_name, 'NATION_7'), '2$'), false)")
both("regexp_extract", r"select n_name, regexp_extract('_(\d+)', n_name, 0) as g, regexp_extract('([A-Z]+)_(5.*)', n_name, 1) as tail from nation", r"select n_name, nullif(regexp_extract(n_name, '_(\d+)', 1), '') as g, nullif(regexp_extract(n_name, '([A-Z]+)_(5.*)', 2), '') as tail from nation")
both("math", "select c_custkey, round(sqrt(abs(c_acctbal)), 9) as s, round(power(c_acctbal, 2), 4) as p, abs(c_acctbal) as a, cast(round(c_acctbal, 0) as bigint) as r, cast(sign(c_acctbal) as bigint) as g, round(ln(abs(c_acctbal) + 1), 9) as l, round(exp(c_custkey % 5), 6) as e, cast(ceil(c_acctbal) as bigint) as c, cast(floor(c_acctbal) as bigint) as f, round(degrees(1.0), 9) as d, round(sin(c_custkey), 6) as si from customer", "select c_custkey, round(sqrt(abs(c_acctbal)), 9) as s, round(power(c_acctbal, 2), 4) as p, abs(c_acctbal) as a, cast(round(c_acctbal, 0) as bigint) as r, cast(sign(c_acctbal) as bigint) as g, round(ln(abs(c_acctbal) + 1), 9) as l, round(exp(c_custkey % 5), 6) as e, cast(ceil(c_acctbal) as bigint) as c, cast(floor(c_acctbal) as bigint) as f, round(degrees(1.0), 9) as d, round(sin(c_custkey), 6) as si from customer")
both("string", "select p_partkey, upper(p_name) as u, lower(p_brand) as l, cast(length(p_name) as bigint) as n, substr(p_name, 2, 4) as s, cast(instr(p_name, 'a') as bigint) as i, replace(p_name, 'a', '#') as r, trim('  ' || p_brand || ' ') as t, ltrim('  x') as lt, rtrim('x  ') as rt, substr(p_name, -3) as tail from part")
both("ascii_char_hex", "select n_nationkey, cast(unicode(n_name) as integer) as a, char(65 + n_nationkey) as c, char(n_nationkey + 97, 233, 8364) as m, hex(n_name) as h from nation", "select n_nationkey, cast(unicode(n_name) as bigint) as a, chr(65 + n_nationkey) as c, chr(n_nationkey + 97) || chr(233) || chr(8364) as m, hex(n_name) as h from nation")
both("printf", "select c_custkey, printf('%05d|%.2f|%s', c_custkey, c_acctbal, c_mktsegment) as s from customer")
both("json", "select event_id, json_extract(props, '$.k') as k, json_valid(props) as v from events", "select event_id, json_extract_string(props, '$.k') as k, cast(json_valid(props) as int) as v from events")
both("json_build", "select n_nationkey, json_object('k', n_nationkey, 'n', n_name) as j from nation", "select n_nationkey, cast(json_object('k', n_nationkey, 'n', n_name) as varchar) as j from nation")
both("strftime_group", "select strftime('%H:%M', ts) as hm, count(*) as n from events group by 1", "select strftime(ts, '%H:%M') as hm, count(*) as n from events group by 1")
both("date_parts", "select o_orderkey, strftime('%Y-%m-%d', o_orderdate) as d, cast(strftime('%Y', o_orderdate) as integer) as y, cast(strftime('%j', o_orderdate) as integer) as j, date(o_orderdate, '+30 days') as later, date(o_orderdate, 'start of month') as m, julianday(date(o_orderdate)) as jd from orders", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d, year(o_orderdate) as y, dayofyear(o_orderdate) as j, strftime(o_orderdate + interval 30 day, '%Y-%m-%d') as later, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as m, datediff('day', date '1970-01-01', cast(o_orderdate as date)) + 2440587.5::double as jd from orders")
both("generate_series", "select value as i from generate_series(1, 100) union all select -value as i from generate_series(10, 30, 5)", "select generate_series as i from generate_series(1, 100) union all select -generate_series as i from generate_series(10, 30, 5)")
both("where_number", "select n_nationkey from nation where n_regionkey and n_nationkey > 3 or regexp('_2$', n_name)", "select n_nationkey from nation where (n_regionkey <> 0 and n_nationkey > 3) or regexp_matches(n_name, '_2$')")
both("sum_of_truths", "select n_regionkey, sum(n_name like '%1%') as a, sum(n_nationkey > 10) as b, count(*) / 2 as half from nation group by n_regionkey", "select n_regionkey, cast(sum(cast(n_name ilike '%1%' as int)) as bigint) as a, cast(sum(cast(n_nationkey > 10 as int)) as bigint) as b, count(*) // 2 as half from nation group by n_regionkey")
both("bare_columns_alone", "select o_orderkey, o_custkey, min(o_totalprice) as least from orders", "select arg_min(o_orderkey, o_totalprice) as o_orderkey, arg_min(o_custkey, o_totalprice) as o_custkey, min(o_totalprice) as least from orders")
both("limit_pair", "select o_orderkey from orders order by o_orderkey limit 5, 10", "select o_orderkey from orders order by o_orderkey limit 10 offset 5")
both("typeof_quote", "select n_nationkey, typeof(n_name) as t, typeof(n_nationkey) as i, typeof(n_nationkey * 1.5) as r, quote(n_name) as q from nation", "select n_nationkey, 'text' as t, 'integer' as i, 'real' as r, chr(39) || n_name || chr(39) as q from nation")
