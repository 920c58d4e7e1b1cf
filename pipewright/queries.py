"""Driver queries: programs over the test tables, and the SQL that must give the same rows.

Each entry: name -> (table, program, SQL).  Doubles are rounded to 4 digits on both sides, as sums differ in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright import catalogue_io
from pipewright.catalogue import FAMILIES
from pipewright.operators.dynamic import apply_rows
from pipewright.plans.lower import lower

FLAGSHIP = """
map(select(.l_quantity > 25) | {flag: .l_returnflag, status: .l_linestatus, price: .l_extendedprice, paid: (.l_extendedprice * (1 - .l_discount))})
| group_by(.flag, .status)
| map({flag: .[0].flag, status: .[0].status, n: length, total: (map(.price) | add), mean: (map(.paid) | add / length), top: (map(.price) | max)})
"""

PROGRAMS: dict[str, tuple[str, str, str]] = {
    "flagship_report": ("lineitem", FLAGSHIP, "select l_returnflag as flag, l_linestatus as status, count(*) as n, round(sum(l_extendedprice), 4) as total, round(avg(l_extendedprice * (1 - l_discount)), 4) as mean, max(l_extendedprice) as top from lineitem where l_quantity > 25 group by 1, 2"),
    "project_object": ("orders", ".[] | {k: .o_orderkey, p: .o_totalprice}", "select o_orderkey as k, round(o_totalprice, 4) as p from orders"),
    "select_filter": ("orders", ".[] | select(.o_totalprice > 100000 and .o_orderstatus == \"O\") | {o_orderkey}", "select o_orderkey from orders where o_totalprice > 100000 and o_orderstatus = 'O'"),
    "select_not": ("orders", ".[] | select(.o_orderstatus == \"O\" | not) | {o_orderkey}", "select o_orderkey from orders where not (o_orderstatus = 'O')"),
    "if_elif": ("part", ".[] | {p_partkey, size: (if .p_size < 10 then \"small\" elif .p_size < 30 then \"middle\" else \"large\" end)}", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end as size from part"),
    "arithmetic": ("lineitem", ".[] | {l_orderkey, l_linenumber, net: (.l_extendedprice * (1 - .l_discount) + .l_tax), neg: (-.l_quantity), half: (.l_quantity / 2), odd: (.l_orderkey % 7)}", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) as net, -l_quantity as neg, l_quantity / 2 as half, l_orderkey % 7 as odd from lineitem"),
    "alternative": ("orders", ".[] | {o_orderkey, s: (.o_orderstatus // \"none\")}", "select o_orderkey, coalesce(o_orderstatus, 'none') as s from orders"),
    "bind_variable": ("orders", ".[] | .o_totalprice as $p | {o_orderkey, double: ($p * 2)}", "select o_orderkey, round(o_totalprice * 2, 4) as double from orders"),
    "sort_limit": ("orders", "sort_by(-.o_totalprice, .o_orderkey) | .[:20] | map({o_orderkey, o_totalprice})", "select o_orderkey, round(o_totalprice, 4) as o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20"),
    "slice_window": ("orders", "sort_by(.o_orderkey) | .[10:25] | map({o_orderkey})", "select o_orderkey from orders order by o_orderkey limit 15 offset 10"),
    "limit_skip": ("customer", "sort_by(.c_custkey) | limit(7; skip(3; .[])) | {c_custkey}", "select c_custkey from customer order by c_custkey limit 7 offset 3"),
    "first_row": ("customer", "sort_by(.c_name) | first | {c_name}", "select c_name from customer order by c_name limit 1"),
    "length_table": ("orders", "length", "select count(*) as value from orders"),
    "add_table": ("orders", "map(.o_totalprice) | add", "select round(sum(o_totalprice), 4) as value from orders"),
    "min_table": ("orders", "map({p: .o_totalprice}) | min", "select round(min(o_totalprice), 4) as p from orders"),
    "any_table": ("orders", "any(.o_totalprice > 400000)", "select bool_or(o_totalprice > 400000) as value from orders"),
    "all_table": ("orders", "all(.o_totalprice > 0)", "select bool_and(o_totalprice > 0) as value from orders"),
    "reduce_sum": ("lineitem", "reduce .[] as $r (0; . + $r.l_quantity * $r.l_tax)", "select round(sum(l_quantity * l_tax), 4) as value from lineitem"),
    "group_count": ("orders", "group_by(.o_orderstatus) | map({s: .[0].o_orderstatus, n: length})", "select o_orderstatus as s, count(*) as n from orders group by 1"),
    "group_many": ("lineitem", "group_by(.l_returnflag) | map({f: .[0].l_returnflag, low: (map(.l_quantity) | min), high: (map(.l_quantity) | max), parts: (map(.l_partkey) | unique | length), big: (map(select(.l_quantity > 40)) | length)})", "select l_returnflag as f, min(l_quantity) as low, max(l_quantity) as high, count(distinct l_partkey) as parts, count(*) filter (where l_quantity > 40) as big from lineitem group by 1"),
    "group_collect": ("nation", "group_by(.n_regionkey) | map({r: .[0].n_regionkey, names: (map(.n_name) | sort)})", "select n_regionkey as r, list(n_name order by n_name) as names from nation group by 1"),
    "group_min_by": ("part", "group_by(.p_brand) | map({b: .[0].p_brand, cheapest: (min_by(.p_retailprice * 1000000 + .p_partkey).p_partkey)})", "select p_brand as b, arg_min(p_partkey, p_retailprice * 1000000 + p_partkey) as cheapest from part group by 1"),
    "max_by_row": ("orders", "max_by(.o_totalprice) | {o_orderkey}", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 1"),
    "unique_rows": ("orders", "map({s: .o_orderstatus, p: .o_orderpriority}) | unique", "select distinct o_orderstatus as s, o_orderpriority as p from orders"),
    "unique_by": ("nation", "map({n_regionkey, n_nationkey}) | unique_by(.n_regionkey)", "select n_regionkey, min(n_nationkey) as n_nationkey from nation group by 1"),
    "del_field": ("nation", "map(del(.n_name))", "select n_nationkey, n_regionkey from nation"),
    "pick_fields": ("nation", "map(pick(.n_name, .n_nationkey))", "select n_name, n_nationkey from nation"),
    "assign_update": ("nation", ".[] | .n_nationkey += 100 | .n_name |= ascii_downcase", "select n_nationkey + 100 as n_nationkey, lower(n_name) as n_name, n_regionkey from nation"),
    "join_inner": ("orders", "join_inner($customer; .o_custkey; .c_custkey) | map({o_orderkey, c_name})", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"),
    "join_left": ("customer", "join_left($orders; .c_custkey; .o_custkey) | map({c_custkey, o_orderkey})", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey"),
    "semi_in": ("customer", "join_semi($orders; .c_custkey; .o_custkey) | map({c_custkey})", "select c_custkey from customer where c_custkey in (select o_custkey from orders)"),
    "anti_in": ("supplier", "join_anti($customer; .s_suppkey; .c_custkey * 2) | map({s_suppkey})", "select s_suppkey from supplier where s_suppkey not in (select c_custkey * 2 from customer)"),
    "union_plus": ("nation", ". + $nation", "select * from nation union all select * from nation"),
    "minus_rows": ("nation", "map({n_nationkey, n_name: (if .n_regionkey == 1 then (.n_name | ascii_downcase) else .n_name end), n_regionkey}) | . - $nation", "select n_nationkey, lower(n_name) as n_name, n_regionkey from nation where n_regionkey = 1"),
    "running_total": ("events", "running(\"total\"; .user_id; [.ts, .event_id]; .value) | map({event_id, total})", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as total from events"),
    "top_per_group": ("orders", "top_per(3; .o_custkey; [-.o_totalprice, .o_orderkey]) | map({o_custkey, o_orderkey})", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3"),
    "array_sum": ("embeddings", ".[] | {vec_id, s: (.embedding | map(. * 1.0) | add), top: (.embedding | max), n: (.embedding | array_length)}", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as s, round(list_max(embedding)::double, 4) as top, len(embedding) as n from embeddings"),
    "array_filter": ("embeddings", ".[] | {vec_id, n: ([.embedding[] | select(. > 0)] | array_length), any: (.embedding | any(. > 2.5))}", "select vec_id, len(list_filter(embedding, lambda x: x > 0)) as n, len(list_filter(embedding, lambda x: x > 2.5)) > 0 as any from embeddings"),
    "array_reduce": ("embeddings", ".[] | {vec_id, s: (reduce .embedding[] as $x (0.0; . + $x * $x))}", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as s from embeddings"),
    "iterate_array": ("embeddings", ".[] | .embedding[] | {v: .}", "select round(unnest(embedding)::double, 4) as v from embeddings"),
    "range_rows": ("nation", ".[] | range(.n_regionkey)", "select unnest(range(n_regionkey::bigint)) as value from nation"),
    "comma_outputs": ("nation", ".[] | (.n_nationkey, .n_regionkey)", "select n_nationkey as value from nation union all select n_regionkey from nation"),
    "string_case": ("part", ".[] | {p_partkey, u: (.p_name | ascii_upcase), n: (.p_name | string_length)}", "select p_partkey, upper(p_name) as u, length(p_name) as n from part"),
    "string_split": ("part", ".[] | {p_partkey, w: (.p_name | split(\" \") | join(\"-\"))}", "select p_partkey, replace(p_name, ' ', '-') as w from part"),
    "string_test": ("part", ".[] | select(.p_name | test(\"r.*g\")) | {p_partkey}", "select p_partkey from part where regexp_matches(p_name, 'r.*g')"),
    "string_gsub": ("part", ".[] | {p_partkey, s: (.p_name | gsub(\"[0-9]+\"; \"#\")), t: (.p_type | sub(\"[A-Z]\"; \"_\"))}", "select p_partkey, regexp_replace(p_name, '[0-9]+', '#', 'g') as s, regexp_replace(p_type, '[A-Z]', '_') as t from part"),
    "string_trim": ("part", ".[] | {p_partkey, l: (.p_name | ltrimstr(\"part\")), s: (.p_name | startswith(\"p\"))}", "select p_partkey, case when starts_with(p_name, 'part') then substr(p_name, 5) else p_name end as l, starts_with(p_name, 'p') as s from part"),
    "string_interpolation": ("part", ".[] | {p_partkey, t: \"\\(.p_brand)/\\(.p_size)\"}", "select p_partkey, p_brand || '/' || p_size as t from part"),
    "scan_all": ("part", ".[] | {p_partkey, d: (.p_name | scan(\"[0-9]\") | array_length)}", "select p_partkey, len(regexp_extract_all(p_name, '[0-9]')) as d from part"),
    "format_base64": ("part", ".[] | {p_partkey, b: (.p_name | @base64), h: (.p_name | @hex)}", "select p_partkey, to_base64(encode(p_name)) as b, lower(hex(encode(p_name))) as h from part"),
    "format_uri_html": ("documents", ".[] | {doc_id, h: (.source | @html), u: (.lang | @uri), q: (.lang | @sh)}", "select doc_id, replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as h, url_encode(lang) as u, '''' || lang || '''' as q from documents"),
    "digests": ("documents", ".[] | {doc_id, m: (.text | md5), s: (.text | sha256), b: (.text | utf8bytelength)}", "select doc_id, md5(text) as m, sha256(text) as s, octet_length(encode(text)) as b from documents"),
    "math_functions": ("lineitem", ".[] | {l_orderkey, l_linenumber, a: (.l_quantity | sqrt), b: (.l_extendedprice | log), c: (.l_discount | floor), d: (.l_tax | exp), e: (.l_quantity | cbrt)}", "select l_orderkey, l_linenumber, round(sqrt(l_quantity), 4) as a, round(ln(l_extendedprice), 4) as b, floor(l_discount)::bigint as c, round(exp(l_tax), 4) as d, round(cbrt(l_quantity), 4) as e from lineitem"),
    "json_props": ("events", ".[] | {event_id, k: (.props | fromjson_path(\"$.k\") | tonumber)}", "select event_id, json_extract_string(props, '$.k')::double as k from events"),
    "date_parts": ("orders", ".[] | {o_orderkey, e: (.o_orderdate | mktime)}", "select o_orderkey, epoch(o_orderdate)::bigint as e from orders"),
    "date_text": ("orders", ".[] | {o_orderkey, d: (.o_orderdate | mktime | strftime(\"%Y-%m-%d\")), i: (.o_orderdate | mktime | todate)}", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as i from orders"),
    "foreach_array": ("embeddings", ".[] | {vec_id, last: ([foreach .embedding[] as $x (0.0; . + $x)] | last)}", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as last from embeddings"),
}

#: Row-wise programs for the dynamic tier: name -> (table, kept columns, program, SQL).
DYNAMIC: dict[str, tuple[str, tuple[str, ...], str, str]] = {
    "dynamic_entries": ("nation", ("n_nationkey",), "to_entries | map(.key) | join(\",\")", "select n_nationkey, 0 as pos, '\"n_nationkey,n_name,n_regionkey\"' as output from nation"),
    "dynamic_recursion": ("nation", ("n_nationkey",), "def f: if . <= 0 then 0 else . + (. - 1 | f) end; .n_regionkey | f", "select n_nationkey, 0 as pos, ((n_regionkey * (n_regionkey + 1)) // 2)::varchar as output from nation"),
    "dynamic_fromjson": ("events", ("event_id",), ".props | fromjson | .k", "select event_id, 0 as pos, json_extract_string(props, '$.k') as output from events"),
    "dynamic_paths": ("region", ("r_regionkey",), "paths | .[0]", "select r_regionkey, pos, case pos when 0 then '\"r_regionkey\"' else '\"r_name\"' end as output from region, (select unnest([0, 1]) as pos)"),
    "dynamic_walk": ("region", ("r_regionkey",), "walk(if type == \"string\" then ascii_downcase else . end) | .r_name", "select r_regionkey, 0 as pos, '\"' || lower(r_name) || '\"' as output from region"),
    "dynamic_destructure": ("nation", ("n_nationkey",), ". as {n_name: $n, n_regionkey: $r} | \"\\($r):\\($n)\"", "select n_nationkey, 0 as pos, '\"' || n_regionkey || ':' || n_name || '\"' as output from nation"),
    "dynamic_csv": ("nation", ("n_nationkey",), "[.n_nationkey, .n_name] | @csv", "select n_nationkey, 0 as pos, '\"' || n_nationkey || ',\\\"' || n_name || '\\\"\"' as output from nation"),
    "dynamic_try": ("nation", ("n_nationkey",), "try (if .n_regionkey == 0 then error(\"zero\") else .n_regionkey end) catch .", "select n_nationkey, 0 as pos, case when n_regionkey = 0 then '\"zero\"' else n_regionkey::varchar end as output from nation"),
    "dynamic_stream": ("region", ("r_regionkey",), "fromstream(tostream) | .r_regionkey", "select r_regionkey, 0 as pos, r_regionkey::varchar as output from region"),
    "dynamic_label": ("nation", ("n_nationkey",), "label $out | range(10) | if . > 2 then break $out else . end", "select n_nationkey, pos, pos::varchar as output from nation, (select unnest([0, 1, 2]) as pos)"),
    "dynamic_events": ("region", ("r_regionkey",), "tostream", "select r_regionkey, pos, case pos when 0 then '[[\"r_regionkey\"],' || r_regionkey || ']' when 1 then '[[\"r_name\"],\"' || r_name || '\"]' else '[[\"r_name\"]]' end as output from region, (select unnest([0, 1, 2]) as pos)"),
    "dynamic_module": ("nation", ("n_nationkey",), "import \"names\" as n; n::tag(.n_name)", "select n_nationkey, 0 as pos, '\"<' || lower(n_name) || '>\"' as output from nation"),
}
#: What programs may import.
MODULES = {"names": 'def tag(f): "<\\(f | ascii_downcase)>";'}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`").cast("double"), 4).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def _static(table: str, program: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        others = {name: read(name) for name in ("customer", "orders", "nation") if f"${name}" in program}
        return _rounded(lower(read(table), program, others))

    return query


def _dynamic(table: str, keep: tuple[str, ...], program: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply_rows(spark.read.parquet(f"{sf_dir}/{table}.parquet"), program, keep, modules=MODULES).drop("error")

    return query


def _family(table: str, program: str, schema: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        others = {name: read(name) for name in ("customer", "orders", "nation") if f"${name}" in program}
        return _rounded(lower(read(table), program, others, schema=schema or None, modules=MODULES))

    return query


def queries():
    return {n: _static(t, p) for n, (t, p, _) in PROGRAMS.items()} | {n: _family(t, p, s) for n, (t, p, s, _) in FAMILIES.items()} | {n: _dynamic(t, k, p) for n, (t, k, p, _) in DYNAMIC.items()} | catalogue_io.queries()


def oracle_sql():
    return {n: s for n, (_, _, s) in PROGRAMS.items()} | {n: s for n, (_, _, _, s) in FAMILIES.items()} | {n: s for n, (_, _, _, s) in DYNAMIC.items()} | catalogue_io.oracle_sql()
