"""The engine's registered queries, bound to the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.operators import baked, catalog, checks, ids, layouts, positions, profile, pyramid, roles, search, ticks, view
from gridloom.session import ship
from gridloom.sources.tables import fixture_of, read_csv, read_tile, scalar_columns, shared_dir, table, write_tags, write_tiles
from gridloom.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda n: table(spark, sf_dir, n))

        QUERIES[name or f.__name__] = run
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    """Doubles to so many places, on both sides of the comparison; -0 as 0."""
    return df.withColumns({n: F.round(F.col(n), places) + F.lit(0.0) for n in names})


def r6(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df, 6, *names)


# ids, joins, integrity

@query("select row_number() over (order by c_name, c_custkey) - 1 as id, c_name as filename from customer")
def dense_ids(t):
    return ids.dense_ids(t("customer"), "c_name", "c_custkey").select("id", F.col("c_name").alias("filename"))


@query("select row_number() over (order by c_custkey) - 1 as id, c_custkey as old_id, c_name as filename from customer where c_custkey % 7 <> 0")
def survivors_redensify(t):
    base = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"))
    kept = base.filter(F.col("id") % 7 != 0)
    return ids.survivors(base, kept, "filename").select("id", "old_id", "filename")


@query("""select c_custkey as id, o.o_orderkey as first_order, o.o_orderpriority as priority, o.o_orderkey is not null as matched from customer
left join (select * from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1) o on o_custkey = c_custkey""")
def metadata_left_join_first_wins(t):
    md = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first_order"), F.col("o_orderpriority").alias("priority"))
    return ids.join_first(t("customer").select(F.col("c_custkey").alias("id")), md, "id", "first_order")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def unmatched_anti_join(t):
    rich = t("orders").filter("o_totalprice > 400000")
    return t("customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""with a as (select distinct c_custkey k from customer where c_custkey % 3 <> 0), b as (select distinct o_custkey k from orders),
d as (select 'left' side, k from a where k not in (select k from b) union all select 'right', k from b where k not in (select k from a)),
r as (select *, row_number() over (partition by side order by k) rn from d)
select side, count(*) as n, (select string_agg(k::varchar, ',' order by k::varchar) from r r2 where r2.side = d.side and rn <= 5) as examples from d group by side""")
def id_integrity_guard(t):
    return ids.integrity(t("customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")), "k")


# validation, casts, profiles

@query("select count(value) as n_values, count(*) filter (isfinite(value)) as n_finite, count(*) filter (value > 0) as n_positive, count(props) as n_props, count(try_cast(json_extract_string(props, '$.k') as double)) as n_parsed from events")
def validate_counts(t):
    k = C.to_number(F.get_json_object("props", "$.k"))
    return t("events").agg(F.count("value").alias("n_values"), F.count_if(C.finite(F.col("value"))).alias("n_finite"), F.count_if(F.col("value") > 0).alias("n_positive"), F.count("props").alias("n_props"), F.count(k).alias("n_parsed"))


@query("select min(l_quantity) as x_min, max(l_quantity) as x_max, min(l_extendedprice) as y_min, max(l_extendedprice) as y_max from lineitem where isfinite(l_quantity) and isfinite(l_extendedprice)")
def coordinate_extents(t):
    both = C.finite(F.col("l_quantity")) & C.finite(F.col("l_extendedprice"))
    return t("lineitem").filter(both).agg(F.min("l_quantity").alias("x_min"), F.max("l_quantity").alias("x_max"), F.min("l_extendedprice").alias("y_min"), F.max("l_extendedprice").alias("y_max"))


@query("select round(avg(length(p_name)), 6) as p_name, round(avg(length(p_brand)), 6) as p_brand, round(avg(length(p_type)), 6) as p_type from part")
def text_lengths(t):
    return r6(search.mean_lengths(t("part"), ["p_name", "p_brand", "p_type"]), "p_name", "p_brand", "p_type")


@query("select column_name from (describe select * from embeddings) where column_type not like '%[]'")
def scalar_columns_profile(t):
    e = t("embeddings")
    return e.sparkSession.createDataFrame([(c,) for c in scalar_columns(e)], "column_name string")


@query("""with k as (select column_name as name, case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' else 'string' end as type from (describe select c_custkey, c_name, c_nationkey, c_mktsegment from customer)), f as (select c_custkey::varchar c_custkey, c_name, c_nationkey::varchar c_nationkey, c_mktsegment from customer order by customer.c_custkey limit 1),
s as (select 'c_custkey' as name, c_custkey as sample from f union all select 'c_name', c_name from f union all select 'c_nationkey', c_nationkey from f union all select 'c_mktsegment', c_mktsegment from f) select name, type, sample from k join s using (name)""")
def column_profile(t):
    return profile.column_profile(t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey").select("name", "type", "sample")


@query("select p_partkey, p_name, (select count(*) from part) as total from part order by p_name, p_partkey limit 20 offset 40")
def name_page(t):
    named = t("part").withColumn("_o", F.concat("p_name", F.lpad(F.col("p_partkey").cast("string"), 12, "0")))
    return profile.page(named, "_o", 40, 20).select("p_partkey", "p_name", "total")


@query("""select 'value' as "column", count(value) as n_values, count(*) filter (isfinite(value)) as n_parsed, count(value) = count(*) filter (isfinite(value)) as whole from events
union all select 'event_type', count(nullif(trim(event_type), '')), count(try_cast(event_type as bigint)), count(nullif(trim(event_type), '')) = count(try_cast(event_type as bigint)) from events
union all select 'ts', count(ts), count(ts), true from events""")
def strict_parse(t):
    return checks.parse_counts(t("events"), {"value": "number", "event_type": "unix_seconds", "ts": "iso8601"})


@query("""with e as (select embedding[1]::double x, embedding[2]::double y from embeddings), l as (select min(x) ax, max(x) bx, min(y) ay, max(y) b2 from e)
select 'x' as "column", 'log' as rule, round(ax, 6) as value from l where ax <= 0 union all select 'x', 'unit', round(case when ax < 0 then ax else bx end, 6) from l where ax < 0 or bx > 1
union all select 'y', 'unit', round(case when ay < 0 then ay else b2 end, 6) from l where ay < 0 or b2 > 1""")
def coordinate_findings(t):
    e = t("embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return r6(checks.coordinate_findings(e, [checks.Pair("x", "y", x_scale="log", normalize="none")]), "value")


@query("""with c as (select (c_custkey % 400 - 200)::double lon, case when c_custkey % 7 <> 0 then (c_custkey % 178 - 89)::double end lat from customer), e as (select min(lon) a, max(lon) b, min(lat) c, max(lat) d from c where lat is not null)
select 'lon' as "column", 'longitude' as rule, case when a < -180 then a else b end as value from e where a < -180 or b > 180 union all select 'lat', 'mercator', case when c < -85.051129 then c else d end from e where c < -85.051129 or d > 85.051129""")
def degree_findings(t):
    k = F.col("c_custkey")
    c = t("customer").select((k % 400 - 200).cast("double").alias("lon"), F.when(k % 7 != 0, (k % 178 - 89).cast("double")).alias("lat"))
    return checks.degree_findings(c, [checks.Pair("lon", "lat", projection="mercator")])


@query("""with d as (select column_name c, column_type t from (describe select * from events)), r(role, c, form) as (values ('datetime', 'ts', 'iso8601'), ('datetime', 'ts', 'unix_millis'), ('scatter', 'value', null), ('scatter', 'user_id', null), ('tag', 'event_type', null), ('categorical', 'colour', null))
select role, r.c as "column", case when t is null then 'missing' when role = 'datetime' and t like 'TIMESTAMP%' then 'iso8601' when role = 'datetime' then 'timestamp' when role = 'scatter' then 'float' else 'list' end as finding from r left join d on d.c = r.c
where t is null or (role = 'datetime' and (t not like 'TIMESTAMP%' or form <> 'iso8601')) or (role = 'scatter' and t not in ('DOUBLE', 'FLOAT')) or (role = 'tag' and t not like '%[]')""")
def role_findings(t):
    return checks.role_findings(t("events"), [("datetime", "ts"), ("datetime", "ts", "unix_millis"), ("scatter", "value"), ("scatter", "user_id"), ("tag", "event_type"), ("categorical", "colour")])


@query("select event_id::varchar as _key, ts as ts, event_type, [event_type] as tags, value from events")
def role_projection(t):
    e = t("events").select(F.col("event_id").cast("string").alias("k"), F.col("ts").cast("string").alias("ts"), "event_type", F.col("event_type").alias("tags"), F.col("value").cast("string").alias("value"))
    known = [roles.Role("datetime", ("ts",)), roles.Role("categorical", ("event_type",)), roles.Role("tag", ("tags",)), roles.Role("scatter", ("value", "value"))]
    return roles.project(e, "k", known).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""select layout_id, count(*) as n, count(distinct id) as ids from (select c_custkey as id, unnest(['grid', 'categorical_c-mktsegment', 'categorical_c_nationkey', 'scatter']) as layout_id from customer) group by 1""".replace("c-mkt", "c_mkt"))
def expanded_layouts(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey", "c_acctbal", F.col("c_custkey").cast("double").alias("k"))
    known = [roles.Role("categorical", ("c_mktsegment",)), roles.Role("categorical", ("c_nationkey",)), roles.Role("scatter", ("k", "c_acctbal"))]
    return roles.expanded(c, known).groupBy("layout_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("""with e as (select p_partkey entry, case when p_partkey % 3 = 0 then 'scatter' else 'tag' end kind, p_brand a, p_type b, p_size::varchar o from part)
select entry, a as "column", '["scatter","first","' || b || '","' || o || '"]' as print from e where kind = 'scatter' union all select entry, b, '["scatter","second","' || a || '","' || o || '"]' from e where kind = 'scatter'
union all select entry, a, '["tag","' || o || '"]' from e where kind = 'tag'""")
def role_prints(t):
    pair = F.col("p_partkey") % 3 == 0
    e = t("part").select(F.col("p_partkey").alias("entry"), F.when(pair, "scatter").otherwise("tag").alias("kind"), F.when(pair, F.array("p_brand", "p_type")).otherwise(F.array("p_brand")).alias("columns"), F.array(F.col("p_size").cast("string")).alias("options"))
    return roles.prints(e)


_DECLARED = """'{"roles": [{"kind": "tag", "column": "a\\\\"' || source || '", "label": "column"}, [{"x_column": "x_' || lang || '", "y_column": ["column", {"column": "deep"}], "note": "\\\\"column\\\\": \\\\"no\\\\""}]], "column": {"lon_column": "in_' || source || '"}, "columns": "never", "column_n": 3, "z_column": 4}'"""


@query(f"""with d as (select doc_id, {_DECLARED.replace(chr(92) * 2, chr(92))} as j from documents), n as (select doc_id, json_extract_string(t.value, '$') as c from d, json_tree(d.j) t where t.type = 'VARCHAR' and (t.key = 'column' or ends_with(t.key, '_column')))
select d.doc_id, coalesce(string_agg(distinct c, ',' order by c), '') as columns from d left join n using (doc_id) group by 1""")
def declared_columns(t):
    docs = t("documents").select("doc_id", F.expr(_DECLARED).alias("j"))
    return roles.declared_columns(docs, "doc_id", "j").withColumn("columns", F.array_join("columns", ","))


_ENTRIES = """{side} as (select p_size as dataset, p_partkey as entry, p_partkey % 4 as k, p_brand a, p_type b, case when {log} then 'log' else '' end as o from part where {rule}),
{side}_r as (select dataset, entry, 'scatter' as kind, unnest([a, b]) as col, 'scatter|' || unnest(['first', 'second']) || '|' || unnest([b, a]) || '|' || o as print from {side} where k = 0 union all select dataset, entry, 'geographic', unnest([b, a]), 'geographic|' || unnest(['first', 'second']) || '|' || unnest([a, b]) || '|' || o from {side} where k = 3
union all select dataset, entry, 'categorical', a, 'categorical|' || o from {side} where k = 1 union all select dataset, entry, 'freeform', b, 'freeform|' || o from {side} where k = 2)"""


@query(f"""with {_ENTRIES.format(side="was", log="false", rule="p_partkey % 7 <> 0")}, {_ENTRIES.format(side="now", log="p_partkey % 9 = 0", rule="p_partkey % 7 <> 1 and p_size % 5 <> 2 or p_partkey % 7 <> 0 and p_size % 5 = 2").replace("p_partkey % 9 = 0 then", "p_partkey % 9 = 0 and p_size % 5 <> 2 then")},
pw as (select distinct dataset, kind, reading from (select dataset, kind, entry, list_sort(list(distinct col || '>' || print)) as reading from was_r where kind in ('scatter', 'geographic') group by all)), pn as (select distinct dataset, kind, reading from (select dataset, kind, entry, list_sort(list(distinct col || '>' || print)) as reading from now_r where kind in ('scatter', 'geographic') group by all)),
lft as (select * from pw except select * from pn), arr as (select * from pn except select * from pw),
fam as (select dataset, kind, greatest(count(*) filter (s = 0), count(*) filter (s = 1)) as n from (select *, 0 as s from lft union all select *, 1 from arr) group by 1, 2),
ax as (select distinct dataset, split_part(unnest(reading), '>', 1) as col from (select * from lft union all select * from arr)),
now_ax as (select distinct dataset, col from now_r where kind in ('scatter', 'geographic')),
gone as (select dataset, kind, col, print from was_r except select dataset, kind, col, print from now_r), come as (select dataset, kind, col, print from now_r except select dataset, kind, col, print from was_r),
ch as (select distinct dataset, col from (select dataset, col from gone union all select dataset, col from come)),
own as (select distinct dataset, col from (select dataset, col from come where kind not in ('scatter', 'geographic') union all select dataset, col from gone where kind not in ('scatter', 'geographic') and not (kind = 'freeform' and (dataset, col) in (select dataset, col from now_ax)))),
m as (select dataset, count(*) filter ((dataset, col) not in (select dataset, col from ax) or (dataset, col) in (select dataset, col from own)) as m from ch group by 1)
select m.dataset, (m.m + coalesce((select sum(n) from fam where fam.dataset = m.dataset), 0))::bigint as n from m""")
def role_changes(t):
    k, size = F.col("p_partkey"), F.col("p_size")

    def side(rule, log):
        kind = F.element_at(F.array(*map(F.lit, ("scatter", "categorical", "freeform", "geographic"))), (k % 4 + 1).cast("int"))
        columns = F.when(k % 4 == 0, F.array("p_brand", "p_type")).when(k % 4 == 3, F.array("p_type", "p_brand")).when(k % 4 == 1, F.array("p_brand")).otherwise(F.array("p_type"))
        e = t("part").filter(rule).select(size.alias("dataset"), k.alias("entry"), kind.alias("kind"), columns.alias("columns"), F.array(F.when(log, "log").otherwise("")).alias("options"))
        return roles.prints(e).join(e.select("dataset", "entry", "kind"), "entry").select("dataset", "entry", "kind", "column", "print")

    quiet = size % 5 == 2
    return roles.role_changes(side(k % 7 != 0, F.lit(False)), side(((k % 7 != 1) & ~quiet) | ((k % 7 != 0) & quiet), (k % 9 == 0) & ~quiet))


@query("""with c as (select o_custkey dataset, o_orderkey seq, o_orderkey layout_id, o_orderpriority pair, o_orderstatus knobs from orders where o_orderkey % 3 <> 1), o as (select o_custkey dataset, o_orderkey seq, o_orderpriority pair, o_orderstatus knobs from orders where o_orderkey % 3 = 1),
h as (select *, layout_id % 2 = 0 as told from c where layout_id % 4 <> 0), l as (select dataset, pair, arg_max(knobs, seq) k, max(layout_id) filter (not told) as layout_id from h group by 1, 2),
f as (select o.dataset, o.pair, l.layout_id, o.seq from o join l on l.dataset = o.dataset and l.pair = o.pair where l.layout_id is not null and o.knobs is distinct from l.k qualify row_number() over (partition by o.dataset order by o.seq) = 1)
select dataset, pair, layout_id, (select count(*) from c where c.dataset = f.dataset and c.pair = f.pair) = 1 and (select count(*) from o where o.dataset = f.dataset and o.pair = f.pair) = 1 as exact from f""")
def stale_knobs(t):
    k = F.col("o_orderkey")
    o = t("orders").select(F.col("o_custkey").alias("dataset"), k.alias("seq"), k.alias("layout_id"), F.col("o_orderpriority").alias("pair"), F.col("o_orderstatus").alias("knobs"))
    seq = F.col("seq")
    committed = o.filter(seq % 3 != 1)
    return roles.stale_knobs(committed, o.filter(seq % 3 == 1).drop("layout_id"), committed.filter(seq % 4 != 0), committed.filter(seq % 2 == 0))


@query("""with c as (select c_nationkey l, c_custkey id, (c_custkey * 37 % 1000) / 1000.0::double as x, (c_custkey * 91 % 1000) / 1000.0::double as y from customer), b as (select l, count(*) n, round(min(x), 6) x0, round(min(y), 6) y0, round(max(x), 6) x1, round(max(y), 6) y1 from c group by 1),
k as (select l, min(id) filter (x > xl and x < xh) as inner_id, min(id) as first_id from (select *, min(x) over (partition by l) xl, max(x) over (partition by l) xh from c) group by 1)
select b.l as layout_id, case when l % 7 = 5 then 'newer' when l % 7 = 6 then 'current' when l = 13 then 'lost' when l % 5 = 1 then 'moved' when l % 5 = 4 then 'unchecked' when l % 5 = 3 then 'shrunk' when l % 5 = 2 and inner_id is not null then 'diverged' else 'same' end as verdict from b join k using (l)""")
def refresh_verdicts(t):
    n, i = F.col("layout_id"), F.col("id")
    c = t("customer").select(F.col("c_nationkey").alias("layout_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1000 / F.lit(1000.0)).alias("x"), (F.col("c_custkey") * 91 % 1000 / F.lit(1000.0)).alias("y"), F.lit(0.001).alias("w"), F.lit(0.001).alias("h"))
    ends = [f(a).alias(f"{a}{k}") for k, f in ((0, F.min), (1, F.max)) for a in "xy"]
    boxes = c.groupBy("layout_id").agg(F.count(F.lit(1)).alias("n"), *ends)
    version = F.when(n % 7 == 5, "2.11").when(n % 7 == 6, "2.10").otherwise("2.9")
    committed = boxes.withColumn("version", version).withColumn("x1", F.when(n % 5 == 1, F.col("x1") + 2e-6).otherwise(F.col("x1")))
    inner = c.join(boxes, "layout_id").filter("x > x0 and x < x1").groupBy("layout_id").agg(F.min("id").alias("inner_id"))
    first = c.groupBy("layout_id").agg(F.min("id").alias("first_id"))
    marked = c.join(inner, "layout_id", "left").join(first, "layout_id").filter((n % 5 != 4) & ~((n % 5 == 3) & (i == F.col("first_id"))))
    baked_ = marked.withColumn("x", F.when((n % 5 == 2) & (i == F.col("inner_id")), F.col("x") + 5e-5).otherwise(F.col("x")))
    floats = baked_.select("layout_id", "id", *[F.col(a).cast("float").alias(a) for a in "xywh"])
    return positions.refresh_verdicts(committed, boxes.drop("n").filter("layout_id != 13"), floats, c, "2.10")


_SIZE = "(p_partkey * p_partkey * p_partkey * p_size)::bigint"


@query(f"""with b as (select p_partkey as id, {_SIZE} as v, p_partkey * p_size / 7.0::double as s from part), u as (select *, case when v < 1024 then 0 when v < 1048576 then 1 when v < 1073741824 then 2 when v < 1099511627776 then 3 else 4 end as k from b), w as (select *, v / pow(1024, k) as n, floor(s + 0.5)::bigint as r from u), m as (select *, floor(r / 60.0::double + 0.5)::bigint as m from w)
select id, case when k = 0 then v::varchar || ' B' else case when n >= 100 then floor(n + 0.5)::bigint::varchar else (floor(n * 10 + 0.5) / 10)::decimal(10, 1)::varchar end || ' ' || ['KiB', 'MiB', 'GiB', 'TiB'][k] end as size, case when r < 60 then r::varchar || ' s' when m < 60 then m::varchar || ' min' else (m // 60)::varchar || ' h' || case when m % 60 > 0 then ' ' || (m % 60)::varchar || ' min' else '' end end as took from m""")
def readable_figures(t):
    k, s = F.col("p_partkey").cast("long"), F.col("p_size")
    wide = k.cast("decimal(38,0)")  # a key's cube leaves 64 bits at 570,000
    return t("part").select(F.col("p_partkey").alias("id"), C.bytes_text(wide * k * k * s).alias("size"), C.duration_text(k * s / F.lit(7.0)).alias("took"))


@query("""select s_nationkey as dataset, coalesce(array_to_string(list_sort(list_filter(list(distinct s_name) filter (s_suppkey % 3 <> 0), lambda x: not list_contains(coalesce(list(distinct s_name) filter (s_suppkey % 2 = 0), []), x))), ','), '') as missing, bool_or(s_suppkey % 5 = 0) and count(*) filter (s_suppkey % 3 <> 0) = 0 as orphan from supplier group by 1""")
def tag_sidecars(t):
    k = F.col("s_suppkey")
    d = t("supplier").groupBy(F.col("s_nationkey").alias("dataset")).agg(F.collect_set(F.when(k % 3 != 0, F.col("s_name"))).alias("declared"), F.collect_set(F.when(k % 2 == 0, F.col("s_name"))).alias("served"), F.bool_or(k % 5 == 0).alias("sidecar"))
    return catalog.tag_sidecars(d).withColumn("missing", F.array_join("missing", ","))


@query("select o_orderkey as id, o_custkey::varchar as owner, o_orderpriority as upload from orders where o_custkey = 7 and o_orderpriority = (select min(o_orderpriority) from orders where o_custkey = 7) order by o_orderdate, o_orderkey limit 1")
def minted_record(t):
    r = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderpriority").alias("upload"), F.col("o_orderdate").alias("created"))
    upload = r.filter("owner = '7'").agg(F.min("upload")).first()[0]
    return catalog.minted(r, "7", upload).select("id", "owner", "upload")


@query("select c_custkey as id, c_name, round(c_acctbal, 2) as bal from customer where c_custkey in (3, 5, 8, 13, 21, 34)")
def metadata_lookup_by_ids(t):
    return ids.by_ids(t("customer"), "c_custkey", "21,3, 5,3,8,13,34").orderBy("c_custkey").select(F.col("c_custkey").alias("id"), "c_name", F.round("c_acctbal", 2).alias("bal"))


@query("select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else '.' || lpad((epoch_us(ts) % 1000000)::varchar, 6, '0') end as iso from events")
def iso_times(t):
    return t("events").select(F.col("event_id").alias("id"), C.iso(F.col("ts")).alias("iso"))


@query("select p_partkey as id, case when p_partkey % 3 = 0 then p_size * 1000 when p_partkey % 3 = 1 then epoch_ms(timestamp '2001-02-03 04:05:06' + to_days(p_size::int)) end as ms from part")
def instants(t):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), "p_size")).when(k % 3 == 1, F.expr("cast(timestamp_ntz'2001-02-03 04:05:06' + make_dt_interval(p_size) as string)")).otherwise("1e30")
    return t("part").select(k.alias("id"), C.instant(raw, "unix_seconds").alias("ms"))


@query("select doc_id as id, case when length(text) > 160 then substr(text, 1, 159) || '…' else text end as sample from documents")
def samples(t):
    return t("documents").select(F.col("doc_id").alias("id"), C.ellipsis(F.col("text")).alias("sample"))


@query("select doc_id as id, sha256(text) as sha from documents")
def text_hashes(t):
    return t("documents").select(F.col("doc_id").alias("id"), C.sha256(F.col("text")).alias("sha"))


# sources and sinks: a table written and read again

@query("select c_custkey::varchar as c_custkey, 'a, \"b\"' || chr(10) || c_name as name, case when c_custkey % 3 <> 0 then c_mktsegment end as segment from customer")
def csv_scan(t):
    path = shared_dir(t("customer").sparkSession)
    name = F.concat(F.lit('a, "b"\n'), "c_name").alias("name")
    t("customer").select("c_custkey", name, F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")).write.csv(path, header=True, escape='"', quoteAll=False)
    return read_csv(t("customer").sparkSession, path)


@query("select p_partkey as id, case when p_partkey % 7 <> 0 then array_to_string(string_split(p_name, ' '), '|') end as tags from part")
def tag_table(t):
    path = shared_dir(t("part").sparkSession)
    write_tags(_tagged(t).withColumn("other", F.lit(1)), ["tags"], path)
    return t("part").sparkSession.read.parquet(path).select("id", F.array_join("tags", "|").alias("tags"))


# tags

def _tagged(t):
    tags = C.split_tags(F.col("p_name"), " ")
    return t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 != 0, tags).alias("tags"))


@query("select p_partkey as id, case when p_partkey % 7 <> 0 then array_to_string(string_split(p_name, ' '), '|') end as tags from part")
def tag_split(t):
    return _tagged(t).select("id", F.array_join("tags", "|").alias("tags"))


@query("select p_partkey as id, case when p_brand in ('Brand#11', 'Brand#22') then '' else p_brand end as tags, case when p_brand in ('Brand#11', 'Brand#22') then 0 else 1 end as n from part")
def tag_single(t):
    one = C.split_tags(F.when(~F.col("p_brand").isin("Brand#11", "Brand#22"), F.col("p_brand")), None)
    return t("part").select(F.col("p_partkey").alias("id"), F.array_join(one, "|").alias("tags"), F.size(one).alias("n"))


@query("select value, count(*) as n from (select unnest(string_split(p_name, ' ')) as value from part where p_partkey % 7 <> 0) group by value order by n desc, value limit 50")
def tag_top(t):
    return search.top_facets(search.facets(_tagged(t), "tags"))


@query("select value, count(*) as n from (select unnest(string_split(p_name, ' ')) as value from part where p_partkey % 7 <> 0) group by value")
def tag_facets(t):
    return search.facets(_tagged(t), "tags")


@query("select value, count(distinct p_partkey) as n from (select p_partkey, unnest(string_split(p_name, ' ')) as value from part where p_partkey % 7 <> 0) group by value")
def tag_members(t):
    return search.members(_tagged(t), "tags")


@query("select p_partkey as id from part where p_partkey % 7 <> 0 and (list_contains(string_split(p_name, ' '), 'cold') or list_contains(string_split(p_name, ' '), 'widget'))")
def tag_filter_or(t):
    return search.tagged(_tagged(t), "tags", ["cold", "widget"]).select("id")


@query("select p_partkey as id from part where p_partkey % 7 <> 0 and list_contains(string_split(p_name, ' '), 'cold') and list_contains(string_split(p_name, ' '), 'widget')")
def tag_filter_and(t):
    return search.tagged(_tagged(t), "tags", ["cold", "widget"], "and").select("id")


# search

PART_ROLES = [("p_name", "title"), ("p_brand", "categorical"), ("p_type", "freeform")]


def _search_sql(q: str, limit: int, columns: list[tuple[str, int]] = [("p_brand", 0), ("p_name", 1), ("p_type", 3)]) -> str:  # noqa: B006
    """columns: (column, priority) in order."""
    any_ = lambda f, on: " or ".join(f"{f}(lower({c}::varchar), '{q}')" for c, _ in on)
    pick = lambda of: "case " + " ".join(f"when contains(lower({c}::varchar), '{q}') then {of(c, p)}" for c, p in columns) + " end"
    return f"""with m as (select *, p_partkey id, row_number() over (order by case when {any_("starts_with", columns)} then 0 else 1 end, p_partkey) rn, count(*) over () all_ from part where {any_("contains", columns)}),
h as (select id, all_ > {limit} capped, {pick(lambda c, p: f"'{c}'")} as field, {pick(lambda c, p: f"{c}::varchar")} as value, {pick(lambda c, p: p)} as p from m where rn <= {limit})
select id, field, value, (row_number() over (order by case when starts_with(lower(value), '{q}') then 0 else 1 end, p, id) - 1)::int as position, capped from h"""


@query(_search_sql("co", 50))
def search_ranked(t):
    return search.search(t("part").withColumn("id", F.col("p_partkey")), PART_ROLES, " CO ", 50)


@query(_search_sql("brand#1", 20))
def search_prefix_topk(t):
    return search.search(t("part").withColumn("id", F.col("p_partkey")), PART_ROLES, "brand#1", 20)


@query(f"select field, value, count(*) as n, min(position) as first from ({_search_sql('brand#1', 50)}) group by field, value, case when field = 'p_brand' then -1 else id end")
def search_group_rows(t):
    hits = search.search(t("part").withColumn("id", F.col("p_partkey")), PART_ROLES, "brand#1", 50)
    return search.grouped_hits(hits, ["p_brand"])


#: p_brand is a category, p_comment-like text goes by its name, p_type by its length.
ROLE_MAP = {"p_brand": ("categorical", "Brand"), "p_name": ("freeform", "Item"), "p_type": ("freeform", "Finish notes")}


def _searchable(t):
    return t("part").select(F.col("p_partkey").alias("id"), "p_partkey", "p_name", "p_brand", "p_type", "p_size", F.concat(F.lit("https://x/"), "p_partkey").alias("p_link"))


@query("""select c as "column", r as role from (values ('p_brand', 'categorical'), ('p_name', 'title'), ('p_partkey', 'title'), ('p_size', 'title'), ('id', 'id')) v(c, r)
union all select 'p_type', 'freeform'""")
def title_like_columns(t):
    found = search.search_columns(_searchable(t), ROLE_MAP, ("p_link",), "all")
    return t("part").sparkSession.createDataFrame(found, "column string, role string")


@query("select id, field, value, position, capped from (" + _search_sql("11", 50, [("p_brand", 0), ("p_name", 1), ("p_partkey", 1), ("p_size", 1)]) + ")")
def search_default(t):
    p = _searchable(t)
    return search.search(p, search.search_columns(p, ROLE_MAP, ("p_link",)), "11", 50)


@query("select id, field, value, position, capped from (" + _search_sql("econ", 50, [("p_brand", 0), ("p_name", 1), ("p_partkey", 1), ("p_size", 1), ("p_type", 3)]) + ")")
def search_all(t):
    p = _searchable(t)
    return search.search(p, search.search_columns(p, ROLE_MAP, ("p_link",), "all"), "econ", 50)


# layouts

GRID_SQL = "select c_custkey as id, round((c_custkey % cols + 0.5) / cols, 6) as x, round(((c_custkey // cols) + 0.5) / rws, 6) as y, round(0.9 / cols, 6) as w, round(0.9 / rws, 6) as h from customer, (select ceil(sqrt(count(*)))::bigint as cols, ceil(count(*) / ceil(sqrt(count(*))))::bigint as rws from customer)"


@query(GRID_SQL)
def grid_layout(t):
    return r6(layouts.grid(t("customer").select(F.col("c_custkey").alias("id"))), "x", "y", "w", "h")


SCATTER_SQL = """with raw as (select vec_id as id, embedding[1]::double as px, embedding[2]::double as py from embeddings),
s as (select median(px) mx, median(py) my, min(px) ax, max(px) bx, min(py) ay, max(py) b2, count(*) n from raw),
f as (select *, least(0.5 / greatest(bx - mx, mx - ax), 0.475 / greatest(b2 - my, my - ay)) sc, 0.9 / greatest(1, ceil(sqrt(n))) side from s),
cells as (select id, 0.5 + (px - mx) * sc as x, 0.95 - (0.475 + (py - my) * sc) as y, side as w, side as h from raw, f)"""


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("px"), F.col("embedding")[1].cast("double").alias("py"))


def _scattered(t):
    return layouts.scatter(_vectors(t)).drop("placed")


@query(SCATTER_SQL + " select id, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(w, 6) as w, round(h, 6) as h from cells")
def scatter_fit(t):
    return r6(_scattered(t), "x", "y", "w", "h")


@query("""with raw as (select l_orderkey * 8 + l_linenumber as id, ln(l_quantity) px, ln(l_extendedprice) py from lineitem),
s as (select median(px) mx, median(py) my, min(px) ax, max(px) bx, min(py) ay, max(py) b2, count(*) n from raw),
f as (select *, least(0.5 / greatest(bx - mx, mx - ax), 0.475 / greatest(b2 - my, my - ay)) sc, 0.9 / greatest(1, ceil(sqrt(n))) side from s)
select id, round(0.5 + (px - mx) * sc, 6) + 0.0 as x, round(0.95 - (0.475 + (py - my) * sc), 6) + 0.0 as y, round(side, 6) as w, round(side, 6) as h from raw, f""")
def scatter_log(t):
    items = t("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("px"), F.col("l_extendedprice").alias("py"))
    return r6(layouts.scatter(items, log=True).drop("placed"), "x", "y", "w", "h")


def _passthrough_sql(scale: str) -> str:
    """Values as they are; every 23rd vector has none and stands in a block below the others, or in the strip where that has no room."""
    return f"""with raw as (select vec_id as id, case when vec_id % 23 <> 5 then abs(embedding[1]::double) * {scale} end px, abs(embedding[2]::double) * {scale} py from embeddings),
s as (select min(px) ax, max(py) by_, greatest(max(px) - min(px), max(py) - min(py)) * (0.9::double / greatest(1, ceil(sqrt(count(*))))) side, (select count(*) from raw where px is null) m from raw where px is not null),
g as (select *, greatest(1, ceil(sqrt(m))) c, 0.95::double * by_ + side as top from s), f as (select *, top + ceil(m / c) * side <= 1 and c * side <= 1 as fits, least(greatest(0.95::double * ax, 0), 1 - c * side) as lft, floor(1 / side) as k from g),
u as (select id, row_number() over (order by id) - 1 as j from raw where px is null)
select id, round(px * 0.95, 9) as x, round(py * 0.95, 9) as y, round(side, 9) as w, round(side, 9) as h, true as placed from raw, f where px is not null
union all select id, round(case when fits then lft + (j % c + 0.5) * side else (j % k + 0.5) / k end, 9), round(case when fits then top + (floor(j / c) + 0.5) * side else 0.96 + (floor(j / k) + 0.5) * (0.04 / ceil(m / k)) end, 9), round(side, 9), round(side, 9), false from u, f"""


def _passthrough(t, scale: float):
    px, py = F.abs("px") * F.lit(scale), F.abs("py") * F.lit(scale)
    items = _vectors(t).select("id", F.when(F.col("id") % 23 != 5, px).alias("px"), py.alias("py"))
    return rounded(layouts.scatter(items, normalize="none"), 9, "x", "y", "w", "h")


@query(_passthrough_sql("0.5::double"))
def scatter_passthrough(t):
    return _passthrough(t, 0.5)


@query(_passthrough_sql("(1 / (select max(abs(embedding[2]::double)) from embeddings))"))
def scatter_passthrough_full(t):
    tallest = _vectors(t).agg(F.max(F.abs("py"))).first()[0]
    return _passthrough(t, 1 / tallest)


def _geo_sql(px: str, py: str) -> str:
    return f"""with raw as (select c_custkey as id, case when c_custkey % 29 <> 0 then ((c_custkey * 47) % 360 - 180)::double end lon, ((c_custkey * 31) % 171 - 85)::double lat from customer),
p as (select id, {px} px, {py} py from raw where lon is not null),
s as (select median(px) mx, median(py) my, min(px) ax, max(px) bx, min(py) ay, max(py) b2, count(*) n from p),
f as (select *, least(0.5 / greatest(bx - mx, mx - ax), 0.475 / greatest(b2 - my, my - ay)) sc, 0.9 / greatest(1, ceil(sqrt(n))) side from s),
u as (select id, row_number() over (order by id) - 1 as k, count(*) over () as m from raw where lon is null),
g as (select side, floor(1 / side)::bigint cols from f)
select id, round(0.5 + (px - mx) * sc, 6) + 0.0 as x, round(0.95 - (0.475 + (py - my) * sc), 6) + 0.0 as y, true as placed from p, f
union all select id, round((k % cols + 0.5) / cols, 6) as x, round(0.96 + (k // cols + 0.5) * (0.04 / ceil(m / cols)), 6) as y, false from u, g"""


def _places(t):
    c = F.col("c_custkey")
    return t("customer").select(c.alias("id"), F.when(c % 29 != 0, (c * 47 % 360 - 180).cast("double")).alias("lon"), (c * 31 % 171 - 85).cast("double").alias("lat"))


@query(_geo_sql("lon", "lat"))
def geo_equirect(t):
    return r6(layouts.geographic(_places(t)).select("id", "x", "y", "placed"), "x", "y")


@query(_geo_sql("radians(lon)", "ln(tan(pi() / 4 + radians(lat) / 2))"))
def geo_mercator(t):
    return r6(layouts.geographic(_places(t), mercator=True).select("id", "x", "y", "placed"), "x", "y")


@query("select coalesce(p_type, '') as value, count(*) as n from part group by 1")
def category_counts(t):
    return layouts.category_counts(t("part"), "p_type")


@query("""with c as (select p_brand as value, count(*) as n from part group by 1), s as (select value, n, n / (select sum(n) from c) as s from c)
select value, n, round(s, 6) as area from s""")
def treemap_areas(t):
    return layouts.treemap_rects(layouts.category_counts(t("part"), "p_brand")).select("value", "n", F.round(F.col("w") * F.col("h"), 6).alias("area"))


def _treemap_sql(value: str, table: str = "part") -> str:
    """Bands by recursion over the groups by falling count, one group a step."""
    return f"""with recursive c as (select {value} as value, count(*) as n from {table} group by 1),
g as (select value, n, n / (select sum(n) from c) as s, row_number() over (order by n desc, value) as i from c),
f as (select i, 1::double as w, 1::double as h, 0::double as x, 0::double as y, 1::double as len, s as top, s as low, s as sum, 0 as band from g where i = 1
union all select i, case when j then w else nw end, case when j then h else nh end, case when j then x else nx end, case when j then y else ny end, case when j then len else least(nw, nh) end,
case when j then top else s end, s, case when j then sum + s else s end, case when j then band else band + 1 end
from (select g.i, g.s, f.w, f.h, f.x, f.y, f.len, f.top, f.sum, f.band,
greatest(top * len * len / ((sum + g.s) * (sum + g.s)), (sum + g.s) * (sum + g.s) / (g.s * len * len)) <= greatest(top * len * len / (sum * sum), sum * sum / (low * len * len)) as j,
w - case when w <= h then 0 else sum / len end as nw, h - case when w <= h then sum / len else 0 end as nh, x + case when w <= h then 0 else sum / len end as nx, y + case when w <= h then sum / len else 0 end as ny
from f join g on g.i = f.i + 1)),
b as (select g.value, g.n, g.s, f.x, f.y, f.w, f.h, max(f.sum) over (partition by band) / least(f.w, f.h) as deep, coalesce(sum(g.s) over (partition by band order by i rows between unbounded preceding and 1 preceding), 0) as off_ from f join g using (i)),
r as (select value, n, case when w <= h then x + off_ / deep else x end as x0, case when w <= h then y else y + off_ / deep end as y0, case when w <= h then s / deep else deep end as rw, case when w <= h then deep else s / deep end as rh from b)"""


@query(_treemap_sql("p_brand") + " select value, n, round(x0, 6) + 0.0 as x0, round(y0, 6) + 0.0 as y0, round(rw, 6) as w, round(rh, 6) as h from r")
def treemap_rects(t):
    return r6(layouts.treemap_rects(layouts.category_counts(t("part"), "p_brand")), "x0", "y0", "w", "h")


@query(_treemap_sql("p_type") + """, k as (select p_partkey as id, p_type as value, row_number() over (partition by p_type order by p_partkey) - 1 as j from part),
q as (select *, greatest(1, least(n, round_even(sqrt(n * rw / rh), 0))) as c from r)
select id, value, round(x0 + rw * (1 - 0.9::double) / 2 + (j % c + 0.5) * (rw * 0.9 / c), 9) + 0.0 as x, round(y0 + rh * (1 - 0.9::double) / 2 + (floor(j / c) + 0.5) * (rh * 0.9 / ceil(n / c)), 9) + 0.0 as y, round(rw * 0.9 / c * 0.9, 9) as w, round(rh * 0.9 / ceil(n / c) * 0.9, 9) as h from k join q using (value)""")
def treemap_cells(t):
    return rounded(layouts.treemap_cells(t("part").withColumn("id", F.col("p_partkey")), "p_type"), 9, "x", "y", "w", "h")


@query(_treemap_sql("case when p_partkey % 97 = 0 then '' else p_brand end") + ", o as (select *, row_number() over (order by n desc, value) as k from r) select value, n, value = '' as missing, round(x0, 6) + 0.0 as x0, round(y0, 6) + 0.0 as y0, round(x0 + rw, 6) as x1, round(y0 + rh, 6) as y1 from o where k <= 10 - (select max((value = '' and k > 10)::int) from o) or value = ''")
def treemap_labels(t):
    part = t("part").withColumn("brand", F.when(F.col("p_partkey") % 97 != 0, F.col("p_brand")))
    return r6(layouts.treemap_labels(layouts.category_counts(part, "brand"), 10), "x0", "y0", "x1", "y1")


@query(_treemap_sql("p_brand") + """, k as (select p_partkey as id, p_brand as value, row_number() over (partition by p_brand order by p_partkey) - 1 as j from part), q as (select *, greatest(1, least(n, round_even(sqrt(n * rw / rh), 0))) as c from r),
cells as (select id, x0 + rw * (0.05 + 0.9 * (j % c + 0.5) / c) as x, y0 + rh * (0.05 + 0.9 * (floor(j / c) + 0.5) / ceil(n / c)) as y, rw * 0.9 / c * 0.9 as w, rh * 0.9 / ceil(n / c) * 0.9 as h from k join q using (value))
select p_type as value, count(*) as n, round(min(x - w / 2), 6) + 0.0 as x0, round(min(y - h / 2), 6) + 0.0 as y0, round(max(x + w / 2), 6) as x1, round(max(y + h / 2), 6) as y1 from cells join part on p_partkey = id group by 1""")
def category_bbox(t):
    part = t("part").withColumn("id", F.col("p_partkey"))
    return r6(view.members_box(layouts.treemap_cells(part, "p_brand").drop("value"), part.select("id", F.col("p_type").alias("value"))), "x0", "y0", "x1", "y1")


@query("select date_trunc('month', o_orderdate)::timestamp as bucket, count(*) as n from orders group by 1")
def dt_buckets(t):
    return t("orders").groupBy(layouts.floor_time(F.col("o_orderdate"), "month", 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("select min(gap) as least_gap, max(n) as deepest from (select n, epoch(b)::bigint - lag(epoch(b)::bigint) over (order by b) as gap from (select date_trunc('day', o_orderdate) b, count(*) n from orders group by 1))")
def dt_gaps(t):
    from pyspark.sql import Window

    b = t("orders").groupBy(layouts.floor_time(F.col("o_orderdate"), "day", 1).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    at = F.unix_seconds(F.col("b").cast("timestamp"))
    return b.withColumn("gap", at - F.lag(at).over(Window.orderBy("b"))).agg(F.min("gap").alias("least_gap"), F.max("n").alias("deepest"))


DT_SQL = """with u as (select ceil(epoch(max(o_orderdate) - min(o_orderdate)) / 86400.0) <= least(2000, ceil(5 * sqrt(count(*)))) as by_day from orders),
v as (select by_day, case when by_day then 86400.0 else 2419200.0 end as least from u),
d as (select o_orderkey as id, o_orderdate as t, case when by_day then date_trunc('day', o_orderdate) else date_trunc('month', o_orderdate) end as b from orders, u),
bins as (select b, count(*) n, epoch(b) ep from d group by b), g as (select *, ep - lag(ep) over (order by b) gap from bins),
p as (select max(n) deepest, min(gap) gap, min(ep) a, max(ep) z, arg_max(n, ep) tail, any_value(least) as least, any_value(by_day) as by_day from g, v),
k as (select k, least(0.92 / (k * ((z - a) / least + 1) + 0.25 * ((z - a) / least)), 0.96 / ceil(deepest / k)) pitch, p.* from p, unnest(generate_series(1, greatest(1, case when gap / least < 1 then least(deepest, floor(0.25 * (gap / least) / (1 - gap / least))::bigint) else deepest end))) u(k)),
s as (select * from k order by pitch desc, k limit 1),
q as (select *, (k + 0.25) * pitch / least as kt from s), r as (select *, 0.04 + greatest(0, (0.92 - (kt * (z - a) + least(tail, k) * pitch)) / 2) as x0, case when k = 1 then least(0.85 * pitch, 0.85 * kt * gap) else 0.85 * pitch end as side from q),
c as (select id, b, ep, row_number() over (partition by d.b order by t, id) - 1 as slot from d join bins using (b)),
cells as (select id, b, slot, x0 + (ep - a) * kt + (slot % k + 0.5) * pitch as x, 0.96 - (slot // k + 0.5) * pitch as y, side as w, side as h from c, r)"""


@query(DT_SQL + " select id, b::timestamp as bucket, slot::int as slot, round(x, 6) as x, round(y, 6) as y from cells")
def dt_layout(t):
    cells, _ = layouts.histogram(t("orders").withColumn("id", F.col("o_orderkey")), "o_orderdate")
    return r6(cells.select("id", "bucket", "slot", "x", "y"), "x", "y")


BOX = "box as (select greatest(0, least(1, min(x - w / 2))) x0, greatest(0, least(1, min(y - h / 2))) y0, greatest(0, least(1, max(x + w / 2))) x1, greatest(0, least(1, max(y + h / 2))) y1 from cells)"


def _tile_sql(z: int) -> str:
    n = 1 << z
    return f"least({n - 1}, greatest(0, trunc((x - x0) / (x1 - x0) * {n})))::int as tx, least({n - 1}, greatest(0, trunc((y - y0) / (y1 - y0) * {n})))::int as ty"


@query(DT_SQL + f", {BOX}, z as (select {_tile_sql(3)} from cells, box) select tx, ty, count(*) as n from z group by tx, ty order by n desc, ty, tx limit 20")
def dt_histogram_tiles(t):
    calendar = _stored(t, "calendar", lambda: layouts.histogram(t("orders").withColumn("id", F.col("o_orderkey")), "o_orderdate")[0].select("id", "x", "y", "w", "h"), "orders")
    tiles = pyramid.tiled(calendar.cells(t("region").sparkSession), calendar.box, 3).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    return tiles.orderBy(F.desc("n"), "ty", "tx").limit(20)


@query(DT_SQL + " select case when by_day then 'day' else 'month' end as kind, 1 as step, k::int as k, round(x0, 9) as range_start, round(x0 + kt * (z - a), 9) as range_end from r")
def dt_axis(t):
    items = t("orders").withColumn("id", F.col("o_orderkey"))
    _, a = layouts.histogram(items, "o_orderdate")
    return items.sparkSession.createDataFrame([(a.get("kind"), a.get("step"), a.get("k"), *a.get("range", [None, None]))], "kind string, step int, k int, range_start double, range_end double")


@query("""with recursive e as (select min(o_orderdate) a, max(o_orderdate) b from orders), m as (select case when a > date_trunc('month', a) then date_trunc('month', a) + interval 1 month else date_trunc('month', a) end::timestamp as f, date_trunc('month', b)::timestamp as l from e),
n as (select year(f) * 12 + month(f) - 1 as i, year(l) * 12 + month(l) - 1 as j from m),
w as (select d from (values (1), (2), (3), (4), (6), (12), (24), (60), (120), (240), (600), (1200)) v(d), n order by abs(ln(((j - i) // d + 1) / 9.0)), d limit 1)
select epoch(make_timestamp(k // 12, k % 12 + 1, 1, 0, 0, 0))::bigint as t, strftime(make_timestamp(k // 12, k % 12 + 1, 1, 0, 0, 0), '%Y-%m') as label from n, w, unnest(generate_series((ceil(i / d) * d)::bigint, j, d)) u(k)""")
def month_ticks(t):
    o = t("orders")
    a, b = o.select(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s")).agg(F.min("s"), F.max("s")).first()
    return ticks.interval_ticks(o.sparkSession, a, b, 9, "month", 1)


@query("""with e as (select year(min(o_orderdate)) a, year(max(o_orderdate)) b from orders), s as (select d, a, b from (values (1), (2), (5), (10), (20), (25), (50), (100)) v(d), e order by abs(ln(d * 5.0 / greatest(1, b - a))), d limit 1)
select epoch(make_timestamp(y, 1, 1, 0, 0, 0))::bigint as t, y::varchar as label from s, unnest(generate_series((ceil(a / d) * d)::bigint, b, d)) u(y)""")
def year_ticks(t):
    o = t("orders")
    a, b = o.select(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s")).agg(F.min("s"), F.max("s")).first()
    return ticks.axis_ticks(o.sparkSession, a, b, 5, ("hour", 5))  # uneven bins: years


@query("select o_orderkey as id, round(0.1 + (epoch(o_orderdate) - a) * 0.8 / (b - a), 6) as x, epoch(o_orderdate)::bigint as back from orders, (select epoch(min(o_orderdate)) a, epoch(max(o_orderdate)) b from orders)")
def axis_places(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s"))
    ends, reach = o.agg(F.min("s"), F.max("s")).first(), (0.1, 0.9)
    x = ticks.place_of(F.col("s"), ends, reach)
    return o.select("id", F.round(x, 6).alias("x"), F.round(ticks.time_at(x, ends, reach)).cast("long").alias("back"))


# pyramid over the scatter of lineitem's prices and quantities

LINES_SQL = SCATTER_SQL.replace("select vec_id as id, embedding[1]::double as px, embedding[2]::double as py from embeddings", "select row_number() over (order by l_orderkey, l_linenumber, l_extendedprice, l_quantity) - 1 as id, l_extendedprice as px, l_quantity::double as py from lineitem")
BOX_SQL = LINES_SQL + ", " + BOX
CAP = pyramid.cap_for()


_baked: dict[tuple[str, str], baked.Baked] = {}


def _stored(t, name: str, cells, of: str = "lineitem") -> baked.Baked:
    """The layout of that name, baked when an application first asks for it; its cells() and spots() are stored tables."""
    source = t(of)
    key = source.sparkSession.sparkContext.applicationId, f"{name}:{','.join(sorted(source.inputFiles()))}"
    if key not in _baked or not baked.is_whole(source.sparkSession, _baked[key].path):
        _baked[key] = baked.bake(cells())
    return _baked[key]


def _layout(t) -> baked.Baked:
    def cells():
        order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]
        items = ids.dense_ids(t("lineitem").select(*order), *order, n=t("lineitem").count()).select("id", F.col("l_extendedprice").alias("px"), F.col("l_quantity").cast("double").alias("py"))
        return layouts.scatter(items).drop("placed")

    return _stored(t, "lines", cells)


def _lines(t):
    return _layout(t).cells(t("region").sparkSession).drop("key")


def _levels_sql(cells: str) -> str:
    """Levels 0 to 24 of `cells`, each cell binned anew at each level."""
    tile = lambda c: f"least((1 << z) - 1, greatest(0, trunc(({c} - {c}0) / ({c}1 - {c}0) * (1 << z))))::int"
    return f"""{cells}, t as (select z, {tile('x')} as tx, {tile('y')} as ty, count(*) as n, max(x) - min(x) as dx, max(y) - min(y) as dy from cells, box, unnest(generate_series(0, 24)) u(z) group by 1, 2, 3),
m as (select max(w) as mw, max(h) as mh from cells),
l as (select z, count(*) as tiles, max(n) as fullest, count(*) filter (n > {CAP}) as over, sum(greatest(n - {CAP}, 0))::bigint as dropped,
bool_or(n > {CAP} and (dx > (select x1 - x0 from box) / 16777216 or dy > (select y1 - y0 from box) / 16777216)) as separable,
bool_or(n > {CAP} and n * (mw * mh) <= (dx + mw) * (dy + mh)) as packable from t, m group by z)"""


@query(BOX_SQL + f", z as (select {_tile_sql(3)} from cells, box) select tx, ty, count(*) as n from z group by tx, ty")
def tile_counts(t):
    return pyramid.tiled(_lines(t), _layout(t).box, 3).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))


def _summary(t):
    b = _layout(t)
    return pyramid.level_summary(pyramid.roll_up(b.spots(t("region").sparkSession), n=b.n), CAP, b.box, b.w, b.h)


@query(_levels_sql(BOX_SQL) + " select z::int as z, tiles, fullest, over, dropped, separable, packable from l")
def level_summary(t):
    return _summary(t)


@query(SCATTER_SQL + ", " + BOX + " " + " union all ".join(f"select {z} as z, tx, ty from (select distinct {_tile_sql(z)} from cells, box)" for z in range(25)))
def occupied_levels(t):
    c = _scattered(t)
    return pyramid.levels(c, pyramid.bbox(c)).select("z", "tx", "ty")


CHOICE_SQL = f""" , a as (select l.*, lead(tiles) over (order by z) as after, (select greatest(0, least(24, floor(log2((x1 - x0) / mw)), floor(log2((y1 - y0) / mh)))) from box, m) as ceiling, (select 16 * greatest(1, ceil(count(*) / {CAP}.0)) from cells) as budget from l),
w as (select z, case when fullest <= {CAP} then 'fits' when not separable then 'coincident' when z >= ceiling and not packable then 'ceiling' when after > budget then 'budget' end as reason from a where z < 24)
select z::int as z, reason from (select z, reason from w where reason is not null union all select 24, 'depth') order by z limit 1"""


def _choice(t, b):
    spark = t("region").sparkSession
    return spark.createDataFrame([pyramid.settle(b.spots(spark), b.n, CAP, b.box, b.w, b.h)], "z int, reason string")


@query(_levels_sql(BOX_SQL) + CHOICE_SQL)
def choose_z(t):
    return _choice(t, _layout(t))


PILES_SQL = "with cells as (select l_orderkey * 8 + l_linenumber as id, ((l_orderkey * 7) % 13) / 13.0 + (l_linenumber % 3) * 1e-9 as x, ((l_orderkey * 5) % 11) / 11.0 as y, 0.004::double as w, 0.004::double as h from lineitem), " + BOX


@query(_levels_sql(PILES_SQL) + CHOICE_SQL)
def choose_z_of_piles(t):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    x, y = (o * 7 % 13) / F.lit(13.0) + (n % 3) * F.lit(1e-9), (o * 5 % 11) / F.lit(11.0)
    return _choice(t, _stored(t, "piles", lambda: t("lineitem").select((o * 8 + n).alias("id"), x.alias("x"), y.alias("y"), F.lit(0.004).alias("w"), F.lit(0.004).alias("h"))))


@query(BOX_SQL + f" select round(max(w) * 8 / max(x1 - x0), 6) as widest, round(max(h) * 8 / max(y1 - y0), 6) as tallest from cells, box")
def tile_spans(t):
    return r6(pyramid.tile_spans(_lines(t), _layout(t).box, 3), "widest", "tallest")


@query(BOX_SQL + f", z as (select id, {_tile_sql(3)} from cells, box), sl as (select *, row_number() over (partition by tx, ty order by id) - 1 as slot from z) select id, tx, ty, slot::int as slot, (slot % 8) / 8.0 as u, (slot // 8) / 8.0 as v from sl where slot < {CAP}")
def fine_tile_keep(t):
    return pyramid.fine(_lines(t), _layout(t).box, 3, CAP).select("id", "tx", "ty", "slot", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))


@query(BOX_SQL + f", z as (select {_tile_sql(5)} from cells, box) select tx, ty, least(count(*), {CAP}) as kept, greatest(count(*) - {CAP}, 0) as dropped from z group by 1, 2")
def fine_tiles(t):
    return pyramid.fine_tiles(_lines(t), _layout(t).box, 5, CAP)


@query(BOX_SQL + f", z as (select {_tile_sql(3)} from cells, box), k as (select count(*) as n from z group by tx, ty) select sum(n)::bigint as items, sum(least(n, {CAP}))::bigint as kept, sum(greatest(n - {CAP}, 0))::bigint as dropped from k")
def reconcile(t):
    c = _lines(t)
    kept = pyramid.fine(c, _layout(t).box, 3, CAP).agg(F.count("id").alias("kept"))
    lost = _summary(t).filter("z = 3").select("dropped")
    return kept.join(lost, F.lit(True)).join(c.agg(F.count(F.lit(1)).alias("items")), F.lit(True))  # single rows


@query(SCATTER_SQL + ", " + BOX + f", z as (select a.id, a.x, a.y, a.w, a.h from cells a) select a.id, b.id as other from z a join z b on a.id < b.id and abs(a.x - b.x) < (a.w + b.w) / 2 and abs(a.y - b.y) < (a.h + b.h) / 2")
def overlapping_neighbours(t):
    c = _scattered(t)
    return pyramid.neighbours(c, pyramid.bbox(c))


@query(BOX_SQL + f", z as (select {_tile_sql(4)} from cells, box), n as (select tx, ty, least(count(*), {CAP}) / {CAP}.0 as alpha from z group by 1, 2) select tx >> 1 as tx, ty >> 1 as ty, round(sum(alpha) / 4, 6) as coverage, sum(alpha) / 4 >= 0.45 as kept from n group by 1, 2")
def coverage_gate(t):
    n = pyramid.tiled(_lines(t), _layout(t).box, 4).groupBy("tx", "ty").agg((F.least(F.count(F.lit(1)), F.lit(CAP)) / F.lit(float(CAP))).alias("alpha"))
    return r6(pyramid.covered(n), "coverage")


@query(BOX_SQL + f", z as (select {_tile_sql(5)} from cells, box) select (ty::bigint * 32 + tx)::bigint as page, count(*) as n from z group by 1")
def tile_pages(t):
    return pyramid.tiled(_lines(t), _layout(t).box, 5).groupBy(pyramid.page_id(F.col("tx"), F.col("ty"), 5).alias("page")).agg(F.count(F.lit(1)).alias("n"))


@query(SCATTER_SQL + " select count(*) as n, 0::bigint as lost, round(max(case when id % 1000 = 7 then 0.01 else 0 end), 9)::double as dx, 0.0::double as dy, false as same from cells")
def position_difference(t):
    c = _scattered(t)
    moved = c.withColumn("x", F.when(F.col("id") % 1000 == 7, F.col("x") + 0.01).otherwise(F.col("x")))
    return positions.position_difference(c, moved).select("n", "lost", F.round("dx", 9).alias("dx"), "dy", "same")


@query(GRID_SQL.replace("round(", "(").replace(", 6)", ")::float").replace("customer", "(select c_custkey from customer)"))
def position_table(t):
    c = t("customer").select(F.col("c_custkey").alias("id"))
    return positions.position_table(layouts.grid(c), c.count())


@query("select c.c_custkey as id, 'img' || c_custkey as filename, case when c_custkey % 3 = 0 then c_custkey || '.webp' end as detail_ref from customer c where c_custkey % 5 <> 0")
def rekey_and_detail(t):
    name = F.concat(F.lit("img"), "c_custkey").alias("filename")
    c = t("customer")
    kept = positions.rekeyed(c.select((F.col("c_custkey") * 10).alias("id"), name), c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), name))
    return positions.detail_refs(kept, c.filter("c_custkey % 3 = 0").select(F.concat("c_custkey", F.lit(".webp")).alias("name"))).select("id", "filename", "detail_ref")


# views

VIEW = (0.3, 0.3, 0.6, 0.55)


def _overlap_sql(v: tuple) -> str:
    return f"x + w / 2 > {v[0]} and x - w / 2 < {v[2]} and y + h / 2 > {v[1]} and y - h / 2 < {v[3]}"


OVERLAP = _overlap_sql(VIEW)


@query(LINES_SQL + f" select count(*) as n from cells where {OVERLAP}")
def viewport_count(t):
    return view.in_view(_layout(t).near(t("region").sparkSession, VIEW), VIEW)


SMALL_VIEW = (0.41, 0.47, 0.4102, 0.476)


@query(LINES_SQL + f", v as (select id from cells where {_overlap_sql(SMALL_VIEW)}) select id from v where (select count(*) from v) <= 1000")
def range_scan_cap(t):
    return view.range_scan(_layout(t).near(t("region").sparkSession, SMALL_VIEW), SMALL_VIEW, 1000)


@query(LINES_SQL + f", v as (select id from cells where {OVERLAP}) select id from v where (select count(*) from v) <= 40")
def range_scan_over_cap(t):
    return view.range_scan(_layout(t).near(t("region").sparkSession, VIEW), VIEW, 40)


@query(BOX_SQL + f", z as (select id, {_tile_sql(5)} from cells, box) select id from z where tx = 13 and ty = 17")
def tile_container(t):
    spark, path = t("region").sparkSession, shared_dir(t("region").sparkSession)
    levels = [pyramid.tiled(_lines(t), _layout(t).box, z).withColumn("z", F.lit(z)) for z in (3, 5)]
    parts = max(2 * _layout(t).n // ids.SORTED, spark.sparkContext.defaultParallelism)
    write_tiles(levels[0].unionByName(levels[1]).withColumn("layout_id", F.lit("scatter")), path, parts)
    return read_tile(spark, path, "scatter", 5, 13, 17).select("id")


@query(BOX_SQL + f", z as (select id, x, y, {_tile_sql(5)} from cells, box) select id, round(x, 9) + 0.0 as x, round(y, 9) + 0.0 as y from z where tx = 13 and ty = 17")
def tile_read(t):
    found = baked.in_tile(_layout(t), t("region").sparkSession, 5, 13, 17)
    return found.select("id", (F.round("x", 9) + 0.0).alias("x"), (F.round("y", 9) + 0.0).alias("y"))


@query(LINES_SQL + " select id, round((x - 0.5) * (x - 0.5) + (y - 0.475) * (y - 0.475), 9) as d2 from cells where abs(x - 0.5) <= w / 2 and abs(y - 0.475) <= h / 2 order by (x - 0.5) * (x - 0.5) + (y - 0.475) * (y - 0.475), id desc limit 1")
def point_pick(t):
    return view.pick(_layout(t).near(t("region").sparkSession, (0.5, 0.475, 0.5, 0.475)), 0.5, 0.475).withColumn("d2", F.round("d2", 9))


@query(BOX_SQL + f", z as (select *, {_tile_sql(2)} from cells, box) select tx, ty, count(*) as n, count(*) - 640 as dropped, round(arg_min(x, id), 6) as x, round(arg_min(y, id), 6) as y from z group by tx, ty having count(*) > 640")
def hotspots(t):
    return r6(view.hotspots(_lines(t), _layout(t).box, 2, 640), "x", "y")


@query(LINES_SQL + ", e as (select min(x) ax, max(x) bx, min(y) ay, max(y) b2 from cells) select least(5, floor((x - ax) / (bx - ax) * 6))::int as gx, least(5, floor((y - ay) / (b2 - ay) * 6))::int as gy, id % 3 = 0 as matched, count(*) as n, round(min(x - w / 2), 6) as x0, round(min(y - h / 2), 6) as y0, round(max(x + w / 2), 6) as x1, round(max(y + h / 2), 6) as y1 from cells, e group by 1, 2, 3")
def marker_bins(t):
    return r6(view.marker_bins(_lines(t), F.col("id") % 3 == 0, 6), "x0", "y0", "x1", "y1")


@query(LINES_SQL + " select floor(x / 0.05 + 0.5)::bigint as bx, floor(y / 0.05 + 0.5)::bigint as by, min(id) as id, count(*) as n from cells group by 1, 2")
def coincident_reps(t):
    return view.coincident(_lines(t), 0.05)


@query(LINES_SQL + " (select id from cells order by x, id limit 8) union (select id from cells order by x desc, id limit 8)")
def extreme_x_ids(t):
    return view.extremes(_lines(t), 8)


@query("select l_extendedprice as median from lineitem order by l_extendedprice limit 1 offset (select (count(*) // 2)::bigint from lineitem)")
def upper_median(t):
    return view.upper_median(t("lineitem"), "l_extendedprice")


@query("select round(regr_slope(l_extendedprice, l_quantity), 4) as a, round(regr_intercept(l_extendedprice, l_quantity), 4) as b from lineitem")
def time_fit(t):
    return view.time_fit(t("lineitem"), "l_quantity", "l_extendedprice").select(F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


SEEN_SQL = BOX_SQL + ", sp as (select greatest(0, floor((0.3 - x0) / (x1 - x0) * 8) - 1)::int a, least(7, floor((0.6 - x0) / (x1 - x0) * 8) + 1)::int b, greatest(0, floor((0.3 - y0) / (y1 - y0) * 8) - 1)::int c, least(7, floor((0.55 - y0) / (y1 - y0) * 8) + 1)::int d from box), v as (select tx::int as tx, ty::int as ty from sp, unnest(generate_series(a, b)) u(tx), unnest(generate_series(c, d)) w(ty))"


@query(SEEN_SQL + " select tx, ty from v")
def visible_tiles(t):
    return view.visible_tiles(t("region").sparkSession, _layout(t).box, VIEW, 3)


@query(SEEN_SQL + " select tx, ty, round((x0 + (tx + 0.5) / 8 * (x1 - x0) - 0.4) * (x0 + (tx + 0.5) / 8 * (x1 - x0) - 0.4) + (y0 + (ty + 0.5) / 8 * (y1 - y0) - 0.4) * (y0 + (ty + 0.5) / 8 * (y1 - y0) - 0.4), 9) as d2 from v, box")
def focal_tiles(t):
    box = _layout(t).box
    return view.focal_order(view.visible_tiles(t("region").sparkSession, box, VIEW, 3), box, 3, 0.4, 0.4).withColumn("d2", F.round("d2", 9))


@query("select 'o_orderpriority' as field, o_orderpriority as value, count(*) as n from orders group by 2 union all select 'o_orderstatus', o_orderstatus, count(*) from orders group by 2 union all select 'o_orderdate', strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') || ' .. ' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S'), count(o_orderdate) from orders")
def selection_digest(t):
    return view.selection_digest(t("orders"), ["o_orderpriority", "o_orderstatus"], "o_orderdate")


@query()
def declutter_chips(t):
    chips = view.hotspots(_lines(t), _layout(t).box, 3, 4).select((F.col("ty") * 8 + F.col("tx")).cast("long").alias("id"), "n", "x", "y")
    return r6(view.declutter(chips, 0.15, 12), "x", "y")


# catalogue; small tables derived from nation, supplier, part

@query("""with disk as (select s_suppkey id from supplier where s_suppkey % 4 <> 0), rec as (select s_suppkey id, s_suppkey + 1000 job from supplier where s_suppkey % 5 <> 0), jobs as (select s_suppkey + 1000 job, case s_suppkey % 3 when 0 then 'queued' when 1 then 'failed' else 'finished' end state from supplier)
select coalesce(disk.id, rec.id) as dataset_id, case when disk.id is not null and rec.id is null then 'unassigned' when disk.id is not null then 'ready' when state in ('queued', 'started') then 'processing' else 'error' end as status, case when state in ('queued', 'started') then rec.job end as active_job from disk full join rec on disk.id = rec.id left join jobs on rec.job = jobs.job""")
def catalog_status(t):
    k = F.col("s_suppkey")
    s = t("supplier")
    disk = s.filter(k % 4 != 0).select(k.alias("dataset_id"))
    rec = s.filter(k % 5 != 0).select(k.alias("dataset_id"), (k + 1000).alias("last_job_id"))
    jobs = s.select((k + 1000).alias("job_id"), F.when(k % 3 == 0, "queued").when(k % 3 == 1, "failed").otherwise("finished").alias("state"))
    return catalog.listing(disk, rec, jobs)


@query("select s_suppkey as dataset_id, case when s_nationkey = 3 then 'u3' else '' end as owner from supplier where s_suppkey % 2 = 0 or s_nationkey = 3")
def readable_datasets(t):
    d = t("supplier").select(F.col("s_suppkey").alias("dataset_id"), F.concat(F.lit("u"), "s_nationkey").alias("owner"), F.when(F.col("s_suppkey") % 2 == 0, "public").otherwise("private").alias("visibility"))
    return catalog.readable(d, "u3").select("dataset_id", "owner")


@query("""with dec as (select p_brand k, p_type f from part where p_partkey % 3 = 0), bak as (select p_size l, p_brand k, case when p_size % 7 = 0 then null else p_type end f from part where p_partkey % 3 = 1),
sup as (select k, f, count(*) s from dec group by 1, 2), need as (select l, k, f, count(*) n from bak group by 1, 2, 3)
select need.l as layout_id, case when max((need.f is not null)::int) = 0 then 'unknown' when max((need.f is not null and coalesce(s, 0) < n)::int) = 1 then 'stale' else 'fresh' end as state from need left join sup on need.k = sup.k and need.f is not distinct from sup.f group by 1""")
def staleness_bag(t):
    p = t("part")
    dec = p.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("key"), F.col("p_type").alias("fingerprint"))
    bak = p.filter("p_partkey % 3 = 1").select(F.col("p_size").alias("layout_id"), F.col("p_brand").alias("key"), F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("fingerprint"))
    return catalog.stale_layouts(dec, bak)


@query("""with a as (select p_brand c, list_sort(list(distinct p_type)) f from part where p_partkey % 40 < 20 group by 1), b as (select p_brand c, list_sort(list(distinct p_type)) f from part where p_partkey % 40 >= 10 and p_brand <> 'Brand#11' group by 1)
select coalesce(a.c, b.c) as "column", case when a.f is null then 'added' when b.f is null then 'removed' else 'changed' end as change from a full join b on a.c = b.c where a.f is distinct from b.f""")
def role_diff(t):
    p = t("part").select("p_partkey", F.col("p_brand").alias("column"), F.col("p_type").alias("fingerprint"))
    return catalog.role_diff(p.filter("p_partkey % 40 < 20"), p.filter("p_partkey % 40 >= 10 and column <> 'Brand#11'"))


@query("""with c as (select n_nationkey::bigint id, 't' || n_regionkey ty, n_name c from nation), p as (select ty, c, min(id + case when id % 3 = 0 then 100 else 0 end) i from c where id % 4 <> 0 group by 1, 2)
select c.id as layout_id, p.i as new_id, case when p.i is null then 'orphaned' when p.i = c.id then 'same' else 'renamed' end as state from c left join p on c.ty = p.ty and c.c = p.c""")
def rename_orphan(t):
    n = t("nation").select(F.col("n_nationkey").cast("long").alias("layout_id"), F.concat(F.lit("t"), "n_regionkey").alias("type"), F.array("n_name").alias("columns"))
    now = n.filter("layout_id % 4 <> 0").withColumn("layout_id", F.col("layout_id") + F.when(F.col("layout_id") % 3 == 0, 100).otherwise(0))
    return catalog.renamed(n, now)


@query("select coalesce(a.n_nationkey, b.n_nationkey) as layout_id, case when b.n_nationkey is not null then 'new ' || b.n_name else a.n_name end as body, (case when a.n_nationkey is not null then a.n_nationkey else b.n_nationkey + 15 end)::int as at from (select * from nation where n_nationkey < 15) a full join (select * from nation where n_nationkey % 2 = 0) b using (n_nationkey)")
def manifest_merge(t):
    n = t("nation")
    old = n.filter("n_nationkey < 15").select(F.col("n_nationkey").alias("layout_id"), F.col("n_name").alias("body"), F.col("n_nationkey").alias("at"))
    new = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("layout_id"), F.concat(F.lit("new "), "n_name").alias("body"), F.col("n_nationkey").alias("at"))
    return catalog.merge_manifest(old, new).withColumn("at", F.col("at").cast("int"))


@query("select 'd' || (s_suppkey % 3) as dir, 'tiles.v' || s_suppkey || '.bin' as name, s_suppkey as version from supplier where s_suppkey % 6 <> 0")
def stale_assets(t):
    s = t("supplier").select(F.concat(F.lit("d"), F.col("s_suppkey") % 3).alias("dir"), F.concat(F.lit("tiles.v"), "s_suppkey", F.lit(".bin")).alias("name"), "s_suppkey")
    extra = s.select("dir", F.lit("notes.txt").alias("name")).distinct()
    return catalog.unreferenced(s.select("dir", "name").union(extra), s.filter("s_suppkey % 6 = 0").select("dir", "name"))


@query("select p_name || p_partkey as name, case when p_partkey % 3 = 0 then 'needed' when p_partkey % 5 = 0 or (p_partkey % 7 = 0 and p_partkey % 2 = 0) then 'mismatched' else 'present' end as state from part")
def upload_check(t):
    k = F.col("p_partkey")
    p = t("part").withColumn("name", F.concat("p_name", "p_partkey"))
    asked = p.select("name", F.col("p_size").alias("size"), F.when(k % 2 == 0, "a").alias("sha"))
    held = p.filter(k % 3 != 0).select("name", (F.col("p_size") + F.when(k % 5 == 0, 1).otherwise(0)).alias("size"), F.when(k % 7 == 0, "b").otherwise("a").alias("sha"))
    return catalog.upload_check(asked, held)


@query("select count(*) as n, sum(p_size)::bigint as bytes from part")
def bundle_tally(t):
    p = t("part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    return catalog.tally(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1"))


@query("select lower(p_name) as key, arg_min(case when p_partkey % 2 = 0 then upper(p_name) else p_name end, p_partkey) as name, min(p_partkey) as at, count(*) - 1 as duplicates from part group by 1")
def dedupe_selection(t):
    f = t("part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_partkey").alias("at"))
    return catalog.unique_selection(f)


@query("""with b as (select p_brand k, p_type f from part where p_partkey % 3 = 0), a as (select p_brand k, p_type f from part where p_partkey % 3 = 0 and p_partkey % 2 = 0), bak as (select p_size l, p_brand k, case when p_size % 7 = 0 then null else p_type end f from part where p_partkey % 12 = 1),
need as (select l, k, f, count(*) n from bak group by 1, 2, 3), w as (select l, k, f, n, (select count(*) from b where b.k = need.k and b.f = need.f) sb, (select count(*) from a where a.k = need.k and a.f = need.f) sa from need)
select l as layout_id, case when max((f is not null)::int) = 0 then 'unknown' when max((f is not null and sa < n)::int) = 0 then 'fresh' when max((f is not null and sb < n)::int) = 1 then 'still' else 'newly' end as state from w group by 1""")
def newly_stale(t):
    p = t("part")
    declared = lambda rule: p.filter(rule).select(F.col("p_brand").alias("key"), F.col("p_type").alias("fingerprint"))
    bak = p.filter("p_partkey % 12 = 1").select(F.col("p_size").alias("layout_id"), F.col("p_brand").alias("key"), F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("fingerprint"))
    return catalog.newly_stale(declared("p_partkey % 3 = 0"), declared("p_partkey % 3 = 0 and p_partkey % 2 = 0"), bak)


@query("""with a as (select p_brand c, list_sort(list(distinct p_type)) f from part where p_partkey % 40 < 20 group by 1), b as (select p_brand c, list_sort(list(distinct p_type)) f from part where p_partkey % 40 >= 10 and p_brand <> 'Brand#11' group by 1) select count(*) as n from a full join b on a.c = b.c where a.f is distinct from b.f""")
def changed_columns(t):
    p = t("part").select("p_partkey", F.col("p_brand").alias("column"), F.col("p_type").alias("fingerprint"))
    return catalog.changed_columns(p.filter("p_partkey % 40 < 20"), p.filter("p_partkey % 40 >= 10 and column <> 'Brand#11'"))


@query("""with own as (select n_nationkey d, case when n_nationkey % 2 = 0 then 'url' else 'text' end v from nation where n_nationkey % 3 <> 0), old as (select n_nationkey d, 'url' v from nation where n_nationkey % 4 <> 0)
select coalesce(own.d, old.d) as dataset, coalesce(own.v, old.v) as render, case when coalesce(own.v, old.v) = 'url' then 'a,link' else 'link' end as links from own full join old on own.d = old.d""")
def presentation(t):
    n, k = t("nation"), F.col("n_nationkey")
    maps = lambda rule, v: n.filter(rule).select(k.alias("dataset"), F.create_map(F.lit("a"), v, F.lit("link"), F.lit("url")).alias("columns"))
    out = catalog.presentation(maps("n_nationkey % 3 <> 0", F.when(k % 2 == 0, "url").otherwise("text")), maps("n_nationkey % 4 <> 0", F.lit("url")))
    return out.select("dataset", F.col("columns")["a"].alias("render"), F.array_join("links", ",").alias("links"))


@query("select n_nationkey as dataset, case n_nationkey % 4 when 0 then 'old' when 1 then null when 2 then null else 'new' end as a, case when n_nationkey % 4 = 3 then 'more' end as b from nation")
def presentation_updates(t):
    n, k = t("nation"), F.col("n_nationkey")
    new = F.when(k % 4 == 1, F.create_map(F.lit("a"), F.lit(" "))).when(k % 4 == 2, F.create_map(F.lit("a"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), F.lit("more")))
    out = catalog.updated(n.select(k.alias("dataset"), F.create_map(F.lit("a"), F.lit("old")).alias("columns")), n.filter("n_nationkey % 4 <> 0").select(k.alias("dataset"), new.alias("columns")))
    return out.select("dataset", F.col("columns")["a"].alias("a"), F.col("columns")["b"].alias("b"))


@query("""with k as (select p_partkey k, p_partkey % 5 in (2, 4) as refused, p_partkey % 5 in (0, 1) as wrote from part),
u as (select *, not refused and k % 4 = 0 as a_off, not refused and k % 4 = 1 as b_gone from k)
select k as dataset, refused, case when wrote and k % 5 = 1 then null when k % 3 = 0 then 'own' when wrote and k % 2 = 0 then 'old' end as display_name, case when k % 3 = 0 then 'x' end as attribution, case when wrote and k % 3 <> 0 and k % 2 = 0 then 'u' end as attribution_url, case when k % 5 = 0 then 'grid' end as default_layout,
case when a_off then null else 'url' end as a_render, not b_gone as b_described, case when not refused and k % 4 = 2 then 'C' end as c_label, case when a_off then '' else 'a,' end || case when b_gone then 'b,' else '' end || 'd' as links,
case when wrote then case when k % 5 = 1 then null when k % 3 = 0 then 'own' when k % 2 = 0 then 'old' end when k % 3 = 0 then 'own' when k % 2 = 0 then 'old' end as shown_name from u""")
def presentation_applied(t):
    p, k = t("part"), F.col("p_partkey")
    text = lambda **kv: F.create_map(*[x for n, v in kv.items() for x in (F.lit(n), F.lit(v).cast("string"))])
    none, gone = F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,map<string,string>>")
    records = p.select(k.alias("dataset"), F.when(k % 3 == 0, text(display_name="own", attribution="x")).otherwise(none).alias("block"), F.create_map(F.lit("a"), text(render="url", label="A"), F.lit("b"), text(label="B")).alias("columns"))
    older = p.filter(k % 2 == 0).select(k.alias("dataset"), text(display_name="old", attribution=None, attribution_url="u", note="n").alias("block"))
    block = F.when(k % 5 == 0, text(default_layout="grid")).when(k % 5 == 1, text(display_name=" ")).when(k % 5 == 2, text(display_name="new", bogus="1")).when(k % 5 == 4, text(attribution="z" * 300)).otherwise(none)
    entries = F.when(k % 4 == 0, F.create_map(F.lit("a"), text(render=None))).when(k % 4 == 1, F.create_map(F.lit("b"), none)).when(k % 4 == 2, F.create_map(F.lit("c"), text(label="C"))).otherwise(gone)
    after = catalog.applied(records, p.select(k.alias("dataset"), block.alias("block"), entries.alias("columns")), older)
    legacy = p.select(k.alias("dataset"), F.array(F.lit("a"), F.lit("b"), F.lit("d")).alias("url"))
    shown = catalog.effective(after, older, legacy).select("dataset", F.col("block")["display_name"].alias("shown_name"), F.array_join("links", ",").alias("links"))
    b, c = F.col("block"), F.col("columns")
    own = after.select("dataset", "refused", *[b[f].alias(f) for f in catalog.BLOCK_FIELDS[:4]], c["a"]["render"].alias("a_render"), F.map_contains_key(c, "b").alias("b_described"), c["c"]["label"].alias("c_label"))
    return own.join(shown, "dataset")


@query("select distinct p_size as dataset, p_brand as key from part where p_partkey % 2 = 0 and (p_size, p_brand) not in (select p_size, p_brand from part where p_partkey % 2 = 1)")
def unresolved_keys(t):
    p = t("part").select("p_partkey", F.col("p_size").alias("dataset"), F.col("p_brand").alias("key"))
    return catalog.unresolved(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1"))


@query("""with c as (select s_suppkey l from supplier where s_suppkey % 3 = 0), p as (select s_suppkey l from supplier where s_suppkey % 2 = 0), g as (select s_suppkey l, case s_suppkey % 5 when 0 then 'running' when 1 then 'queued' when 2 then 'done' else 'failed' end s from supplier where s_suppkey % 7 <> 0),
e as (select l, max(l in (select l from c)) as k from (select l from c union select l from p union select l from g) group by 1), r as (select e.l, e.k, case when s = 'running' then 'baking' when s = 'queued' or (s is null and e.l in (select l from p)) then 'queued' end as state from e left join g on g.l = e.l)
select l as layout_id, k as committed, state from r where k or state is not null""")
def layout_states(t):
    k = F.col("s_suppkey")
    s = t("supplier").select(k.alias("layout_id"), F.when(k % 5 == 0, "running").when(k % 5 == 1, "queued").when(k % 5 == 2, "done").otherwise("failed").alias("stage"))
    return catalog.layout_states(s.filter("layout_id % 3 = 0").select("layout_id"), s.filter("layout_id % 2 = 0").select("layout_id"), s.filter("layout_id % 7 <> 0"))


@query("""with b as (select p_brand as text, p_brand = 'Brand#2' as missing, min(p_size)::double as x0, max(p_size)::double as x1 from part group by 1)
select p_partkey as id, case when not missing then x0 end as x0, case when not missing then x1 end as x1 from part left join b on text = p_brand""")
def search_bands(t):
    p = t("part")
    hits = p.select(F.col("p_partkey").alias("id"), F.lit("Brand").alias("label"), F.col("p_brand").alias("value"))
    bands = p.groupBy(F.col("p_brand").alias("text")).agg(F.min("p_size").cast("double").alias("x0"), F.max("p_size").cast("double").alias("x1")).withColumns({"label": F.lit("Brand"), "type": F.lit("categorical"), "missing": F.col("text") == "Brand#2", "y0": F.lit(0.0), "y1": F.lit(1.0)})
    return catalog.band_of(hits, bands).select("id", "x0", "x1")


@query("""with l as (select p_brand as selection, string_agg(split_part(n, '/', -1) || ' ' || p_size, chr(10) order by split_part(n, '/', -1) || ' ' || p_size) as t from (select *, 'a/' || p_name as n from part) group by 1)
select selection, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, length(t) + 1), lambda i: unicode(substr(t, i, 1))::bigint)), lambda h, u: ((xor(h, u)::hugeint * 16777619) % 4294967296)::bigint))), 8, '0') as print from l""")
def selection_prints(t):
    return catalog.selection_print(t("part").select(F.col("p_brand").alias("selection"), F.concat(F.lit("a/"), "p_name").alias("name"), F.col("p_size").alias("size")))


@query("select o_orderkey as id, 'img_' || lpad(o_orderkey::varchar, 7, '0') || '.jpg' as filename, true as stable from orders")
def fixture_rows(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    rows, again = fixture_of(o), fixture_of(o.repartition("o_custkey").select("id"))
    same = F.lit(True)
    for c in ("taken", "kind", "px", "py", "tags"):
        same = same & rows[c].eqNullSafe(again[c])
    return rows.join(again, "id").select("id", rows["filename"], same.alias("stable"))


@query("""with f as (select case p_partkey % 4 when 0 then upper(p_name) || '.JPG' when 1 then p_name || '.jpg' when 2 then p_name || '.zip' else p_name end as name from part), k as (select lower(name) as k, case p when 'jpg' then 'i' when 'zip' then 'z' else 'o' end as t, count(*) as n from (select name, lower(split_part(name, '.', -1)) p from f) group by 1, 2)
select count(*) filter (t = 'i') as images, coalesce(sum(n) filter (t = 'z'), 0)::bigint as archives, coalesce(sum(n - 1) filter (t = 'i'), 0)::bigint as duplicates, coalesce(sum(n) filter (t = 'o'), 0)::bigint as ignored from k""")
def selection_counts(t):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.upper("p_name"), F.lit(".JPG"))).when(k == 1, F.concat("p_name", F.lit(".jpg"))).when(k == 2, F.concat("p_name", F.lit(".zip"))).otherwise(F.col("p_name"))
    return catalog.selection_counts(t("part").select(name.alias("name"), F.col("p_partkey").alias("at")))


@query("""with b as (select p_partkey % 50 as layout_id, p_brand as c, case when p_partkey % 50 <> 7 then p_type end as p from part where p_partkey % 3 = 0), d as (select distinct p_brand c, p_type p from part where p_partkey % 3 = 1 and p_partkey % 2 = 0)
select layout_id, count(p) = count(*) as checkable, coalesce(string_agg(distinct c, ',' order by c) filter (p is not null and (c, p) not in (select c, p from d)), '') as stale_columns from b group by 1""")
def baked_staleness(t):
    k, p = F.col("p_partkey"), t("part")
    baked = p.filter(k % 3 == 0).select((k % 50).alias("layout_id"), F.col("p_brand").alias("column"), F.when(k % 50 != 7, F.col("p_type")).alias("print"))
    declared = p.filter((k % 3 == 1) & (k % 2 == 0)).select(F.col("p_brand").alias("column"), F.col("p_type").alias("print"))
    return catalog.baked_staleness(baked, declared).withColumn("stale_columns", F.array_join("stale_columns", ","))


@query("select n_nationkey as layout_id, case when (select count(*) = count(nullif(n_regionkey, 9)) from nation) then '2.10' else '2.8' end as version from nation")
def manifest_restamp(t):
    return catalog.restamped(t("nation").select(F.col("n_nationkey").alias("layout_id"), F.col("n_regionkey").cast("string").alias("print"), F.lit("2.8").alias("version")), "2.10").select("layout_id", "version")


@query("select count(*) as n, count(*) filter (c_custkey in (select o_custkey from orders where o_orderkey % 3 = 0)) as matched from customer")
def matched_metadata(t):
    return ids.matched_count(t("customer").select(F.col("c_custkey").alias("k")), t("orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k")), "k")


@query("select unnest(string_split(p_name, ' ')) as value from part where p_partkey = 25")
def tags_of_one(t):
    return search.tags_of(_tagged(t), "tags", 25)


# keyed state

LIMIT_SQL = """with recursive e as (select user_id, epoch_us(ts) t, row_number() over (partition by user_id order by ts, event_id) i from events),
w as (select user_id, i, t as o, 1 as n, t from e where i = 1 union all select e.user_id, e.i, case when e.t - w.o >= {us} then e.t else w.o end, case when e.t - w.o >= {us} then 1 else w.n + 1 end, e.t from w join e on e.user_id = w.user_id and e.i = w.i + 1)"""


@query(LIMIT_SQL.format(us="21600000000") + " select user_id as key, count(*) filter (n = 1) as windows, count(*) as events, count(*) filter (n > 5) as rejected from w group by 1")
def rate_limit_fixed_window(t):
    return stream.limited(t("events"), "user_id", "ts", 5, 21600)


@query(LIMIT_SQL.format(us="3600000000") + " select user_id as key, count(*) filter (n = 1) as kept from w group by 1")
def throttle_hourly(t):
    return stream.throttled(t("events"), "user_id", "ts", 3600)


@query("select user_id as job, event_type as stage, max(event_id) as done, arg_max(round(value, 6), event_id) as total, arg_max(props, event_id) as state from events group by 1, 2")
def progress_max(t):
    e = t("events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.col("event_id").alias("done"), F.round("value", 6).alias("total"), F.col("props").alias("state"))
    return stream.progress(e)


@query("""with s as (select o_custkey job, o_orderpriority unit, o_totalprice total, o_totalprice * (o_orderkey % 4) / 4 done, (o_orderkey % 100 + 1)::double secs, case when o_orderkey % 3 = 0 then 'running' else 'done' end state, o_orderkey ordinal from orders),
r as (select job, unit, arg_max(done / secs, ordinal) rate from s where state = 'done' group by 1, 2), l as (select s.job, (total - done) / nullif(rate, 0) e from s left join r using (job, unit) where state <> 'done')
select job, round(case when count(e) = count(*) then sum(e) end, 2) as eta from l group by 1""")
def eta(t):
    k = F.col("o_orderkey")
    s = t("orders").select(F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("unit"), F.col("o_totalprice").alias("total"), (F.col("o_totalprice") * (k % 4) / 4).alias("done"), (k % 100 + 1).cast("double").alias("seconds"), F.when(k % 3 == 0, "running").otherwise("done").alias("state"), k.alias("ordinal"))
    return stream.eta(s).select("job", F.round("eta", 2).alias("eta"))


@query("""with s as (select o_custkey job, o_orderpriority unit, o_totalprice total, o_totalprice * (o_orderkey % 4) / 4 done, (o_orderkey % 100)::double secs, case when o_orderkey % 3 = 0 then 'running' when o_orderkey % 3 = 1 then 'queued' else 'done' end state, o_orderkey ordinal from orders),
r as (select job, unit, arg_max(done / secs, ordinal) rate from s where state = 'done' and secs > 0 group by 1, 2),
l as (select s.job, state, case when state = 'running' then (total - done) / nullif(done / nullif(secs, 0), 0) else total / nullif(rate, 0) end e from s left join r using (job, unit) where state <> 'done')
select job, round(case when count(e) = count(*) and count(*) filter (state = 'running') > 0 then sum(e) end, 2) as eta from l group by 1""")
def job_eta(t):
    k = F.col("o_orderkey")
    state = F.when(k % 3 == 0, "running").when(k % 3 == 1, "queued").otherwise("done")
    s = t("orders").select(F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("unit"), F.col("o_totalprice").alias("total"), (F.col("o_totalprice") * (k % 4) / 4).alias("done"), (k % 100).cast("double").alias("seconds"), state.alias("state"), k.alias("ordinal"))
    return stream.job_eta(s).select("job", F.round("eta", 2).alias("eta"))


@query("""with p as (select user_id as job, event_type as stage, max(event_id) as done, case when max(event_id) % 3 = 0 then 'done' else 'running' end as state from events group by 1, 2)
select job, stage, done, case when state = 'running' and job % 4 = 0 then 'failed' else state end as state from p""")
def progress_closed(t):
    e = t("events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.col("event_id").alias("done"), F.lit(1.0).alias("total"), F.when(F.col("event_id") % 3 == 0, "done").otherwise("running").alias("state"))
    return stream.closed(stream.progress(e), t("events").filter("user_id % 4 = 0").select(F.col("user_id").alias("job"))).select("job", "stage", "done", "state")


@query("select event_id // 10 as session, min(ts) as created, max(ts) as last from events group by 1 having max(ts) <= timestamp '2024-01-31 00:00:00' - interval 7 days and not bool_or(user_id % 50 = 0)")
def session_sweep(t):
    f = t("events").select(F.floor(F.col("event_id") / 10).alias("session"), "ts", (F.col("user_id") % 50 == 0).alias("final"))
    return stream.sessions_to_reap(f, "2024-01-31 00:00:00")


@query("select time_bucket(interval '1 hour', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(t):
    return stream.tumbling(t("events"), "ts", "1 hour").withColumn("total", F.round("total", 4))


@query("with h as (select time_bucket(interval '30 minutes', ts)::timestamp b from events), s as (select b as start from h union all select b - interval '30 minutes' from h) select start::timestamp as start, count(*) as n from s group by 1")
def events_sliding(t):
    return stream.sliding(t("events"), "ts", "1 hour", "30 minutes")


@query("with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id as key, min(ts)::timestamp as start, count(*) as n from s group by user_id, k")
def events_sessions(t):
    return stream.session_windows(t("events"), "user_id", "ts", "2 hours")


CHUNKS_SQL = """c as (select user_id session, event_type name, event_id as seq, case when event_id % 17 = 0 then null when event_id % 5 = 0 then 0 when event_id % 29 = 0 then 30 else (event_id % 3) * 10 end off,
case when event_id % 19 = 0 then 25 else 10 end as len, case when event_id % 13 = 0 then 20 else 30 end as size, event_id % 7 <> 3 as ok, case when event_id % 2 = 0 then 'a' else 'b' end as sha from events)"""


@query(f"""with recursive {CHUNKS_SQL}, o as (select *, row_number() over (partition by session, name order by seq) i from c),
f as (select session, name, 0::bigint i, 0::bigint staged, null::bigint declared, null::bigint fsize, null::varchar fsha, 0::bigint refused, 0::bigint failed, 0::bigint already, 0::bigint conflicts from (select distinct session, name from c)
union all select session, name, i, case when done and not whole then 0 when act in ('refused', 'none') then staged when act = 'drop' then 0 when act = 'cut' then off else off + len end, case when done and not whole then null when act in ('refused', 'none') then declared when act = 'drop' then null else size end,
case when done and fsize is null then size else fsize end, case when done and fsize is null then sha else fsha end, refused + (act in ('refused', 'drop'))::int, failed + ((act = 'cut') or (whole and not ok))::int, already + (done and fsize is not null and fsize = size and fsha = sha)::int, conflicts + (done and fsize is not null and not (fsize = size and fsha = sha))::int
from (select *, (whole and ok) or (act = 'add' and off + len = size) as done from (select o.*, f.staged, f.declared, f.fsize, f.fsha, f.refused, f.failed, f.already, f.conflicts, off is null as whole,
case when off is null then 'none' when off < 0 or off >= size or (off > 0 and (off <> staged or size is distinct from declared)) then 'refused' when not ok then 'cut' when off + len > size then 'drop' else 'add' end as act from f join o on o.session = f.session and o.name = f.name and o.i = f.i + 1)))
select session, name, staged, fsize as size, fsha as sha, refused, failed, already, conflicts from f qualify row_number() over (partition by session, name order by i desc) = 1""")
def append_files(t):
    i = F.col("event_id")
    long = lambda c: c.cast("long")
    c = t("events").select(
        F.col("user_id").alias("session"), F.col("event_type").alias("name"), i.alias("seq"),
        long(F.when(i % 17 == 0, None).when(i % 5 == 0, 0).when(i % 29 == 0, 30).otherwise(i % 3 * 10)).alias("offset"), long(F.when(i % 19 == 0, 25).otherwise(10)).alias("length"),
        long(F.when(i % 13 == 0, 20).otherwise(30)).alias("size"), (i % 7 != 3).alias("ok"), F.when(i % 2 == 0, "a").otherwise("b").alias("sha"),
    )
    return stream.appended(c)


@query("""with recursive e as (select epoch_us(ts) t from events), w as (select min(t) o from e union all select (select min(t) from e where t >= o + 21600000000) from w where o is not null),
k as (select o, (select count(*) from e where t >= o and t < o + 21600000000) n from w where o is not null)
select 'all' as key, count(*) as windows, sum(n)::bigint as events, sum(greatest(n - 5, 0))::bigint as rejected from k""")
def rate_limit_one_key(t):
    return stream.limiter_counts(t("events").select(F.lit("all").alias("k"), "ts"), "k", "ts", 21600, 5, busy=1000)


@query("""with recursive e as (select user_id job, event_type stage, event_id % 7 < 4 as busy, epoch_us(ts) t, event_id from events), l as (select *, lag(busy) over (partition by job, stage order by t, event_id) p from e),
r as (select *, sum((p is null or p <> busy)::int) over (partition by job, stage order by t, event_id rows unbounded preceding) run from l), o as (select *, row_number() over (partition by job, stage, run order by t, event_id) i from r),
f as (select job, stage, run, i, t as o, true as kept from o where i = 1 union all select o.job, o.stage, o.run, o.i, case when o.t - f.o >= 7200000000 then o.t else f.o end, o.t - f.o >= 7200000000 from f join o on o.job = f.job and o.stage = f.stage and o.run = f.run and o.i = f.i + 1)
select job, stage, count(*) filter (kept) as kept from f group by 1, 2""")
def progress_flushes(t):
    e = t("events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), (F.col("event_id") % 7 < 4).alias("state"), "ts", F.col("event_id").alias("seq"))
    return stream.flushes(e, 7200)
