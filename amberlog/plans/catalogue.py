"""Queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlog.functions import hashes, labels
from amberlog.operators import classes, graph, histogram, ingest, log, lookup, names, partitions, triples, words
from amberlog.plans import problems
from amberlog.sources.typed import INTEGER, STRING, record, text_column

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query (its name is the function's) with its SQL."""

    def put(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return put


# scans and the log


@query("select count(*) as n, sum(l_quantity) as total_qty from lineitem")
def scan_sum(spark, sf):
    return _t(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total_qty"))


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 20 offset 500")
def scan_skip_take(spark, sf):
    return lookup.head(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey"), n=20, skip=500)


@query("select event_id, user_id, event_type from events where not (event_type = 'error')")
def load_drop_empty(spark, sf):
    return log.load(_t(spark, sf, "events").select("event_id", "user_id", "event_type"), F.col("event_type") == "error")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 100")
def get_by_key(spark, sf):
    return lookup.by_key(_t(spark, sf, "orders"), "o_orderkey", 100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)")
def get_by_keys_batch(spark, sf):
    probes = _t(spark, sf, "lineitem").where("l_quantity > 49")
    return lookup.by_keys(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", probes, "l_orderkey")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) t where rn = 1")
def last_write_wins(spark, sf):
    return log.newest(_t(spark, sf, "events"), "user_id", ["event_id"], ["user_id", "event_id", "event_type"])


@query(
    "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) t where rn = 1 and event_type <> 'error'"
)
def tombstone_current(spark, sf):
    return log.current(_t(spark, sf, "events"), "user_id", ["event_id"], F.col("event_type") == "error", ["user_id", "event_id", "event_type"])


@query("select user_id, max(event_id) as event_id from events where event_type <> 'error' group by user_id")
def tombstone_before_shadow(spark, sf):
    rows = log.load(_t(spark, sf, "events").select("user_id", "event_id", "event_type"), F.col("event_type") == "error")
    return log.newest(rows, "user_id", ["event_id"], ["user_id", "event_id"])


@query(
    "select b.user_id, b.event_id from (select user_id, max(event_id) as event_id from events where event_id < 5000 group by user_id) b left join (select distinct user_id from events where event_id >= 5000) d on b.user_id = d.user_id where d.user_id is null union all select user_id, max(event_id) as event_id from events where event_id >= 5000 group by user_id"
)
def static_plus_delta(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_id")
    base, delta = log.newest(e.where("event_id < 5000"), "user_id", ["event_id"]), log.newest(log.replay(e, "event_id", 5000), "user_id", ["event_id"])
    return log.with_delta(base, delta, "user_id")


@query("select event_id, user_id from events where event_id >= 5000")
def restore_delta(spark, sf):
    return log.replay(_t(spark, sf, "events").select("event_id", "user_id"), "event_id", 5000)


# lookups by value, prefix and order


@query("select p_partkey, p_name, p_size from part where p_size = 10")
def value_eq(spark, sf):
    return lookup.by_value(_t(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_size", 10)


@query("select p_partkey, p_name from part where upper(p_brand) = upper('brand#13')")
def value_eq_icase(spark, sf):
    return lookup.by_value(_t(spark, sf, "part"), "p_brand", "brand#13", ignore_case=True).select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where p_partkey % 64 = 77 % 64 and p_partkey = 77")
def value_hash_recheck(spark, sf):
    # a hash only narrows candidates that the equality tests again; the equality alone prunes as well
    return lookup.by_value(_t(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 77)


@query("select doc_id, count(*) as n from (select doc_id, unnest(regexp_split_to_array(lower(text), '[ \n\t,.:!?\"''=\\\\|/()\\[\\]{};*<>-]+')) as w from documents) t where w = 'the' group by doc_id")
def value_any_element(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", words.words("text").alias("ws"))
    return lookup.by_any_value(rows, F.col("ws"), "the").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, p_name from part where starts_with(upper(p_name), upper('small'))")
def prefix_like(spark, sf):
    return lookup.by_prefix(_t(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "small")


@query("select p_partkey from part where starts_with(upper(p_name), '')")
def prefix_like_empty(spark, sf):
    return lookup.by_prefix(_t(spark, sf, "part"), "p_name", "").select("p_partkey")


@query("select p_partkey, p_brand, p_type from part where p_brand = 'Brand#13' and p_type = 'PROMO'")
def ordered_view_eq(spark, sf):
    return lookup.by_sample(_t(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), {"p_brand": "Brand#13", "p_type": "PROMO"})


@query("select o_orderkey, o_totalprice from orders where (case when o_totalprice < 1000 then -1 when o_totalprice >= 2000 then 1 else 0 end) = 0")
def level_function(spark, sf):
    return lookup.by_level(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1000, 2000)


@query("select o_orderkey, row_number() over (order by o_custkey, o_orderkey) as pos from orders")
def sort_rank(spark, sf):
    return lookup.ranked(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "pos")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def first_n_by_key(spark, sf):
    return lookup.head(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey"), n=10)


@query("select k, row_number() over (order by k, src) as pos from (select c_custkey as k, 1 as src from customer union all select s_suppkey as k, 2 as src from supplier) t")
def merge_two_runs(spark, sf):
    a = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("src"))
    b = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(2).alias("src"))
    return lookup.ranked(a.unionByName(b), ["k", "src"]).select("k", "pos")


@query(
    "with k as (select cast(o_custkey as bigint) as key from orders), m as (select min(key) as mn, max(key) as mx, cast(floor(count(*) / 16) as bigint) as n from k), b as (select cast(floor((k.key - m.mn) * (m.n - 1) / (m.mx - m.mn)) as bigint) as pos, count(*) as c from k cross join m group by 1) select pos, c, sum(c) over (order by pos) - c as start from b"
)
def scale_histogram(spark, sf):
    return histogram.histogram(_t(spark, sf, "orders").select("o_custkey"), "o_custkey")


@query(
    "with k as (select cast(o_custkey as bigint) as key from orders), m as (select min(key) as mn, max(key) as mx, cast(floor(count(*) / 16) as bigint) as n from k), p as (select cast(floor((k.key - m.mn) * (m.n - 1) / (m.mx - m.mn)) as bigint) as pos from k cross join m), q as (select cast(floor((700 - mn) * (n - 1) / (mx - mn)) as bigint) as pos from m) select case when q.pos between 0 and m.n - 1 then (select count(*) from p where p.pos < (select pos from q)) else 0 end as start, case when q.pos between 0 and m.n - 1 then (select count(*) from p where p.pos = (select pos from q)) else 0 end as numb from q cross join m"
)
def scale_diapason(spark, sf):
    return histogram.key_range(_t(spark, sf, "orders").select("o_custkey"), "o_custkey", 700)


# text form, words, names, triples


@query("select p_partkey, concat('{', cast(p_partkey as varchar(20)), ',\"', replace(replace(p_name, '\\', '\\\\'), '\"', '\\\"'), '\"}') as txt from part")
def text_row(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", text_column(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), record(id=INTEGER, name=STRING)).alias("txt"))


_SPLIT = "regexp_split_to_array(lower(text), '[ \n\t,.:!?\"''=\\\\|/()\\[\\]{};*<>-]+')"


@query(f"select w, count(*) as n from (select unnest({_SPLIT}) as w from documents) t where w <> '' group by w")
def word_tokens(spark, sf):
    return words.word_table(_t(spark, sf, "documents"), "doc_id", "text").groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, count(*) as c from (select doc_id, unnest({_SPLIT}) as w from documents) t where w in ('the', 'and', 'of') group by doc_id order by c desc, doc_id limit 20")
def word_rank(spark, sf):
    return words.search_texts(_t(spark, sf, "documents"), "doc_id", "text", "the and of")


@query("select coalesce(d.norm, e.event_type) as w, count(*) as n from events e left join (values ('click', 'view'), ('signup', 'register')) d(form, norm) on e.event_type = d.form group by 1")
def word_normalize(spark, sf):
    forms = spark.createDataFrame([("click", "view"), ("signup", "register")], "form string, norm string")
    return words.normalize(_t(spark, sf, "events").select(F.col("event_type").alias("w")), "w", forms).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("select s, row_number() over (order by first_pos) - 1 as code from (select event_type as s, min(event_id) as first_pos from events group by event_type) t")
def nametable_encode(spark, sf):
    return names.encode_table(_t(spark, sf, "events"), "event_type", "event_id")


_TRIPLES = "with tr as (select concat('c', cast(c_custkey as varchar(20))) as s, 'name' as p, c_name as o, 2 as tag from customer union all select concat('c', cast(c_custkey as varchar(20))), 'nation', concat('n', cast(c_nationkey as varchar(20))), 1 from customer union all select concat('n', cast(n_nationkey as varchar(20))), 'name', n_name, 2 from nation)"


def _triples(spark, sf):
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    code = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    row = lambda t, s, p, o, tag: t.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(tag).alias("tag"))
    named = row(c, code("c", "c_custkey"), "name", F.col("c_name"), 2).unionByName(row(n, code("n", "n_nationkey"), "name", F.col("n_name"), 2))
    return named.unionByName(row(c, code("c", "c_custkey"), "nation", code("n", "c_nationkey"), 1))


@query(f"{_TRIPLES} select s, p, o, tag from tr where s = 'c7'")
def triples_by_subject(spark, sf):
    return triples.by_subject(_triples(spark, sf), "c7")


@query(f"{_TRIPLES} select s, p from tr where tag = 1 and o = 'n3'")
def triples_by_target(spark, sf):
    return triples.by_target(_triples(spark, sf), "n3").select("s", "p")


@query(f"{_TRIPLES} select s, o from tr where tag = 2 and p = 'name' and starts_with(upper(o), 'CUSTOMER#00000001')")
def triples_by_text_prefix(spark, sf):
    return triples.by_text_prefix(_triples(spark, sf), "name", "Customer#00000001").select("s", "o")


@query(
    f"{_TRIPLES}, st as (select p as x from tr union select s from tr union select o from tr where tag = 1), d as (select x, row_number() over (order by x) - 1 as code from st) select a.code as s, b.code as p, tr.tag, c.code as iri, case when tr.tag = 2 then tr.o end as str from tr join d a on a.x = tr.s join d b on b.x = tr.p left join d c on tr.tag = 1 and c.x = tr.o"
)
def triples_encode(spark, sf):
    t = _triples(spark, sf)
    strings = t.select(F.explode(F.array_compact(F.array("s", "p", F.when(F.col("tag") == 1, F.col("o"))))).alias("x"))
    return triples.encode(t, names.encode_table(strings, "x", "x"))


@query(
    "select c.c_custkey, o.o_orderkey, p.p_name from customer c join orders o on o.o_custkey = c.c_custkey join lineitem l on l.l_orderkey = o.o_orderkey join part p on p.p_partkey = l.l_partkey"
)
def two_hop(spark, sf):
    c, o, line, p = (_t(spark, sf, n) for n in ("customer", "orders", "lineitem", "part"))
    middle = graph.two_hops(c, o, line, c["c_custkey"] == o["o_custkey"], o["o_orderkey"] == line["l_orderkey"])
    return middle.join(p, line["l_partkey"] == p["p_partkey"]).select("c_custkey", "o_orderkey", "p_name")


# linked records, ingest, classes, partitions


@query("select o_custkey as target, 'customer' as pred, count(*) as n_sources, min(o_orderkey) as first_source from orders group by o_custkey")
def inverse_links(spark, sf):
    return graph.inverse(_t(spark, sf, "orders"), "o_custkey", "o_orderkey", F.lit("customer"))


@query(
    "with rec as (select concat('p', cast(p_partkey as varchar(20))) as id, 'part' as tp, p_name as name, cast(null as varchar(20)) as ref from part union all select concat('a', cast(p_partkey as varchar(20))), 'naming', concat('alias ', p_name), concat('p', cast(p_partkey as varchar(20))) from part) select distinct coalesce(r2.id, r.id) as id from rec r left join rec r2 on r.tp = 'naming' and r.ref = r2.id where starts_with(upper(r.name), 'ALIAS SMALL')"
)
def name_search_indirect(spark, sf):
    p = _t(spark, sf, "part")
    pid = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    plain = p.select(pid.alias("id"), F.lit("part").alias("tp"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("ref"))
    alias = p.select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("id"), F.lit("naming").alias("tp"), F.concat(F.lit("alias "), F.col("p_name")).alias("name"), pid.alias("ref"))
    rec = plain.unionByName(alias)
    return graph.resolve_aliases(lookup.by_prefix(rec, "name", "alias small"), "id", "tp", "naming", "ref", rec)


@query(
    "select user_id, event_id from (select *, row_number() over (partition by user_id order by coalesce(case when event_id % 3 = 0 then null else ts end, timestamp '0001-01-01 00:00:00') desc, event_id) as rn from events) t where rn = 1"
)
def last_definition(spark, sf):
    return ingest.last_definition(_t(spark, sf, "events"), "user_id", F.when(F.col("event_id") % 3 != 0, F.col("ts")), "event_id", ["event_id"])


@query("select e.event_id, e.user_id from events e left join (select distinct user_id from events where event_type = 'error') d on e.user_id = d.user_id where d.user_id is null")
def delete_wins(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ingest.without_deleted(e, "user_id", e.where("event_type = 'error'"), "user_id").select("event_id", "user_id")


@query(
    "with l as (select distinct l_orderkey, l_partkey from lineitem) select l_orderkey, case when p_partkey is not null then l_partkey + 1 else l_partkey end as link from l left join part on p_partkey = l_partkey"
)
def redirect_links(spark, sf):
    x = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("link")).distinct()
    ends = _t(spark, sf, "part").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") + 1).alias("new_id"))
    return ingest.redirect(x, "link", ends)


@query(
    "select 'removed' as side, k from (select l_partkey as k from lineitem except select p_partkey from part) t union all select 'appeared' as side, k from (select p_partkey as k from part except select l_partkey from lineitem) u"
)
def link_diff(spark, sf):
    return graph.link_changes(_t(spark, sf, "lineitem").select("l_partkey"), _t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")


@query(
    "with recursive c(id, parent) as (select concat('r', cast(r_regionkey as varchar(20))), 'root' from region union all select concat('n', cast(n_nationkey as varchar(20))), concat('r', cast(n_regionkey as varchar(20))) from nation), d(anc, id) as (select id, id from c union all select d.anc, c.id from d join c on c.parent = d.id) select anc, count(*) as n from d group by anc"
)
def class_descendants(spark, sf):
    code = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    r = _t(spark, sf, "region").select(code("r", "r_regionkey").alias("id"), F.lit("root").alias("parent"))
    n = _t(spark, sf, "nation").select(code("n", "n_nationkey").alias("id"), code("r", "n_regionkey").alias("parent"))
    return classes.descendant_counts(r.unionByName(n), "id", "parent")


@query(
    "select o_orderkey, concat(substring(d, 1, 4), case substring(d, 6, 2) when '01' then 'jan' when '02' then 'feb' else substring(d, 6, 2) end, substring(d, 9, 2)) as label from (select o_orderkey, cast(cast(o_orderdate as date) as varchar(10)) as d from orders) t"
)
def smart_date(spark, sf):
    d = F.col("o_orderdate").cast("date").cast("string")
    return _t(spark, sf, "orders").select("o_orderkey", labels.partial_date(d, {"01": "jan", "02": "feb"}).alias("label"))


@query("select o_orderkey % 10 as section, count(*) as n from orders group by 1")
def partition_route(spark, sf):
    return _t(spark, sf, "orders").groupBy(partitions.section("o_orderkey", 10).alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("select r.l_orderkey, r.l_linenumber, o.o_custkey from lineitem r join orders o on o.o_orderkey = r.l_orderkey where r.l_partkey = 55")
def ext_key_lookup(spark, sf):
    ext = partitions.secondary(_t(spark, sf, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"])
    o = _t(spark, sf, "orders")
    return lookup.by_key(ext, "l_partkey", 55).join(o, F.col("l_orderkey") == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_custkey")


@query("select user_id, max(event_id) as off from events group by user_id")
def static_index_dedup(spark, sf):
    return partitions.latest_offset(_t(spark, sf, "events"), "user_id", "event_id")


# more of the log, codes, properties and the record graph over the record log


@query("select s_suppkey, 25 + row_number() over (order by s_suppkey) - 1 as pos from supplier")
def append_positions(spark, sf):
    base = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("pos"))
    return log.append(base, _t(spark, sf, "supplier").select("s_suppkey"), "pos", ["s_suppkey"]).select("s_suppkey", "pos")


@query("select event_id, user_id from events where event_id >= 300 and event_id < 340")
def values_between(spark, sf):
    return log.between(_t(spark, sf, "events").select("event_id", "user_id"), "event_id", 300, 40)


@query("select o_orderkey from orders where not (o_orderstatus = 'F')")
def flagged_rows_hidden(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("deleted"))
    return log.without_flagged(o, "deleted").select("o_orderkey")


@query("select o_orderkey, o_custkey from orders where o_totalprice > 100000 and o_custkey = 7")
def partial_index(spark, sf):
    applicable = _t(spark, sf, "orders").where("o_totalprice > 100000")
    return lookup.by_key(applicable, "o_custkey", 7).select("o_orderkey", "o_custkey")


_HASH = "list_reduce(list_concat([cast(0 as bigint)], list_transform(range(1, length(p_name) + 1), lambda i: cast(ord(p_name[i]) % 256 as bigint))), lambda h, c: (((h + c) % 4294967296) - ((((h + c) % 4294967296) * 8192 % 4294967296) | (((h + c) % 4294967296) // 524288)) + 4294967296) % 4294967296)"


@query(f"select p_partkey, cast(case when h >= 2147483648 then h - 4294967296 else h end as integer) as code from (select p_partkey, {_HASH} as h from part) t")
def string_hash(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", hashes.low_byte_hash("p_name").alias("code"))


@query(f"select count(*) as n_rows, count(distinct {_HASH}) as n_codes, count(distinct p_name) as n_keys from part")
def hash_collisions(spark, sf):
    return log.collisions(_t(spark, sf, "part"), hashes.low_byte_hash("p_name"), "p_name")


@query("select domain_of as tp, about as prop, row_number() over (partition by domain_of order by priority nulls last, about) - 1 as pos, count(*) over (partition by domain_of) as total from onto_props")
def prop_positions(spark, sf):
    return classes.positions(_t(spark, sf, "onto_props"))


def _records(spark, sf):
    """The current records with clean ids, names and links."""
    from amberlog.functions.names import key_of, local_lower
    from amberlog.operators.changes import current_state

    clean = F.transform(
        "props",
        lambda e: F.struct(
            e["tag"].alias("tag"), local_lower(e["prop"]).alias("prop"), e["value"].alias("value"), e["lang"].alias("lang"), key_of(e["link"]).alias("link"), key_of(e["sourcelink"]).alias("sourcelink")
        ),
    )
    return current_state(_t(spark, sf, "rrecord_log")).select(F.col("__key").alias("id"), local_lower("tp").alias("tp"), clean.alias("props"))


_RECORDS = (
    problems.STATE
    + f", rec as (select w.k as id, w.tp, l.props from winner w join rrecord_log l on l.seq = w.seq where w.tp <> 'delete'), entry as (select id, tp, unnest(props) as e from rec), link as (select id, tp, lower({problems.local_sql('e.prop')}) as prop, {problems.key_sql('e.link')} as target from entry where e.tag = 2), field as (select id, tp, lower({problems.local_sql('e.prop')}) as prop, e.value, e.lang from entry where e.tag = 1)"
)


@query(f"{_RECORDS} select target, prop as pred, count(*) as n_sources, min(id) as first_source from link where target <> '' group by 1, 2")
def record_inverse_links(spark, sf):
    return graph.inverse(graph.links(_records(spark, sf)), "target", "id", F.col("prop"))


@query(f"{_RECORDS} select l.id, l.prop, l.target, r.tp as target_tp from link l join rec r on r.id = l.target where l.tp = 'naming'")
def record_portraits(spark, sf):
    r = _records(spark, sf)
    return graph.portrait(r, r.where("tp = 'naming'"))


@query(
    f"{_RECORDS}, hit as (select distinct id, tp from field where prop in ('name', 'alias') and starts_with(upper(value), 'BA')), ref as (select l.id, l.target from link l join rec r on r.id = l.target where l.tp = 'naming' and l.prop = 'referred-sys') select distinct coalesce(f.target, h.id) as id from hit h left join ref f on f.id = h.id"
)
def record_name_search(spark, sf):
    r = _records(spark, sf)
    named = graph.fields(r).where(F.col("prop").isin("name", "alias"))
    hits = lookup.by_prefix(named, "value", "ba").select("id", "tp").distinct()
    refs = graph.links(r).where("prop = 'referred-sys'").select(F.col("id").alias("r_id"), F.col("target").alias("ref"))
    x = hits.join(refs, (F.col("id") == F.col("r_id")) & (F.col("tp") == "naming"), "left").select("id", "tp", "ref")
    return graph.resolve_aliases(x, "id", "tp", "naming", "ref", r)


@query(
    f"{_RECORDS} select p.id as root, '' as path, 0 as level, p.id, p.prop, p.value from field p where p.tp = 'person' and p.prop = 'name' union all select p.id, '/^reflected/in-doc', 2, f.id, f.prop, f.value from rec p join link a on a.target = p.id and a.prop = 'reflected' join link b on b.id = a.id and b.prop = 'in-doc' join field f on f.id = b.target and f.prop = 'uri' where p.tp = 'person'"
)
def record_trees(spark, sf):
    r = _records(spark, sf)
    shape = graph.Template(fields=("name",), inverse={"reflected": graph.Template(fields=("none",), direct={"in-doc": graph.Template(fields=("uri",))})})
    return graph.tree(r.where("tp = 'person'"), r, shape).select("root", "path", "level", "id", "prop", "value")


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _ALL.items() if s}
