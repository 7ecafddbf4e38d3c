"""More queries of the engine's own operators: value forms, tables with indexes, names, records, trees, edits, files and streams, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberlog.functions import hashes, labels, places
from amberlog.operators import classes, edits, graph, histogram, ingest, log, lookup, names, partitions, triples, words
from amberlog.operators.table import Index, Table
from amberlog.plans import problems, scratch
from amberlog.plans.catalogue import _RECORDS, _TRIPLES, _records, _t, _triples, query
from amberlog.sources import binary_form, files, record_xml, text_form, typed
from amberlog.sources.typed import INTEGER, LONG, REAL, STRING, record, sequence, spark_type, text_column, union
from amberlog.streaming import append

# forms of values, over whole tables

PART = record(id=LONG, name=STRING, size=INTEGER, price=REAL)
EVENT = record(id=LONG, props=STRING)
_PART_SQL = "select p_partkey as id, p_name as name, p_size as size, p_retailprice as price from part"


def _part(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def _each(rows: DataFrame, kind: typed.Kind, change, schema: str) -> DataFrame:
    """A function of every record, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([change(typed.from_spark(r, kind)) for r in f.itertuples(index=False)], columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


_PART_SCHEMA = "id bigint, name string, size int, price double"


@query(_PART_SQL)
def text_round_trip(spark, sf):
    return _each(_part(spark, sf), PART, lambda v: text_form.read(text_form.write(v, PART), PART), _PART_SCHEMA)


@query("select event_id as id, props from events")
def string_literals(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_id").alias("id"), "props")
    return _each(e, EVENT, lambda v: text_form.read(text_form.write(v, EVENT), EVENT), "id bigint, props string")


@query(_PART_SQL)
def binary_round_trip(spark, sf):
    def run(frames):
        for f in frames:
            yield pd.DataFrame([binary_form.read(bytes(b), PART) for b in f["content"]], columns=["id", "name", "size", "price"])

    return files.binary_column(_part(spark, sf), PART).mapInPandas(run, spark_type(PART))


@query(_PART_SQL)
def text_sequence_files(spark, sf):
    path = scratch.new_folder(spark, "sequences")
    files.write_sequences(_part(spark, sf).repartition(3, "id"), PART, path)
    return files.read_text(spark, path, PART)


_REAL_SQL = "regexp_replace(cast(p_retailprice as varchar), '\\.0$', '')"


@query(f"select p_partkey as id, concat('{{id:', p_partkey, ',name:\"', p_name, '\",size:', p_size, ',price:', {_REAL_SQL}, '}}') as txt from part")
def readable_values(spark, sf):
    return _each(_part(spark, sf), PART, lambda v: (v[0], typed.readable(v, PART, names=True)), "id bigint, txt string")


@query("select p_partkey as id, concat('{', chr(10), '    ', p_partkey, ',', chr(10), '    [', chr(10), '        \"', p_name, '\",', chr(10), '        \"', p_brand, '\"', chr(10), '    ]', chr(10), '}') as txt from part")
def pretty_values(spark, sf):
    kind = record(id=LONG, texts=sequence(STRING))
    rows = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_brand").alias("texts"))
    return _each(rows, kind, lambda v: (v[0], text_form.write_pretty(v, kind)), "id bigint, txt string")


@query("select p_partkey, case when p_size > 25 then concat('1^\"', p_name, '\"') else concat('0^', p_size) end as txt from part")
def union_values(spark, sf):
    large = F.col("p_size") > 25
    value = F.struct(large.cast("int").alias("tag"), F.when(~large, F.col("p_size")).alias("small"), F.when(large, F.col("p_name")).alias("large"))
    return _t(spark, sf, "part").select("p_partkey", text_column(value, union(small=INTEGER, large=STRING)).alias("txt"))


# codes, histograms, labels

_CODE = " + ".join(f"greatest(strpos('{hashes.ALPHABET.replace(chr(39), chr(39) * 2)}', substr(rpad(upper(p_name), cast(greatest(length(p_name), 4) as integer), ' '), {i + 1}, 1)) - 1, 0) * {128 ** (3 - i)}" for i in range(4))


@query(f"select p_partkey, cast({_CODE} as integer) as code from part")
def first_four_code(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", hashes.first4_code("p_name").alias("code"))


@query(
    "with k as (select cast(o_custkey as bigint) as key from orders), m as (select min(key) as mn, max(key) as mx, cast(floor(count(*) / 32) as bigint) as n from k), b as (select cast(floor((k.key - m.mn) * (m.n - 1) / (m.mx - m.mn)) as bigint) as pos, count(*) as c from k cross join m group by 1) select pos, c, sum(c) over (order by pos) - c as start from b"
)
def scale_of_32(spark, sf):
    return histogram.histogram(_t(spark, sf, "orders").select("o_custkey"), "o_custkey", per_bucket=32)


_MONTH = "case substring(d, 6, 2) " + " ".join(f"when '{i + 1:02d}' then '{m}'" for i, m in enumerate(labels.MONTHS)) + " end"


@query(f"with x as (select o_orderkey, o_orderstatus, cast(cast(o_orderdate as date) as varchar) as d from orders) select o_orderkey, concat(substring(d, 1, 4), {_MONTH}, substring(d, 9, 2), case when o_orderstatus = 'O' then '' else concat('-', substring(d, 1, 4), {_MONTH}, substring(d, 9, 2)) end) as label from x")
def date_ranges(spark, sf):
    d = F.col("o_orderdate").cast("date").cast("string")
    return _t(spark, sf, "orders").select("o_orderkey", labels.date_range(d, F.when(F.col("o_orderstatus") != "O", d)).alias("label"))


@query("select p_partkey, 'http://x.example/' || p_brand || '#' as namespace, replace(p_name, ' ', '-') as name from part")
def split_names(spark, sf):
    iri = F.concat(F.lit("http://x.example/"), "p_brand", F.lit("#"), F.translate("p_name", " ", "-"))
    return _t(spark, sf, "part").select("p_partkey", labels.split_name(iri).alias("n")).select("p_partkey", "n.*")


@query("select p_partkey, concat('/stores/a/documents/small', right(lpad(cast(p_partkey as varchar), 10, '0'), 10)) as path from part")
def document_paths(spark, sf):
    uri = F.concat(F.lit("store://Name@host/0001/"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    return _t(spark, sf, "part").select("p_partkey", places.file_path(uri, F.lit("/stores/a"), "small").alias("path"))


# the log: order, positions, parts, sections

_NEWEST = "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) t where rn = 1"


@query("select event_id, user_id from events")
def scan_in_order(spark, sf):
    return log.stored_order(_t(spark, sf, "events").select("event_id", "user_id"), "event_id")


@query("select n_nationkey, coalesce(r_name, n_name) as n_name, n_regionkey from nation left join region on r_regionkey = n_nationkey")
def overwrite_positions(spark, sf):
    changes = _t(spark, sf, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return log.overwritten(_t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", changes)


@query("select event_id, user_id, event_type from events where event_id = 77")
def value_at_position(spark, sf):
    return log.at(_t(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id", 77)


@query(f"{_NEWEST} and event_type <> 'error'")
def compacted(spark, sf):
    path = scratch.new_folder(spark, "compacted")
    log.compact(_t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], F.col("event_type") == "error", path)
    return spark.read.parquet(path)


@query("select event_id, event_type from events where event_id >= 5000 and starts_with(upper(event_type), 'CL')")
def prefix_over_delta(spark, sf):
    return lookup.by_prefix(log.replay(_t(spark, sf, "events").select("event_id", "event_type"), "event_id", 5000), "event_type", "cl")


@query("select event_id, event_type from events where user_id = 13")
def versions_by_key(spark, sf):
    return Table(_t(spark, sf, "events").select("event_id", "event_type", "user_id"), "user_id", ["event_id"]).versions(13).select("event_id", "event_type")


def _people(spark, sf) -> Table:
    e = _t(spark, sf, "events").select("user_id", "event_id", "event_type", "props")
    return Table(e, "user_id", ["event_id"], F.col("event_type") == "error", (Index(F.col("event_type")), Index(F.col("event_type"), "ordered", ignore_case=True), Index(F.split("props", '[":{} ]+'))))


@query(f"with cur as ({_NEWEST} and event_type <> 'error') select 'key' as by, user_id, event_id from cur where user_id = 13 union all select 'value', user_id, event_id from cur where event_type = 'click' union all select 'prefix', user_id, event_id from cur where starts_with(upper(event_type), 'S')")
def table_with_indexes(spark, sf):
    t = _people(spark, sf)
    t.build(scratch.new_folder(spark, "indexes"), buckets=8)
    by = lambda name, rows: rows.select(F.lit(name).alias("by"), "user_id", "event_id")
    return by("key", t.get(13)).unionByName(by("value", t.all_using(0, "click"))).unionByName(by("prefix", t.like_using(1, "s")))


@query("select doc_id, count(*) as n from (select doc_id, unnest(regexp_split_to_array(lower(text), '[ \n\t,.:!?\"''=\\\\|/()\\[\\]{};*<>-]+')) as w from documents) t where w = 'and' group by doc_id")
def built_word_index(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    t = Table(docs, "doc_id", ["doc_id"], None, (Index(words.words("text")),))
    t.build(scratch.new_folder(spark, "words"), buckets=8)
    return t.all_using(0, "and").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_custkey from orders where o_orderkey = 77")
def routed_lookup(spark, sf):
    path = scratch.new_folder(spark, "sections")
    partitions.write_sections(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 10, path)
    return partitions.read_key(spark, path, "o_orderkey", 77, 10)


@query("select o_orderkey, o_custkey from orders where o_custkey = 7")
def appended_secondary(spark, sf):
    path = scratch.new_folder(spark, "appended")
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for status in (F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F"):
        partitions.append_rows(o.where(status).drop("o_orderstatus"), "o_orderkey", 8, path, ("o_custkey",))
    return partitions.by_secondary(spark, path, "o_orderkey", "o_custkey", 7, 8)


@query("select (o_orderkey % 6) % 3 as node, count(*) as n from orders group by 1")
def sections_of_nodes(spark, sf):
    _, sections = partitions.configuration(spark, {"customer": [], "orders": ["o_custkey"]}, nodes=3, sections=6)
    return partitions.routed(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1, sections).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


# streams


def _stream(spark, sf) -> DataFrame:
    return spark.readStream.schema(_t(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet").select("event_id", "user_id")


@query("select event_id, user_id from events")
def stream_to_log(spark, sf):
    path, checkpoint = scratch.new_folder(spark, "stream"), scratch.new_folder(spark, "stream-checkpoint")
    append.append_stream(_stream(spark, sf), path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


@query("select event_id, user_id from events")
def stream_in_batches(spark, sf):
    path, checkpoint = scratch.new_folder(spark, "batches"), scratch.new_folder(spark, "batches-checkpoint")
    append.in_batches(_stream(spark, sf), lambda batch: batch.write.mode("append").parquet(path), checkpoint).awaitTermination()
    return spark.read.parquet(path)


# names and triples


@query("select event_id, event_type from events")
def names_decoded(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "event_type")
    table = names.encode_table(e, "event_type", "event_id")
    coded = names.codes_of(e, "event_type", table, "code").select("event_id", "code")
    return names.strings_of(coded, "code", table, "event_type").select("event_id", "event_type")


@query("with a as (select c_mktsegment as s, row_number() over (order by c_mktsegment) - 1 as code from (select distinct c_mktsegment from customer) x) select s, code from a union all select s, (select count(*) from a) + row_number() over (order by s) - 1 from (select distinct p_brand as s from part where p_brand not in (select s from a)) y")
def names_extended(spark, sf):
    first = names.encode_table(_t(spark, sf, "customer"), "c_mktsegment", "c_mktsegment")
    return names.extend(first, _t(spark, sf, "part").select("p_brand"), "p_brand", "p_brand")


@query(f"{_TRIPLES} select s as id, count(*) filter (where tag = 1) as n_directs, count(*) filter (where tag = 2) as n_fields from tr group by s")
def triple_records(spark, sf):
    return triples.records(_triples(spark, sf)).select("id", F.size("directs").cast("bigint").alias("n_directs"), F.size("fields").cast("bigint").alias("n_fields"))


@query(f"{_TRIPLES} select s as id, o as name from tr where p = 'name' and s in (select s from tr where tag = 1 and o = 'n3')")
def triple_records_that_refer(spark, sf):
    return triples.first_field(triples.refers(triples.records(_triples(spark, sf)), "n3"), "name", "name").select("id", "name")


@query(f"{_TRIPLES} select s as id, o as name from tr where p = 'name' and starts_with(upper(o), 'CUSTOMER#00000002')")
def triple_records_by_name(spark, sf):
    named = triples.first_field(triples.records(_triples(spark, sf)), "name", "name").select("id", "name")
    return lookup.by_prefix(named, "name", "Customer#00000002")


@query(f"{_TRIPLES} select s as id, case when starts_with(s, 'n') then 'changed' else o end as name from tr where p = 'name'")
def triple_records_replaced(spark, sf):
    r = triples.records(_triples(spark, sf))
    changed = r.where("id like 'n%'").withColumn("fields", F.transform("fields", lambda f: f.withField("value", F.lit("changed"))))
    return triples.first_field(triples.replace(r, changed, F.lit(False)), "name", "name").select("id", "name")


@query(
    f"{_TRIPLES}, st as (select p as x from tr union select s from tr union select o from tr where tag = 1), d as (select x, row_number() over (order by x) - 1 as code from st) select a.code as id, b.code as prop, c.code as entity from tr join d a on a.x = tr.s join d b on b.x = tr.p join d c on c.x = tr.o where tr.tag = 1"
)
def triple_records_encoded(spark, sf):
    t = _triples(spark, sf)
    table = names.encode_table(t.select(F.explode(F.array_compact(F.array("s", "p", F.when(F.col("tag") == 1, F.col("o"))))).alias("x")), "x", "x")
    return triples.encode_records(triples.records(t), table).select("id", F.explode("directs").alias("d")).select("id", "d.*")


# records


@query(f"{_RECORDS} select id, cast(len(list_filter(props, lambda x: x.tag <> 3)) as integer) as n from rec where props is not null")
def records_without_inverse(spark, sf):
    return _records(spark, sf).where("props is not null").select("id", F.size(F.filter("props", lambda e: e["tag"] != 3)).alias("n"))


@query(f"{_RECORDS}, back as (select target, count(*) as n from link join rec on rec.id = link.target group by target) select rec.id, coalesce(len(props), 0) + coalesce(n, 0) as n from rec left join back on back.target = rec.id")
def records_with_inverse(spark, sf):
    return graph.with_inverse_entries(_records(spark, sf)).groupBy("id").agg(F.sum(F.size("props")).alias("n"))


@query(f"{_RECORDS}, root as (select id from rec where tp = 'naming') select l.id as root, 1 as level, 'direct' as direction, l.prop, r.id, r.tp from link l join root on root.id = l.id join rec r on r.id = l.target union all select l.target, 2, 'inverse', l.prop, r.id, r.tp from link l join root on root.id = l.target join rec r on r.id = l.id")
def record_generic_trees(spark, sf):
    r = _records(spark, sf)
    return graph.generic_tree(r.where("tp = 'naming'"), r)


_PLAIN = f"""{_RECORDS}, root as (select id from rec where tp = 'person'), step as (select id as a, prop as p, target as b from link where target <> ''),
near as (select root.id as root, step.b as id, '/' || p as path, cast(null as varchar) as back from root join step on step.a = root.id union all select root.id, step.a, '/^' || p, p from root join step on step.b = root.id),
node as (select id as root, id, '' as path, 0 as level, cast(null as varchar) as back from root union all select root, id, path, 1, back from near union all select n.root, s.b, n.path || '/' || s.p, 2, null from near n join step s on s.a = n.id where n.back is null or s.p <> n.back)
select n.root, n.path, n.level, n.id, f.prop, f.value, cast(null as varchar) as target from node n join field f on f.id = n.id
union all select n.root, n.path, n.level, n.id, l.prop, null, l.target from node n join link l on l.id = n.id where l.target <> '' and n.level < 2 and (n.back is null or l.prop <> n.back)"""


@query(_PLAIN)
def record_plain_trees(spark, sf):
    r = _records(spark, sf)
    return graph.plain_tree(r.where("tp = 'person'"), r).select("root", "path", "level", "id", "prop", "value", "target")


#: The classes that the declared properties of the test tables speak of: (class, parent).
_TREE = (("entity", None), ("sys-obj", "entity"), ("person", "sys-obj"), ("document", "sys-obj"), ("photo-doc", "document"), ("collection", "sys-obj"), ("reflection", "entity"), ("naming", "entity"), ("collection-member", "entity"))
_TREE_SQL = "with recursive cls(id, parent) as (values " + ", ".join(f"('{a}', {'null' if b is None else repr(b)})" for a, b in _TREE) + "), anc(anc, id) as (select id, id from cls union all select c.parent, a.id from anc a join cls c on c.id = a.anc where c.parent is not null)"


def _ancestors(spark) -> DataFrame:
    return classes.with_self(classes.tree_of(spark.createDataFrame(_TREE, "id string, parent string"), "id", "parent"))


@query(f"{_TREE_SQL} select distinct anc.id as tp, o.about as prop from anc join onto_props o on o.domain_of = anc.anc")
def props_by_type(spark, sf):
    return classes.inherited(_ancestors(spark), _t(spark, sf, "onto_props").select(F.col("about").alias("prop"), F.col("domain_of").alias("cls")))


@query(f"{_TREE_SQL} select anc.id as tp, o.about as prop, cast(row_number() over (partition by anc.id order by o.priority nulls last, o.about) - 1 as integer) as pos from anc join onto_props o on o.domain_of = anc.anc")
def direct_properties(spark, sf):
    return classes.direct_props(_ancestors(spark), _t(spark, sf, "onto_props"))


@query(f"{_TREE_SQL}, op as (select about, domain_of, priority from onto_props where kind = 'ObjectProperty') select anc.id as tp, op.about as prop, cast(row_number() over (partition by anc.id order by op.priority nulls last, op.about) - 1 as integer) as pos from anc join op on op.domain_of = anc.anc")
def inverse_properties(spark, sf):
    # the ranges of the test tables are all iri, so the classes of the domains stand in for them
    declared = _t(spark, sf, "onto_props").withColumn("range_of", F.col("domain_of"))
    return classes.inverse_props(_ancestors(spark), declared)


@query("select 'father' as prop, domain_of as domain, range_of as range from onto_props where about = 'father'")
def domains_and_ranges(spark, sf):
    p = _t(spark, sf, "onto_props")
    return classes.domains(p, "father").select(F.lit("father").alias("prop"), F.col("tp").alias("domain")).crossJoin(classes.ranges(p, "father").select(F.col("tp").alias("range")))


_SHAPE = graph.Template(
    fields=("name",),
    inverse={"reflected": graph.Template(fields=("ground",), types=("reflection",), direct={"in-doc": (graph.Template(fields=("uri",), types=("photo-doc",)), graph.Template(fields=("name",), types=("document",)))})},
)


@query(
    f"{_RECORDS}, kind(tp, k) as (values ('photo-doc', 'uri'), ('document', 'name')) select p.id as root, '' as path, 0 as level, p.id, p.prop, p.value from field p where p.tp = 'person' and p.prop = 'name' union all select p.id, '/^reflected', 1, f.id, f.prop, f.value from rec p join link a on a.target = p.id and a.prop = 'reflected' and a.tp = 'reflection' join field f on f.id = a.id and f.prop = 'ground' where p.tp = 'person' union all select p.id, '/^reflected/in-doc', 2, f.id, f.prop, f.value from rec p join link a on a.target = p.id and a.prop = 'reflected' and a.tp = 'reflection' join link b on b.id = a.id and b.prop = 'in-doc' join field f on f.id = b.target join kind on kind.tp = f.tp and kind.k = f.prop where p.tp = 'person'"
)
def record_typed_trees(spark, sf):
    r = _records(spark, sf)
    return graph.tree(r.where("tp = 'person'"), r, _SHAPE, _ancestors(spark)).select("root", "path", "level", "id", "prop", "value")


@query(f"{_RECORDS} select f.id, f.prop, f.value from field f join onto_props o on o.about = f.prop and o.kind = 'DatatypeProperty' and o.domain_of in ('collection', 'sys-obj', 'entity') where f.id = 'cassetterootcollection' and f.tp = 'collection'")
def portrait_in_one_call(spark, sf):
    t = classes.portrait_tree("cassetterootcollection", _records(spark, sf), _t(spark, sf, "onto_props"), _ancestors(spark))
    return t.where("level = 0").select("id", "prop", "value")


@query(f"{_RECORDS} select f.id, count(*) as n from (select id from field where tp = 'naming' and value is not null union all select id from link where tp = 'naming' and target <> '') f group by 1")
def trees_as_records(spark, sf):
    r = _records(spark, sf)
    ids = r.where("tp = 'naming'")
    return graph.tree_records(graph.tree(ids, r, graph.Template()), r, ids).select("id", F.size("props").cast("bigint").alias("n"))


@query(
    f"{_RECORDS} select id, list_filter(props, lambda x: x.tag = 1 and lower({problems.local_sql('x.prop')}) = 'name')[1].value as name, coalesce(list_filter(props, lambda x: x.tag = 1 and lower({problems.local_sql('x.prop')}) = 'name' and x.lang = 'ru')[1].value, list_filter(props, lambda x: x.tag = 1 and lower({problems.local_sql('x.prop')}) = 'name')[-1].value) as ru, {problems.key_sql('l')} as father from (select id, props, list_filter(props, lambda x: x.tag = 2 and lower(" + problems.local_sql("x.prop") + ") = 'father')[1].link as l, list_filter(props, lambda x: x.tag = 2 and lower(" + problems.local_sql("x.prop") + ") = 'father') as fs from rec where tp = 'person') t"
)
def record_accessors(spark, sf):
    p = F.col("props")
    return _records(spark, sf).where("tp = 'person'").select("id", graph.field_of(p, "name").alias("name"), graph.text_of(p, "name").alias("ru"), F.coalesce(graph.link_of(p, "father"), F.lit("")).alias("father"))


@query(f"{_RECORDS}, n as (select id, list_filter(props, lambda x: x.tag = 1 and lower({problems.local_sql('x.prop')}) = 'name') as ns from rec where tp = 'person') select id, coalesce(list_filter(ns, lambda x: x.lang = 'en')[1].value, case when coalesce(ns[1].lang, 'ru') = 'en' then ns[1].value when ns[1].value is not null then concat(ns[1].value, ' (', coalesce(ns[1].lang, 'ru'), ')') end) as name from n")
def names_in_a_language(spark, sf):
    return _records(spark, sf).where("tp = 'person'").select("id", graph.name_in(F.col("props"), "en").alias("name"))


@query(f"{_RECORDS} select id, case when len(props) > 0 then 'set' end as first from rec where tp = 'person' and props is not null")
def nested_value_set(spark, sf):
    r = _records(spark, sf).where("tp = 'person' and props is not null")
    return r.select("id", F.get(graph.with_entry(F.col("props"), 0, value=F.lit("set")), F.lit(0))["value"].alias("first"))


# edits and ingest


@query("select o_orderkey, o_orderstatus, case when o_orderstatus = 'F' then 'finished' when o_orderstatus = 'O' then 'offen' end as label from orders")
def enumerated_values(spark, sf):
    states = spark.createDataFrame([("F", "en", "finished"), ("F", "de", "fertig"), ("O", "de", "offen")], "value string, lang string, label string")
    return classes.enumerated(_t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", states, "en", fallback="de").select("o_orderkey", "o_orderstatus", "label")


@query("select distinct o.about, case when o.about = 'name' then 'Name' else o.about end as label from onto_props o")
def property_labels(spark, sf):
    named = spark.createDataFrame([("name", "en", "Name", False), ("name", "de", "Bezeichnung", False), ("father", "en", "child", True)], "about string, lang string, label string, inverse boolean")
    return classes.labels(_t(spark, sf, "onto_props"), named, "en")


_EDIT = "id string, tp string, mt string, props " + record_xml.ENTRIES


def _as_records(spark, sf) -> DataFrame:
    c = _t(spark, sf, "customer")
    none = F.lit(None).cast("string")
    entry = lambda tag, prop, value, link: F.struct(F.lit(tag).alias("tag"), F.lit(prop).alias("prop"), value.alias("value"), none.alias("lang"), link.alias("link"), none.alias("sourcelink"))
    props = F.array(entry(1, "name", F.col("c_name"), none), entry(2, "nation", none, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))))
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("customer").alias("tp"), F.lit("2020-01-01").alias("mt"), props.alias("props"))


@query("select concat('new', row_number() over (order by c_custkey) + 9) as id, count(*) over () as n from customer")
def new_ids(spark, sf):
    rows = _as_records(spark, sf).withColumn("id", F.lit(None).cast("string")).withColumn("by", F.monotonically_increasing_id())
    out, following = edits.stamped(rows, "new", 10, "2021-01-01", ["by"])
    return out.select("id", F.lit(following - 10).cast("bigint").alias("n"))


@query("select concat('c', c_custkey) as id, case when c_acctbal < 0 then 0 else 1 end as there from customer")
def deletions_as_rows(spark, sf):
    r, c = _as_records(spark, sf).withColumn("seq", F.lit(0)), _t(spark, sf, "customer").where("c_acctbal < 0")
    gone = edits.deletion(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")), r, "2021-01-01").withColumn("seq", F.lit(1))
    last = log.newest(r.unionByName(gone), "id", ["seq"], ["id", "seq", "tp"])
    return last.select("id", F.when(F.col("tp") == "delete", 0).otherwise(1).alias("there"))


@query("select count(*) * 2 as n, (select count(*) from customer) * 2 - 1 as last from customer")
def records_put(spark, sf):
    base = lookup.ranked(_as_records(spark, sf), ["id"], "seq").withColumn("seq", F.col("seq").cast("bigint") - 1)
    after, _ = edits.put(base, _as_records(spark, sf), "seq", "2021-01-01")
    return after.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


@query("select concat('c', c_custkey) as id, 1 + case when c_nationkey < 5 then 0 else 1 end as n from customer")
def records_removed_with_links(spark, sf):
    r = _as_records(spark, sf)
    nations = _t(spark, sf, "nation").where("n_nationkey < 5").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return edits.without_records(r, nations).select("id", F.size("props").alias("n"))


@query("select concat('c', c_custkey) as id, 'customer' as tp, '2020-01-01' as mt, 'me' as owner, c_name as name, concat('n', c_nationkey) as nation from customer")
def record_files(spark, sf):
    path = scratch.new_folder(spark, "records")
    files.write_records(_as_records(spark, sf).repartition(2, "id"), path, owner="me", prefix="x", counter="5")
    rows = record_xml.read(spark, path)
    return rows.select("id", "tp", "mt", "owner", F.col("props")[0]["value"].alias("name"), F.col("props")[1]["link"].alias("nation"))


@query("select concat('c', c_custkey) as id, concat('n', case when c_nationkey = 3 then 4 else c_nationkey end) as nation from customer where c_acctbal >= 0 union all select 'seed', null")
def record_files_ingested(spark, sf):
    path = scratch.new_folder(spark, "ingested")
    files.write_records(_as_records(spark, sf).repartition(2, "id"), path)
    rows = record_xml.read(spark, path)
    shape = lambda x, kind, id_, new: x.select(F.lit("z").alias("file"), F.lit(0).cast("bigint").alias("place"), F.lit(kind).alias("kind"), id_.alias("id"), new.alias("new_id"))
    c = _t(spark, sf, "customer").where("c_acctbal < 0")
    gone = shape(c, "delete", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit(None).cast("string"))
    moved = shape(_t(spark, sf, "nation").where("n_nationkey = 3"), "substitute", F.lit("n3"), F.lit("n4"))
    all_ = rows.unionByName(gone, allowMissingColumns=True).unionByName(moved, allowMissingColumns=True)
    out = ingest.ingested(all_, F.to_timestamp("mt"), ("seed", "collection"))
    return out.select("id", F.get(F.filter("props", lambda e: e["tag"] == 2), F.lit(0))["link"].alias("nation"))


@query(
    problems._CLASSES.split(",\nup as")[0]
    + ", pair as (select k as a, p as b from last where p <> ''), walk(a, c) as (select a, b from pair union select w.a, p.b from walk w join pair p on p.a = w.c), ends as (select w.a, w.c from walk w left join pair p on p.a = w.c where p.a is null) select p.a as old_id, coalesce(e.c, p.a) as new_id from pair p left join ends e on e.a = p.a"
)
def substitute_closure(spark, sf):
    from amberlog.functions.names import class_key

    rows = _t(spark, sf, "ontology_class").select(class_key("about").alias("a"), F.nullif(class_key("subclassof"), F.lit("")).alias("b"), "def_seq").where("a <> ''")
    last = rows.groupBy("a").agg(F.max_by(F.struct("b"), "def_seq").alias("v")).select("a", "v.b").where("b is not null")
    return ingest.substitutes(last)


@query("select p_brand, p_type, count(*) as n from part where p_size > 25 group by all union all select o.p_brand, o.p_type, o.n from (select p_brand, p_type, count(*) as n from part where p_size <= 25 group by all) o left join (select distinct p_brand, p_type from part where p_size > 25) w on w.p_brand = o.p_brand and w.p_type = o.p_type where w.p_brand is null")
def update_merge(spark, sf):
    counts = lambda rows: rows.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    p = _t(spark, sf, "part")
    return graph.merge_fields(counts(p.where("p_size <= 25")), counts(p.where("p_size > 25")), ["p_brand", "p_type"])
