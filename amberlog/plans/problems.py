"""Queries of the general problems over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlog.functions.names import class_key, key_of, local_lower
from amberlog.operators import changes, hierarchy, nested, orphans, wide
from amberlog.plans import scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.newest_links(_table(spark, sf, "ontology_class"), class_key("about"), class_key("subclassof"), F.col("def_seq"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, sf), paths=False).select(F.col("name").alias("about"), "root", F.col("steps").cast("int").alias("n_steps"))


def p1_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    h = hierarchy.hierarchy(_links(spark, sf))
    return h.select(F.col("name").alias("about"), "parent", "root", "depth", F.array_join("path", "/").alias("path"), F.col("descendants").alias("n_descendants"), "in_loop")


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.closure(hierarchy.hierarchy(_links(spark, sf)))


def p1_all_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth and descendants of every class that is on no loop; below a loop they begin with the class right under it."""
    h = hierarchy.hierarchy(_links(spark, sf), below_loops=True).where("not on_loop")
    return h.select(F.col("name").alias("about"), F.col("path")[0].alias("top"), "depth", F.array_join("path", "/").alias("path"), F.col("descendants").alias("n_descendants"))


def p1_all_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of p1_descendants and those among the classes below loops."""
    return hierarchy.closure(hierarchy.hierarchy(_links(spark, sf), below_loops=True))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return changes.current_state(_table(spark, sf, "rrecord_log")).select(F.col("__key").alias("id"), "seq")


def p2_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same state from three batches of changes, in the order of the log, applied one after the other to a table in the shared folder."""
    log = _table(spark, sf, "rrecord_log")
    first, last = log.agg(F.min("seq"), F.max("seq")).first()
    table = changes.MergeOnReadTable(spark, scratch.new_folder(spark, "batches"))
    third = (last - first) // 3 + 1 if first is not None else 1
    for i in range(3):
        begin = (first or 0) + i * third
        table.apply(log.where((F.col("seq") >= begin) & (F.col("seq") < begin + third)))
    return table.read().select(key_of("id").alias("id"), "seq")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    e = nested.held(nested.label_nodes(_table(spark, sf, "fog_raw")))
    return e.select("raw_id", "entry_path", "kind", F.coalesce("holder_id", F.lit("")).alias("holder"))


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    return nested.records(nested.label_nodes(_table(spark, sf, "fog_raw")))


def p3_entries(spark: SparkSession, sf: str) -> DataFrame:
    return nested.held(nested.label_nodes(_table(spark, sf, "fog_raw")))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    log = _table(spark, sf, "rrecord_log")
    return orphans.orphans(orphans.references(log), orphans.parents(log))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("seq", "pos", "status")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf), local_lower("tp"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return wide.unclean(_table(spark, sf, "triples"), wide.discover(_table(spark, sf, "onto_props")))


def p5_wide(spark: SparkSession, sf: str) -> DataFrame:
    return wide.wide_table(_table(spark, sf, "triples"), wide.discover(_table(spark, sf, "onto_props")))


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    return wide.all_counts(_table(spark, sf, "triples"), wide.discover(_table(spark, sf, "onto_props")))


def p5_values(spark: SparkSession, sf: str) -> DataFrame:
    return wide.values(_table(spark, sf, "triples"), wide.discover(_table(spark, sf, "onto_props")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p1_all_hierarchy, p1_all_descendants, p2_found, p2_batches, p3_found, p3_records, p3_entries, p4_found, p4_report, p5_found, p5_wide, p5_counts, p5_values)}


# the same by SQL, for queries that SQL can express on whole tables


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')"


def _key(x: str) -> str:
    return _trim(f"replace(coalesce({x}, ''), '|', '')")


def local_sql(x: str) -> str:
    return _trim(f"regexp_replace({_trim(f"coalesce({x}, '')")}, '^(?:\\{{[^}}]*\\}}|[A-Za-z_][A-Za-z0-9_.-]*:)', '')")


def deletes_sql(x: str) -> str:
    return f"lower({local_sql(x)}) = 'delete'"


def key_sql(x: str) -> str:
    return _key(x)


_CLASSES = f"""with recursive raw as (select {_key(local_sql("about"))} as k, {_key(local_sql("subclassof"))} as p, def_seq from ontology_class),
last as (select k, arg_max(p, def_seq) as p from raw where k <> '' group by k),
up as (select a.k, b.k as p from last a left join last b on a.p = b.k),
reach(k, c) as (select k, k from up union select r.k, u.p from reach r join up u on u.k = r.c where u.p is not null),
tops as (select r.k, r.c as root from reach r join up u on u.k = r.c where u.p is null),
steps as (select k, count(*) - 1 as n from reach group by k)"""
_P1 = (
    _CLASSES
    + """, on_loop as (select u.k from up u join reach r on r.k = u.p and r.c = u.k)
select s.k as about, coalesce(t.root, l.root) as root, cast(case when t.root is null then -1 else s.n end as integer) as n_steps
from steps s left join tops t on t.k = s.k left join (select r.k, min(r.c) as root from reach r join on_loop o on o.k = r.c group by r.k) l on l.k = s.k"""
)
_P1_DESCENDANTS = _CLASSES + " select r.c as ancestor, r.k as descendant, a.n - b.n as distance from reach r join tops t on t.k = r.k join steps a on a.k = r.k join steps b on b.k = r.c where r.c <> r.k"
_P1_HIERARCHY = (
    _CLASSES
    + """, paths as (select r.k, string_agg(r.c, '/' order by s.n) as path from reach r join steps s on s.k = r.c group by r.k),
below as (select c, count(*) - 1 as n from reach group by c),
on_loop as (select u.k from up u join reach r on r.k = u.p and r.c = u.k), loops as (select r.k, min(r.c) as root from reach r join on_loop o on o.k = r.c group by r.k)
select s.k as about, u.p as parent, coalesce(t.root, l.root) as root, cast(case when t.root is not null then s.n end as integer) as depth, case when t.root is not null then p.path end as path,
case when t.root is not null then b.n end as n_descendants, t.root is null as in_loop
from steps s join up u on u.k = s.k left join tops t on t.k = s.k left join loops l on l.k = s.k join paths p on p.k = s.k join below b on b.c = s.k"""
)
_FREE = _CLASSES + ", on_loop as (select u.k from up u join reach r on r.k = u.p and r.c = u.k), free as (select s.k, s.n from steps s left join on_loop o on o.k = s.k where o.k is null)"
_P1_ALL_DESCENDANTS = _FREE + " select r.c as ancestor, r.k as descendant, a.n - b.n as distance from reach r join free a on a.k = r.k join free b on b.k = r.c where r.c <> r.k"
_P1_ALL_HIERARCHY = (
    _FREE
    + """, paths as (select r.k, count(*) - 1 as depth, arg_min(r.c, f.n) as top, string_agg(r.c, '/' order by f.n) as path from reach r join free f on f.k = r.c group by r.k),
below as (select c, count(*) - 1 as n from reach group by c)
select f.k as about, p.top, cast(p.depth as integer) as depth, p.path, b.n as n_descendants from free f join paths p on p.k = f.k join below b on b.c = f.k"""
)
_MT = f"""coalesce(epoch_us(try_cast(case when {_trim("mt")} similar to '[0-9]{{4}}-.*(Z|[+-][0-9]{{2}}:[0-9]{{2}})' then {_trim("mt")} when {_trim("mt")} similar to '[0-9]{{4}}-.*' then concat({_trim("mt")}, 'Z') end as timestamptz)), epoch_us(try_strptime({_trim("mt")}, '%m/%d/%Y %I:%M:%S %p')), -4611686018427387904)"""
STATE = f"""with log as (select seq, arrived, {_key("id")} as k, lower({local_sql("tp")}) as tp, {_MT} as changed_us, props from rrecord_log),
winner as (select k, seq, tp from (select *, row_number() over (partition by k order by changed_us desc, seq) as rn from log where k <> '') t where rn = 1),
defined as (select k, min(seq) as since from log where k <> '' and tp <> 'delete' group by k)"""
_ORPHANS = (
    STATE
    + f""", entry as (select seq, arrived, tp, pos, props[pos + 1] as e from (select *, unnest(range(len(props))) as pos from log where tp <> 'delete') t),
ref as (select seq, arrived, tp, cast(pos as integer) as pos, {_key("case e.tag when 2 then e.link when 3 then e.sourcelink end")} as target from entry),
found as (select r.*, case when d.k is null then 'missing' when w.tp = 'delete' then 'deleted' when d.since > r.seq then 'late' end as status
from ref r left join defined d on d.k = r.target left join winner w on w.k = r.target where r.target <> '')"""
)
_P5 = f"""with fact as (select subj, lower({local_sql("pred")}) as pred, {_trim("obj")} as s from triples where subj is not null and {_trim("coalesce(obj, '')")} <> ''),
cell as (select f.subj, f.pred, p.single_valued, case p.range_of
when 'integer' then case when regexp_full_match(s, '[+-]?[0-9]+') or regexp_full_match(s, '[+-]?[0-9]{{1,3}}( [0-9]{{3}})+') then cast(try_cast(regexp_replace(s, '[^0-9-]', '', 'g') as decimal(38, 0)) as varchar) end
when 'real' then case when regexp_full_match(s, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?') then cast(try_cast(replace(s, ',', '.') as double) as varchar) end
when 'boolean' then case when lower(s) in ('t', 'true', '1') then 't' when lower(s) in ('f', 'false', '0') then 'f' end
when 'date' then cast(try_cast(case when regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then s when regexp_full_match(s, '[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}') then concat(s[7:10], '-', s[4:5], '-', s[1:2])
when regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}') then concat(s, '-01') when regexp_full_match(s, '[0-9]{{4}}') then concat(s, '-01-01') end as date) as varchar)
else s end as v from fact f join onto_props p on lower(p.about) = f.pred)
select subj, pred, status from (select subj, pred, case when count(v) = 0 then 'untyped' when bool_or(single_valued) and count(distinct v) > 1 then 'conflict' end as status from cell group by subj, pred) t where status is not null"""


_CELLS = _P5[: _P5.index("\nselect subj, pred, status")]
_P5_COUNTS = _CELLS + " select subj, pred, count(*) as n_values, count(v) as n_fitting from cell group by subj, pred"


# nested records: one step of the recursion goes from records over their entries to the records within


def _text_sql(x: str) -> str:
    return f"json_extract_string({x}, '$')"


def _valid_sql(x: str) -> str:
    """JSON as the standard has it: without the numbers and commas that this engine lets pass beside it."""
    bare = f"regexp_replace({x}, '\"(\\\\.|[^\"\\\\])*\"', '', 'g')"
    return f"(json_valid({x}) and not regexp_matches({bare}, ',\\s*[\\]}}]|[Nn][Aa][Nn]|[Ii][Nn][Ff]'))"


def _tag_sql(x: str) -> str:
    s = _text_sql(x)
    return (
        f"case json_type({x}) when 'UBIGINT' then try_cast({s} as bigint) when 'BIGINT' then try_cast({s} as bigint) when 'DOUBLE' then case when try_cast({s} as double) = floor(try_cast({s} as double)) then try_cast(try_cast({s} as double) as bigint) end "
        f"when 'VARCHAR' then case when regexp_full_match({s}, '\\s*\\+?[0-9]{{1,9}}\\s*') then try_cast(replace(trim({s}), '+', '') as bigint) else case lower(trim({s})) when 'field' then 1 when 'objprop' then 2 when 'invlink' then 3 end end end"
    )


def _items_sql(x: str) -> str:
    return f"case json_type({x}) when 'ARRAY' then json_extract({x}, '$[*]') else [{x}] end"


def _filled_sql(x: str) -> str:
    return f"(json_type({x}) = 'OBJECT' and len(json_keys({x})) > 0)"


def _named_sql(what: str) -> str:
    """The number or content of an entry named by its variant."""
    return "case " + " ".join(f"when {_filled_sql(f"json_extract(e, '$.{n}')")} then {k if what == 'k' else f"json_extract(e, '$.{n}')"}" for k, n in ((1, "field"), (2, "objprop"), (3, "invlink"))) + " end"


def _entries_sql(rec: str) -> str:
    """(raw_id, path, r, i, k, c): the filled entries of the records of a table."""
    p = "json_extract(r, '$.props')"
    first, second = "json_extract(p, '$[0]')", "json_extract(p, '$[1]')"
    lone = f"json_type(p) = 'ARRAY' and json_array_length(p) = 2 and json_type({first}) not in ('OBJECT', 'ARRAY') and ({_tag_sql(first)}) is not null and json_type({second}) in ('OBJECT', 'NULL')"
    listed = f"select raw_id, path, r, case when p is null or json_type(p) = 'NULL' then [] when {lone} then [p] else {_items_sql('p')} end as es from (select raw_id, path, r, {p} as p from {rec}) a"
    each = f"select raw_id, path, r, unnest(es) as e, unnest(range(len(es))) as i from ({listed}) b"
    pair = f"case when {_filled_sql("json_extract(e, '$[1]')")} then "
    k = f"case json_type(e) when 'ARRAY' then {pair} {_tag_sql("json_extract(e, '$[0]')")} end when 'OBJECT' then case when json_extract(e, '$.tag') is not null then case when len(json_keys(e)) > 1 then {_tag_sql("json_extract(e, '$.tag')")} end else {_named_sql('k')} end end"
    c = f"case json_type(e) when 'ARRAY' then json_extract(e, '$[1]') when 'OBJECT' then case when json_extract(e, '$.tag') is not null then e else {_named_sql('c')} end end"
    return f"select raw_id, path, r, i, k, c from (select raw_id, path, r, i, {k} as k, {c} as c from ({each}) d) f where k in (1, 2, 3)"


def _records_within_sql(entries: str) -> str:
    v = "json_extract(c, '$.record')"
    inner = f"case json_type(v) when 'VARCHAR' then case when {_valid_sql(_text_sql('v'))} then case when json_type(cast({_text_sql('v')} as json)) <> 'VARCHAR' then cast({_text_sql('v')} as json) end end else v end"
    listed = f"select raw_id, path || [i] as path, {inner} as v from (select raw_id, path, i, {v} as v from ({entries}) g where k > 1) h where v is not null and json_type(v) <> 'NULL'"
    each = f"select raw_id, path, unnest({_items_sql('v')}) as r, unnest(range(len({_items_sql('v')}))) as j from ({listed}) m where v is not null"
    return f"select raw_id, path || [j] as path, r from ({each}) n where json_type(r) = 'OBJECT'"


_NESTED = f"""with recursive top as (select raw_id, cast(body as json) as v from fog_raw where body is not null and {_valid_sql("body")}),
rec(raw_id, path, r) as (select raw_id, [j] as path, r from (select raw_id, unnest({_items_sql("v")}) as r, unnest(range(len({_items_sql("v")}))) as j from top) t where json_type(r) = 'OBJECT'
union all {_records_within_sql(_entries_sql("rec"))}),
ent as ({_entries_sql("rec")}),
node as (select raw_id, path from rec union all select raw_id, path || [i] from ent),
ranked as (select raw_id, path, row_number() over (partition by raw_id order by path) - 1 as place from node),
sized as (select a.raw_id, a.path, a.place, count(*) as n from ranked a join ranked b on b.raw_id = a.raw_id and b.path[1:len(a.path)] = a.path group by all),
span as (select raw_id, path, cast(len(path) - 1 as integer) as level, cast(2 * place - (len(path) - 1) as integer) as pre, cast(2 * place - (len(path) - 1) + 2 * n - 1 as integer) as post from sized)"""
_KIND = "case k when 1 then 'field' when 2 then 'objprop' else 'invlink' end"
_P3_FOUND = _NESTED + f" select raw_id, array_to_string(path || [i], '.') as entry_path, {_KIND} as kind, coalesce({_text_sql("json_extract(r, '$.id')")}, '') as holder from ent"
_P3_RECORDS = (
    _NESTED
    + f" select s.raw_id, s.pre, s.post, s.level, array_to_string(s.path, '.') as record_path, {_text_sql("json_extract(r, '$.id')")} as id, {_text_sql("json_extract(r, '$.tp')")} as tp, {_text_sql("json_extract(r, '$.mT')")} as mt from rec join span s on s.raw_id = rec.raw_id and s.path = rec.path"
)
_P3_ENTRIES = (
    _NESTED
    + f" select s.raw_id, s.pre, s.post, s.level, array_to_string(s.path, '.') as entry_path, {_KIND} as kind, "
    + ", ".join(f"{_text_sql(f"json_extract(c, '$.{n}')")} as {n}" for n in ("prop", "value", "lang"))
    + f", case k when 2 then {_text_sql("json_extract(c, '$.link')")} when 3 then {_text_sql("json_extract(c, '$.sourcelink')")} end as target, {_text_sql("json_extract(r, '$.id')")} as holder_id, array_to_string(ent.path, '.') as holder_path from ent join span s on s.raw_id = ent.raw_id and s.path = ent.path || [ent.i]"
)

#: The declared properties of the test tables, fixed and clean: type by name.
_DECLARED = {
    "name": "string", "alias": "string", "age": "integer", "birth-date": "date", "height": "real", "is-alive": "boolean", "from-date": "date", "uri": "string", "n-pages": "integer", "exposure": "real",
    "is-colour": "boolean", "ground": "string", "description": "string", "comment": "string", "father": "iri", "participant": "iri", "reflected": "iri", "in-doc": "iri", "in-collection": "iri",
    "collection-item": "iri", "referred-sys": "iri", "has-member": "iri", "type": "iri",
}


def _wide_sql() -> str:
    cast = {"integer": "decimal(38, 0)", "real": "double", "boolean": "boolean", "date": "date"}
    columns = ", ".join(f"min(cast(case when c.pred = '{a}' then c.v end as {cast.get(k, 'varchar')})) as \"{a}\"" for a, k in _DECLARED.items())
    return f"{_CELLS} select a.subj, {columns} from (select distinct subj from triples where subj is not null) a left join cell c on c.subj = a.subj group by a.subj"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_hierarchy": _P1_HIERARCHY,
        "p5_wide": _wide_sql(),
        "p1_descendants": _P1_DESCENDANTS,
        "p1_all_hierarchy": _P1_ALL_HIERARCHY,
        "p1_all_descendants": _P1_ALL_DESCENDANTS,
        "p2_found": STATE + " select k as id, seq from winner where tp <> 'delete'",
        "p2_batches": STATE + " select k as id, seq from winner where tp <> 'delete'",
        "p3_found": _P3_FOUND,
        "p3_records": _P3_RECORDS,
        "p3_entries": _P3_ENTRIES,
        "p4_found": _ORPHANS + " select seq, pos, status from found where status is not null",
        "p4_report": _ORPHANS + " select tp, strftime(arrived, '%Y-%m') as month, status, count(*) as n_refs, count(distinct target) as n_targets from found where status is not null group by 1, 2, 3",
        "p5_found": _P5,
        "p5_counts": _P5_COUNTS,
    }
