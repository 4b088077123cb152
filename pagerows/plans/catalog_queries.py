"""Queries of whole catalogs: a user's events are the log of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog_log as log
from .registry import register, table
from .status_queries import _KIND_SQL, _KINDS


def _log(spark, sf_dir) -> DataFrame:
    c, lit = F.col, F.lit
    n = c("event_id")
    text = lambda prefix, number: F.concat(lit(prefix), number.cast("string"))
    kind = F.coalesce(*(F.when(c("event_type") == k, v) for k, v in _KINDS.items()))
    kind = (
        F.when(n % 50 == 49, "DELETE_ALL_SKILLS").when(n % 11 == 5, "SET_PAGE_NAME").when(n % 13 == 7, "UPDATE_SOURCE_HEADERS")
        .when(n % 7 == 3, "IMPORT_SKILLS").when(n % 29 == 1, "MERGE_SKILLS").otherwise(kind)
    )
    skill_id = F.when(n % 97 > 0, text("s", F.floor(n / 2) % 3))
    source = lambda i, place, headers, tab: F.struct(lit(i).alias("id"), place.alias("place"), headers.alias("headers"), tab.alias("tab"), lit(None).cast("boolean").alias("confirmed"), lit(None).cast("bigint").alias("captured_at"))
    skill = lambda i, name, revision, k, sources: F.struct(i.alias("id"), name.alias("name"), revision.cast("bigint").alias("revision"), lit(None).cast("bigint").alias("created_at"), text("m", (n + k) % 3).alias("method"), text("c", n % 2).alias("content"), lit(None).cast("int").alias("version"), sources.alias("sources"))
    none = lit(None).cast("string")
    first = source("a", text("q", n % 2), F.array(text("H", n % 3), lit("x")), F.when(n % 5 == 0, text("t", n)))
    own = skill(skill_id, text("n", n), lit(0), 0, F.concat(F.array(first), F.when(n % 4 < 2, F.array(source("b", lit("r"), F.array(lit("y")), none))).otherwise(F.array().cast(f"array<{log.SOURCE}>"))))
    brought = [skill(F.when((n % 6 > 0) | lit(k == 0), F.concat(text("i", n % 5), lit(str(k)))), lit("imported"), n % 3, k, F.array(source("a", text("q", (n + k) % 2), F.array(text("h", n % 3), lit(" X")), none))) for k in (0, 1)]
    return table(spark, sf_dir, "events").select(
        c("user_id").alias("catalog"), n.alias("seq"), kind.alias("type"), skill_id.alias("skill_id"), F.get(F.array(*map(lit, "aabcb")), (n % 5).cast("int")).alias("source_id"),
        F.when(n % 2 == 0, n % 4).alias("expected_revision"), (n * 10).alias("now"), F.when(n % 3 > 0, text("p", n % 4)).alias("page_key"),
        F.when(n % 3 == 0, " ").otherwise(F.concat(text(" v", n % 9), lit(" "))).alias("value"), F.array(text("H", n % 3), lit("x")).alias("headers"),
        F.when(kind == "UPSERT_SKILL", F.array(own)).when(kind == "IMPORT_SKILLS", F.array(*brought)).alias("skills"), F.when(kind == "IMPORT_SKILLS", F.create_map(text("p", n % 4), text("imported ", n))).alias("page_names"),
    )


_SOURCE_SQL = "struct_pack(id := {}, place := {}, headers := {}, tab := {}, conf := false, cap := cast(0 as bigint))"
_SKILL_SQL = "struct_pack(id := {id}, name := {name}, rev := cast({rev} as bigint), c := cast({c} as bigint), u := cast({u} as bigint), method := {method}, content := {content}, sources := {sources})"
_OWN_SQL = _SKILL_SQL.format(
    id="sid", name="'n' || n", rev=1, c="now", u="now", method="'m' || n % 3", content="'c' || n % 2",
    sources="[" + _SOURCE_SQL.format("'a'", "'q' || n % 2", "'H' || n % 3 || ',x'", "case when n % 5 = 0 then 't' || n end") + "] || case when n % 4 < 2 then [" + _SOURCE_SQL.format("'b'", "'r'", "'y'", "null::varchar") + "] else [] end",
)
_BROUGHT_SQL = [
    _SKILL_SQL.format(id=f"case when n % 6 > 0 or {k} = 0 then 'i' || n % 5 || '{k}' end", name="'imported'", rev="greatest(1, n % 3)", c="now", u="now", method=f"'m' || (n + {k}) % 3", content="'c' || n % 2", sources="[" + _SOURCE_SQL.format("'a'", f"'q' || (n + {k}) % 2", "'h' || n % 3 || ', X'", "null::varchar") + "]")
    for k in (0, 1)
]
_SAME_SQL = "trim({0}.method) || '~' || {0}.content || '~' || array_to_string(list_transform({0}.sources, lambda y: y.place || ':' || replace(lower(y.headers), ' ', '')), ';')"
_EDIT_SQL = lambda **new: _SKILL_SQL.format(**({"id": "cur.id", "name": "cur.name", "rev": "cur.rev + 1", "c": "cur.c", "u": "now", "method": "cur.method", "content": "cur.content", "sources": "cur.sources"} | new))
_TYPE_SQL = "STRUCT(id VARCHAR, name VARCHAR, rev BIGINT, c BIGINT, u BIGINT, method VARCHAR, content VARCHAR, sources STRUCT(id VARCHAR, place VARCHAR, headers VARCHAR, tab VARCHAR, conf BOOLEAN, cap BIGINT)[])[]"
_HOLDS_SQL = "list_contains(list_transform(cur.sources, lambda y: y.id), src)"
_SET_SQL = "list_transform(cur.sources, lambda y: case when y.id = src then {} else y end)"

_CATALOG_SQL = f"""e as (select user_id, event_id, event_id as n, greatest(1, event_id * 10) as now, case when event_id % 50 = 49 then 'DELETE_ALL_SKILLS' when event_id % 11 = 5 then 'SET_PAGE_NAME' when event_id % 13 = 7 then 'UPDATE_SOURCE_HEADERS'
    when event_id % 7 = 3 then 'IMPORT_SKILLS' when event_id % 29 = 1 then 'MERGE_SKILLS' else {_KIND_SQL} end as what, case when event_id % 97 > 0 then 's' || (event_id // 2) % 3 end as sid, ['a', 'a', 'b', 'c', 'b'][event_id % 5 + 1] as src,
    case when event_id % 2 = 0 then event_id % 4 end as wanted, case when event_id % 3 > 0 then 'p' || event_id % 4 end as page, case when event_id % 3 = 0 then ' ' else ' v' || event_id % 9 || ' ' end as value from events),
  m as (select *, row_number() over (partition by user_id order by event_id) as k, {_OWN_SQL} as own, {_BROUGHT_SQL[0]} as one, {_BROUGHT_SQL[1]} as two from e),
  f as (select distinct user_id, cast(0 as bigint) as k, cast(null as bigint) as event_id, cast([] as {_TYPE_SQL}) as skills, '' as outcome from m
  union all select user_id, k, event_id,
    case when error is not null or what = 'SET_PAGE_NAME' then s when what = 'DELETE_ALL_SKILLS' then [] when what = 'IMPORT_SKILLS' then s || case when new1 then [one] else [] end || case when new2 then [two] else [] end
      when what = 'UPSERT_SKILL' and pos = 0 then [own] || s when what = 'DELETE_SKILL' then list_filter(s, lambda x, i: i <> pos) else list_transform(s, lambda x, i: case when i = pos then changed else x end) end,
    case when error is not null then error when what = 'SET_PAGE_NAME' then 'named' when what = 'DELETE_ALL_SKILLS' then 'cleared' when what = 'IMPORT_SKILLS' then 'added ' || (new1::int + new2::int)
      when what = 'DELETE_SKILL' then 'deleted' when pos = 0 then '1' else changed.rev::varchar end
  from (select *, case what
      when 'UPSERT_SKILL' then {_EDIT_SQL(name="own.name", method="own.method", content="own.content", sources="list_transform(own.sources, lambda x: case when x.tab is null and len(list_filter(cur.sources, lambda y: y.id = x.id and y.tab is not null)) > 0 then struct_pack(id := x.id, place := x.place, headers := x.headers, tab := list_filter(cur.sources, lambda y: y.id = x.id)[1].tab, conf := list_filter(cur.sources, lambda y: y.id = x.id)[1].conf, cap := x.cap) else x end)")}
      when 'UPDATE_ANALYSIS_METHOD' then {_EDIT_SQL(method="value")}
      when 'UPDATE_SOURCE_HEADERS' then {_EDIT_SQL(sources=_SET_SQL.format("struct_pack(id := y.id, place := y.place, headers := 'H' || n % 3 || ',x', tab := y.tab, conf := y.conf, cap := now)"))}
      when 'LEARN_SOURCE_BUSINESS_TAB' then {_EDIT_SQL(rev="cur.rev", u="cur.u", sources=_SET_SQL.format("struct_pack(id := y.id, place := y.place, headers := y.headers, tab := coalesce(y.tab, trim(value)), conf := y.conf or y.tab is null, cap := y.cap)"))} end as changed,
      not list_contains(same, {_SAME_SQL.format("one")}) as new1, two.id is not null and not list_contains(same || [{_SAME_SQL.format("one")}], {_SAME_SQL.format("two")}) as new2
    from (select *, case when what = 'UPSERT_SKILL' then case when sid is null then 'INVALID_SKILL' when pos = 0 and coalesce(wanted, 0) > 0 or pos > 0 and wanted <> cur.rev then 'SKILL_CONFLICT' end
        when what in ('UPDATE_ANALYSIS_METHOD', 'UPDATE_SOURCE_HEADERS', 'DELETE_SKILL') then case when pos = 0 then 'SKILL_NOT_FOUND' when wanted <> cur.rev then 'SKILL_CONFLICT' when what = 'UPDATE_SOURCE_HEADERS' and not {_HOLDS_SQL} then 'SOURCE_NOT_FOUND' end
        when what = 'LEARN_SOURCE_BUSINESS_TAB' then case when pos = 0 then 'SKILL_NOT_FOUND' when not {_HOLDS_SQL} then 'SOURCE_NOT_FOUND' when trim(value) = '' then 'INVALID_BUSINESS_TAB' end
        when what = 'SET_PAGE_NAME' then case when page is null or trim(value) = '' then 'INVALID_PAGE_NAME' end when what = 'MERGE_SKILLS' then 'UNKNOWN_SKILL_MUTATION' end as error,
        list_transform(s, lambda x: {_SAME_SQL.format("x")}) as same
      from (select *, s[pos] as cur from (select m.*, f.skills as s, case when sid is null then 0 else coalesce(list_position(list_transform(f.skills, lambda x: x.id), sid), 0) end as pos from f join m on m.user_id = f.user_id and m.k = f.k + 1)))))"""

_LAST_SQL = "(select * from f qualify k = max(k) over (partition by user_id))"
_STATE_SQL = f"""with recursive {_CATALOG_SQL} select user_id, i - 1 as position, x.id, x.name, x.rev as revision, x.c as created_at, x.u as updated_at, x.method, x.content,
    array_to_string(list_transform(x.sources, lambda y: concat_ws('|', y.id, y.place, y.headers, coalesce(y.tab, ''), y.conf::varchar, y.cap::varchar)), ';') as sources
    from (select user_id, skills[i] as x, i from (select user_id, skills, unnest(range(1, len(skills) + 1)) as i from {_LAST_SQL}))"""


def _shown(snapshot: DataFrame) -> DataFrame:
    text = lambda y: F.concat_ws("|", y["id"], y["place"], F.array_join(y["headers"], ","), F.coalesce(y["tab"], F.lit("")), F.coalesce(y["confirmed"], F.lit(False)).cast("string"), F.coalesce(y["captured_at"], F.lit(0)).cast("string"))
    return log.skills_of(snapshot).withColumn("sources", F.array_join(F.transform("sources", text), ";")).withColumnRenamed("catalog", "user_id").withColumn("position", F.col("position").cast("bigint"))


@register("job3_catalog_outcomes", f"with recursive {_CATALOG_SQL} select user_id, event_id, outcome from f where k > 0")
def catalog_outcomes(spark, sf_dir):
    """All eight kinds of mutations, and an unknown one."""
    return log.outcomes(_log(spark, sf_dir)).select(F.col("catalog").alias("user_id"), F.col("seq").alias("event_id"), "outcome")


@register("job3_catalog_skills", _STATE_SQL)
def catalog_skills(spark, sf_dir):
    return _shown(log.compacted(_log(spark, sf_dir)))


@register("job3_resumed_skills", _STATE_SQL)
def resumed_skills(spark, sf_dir):
    """The same from snapshots: a log that comes in three parts, each folded onto the snapshot of those before."""
    whole, held = _log(spark, sf_dir), None
    for part in range(3):
        held = log.compacted(whole.where(F.least(F.floor(F.col("seq") / 3000), F.lit(2)) == part), held)
    return _shown(held)


@register("job3_page_names", f"""with recursive {_CATALOG_SQL}, s as (select user_id, event_id, page, trim(value) as name, what from e where what = 'SET_PAGE_NAME' and page is not null and trim(value) <> ''
    union all select user_id, event_id, 'p' || n % 4, 'imported ' || n, what from e where what = 'IMPORT_SKILLS')
    select user_id, page as page_key, max_by(name, event_id) as name from s where event_id > coalesce((select max(event_id) from e where e.user_id = s.user_id and what = 'DELETE_ALL_SKILLS'), -1) group by user_id, page""")
def catalog_names(spark, sf_dir):
    return log.names_of(log.compacted(_log(spark, sf_dir))).withColumnRenamed("catalog", "user_id")


@register("job3_catalog_state", f"""with recursive {_CATALOG_SQL}, z as (select user_id, skills, unnest(case when len(skills) > 0 then skills else [null] end) as x from {_LAST_SQL})
    select user_id, cast(count(x) as bigint) as analyses, cast(coalesce(sum(x.rev), 0) as bigint) as revisions, max(x.u) as updated_at, cast(coalesce(sum(len(x.sources)), 0) as bigint) as sources from z group by user_id""")
def catalog_state(spark, sf_dir):
    """A row for each catalog, emptied ones too."""
    held = log.compacted(_log(spark, sf_dir))
    sums = log.skills_of(held).groupBy("catalog").agg(F.count("*").alias("analyses"), F.sum("revision").alias("revisions"), F.max("updated_at").alias("updated_at"), F.sum(F.size("sources").cast("bigint")).alias("sources"))
    return held.select("catalog").join(sums, "catalog", "left").select(F.col("catalog").alias("user_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("analyses", "revisions", "sources")), "updated_at")
