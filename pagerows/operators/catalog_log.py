"""A catalog of saved analyses as what its log of mutations leaves: outcomes, state, snapshots.

A catalog is an ordered list of analyses with their sources, and names of pages; a log has mutations of many catalogs. One
fold knows all kinds. It is cut where a catalog is emptied, as nothing before that can matter later: each part is
folded by itself, as one task streams its mutations in order and holds one catalog. What was folded once can be
kept as a snapshot (a row for each catalog), from which the rest of the log goes on.
"""

from __future__ import annotations

import json
from bisect import insort
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SOURCE = "struct<id:string,place:string,headers:array<string>,tab:string,confirmed:boolean,captured_at:bigint>"
#: ``content`` is what tells analyses apart besides sources and method; ``version`` counts only without a method.
SKILL = f"struct<id:string,name:string,revision:bigint,created_at:bigint,method:string,content:string,version:int,sources:array<{SOURCE}>>"
LOG = (
    "catalog, seq, type, skill_id, source_id, expected_revision, now, page_key, value, headers, skills, page_names".split(", "),
    ["bigint", "bigint", "string", "string", "string", "bigint", "bigint", "string", "string", "array<string>", f"array<{SKILL}>", "map<string,string>"],
)
_STATE = (
    f"struct<skills:array<struct<id:string,name:string,revision:bigint,created_at:bigint,updated_at:bigint,method:string,content:string,sources:array<{SOURCE}>>>,"
    "names:map<string,string>>"
)
CLEAR, SNAPSHOT = "DELETE_ALL_SKILLS", "snapshot"


def source_place(page_key: Column, frame_url: Column, selector: Column, index: Column) -> Column:
    """Where a source lies, as a text."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.to_json(F.struct(clean(page_key).alias("page"), clean(frame_url).alias("frame"), clean(selector).alias("selector"), index.alias("index")))


class Refused(Exception):
    """A mutation that leaves the catalog as it was."""


class Catalog:
    """Analyses by rank: new ones go before all others, imported ones behind. Of several with one id the first counts."""

    def __init__(self, state: dict | None = None):
        self.skills: dict[int, dict] = {}
        self.ranks: dict[str, list[int]] = {}
        self.names: dict[str, str] = {}
        self.seen: Counter = Counter()
        self.front, self.back = -1, 0
        for skill in (state or {}).get("skills", ()):
            self._append(skill)
        self.names.update((state or {}).get("names", {}))

    @staticmethod
    def identity(skill: dict) -> tuple:
        """Two analyses are the same if all of this is; names, ids, times and tabs don't count."""
        method = skill["method_key"]
        return skill["content"], method or skill["version"], tuple((s["place"], s["keys"]) for s in skill["sources"])

    def _put(self, rank: int, skill: dict) -> None:
        self.skills[rank] = skill
        insort(self.ranks.setdefault(skill["id"], []), rank)
        self.seen[self.identity(skill)] += 1

    def _append(self, skill: dict) -> None:
        self._put(self.back, skill)
        self.back += 1

    def _take(self, rank: int) -> dict:
        skill = self.skills.pop(rank)
        ranks = self.ranks[skill["id"]]
        ranks.remove(rank)
        if not ranks:
            del self.ranks[skill["id"]]
        key = self.identity(skill)
        self.seen[key] -= 1
        if not self.seen[key]:
            del self.seen[key]
        return skill

    def _rank(self, m: dict, check: bool = True) -> int:
        found = self.ranks.get(m["skill_id"])
        if not found:
            raise Refused("SKILL_NOT_FOUND")
        wanted = m["expected_revision"]
        if check and wanted is not None and self.skills[found[0]]["revision"] != max(0, wanted):
            raise Refused("SKILL_CONFLICT")
        return found[0]

    def _edit(self, rank: int, now: int, **new) -> str:
        old = self._take(rank)
        skill = {**old, "updated_at": now, **new, "revision": old["revision"] + 1}
        self._put(rank, skill)
        return str(skill["revision"])

    def _upsert(self, m: dict, now: int) -> str:
        new = (m["skills"] or [None])[0]
        if not new or not new["id"]:
            raise Refused("INVALID_SKILL")
        wanted = m["expected_revision"]
        if new["id"] not in self.ranks:
            if (wanted or 0) > 0:
                raise Refused("SKILL_CONFLICT")
            self._put(self.front, {**new, "revision": 1, "created_at": new["created_at"] or now, "updated_at": now})
            self.front -= 1
            return "1"
        rank = self._rank({"skill_id": new["id"], "expected_revision": wanted})
        old = self.skills[rank]
        known = {s["id"]: s for s in old["sources"]}
        sources = [
            {**s, "tab": k["tab"], "confirmed": k["confirmed"] is True} if (k := known.get(s["id"])) and k["tab"] and not s["tab"] else s for s in new["sources"]
        ]
        return self._edit(rank, now, **{**new, "sources": sources, "created_at": old["created_at"] or new["created_at"] or now})

    def _learn(self, m: dict) -> str:
        rank = self._rank(m, check=False)  # fills in what is empty and isn't an edit
        skill, title = self.skills[rank], (m["value"] or "").strip()
        current = next((s for s in skill["sources"] if s["id"] == m["source_id"]), None)
        if current is None:
            raise Refused("SOURCE_NOT_FOUND")
        if not title:
            raise Refused("INVALID_BUSINESS_TAB")
        if not current["tab"]:
            sources = [{**s, "tab": title, "confirmed": True} if s["id"] == m["source_id"] else s for s in skill["sources"]]
            self.skills[rank] = {**skill, "sources": sources}
        return str(skill["revision"])

    def _headers(self, m: dict, now: int) -> str:
        rank = self._rank(m)
        old, changed = self.skills[rank]["sources"], {"headers": m["headers"] or [], "keys": m["header_keys"], "captured_at": now}
        if all(s["id"] != m["source_id"] for s in old):
            raise Refused("SOURCE_NOT_FOUND")
        return self._edit(rank, now, sources=[{**s, **changed} if s["id"] == m["source_id"] else s for s in old])

    def _import(self, m: dict, now: int) -> str:
        added = 0
        for skill in m["skills"] or ():
            if skill and skill["id"] and self.identity(skill) not in self.seen:
                self._append({**skill, "revision": max(1, skill["revision"] or 0), "created_at": skill["created_at"] or now, "updated_at": now})
                added += 1
        self.names.update(m["page_names"] or ())
        return f"added {added}"

    def apply(self, m: dict) -> str:
        """The new revision, or what else was done, or the error."""
        kind, now = m["type"], max(1, m["now"] or 0)
        try:
            if kind == "UPSERT_SKILL":
                return self._upsert(m, now)
            if kind == "UPDATE_ANALYSIS_METHOD":
                return self._edit(self._rank(m), now, method=m["value"], method_key=m["value_key"])
            if kind == "UPDATE_SOURCE_HEADERS":
                return self._headers(m, now)
            if kind == "LEARN_SOURCE_BUSINESS_TAB":
                return self._learn(m)
            if kind == "DELETE_SKILL":
                self._take(self._rank(m))
                return "deleted"
            if kind == "IMPORT_SKILLS":
                return self._import(m, now)
            if kind == "SET_PAGE_NAME":
                if not m["page_key"] or not (m["value"] or "").strip():
                    raise Refused("INVALID_PAGE_NAME")
                self.names[m["page_key"]] = m["value"].strip()
                return "named"
            if kind == CLEAR:
                self.__init__()
                return "cleared"
            raise Refused("UNKNOWN_SKILL_MUTATION")
        except Refused as e:
            return str(e)

    def state(self) -> str:
        return json.dumps({"skills": [self.skills[k] for k in sorted(self.skills)], "names": self.names}, ensure_ascii=False)


def _keyed(log: DataFrame) -> DataFrame:
    """What is compared, made once by column functions: headers without marks of writing, methods without white space around."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), r"^\s+|(?<!\s)\s+$", "")
    keys = lambda h: F.array_join(F.transform(F.coalesce(h, F.array().cast("array<string>")), tx.norm_header), tx.UNIT_SEPARATOR)
    some = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    sources = lambda s: F.transform(some(s["sources"], SOURCE), lambda x: x.withField("keys", keys(x["headers"])))
    skill = lambda s: s.withField("method_key", clean(s["method"])).withField("sources", sources(s))
    return log.withColumn("skills", F.transform("skills", skill)).withColumn("header_keys", keys(F.col("headers"))).withColumn("value_key", clean(F.col("value")))


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    at, catalog = None, Catalog()
    for batch in batches:
        out = []
        for m in batch.to_pylist():
            key = (m["catalog"], m["part"])
            if key != at:
                if at is not None:
                    out.append((*at, None, None, catalog.state()))
                at, catalog = key, Catalog()
            if m["type"] == SNAPSHOT:
                catalog = Catalog(json.loads(m["value"]))
            else:
                out.append((*key, m["seq"], catalog.apply(m), None))
        yield _batch(out)
    if at is not None:
        yield _batch([(*at, None, None, catalog.state())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["catalog", "part", "seq", "outcome", "state"])


def import_log(items: DataFrame, names: DataFrame | None, files: DataFrame, at: int = 1) -> DataFrame:
    """A log of one import for each catalog of ``files`` (catalog): ``items`` (catalog, seq, and any fields of ``SKILL``) in order, and
    ``names`` (catalog, page_key, name). A file is one mutation, as large as a file may be."""
    fields = [f.split(":")[0] for f in ("id", "name", "revision", "created_at", "method", "content", "version")]
    kinds = dict(zip(fields, ("string", "string", "bigint", "bigint", "string", "string", "int")))
    skill = F.struct(*((F.col(f) if f in items.columns else F.lit(None)).cast(kinds[f]).alias(f) for f in fields), (F.col("sources") if "sources" in items.columns else F.array().cast(f"array<{SOURCE}>")).alias("sources"))
    listed = items.groupBy("catalog").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", skill.alias("s")))), lambda x: x["s"]).alias("skills"))
    out = files.join(listed, "catalog", "left")
    if names is not None:
        own = names.groupBy("catalog").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_key", "name")))).alias("page_names"))
        out = out.join(own, "catalog", "left")
    fixed = {"type": F.lit("IMPORT_SKILLS"), "seq": F.lit(at).cast("bigint"), "now": F.lit(at).cast("bigint")}
    given = {**fixed, **{c: F.col(c) for c in out.columns}}
    return out.select(*(given.get(c, F.lit(None)).cast(k).alias(c) for c, k in zip(*LOG)))


def folded(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """``(catalog, part, seq, outcome, state)``: a row for each mutation with its outcome, and one for each part of a catalog's
    log with its state in JSON. ``log`` has the columns of ``LOG``; ``snapshot`` (catalog, state) is what went before it."""
    w = Window.partitionBy("catalog").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.sum((F.col("type") == CLEAR).cast("long")).over(w), F.lit(0))
    rows = _keyed(log.select(*LOG[0])).withColumn("part", part)
    if snapshot is not None:
        held = snapshot.select("catalog", F.lit(SNAPSHOT).alias("type"), F.col("state").alias("value"), F.lit(0).cast("long").alias("part"))
        rows = rows.unionByName(held, allowMissingColumns=True)
    dealt = rows.repartition("catalog", "part").sortWithinPartitions("catalog", "part", F.col("seq").asc_nulls_first())
    return dealt.mapInArrow(_fold, "catalog bigint, part bigint, seq bigint, outcome string, state string")


def outcomes(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """``(catalog, seq, outcome)`` of each mutation, in the order of ``seq``, which is different for each of a catalog: the new
    revision, ``deleted``, ``added n``, ``named``, ``cleared``, or the error that left the catalog as it was. A null ``now`` is 1."""
    return folded(log, snapshot).where("outcome is not null").select("catalog", "seq", "outcome")


def compacted(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """``(catalog, state)``, a snapshot of all that ``snapshot`` and ``log`` hold: written down, it takes the place of both."""
    return folded(log, snapshot).where("state is not null").groupBy("catalog").agg(F.max_by("state", "part").alias("state"))


def skills_of(snapshot: DataFrame) -> DataFrame:
    """``(catalog, position, id, name, revision, created_at, updated_at, method, content, sources)`` in the catalog's order."""
    return snapshot.select("catalog", F.posexplode(F.from_json("state", _STATE)["skills"]).alias("position", "s")).select("catalog", "position", "s.*")


def names_of(snapshot: DataFrame) -> DataFrame:
    """``(catalog, page_key, name)``."""
    return snapshot.select("catalog", F.explode(F.from_json("state", _STATE)["names"]).alias("page_key", "name"))
