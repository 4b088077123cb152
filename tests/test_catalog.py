"""The log of a catalog: single mutations, parts, snapshots at any cut."""

import random

from pagerows.operators import catalog_log as log

SOURCE = {"id": "a", "place": "p", "headers": ["K 1"], "tab": None, "confirmed": None, "captured_at": None}
ROW = dict.fromkeys(log.LOG[0])


def skill(**new):
    return {"id": "s", "name": "n", "revision": 0, "created_at": None, "method": "m", "content": "c", "version": None, "sources": [dict(SOURCE)], **new}


def frame(spark, rows):
    schema = ", ".join(f"{c} {k}" for c, k in zip(*log.LOG))
    return spark.createDataFrame([{**ROW, "catalog": 1, "seq": k, "now": 10 * k, **r} for k, r in enumerate(rows)], schema)


def said(spark, rows, snapshot=None):
    return [r.outcome for r in log.outcomes(frame(spark, rows), snapshot).orderBy("catalog", "seq").collect()]


def upsert(expected=None, **new):
    return {"type": "UPSERT_SKILL", "expected_revision": expected, "skills": [skill(**new)]}


def test_outcomes_of_all_kinds(spark):
    on = {"skill_id": "s", "source_id": "a"}
    rows = [
        {"type": "DELETE_SKILL", **on}, upsert(1), upsert(), upsert(id=None), {"type": "UPSERT_SKILL"}, upsert(2), upsert(1),
        {"type": "UPDATE_SOURCE_HEADERS", **on, "source_id": "z"}, {"type": "UPDATE_SOURCE_HEADERS", **on, "headers": ["x"]}, {"type": "LEARN_SOURCE_BUSINESS_TAB", **on, "value": " "},
        {"type": "LEARN_SOURCE_BUSINESS_TAB", **on, "value": " t ", "expected_revision": 9}, {"type": "LEARN_SOURCE_BUSINESS_TAB", **on, "value": "u"}, upsert(3), {"type": "SET_PAGE_NAME", "page_key": "p", "value": " "},
        {"type": "SET_PAGE_NAME", "page_key": "p", "value": " N "}, {"type": "IMPORT_SKILLS", "skills": [skill(id="i"), skill(id="j", method="new"), skill(id="k", method=" new "), skill(id=None, method="x")], "page_names": {"q": "Q"}},
        {"type": "UPDATE_ANALYSIS_METHOD", **on, "value": "w"}, {"type": "IMPORT_SKILLS", "skills": [skill(id="i")]}, {"type": "?"}, {"type": None}, {"type": "DELETE_SKILL", **on, "expected_revision": 5},
        {"type": "DELETE_ALL_SKILLS"}, {"type": "UPDATE_ANALYSIS_METHOD", **on, "value": "w"}, upsert(),
    ]
    assert said(spark, rows) == [
        "SKILL_NOT_FOUND", "SKILL_CONFLICT", "1", "INVALID_SKILL", "INVALID_SKILL", "SKILL_CONFLICT", "2", "SOURCE_NOT_FOUND", "3", "INVALID_BUSINESS_TAB", "3", "3", "4", "INVALID_PAGE_NAME",
        "named", "added 1", "5", "added 1", "UNKNOWN_SKILL_MUTATION", "UNKNOWN_SKILL_MUTATION", "deleted", "cleared", "SKILL_NOT_FOUND", "1",
    ]
    before = log.compacted(frame(spark, rows[:20]))
    held = log.skills_of(before).orderBy("position").collect()
    assert [(r.id, r.revision, r.created_at) for r in held] == [("s", 5, 20), ("j", 1, 150), ("i", 1, 170)]
    assert [(s.headers, s.tab, s.confirmed) for s in held[0].sources] == [(["K 1"], "t", True)]  # an UPSERT brings its own headers; a learnt tab stays
    assert {r.page_key: r.name for r in log.names_of(before).collect()} == {"p": "N", "q": "Q"}


def test_new_ones_go_first_and_of_one_id_the_first_counts(spark):
    rows = [upsert(id="a"), upsert(id="b", method="2"), {"type": "IMPORT_SKILLS", "skills": [skill(id="a", method="3")]}, {"type": "DELETE_SKILL", "skill_id": "a"}, {"type": "UPDATE_ANALYSIS_METHOD", "skill_id": "a", "value": "4"}]
    assert said(spark, rows) == ["1", "1", "added 1", "deleted", "2"]
    assert [(r.id, r.method) for r in log.skills_of(log.compacted(frame(spark, rows))).orderBy("position").collect()] == [("b", "2"), ("a", "4")]


def test_a_snapshot_takes_the_place_of_the_log_before_it(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(400):
        sid = f"s{rnd.randrange(4)}"
        kind = rnd.choice(["UPSERT_SKILL"] * 3 + ["UPDATE_ANALYSIS_METHOD", "UPDATE_SOURCE_HEADERS", "LEARN_SOURCE_BUSINESS_TAB", "DELETE_SKILL", "IMPORT_SKILLS", "SET_PAGE_NAME"] + ["DELETE_ALL_SKILLS"] * (k % 50 == 0))
        rows.append({"catalog": rnd.randrange(3), "type": kind, "skill_id": sid, "source_id": "a", "value": f"v{k % 5}", "page_key": f"p{k % 3}", "headers": [f"h{k % 3}"], "skills": [skill(id=sid, method=f"m{k % 4}"), skill(id=f"i{k % 9}", method=f"m{k % 7}")], "page_names": {f"p{k % 4}": f"n{k}"}})
    whole = frame(spark, rows).cache()
    shown = lambda s: sorted(map(str, log.skills_of(s).collect())) + sorted(map(str, log.names_of(s).collect()))
    want = shown(log.compacted(whole))
    outcomes = {(r.catalog, r.seq): r.outcome for r in log.outcomes(whole).collect()}
    for cut in (0, 133, 399):
        held = log.compacted(whole.where(f"seq < {cut}")).cache()
        assert shown(log.compacted(whole.where(f"seq >= {cut}"), held)) == want
        later = {(r.catalog, r.seq): r.outcome for r in log.outcomes(whole.where(f"seq >= {cut}"), held).collect()}
        assert later == {k: v for k, v in outcomes.items() if k[1] >= cut}
    assert shown(log.compacted(whole.limit(0))) == []
