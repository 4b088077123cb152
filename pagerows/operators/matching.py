"""Which table a saved binding means: headers compared, candidates scored, frames found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_header
from ..shared import shared_dir

# fixed values: weights of a candidate's score, least coverages, least lead of the best
_VISIBLE, _STABLE_SELECTOR, _SELECTOR, _INDEX = 0.03, 0.22, 0.08, 0.03
_TYPE, _SIGNATURE, _TITLE = (0.08, -0.12), (0.18, -0.12), (0.08, -0.05)
_EXACT, _COVERAGE, _SELECTED = 0.35, 0.28, 0.30
ACCEPT, CHANGED, LEAD = 0.78, 0.45, 0.08


def header_diff(pairs: DataFrame, expected: str = "expected", actual: str = "actual", most: int = 20) -> DataFrame:
    """Adds how two header lists differ: ``same_length``, ``same_sequence``, ``first_mismatch`` (-1: none),
    ``mismatches`` (positions where both are there and differ), ``missing`` and ``added`` (``position:name``)."""
    norm = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), norm_header)
    both = pairs.withColumn("__e", norm(F.col(expected))).withColumn("__a", norm(F.col(actual)))
    positions = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__e"), F.size("__a"))), lambda i: i < F.greatest(F.size("__e"), F.size("__a")))
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    differ = F.filter(positions, lambda i: (at("__e", i) != "") & (at("__a", i) != "") & (at("__e", i) != at("__a", i)))
    # what is absent at its own position comes first, then what is absent everywhere
    gone = lambda x, y: F.array_distinct(
        F.concat(
            F.filter(positions, lambda i: (at(x, i) != "") & (at(y, i) == "")),
            F.filter(positions, lambda i: (at(x, i) != "") & ~F.array_contains(y, at(x, i))),
        )
    )
    named = lambda x, found: F.transform(F.slice(found, 1, most), lambda i: F.concat(i.cast("string"), F.lit(":"), at(x, i)))
    return both.select(
        *pairs.columns,
        (F.size("__e") == F.size("__a")).alias("same_length"),
        (F.col("__e") == F.col("__a")).alias("same_sequence"),
        F.coalesce(F.get(differ, 0), F.lit(-1)).alias("first_mismatch"),
        F.slice(differ, 1, most).alias("mismatches"),
        named("__e", gone("__e", "__a")).alias("missing"),
        named("__a", gone("__a", "__e")).alias("added"),
    )


def resolve_columns(selections: DataFrame, headers: DataFrame, key: str, name: str = "name", occurrence: str = "occurrence") -> DataFrame:
    """Selections (key, name, occurrence from 1) with the ``index`` of that header of ``headers`` (key, headers); null:
    missing."""
    listed = headers.select(key, F.posexplode("headers").alias("index", "__h")).withColumn("__norm", norm_header(F.col("__h")))
    repeat = F.row_number().over(Window.partitionBy(key, "__norm").orderBy("index"))
    known = listed.select(key, "__norm", repeat.alias(occurrence), "index")
    return selections.withColumn("__norm", norm_header(F.col(name))).join(known, [key, "__norm", occurrence], "left").drop("__norm")


def match_score(visible: Column, selector: Column, stable: Column, indexed: Column, same_type: Column, signature: Column, title: Column, exact: Column, coverage: Column, selected: Column) -> Column:
    """A candidate's score. ``signature`` and ``title`` are null where the binding stores none."""
    gain = lambda c, yes, no=0.0: F.when(c, yes).otherwise(no)
    stored = lambda c, w: F.when(c.isNull(), 0.0).otherwise(gain(c, *w))
    return (
        gain(visible, _VISIBLE) + F.when(selector, gain(stable, _STABLE_SELECTOR, _SELECTOR)).otherwise(0.0) + gain(indexed, _INDEX)
        + gain(same_type, *_TYPE) + stored(signature, _SIGNATURE) + stored(title, _TITLE)
        + gain(exact, _EXACT) + coverage * _COVERAGE + selected * _SELECTED
    )


def best_match(candidates: DataFrame, key: str, tie: str, derived: Column | None = None) -> DataFrame:
    """For each binding the best candidate (columns score, selected, coverage, selector, indexed, exact; ``tie`` orders
    equal ones) with ``status`` available, changed, ambiguous or missing. Best and second are first picked in 64 buckets
    of each binding, so one with very many candidates is no hot partition."""
    derived = F.lit(False) if derived is None else derived
    accepted = F.col("exact") | F.when(derived, F.col("selected") == 1).otherwise(F.col("coverage") >= ACCEPT)
    rank = F.struct(-F.col("score"), -F.col("selected"), -F.col("coverage"), ~F.col("selector"), tie).alias("rank")
    scored = candidates.select(key, rank, F.struct(tie, "score", "coverage", "selector", "indexed", accepted.alias("accepted")).alias("c"))
    # the best two of all lie among the best two of each bucket
    spread = scored.withColumn("__b", F.pmod(F.xxhash64(F.col(f"c.{tie}")), F.lit(64)))
    near = spread.withColumn("__k", F.row_number().over(Window.partitionBy(key, "__b").orderBy("rank"))).where("__k <= 2")
    top = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("top"))  # at most 128 each
    found = top.select(key, F.get("top", 0)["c"].alias("a"), F.get("top", 1)["c"].alias("b"))
    close = F.col("b").isNotNull() & (F.abs(F.col("a.score") - F.col("b.score")) < LEAD)
    unsure = close & (F.col("a.accepted") | F.col("b.accepted") | (F.col("a.coverage") >= CHANGED))
    changed = (F.col("a.coverage") >= CHANGED) | F.col("a.selector") | F.col("a.indexed")
    status = F.when(unsure, "ambiguous").when(F.col("a.accepted"), "available").when(changed, "changed").otherwise("missing")
    picked = F.when(status.isin("available", "changed"), F.col(f"a.{tie}"))
    return found.select(key, status.alias("status"), picked.alias(tie))


def frame_paths(frames: DataFrame, frame: str = "frame_id", parent: str = "parent_frame_id", url: str = "url", page: str = "page_id", normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(page, frame, path)``: ``url#i`` of each frame from the root down, joined by `` > ``; i counts the siblings
    with the same url (as ``normalize`` gives it) before it. Paths double in each round, so the number of rounds is the logarithm of the depth, which
    has no limit; each round is checkpointed. Frames on or below a cycle have no path: they are those left when no path
    ends any more though paths as long as there are frames would have. A parent that isn't there makes a root."""
    shared_dir(frames.sparkSession)
    frames = frames if normalize is None else frames.withColumn(url, normalize(F.col(url)))
    index = F.row_number().over(Window.partitionBy(page, parent, url).orderBy(frame)) - 1
    part = F.concat(F.coalesce(url, F.lit("")), F.lit("#"), index.cast("string"))
    known = frames.select(F.col(page), F.col(frame).alias("__above"), F.lit(True).alias("__is"))
    own = frames.select(page, frame, F.col(parent).alias("__above"), part.alias("path")).join(known, [page, "__above"], "left")
    paths = own.select(page, frame, F.when(F.col("__is"), F.col("__above")).alias("__above"), "path").checkpoint()
    # a path without end has more steps than its page has frames
    most = frames.groupBy(page).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= most and not paths.where(F.col("__above").isNotNull()).isEmpty():
        up = paths.select(F.col(page), F.col(frame).alias("__above"), F.col("__above").alias("__next"), F.col("path").alias("__p"))
        longer = F.when(F.col("__p").isNotNull(), F.concat("__p", F.lit(" > "), "path")).otherwise(F.col("path"))
        done, live = paths.where(F.col("__above").isNull()), paths.where(F.col("__above").isNotNull())
        more = live.join(up, [page, "__above"], "left").select(page, frame, F.col("__next").alias("__above"), longer.alias("path"))
        paths = done.unionByName(more).checkpoint()
        reach *= 2
    return paths.select(page, frame, F.when(F.col("__above").isNull(), F.col("path")).alias("path"))


def select_frames(sources: DataFrame, frames: DataFrame, source: str, page: str = "page_id") -> DataFrame:
    """Sources (page, path, url) against frames (page, frame_id, path, url): one frame with the same path is a
    ``match``, several are ``ambiguous``; with none, one frame with the same url is a ``fallback``. Frames are counted
    before they are joined, so equal frames don't multiply."""
    by = lambda c, n: frames.groupBy(page, c).agg(F.count("*").alias(f"n_{n}"), F.min("frame_id").alias(f"f_{n}"))
    joined = sources.join(by("path", "path"), [page, "path"], "left").join(by("url", "url"), [page, "url"], "left")
    status = (
        F.when(F.col("n_path") == 1, "match").when(F.col("n_path") > 1, "ambiguous")
        .when(F.col("n_url") == 1, "fallback").when(F.col("n_url") > 1, "ambiguous").otherwise("missing")
    )
    picked = F.when(status == "match", F.col("f_path")).when(status == "fallback", F.col("f_url"))
    return joined.select(source, status.alias("status"), picked.alias("frame_id"))
