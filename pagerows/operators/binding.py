"""From saved bindings and the tables that a page shows now to the state of each binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import matching
from .derive import distinct_selections, places_among
from .status import LABELS


def selected_coverage(selected: Column, headers: Column) -> Column:
    """``(total, matched, ratio, missing)`` of selected columns among headers; ratio 0 where none is selected."""
    return tx.let(distinct_selections(selected), lambda wanted: coverage_among(wanted, F.transform(headers, tx.norm_header)))


def coverage_among(wanted: Column, names: Column) -> Column:
    """The same of distinct selections and normalised headers."""

    def found(places):
        absent = F.filter(F.zip_with(wanted, places, lambda s, i: F.when(i.isNull(), F.concat(s["name"], F.lit("#"), s["occurrence"].cast("string")))), lambda x: x.isNotNull())
        return tx.let(absent, summed)

    def summed(absent):
        total, matched = F.size(wanted), F.size(wanted) - F.size(absent)
        return F.struct(total.alias("total"), matched.alias("matched"), F.when(total > 0, matched / total).otherwise(0.0).alias("ratio"), absent.alias("missing"))

    return tx.let(places_among(wanted, names), found)


def score_candidates(bindings: DataFrame, candidates: DataFrame, binding: str = "binding", page: str = "page_key") -> DataFrame:
    """Each binding (page, headers, selected, derived, component_type, container_signature, title, selector, stable,
    table_index) with each table that its page shows (page, candidate, headers, component_type, container_signature, title,
    selector, visible; candidates count from 0 in the page's order) and how well they fit."""
    c = F.col
    named = lambda x: F.lower(tx.one_line(x))
    # headers and selections are normalised once for each side, before the join
    norm = lambda x: F.transform(x, tx.norm_header)
    shown = candidates.select(
        page, "candidate", norm(c("headers")).alias("__h"), c("component_type").alias("__type"), tx.one_line(c("container_signature")).alias("__sig"), named(c("title")).alias("__title"), c("selector").alias("__sel"),
        F.coalesce("visible", F.lit(True)).alias("__visible"),
    )
    ready = bindings.withColumn("__stored", norm(c("headers"))).withColumn("__wanted", distinct_selections(c("selected")))
    both = ready.join(shown, page)
    stored = F.coalesce(F.size("headers"), F.lit(0)) > 0
    signature, title = tx.one_line(c("container_signature")), named(c("title"))
    both = both.withColumn("__selects", F.size("__wanted") > 0).withColumn("__cover", F.when(stored, tx.coverage_of(c("__stored"), c("__h"))).otherwise(0.0)).withColumn("__picked", coverage_among(c("__wanted"), c("__h"))["ratio"])
    exact = stored & (c("__stored") == c("__h"))
    selector = F.coalesce((c("selector") == c("__sel")) & (c("selector") != ""), F.lit(False))
    indexed = F.coalesce(c("table_index") == c("candidate"), F.lit(False))
    same_type = (F.coalesce("component_type", F.lit("")) == "") | (c("component_type") == c("__type"))
    score = matching.match_score(
        c("__visible"), selector, F.coalesce("stable", F.lit(False)), indexed, same_type, F.when(signature != "", signature == c("__sig")), F.when(title != "", title == c("__title")), exact, c("__cover"), c("__picked")
    )
    return both.select(
        binding, "candidate", score.alias("score"), c("__picked").alias("selected"), c("__cover").alias("coverage"), selector.alias("selector"), indexed.alias("indexed"), exact.alias("exact"),
        F.coalesce("derived", F.lit(False)).alias("derived"), c("__selects").alias("selects"), F.coalesce("stable", F.lit(False)).alias("stable"),
    )


def match_sources(bindings: DataFrame, candidates: DataFrame, binding: str = "binding", page: str = "page_key") -> DataFrame:
    """``(binding, status, candidate, candidates, method)`` of each binding: the table it means now. A binding whose page
    shows no table is missing."""
    scored = score_candidates(bindings, candidates, binding, page)
    best = matching.best_match(scored, binding, "candidate", F.col("derived") & F.col("selects"))
    counts = candidates.groupBy(page).agg(F.count("*").alias("candidates"))
    own = bindings.select(binding, page).join(counts, page, "left").join(best, binding, "left")
    how = scored.select(binding, "candidate", F.when(F.col("selector"), F.when(F.col("stable"), "stable-selector").otherwise("selector")).when(F.col("indexed"), "tableIndex").otherwise("scored-candidate").alias("method"))
    return own.join(how, [binding, "candidate"], "left").select(
        binding, F.coalesce("status", F.lit("missing")).alias("status"), "candidate", F.coalesce("candidates", F.lit(0)).alias("candidates"), "method"
    )


def bind_and_validate(bindings: DataFrame, candidates: DataFrame, binding: str = "binding", page: str = "page_key") -> DataFrame:
    """As ``match_sources``, with what is shown for the state, and how the headers of the table found differ from those
    stored (``first_mismatch``: -1 for none, ``missing``, ``added``: counts)."""
    found = match_sources(bindings, candidates, binding, page)
    heads = candidates.select(page, "candidate", F.col("headers").alias("actual"))
    both = found.join(bindings.select(binding, page, F.col("headers").alias("expected")), binding).join(heads, [page, "candidate"], "left")
    diff = matching.header_diff(both)
    label = F.coalesce(*(F.when(F.col("status") == s, F.lit(text)) for s, text in LABELS.items()))
    there = F.col("candidate").isNotNull()
    return diff.select(
        binding, "status", label.alias("label"), "candidate", "candidates", F.when(there, F.col("first_mismatch")).alias("first_mismatch"),
        F.when(there, F.size("missing")).alias("missing"), F.when(there, F.size("added")).alias("added"),
    )
