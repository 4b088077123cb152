"""Derived columns: selected cells of each row go, once for each different content, to a scorer in batches; what it
concludes is checked, cached and set beside every row with that content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shared import cut
from .catalog import results_of
from .folds import ordered_fold

#: Most selected columns, most rows of a batch, rows of a preview, characters of a conclusion, default, method and version.
MOST_COLUMNS, MOST_ROWS, PREVIEW_ROWS, MOST_CHARS = 10, 20, 1000, 1000
DEFAULT_METHOD = "根据所选字段识别异常、风险、矛盾和值得关注的业务事项，并为每条数据生成简短明确的结论。"
DEFAULT_VERSION = 1
#: Fixed texts of a request.
_OPENING = ("你正在执行按列分析测试预览。", "请逐条阅读输入数据，只输出 JSON，不要输出解释、Markdown、标题或额外文本。")
_RULES = (
    "返回格式必须是：",
    '{"results":[{"fingerprint":"sha256:...","conclusion":"结论","needsAttention":true}]}',
    "要求：",
    "1. 必须按 fingerprint 返回结果；",
    "2. 不得返回未知 fingerprint；",
    "3. 每个 fingerprint 只能出现一次；",
    "4. 若无法判断，也请给出简短结论，不要留空；",
    "5. needsAttention 为 true 表示结论需要用户关注（如风险、异常、待处理），false 表示无需关注；",
)

Scorer = Callable[[DataFrame], DataFrame]


def distinct_selections(columns: Column) -> Column:
    """Selected columns (array of header, occurrence): blank headers go, of equal ones the first stays, ten at most."""
    named = F.transform(
        columns,
        lambda s: F.struct(
            tx.one_line(s["header"]).alias("header"), tx.norm_header(s["header"]).alias("name"), F.when(s["occurrence"] > 0, s["occurrence"].cast("int")).otherwise(1).alias("occurrence")
        ),
    )
    key = lambda s: F.struct(s["name"], s["occurrence"])
    first = lambda filled: tx.let(F.transform(filled, key), lambda keys: F.filter(filled, lambda s, i: F.array_position(keys, key(s)) == i + 1))
    return F.slice(tx.let(F.filter(named, lambda s: s["name"] != ""), first), 1, MOST_COLUMNS)


def selected_indexes(selected: Column, headers: Column) -> Column:
    """Where each selection (name, occurrence) stands among the headers; null where it is missing."""
    return places_among(selected, F.transform(headers, tx.norm_header))


def places_among(selected: Column, names: Column) -> Column:
    """The same among headers that are normalised."""
    places = F.transform(names, lambda h, i: F.struct(h.alias("name"), i.alias("i")))
    return tx.let(places, lambda all_: F.transform(selected, lambda s: F.get(F.filter(all_, lambda p: p["name"] == s["name"]), s["occurrence"] - 1)["i"]))


def effective_method(method: Column, version: Column) -> Column:
    """``(description, version, used_default)``: a blank method means the default one, whose version counts then."""
    own = F.regexp_replace(F.coalesce(method, F.lit("")), r"^\s+|(?<!\s)\s+$", "")
    blank = own == ""
    return F.struct(
        F.when(blank, DEFAULT_METHOD).otherwise(own).alias("description"),
        F.when(blank, F.greatest(F.coalesce(version, F.lit(DEFAULT_VERSION)), F.lit(1))).alias("version"),
        blank.alias("used_default"),
    )


def analysis_fingerprint(
    skill: Column, revision: Column, source: Column, selected: Column, method: Column, version: Column, model: Column, schema: Column, max_chars: Column, name: Column, position: Column
) -> Column:
    """Digest of all that a result depends on, as JSON with sorted keys; a number that is missing is null."""
    text = tx.fingerprint_text(method)
    blank = text == ""
    payload = F.struct(
        text.alias("analysisMethod"),
        F.when(blank, F.greatest(F.coalesce(version, F.lit(DEFAULT_VERSION)), F.lit(1))).alias("defaultMethodVersion"),
        F.trim(model).alias("modelId"),
        F.struct(F.trim(name).alias("columnName"), F.greatest(max_chars, F.lit(1)).alias("maxChars"), F.trim(position).alias("position")).alias("output"),
        F.greatest(schema, F.lit(1)).alias("resultSchemaVersion"),
        F.transform(selected, lambda s: F.struct(s["name"].alias("normalizedHeader"), s["occurrence"].alias("occurrence"))).alias("selectedColumns"),
        F.trim(skill).alias("skillId"),
        F.greatest(revision, F.lit(0)).alias("skillRevision"),
        F.trim(source).alias("sourceId"),
    )
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256))


def json_text(c: Column) -> Column:
    """A text as JSON writes it."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def batch_budget(method: Column, window: Column, max_output: Column, max_chars: Column, reserve: int = 512) -> tuple[Column, Column]:
    """Tokens that a batch's rows may cost, and rows whose answers fit the output (an answer is reckoned at 160
    characters at most)."""
    history = 2 + 4 + tx.estimate_tokens(F.coalesce(method, F.lit("")))
    free = tx.context_budget(F.greatest(window, F.lit(8192)), F.greatest(max_output, F.lit(512)), history, reserve)
    answer = 35 + F.greatest(F.lit(40), F.least(F.lit(160), max_chars))  # its JSON, of ASCII but for the conclusion, and 8
    rows = F.floor((F.greatest(max_output, F.lit(512)) - 20) / answer)
    return F.greatest(F.lit(2000), F.floor(free * 0.9)), F.least(F.lit(MOST_ROWS), F.greatest(F.lit(1), rows)).cast("int")


def row_cost(fingerprint: Column, content: Column) -> Column:
    return tx.let(F.to_json(F.struct(fingerprint.alias("fingerprint"), content.alias("content"))), tx.estimate_tokens) + 8


def derived_prompt(rows: Column, method: Column, max_chars: Column) -> Column:
    """The request for a batch (array of fingerprint, content)."""
    one = lambda r: F.concat(
        F.lit('    {\n      "fingerprint": '), json_text(r["fingerprint"]), F.lit(',\n      "content": '), json_text(r["content"]), F.lit("\n    }")
    )
    payload = F.concat(F.lit('{\n  "rows": [\n'), F.array_join(F.transform(rows, one), ",\n"), F.lit("\n  ]\n}"))
    parts = [
        *map(F.lit, _OPENING), F.concat(F.lit("分析方法："), method), F.concat(F.lit("单条结论要求：简短明确，不超过 "), max_chars.cast("string"), F.lit(" 个字符。")),
        *map(F.lit, _RULES), F.concat(F.lit("输入数据：\n"), payload),
    ]
    return F.array_join(F.array(*parts), "\n\n")


def batches(pending: DataFrame, group: str, order: list, shards: int = 64) -> DataFrame:
    """Adds ``batch``: rows of a group in order, as many to a batch as its budget (columns ``budget``, ``most``) lets in,
    one at least. A group is cut into shards first, so that a large one is no single task's work."""
    sharded = pending.withColumn("__shard", F.concat_ws("\x1f", F.col(group).cast("string"), F.pmod(F.xxhash64("fingerprint"), F.lit(shards)).cast("string")))

    def step(state, cost, budget, most):
        number, used, rows = state
        if rows and (used + cost > budget or rows >= most):
            number, used, rows = number + 1, 0, 0
        return (number, used + cost, rows + 1), number

    cost = row_cost(F.col("fingerprint"), F.col("content"))
    inputs = {"cost": cost, "budget": F.col("budget").cast("long"), "most": F.col("most").cast("long")}
    numbered = ordered_fold(sharded, "__shard", order, inputs, "__n", "int64", lambda: (0, 0, 0), step)
    return numbered.withColumn("batch", F.concat_ws("\x1f", "__shard", F.col("__n").cast("string"))).drop("__shard", "__n")


def score_rows(pending: DataFrame, scorer: Scorer, attempt: int, shards: int = 64) -> DataFrame:
    """``(analysis, fingerprint, status, conclusion, truncated, needs_attention)`` of pending contents (analysis,
    fingerprint, content, first, method, max_chars, budget, most). The scorer gets a row for each batch (batch, rows,
    prompt, attempt) and returns (batch, answer). What its answers hold is written before it is used: it is asked once."""
    return _scored(pending, scorer, attempt, shards).select("analysis", "fingerprint", "status", "conclusion", "truncated", "needs_attention")


def _scored(pending: DataFrame, scorer: Scorer, attempt: int, shards: int) -> DataFrame:
    """The same with the columns of ``pending``. Batches are written once and judged as wholes: a batch's contents and its
    answer's results meet in one row, of ``most`` contents at most."""
    c = F.col
    placed = batches(pending, "analysis", ["first", "fingerprint"], shards)
    row = F.struct("first", "fingerprint", "content", "max_chars")
    once = [F.first(x).alias(x) for x in ("method", "max_chars", "budget", "most")]
    asked = cut(placed.groupBy("batch", "analysis").agg(F.array_sort(F.collect_list(row)).alias("r"), *once))
    rows = F.transform("r", lambda x: F.struct(x["fingerprint"].alias("fingerprint"), x["content"].alias("content")))
    sent = asked.select("batch", rows.alias("rows"), "method", "max_chars").withColumn("attempt", F.lit(attempt))
    scored = scorer(sent.withColumn("prompt", derived_prompt(c("rows"), c("method"), c("max_chars"))))
    answers = cut(scored.select("batch", results_of(c("answer")).alias("__r"))).groupBy("batch").agg(F.flatten(F.collect_list("__r")).alias("results"))
    both = asked.join(answers, "batch", "left")
    names = F.transform("results", lambda r: r["fingerprint"])
    # the first result with a content's fingerprint counts, as in ``validate_results``
    found = tx.let(names, lambda n: F.transform("r", lambda x: F.struct(x.alias("x"), F.get("results", (F.array_position(n, x["fingerprint"]) - 1).cast("int")).alias("got"))))
    each = both.select("analysis", "method", "budget", "most", F.explode(found).alias("__f")).select("analysis", "method", "budget", "most", "__f.x.*", "__f.got")
    said = each.withColumn("__c", F.trim("got.conclusion"))
    status = F.when(c("got.fingerprint").isNull(), "missing").when(F.coalesce("__c", F.lit("")) == "", "blank").otherwise("ok")
    ok = c("status") == "ok"
    judged = said.withColumn("status", status).withColumn("__held", F.when(ok, F.left("__c", F.lit(MOST_CHARS))))
    cut_off = (ok & (F.length("__c") > MOST_CHARS)) | (F.length("__held") > c("max_chars"))
    return judged.select(
        *pending.columns, "status", F.left("__held", c("max_chars")).alias("conclusion"), cut_off.alias("truncated"), (ok & F.coalesce("got.needsAttention", F.lit(False))).alias("needs_attention")
    )


def retry_set(requested: DataFrame, resolved: DataFrame, keys: list[str], attempts: Column | None = None, most: int = 1) -> DataFrame:
    """What was requested, isn't resolved, and may be tried again."""
    left = requested.join(resolved.select(*keys).distinct(), keys, "left_anti")
    return left if attempts is None else left.where(attempts < most)


def contents(definitions: DataFrame, tables: DataFrame, rows: DataFrame, few: bool = True) -> DataFrame:
    """Rows (table, row_pos, cells) of each analysis on their table, with ``fingerprint``, ``content`` and ``missing`` (a
    selected column isn't there; such rows have neither). Definitions: (analysis, table, selected, ...); where they are
    ``few``, they go to all rows, so that rows of few tables aren't few tasks' work."""
    chosen = definitions.withColumn("__s", distinct_selections(F.col("selected"))).join(tables, "table")
    placed = chosen.withColumn("indexes", selected_indexes(F.col("__s"), F.col("headers")))
    placed = placed.withColumn("missing", (F.size("indexes") == 0) | F.exists("indexes", lambda i: i.isNull())).drop("selected")
    each = rows.join(F.broadcast(placed) if few else placed, "table")
    values = F.transform("indexes", lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    able = each.withColumn("values", F.when(~F.col("missing"), values))
    named = F.transform("__s", lambda s: s["header"])
    return able.withColumn("fingerprint", tx.row_fingerprint(F.col("values"))).withColumn("content", tx.row_markdown(named, F.col("values"))).drop("__s", "values")


def derive_column(
    definitions: DataFrame, tables: DataFrame, rows: DataFrame, cache: DataFrame, scorer: Scorer, now: int, ttl_ms: int = 7_200_000, window: int = 64_000, max_output: int = 4096, shards: int = 64, few: bool = True
) -> tuple[DataFrame, DataFrame]:
    """A conclusion beside each row, and the cache's new entries.

    Definitions: (analysis, table, selected, method, max_chars, column_name, position, position_index). Each different
    content of an analysis is looked up in the cache (analysis, fingerprint, conclusion, created_at), else scored; what
    fails is tried once more. Rows come back with the derived cell put in, ``conclusion`` and ``status``: ``complete``,
    ``error`` (the scorer gave nothing valid) or ``missing-column``. Repeated rows stay; contents are joined by
    fingerprint, of which a frequent one is scored once."""
    ready = contents(definitions, tables, rows, few)
    budget, most = batch_budget(F.col("method"), F.lit(window), F.lit(max_output), F.col("max_chars"))
    described = effective_method(F.col("method"), F.lit(DEFAULT_VERSION))["description"]
    unique = ready.where(~F.col("missing")).groupBy("analysis", "fingerprint").agg(F.min("row_pos").alias("first"), F.first("content").alias("content"))
    asked = definitions.select("analysis", described.alias("method"), "max_chars", budget.alias("budget"), most.alias("most"))
    live = F.col("created_at").isNotNull() & (F.lit(now) - F.col("created_at") <= max(60_000, ttl_ms)) & (F.trim("conclusion") != "")
    hits = cache.where(live).groupBy("analysis", "fingerprint").agg(F.max_by("conclusion", "created_at").alias("conclusion"))
    pending = retry_set(unique, hits, ["analysis", "fingerprint"]).join(F.broadcast(asked) if few else asked, "analysis")
    first = _scored(pending, scorer, 0, shards)
    good = first.where("status = 'ok'")
    again = _scored(first.where("status <> 'ok'").select(pending.columns), scorer, 1, shards).where("status = 'ok'")
    fresh = good.unionByName(again)
    new = fresh.select("analysis", "fingerprint", "conclusion", "needs_attention", F.lit(now).cast("long").alias("created_at"))
    results = hits.unionByName(fresh.select("analysis", "fingerprint", "conclusion"))
    # rows without a fingerprint meet nothing, and are dealt over all tasks
    spread = ready.withColumn("__k", F.coalesce("fingerprint", F.concat(F.lit("-"), F.xxhash64("row_pos").cast("string"))))
    joined = spread.join(results.withColumnRenamed("fingerprint", "__k"), ["analysis", "__k"], "left").drop("__k")
    at = tx.insert_index(F.col("indexes"), F.col("position"), F.col("position_index"))
    cell = F.coalesce("conclusion", F.lit(""))
    status = F.when(F.col("missing"), "missing-column").when(F.col("conclusion").isNotNull(), "complete").otherwise("error")
    out = joined.withColumn("status", status).withColumn("at", F.least(at, F.size("headers")))
    put = lambda c, x: F.concat(F.slice(c, F.lit(1), F.col("at")), F.array(x), F.slice(c, F.col("at") + 1, F.greatest(F.size(c) - F.col("at"), F.lit(0))))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.size("headers") - F.size("cells"), F.lit(0))))
    return out.select(
        "analysis", "table", "row_pos", put(F.col("headers"), F.col("column_name")).alias("headers"), put(padded, cell).alias("cells"), "fingerprint", "conclusion", "status"
    ), new


def preview_rows(ready: DataFrame, limit: int = PREVIEW_ROWS, unique: int = MOST_ROWS) -> DataFrame:
    """Of an analysis' first ``limit`` rows those whose content is among the first ``unique`` different ones."""
    from .rows import submitted_rows, top_rows

    first = top_rows(ready, ["analysis"], [F.col("row_pos")], limit)
    contents = first.groupBy("analysis", "fingerprint").agg(F.min("row_pos").alias("first"))
    sent = top_rows(contents, ["analysis"], [F.col("first")], unique)
    return submitted_rows(first, sent, ["analysis", "fingerprint"])


def analysis_status(rows: DataFrame) -> DataFrame:
    """``(analysis, status, n_complete, n_rows)``: complete, partial, or error where no row has a conclusion."""
    done = F.count_if(F.col("status") == "complete")
    counted = rows.groupBy("analysis").agg(done.alias("n_complete"), F.count("*").alias("n_rows"))
    status = F.when(F.col("n_complete") == F.col("n_rows"), "complete").when(F.col("n_complete") > 0, "partial").otherwise("error")
    return counted.select("analysis", status.alias("status"), "n_complete", "n_rows")
