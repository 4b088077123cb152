"""Personal data by weak supervision, in DataFrame functions only.

Candidates are found by regular expressions; the model learns from those that fail their checks, too. Labelers vote on
each (1 for, -1 against, 0 none): the strict pattern and check digits, a gazetteer, the words and signs before it, its
shape. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is and a pattern's chance to be right; with these as soft
labels a naive Bayes classifier over votes and shape features is trained, which decides on spans beyond the base ones.
Only counts of patterns, whose number is fixed by the labelers, reach the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed. The last two have no base pattern.
KINDS = ("email", "ip", "card", "phone", "secret", "account")
BASE_KINDS = KINDS[:4]

# Each is the contract's pattern, written so that a failed start isn't tried again within the same run of characters
# (a match can't start there, but right after the match before) and long runs need no recursion.
_LOCAL = r"[A-Za-z0-9._%+-]"
_BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EXTRA = {
    # digits and brackets in phone groups, without the international sign
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
    # key=value credentials, key ids, long hexadecimal strings
    "secret": r"(?<![A-Za-z0-9])(?:(?i:password|passwd|pwd|secret|token|api_?key)[=:]\x20?[^\s\x22',;]{6,}+|AKIA[0-9A-Z]{16}|[0-9a-f]{32,}+)(?![A-Za-z0-9])",
    # country code, check digits, account number; 34 characters at most, the last group may be shorter
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20?[0-9A-Z]{4}){7}(?:\x20?[0-9A-Z]{1,2})?|(?:\x20?[0-9A-Z]{4}){2,6}(?:\x20?[0-9A-Z]{1,3})?)(?![A-Za-z0-9])",
}
#: Words before a span that speak for its kind.
_CONTEXT = {
    "email": "mail|contact|write|address", "ip": r"\bip\b|host|server|address|login", "card": "card|visa|credit|pay|amex",
    "phone": "phone|call|tel|mobile|fax|contact", "secret": "key|secret|password|token|credential|login", "account": "iban|account|bank|transfer",
}
#: What speaks against any kind: a number goes on, or something else is named.
_AGAINST = r"[0-9][.,-]?$|\b(?:version|release|isbn|issn|order|invoice|serial|build|sku|item|chapter|section|page)\b"
#: Addresses as mail servers take them: no stray dots, a domain that ends in letters.
_EMAIL = r"^[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$"
#: Gazetteers: top-level domains, leading octets that are no hosts, card issuers, calling codes, countries of accounts.
_DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|it|nl|eu|info|biz"
_ISSUERS = "4|5[1-5]|2[2-7]|34|37|6011|65|35"
_CALLING = "1|7|20|27|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_COUNTRIES = "AD|AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE"
LABELERS = ("regex", "gazetteer", "context", "shape")
#: Characters looked at before a span (back to the match before it at most), and elements of a chunk of ``_before``.
_BEFORE, _CHUNK = 32, 256


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    place = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 1).otherwise(0)
        ),
    )
    return F.aggregate(place, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _checks(account: Column) -> Column:
    """The check digits: the number, its first four characters moved to the end and letters as 10 to 35, is 1 modulo 97."""
    plain = F.translate(account, " ", "")
    moved = F.concat(F.substring(plain, 5, F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    values = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.conv(F.substring(moved, i, F.lit(1)), 36, 10).cast("int"))
    return (F.length(plain) >= 15) & (F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97) == 1)


def _without_words(s: Column) -> Column:
    """An account's span without capitals that only follow it: the longest run of its groups with right check digits."""
    groups = F.split(s["match"], " ")
    runs = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    own = F.coalesce(F.get(F.filter(runs, _checks), F.lit(0)), s["match"])
    after = F.when(own == s["match"], s["after"]).otherwise(" ")
    return F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), (s["start"] + F.length(own)).alias("end"), own.alias("match"),
        s["base"].alias("base"), s["before"].alias("before"), after.alias("after"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, though lambdas within use it for each of their elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each whole number what ``step`` (a sum, a greatest) makes of 0 and all before it. An array that grows is
    copied at each step, so this is done in chunks, then for the chunks: time is all but linear."""
    empty = F.expr("cast(array() as array<int>)")

    def fold(xs: Column) -> Column:
        return F.aggregate(
            xs,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )

    def chunked(xs: Column) -> Column:
        last = F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: fold(F.slice(xs, i * _CHUNK + 1, F.lit(_CHUNK))))

    def joined(parts: Column) -> Column:
        return _let(
            fold(F.transform(parts, lambda c: c["at"]))["out"],
            lambda tops: F.flatten(F.zip_with(parts, tops, lambda c, top: F.transform(c["out"], lambda v: step(top, v)))),
        )

    return _let(values, lambda xs: _let(chunked(xs), joined))


def _passes(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _teaches(kind: str, match: Column) -> Column:
    """Matches that the model learns from, whether they pass or not: a number of the wrong length says nothing."""
    return F.length(_digits(match)).between(12, 19) if kind == "card" else F.lit(True)


_SPAN = "struct<start:int,rank:int,end:int,match:string,base:boolean,before:string,after:string>"


def _spans(text: Column, pattern: str, kind: str, base: bool, loose: bool) -> Column:
    """All matches with their places and what stands around them: the gaps between them, as split gives them, and the
    matches take turns."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def placed(found: Column) -> Column:
        matches, gaps = found["matches"], found["gaps"]
        n = F.size(matches)
        gap = F.slice(gaps, F.lit(1), n)
        starts = _before(F.zip_with(gap, matches, lambda g, m: F.length(g) + F.length(m)), lambda a, x: a + x)
        parts = F.arrays_zip(starts.alias("at"), gap.alias("gap"), matches.alias("match"), F.slice(gaps, F.lit(2), n).alias("next"))
        spans = F.transform(
            parts,
            lambda p: F.struct(
                (p["at"] + F.length(p["gap"])).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                (p["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("end"),
                p["match"].alias("match"),
                (_passes(kind, p["match"]) if base else F.lit(False)).alias("base"),
                F.right(p["gap"], F.lit(_BEFORE)).alias("before"),
                F.left(p["next"], F.lit(1)).alias("after"),
            ),
        )
        if base:
            return F.filter(spans, lambda s: s["base"] | _teaches(kind, s["match"]) if loose else s["base"])
        return F.transform(spans, _without_words) if kind == "account" else spans

    found = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))
    return _let(found, lambda f: F.when(F.size(f["matches"]) > 0, placed(f)).otherwise(none))


def _apart(extra: Column, base: Column) -> Column:
    """The spans that overlap no base span: in order of where bases start and others end, no base before one of the
    others may end after that one's start."""
    begins = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("end"), b.alias("span")))
    others = F.transform(extra, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("base"), F.lit(0).alias("end"), s.alias("span")))

    def kept(events: Column) -> Column:
        ends = _before(F.transform(events, lambda e: e["end"]), lambda a, x: F.greatest(a, x))
        both = F.zip_with(events, ends, lambda e, end: F.struct(e["base"].alias("base"), end.alias("until"), e["span"].alias("span")))
        return F.transform(F.filter(both, lambda x: (x["base"] == 0) & (x["until"] <= x["span"]["start"])), lambda x: x["span"])

    return F.when((F.size(extra) == 0) | (F.size(base) == 0), extra).otherwise(_let(F.array_sort(F.concat(begins, others)), kept))


_NEEDS = {"email": "@", "phone": "+"}


def candidates(documents: DataFrame, text_col: str, keep: list[str], loose: bool = False) -> DataFrame:
    """``keep`` columns, the text as ``__text`` ('' for null) and ``__spans``, base spans first in order, then others
    that overlap no base span. ``loose``: base patterns' matches that fail their checks are there, too."""
    text = F.col("__text")
    source = documents.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    has_digit = text.rlike("[0-9]")

    def found(kind: str, pattern: str, base: bool) -> Column:
        sign = _NEEDS.get(kind) if base else None
        possible = F.contains(text, F.lit(sign)) if sign else has_digit
        return F.when(possible, _spans(text, pattern, kind, base, loose)).otherwise(none)

    bases = source.withColumn("__base", F.array_sort(F.concat(*(found(k, _BASE[k], True) for k in BASE_KINDS))))
    both = bases.withColumn("__extra", F.concat(*(found(k, p, False) for k, p in _EXTRA.items())))
    return both.withColumn("__spans", F.concat("__base", F.array_sort(_apart(F.col("__extra"), F.col("__base"))))).drop("__base", "__extra")


def _by_kind(rank: Column, of: dict[str, Column], other: Column) -> Column:
    out = other
    for kind, value in of.items():
        out = F.when(rank == KINDS.index(kind), value).otherwise(out)
    return out


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)


def voted(spans: Column) -> Column:
    """Each span with its labelers' votes and its features."""

    def one(s: Column) -> Column:
        match, rank = s["match"], s["rank"]
        before, after = F.lower(s["before"]), s["after"]
        digits = _digits(match)
        strict = _by_kind(rank, {"email": match.rlike(_EMAIL), "account": _checks(match)}, s["base"])
        regex = F.when(strict, 1).when(
            _by_kind(rank, {"phone": ~match.startswith("+") & F.length(digits).between(9, 12), "secret": F.lit(True)}, F.lit(False)), 0
        ).otherwise(-1)
        gazetteer = _by_kind(
            rank,
            {
                "email": _vote(match.rlike(rf"\.(?:{_DOMAINS})$"), ~match.rlike(r"\.[A-Za-z]{2,}$")),
                "ip": _vote(match.rlike(r"^(?:10|192|172|127)\."), match.rlike(r"^(?:0|2[4-5][0-9])\.")),
                "card": _vote(digits.rlike(f"^(?:{_ISSUERS})"), digits.rlike("^0")),
                "phone": _vote(digits.rlike(f"^(?:{_CALLING})"), digits.rlike("^0000")),
                "secret": _vote(match.rlike("^AKIA|(?i:password|passwd|pwd|secret|token|key)")),
                "account": _vote(match.rlike(f"^(?:{_COUNTRIES})"), F.lit(True)),
            },
            F.lit(0),
        )
        context = _vote(_by_kind(rank, {k: before.rlike(w) for k, w in _CONTEXT.items()}, F.lit(False)), before.rlike(_AGAINST))
        shape = _by_kind(
            rank,
            {
                "email": _vote(match.rlike(r"^[A-Za-z0-9]") & (F.length(match) <= 64), match.rlike(r"\.\.|^[._%+-]")),
                "ip": _vote(match.rlike(r"^[1-9]") & ~match.rlike(r"\.0[0-9]")),
                "card": _vote(F.length(digits).isin(15, 16), digits.rlike(r"^([0-9])\1+$")),
                "phone": _vote(match.rlike(r"[\x20().-]"), digits.rlike(r"([0-9])\1{6}")),
                "secret": _vote(match.rlike("[0-9]") & match.rlike("[A-Za-z]"), ~match.rlike("[0-9]")),
                "account": _vote(match.rlike("[0-9]{6}"), ~match.rlike("[0-9]{4}")),
            },
            F.lit(0),
        )
        size = F.when(F.length(match) < 12, 0).when(F.length(match) < 20, 1).when(F.length(match) < 40, 2).otherwise(3)
        edge = F.when(before.rlike(r"^$|[\s(\[<]$") & after.rlike(r"^$|[\s)\],.;:>]"), 0).when(after.rlike(r"[\x22']"), 1).otherwise(2)
        return F.struct(
            s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), s["base"].alias("base"),
            regex.alias("regex"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"), size.alias("size"), edge.alias("edge"),
        )

    return F.transform(spans, one)


_SEEN = ("rank", *LABELERS, "size", "edge")


class SpanModel:
    """Reliabilities by EM, and the classifier's log-odds; both from counts of patterns."""

    def __init__(self, patterns: list[tuple[tuple, int]], rounds: int = 50):
        self.reliability: dict = {}
        self.weights: dict = defaultdict(dict)
        self.prior: dict = {}
        for rank in sorted({p[0] for p, _ in patterns}):
            self._fit(rank, [(p, n) for p, n in patterns if p[0] == rank], rounds)

    def _fit(self, rank: int, rows: list[tuple[tuple, int]], rounds: int) -> None:
        total = sum(n for _, n in rows)
        share, right = 0.5, [[0.7, 0.7] for _ in LABELERS]  # a labeler's chance to vote right, for true and false spans
        chance = {}
        for _ in range(rounds):
            for p, _ in rows:
                yes, no = math.log(share), math.log(1 - share)
                for v, (a, b) in zip(p[1:], right):
                    if v:
                        yes += math.log(a if v > 0 else 1 - a)
                        no += math.log(1 - b if v > 0 else b)
                chance[p] = 1 / (1 + math.exp(min(50, no - yes)))
            true = sum(n * chance[p] for p, n in rows)
            share = min(0.98, max(0.02, (true + 1) / (total + 2)))
            for k in range(len(LABELERS)):
                hit = [sum(n * chance[p] for p, n in rows if p[1 + k] == v) for v in (1, -1)]
                miss = [sum(n * (1 - chance[p]) for p, n in rows if p[1 + k] == v) for v in (1, -1)]
                # priors of some votes keep a labeler better than chance
                right[k] = [(hit[0] + 7) / (sum(hit) + 10), (miss[1] + 7) / (sum(miss) + 10)]
        self.reliability[KINDS[rank]] = dict(zip(LABELERS, right))
        self.prior[rank] = math.log(share / (1 - share))
        for k, name in enumerate(_SEEN[1:], 1):
            yes, no = defaultdict(float), defaultdict(float)
            for p, n in rows:
                yes[p[k]] += n * chance[p]
                no[p[k]] += n * (1 - chance[p])
            kinds = len(yes)
            for v in yes:
                # votes that say nothing weigh nothing
                self.weights[rank, name][v] = (
                    math.log((yes[v] + 1) / (sum(yes.values()) + kinds)) - math.log((no[v] + 1) / (sum(no.values()) + kinds)) if v or name not in LABELERS else 0.0
                )

    def log_odds(self, s: Column) -> Column:
        out = F.lit(-1.0)
        for rank, prior in self.prior.items():
            value = F.lit(prior)
            for name in _SEEN[1:]:
                part = F.lit(0.0)
                for v, w in self.weights[rank, name].items():
                    part = F.when(s[name] == v, w).otherwise(part)
                value = value + part
            out = F.when(s["rank"] == rank, value).otherwise(out)
        return out


def fit(documents: DataFrame, text_col: str = "text") -> SpanModel:
    """From the vote patterns of all candidates of all documents, those that fail a base kind's checks among them. No
    documents or candidates give a model that adds no span."""
    found = candidates(documents, text_col, [], loose=True)
    s = found.select(F.explode(voted(F.col("__spans"))).alias("s"))
    counted = s.groupBy(*(F.col(f"s.{c}").alias(c) for c in _SEEN)).count()
    return SpanModel(sorted((tuple(r)[:-1], r["count"]) for r in counted.collect()))  # at most kinds x votes x features


def detect(documents: DataFrame, model: SpanModel, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the text as ``__text``, and ``__base`` and ``__spans``: arrays of ``(start, rank, end)`` in
    order of start, then kind; places in code points, end exclusive. Base spans always stay; of the others those with
    log odds over 0. Null text counts as empty. Repeated rows stay. No shuffle."""
    found = candidates(documents, text_col, list(keep)).withColumn("__voted", voted(F.col("__spans")))
    place = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    return found.select(
        *(F.col(f"`{c}`") for c in keep),
        "__text",
        F.transform(F.filter("__voted", lambda s: s["base"]), place).alias("__base"),
        F.array_sort(F.transform(F.filter("__voted", lambda s: s["base"] | (model.log_odds(s) > 0)), place)).alias("__spans"),
    )


def _listed(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame, model: SpanModel, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans``, a row for each document."""
    found = detect(documents, model, text_col, keep)

    def count(rank: int) -> Column:
        return F.size(F.filter("__base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    counts = [count(k) for k in range(len(BASE_KINDS))]
    return found.select(*(F.col(f"`{c}`") for c in keep), *counts, F.sha2(_listed("__base"), 256).alias("base_sha256"), _listed("__spans").alias("spans"))


def redact(documents: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """The documents with each run of overlapping spans replaced by its first kind in brackets; a null text stays null."""
    others = [c for c in documents.columns if c != text_col]
    found = detect(documents, model, text_col, [*others, text_col])
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut(x: Column) -> Column:
        """Each span with the end of all before it: what lies between stays, a span that begins later is named."""
        chars, spans = x["chars"], x["spans"]
        until = _before(F.transform(spans, lambda s: s["end"]), lambda a, e: F.greatest(a, e))
        pieces = F.zip_with(
            spans,
            until,
            lambda s, at: F.when(s["start"] < at, "").otherwise(
                F.concat(F.array_join(F.slice(chars, at + 1, s["start"] - at), ""), F.element_at(names, s["rank"] + 1))
            ),
        )
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.array_join(F.concat(pieces, F.array(F.array_join(F.slice(chars, last + 1, F.size(chars)), ""))), "")

    redacted = _let(F.struct(F.split(F.col("__text"), "").alias("chars"), F.col("__spans").alias("spans")), cut)
    new = F.when(F.size("__spans") == 0, F.col(text_col)).otherwise(redacted).alias(text_col)
    return found.select(*(new if c == text_col else F.col(f"`{c}`") for c in documents.columns))
