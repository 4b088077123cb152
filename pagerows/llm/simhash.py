"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most two bits agree, in one of their two 32-bit segments, but for at most one bit. So
each distinct fingerprint is indexed under its two segments and under each segment with one bit made a wildcard; equal
keys are joined and the pair's whole distance verified. Under a wildcard only fingerprints that hold 0 there meet
those that hold 1, so a pair that is equal in a segment meets once there, not once for each wildcard.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut, map_texts
from .components import connected_components

SEED, SHINGLE, BITS = 42, 3, 2


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set where more than half the shingles' hashes have it. No words: 0."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "uint64")
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), "uint64", len(words) - shingle + 1)
    ones = np.zeros(64, "int64")
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp`` (the 64 bits as a signed long). A null or wordless text has 0."""

    def start():
        def work(texts):
            return (np.array([fingerprint(t, shingle) for t in texts.to_pylist()], "uint64").view("int64"),)

        return work

    return map_texts(documents, text_col, list(keep), [T.StructField("fp", T.LongType())], start)


def near_pairs(distinct: DataFrame) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``, pairs of fingerprints that differ in one or two bits; each once or more."""
    segments = ("fp & 4294967295L", "shiftrightunsigned(fp, 32)")

    def keyed(bit: int) -> DataFrame:
        """A key: segment number, wildcard (32: none) and the segment with the wildcard's bit cleared."""
        keys = []
        for s, value in enumerate(segments):
            keys.append(f"array(named_struct('slot', {s * 64 + 32}, 'value', {value}))")
            keys.append(
                f"transform(filter(sequence(0, 31), p -> (shiftright({value}, p) & 1L) = {bit}), "
                f"p -> named_struct('slot', {s * 64} + p, 'value', {value} & ~shiftleft(1L, p)))"
            )
        exploded = distinct.select("fp", F.expr(f"explode(concat({', '.join(keys)}))").alias("k"))
        return exploded.select("k.slot", "k.value", F.col("fp").alias("ab"[bit]))

    zero, one = keyed(0), keyed(1)
    wildcard = F.col("slot").bitwiseAND(F.lit(32)) == 0
    joined = zero.join(one, ["slot", "value"]).where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS) & (wildcard | (F.col("a") < F.col("b"))))
    return joined.select("a", "b")


def simhash_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fingerprint, component_id)``, a row for each document.

    Documents with equal fingerprints count as linked, whatever their number, without pairs between them; null and
    wordless texts have fingerprint 0 and link like others. A row with a null id has a fingerprint, a null component
    and no links. Repeated rows stay. The least id of a component names it."""
    return grouped(documents, [id_col], id_col, text_col, shingle).select(
        id_col,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"),
    )


def grouped(documents: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns (the id among them), ``fp``, and the component's ``root`` and least id: two components can have
    the same least id where texts share one. For rows with a null id neither means anything."""
    prints = cut(fingerprints(documents, text_col, keep, shingle))
    classes = cut(prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected_components(near_pairs(classes.select("fp")).select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(placed.join(names, "root").select(F.col("fp").alias("__fp"), "root", "component_id"))
    return prints.join(named, prints["fp"] == named["__fp"], "left").drop("__fp")
