"""URL filter over a sorted digest array.

Rules are strings ``host/path``. Their 64-bit xxhash keys lie sorted in one ``.npy`` file that workers memory-map;
a url's candidate rules (every suffix of its host with every rule-length prefix of its path) are hashed and probed
with one vectorised binary search a batch, and a hit counts only if the full stored string is equal.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches

#: (host, path, verdict) of the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


class DigestArray:
    """Sorted xxhash64 keys (memory-mapped), with the rule strings and verdicts in the same order."""

    PARTS = ("keys.npy", "starts.npy", "rules.bin", "block.npy", "path_lengths.npy", "labels.npy")

    def __init__(self, prefix: str):
        self.keys = np.load(f"{prefix}_keys.npy", mmap_mode="r")
        self.starts = np.load(f"{prefix}_starts.npy", mmap_mode="r")
        self.blob = np.memmap(f"{prefix}_rules.bin", dtype="uint8", mode="r") if self.starts[-1] else np.zeros(0, "uint8")
        self.block = np.load(f"{prefix}_block.npy", mmap_mode="r")
        self.lengths = np.load(f"{prefix}_path_lengths.npy").tolist()
        self.labels = int(np.load(f"{prefix}_labels.npy"))

    @staticmethod
    def write(rules: Sequence[tuple[str, str, str]], prefix: str) -> None:
        rows = sorted(
            {f"{h.lower()}{p}": v for h, p, v in rules}.items(), key=lambda kv: (xxhash.xxh64_intdigest(kv[0]), kv[0])
        )
        texts = [k.encode() for k, _ in rows]
        np.save(f"{prefix}_keys.npy", np.array([xxhash.xxh64_intdigest(t) for t in texts], "uint64"))
        np.save(f"{prefix}_starts.npy", np.cumsum([0, *map(len, texts)]))
        with open(f"{prefix}_rules.bin", "wb") as f:
            f.write(b"".join(texts))
        np.save(f"{prefix}_block.npy", np.array([v == "block" for _, v in rows], bool))
        np.save(f"{prefix}_path_lengths.npy", np.array(sorted({len(p) for _, p, _ in rules}), "int64"))
        np.save(f"{prefix}_labels.npy", np.int64(max([h.count(".") + 1 for h, _, _ in rules] or [0])))

    def find(self, texts: list[str]) -> np.ndarray:
        """The row of each text's rule, -1 if there is none."""
        if not texts or not len(self.keys):
            return np.full(len(texts), -1)
        raw = [t.encode() for t in texts]
        keys = np.array([xxhash.xxh64_intdigest(t) for t in raw], "uint64")
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(texts), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:  # equal digests stand together
                if self.blob[self.starts[k] : self.starts[k + 1]].tobytes() == raw[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def candidates(self, host: str, path: str) -> list[str]:
        """Longest first; of equally long ones, the longer host first."""
        labels = host.split(".")
        hosts = [".".join(labels[i:]) for i in range(max(0, len(labels) - self.labels), len(labels))]
        return sorted((h + path[:n] for h in hosts for n in self.lengths if n <= len(path)), key=len, reverse=True)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[end:]
    host = rest[:end].encode().lower().decode()
    return host, tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow"
) -> DataFrame:
    """``(id, host, path, rule, verdict)``, a row for each page. The longest fitting rule decides (the longer host on
    a tie); without one, rule is null and the verdict ``default``. A null url has empty host and path and the default.
    Repeated rows stay; an empty table gives no rows. The driver hands the digest files to the executors with ``addFile``; all
    workers of a host map one copy."""
    spark = pages.sparkSession
    small_batches(spark)
    prefix = os.path.join(tempfile.mkdtemp(prefix="spark-"), uuid.uuid4().hex)
    DigestArray.write(rules, prefix)
    for part in DigestArray.PARTS:
        spark.sparkContext.addFile(f"{prefix}_{part}")
    name = os.path.basename(prefix)

    def run(batches):
        index = DigestArray(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            wanted = [index.candidates(h, p) if h else [] for h, p in parts]
            flat = [c for w in wanted for c in w]
            hits, rule, verdict, k = index.find(flat), [], [], 0
            for w in wanted:
                best = next((j for j in range(k, k + len(w)) if hits[j] >= 0), None)
                rule.append(None if best is None else flat[best])
                verdict.append(default if best is None else "block" if index.block[hits[best]] else "allow")
                k += len(w)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(url_col).alias("__url")).mapInArrow(
        run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string"
    )
