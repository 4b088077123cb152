"""Token counts of whole texts by overlap resynchronisation.

A text of more than one window is encoded in overlapping windows with offsets. Two neighbours are spliced at a place in their overlap
that both have as a token boundary and that is proven stable: it lies at white space, which this kind of tokenizer
never joins across, so neither window's cut ends can have changed the tokens on the other side. Where an overlap has
no such place it is doubled, up to the whole rest of the text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import map_texts
from .tokenize import UnitEncoder

#: Characters of a window, the only length that matters: a text of more is spliced.
WINDOW_CHARS = 8192
OVERLAP_CHARS = 128

#: Characters at which the tokenizer surely cuts.
_SPACE = frozenset(" \t\n\r\x0b\x0c")


def spliced(text: str, encode: Callable[[str], tuple[list[int], list[tuple[int, int]]]], window: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """All ids of ``text``. ``encode`` gives ids and their (start, end) offsets."""
    ids: list[int] = []
    start = done = 0  # the window's start; up to where ids are final
    while True:
        end = min(len(text), start + window)
        got, spans = encode(text[start:end])
        keep_from = next((k for k, (s, _) in enumerate(spans) if start + s >= done), len(got))
        if end == len(text):
            return ids + got[keep_from:]
        wide = overlap
        while True:
            low = max(start + 1, end - wide)
            ahead, ahead_spans = encode(text[low : min(len(text), end + wide)])
            ends = {low + e for _, e in ahead_spans} | {low + s for s, _ in ahead_spans}
            ours = {start + e for _, e in spans} | {start + s for s, _ in spans}
            # the last white space that both windows see and after which both begin a token (or have none)
            cut = next((p for p in range(end - 1, max(low, done), -1) if text[p - 1] in _SPACE and text[p] not in _SPACE and p in ours and p in ends), None)
            if cut is not None:
                break
            if low == start + 1 and end + wide >= len(text):
                rest, rest_spans = encode(text[start:])
                k = next((k for k, (s, _) in enumerate(rest_spans) if start + s >= done), len(rest))
                return ids + rest[k:]
            wide *= 2
            if low == start + 1:  # the whole window holds no place: it grows
                end = min(len(text), end + wide)
                got, spans = encode(text[start:end])
        ids += [i for k, (i, (s, _)) in enumerate(zip(got, spans)) if k >= keep_from and start + s < cut]
        start = done = cut


def count_tokens(documents: DataFrame, path: str, text_col: str = "text", keep: list[str] = ("doc_id",), limit: int = 2048, window: int = WINDOW_CHARS) -> DataFrame:
    """``keep`` columns, ``n_bytes, n_tokens, over_limit``, a row for each document; no shuffle.

    Null and empty texts have no bytes and no tokens. A text without white space is encoded whole, however long.
    Repeated rows stay."""

    def start():
        encoder = UnitEncoder(path)

        def encode(part):
            e = encoder.tokenizer.encode(part, add_special_tokens=False)
            return e.ids, e.offsets

        def work(texts):
            texts = pc.fill_null(texts, "")
            big = pc.greater(pc.utf8_length(texts), window)
            _, counts = encoder.batch(pc.if_else(big, "", texts), counts_only=True)
            for k in np.flatnonzero(big.to_numpy(zero_copy_only=False)):
                counts[k] = len(spliced(texts[int(k)].as_py(), encode, window))
            return pc.binary_length(texts).cast("int64"), counts

        return work

    out = map_texts(documents, text_col, list(keep), [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], start)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
