"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda (heap) of adjacent symbol pairs whose join is a piece, best score first and leftmost on
a tie, and joins until none is left; symbols that are no piece become byte pieces. Where no piece holds a space mark
after another character, a text's words (each with the spaces before it) are encoded one by one and cached. What the
agenda gives for new words is compared with the sentencepiece library in every Arrow batch; a difference raises.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import map_texts, split_words, sums
from .tokenize import gather, trim

MARK = "▁"
CACHE_WORDS = 250_000


class Agenda:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        lib = self.library
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        # a lower rank is a better score; equal scores share a rank
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        self.rank = {p: order[lib.get_score(i)] for p, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary has no byte fallback")
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already."""
        rank = self.rank
        sym = list(text)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, 2) for i in range(n - 1) if (r := rank.get(sym[i] + sym[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            left = sym[i]
            j = after[i]
            if not left or j >= n or len(left) + len(sym[j]) != size:
                continue  # one of the two has been joined meanwhile
            sym[i] = joined = left + sym[j]
            sym[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = rank.get(joined + sym[k])
                if r is not None:
                    heapq.heappush(agenda, (r, i, size + len(sym[k])))
            h = before[i]
            if h >= 0:
                r = rank.get(sym[h] + joined)
                if r is not None:
                    heapq.heappush(agenda, (r, h, len(sym[h]) + size))
        out, ids = [], self.ids
        for s in sym:
            if s:
                i = ids.get(s)
                if i is None:
                    out += [self.bytes[b] for b in s.encode()]
                else:
                    out.append(i)
        return out


class PieceEncoder:
    """Ids of the texts of a batch, without begin or end ids."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        self.agenda, self.limit, self.cache = Agenda(path), limit, {}

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of words, each given without its first space mark; they are kept."""
        trim(self.cache, self.limit)
        own = list(map(self.cache.get, words))
        missing = [k for k, ids in enumerate(own) if ids is None]
        new = [words[k] for k in missing]
        ids = [self.agenda.encode(MARK + w) for w in new]
        # the library marks the text's start itself; a word of nothing but that mark needs a space of its own
        if [i for w, i in zip(new, ids) if w] != self.agenda.library.encode([w for w in new if w], num_threads=1):
            raise ValueError("the agenda and the library differ")
        for k, w, i in zip(missing, new, ids):
            own[k] = self.cache[w] = array("H", i).tobytes()
        return own

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of ids."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        if not self.agenda.apart:
            lists = [self.agenda.encode(MARK + t.replace(" ", MARK)) if t else [] for t in texts.to_pylist()]
            return np.array([i for x in lists for i in x], "uint16"), np.array([len(x) for x in lists], "int64")
        begin, codes, words = split_words(texts, " ")
        gap = words.index("") if "" in words else -1
        if gap >= 0:
            begin, codes, words = self._spaced(texts, begin, codes, words, gap)
        own = self.learn(words)
        lengths = np.fromiter(map(len, own), "int64", len(own)) // 2
        return gather(np.frombuffer(b"".join(own), "<u2"), lengths, codes), sums(lengths[codes], begin)

    @staticmethod
    def _spaced(texts, begin, codes, words, gap):
        """Texts with neighbouring, leading or trailing spaces: spaces go before the word that follows them."""
        odd = sums((codes == gap).astype("int64"), begin) > 0
        number = {w: k for k, w in enumerate(words)}
        out, sizes = [], []
        for k in range(len(begin) - 1):
            if not odd[k]:
                out.append(codes[begin[k] : begin[k + 1]])
            else:
                t, own, spaces = texts[k].as_py(), [], ""
                parts = t.split(" ") if t else []
                for p in parts[:-1]:
                    if p:
                        own.append(spaces + p)
                        spaces = ""
                    else:
                        spaces += MARK
                if parts:
                    own.append(spaces + parts[-1])
                out.append(np.array([number.setdefault(w, len(number)) for w in own], "int64"))
            sizes.append(len(out[-1]))
        return np.concatenate([[0], np.cumsum(sizes)]).astype("int64"), np.concatenate(out).astype("int64"), list(number)


def encode_decode(documents: DataFrame, path: str, text_col: str = "text", keep: list[str] = ("doc_id",), full: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens, ids_sha256, decoded_sha256`` (with ``full`` also ``ids, decoded``), a row for each
    document; no shuffle. Null and empty texts have the end id alone and decode to nothing. Repeated rows stay."""

    def start():
        encoder = PieceEncoder(path)
        library = encoder.agenda.library
        end = library.eos_id()

        def work(texts):
            ids, counts = encoder.batch(texts)
            hashed, back, plain = [], [], []
            at = 0
            for c in counts.tolist():
                own = ids[at : at + c].tolist()
                own.append(end)
                at += c
                text = library.decode(own)
                hashed.append(hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
                back.append(hashlib.sha256(text.encode()).hexdigest())
                if full:
                    plain.append(text)
            if not full:
                return counts + 1, hashed, back
            ends = np.cumsum(counts)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.insert(ids, ends, end).astype("int32")))
            return counts + 1, hashed, back, lists, plain

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if full:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_texts(documents, text_col, list(keep), fields, start)
