"""Exact encoding with a ``tokenizers`` vocabulary that drops white space, by pieces between white space.

Such a tokenizer's pre-tokenizer never lets a token span white space and its normaliser doesn't look across it, so a
text's ids are those of its white-space-separated units in a row. Units repeat, so a bounded cache of their ids saves
most of the work; all ids come from the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .base import split_arrow, sums

#: Units kept by a worker. Of more, the older half stays (frequent ones come early); results don't depend on it.
CACHE_UNITS = 700_000
#: Fixed value: the pattern by which the vocabulary's pre-tokenizer finds pre-tokens in lower-cased text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Units of printable ASCII and the letters of Latin-1, which are composed and have a plain lower case, and the
#: pattern as it reads for these characters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Of these characters alone, a word of letters with marks after it has two pre-tokens, the word and the marks; "<" may begin
#: a special token.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "<")
_EACH = "".join(c for c in map(chr, range(65, 256)) if re.match(f"[{_LETTERS}]", c))
#: Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from U+0100 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_BYTES = dict(zip((b for b in range(256) if b not in _PRINTED), range(256, 512)))


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def trim(cache: dict, limit: int) -> None:
    if len(cache) > limit:
        for k in list(cache)[limit // 2 :]:
            del cache[k]


class UnitEncoder:
    """Ids of the texts of a batch, as 16-bit numbers; the vocabulary must have at most 65,536."""

    def __init__(self, path: str, limit: int = CACHE_UNITS):
        self.tokenizer, self.limit, self.cache, self.pieces = load(path), limit, {}, {}
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 65_536:
            raise ValueError("ids need 16 bits")
        parts = (json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [])
        #: Whether units may be cut here; with another pre-tokenizer the library gets them whole.
        self.cuts = [p.get("pattern", {}).get("Regex") for p in parts if p["type"] == "Split"] == [PATTERN]

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token in lower case, from the library's model."""
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        self.pieces[piece] = ids = array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids

    def learn(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, which are kept."""
        trim(self.cache, self.limit)
        cache, pieces, others = self.cache, self.pieces, []
        own = list(map(cache.get, units))
        new = [k for k, ids in enumerate(own) if ids is None]
        for u in map(units.__getitem__, new):
            # special tokens are found before pre-tokens are; white space at a batch's ends makes an empty unit
            if not u:
                cache[u] = b""
            elif self.cuts and "<|" not in u and _PLAIN.fullmatch(u):
                found = _PIECE.findall(u.lower())
                cache[u] = b"".join([pieces.get(p) or self.piece(p) for p in found])
            else:
                others.append(u)
        for u, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            cache[u] = array("H", e.ids).tobytes()
        for k in new:
            own[k] = cache[units[k]]
        return own

    def words(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token in lower case, which are kept."""
        own = list(map(self.pieces.get, pieces))
        for k, ids in enumerate(own):
            if ids is None:
                own[k] = self.piece(pieces[k])
        return own

    def units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, and each unit's number of ids."""
        trim(self.pieces, self.limit)
        bare = pc.ascii_rtrim(units, characters=_MARKS)
        plain = pc.match_substring_regex(bare, f"^[{_LETTERS}]+$") if self.cuts else pa.array(np.zeros(len(units), bool))
        others = pc.invert(plain)
        words = pc.utf8_lower(bare.filter(plain)).dictionary_encode()
        marks = pc.utf8_ltrim(units.filter(plain), characters=_EACH).dictionary_encode()
        own, runs = [b""], np.zeros((len(units), 2), "int64")
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        for k, part in enumerate((words, marks)):
            runs[at, k] = part.indices.to_numpy() + len(own)
            own += self.words(part.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = np.flatnonzero(others.to_numpy(zero_copy_only=False))
        runs[at, 0] = np.arange(len(own), len(own) + len(at))
        own += self.learn(units.filter(others).to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, own), "int64", len(own)) // 2
        return gather(np.frombuffer(b"".join(own), "<u2"), lengths, runs.ravel()), lengths[runs].sum(axis=1)

    def batch(self, texts: pa.Array, counts_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """All ids in a row, and each text's number of ids."""
        begin, codes, units = split_arrow(texts)
        flat, lengths = self.units(units)
        counts = sums(lengths[codes], begin)
        if counts_only:
            return None, counts
        return gather(flat, lengths, codes), counts


def gather(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs ``codes`` of ``flat``, whose runs have the given lengths, in a row."""
    per = lengths[codes]
    total = int(per.sum())
    small = "int32" if max(total, len(flat)) < 1 << 31 else "int64"
    shift = ((np.cumsum(lengths) - lengths)[codes] - (np.cumsum(per) - per)).astype(small)
    at = np.repeat(shift, per)
    at += np.arange(total, dtype=small)
    return flat.take(at)


@lru_cache(maxsize=1)
def unit_encoder(path: str) -> UnitEncoder:
    """One encoder for all tasks that a worker runs, so that its cache is filled once."""
    return UnitEncoder(path)
