"""Ids of whole texts by a byte-level BPE file, as the tokenizers library gives them.

The library is slow on whole texts, so those of well-known letters and marks go
to an engine made from the file's own vocabulary and pattern, where ranks of
tokens stand for ranks of merges.  That needs a file whose ids rise with its
merges and that splits by the byte-level pattern; it is looked at when it is
loaded.  Any other text (rare scripts, on which pattern engines may differ by
their Unicode tables, or the string of an added token) and any other byte-level
file goes through the library itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import byte_letters

# Bytes of text taken at once.
SLICE_BYTES = 2_000_000
# The pattern of byte-level pre-tokenizers (fixed value of that format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters whose classes have long been fixed: Latin, Cyrillic, kana, common ideographs, Hangul, usual marks.
KNOWN = r"\x00-ɏЀ-ҁҊ-ӿ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣"
_CUT = re.compile(r"(?<! ) (?=\S)")
# a space at which a text isn't cut, as wide as the white space of any pattern
_UNCUT = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
_encoders: dict[tuple[str, bool], ByteEncoder] = {}


def encoder(path: str, plain_specials: bool = False) -> ByteEncoder:
    """The worker's encoder for a tokenizer file."""
    if (path, plain_specials) not in _encoders:
        _encoders[path, plain_specials] = ByteEncoder(path, plain_specials)
    return _encoders[path, plain_specials]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts): consecutive parts of about ``size`` bytes, one text at least; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with these starts and lengths, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def cut_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units, the place among them of every unit in text order, and each text's number of units.

    A text is its units joined by single spaces.  It has one unit at least, the
    first of which may be empty; any other follows a space that has no space
    before it and no white space behind it.
    """
    odd = pc.match_substring_regex(texts, _UNCUT)
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    if not pc.any(odd).as_py():
        lists = plain
    else:
        cut = pa.array([_CUT.split(t) for t in texts.filter(odd).to_pylist()], plain.type)
        lists = pa.concat_arrays([plain, cut])
        odd = odd.to_numpy(zero_copy_only=False)
        place = np.empty(len(texts), np.int64)
        place[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(texts))
        lists = lists.take(pa.array(place))
    units = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return units.dictionary, units.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes


class ByteEncoder:
    """Ids of a byte-level BPE file; other kinds of tokenizers are refused.

    With ``plain_specials`` the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        self.path, self.plain_specials = path, plain_specials
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        split, model = parts["pre_tokenizer"] or {}, parts["model"]
        usual = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if not usual or parts["normalizer"] or model["type"] != "BPE":
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab = model["vocab"]
        added = {t["id"]: t for t in parts["added_tokens"]}
        self.added = [t["content"] for t in added.values() if not (plain_specials and t["special"])]
        letters = {c: b for b, c in byte_letters().items()}
        self.bytes_of = [b""] * (1 + max(*vocab.values(), *added, 0))
        for token, i in vocab.items():
            if i not in added:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        self.width = np.array([len(b) for b in self.bytes_of])
        self.dtype = np.dtype("<u2" if len(self.width) <= 1 << 16 else "<u4")
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        singles = sum(len(b) == 1 for b in self.bytes_of)
        self.ranked = (
            singles == 256
            and all(a < b for a, b in zip(made, made[1:]))
            and len(made) + 256 == len(vocab) - sum(i in added for i in vocab.values())
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "end_of_word_suffix"))
        )
        self.ranked = self.ranked and not model.get("continuing_subword_prefix")
        if self.ranked:
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes_of) if b}
            self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """The library's tokenizer, loaded for the first text that needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = self.plain_specials
        return made

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _engine(self, text: str) -> np.ndarray:
        return np.frombuffer(array(self.dtype.char, self.engine.encode_ordinary(text)), self.dtype)

    def _others(self, texts: pa.Array) -> np.ndarray:
        """Which texts only the library may encode."""
        found = pc.match_substring_regex(texts, f"[^{KNOWN}]").to_numpy(zero_copy_only=False)
        for name in self.added:
            found = found | pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        return found

    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        for _, part in slices(texts):
            other = self._others(part)
            if not self.ranked:
                other = np.ones(len(part), bool)
            for text, by_library in zip(part.to_pylist(), other.tolist()):
                yield self._library(text) if by_library else self._engine(text)

    def encode_units(self, units: list[str], joined: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of ``cut_texts``, each behind a space, and each unit's number of ids."""
        found = [" " + " ".join(units[i : i + joined]) for i in range(0, len(units), joined)]
        found = list(self.encode(found))
        ids = np.concatenate([np.empty(0, self.dtype), *found])
        ends = np.cumsum([1 + len(u.encode()) for u in units])
        stops = np.searchsorted(np.cumsum(self.width[ids]), ends, "right")
        return ids, np.diff(stops, prepend=0)
