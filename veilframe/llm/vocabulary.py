"""Fast, exact ids of byte-pair tokenizer files, one call for a whole block of texts.

A text is cut into pre-tokens by array operations, each distinct pre-token is merged once per
block (frequent ones once per worker), and ids are put together by indexing. Texts that name a
special token of the file, or hold a code point outside `CHECKED`, are handed to the tokenizers
library as a whole: Unicode tables differ in code points that are new or not assigned. The ids are
those that the library gives for the whole text with add_special_tokens=False; tests compare them,
on every code point of Unicode too."""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from veilframe.llm.text import Texts, run_ids, slice_hashes, take_slices

_L, _N, _W, _O = 0, 1, 2, 3
#: Code points whose classes and letter cases are the library's: Latin, Greek, Cyrillic, punctuation,
#: kana and Han, Hangul, pictures.
CHECKED = ((0x0000, 0x02FF), (0x0370, 0x0557), (0x2000, 0x206F), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F))
#: The first byte of any code point from the end of the first of these ranges on.
_BEYOND = 0xCC
#: Pre-tokens a worker remembers between blocks.
CACHE = 1 << 18


@functools.cache
def _classes() -> np.ndarray:
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    kinds = np.full(0x110000, _O, dtype=np.uint8)
    for kind, pattern in ((_L, r"\p{L}+"), (_N, r"\p{N}+"), (_W, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start():m.end()] = kind
    return kinds


@functools.cache
def _checked() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for low, high in CHECKED:
        table[low:high + 1] = True
    return table


def unchecked(texts: Texts) -> np.ndarray:
    """For each text whether it holds a code point outside CHECKED."""
    out = np.zeros(texts.count, dtype=bool)
    if texts.data.max(initial=0) >= _BEYOND:
        codes = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero((texts.data & 0xC0) != 0x80)[~_checked()[codes]]
        out[np.searchsorted(texts.offsets, at, side="right") - 1] = True
    return out


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level tokenizer files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in plain):
        letters[chr(256 + n)] = b
    return letters


class Vocabulary:
    """Ids of one tokenizer file: byte-level with the splitting rule of its family, or with word
    ends, lower case and dropped white space."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.suffix = spec["model"].get("end_of_word_suffix")
        if self.suffix:
            # A byte that UTF-8 never uses ends each word; joining it to the last letter comes first.
            end = b"\xff"
            ids = {}
            ranks = {bytes([b]): b for b in range(256)}
            for token, i in vocab.items():
                closed = token.endswith(self.suffix) and len(token) > len(self.suffix)
                body = token[:-len(self.suffix)] if closed else token
                ids[bytes(letters[c] for c in body) + (end if closed else b"")] = i
            for b in range(256):
                if bytes([b]) + end not in ranks:
                    ranks[bytes([b]) + end] = len(ranks)
            for left, right in spec["model"]["merges"]:
                body = (left + right).removesuffix(self.suffix)
                made = bytes(letters[c] for c in body) + (end if right.endswith(self.suffix) else b"")
                ranks.setdefault(made, len(ranks))
            self.to_id = np.zeros(len(ranks), dtype=np.uint32)
            for piece, rank in ranks.items():
                self.to_id[rank] = ids.get(piece, 0)
        else:
            ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            self.to_id = None
        self.core = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_len = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _plain(self, column: pa.Array) -> pa.Array:
        """Texts as the file's normaliser leaves them, white space apart."""
        if not self.suffix:
            return column
        out = []
        for text in column.to_pylist():
            text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
            out.append(text.lower())
        return pa.array(out, pa.large_string())

    def _pretokens(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each pre-token, and each text's first."""
        data = texts.data
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(codes)
        if not n:
            return at, at, np.zeros(texts.count + 1, np.int64)
        kind = _classes()[codes]
        first = np.zeros(n + 1, dtype=bool)
        first[np.searchsorted(at, texts.offsets)] = True  # the place behind the last text too
        last = first[1:]
        first = first[:-1]
        start = first.copy()
        changed = kind[1:] != kind[:-1]
        if self.suffix:
            start[1:] |= changed | (kind[1:] == _N)
        else:
            blank = codes == 0x20
            start[1:] |= changed & ~(blank[:-1] & (kind[1:] != _W))
            start[1:-1] |= (kind[1:-1] == _W) & (kind[:-2] == _W) & (kind[2:] != _W) & ~last[1:-1]
        quote = np.flatnonzero((codes == 0x27) & start & ~last)
        quote = quote[kind[np.minimum(quote + 1, n - 1)] == _L]
        if len(quote):
            one = codes[quote + 1]
            two = np.where(last[quote + 1], 0, codes[np.minimum(quote + 2, n - 1)])
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
            for a, b in ("re", "ve", "ll"):
                size[(one == ord(a)) & (two == ord(b))] = 2
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            beyond = quote + 1 + size
            start[beyond[beyond < n]] = True
        begin = np.flatnonzero(start)
        stop = np.append(begin[1:], n)
        if self.suffix:
            solid = kind[begin] != _W
            begin, stop = begin[solid], stop[solid]
        byte = np.append(at, len(data))
        return byte[begin], byte[stop], np.searchsorted(byte[begin], texts.offsets)

    def _merge(self, piece: bytes) -> list[int]:
        return self.core.encode_single_piece(piece + b"\xff" if self.suffix else piece)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin. Null is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        special = unchecked(Texts(column))
        for token in self.special:
            special |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        odd = {int(i): self.whole.encode(column[int(i)].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(special)}
        plain = self._plain(column)
        if odd:
            plain = pc.fill_null(plain.take(pa.array(np.arange(len(special)), mask=special)), "")
        texts = Texts(plain)
        starts, ends, first = self._pretokens(texts)
        key = slice_hashes(texts.data, starts, ends)
        distinct, where, which = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        hit = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == distinct[inside]
        begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        begin[hit], size[hit] = self.known_at[at[hit]], self.known_len[at[hit]]
        new = np.flatnonzero(~hit)
        raw = texts.data.tobytes()
        made = [self._merge(raw[a:b]) for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())]
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter((i for ids in made for i in ids), np.uint32, int(lengths.sum()))
        if self.to_id is not None:
            flat = self.to_id[flat]
        pool = np.concatenate([self.pool, flat])
        size[new] = lengths
        begin[new] = len(self.pool) + np.cumsum(lengths) - lengths
        ids, offsets = take_slices(pool, begin[which], (begin + size)[which])
        bounds = offsets[first]
        if len(self.known) + len(new) <= CACHE:
            order = np.argsort(joined := np.concatenate([self.known, distinct[new]]))
            self.known, self.pool = joined[order], pool
            self.known_at = np.concatenate([self.known_at, begin[new]])[order]
            self.known_len = np.concatenate([self.known_len, size[new]])[order]
        if odd:
            parts = [np.asarray(odd[i], np.uint32) if i in odd else ids[bounds[i]:bounds[i + 1]] for i in range(len(column))]
            ids = np.concatenate(parts)
            bounds = np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, bounds


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path)


def append_id(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id behind each text's."""
    out_bounds = bounds + np.arange(len(bounds))
    out = np.full(out_bounds[-1], end, dtype=np.uint32)
    at = np.arange(len(ids)) + run_ids(bounds)
    out[at] = ids
    return out, out_bounds
