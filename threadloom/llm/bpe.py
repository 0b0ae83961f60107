"""Byte-pair encoding and decoding.

The encoder is exact and linear in the text: an Aho-Corasick automaton over the vocabulary gives the longest token at
a position, a pair-compatibility test (would the merges ever have crossed this boundary?) accepts or refuses it, and on
refusal the next shorter token, or the token before, is tried; positions from which no encoding went on are struck out,
so each is visited once. The decoder copies token bytes from one flat buffer by an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from threadloom.llm.common import map_rows

# The byte-level pre-tokenizer's pattern and Unicode's White_Space class, as the format defines them.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Pieces of text longer than this are encoded without being remembered; so many are remembered at most in a worker.
MEMO_CHARS, MEMO_SIZE = 64, 200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BacktrackingBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        letters = byte_letters()
        self._letters = {b: letters[b] for b in range(256)}
        # Inside the encoder tokens are numbered by merge order: single bytes first, then each merge's product.
        made = [a + b for a, b in merges]
        self._text = [*letters, *made]
        number = {t: i for i, t in enumerate(self._text)}
        self._pairs = {(number[a], number[b]): number[a + b] for a, b in merges}
        self._parts = [(i, i) for i in range(256)] + [(number[a], number[b]) for a, b in merges]
        self._ids = np.array([vocab[t] for t in self._text], dtype="<u4")
        self._length = [len(t) for t in self._text]
        self._automaton = ahocorasick.Automaton()
        for t, i in number.items():
            self._automaton.add_word(t, i)
        self._automaton.make_automaton()
        self._shorter = [self._prefix(t) for t in self._text]
        self._special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._split = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True)))) if self._special else None
        self._words = regex.compile(WORDS)
        self._chunks = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?=$|[{SPACE}])|[{SPACE}]+")
        self._memo: dict[str, bytes] = {}
        self._compatible: dict[int, bool] = {}
        flat = {i: bytes(letters.index(c) for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
        flat |= {i: t.encode() for t, i in self._special.items()}
        size = max(flat) + 1
        self._offsets = np.zeros(size + 1, dtype=np.int64)
        self._offsets[1:] = np.cumsum([len(flat.get(i, b"")) for i in range(size)])
        self._bytes = np.frombuffer(b"".join(flat.get(i, b"") for i in range(size)), dtype=np.uint8)

    def _prefix(self, token: str) -> int:
        """The longest vocabulary token that is a shorter prefix of this one; -1 for single bytes."""
        for n in range(len(token) - 1, 0, -1):
            if (found := self._automaton.get(token[:n], -1)) >= 0:
                return found
        return -1

    def _fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: undoing both sides' merges, no merge across the boundary comes first."""
        pairs, parts, limit = self._pairs, self._parts, 1 << 60
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            # The later merge of the two was the last made: take it apart on its side, and bound what may join.
            left = a > b
            for _ in range(2):
                if left and parts[a][1] != a:
                    limit, a = a, parts[a][1]
                    break
                if not left and parts[b][0] != b:
                    limit, b = b + 1, parts[b][0]
                    break
                limit = a if left else b + 1
                left = not left
            else:
                return True

    def _word(self, text: str) -> list[int]:
        """Merge numbers of one pre-token, given in byte letters."""
        if (whole := self._automaton.get(text, -1)) >= 0:
            return [whole]
        length, shorter, known = self._length, self._shorter, self._compatible
        # One run of the automaton: a start's tokens are reported by rising end, so the longest is written last.
        longest = [0] * len(text)
        for end, token in self._automaton.iter(text):
            longest[end + 1 - length[token]] = token
        closed: set[int] = set()
        out: list[int] = []
        at, size, token, last = 0, len(text), longest[0], -1
        while True:
            end = at + length[token]
            if end not in closed:
                if last < 0:
                    fits = True
                else:
                    fits = known.get(pair := last << 20 | token)
                    if fits is None:
                        if len(known) > 200_000:
                            known.clear()
                        fits = known[pair] = self._fits(last, token)
                if fits:
                    out.append(token)
                    if end == size:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                closed.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def _chunk(self, chunk: str) -> bytes:
        out: list[int] = []
        letters = self._letters
        space = letters[32]
        for word in self._words.findall(chunk):
            out += self._word(word.replace(" ", space) if word.isascii() and word.isprintable() else "".join(map(letters.__getitem__, word.encode())))
        ids = self._ids[out].tobytes()
        if len(chunk) <= MEMO_CHARS:
            if len(self._memo) >= MEMO_SIZE:
                self._memo.clear()
            self._memo[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers; special tokens' strings become their ids."""
        if self._split is None or not self._split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._split.finditer(text):
            out += [self._plain(text[at : m.start()]), np.uint32(self._special[m[0]]).astype("<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        # Pre-tokens never reach over these chunks' ends, so that chunks can be encoded, and remembered, one by one.
        memo, chunk = self._memo, self._chunk
        return b"".join([memo.get(c) or chunk(c) for c in self._chunks.findall(text)])

    def decode(self, ids: np.ndarray) -> str:
        starts = self._offsets[ids]
        lengths = self._offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(lengths)
        if not len(ids):
            return ""
        at = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self._bytes[at].tobytes().decode("utf-8", errors="replace")


_coders: dict[str, BacktrackingBpe] = {}


def coder(path: str) -> BacktrackingBpe:
    """One coder for each file and Python worker."""
    if path not in _coders:
        _coders[path] = BacktrackingBpe(path)
    return _coders[path]


def encode_documents(documents: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode whole texts: (doc_id, ids array<long>). Null and empty texts have no ids; rows and their repeats all stay."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = coder(path)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                yield {key: [k], "ids": [np.frombuffer(bpe.encode(t.as_py() or ""), dtype="<u4").astype(np.int64)]}

    return map_rows(documents.select(key, text), rows, f"{key} long, ids array<long>")


def round_trip(documents: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every whole text; per row its key, n_tokens, ids_sha256 and decoded_sha256.

    Scan splits are worked on where they lie, without a shuffle: a hot source or key changes nothing. A null text is
    empty: no tokens, and both digests are those of no bytes. Repeated rows each give a row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = coder(path)
        for b in batches:
            out: dict[str, list] = {key: b.column(0).to_pylist(), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(np.frombuffer(ids, dtype="<u4")).encode()).hexdigest())
            yield out

    return map_rows(documents.select(key, text), rows, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
