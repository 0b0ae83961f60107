"""Vector best-fit packing of documents into training sequences.

Each sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces are
placed in decreasing length; among the open sequences with room in every capacity, the one is taken whose residual
after placement has the smallest weighted norm ("norm"), or whose residual has the largest weighted dot product with
the piece's demands ("dot"). A piece's demands follow from its length alone.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm.common import map_rows, work_table

CAPACITY = 2048
#: Pieces that one task packs together in the first round; the rest of each group meets in a second round.
GROUP = 4096
END = 0
MEMO_CHARS, MEMO_SIZE, RUN_CHARS = 64, 100_000, 1 << 20
#: Forms in one call of the library.
CALL = 4096

#: A slot is a task's number, shifted by so many bits, and the piece's number within the task.
TASK_BITS = 33

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"


# The vocabulary's own rule for words, for characters below U+0180 and some punctuation, lower-cased.
# There composed forms are the only ones and letters keep their block; other texts are left to the library whole.
_LETTER, _DIGIT, _SPACE = "a-zªµº\u00df-\u00f6\u00f8-\u017f", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+").findall
_OTHER = re.compile("[^\x00-\u012f\u0131-\u017f\u2010-\u2027]|<\\|").search


class WordTokenizer:
    """The tokenizers library's ids, found word by word and remembered.

    No token reaches over the words that the vocabulary's pre-tokenizer cuts, so that each new word is encoded once by
    the library. Texts with characters outside `_OTHER`'s range are cut at spaces and line feeds only (white space is
    dropped), and the library normalizes and cuts the pieces itself. At most twice MEMO_SIZE forms are remembered.
    """

    def __init__(self, path: str):
        self._path, self._rest = path, None
        with open(path, encoding="utf-8") as file:
            plain = json.load(file)
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain |= {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}}
        self._word = Tokenizer.from_str(json.dumps(plain))
        suffix = plain["model"]["end_of_word_suffix"]
        self._ends = np.zeros(max(plain["model"]["vocab"].values()) + 1, dtype=bool)
        self._ends[[i for t, i in plain["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.forget()

    @property
    def _whole(self) -> Tokenizer:
        """The vocabulary as it is, made when first needed."""
        if self._rest is None:
            self._rest = Tokenizer.from_file(self._path)
            self._rest.no_padding()
            self._rest.no_truncation()
        return self._rest

    def forget(self) -> None:
        # Words and pieces (these end in a line feed, which no word holds) share one table.
        self._memo: dict[str, bytes] = {"\n": b""}
        self._old: dict[str, bytes] = {}

    def _forms(self, text: str) -> list[str]:
        if text.isascii() and "<|" not in text or _OTHER(text) is None:
            return _WORDS(text.lower())
        out: list[str] = []
        for piece in text.replace("\n", " ").split(" "):
            if _OTHER(piece) is None:
                out += _WORDS(piece.lower())
            else:
                out.append(piece + "\n")
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts; the library sees each new form of all of them once."""
        forms = [self._forms(t) for t in texts]
        memo, old = self._memo, self._old
        missing = set().union(*forms).difference(memo)
        memo.update((f, old[f]) for f in missing if f in old)
        new = [f for f in missing if f not in memo]
        words, pieces = [f for f in new if f[-1] != "\n"], [f for f in new if f[-1] == "\n"]
        for at in range(0, len(words), CALL):
            part = words[at : at + CALL]
            ids = np.array(self._word.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = 4 * (np.flatnonzero(self._ends[ids]) + 1)  # the last token of each word, and no other, has the suffix
            whole, stops = ids.tobytes(), stops.tolist()
            memo.update((f, whole[i:j]) for f, i, j in zip(part, [0, *stops], stops, strict=False))
            if len(stops) != len(part):
                raise ValueError("a word has no last token")
        for at in range(0, len(pieces), CALL):
            part = pieces[at : at + CALL]
            for f, e in zip(part, self._whole.encode_batch_fast([f[:-1] for f in part], add_special_tokens=False)):
                memo[f] = np.array(e.ids, dtype="<u4").tobytes()
        out = [b"".join(map(memo.__getitem__, own)) for own in forms]
        for f in new:
            if len(f) > MEMO_CHARS:
                del memo[f]
        if len(memo) > MEMO_SIZE:
            # Forms that aren't met again before the next change of generations are forgotten.
            self._memo, self._old = {"\n": b""}, memo
        return out

    def runs(self, texts: pa.Array) -> Iterator[bytes]:
        """encode_all over runs of RUN_CHARS."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t.as_py() or "")
            size += len(held[-1])
            if size > RUN_CHARS:
                yield from self.encode_all(held)
                held, size = [], 0
        yield from self.encode_all(held)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut_documents(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, slot): each document's ids and an end id, cut only beyond capacity.

    slot is the task's number and the piece's within it, so that no two pieces share one whatever their ids are.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        coder, slot = tokenizer(path), TaskContext.get().partitionId() << TASK_BITS
        try:
            for b in batches:
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "slot")}
                for key, text_ids in zip(b.column(0).to_pylist(), coder.runs(b.column(1))):
                    ids = text_ids + END.to_bytes(4, "little")
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for k, v in zip(out, (key, i, at // 4, len(part) // 4, zlib.crc32(part), slot)):
                            out[k].append(v)
                        slot += 1
                yield out
        finally:
            coder.forget()  # the worker's next tasks may be of other stages

    return map_rows(documents.select("doc_id", "text"), rows, PIECES)


def best_fit(lengths: np.ndarray, capacity: int, documents: int, attention: float, choose: str = "norm") -> np.ndarray:
    """The bin of each length (bins from 0), by vector best-fit in decreasing order; ties go to the earlier bin.

    A piece that alone breaks the attention capacity can't be placed and raises ValueError.
    """
    order = np.argsort(-lengths, kind="stable")
    limits = np.array([capacity, documents, attention], dtype=np.float64)
    demands = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2], axis=1)
    if (demands > limits).any():
        raise ValueError("a piece is larger than a capacity")
    weights = demands.sum(axis=0) / limits
    weights = weights / weights.sum()
    smallest = lengths.min() if len(lengths) else 0
    bins = np.empty(len(lengths), dtype=np.int64)
    left, names, made = np.empty((64, 3)), np.empty(64, dtype=np.int64), 0
    n = 0  # open bins are the first n rows of left
    for i in order:
        d = demands[i]
        at = -1
        if n:
            rest = left[:n] - d
            fits = (rest >= 0).all(axis=1)
            if fits.any():
                share = (rest if choose == "norm" else left[:n] * (d / limits)) / limits
                score = (weights * share * share).sum(axis=1) if choose == "norm" else -(weights * share).sum(axis=1)
                score[~fits] = np.inf
                at = int(score.argmin())
        if at < 0:
            if n == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            left[n], names[n], at = limits, made, n
            n, made = n + 1, made + 1
        bins[i] = names[at]
        left[at] -= d
        if left[at, 0] < smallest or left[at, 1] < 1 or left[at, 2] < 1:  # full: the last open bin takes its row
            n -= 1
            left[at], names[at] = left[n], names[n]
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, documents: int | None = None, attention: float | None = None, choose: str = "norm", group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces (a table with PIECES' columns, as cut_documents gives).

    Pieces as long as a sequence are one each, named by their slot. The others are dealt by slot into groups that tasks
    pack at once; pieces of sequences left under 97 % full are dealt and packed once more. documents and attention default
    to bounds that no set of whole pieces within the token capacity can break. An empty table gives no rows.
    """
    documents = documents or capacity
    attention = attention or float(capacity) ** 2
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def placed(loose: DataFrame, n: int, round_: int) -> DataFrame:
        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["slot"], kind="stable").reset_index(drop=True)
            pdf["bin"] = best_fit(pdf["length"].to_numpy(), capacity, documents, attention, choose)
            pdf = pdf.sort_values(["bin", "slot"], kind="stable")
            sizes = pdf.groupby("bin")["length"]
            pdf["offset"] = sizes.cumsum() - pdf["length"]
            pdf["used"] = sizes.transform("sum")
            pdf["sequence_id"] = (round_ << 60) + (int(key[0]) << 24) + pdf["bin"]
            return pdf[[*columns, "slot", "sequence_id", "offset", "used"]]

        # Each task's pieces are dealt in turn, from a group of the task's own.
        turn = F.shiftright("slot", TASK_BITS) * 7919 + F.col("slot").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
        dealt = loose.withColumn("grp", F.pmod(turn, F.lit(n)))
        return dealt.groupBy("grp").applyInPandas(one, f"{PIECES}, sequence_id long, offset long, used long")

    loose = pieces.filter(F.col("length") < capacity)
    n = loose.count()
    first = work_table(placed(loose, max(1, round(n / group)), 1), "packed")
    whole = (F.col("used") >= 0.97 * capacity)
    rest = first.filter(~whole)
    m = rest.count()
    again = placed(rest.select(*columns, "slot"), max(1, round(m / group)), 2)
    full = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", F.col("slot")).withColumn("offset", F.lit(0).cast("long"))
    parts = [x.select(*columns, "sequence_id", "offset") for x in (first.filter(whole), again, full)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pack_documents(documents: DataFrame, path: str, **limits) -> DataFrame:
    """Tokenize, cut and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone; rows that repeat an id are documents of their own.
    """
    return pack(work_table(cut_documents(documents, path, limits.get("capacity", CAPACITY)), "pieces"), **limits)
