"""Packing documents into fixed-length training sequences by sum-of-squares online bin packing.

Every task packs the documents of its own input partition as they come, so nothing is shuffled and
nothing meets in one place. A document is tokenized, closed with an end id and cut into full
sequences; its rest goes to the fill level whose choice leaves the least sum of squared counts of
partly filled sequences. The counts are one array with a cell per level, so that a choice is one
vector operation. When a partition ends, the sequences that are still open keep what was placed in them, the
fullest first, and are filled up with pieces cut off the emptiest ones (a piece may be cut anywhere), which leaves one padded
sequence per partition at most. Only what the emptiest held is moved: by_rest marks it.

Defined results: null text counts as empty and is the end id alone; a null doc_id stays null;
repeated rows are packed each; an empty table gives no pieces; only doc_id and text are read, so
other columns can have any name. Sequence ids are unique (partition number, then a counter) and
the same again when a task is repeated on the same partition.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: White space in a row that tiktoken is given; its regular expression fails on runs of about a million.
LONGEST_GAP = 100_000
_GAP = re.compile(rf"(?<!\s)\s{{{LONGEST_GAP}}}")
#: Pieces in an output batch.
PIECES_AT_ONCE = 8192
# Fixed value: how byte-level BPE files of the tokenizers library split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """A byte-level BPE file of the tokenizers library, run by tiktoken: the same ids in a third of the time.

    In such files a token is written with printable stand-ins for bytes, and ids follow merge order.
    """
    if path not in _encodings:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        _encodings[path] = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[path]


_tokenizers: dict[str, Tokenizer] = {}


def token_ids(path: str, text: str) -> np.ndarray:
    """The text's ids; texts with a very long run of white space go through the tokenizers library itself."""
    if len(text) > LONGEST_GAP and _GAP.search(text):
        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer.from_file(path)
        return np.array(_tokenizers[path].encode(text, add_special_tokens=False).ids, dtype="<u4")
    return encoding(path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


class LevelPacker:
    """Open sequences by fill level; ``place`` gives back the sequences that it fills."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]

    def level_for(self, length: int) -> int:
        """The level (0: a new sequence) that minimises the sum of squared counts; of equals the fullest."""
        reach = self.size - length
        now, then = self.count[: reach + 1], self.count[length : self.size + 1]
        change = 2 * (then - now) + 2
        change[reach] = 1 - 2 * now[reach]
        change[now == 0] = np.iinfo(np.int64).max
        if reach:
            change[0] = 2 * self.count[length] + 1
        else:
            return 0
        return reach - int(np.argmin(change[::-1]))

    def place(self, piece, length: int) -> list | None:
        level = self.level_for(length)
        pieces = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        pieces.append(piece)
        if level + length == self.size:
            return pieces
        self.count[level + length] += 1
        self.open[level + length].append(pieces)
        return None

    def rest(self) -> Iterator[list]:
        """The sequences still open, the fullest filled up with what the emptiest hold; the last may lack something."""
        left = deque((level, pieces) for level in range(self.size - 1, 0, -1) for pieces in self.open[level])
        while left:
            level, pieces = left.popleft()
            while level < self.size and left:
                held, donor = left.pop()
                while donor and level < self.size:
                    doc, start, ids, total, _ = donor.pop()
                    taken = ids[: self.size - level]
                    pieces.append((doc, start, taken, total, True))
                    level, held = level + len(taken), held - len(taken)
                    if len(taken) < len(ids):
                        donor.append((doc, start + len(taken), ids[len(taken) :], total, True))
                if donor:
                    left.append((held, donor))
            yield pieces


def _documents(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple]:
    """(doc_id, its ids and the end id) of every row."""
    end = np.array([end_id], dtype="<u4")
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield doc, np.concatenate((token_ids(path, text.as_py() or ""), end))


def _sequences(documents: Iterator[tuple], size: int) -> Iterator[list]:
    """Lists of pieces (doc_id, start, ids, doc_tokens, by_rest), each list a sequence."""
    packer = LevelPacker(size)
    for doc, ids in documents:
        full = len(ids) // size * size
        for start in range(0, full, size):
            yield [(doc, start, ids[start : start + size], len(ids), False)]
        if full < len(ids) and (done := packer.place((doc, full, ids[full:].copy(), len(ids), False), len(ids) - full)):
            yield done
    yield from packer.rest()


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, by_rest, and ids if asked for.

    Sequence ``sequence_id`` is its pieces by ``offset``; what lacks to ``size`` is padding.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, by_rest boolean" + ", ids array<int>" * with_ids
    types = [pa.int64()] * 7 + [pa.bool_()] + [pa.list_(pa.int32())] * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        base, rows = TaskContext.get().partitionId() << 40, []
        for number, pieces in enumerate(_sequences(_documents(batches, tokenizer_path, end_id), size)):
            offset = 0
            for doc, start, ids, total, by_rest in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + number, offset, by_rest)
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                offset += len(ids)
            if len(rows) >= PIECES_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
