"""Harmonic packing of documents into training sequences.

A sequence holds ``size`` tokens. Class k takes pieces of at most size/k tokens and fills each of its bins with exactly
k of them, so every task fills bins alone, without looking at others. A class-k piece is longer than size/(k+1), so a
full bin wastes at most 1/(k+1) of itself. To keep that small, a document is first cut into whole sequences, then halves,
quarters and eighths of one (classes 1, 2, 4 and 8, no waste), and only its tail of under size/8 goes to a class k >= 8.
When a task ends, the pieces in bins that never filled up (fewer than k for each class) are laid end to end.

Results for odd input: a null text is an empty one and a document of one token, the end mark. Null and repeated ids are
rows like any other. An empty table gives no rows. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gramlaw.llm.text import batch, filled, mapped

SIZE, END = 2048, 1
SMALLEST = 64  # class of all pieces of at most size/64 tokens
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
OWN_SEQUENCES = 1 << 36  # sequence numbers of one task

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of ``path`` (a rank file), with its end mark recognised in texts; made once a process."""
    if path not in _encoders:
        import base64

        import public_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        _encoders[path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _encoders[path]


def token_ids(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.append(enc.encode_to_numpy(text, allowed_special="all"), np.uint32(END)).astype("<u4")


class Harmonic:
    """The bins of one task. ``place`` and ``finish`` give (piece, sequence, offset); a piece is (doc, start, ids, total)."""

    def __init__(self, first: int, size: int = SIZE, smallest: int = SMALLEST):
        self.next, self.size, self.smallest, self.waiting = first, size, smallest, {}

    def sequence(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield piece, self.next, at
            at += len(piece[2])
        self.next += 1

    def place(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start, total = 0, len(ids)
        while start < total:
            left = total - start
            cut = next((self.size // k for k in (1, 2, 4, 8) if left >= self.size // k), left)
            k = min(self.size // cut, self.smallest)
            held = self.waiting.setdefault(k, [])
            held.append((doc, start, ids[start : start + cut], total))
            if len(held) == k:
                yield from self.sequence(held)
                self.waiting[k] = []
            start += cut

    def finish(self) -> Iterator[tuple]:
        row, room = [], self.size
        for k in sorted(self.waiting):
            for doc, start, ids, total in self.waiting[k]:
                while len(ids):
                    part = ids[:room]
                    row.append((doc, start, part, total))
                    start, ids, room = start + len(part), ids[len(part) :], room - len(part)
                    if not room:
                        yield from self.sequence(row)
                        row, room = [], self.size
        if row:
            yield from self.sequence(row)
        self.waiting = {}


def pack(docs: DataFrame, ranks_path: str, size: int = SIZE) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        bins = Harmonic(TaskContext.get().partitionId() * OWN_SEQUENCES, size)

        def rows(placed):
            out = [(doc, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, at) for (doc, start, ids, total), seq, at in placed]
            return batch(ARROW, *zip(*out, strict=True)) if out else None

        for part in batches:
            placed = [p for doc, text in zip(part.column(0).to_pylist(), filled(part.column(1)).to_pylist(), strict=True) for p in bins.place(doc, token_ids(enc, text))]
            if (out := rows(placed)) is not None:
                yield out
        if (out := rows(bins.finish())) is not None:
            yield out

    return mapped(docs, ["doc_id", "text"], run, SCHEMA)
