"""Vector bin packing of tokenised examples into training sequences.

An example is a size vector (tokens, segments, loss-bearing tokens); a sequence
has a limit for each. One open sequence at a time is filled with the waiting
example whose size has the largest dot product with what the sequence has left,
both as shares of the limits. Every task packs the rows of its own partition in
windows of bounded size, so packing needs no shuffle and memory does not grow
with the input; leftovers of a window join the next one.

Examples may be cut: blocks of the full length leave first, a gap that no
waiting example fits is filled with the head of the largest one, and the last
open sequence of a task is cut at powers of two, which need no padding.

Defined cases: a null text counts as an empty one (one token, the end id); null
ids are carried; equal rows are packed one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.arrow import frugal, slices

SEQUENCE_TOKENS = 1024
SEQUENCE_SEGMENTS = 256
WINDOW = 2048
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoder(path: str):
    """Byte-level BPE over a rank file; gives the ids that the same vocabulary gives in ``tokenizers``."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Packer:
    """Packs (doc, start, length) pieces of one task; ``emit`` collects (piece, sequence, offset)."""

    def __init__(self, first_sequence: int, tokens: int, segments: int, loss: int):
        self.next, self.tokens, self.segments, self.loss = first_sequence, tokens, segments, loss
        self.pool: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray, loss: np.ndarray) -> None:
        full = len(ids) // self.tokens * self.tokens
        for start in range(0, full, self.tokens):
            part = (doc, start, ids[start : start + self.tokens], len(ids), loss[start : start + self.tokens])
            if part[4].sum() <= self.loss:
                self.seal([part])
            else:
                self.pool.extend(self.within_loss(part))
        if full < len(ids):
            self.pool.extend(self.within_loss((doc, full, ids[full:], len(ids), loss[full:])))

    def within_loss(self, part) -> Iterator[tuple]:
        """Cut a piece so that each holds at most the allowed loss-bearing tokens."""
        doc, start, ids, total, loss = part
        while loss.sum() > self.loss:
            cut = int(np.searchsorted(np.cumsum(loss), self.loss, side="right"))
            yield doc, start, ids[:cut], total, loss[:cut]
            start, ids, loss = start + cut, ids[cut:], loss[cut:]
        yield doc, start, ids, total, loss

    def seal(self, parts: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total, loss in parts:
            crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
            self.out.append((doc, start, len(ids), crc, total, self.next, offset, int(loss.sum())))
            offset += len(ids)
        self.next += 1

    def flush(self, final: bool) -> None:
        limits = np.array([self.tokens, self.segments, self.loss], dtype=float)
        pool, self.pool = self.pool, []
        sizes = np.array([(len(p[2]), 1, int(p[4].sum())) for p in pool], dtype=float).reshape(-1, 3)
        shares, alive = sizes / limits, np.ones(len(pool), dtype=bool)
        while alive.any():
            left, parts = np.ones(3), []
            while True:
                at = np.flatnonzero(alive)
                fits = (shares[at] <= left + 1e-12).all(axis=1) if len(at) else np.zeros(0, dtype=bool)
                if not fits.any():
                    break
                best = at[int(np.argmax(np.where(fits, shares[at] @ left, -1.0)))]
                parts.append(pool[best])
                left = left - shares[best]
                alive[best] = False
            gap = self.tokens - sum(len(p[2]) for p in parts)
            at = np.flatnonzero(alive)
            if gap and len(at) and len(parts) < self.segments:
                longest = at[int(np.argmax(sizes[at, 0]))]
                doc, start, ids, total, loss = pool[longest]
                room = self.loss - sum(int(p[4].sum()) for p in parts)
                cut = min(gap, int(np.searchsorted(np.cumsum(loss), room, side="right")))
                if 0 < cut < len(ids):
                    parts.append((doc, start, ids[:cut], total, loss[:cut]))
                    pool[longest] = (doc, start + cut, ids[cut:], total, loss[cut:])
                    sizes[longest] = (len(ids) - cut, 1, int(loss[cut:].sum()))
                    shares[longest] = sizes[longest] / limits
                    gap -= cut
            if gap and not alive.any():
                if not final:
                    self.pool = parts
                    return
                self.tail(parts)
            else:
                self.seal(parts)

    def tail(self, parts: list[tuple]) -> None:
        """The last open sequence, cut into sequences whose lengths are powers of two."""
        total = sum(len(p[2]) for p in parts)
        while total:
            want, taken = 1 << (total.bit_length() - 1), []
            total -= want
            while want:
                doc, start, ids, n, loss = parts.pop(0)
                taken.append((doc, start, ids[:want], n, loss[:want]))
                if len(ids) > want:
                    parts.insert(0, (doc, start + want, ids[want:], n, loss[want:]))
                want -= len(taken[-1][2])
            self.seal(taken)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, tokens: int = SEQUENCE_TOKENS, segments: int = SEQUENCE_SEGMENTS, loss_tokens: int | None = None) -> DataFrame:
    """One row per piece: the document's ids from ``start``, placed at ``offset`` of ``sequence_id``.

    Sequence ids are unique, not dense: the task's number takes the upper bits.
    """
    path, limit = vocabulary or default_vocabulary(), tokens if loss_tokens is None else loss_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path)
        packer = _Packer(TaskContext.get().partitionId() << 36, tokens, segments, limit)
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encoder.encode_to_numpy(text or "", disallowed_special=()).astype("<u4"), np.uint32(END_ID))
                packer.add(doc, ids, np.ones(len(ids), dtype=np.int32))
                if len(packer.pool) >= WINDOW:
                    packer.flush(False)
                if len(packer.out) >= 8192:
                    yield _rows(packer)
        packer.flush(True)
        if packer.out:
            yield _rows(packer)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(frugal(run), PIECES)


def _rows(packer: _Packer) -> pa.RecordBatch:
    columns, packer.out = list(zip(*packer.out)), []
    names = [part.split()[0] for part in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack_conversations(turns: DataFrame, vocabulary: str | None = None, tokens: int = SEQUENCE_TOKENS, segments: int = 16, loss_tokens: int = 768, loss_role: str = "assistant") -> DataFrame:
    """Packs instruction data: one example per conversation, its turns in order; only tokens of ``loss_role`` bear loss.

    Turns of one conversation are gathered on one task; a conversation is one training example.
    """
    path = vocabulary or default_vocabulary()
    told = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path)
        packer = _Packer(TaskContext.get().partitionId() << 36, tokens, segments, loss_tokens)
        for batch in slices(batches):
            for conv, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = [encoder.encode_to_numpy(x["text"] or "", disallowed_special=()).astype("<u4") for x in said]
                bears = [np.full(len(part), int(x["role"] == loss_role), dtype=np.int32) for part, x in zip(ids, said)]
                packer.add(conv, np.append(np.concatenate(ids), np.uint32(END_ID)), np.append(np.concatenate(bears), np.int32(0)))
                if len(packer.pool) >= WINDOW:
                    packer.flush(False)
                if len(packer.out) >= 8192:
                    yield _rows(packer)
        packer.flush(True)
        if packer.out:
            yield _rows(packer)

    return told.mapInArrow(frugal(run), PIECES)
