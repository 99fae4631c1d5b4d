"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class k holds the lengths in (capacity / (k + 1), capacity / k]; a bin of class
k takes exactly k pieces, so a bin is decided by counting and never by search.
Documents may be cut: each gives whole sequences first, and what remains is cut
into the largest exact reciprocals (capacity / 2, / 4, ... down to ``SMALL``)
and one piece below that. Bins of exact reciprocals fill to the last token;
bins of small pieces waste less than one piece.

Each task packs the rows of its scan split on its own: no shuffle and no state
beyond the open bins (fewer than ``capacity`` pieces a class). At its end the
open bins' pieces are laid end to end and cut at the capacity; the last run is
cut into powers of two, which need no padding. A task that is run again makes
the same sequences under the same ids, as a split's rows are in file order.

Defined results: null text counts as empty and gives the separator alone; an
empty table gives no pieces; repeated rows are each packed; of the input only
the id column is carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
SMALL = 32
SEPARATOR = 0
#: Most pre-tokens that a task remembers the ids of (about 250 bytes each).
REMEMBERED = 300_000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint"

#: The pre-token pattern of the byte-level vocabulary for texts of ASCII and
#: Latin-1 letters, where a class is a plain list. Other texts go to the tokenizer whole.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼½¾"
_S = r"\s"
PLAIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|{_S}+(?!\S)|{_S}+"


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, with a bounded memory of pre-tokens.

    The ids are those of the ``tokenizers`` vocabulary file; its rank file gives
    the same ids for one pre-token in less time (held against it in the tests).
    """

    def __init__(self, vocabulary: str, ranks: str | None = None):
        import base64
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.piece = None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.piece = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        # The separators U+001C to U+001F are white space to Python only.
        self.odd = re.compile(r"[^\x00-\x1b\x20-ÿ]").search
        self.split = re.compile(PLAIN).findall
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        import numpy as np

        if self.piece and not any(s in text for s in self.specials):
            ids = self.piece.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.piece is None or self.odd(text) or any(s in text for s in self.specials):
            return self._whole(text)
        known = self.known
        pieces = self.split(text)
        for p in set(pieces).difference(known):
            if len(known) >= REMEMBERED:
                known = self.known = {}
            known[p] = self._whole(p)
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:  # the memory was emptied on the way
            return b"".join([known[p] if p in known else self._whole(p) for p in pieces])


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in its order."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    size = capacity // 2
    while rest >= SMALL and size >= SMALL:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    if rest:
        out.append(rest)
    return out


class Packer:
    """The open bins of one task. A piece is (doc_id, start, length, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        total, at = sum(p[2] for p in pieces), 0
        for p in pieces:
            yield (*p, self.next_id, at, total)
            at += p[2]
        self.next_id += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // piece[2]
        if k == 1:
            yield from self._close([piece])
            return
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """Pack what the open bins hold, end to end."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(p[2] for p in rest)
        now: list[tuple] = []
        room = 0
        while rest or now:
            if room == 0:
                if now:
                    yield from self._close(now)
                    now = []
                if not rest:
                    break
                room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                left -= room
            doc, start, n, ids, total = rest.pop(0)
            take = min(n, room)
            now.append((doc, start, take, ids[: 4 * take], total))
            room -= take
            if take < n:
                rest.insert(0, (doc, start + take, n - take, ids[4 * take:], total))


def pack(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per piece, with its ids, its sequence and its place there."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(vocabulary, ranks), Packer(capacity, TaskContext.get().partitionId() << 33)
        end = SEPARATOR.to_bytes(4, "little")

        def made() -> Iterator[tuple]:
            for batch in batches:
                for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(body.as_py() or "") + end
                    total, at = len(ids) // 4, 0
                    for n in cuts(total, capacity):
                        yield from packer.add((key, at, n, ids[4 * at: 4 * (at + n)], total))
                        at += n
            yield from packer.finish()

        rows: list[tuple] = []
        for row in made():
            rows.append(row)
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, SCHEMA)
