"""Content hashes over BINARY columns: full ids, quick ids, Merkle steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import ids

#: Bytes of one piece of a quick id; contents under three pieces have none.
PIECE = 4096
LEAST_QUICK = 3 * PIECE


def _keccak256(data: bytes) -> bytes:
    """Keccak-f[1600] with the original padding (0x01), rate 136."""
    mask = (1 << 64) - 1
    rotate = lambda x, n: ((x << n) | (x >> (64 - n))) & mask if n else x
    constants, r = [], 1
    for _ in range(24):  # round constants from the degree-8 shift register of the standard
        c = 0
        for j in range(7):
            if r & 1:
                c |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        constants.append(c)
    state = [[0] * 5 for _ in range(5)]
    padded = bytearray(data) + b"\x01"
    padded += b"\x00" * (-len(padded) % 136)
    padded[-1] |= 0x80
    for at in range(0, len(padded), 136):
        for i in range(17):
            state[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i: at + 8 * i + 8], "little")
        for rc in constants:
            c = [state[x][0] ^ state[x][1] ^ state[x][2] ^ state[x][3] ^ state[x][4] for x in range(5)]
            d = [c[(x - 1) % 5] ^ rotate(c[(x + 1) % 5], 1) for x in range(5)]
            state = [[state[x][y] ^ d[x] for y in range(5)] for x in range(5)]
            x, y, now = 1, 0, state[1][0]
            for t in range(24):
                x, y = y, (2 * x + 3 * y) % 5
                now, state[x][y] = state[x][y], rotate(now, (t + 1) * (t + 2) // 2 % 64)
            for y in range(5):
                row = [state[x][y] for x in range(5)]
                for x in range(5):
                    state[x][y] = row[x] ^ (~row[(x + 1) % 5] & row[(x + 2) % 5] & mask)
            state[0][0] ^= rc
    return b"".join(state[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


@F.pandas_udf(BinaryType())
def keccak256(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield pd.Series([None if v is None else _keccak256(v) for v in values], dtype=object)


@F.pandas_udf(BinaryType())
def blake2s256(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import hashlib

    for values in batches:
        yield pd.Series([None if v is None else hashlib.blake2s(v).digest() for v in values], dtype=object)


def digest(method: str, data: Column) -> Column:
    """Hash of bytes by method name."""
    if method in ("sha256", "sha512"):
        return F.unhex(F.sha2(data, int(method[3:])))
    if method == "blake2s256":
        return blake2s256(data)
    if method == "keccak256":
        return keccak256(data)
    raise ValueError(f"no one-shot hash is named {method}")


def stateful_method(method: str) -> str:
    """The methods that hash piece by piece; others raise."""
    if method not in ("sha256", "sha512"):
        raise ValueError(f"{method} cannot be computed piece by piece")
    return method


def chunk_id(data: Column, method: str = "sha256") -> Column:
    return ids.make_id(method, digest(method, data))


def mix_chunk_id(data: Column, method: str = "sha256") -> Column:
    """Id that carries the length of its content."""
    kind = {"sha256": "mix256", "sha512": "mix512"}.get(method, f"mix{method}")
    return ids.make_id(kind, ids.mix_hash(F.length(data).cast("bigint"), digest(method, data)))


def quick_id(data: Column) -> Column:
    """Id from the first and the middle piece; null under ``LEAST_QUICK`` bytes."""
    n = F.length(data)
    middle = F.substring(data, F.floor(n / 2).cast("int") + 1, F.lit(PIECE))
    return F.when(n >= LEAST_QUICK, ids.make_id("qcid", ids.mix_hash(n.cast("bigint"), F.unhex(F.sha2(F.concat(F.substring(data, 1, PIECE), middle), 256)))))


def quick_id3(data: Column) -> Column:
    """Id from the first, the middle and the last piece: never equal to ``quick_id``."""
    n = F.length(data)
    middle = F.substring(data, F.floor(n / 2).cast("int") + 1, F.lit(PIECE))
    last = F.substring(data, n - PIECE + 1, F.lit(PIECE))
    return F.when(n >= LEAST_QUICK, ids.make_id("qcid", ids.mix_hash(n.cast("bigint"), F.unhex(F.sha2(F.concat(F.substring(data, 1, PIECE), middle, last), 256)))))


def parent_hash(left: Column, right: Column) -> Column:
    """Merkle step; a node without a right sibling is hashed alone."""
    return F.unhex(F.sha2(F.concat(left, F.coalesce(right, F.lit("").cast("binary"))), 256))


def expected_id(data: Column, claimed: Column) -> Column:
    """The id that content has under the type of a claimed id (sha2 types and quick ids)."""
    kind = ids.id_type(claimed)
    return (
        F.when(kind == "sha256", chunk_id(data)).when(kind == "sha512", chunk_id(data, "sha512"))
        .when(kind == "mix256", mix_chunk_id(data)).when(kind == "mix512", mix_chunk_id(data, "sha512"))
        .when(kind == "qcid", quick_id(data))
    )
