"""Byte-level BPE by merge replay over the distinct words of a block of texts.

The words of a block are laid out once as a chain of symbols. An inverted index maps each rank to the positions of the
token pairs that merge into it; ranks are replayed in ascending order, and a merge touches only its two neighbours. A
text's ids are the ids of its words in order. Blocks are bounded in bytes, so memory does not grow with the input, and
words seen before in a task are not replayed again.

Defined cases: a null or empty text has no ids and decodes to nothing; repeated rows each get their row; extra columns
never clash, as only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLOCK = 2 << 20
#: Words whose ids a task remembers from block to block.
REMEMBERED = 400_000


class Vocabulary:
    """Ranks, the bytes of each id, and the rank of each pair of ids whose bytes join to a token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.first = np.full((256, 256), -1, np.int64)  # by two raw bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def replay(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    inside = np.ones(len(data), bool)  # a symbol with a right neighbour in its word
    inside[ends - 1] = False
    ids = v.single[data].tolist()
    rank = np.full(len(data), -1, np.int64)
    rank[:-1] = v.first[data[:-1], data[1:]]
    at = np.flatnonzero(inside & (rank >= 0))
    at = at[np.argsort(rank[at], kind="stable")]
    levels, begin = np.unique(rank[at], return_index=True)
    index = dict(zip(levels.tolist(), (x.tolist() for x in np.split(at, begin[1:])), strict=False)) if len(at) else {}
    heap = list(index)
    right = np.where(inside, np.arange(1, len(data) + 1), -1).tolist()
    left = np.where(np.append(False, inside[:-1]), np.arange(-1, len(data) - 1), -1).tolist()
    pairs = v.pairs
    while heap:
        r = heapq.heappop(heap)
        places = sorted(index.pop(r))
        for k, p in enumerate(places):
            q = right[p]
            if q < 0 or ids[p] < 0 or pairs.get(ids[p] << 32 | ids[q]) != r:
                continue  # a neighbour was merged meanwhile
            after, before = right[q], left[p]
            ids[p], ids[q] = r, -1
            right[p], right[q] = after, -1
            lower = False
            if after >= 0:
                left[after] = p
                n = pairs.get(r << 32 | ids[after], -1)
                if n >= 0:
                    if n not in index:
                        index[n] = []
                        heapq.heappush(heap, n)
                    index[n].append(p)
                    lower = n < r
            if before >= 0:
                n = pairs.get(ids[before] << 32 | r, -1)
                if n >= 0:
                    if n not in index:
                        index[n] = []
                        heapq.heappush(heap, n)
                    index[n].append(before)
                    lower |= n < r
            if lower and k + 1 < len(places):  # a smaller rank appeared: it goes before the rest of this one
                if r not in index:
                    heapq.heappush(heap, r)
                index.setdefault(r, []).extend(places[k + 1 :])
                break
    final = np.array(ids)
    alive = final >= 0
    cuts = np.cumsum(alive)[ends - 1] * 4
    packed = final[alive].astype("<u4").tobytes()
    return [packed[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


def encode(texts: list[str | None], v: Vocabulary) -> list[bytes]:
    """The ids of each text, packed as in replay."""
    split = [v.split(t) if t else [] for t in texts]
    if len(v.known) > REMEMBERED:
        v.known.clear()
    new = list(set(chain.from_iterable(split)).difference(v.known))
    if new:
        v.known.update(zip(new, replay([w.encode() for w in new], v), strict=True))
    return [b"".join(map(v.known.__getitem__, words)) for words in split]


def decode(packed: bytes, v: Vocabulary) -> bytes:
    return b"".join(map(v.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def paths(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_bpe(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, digests of the packed ids and of the decoded bytes; the packed ids themselves if asked for."""
    where = paths(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(*where)
        for b in slices(batches, "text", BLOCK):
            ids = encode(b.column("text").to_pylist(), v)
            cols = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(decode(x, v)).hexdigest() for x in ids], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_bpe(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text from the packed ids of encode_bpe(with_ids=True)."""
    where = paths(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(*where)
        for b in batches:
            texts = [None if x is None else decode(x, v).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
