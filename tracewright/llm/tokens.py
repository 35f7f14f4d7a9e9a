"""Token ids in a binary file format with per-document compression under one shared zstandard dictionary.

Format: shards, one row of a Parquet table each, so that the files lie wherever Spark writes and a task that is run
again replaces its own. A shard holds the documents of one range of doc_id in ascending order: their ids, counts of
tokens, byte offsets into `payload`, the tokens before each of them in the range, and the hash of the dictionary.
`payload` is the documents' zstandard frames end to end. A short document is read by slicing one frame, without
touching its neighbours. The dictionary is a one-row table beside the shards.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first; rows that repeat a doc_id follow
each other by their number of ids, then by their compressed bytes; an empty table gives no shards and reads back as no rows; extra columns never clash, as only
doc_id and text are read. A literal of one of the tokenizer's added tokens, such as <|endoftext|>, is that token's id with
added=True, as the library has it by default; with added=False it is text like any other.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, slices

END = 1
BLOCK = 6 << 20
#: Words, and stems, that a task remembers.
REMEMBERED = 800_000
SHARD_BYTES = 4 << 20
RANGES_PER_PARTITION = 4
LEVEL = 3


#: Words that the model takes as they are: Latin letters, which are their own lower case and one run for the splitter.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
STEM_END = re.compile(rb"(?m)(?<=[A-Za-z0-9])[!-/:-@\[-`{-~]+$")
#: Lead bytes of combining marks in UTF-8; where they are, lower case is left to the library, after its normal form.
MARKS = (b"\xcc", b"\xcd")


class Library:
    """The tokenizer, and what a task remembers of words and of stems."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # for stems, which are cut out between literals of added tokens
        #: Ids of added tokens, by names that no UTF-8 text holds.
        self.added = {b"\xff" + t.content.encode(): pack("<I", i) for i, t in self.whole.get_added_tokens_decoder().items()}
        self.literals = sorted((k[1:] for k in self.added), key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, self.literals)) + b")")
        self.model = self.whole.model
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # each Latin letter as the model's symbols for its bytes
        self.symbols = {ord(c): letters.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))}
        self.words: dict[bytes, bytes] = dict(self.added)
        self.stems: dict[bytes, bytes] = {b"": b""}

    def split(self, text: bytes, added: bool) -> list[bytes]:
        """The words of a text, and between them the names of the added tokens."""
        if added and any(t in text for t in self.literals):
            parts = self.cut.split(text)
            return [w for k, x in enumerate(parts) for w in ([b"\xff" + x] if k % 2 else self.split(x, False))]
        return (text if any(m in text for m in MARKS) else text.lower()).split()

    def learn(self, new: list[bytes]) -> None:
        """Add the packed ids of words without white space."""
        if len(self.stems) > REMEMBERED:
            self.stems = {b"": b""}
        joined = b"\n".join(new)
        stems = STEM_END.sub(b"", joined)
        if not any(m in stems for m in MARKS):
            stems = stems.lower()
        stems = stems.split(b"\n")
        tails = [w[len(s) :] for w, s in zip(new, stems, strict=True)]
        known = self.stems
        for s in set(stems).union(tails).difference(known):
            text = s.decode()
            if PLAIN.fullmatch(text):
                found = [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.symbols))]
            else:
                found = self.whole.encode(text, add_special_tokens=False).ids
            known[s] = pack(f"<{len(found)}I", *found)
        self.words.update(zip(new, [known[s] + known[t] if t else known[s] for s, t in zip(stems, tails, strict=True)], strict=True))


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def encode(texts: list[bytes | None], path: str, added: bool = False) -> list[bytes]:
    """Ids of each UTF-8 text with the end id, packed as little-endian unsigned 32-bit integers.

    No token of this vocabulary spans white space or the border from a letter or digit to ASCII punctuation, and the
    library lower-cases. So texts are put together from their words, words from a stem and the punctuation after it,
    and each distinct stem is encoded once: by the library's model where the library's splitter would keep it whole, else by
    the library."""
    own = library(path)
    split = [own.split(x, added) if x else [] for x in texts]
    new = list(set(chain.from_iterable(split)).difference(own.words))
    if len(own.words) + len(new) > REMEMBERED and own.words:
        own.words.clear()
        own.words.update(own.added)
        new = list(set(chain.from_iterable(split)).difference(own.words))
    if new:
        own.learn(new)
    end, known = pack("<I", END), own.words
    return [b"".join(map(known.__getitem__, words)) + end for words in split]


def _width(path: str) -> int:
    """Bytes of an id in the files."""
    return 2 if library(path).whole.get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, samples: int = 2000, size: int = 64 << 10, sample_bytes: int = 8 << 10, added: bool = False) -> bytes:
    """A dictionary from the id arrays of at most `samples` documents chosen by hash of doc_id: of a long one a slice that
    gives up to sample_bytes, from a place that the hash chooses anywhere in the text. Only the files' size depends on it; empty where there is too little to train on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(f"<u{_width(path)}").tobytes()[:sample_bytes] for x in encode(b.column("text").to_pylist(), path, added)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    ids = [r["doc_id"] for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(samples).collect()]
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.greatest(F.length("text") - 4 * sample_bytes, F.lit(0)) + 1)
    slice_ = F.substring(F.col("text"), place.cast("int"), F.lit(4 * sample_bytes))
    chosen = docs.where(F.col("doc_id").isin(ids)).select("doc_id", slice_.cast("binary").alias("text"))
    rows = chosen.mapInArrow(run, "doc_id long, ids binary").orderBy("doc_id", "ids").limit(2 * samples).collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r["ids"]) for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _zdict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


SHARD = "range int, dictionary_sha256 string, width int, doc_ids array<long>, counts array<int>, before array<long>, offsets array<long>, payload binary"


def write_tokens(docs: DataFrame, out: str, path: str | None = None, added: bool = False) -> None:
    """Encode docs and write shards and dictionary under out."""
    spark, where = docs.sparkSession, path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = train_dictionary(rows, where, added=added)
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, bytearray(raw))], "sha256 string, dictionary binary").write.parquet(f"{out}/dictionary")
    parts = partitions(spark)
    cuts = rows.select(F.percentile_approx("doc_id", [i / (RANGES_PER_PARTITION * parts) for i in range(1, RANGES_PER_PARTITION * parts)], 10_000)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, press = _width(where), zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(raw), write_checksum=False)
        for b in slices(batches, "text", BLOCK):
            ids = encode(b.column("text").to_pylist(), where, added)
            frames = [press.compress(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes()) for x in ids]
            ranges = np.searchsorted(cuts, b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ranges.astype(np.int32)), pa.array([len(x) // 4 for x in ids], pa.int32()), pa.array(frames, pa.binary())], ["doc_id", "range", "n", "frame"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(where)
        now, held, base = None, [], 0

        def close() -> pa.RecordBatch:
            ids, counts, frames = zip(*held, strict=True)
            before = base + np.append(0, np.cumsum(counts, dtype=np.int64)[:-1])
            offsets = np.append(0, np.cumsum([len(f) for f in frames], dtype=np.int64))
            cells = [[now], [name], [width], [list(ids)], [list(counts)], [before.tolist()], [offsets.tolist()], [b"".join(frames)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names)

        types = [pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = [c.split()[0] for c in SHARD.split(", ")]
        size = 0
        for b in batches:
            for i, r, n, f in zip(*(b.column(c).to_pylist() for c in ("doc_id", "range", "n", "frame")), strict=True):
                if held and (r != now or size + len(f) > SHARD_BYTES):
                    yield close()
                    base = base + sum(x[1] for x in held) if r == now else 0
                    held, size = [], 0
                now = r
                held.append((i, n, f))
                size += len(f)
        if held:
            yield close()

    packed = rows.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(compress, "doc_id long, range int, n int, frame binary")
    dealt = packed.repartition(parts, "range").sortWithinPartitions("range", F.asc_nulls_first("doc_id"), "n", "frame")
    dealt.mapInArrow(shards, SHARD).write.option("compression", "none").parquet(f"{out}/shards")


def frame(shard, position: int, dictionary: bytes) -> np.ndarray:
    """The ids of one document of a shard row, read without its neighbours."""
    if hashlib.sha256(dictionary).hexdigest() != shard["dictionary_sha256"]:
        raise ValueError("the shard was written with another dictionary")
    a, b = shard["offsets"][position], shard["offsets"][position + 1]
    data = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary)).decompress(bytes(shard["payload"][a:b]))
    return np.frombuffer(data, f"<u{shard['width']}").astype("<u4")


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and its ids if asked for."""
    shards, kept = spark.read.parquet(f"{out}/shards"), spark.read.parquet(f"{out}/dictionary").first()
    raw = bytes(kept["dictionary"])
    # one number for each range, of which there are as many as partitions allow
    sums = dict(shards.groupBy("range").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).collect())
    starts, total = {}, 0
    for r in sorted(sums):
        starts[r] = total
        total += sums[r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=_zdict(raw))
        for b in batches:
            for s in range(b.num_rows):
                if b.column("dictionary_sha256")[s].as_py() != kept["sha256"]:
                    raise ValueError("a shard was written with another dictionary")
                payload, width = b.column("payload")[s].as_buffer(), b.column("width")[s].as_py()
                at = b.column("offsets")[s].as_py()
                view = memoryview(payload)
                ids = [np.frombuffer(opener.decompress(view[x:y]), f"<u{width}").astype("<u4") for x, y in zip(at, at[1:], strict=False)]
                base = starts[b.column("range")[s].as_py()]
                cols = [pa.array(b.column("doc_ids")[s].as_py(), pa.int64()), pa.array([base + x for x in b.column("before")[s].as_py()], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([x.tobytes() for x in ids], pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_files(docs: DataFrame, path: str | None = None, added: bool = False) -> DataFrame:
    """Write docs to a new place in the shared folder and read the digests back."""
    out = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out, path, added)
    return read_tokens(docs.sparkSession, out)
