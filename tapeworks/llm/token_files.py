"""Token ids in ORC files, in ascending order of doc_id, and what reads them back.

``write_tokens`` deals the rows to contiguous ranges of (doc_id, text hash), sorts each, encodes it in that order and writes one ORC file per
range.  Integers are run-length encoded by ORC; ``STRIPE_BYTES`` bounds what one reader decodes at once, a row index entry is kept every
``INDEX_ROWS`` rows, and Bloom filters lie on doc_id, so that readers split files by stripes and skip stripes and row groups without
decoding them.  A file row holds

    part long, doc_id long, local_start long (ids before it in its file), n_tokens long (end id included), ids array<int>

and the number of ids before a document is its file's base plus ``local_start``.  Bases come from one row per file (``file_bases``): no id is
counted twice, no running sum leaves its task.

Every distinct chunk of the texts is encoded once per worker, as long as it stays in the worker's store of recent chunks.  A chunk ends where a
blank or line feed follows another character, or a sign of ASCII a letter or digit; the byte-level pattern never crosses such places, so the ids of
a text are those of its chunks in sequence.  Texts that hold other white space or the text of an added token are encoded in one piece.

Null and empty texts are the end id alone; a null doc_id comes before all others; rows of one doc_id follow each other by text hash, equal rows in
any order; equal rows form one range however many they are (sorted with spilling, encoded batch by batch); an empty table gives an empty
result; other columns are ignored.  Ids of 2^31 and more don't fit the format and none of the vocabularies has them.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_bounded, map_arrow, pick

SCHEMA = "part long, doc_id long, local_start long, n_tokens long, ids array<int>"
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
CACHED_CHUNKS = 500_000
BATCH_BYTES = 8 << 20
FILE_ROWS = 500_000
#: white space other than blank and line feed
_OTHER_SPACE = r"[\x{9}\x{b}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_KIND = np.zeros(256, np.uint8)  # 0: any other byte, 1: blank or line feed, 2: ASCII letter or digit, 3: other ASCII sign
_KIND[33:127] = 3
for _span in (b"az", b"AZ", b"09"):
    _KIND[_span[0] : _span[1] + 1] = 2
_KIND[[10, 32]] = 1
_CUT = np.zeros((4, 4), bool)  # between which kinds a chunk ends
_CUT[[0, 2, 3], 1] = _CUT[2, 3] = True


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Encoder:
    """Ids of whole texts, with the ids of ``CACHED_CHUNKS`` chunks kept for reuse (when full, those of the last texts stay).

    Chunks met for the first time are encoded as joined texts, whose ids are cut where the bytes of a chunk end.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token: its characters stand for one byte each
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        # known chunks, where the ids of each begin (one more at the end), and all their ids
        self.known, self.at, self.ids = pa.array([], pa.large_binary()), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each chunk begin (one more at the end), and all their ids."""
        text = chunks.to_pylist()
        # such chunks don't meet when joined: they begin with a blank or line feed and end with another character
        joined = np.array([c[0] in b" \n" and c[-1] not in b" \n" for c in text], bool)
        inner = chunks.filter(pa.array(joined))
        groups = [b"".join(inner.slice(i, 256).to_pylist()).decode() for i in range(0, len(inner), 256)]
        ids = np.array([i for x in self._plain(groups) for i in x], np.int32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(pc.binary_length(inner).to_numpy(zero_copy_only=False))) + 1
        others = self._plain([c.decode() for c, j in zip(text, joined) if not j])
        sizes = np.zeros(len(text), np.int64)
        sizes[joined] = np.diff(ends, prepend=0)
        sizes[~joined] = [len(x) for x in others]
        at = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(at[-1], np.int32)
        out[_ranges(at[:-1][joined], sizes[joined])] = ids
        out[_ranges(at[:-1][~joined], sizes[~joined])] = [i for x in others for i in x]
        return at, out

    def _ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct chunks, from the store where it has them; the others enter it."""
        place = pc.index_in(chunks, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = place < 0
        if new.any():
            fresh = chunks.filter(pa.array(new))
            at, ids = self._encode_chunks(fresh)
            place[new] = len(self.known) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, fresh])
            self.at, self.ids = np.concatenate((self.at, self.at[-1] + at[1:])), np.concatenate((self.ids, ids))
        sizes = self.at[place + 1] - self.at[place]
        at, ids = np.concatenate(([0], np.cumsum(sizes))), self.ids[_ranges(self.at[place], sizes)]
        if len(self.known) > CACHED_CHUNKS:
            self.known, self.at, self.ids = chunks, at, ids
        return at, ids

    def _in_chunks(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts whose white space is blanks and line feeds."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
        if not len(ends) or not ends[-1]:
            return [np.zeros(0, np.int32)] * len(ends)
        data = np.frombuffer(b"".join(t.as_buffer() for t in texts), np.uint8)
        kind = _KIND[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = _CUT[kind[:-1], kind[1:]]
        cut[ends] = cut[0] = True
        offsets = np.nonzero(cut)[0]
        chunks = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        at, ids = self._ids_of(chunks.dictionary)
        place = chunks.indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(at)[place]
        out = ids[_ranges(at[:-1][place], sizes)]
        return np.split(out, np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(offsets, ends[:-1])])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, _OTHER_SPACE)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        whole = whole.to_numpy(zero_copy_only=False)
        plain = iter([np.array(x, np.int32) for x in self._plain(texts.filter(pa.array(whole)).to_pylist())])
        cut = iter(self._in_chunks(texts.filter(pa.array(~whole))))
        return [next(plain if w else cut) for w in whole.tolist()]


@lru_cache(maxsize=1)
def _encoder(name: str) -> Encoder:
    return Encoder(SparkFiles.get(name))


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``BATCH_BYTES`` of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES)))
        yield at, until
        at = until


def _encoded(batches: Iterator[pa.RecordBatch], name: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order -> rows of its file; the number of ids so far is all that is kept between batches."""
    encode, part, before = _encoder(name), TaskContext.get().partitionId(), 0
    end = np.array([end_id], np.int32)
    for batch in batches:
        for a, b in _slices(batch.column("text")):
            ids = encode(batch.column("text").slice(a, b - a))
            sizes = np.array([len(x) + 1 for x in ids])
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([y for x in ids for y in (x, end)]), pa.int32()))
            columns = [pa.array(np.full(b - a, part)), batch.column("doc_id").slice(a, b - a), pa.array(offsets[:-1] + before), pa.array(sizes), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "local_start", "n_tokens", "ids"])
            before += int(offsets[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, files: int | None = None, stripe_bytes: int = STRIPE_BYTES,
                 index_rows: int = INDEX_ROWS) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write the ids to ``path``.

    ``tokenizer`` is a vocabulary file the driver can read; Spark hands it to the executors.  ``files`` fixes the number of ranges; else it is the
    session's number of shuffle partitions, merged at run time to its advisory size.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    keys = [F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc()]
    rows = pick(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    ordered = dealt.sortWithinPartitions(*keys).select("doc_id", "text")
    encoded = ordered.mapInArrow(partial(_encoded, name=os.path.basename(tokenizer), end_id=end_id), SCHEMA)
    (encoded.write.mode("overwrite").option("compression", "lz4").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def file_bases(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: part, base (ids in the files before it), n_ids, n_docs, and the doc_ids it spans; reads three narrow columns."""
    rows = (_files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"),
                                                    F.max("doc_id").alias("last_id")).orderBy("part").limit(FILE_ROWS + 1).collect())
    if len(rows) > FILE_ROWS:
        raise ValueError(f"more than {FILE_ROWS} files; write fewer and larger ones")
    base, out = 0, []
    for r in rows:
        out.append((r["part"], base, r["n_ids"], r["n_docs"], r["first_id"], r["last_id"]))
        base += r["n_ids"]
    return spark.createDataFrame(out, "part long, base long, n_ids long, n_docs long, first_id long, last_id long")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids from the files.

    With ``doc_ids`` only these documents: files whose span holds none are left out by their part, and within files statistics and Bloom filters
    of doc_id name the stripes and row groups to decode.
    """
    rows, bases = _files(spark, path), file_bases(spark, path)
    if doc_ids is not None:
        wanted = sorted(set(doc_ids))
        spans = F.exists(F.array(*map(F.lit, wanted)).cast("array<long>"), lambda d: d.between(F.col("first_id"), F.col("last_id")))
        bases = bases.filter(spans)
        rows = rows.filter(F.col("doc_id").isin(wanted) & F.col("part").isin([r["part"] for r in bases.select("part").collect()]))
    placed = rows.join(broadcast_bounded(bases.select("part", "base"), FILE_ROWS), "part")
    return placed.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def ids_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC32 of the ids as little-endian 32-bit integers."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.table([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(tokens, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
