"""Token ids in packs: each document compressed on its own with one shared zstandard dictionary.

A pack is one byte string, stored as a row of a Parquet table that Spark commits as a whole:

    magic "LVT1", 32-byte SHA-256 of the dictionary, number of documents n (u32)
    n entries of the offset index: doc_id (i64), null flag (u8), ids before it in the pack (u64), ids (u32), end of its frame (u64)
    n zstandard frames, each the ids of one document as little-endian u32

The dictionary is kept next to the packs. To read one document, its pack is found by the packs' id ranges, its frame
by the index; nothing else is decompressed.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafvoice.llm.buffers import text_slices
from leafvoice.llm.tables import Steps, table
from leafvoice.plans.blocks import run_folder

MAGIC = b"LVT1"
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("before", "<u8"), ("n", "<u4"), ("end", "<u8")])
#: A pack is closed when its frames reach this size; a longer document has a pack of its own.
PACK_BYTES = 1 << 20
#: Documents the dictionary is trained on: those with the least hashes, whatever the corpus' size.
DICTIONARY_DOCS = 2000
DICTIONARY_BYTES = 64 << 10
#: Word ids kept by a worker before it starts anew.
CACHE_WORDS = 500_000


_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Letters of Latin-1 have one small letter each, the same for the tokenizer.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[^\\w\\s]*", re.ASCII)
_PLAIN_AND_MARKS = re.compile("([a-zß-öø-ÿ]+)([^'\\w\\s]+)", re.ASCII)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as its Latin-1 character, any other as the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordEncoder(dict):
    """Piece -> bytes of its ids. The tokenizer cuts at white space first and drops it, so a text's ids are those of
    its blank-separated pieces, in order. Pieces are encoded once and remembered in two generations."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.unit = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}

    def _plain(self, piece: str) -> bytes:
        """Lower-case Latin letters in composed form: one unit before and after the tokenizer's own first steps."""
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.unit(piece)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            # The tokenizer finds its added tokens before it lower-cases, so only letters are lower-cased here.
            low = piece.lower() if piece.isascii() or _LATIN.fullmatch(piece) else piece
            if _PLAIN.fullmatch(low):
                out = self._plain(low)
            elif (m := _PLAIN_AND_MARKS.fullmatch(low)) and m[2].isascii():
                out = self[m[1]] + self[m[2]]
            else:
                out = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join([self[p] for p in text.replace("\n", " ").split(" ")])


def train_dictionary(samples: list[bytes]) -> bytes:
    """Too few or too small samples give an empty dictionary, which compresses as none."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(docs: list[tuple[int | None, int, bytes]], dictionary_hash: bytes) -> bytes:
    """docs: (doc_id, ids, frame)."""
    index = np.zeros(len(docs), ENTRY)
    before = end = 0
    for i, (doc_id, n, frame) in enumerate(docs):
        end += len(frame)
        index[i] = (0 if doc_id is None else doc_id, doc_id is None, before, n, end)
        before += n
    return b"".join([MAGIC, dictionary_hash, np.array([len(docs)], "<u4").tobytes(), index.tobytes(), *(d[2] for d in docs)])


def unpack_index(data: bytes, dictionary: bytes) -> tuple[np.ndarray, int]:
    """The offset index, and where the frames begin. A pack of another dictionary raises an error."""
    if data[:4] != MAGIC or data[4:36] != hashlib.sha256(dictionary).digest():
        raise ValueError("not a pack of this dictionary")
    n = int(np.frombuffer(data, "<u4", 1, 36)[0])
    return np.frombuffer(data, ENTRY, n, 40), 40 + n * ENTRY.itemsize


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _pack(shared, level: int, tokenizer: str, end_id: int):
    def run(batches):
        encode, end = WordEncoder(tokenizer).encode, array("I", [end_id]).tobytes()
        dictionary = shared.value
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=True).compress
        digest, part, number = hashlib.sha256(dictionary).digest(), TaskContext.get().partitionId(), 0
        docs, size = [], 0

        def close():
            ids = sum(d[1] for d in docs)
            known = [d[0] for d in docs if d[0] is not None]
            return pa.RecordBatch.from_pylist([{
                "part": part, "pack": number, "n_docs": len(docs), "n_ids": ids, "first_doc": min(known, default=None),
                "last_doc": max(known, default=None), "data": pack(docs, digest)}], schema=PACKS)

        for batch, data, offsets in text_slices(batches):
            raw = data.tobytes()
            for r, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = encode(raw[offsets[r]: offsets[r + 1]].decode()) + end
                docs.append((doc_id, len(ids) // 4, compress(ids)))
                size += len(docs[-1][2])
                if size >= PACK_BYTES:
                    yield close()
                    docs, size, number = [], 0, number + 1
        if docs:
            yield close()
    return run


PACKS = pa.schema([("part", pa.int32()), ("pack", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
                   ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("data", pa.binary())])
_PACKS = "part int, pack int, n_docs int, n_ids long, first_doc long, last_doc long, data binary"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, level: int = 3) -> None:
    """Encode ``docs`` (doc_id, text) and write dictionary and packs under ``folder``, in ascending doc_id order.

    Null and empty texts are the end id alone; a null doc_id comes first; rows with equal doc_id are ordered by text.
    Ranges of doc_id are dealt over the tasks, so the order costs one exchange and no task sees the whole. The
    dictionary is trained on ``DICTIONARY_DOCS`` documents, those whose doc_id has the least hash (of very long ones
    the beginning; this concerns the dictionary only).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = F.xxhash64("doc_id")
    least = docs.select(place.alias("h")).orderBy("h").limit(DICTIONARY_DOCS).agg(F.max("h").alias("h")).first()["h"]
    sample = docs.where(place <= F.lit(least)).select(F.substring("text", 1, 16384).alias("text")).limit(DICTIONARY_DOCS)
    encode = WordEncoder(tokenizer).encode
    dictionary = train_dictionary([encode(r["text"] or "") for r in sample.collect()])
    spark.createDataFrame([(dictionary, hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    # Only doc_id is sampled for the ranges; equal ones fall into one.
    (docs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order[0]).sortWithinPartitions(*order)
     .mapInArrow(_pack(shared, level, tokenizer, end_id), _PACKS).write.mode("overwrite").parquet(f"{folder}/packs"))


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])


def _unpack(shared):
    def run(batches):
        dictionary = shared.value
        decompress = _decompressor(dictionary).decompress
        for batch in batches:
            starts = batch.column(0).to_pylist()
            for start, data in zip(starts, batch.column(1)):
                data = data.as_py()
                index, at = unpack_index(data, dictionary)
                ends = at + index["end"].astype(np.int64)
                begins = np.concatenate([[at], ends[:-1]])
                frames = [decompress(data[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if e["null"] else int(e["doc_id"]) for e in index], pa.int64()),
                     pa.array(start + index["before"].astype(np.int64)), pa.array([len(f) // 4 for f in frames], pa.int64()),
                     pa.array(frames, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])
    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian u32) of every document under ``folder``; ``start`` counts the ids
    of all documents before it. Totals are summed by part first, so no task orders all packs."""
    packs = spark.read.parquet(f"{folder}/packs")
    parts = packs.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    starts = Steps(spark, "tokens").keep(packs.select("part", "pack", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_part")).join(parts, "part") \
        .select("part", "pack", (F.col("before") + F.col("in_part")).alias("start")), "starts")
    shared = spark.sparkContext.broadcast(_dictionary(spark, folder))
    return packs.select("part", "pack", "data").join(starts, ["part", "pack"]).select("start", "data").mapInArrow(
        _unpack(shared), "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents of that id: the packs are pruned by their id ranges, only its frames are decompressed."""
    dictionary, out = _dictionary(spark, folder), []
    for r in spark.read.parquet(f"{folder}/packs").where(F.lit(doc_id).between(F.col("first_doc"), F.col("last_doc"))).select("data").toLocalIterator():
        index, at = unpack_index(bytes(r["data"]), dictionary)
        for i in np.flatnonzero((index["doc_id"] == doc_id) & (index["null"] == 0)):
            a, b = at + int(index["end"][i - 1] if i else 0), at + int(index["end"][i])
            out.append(np.frombuffer(_decompressor(dictionary).decompress(bytes(r["data"])[a:b]), "<u4"))
    return out


def token_digests(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as packs under the run's folder, read them back, one row per document."""
    import public_tokenizers

    spark = docs.sparkSession
    folder = f"{run_folder(spark)}/packs-{uuid.uuid4().hex}"
    write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_token_packs(spark, sf_dir):
    """Whole documents as packs of token ids, read back."""
    return token_digests(table(spark, sf_dir, "documents"))
