"""Token-id files with a shared zstandard dictionary.

Every document's ids are serialized in the fewest bytes the vocabulary needs,
compressed by themselves with a dictionary that all files share, and written in
ascending doc_id order. A file is a blob:

    magic "CLTF1\\0", id width (1 byte), 32 bytes SHA-256 of the dictionary,
    number of documents (u32), then per document its id (i64), a null mark (u8)
    and the end of its frame (u64), then the frames.

so one short document is read by its offset alone. Files are kept as the binary
column of a Parquet table in the shared folder, so that any file system that
Spark writes can hold them; the dictionary lies beside them in a table of its
own, and a reader refuses files whose dictionary hash differs.

The dictionary is trained on about SAMPLE_DOCS documents, chosen by hash among
all, and of each the SAMPLE_CHARS from a hashed offset on, or the whole text if
it is no longer; it changes sizes, never contents.

Defined results: null text counts as empty; a null doc_id stands last; rows of
one doc_id follow each other in order of a hash of their text; an empty table gives no
file and an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import importable, shared_dir, written

MAGIC, HEAD, ENTRY = b"CLTF1\0", struct.Struct("<6sB32sI"), struct.Struct("<qBQ")
ENTRY_BYTES = ENTRY.size
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL, FILE_BYTES = 1_000, 4_000, 65_536, 3, 2_000_000


def serialize(ids: bytes, width: int) -> bytes:
    """Little-endian u32 ids in width bytes each."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def restore(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train(samples: list[bytes]) -> bytes:
    """A dictionary of serialized id arrays; raw content where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8


def join_file(rows: list[tuple[int | None, bytes]], width: int, dictionary_hash: bytes) -> bytes:
    ends = np.cumsum([len(f) for _, f in rows]).tolist()
    index = b"".join(ENTRY.pack(d or 0, d is None, e) for (d, _), e in zip(rows, ends, strict=True))
    return HEAD.pack(MAGIC, width, dictionary_hash, len(rows)) + index + b"".join(f for _, f in rows)


def file_index(blob: bytes, dictionary: bytes) -> tuple[int, list[tuple[int | None, int, int]]]:
    """(id width, [(doc_id, start, end of its frame)])."""
    magic, width, digest, n = HEAD.unpack_from(blob)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token file of this dictionary")
    out, start = [], HEAD.size + n * ENTRY.size
    at = start
    for i in range(n):
        d, null, end = ENTRY.unpack_from(blob, HEAD.size + i * ENTRY.size)
        out.append((None if null else d, at, start + end))
        at = start + end
    return width, out


def read_document(blob: bytes, dictionary: bytes, n: int) -> bytes:
    """The u32 ids of the n-th document of a file, by its offset alone."""
    import zstandard

    width, index = file_index(blob, dictionary)
    _, a, b = index[n]
    return restore(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(blob[a:b]), width)


def trained_on(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[bytes, int]:
    """The dictionary and the id width."""
    from corpusloom.llm.tokens import encoder

    tool = encoder(tokenizer, "word")
    width = 2 if tool.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 and end_id < 65_536 else 4
    every = max(1, docs.count() // SAMPLE_DOCS)
    # equal rows have one hash and count once, so the sample is small however often a row stands there
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).distinct()
    start = F.pmod(F.xxhash64("text", F.lit("start")), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    some = chosen.select(F.substring("text", start.cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("t"))
    texts = sorted(r["t"] or "" for r in some.collect())
    return train([serialize(x, width) for x in tool.encode(texts) if x]), width


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes the files and the dictionary; returns their folder."""
    import zstandard

    spark = docs.sparkSession
    importable(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    dictionary, width = trained_on(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).digest()
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"

    def frames(batches):
        import pyarrow as pa

        from corpusloom.llm.tokens import encoder

        tool, last = encoder(tokenizer, "word"), serialize(np.asarray([end_id], "<u4").tobytes(), width)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        for batch in batches:
            out = [press.compress(ids.astype(f"<u{width}").tobytes() + last) for ids in tool.arrays(batch.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "h", "frame"])

    def files(batches):
        import pyarrow as pa

        rows, held, n = [], 0, 0

        def blob():
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([join_file(rows, width, digest)], pa.binary())], names=["n", "blob"])

        for batch in batches:
            for d, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows.append((d, f))
                held += len(f) + ENTRY_BYTES
                if held >= FILE_BYTES:
                    yield blob()
                    rows, held, n = [], 0, n + 1
        if rows:
            yield blob()

    encoded = written(docs.mapInArrow(frames, "doc_id long, h long, frame binary"), "frames")
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]  # a short key: its samples go to the driver
    made = encoded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(files, "n long, blob binary")
    # a file's place in the order: the partition, then its number there
    made.select(F.spark_partition_id().alias("part"), "n", "blob").write.parquet(f"{folder}/files")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.parquet(f"{folder}/dictionary")
    return folder


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, all taken from the files."""
    import zstandard

    importable(spark)
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])

    def decode(batches):
        import zlib

        import pyarrow as pa

        tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for part, n, blob in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                width, index = file_index(blob, dictionary)
                rows, at = [], 0
                for d, a, b in index:
                    ids = restore(tool.decompress(blob[a:b]), width)
                    rows.append((part, n, d, at, len(ids) // 4, zlib.crc32(ids)))
                    at += len(ids) // 4
                kinds = [pa.int32(), pa.int64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "n", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = written(spark.read.parquet(f"{folder}/files").select("part", "n", "blob").mapInArrow(decode, "part int, n long, doc_id long, at long, n_tokens long, ids_crc32 long"), "decoded")
    # sums per task's files, then running sums of these, then running sums within a task: the only window over all rows has a row per task
    files = docs.groupBy("part", "n").agg(F.sum("n_tokens").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("part", "n", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("before")).join(parts, "part").select("part", "n", (F.col("base") + F.col("before")).alias("before"))
    return docs.join(before, ["part", "n"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
