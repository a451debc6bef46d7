"""Helpers of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import importable, shared_dir, table, written  # noqa: F401

#: a word, wherever an operator's contract says words
WORD = r"[^\x20\x09-\x0D]+"


def whole(c: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(c, F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, amount: int, each: int) -> int:
    """Groups for an amount of work of which one group should hold about each: as many as there are shuffle partitions at least."""
    return max(2, shuffle_parts(spark), -(-amount // each))


def fresh(docs: DataFrame, name: str) -> str:
    """name, with as many underscores more as no column of docs needs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, doc_id: str, text: str, lid: str = "lid") -> tuple[DataFrame, bool]:
    """docs with the column lid, and whether it is unique: the id itself where ids are, else the place in order of (id, text), null ids last, equal rows sharing one. docs must have no column of that name."""
    n = docs.count()
    if docs.where(F.col(doc_id).isNotNull()).select(doc_id).distinct().count() == n:
        return docs.withColumn(lid, F.col(doc_id).cast("long")), True
    order = [F.col(doc_id).asc_nulls_last(), F.col(text).asc_nulls_last()]
    in_order = docs.repartitionByRange(max(2, shuffle_parts(docs.sparkSession)), *order).sortWithinPartitions(*order)
    own_id, own_text, place = (fresh(docs, name) for name in ("nb_id", "nb_text", "nb_place"))
    held = written(in_order.withColumn(place, F.monotonically_increasing_id()), "numbered")
    same = held.groupBy(F.col(doc_id).alias(own_id), F.col(text).alias(own_text)).agg(F.min(place).alias(lid))
    joined = held.join(same, F.col(doc_id).eqNullSafe(F.col(own_id)) & F.col(text).eqNullSafe(F.col(own_text)))
    return joined.select(*docs.columns, lid), False


#: a key with over one row in so many is hot; so no more than so many keys are
HOT = 4_096


def least_of(rows: DataFrame, keys: list[str], value: str, name: str, alone: bool = True) -> DataFrame:
    """rows with name, the smallest value among the rows of the same keys, null where these have none; alone: also rows whose keys no other row has. rows should be a written table: it is read several times.

    Smallest values are aggregated before the shuffle. The fewer than HOT keys that hold over a HOT-th of all rows are
    broadcast, so no task of the join gets more rows of one key."""
    n = rows.count()
    sums = rows.groupBy(*keys).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("lo_rows"))
    several = written(sums.where("lo_rows > 1"), "least")
    is_hot = F.col("lo_rows") * HOT > n
    found = rows.join(F.broadcast(several.where(is_hot)), keys, "left")
    rest = found.where("lo_rows IS NULL").select(*rows.columns).join(several.where(~is_hot), keys, "left" if alone else "inner")
    own = F.when(F.col("lo_rows").isNull(), F.col(value)).otherwise(F.col(name))
    return found.where("lo_rows IS NOT NULL").select(*rows.columns, name).unionByName(rest.select(*rows.columns, own.alias(name)))



def pack(*arrays) -> bytes:
    """Arrays byte plane by byte plane, compressed: small numbers take few bytes."""
    import struct

    import numpy as np
    import zstandard

    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(struct.pack("<4sQ", a.dtype.str.encode(), a.size) + a.reshape(-1).view(np.uint8).reshape(a.size, a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes, n: int) -> list:
    """The n arrays of a blob of pack."""
    import struct

    import numpy as np
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for _ in range(n):
        kind, size = struct.unpack_from("<4sQ", data, at)
        kind = np.dtype(kind.rstrip(b"\0").decode())
        at += 12
        planes = np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += size * kind.itemsize
    return out


def unpacked(blobs, n: int) -> list:
    """The n arrays of all blobs, each joined over the blobs."""
    import numpy as np

    return [np.concatenate(x) for x in zip(*(unpack(b, n) for b in blobs), strict=True)]


CHUNKS = 64


def table_rows(total):
    """A task's table of fixed size as an Arrow batch of CHUNKS packed rows (chunk, blob); empty chunks are left out."""
    import numpy as np
    import pyarrow as pa

    parts = [(i, x) for i, x in enumerate(np.split(total, CHUNKS)) if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([pack(x) for _, x in parts], pa.binary())], names=["chunk", "blob"])


def table_of(rows: DataFrame, size: int, kind: str, combine: str):
    """The tables of all tasks combined by the named numpy operation, chunk by chunk on the executors; the driver gets one table of fixed size."""
    return _merged(rows, size, kind, combine, None)[0]


def ranks_of(rows: DataFrame, size: int):
    """Sums of the tasks' counts as ranks of one byte, 8 steps a doubling; and the sum of all."""
    import numpy as np

    return _merged(rows, size, "<i8", "add", lambda x: np.minimum(np.round(8 * np.log2(x + 1.0)), 255).astype(np.uint8))


def _merged(rows: DataFrame, size: int, kind: str, combine: str, finish):
    import numpy as np

    def merge(key, own):
        import pandas as pd

        total = np.zeros(size // CHUNKS, kind)
        for b in own["blob"]:
            total = getattr(np, combine)(total, unpack(b, 1)[0].astype(kind))
        return pd.DataFrame({"chunk": [key[0]], "blob": [pack(finish(total) if finish else total)], "total": [int(total.sum()) if finish else 0]})

    out, amount = np.zeros(size, np.uint8 if finish else kind), 0
    for r in rows.groupBy("chunk").applyInPandas(merge, "chunk int, blob binary, total long").collect():
        at = r["chunk"] * (size // CHUNKS)
        out[at : at + size // CHUNKS] = unpack(bytes(r["blob"]), 1)[0]
        amount += r["total"]
    return out, amount


def bits_for(n: int) -> int:
    """Bits of a bitmap of n members: about sixteen for each, from 128 KB to 128 MB."""
    return 1 << min(30, max(20, (16 * n).bit_length()))


def bitmap_of(spots: DataFrame, bits: int):
    """Bits set at the numbers of the column s, as an array of u32 of fixed size."""
    import numpy as np

    def mark(batches):
        total = np.zeros(bits >> 5, np.uint32)
        for rows in batches:
            s = rows.column(0).to_numpy(zero_copy_only=False)
            np.bitwise_or.at(total, s >> 5, np.uint32(1) << (s & 31).astype(np.uint32))
        yield table_rows(total)

    return table_of(spots.select("s").mapInArrow(mark, "chunk int, blob binary"), bits >> 5, "<u4", "bitwise_or")
