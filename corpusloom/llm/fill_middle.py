"""Fill-in-middle transformation: a document cut in prefix, middle and suffix, in an order that teaches infilling.

Each text is decoded to an array of UTF-32 code points. A class per code point
tells which neighbours are one unit: flatnonzero over neighbouring classes gives
the places between units. Two ranks of these, drawn from the id's hash, are the
cuts; the pieces are slices of the array, encoded again.

Forms: psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle,
plain is the text itself: for empty texts, for those that hold a mark, and for
100 - SHARE of a hundred others. A mark begins with its only "<", so none can
arise where two pieces meet, and ``restored`` gets each text back exactly.

Defined results: a null text is an empty one (form plain, no cuts); a null id is
hashed as the word null; rows are independent of each other, so repeated ones
have the same result and an empty table gives an empty one; texts of any length
are cut whole, and bytes that are no UTF-8 count as one code point each and come
back as they are. All columns of the input stay; new ones get names that it
doesn't have, which are returned beside the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.llm.common import fresh, importable
from corpusloom.llm.hashing import give_back

#: texts of a hundred that are transformed, and those of a hundred of these in the order suffix, prefix, middle
SHARE, SPM = 90, 20
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: bytes of output in one Arrow batch, about; rows that are Python objects at a time
OUTPUT, AT_ONCE = 4 << 20, 200
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")
#: code points that end a word
BLANK = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def code_points(text: bytes) -> np.ndarray:
    """UTF-8 as an array of code points; a byte that is no UTF-8 is one of its own."""
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")


def encoded(points: np.ndarray) -> bytes:
    """The inverse of code_points."""
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """Neighbours of one class are one unit: every code point is a class of its own (char), blank or not (word), the number of line ends before it (line)."""
    if unit == "char":
        return np.arange(len(points))
    if unit == "word":
        return np.isin(points, BLANK)
    if unit == "line":
        ends = np.cumsum(points == 10)
        return ends - (points == 10)
    raise ValueError("unit must be char, word or line")


def bounds(points: np.ndarray, unit: str) -> np.ndarray:
    """Where each unit begins, and the end of the text: one more than there are units."""
    own = classes(points, unit)
    inner = np.flatnonzero(own[1:] != own[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def drawn(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits from the hash of seed:key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut(key: str, text: bytes, unit: str = "char", seed: int = 1) -> tuple[int, str, int | None, int | None, bytes]:
    """(n units, form, code points of prefix and of middle, output) of one text."""
    points = code_points(text)
    at = bounds(points, unit)
    n = len(at) - 1
    h1, h2, h3, h4 = drawn(key, seed)
    if not text or any(m in text for m in MARKS.values()) or h3 % 100 >= SHARE:
        return n, "plain", None, None, text
    a, b = (int(at[h]) for h in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (encoded(x) for x in (points[:a], points[a:b], points[b:]))
    form = "spm" if h4 % 100 < SPM else "psm"
    ordered = [("suffix", suffix), ("prefix", prefix)] if form == "spm" else [("prefix", prefix), ("suffix", suffix)]
    return n, form, a, b - a, b"".join(MARKS[name] + piece for name, piece in [*ordered, ("middle", middle)])


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "char", seed: int = 1) -> tuple[DataFrame, dict[str, str]]:
    """docs with COLUMNS, and what these are called there. Rows stay where they are: nothing is shuffled."""
    classes(np.zeros(0, np.uint32), unit)  # an unknown unit fails here
    importable(docs.sparkSession)
    names = {c: fresh(docs, f"fm_{c}") for c in COLUMNS}
    key, own = fresh(docs, "fm_key"), fresh(docs, "fm_text")
    kept = docs.columns

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                out, size, first = [], 0, at
                while at < batch.num_rows and size < OUTPUT:
                    part = batch.slice(at, min(AT_ONCE, batch.num_rows - at))
                    keys, texts = part.column(0), part.column(1).cast(pa.binary())
                    for i in range(part.num_rows):
                        value = keys[i].as_py()
                        out.append(cut("null" if value is None else str(value), texts[i].as_py() or b"", unit, seed))
                        size += len(out[-1][4])
                        at += 1
                        if size >= OUTPUT:
                            break
                n, form, a, b, output = zip(*out, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(output, pa.binary()).cast(pa.string(), safe=False)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, at - first).columns[2:], *made], names=[*kept, *names.values()])
        give_back()

    schema = StructType([*docs.schema.fields, *[StructField(names[c], StringType() if c in ("form", "output") else LongType()) for c in COLUMNS]])
    asked = docs.select(F.col(doc_id).cast("string").alias(key), F.col(text).alias(own), *[F.col(f"`{c}`") for c in kept])
    return asked.mapInArrow(rows, schema), names


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of."""
    part = lambda c, mark, i: F.split_part(c, F.lit(MARKS[mark].decode()), F.lit(i))
    head, middle = part(output, "middle", 1), part(output, "middle", 2)
    psm = F.concat(part(part(head, "suffix", 1), "prefix", 2), middle, part(head, "suffix", 2))
    spm = F.concat(part(head, "prefix", 2), middle, part(part(head, "prefix", 1), "suffix", 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
