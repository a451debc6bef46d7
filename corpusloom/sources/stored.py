"""A stored table of analyses with a full-text index that is maintained, not rebuilt.

Layout, all of it plain partitioned Parquet below one path:

    gen=G/rows/version=V/bucket=B       key, payload columns, gone
    gen=G/postings/version=V/bucket=B   term, key, there
    gen=G/totals/version=V              what the batch changes in the sums
    gen=G/accesses/batch=V/bucket=B     key, at, id
    gen=G/commits/V                     an empty file: version V is whole

A batch of upserts and deletes is a version. Rows are dealt to buckets by the
hash of their key and postings by that of their term, so a look-up or a search
reads the buckets of what it asks for and no others: they are named before the
scan, as a filter on partitions. A batch reads the old rows of its own keys and
writes the difference: rows, and of their terms those that came and those that
went. Readers take the latest version of each key (or term and key) and leave
out what is gone. A version holds a key once, so only what belongs to keys that
several versions hold is aggregated; all else passes as it was read. ``compacted`` writes the current state as one version of a new
generation.

A version counts only once its commit is there, and writing it again replaces
it. So a batch that is run again after a failure changes nothing, and a stream
writes each of its batches once (``from_stream``).

Keys mustn't be null (such rows are left out). One writer at a time; readers are
free. Batches of several rows for one key take the last by ``order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpusloom.operators.store import terms

BUCKETS = 64
#: versions that a generation should have at most
VERSIONS = 16
#: keys are counted before they are broadcast, and up to so many are
MOST_KEYS = 1_000_000


def bucket_of(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


class Stored:
    """payload: the schema of the columns beside the key; text: the one that is indexed; done: a condition that is counted in ``totals``."""

    def __init__(self, spark: SparkSession, path: str, payload: str, key: str = "cache_key", key_type: str = "string", text: str = "normalized", done: str = "false", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.text, self.done, self.buckets = spark, path.rstrip("/"), key, text, done, buckets
        self.row = StructType.fromDDL(f"{key} {key_type}, {payload}, gone boolean")
        self.posting = StructType.fromDDL(f"term string, {key} {key_type}, there boolean")
        self.access = StructType.fromDDL(f"{key} {key_type}, at timestamp, id long")
        self.payload = [f.name for f in self.row.fields if f.name not in (key, "gone")]
        if not self._generations():
            self._make("gen=0/commits")

    # ---- the file system, by the path's own kind

    def _fs(self, name: str = ""):
        held = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return held.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), held

    def _names(self, name: str) -> list[str]:
        fs, held = self._fs(name)
        return [s.getPath().getName() for s in fs.listStatus(held)] if fs.exists(held) else []

    def _make(self, name: str) -> None:
        fs, held = self._fs(name)
        fs.mkdirs(held)

    def _generations(self) -> list[int]:
        """A generation counts once it has its folder of commits, which is made last."""
        return sorted(int(n[4:]) for n in self._names("") if n.startswith("gen=") and self._fs(f"{n}/commits")[0].exists(self._fs(f"{n}/commits")[1]))

    @property
    def generation(self) -> int:
        return self._generations()[-1]

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"gen={self.generation}/commits") if n.isdigit())

    @property
    def last(self) -> int:
        """The latest whole version, -1 for none."""
        return max(self.versions(), default=-1)

    # ---- reading

    def _read(self, what: str, schema: StructType, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Whole versions, up to one before a given one; only these buckets are listed in the scan."""
        part = "batch" if what == "accesses" else "version"
        kinds = StructType([*schema.fields, StructField(part, LongType()), *([] if what == "totals" else [StructField("bucket", IntegerType())])])
        name = f"gen={self.generation}/{what}"
        if not self._names(name):
            return self.spark.createDataFrame([], kinds)
        rows = self.spark.read.schema(kinds).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        if part == "version":
            rows = rows.where(F.col("version").isin([v for v in self.versions() if before is None or v < before]))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def buckets_of(self, rows: DataFrame, column: str) -> list[int]:
        """The buckets that these keys or terms are in: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(bucket_of(F.col(column), self.buckets)).distinct().collect())

    def _several(self, before: int | None = None) -> bool:
        return sum(before is None or v < before for v in self.versions()) > 1

    def _again(self) -> DataFrame:
        """The keys that more than one version holds."""
        from corpusloom.session import written

        held = self._read("rows", self.row).groupBy(self.key).agg(F.count(F.lit(1)).alias("sd_n"))
        keys = written(held.where("sd_n > 1").select(self.key), "keys")
        return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys

    def _settled(self, rows: DataFrame, latest) -> DataFrame:
        """latest(rows), applied to no more than the keys that need it."""
        if not self._several():
            return rows
        again = self._again()
        once = rows.join(again, self.key, "left_anti")
        return once.unionByName(latest(rows.join(again, self.key, "left_semi")))

    def _state(self, rows: DataFrame) -> DataFrame:
        """Each key's latest row with its version; gone ones too."""
        latest = F.max_by(F.struct("gone", *self.payload), F.col("version"))
        return rows.groupBy(self.key).agg(latest.alias("sd"), F.max("version").alias("version")).select(self.key, "sd.*", "version")

    def rows(self) -> DataFrame:
        """key, payload and version of all that is there."""
        held = self._read("rows", self.row).select(self.key, "gone", *self.payload, "version")
        return self._settled(held, self._state).where("NOT gone").drop("gone")

    def get(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of these keys that are there; reads their buckets alone."""
        return self._of(keys, before).where("NOT gone").drop("gone")

    def _of(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        buckets = {r[0]: r[1] for r in asked.groupBy(bucket_of(F.col(self.key), self.buckets)).count().collect()}
        # few keys are broadcast, so that the texts of all others stay where they are
        asked = F.broadcast(asked) if sum(buckets.values()) <= MOST_KEYS else asked
        own = self._read("rows", self.row, before, sorted(buckets)).join(asked, self.key, "left_semi").select(self.key, "gone", *self.payload, "version")
        return self._state(own) if self._several(before) else own

    def index(self) -> DataFrame:
        """(term, key) of all rows that are there, as it has been maintained."""
        held = self._read("postings", self.posting).select("term", self.key, "there", "version")
        return self._settled(held, self._postings).where("there").select("term", self.key)

    def _postings(self, rows: DataFrame) -> DataFrame:
        """Each term and key's latest posting with its version; gone ones too."""
        return rows.groupBy("term", self.key).agg(F.max_by("there", "version").alias("there"), F.max("version").alias("version"))

    def search(self, query: list[str]) -> DataFrame:
        """Keys of the rows that hold all terms; reads the terms' buckets alone."""
        wanted = sorted({t.lower() for t in query})
        asked = self.spark.createDataFrame([(t,) for t in wanted], "term string")
        held = self._read("postings", self.posting, buckets=self.buckets_of(asked, "term")).where(F.col("term").isin(wanted))
        return self._postings(held).where("there").groupBy(self.key).agg(F.count(F.lit(1)).alias("sd_n")).where(F.col("sd_n") == len(wanted)).select(self.key)

    def totals(self) -> DataFrame:
        """One row: total and done, the sums of what each batch changed."""
        own = self._read("totals", StructType.fromDDL("total long, done long"))
        return own.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", "done")])

    # ---- writing

    def _write(self, rows: DataFrame, what: str, version: int, partition: str | None = "bucket", mode: str = "overwrite", generation: int | None = None, dealt: bool = False) -> None:
        part = "batch" if what == "accesses" else "version"
        name = f"{self.path}/gen={self.generation if generation is None else generation}/{what}/{part}={version}"
        # a bucket's rows go to one task each, a large one's to several
        rows = rows if dealt else rows.hint("rebalance", partition) if partition else rows.coalesce(1)
        writer = rows.write.mode(mode)
        (writer.partitionBy(partition) if partition else writer).parquet(name)

    def _commit(self, version: int, generation: int | None = None) -> None:
        fs, held = self._fs(f"gen={self.generation if generation is None else generation}/commits/{version}")
        fs.create(held, True).close()

    def apply(self, changes: DataFrame, version: int | None = None, order: str | None = None) -> bool:
        """Upserts of the rows, deletes where a column gone is true; False if the version is there already."""
        version = self.last + 1 if version is None else version
        if version <= self.last:
            return False
        gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in changes.columns else F.lit(False)
        new = changes.where(F.col(self.key).isNotNull()).select(self.key, *[F.col(c) for c in self.payload if c in changes.columns], *[F.lit(None).cast(self.row[c].dataType).alias(c) for c in self.payload if c not in changes.columns], gone.alias("gone"), (F.col(order) if order else F.lit(0)).alias("sd_order"))
        # dealt once, by parts of buckets: a key's rows meet there and are written from there
        parts = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        new = new.withColumns({"bucket": bucket_of(F.col(self.key), self.buckets), "sd_part": F.pmod(F.hash(self.key), F.lit(parts))}).repartition("bucket", "sd_part")
        new = new.groupBy("bucket", "sd_part", self.key).agg(F.max(F.struct("sd_order", "gone", *self.payload)).alias("sd")).select(self.key, "sd.*", "bucket").select(*self.row.names, "bucket")
        self._write(new, "rows", version, dealt=True)
        # from here on the batch is read back, so what it was made of is evaluated once
        held = self.spark.read.schema(self.row).parquet(f"{self.path}/gen={self.generation}/rows/version={version}")
        live = lambda c: F.when(~F.col("gone"), F.col(c))
        first = not any(v < version for v in self.versions())
        was = (held.where("false").withColumn("version", F.lit(None)) if first else self._of(held, version)).select(self.key, live(self.text).alias("sd_text"), (~F.col("gone")).alias("sd_was"), (F.expr(self.done) & ~F.col("gone")).alias("sd_done"))
        both = held.withColumn("sd_now_done", F.coalesce(F.expr(self.done) & ~F.col("gone"), F.lit(False))).join(was, self.key, "left")
        of = lambda c: F.coalesce(F.array_distinct(terms(c)), F.array().cast("array<string>"))
        marked = lambda a, b, there: F.transform(F.array_except(a, b), lambda t: F.struct(t.alias("term"), F.lit(there).alias("there")))
        if first:
            # nothing to compare with
            changed = held.select(F.explode(of(live(self.text))).alias("term"), self.key, F.lit(True).alias("there"))
        else:
            words = both.select(self.key, of(live(self.text)).alias("now"), of(F.col("sd_text")).alias("old"))
            changed = words.select(self.key, F.explode(F.concat(marked("now", "old", True), marked("old", "now", False))).alias("p")).select("p.term", self.key, "p.there")
        self._write(changed.withColumn("bucket", bucket_of(F.col("term"), self.buckets)), "postings", version)
        number = lambda c: F.coalesce(c, F.lit(False)).cast("long")
        sums = both.agg(F.coalesce(F.sum(number(~F.col("gone")) - number(F.col("sd_was"))), F.lit(0)).alias("total"), F.coalesce(F.sum(number(F.col("sd_now_done")) - number(F.col("sd_done"))), F.lit(0)).alias("done"))
        self._write(sums, "totals", version, None)
        self._commit(version)
        return True

    def delete(self, keys: DataFrame, version: int | None = None) -> bool:
        return self.apply(keys.select(self.key).withColumn("gone", F.lit(True)), version)

    def compacted(self, least: int = VERSIONS) -> bool:
        """One version of a new generation in place of all, if there are least or more; False if not. The old generation stays for its readers."""
        last, now = self.last, self.generation
        if len(self.versions()) < max(1, least):
            return False
        own = self.rows().drop("version").withColumn("gone", F.lit(False)).select(*self.row.names)
        self._write(own.withColumn("bucket", bucket_of(F.col(self.key), self.buckets)), "rows", last, generation=now + 1)
        index = self.index().withColumn("there", F.lit(True)).select(*self.posting.names)
        self._write(index.withColumn("bucket", bucket_of(F.col("term"), self.buckets)), "postings", last, generation=now + 1)
        self._write(self.totals(), "totals", last, None, generation=now + 1)
        if self._names(f"gen={now}/accesses"):
            log = self._read("accesses", self.access).drop("batch")
            self._write(log, "accesses", 0, generation=now + 1)
        fs, held = self._fs(f"gen={now + 1}/making")
        fs.mkdirs(held)
        fs.create(self._fs(f"gen={now + 1}/making/{last}")[1], True).close()
        # the folder of commits appears whole: from now on readers take the new generation
        return fs.rename(held, self._fs(f"gen={now + 1}/commits")[1])

    def from_stream(self, stream: DataFrame, checkpoint: str, order: str | None = None):
        """Every batch of a stream as a version of its own; runs until all that is there has been taken."""
        first = self.last + 1
        marker = f"{checkpoint.rstrip('/')}/first-version"
        held = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marker)
        fs = held.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(held):
            # a stream that goes on numbers its batches as it began
            first = int(self.spark.read.text(marker).first()[0])
        else:
            self.spark.createDataFrame([(str(first),)], "value string").coalesce(1).write.text(marker)
        query = stream.writeStream.foreachBatch(lambda batch, number: self.apply(batch, first + number, order) and None).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()

    # ---- accesses

    def log(self, accesses: DataFrame, batch: int) -> None:
        """Accesses (key, at, id) as a batch of the log; the same number again replaces it."""
        own = accesses.where(F.col(self.key).isNotNull()).select(self.key, F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"))
        self._write(own.withColumn("bucket", bucket_of(F.col(self.key), self.buckets)), "accesses", batch)

    def access_counts(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, access_count, accessed_at) from the log, of these keys or all."""
        log = self._read("accesses", self.access, buckets=None if keys is None else self.buckets_of(keys, self.key))
        log = log if keys is None else log.join(keys.select(self.key).distinct(), self.key, "left_semi")
        return log.groupBy(self.key).agg(F.count(F.lit(1)).alias("access_count"), F.max("at").alias("accessed_at"))


def counts_before(accesses: DataFrame, key: str, order: list[str], name: str = "count_before") -> DataFrame:
    """accesses with how many of the same key came before each, in this order, which must tell rows apart.

    Ranges of (key, order) are numbered each in a group of its own and lifted by what the key has in the ranges before, so a frequent key is spread over many tasks."""
    from corpusloom.session import written

    parts = max(2, int(accesses.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = accesses.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    own = written(own.withColumn("sd_part", F.spark_partition_id()), "accesses")
    sums = own.groupBy("sd_part", F.col(key).alias("sd_key")).agg(F.count(F.lit(1)).alias("sd_n"))
    lifted = F.coalesce(F.sum("sd_n").over(Window.partitionBy("sd_key").orderBy("sd_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("sd_part", "sd_key", lifted.alias("sd_lift"))
    inner = F.row_number().over(Window.partitionBy("sd_part", key).orderBy(*order)) - 1
    ranked = own.withColumn("sd_rank", inner)
    joined = ranked.join(sums, (ranked["sd_part"] == sums["sd_part"]) & ranked[key].eqNullSafe(sums["sd_key"]))
    return joined.select(*[ranked[c] for c in accesses.columns], (F.col("sd_rank") + F.col("sd_lift")).cast("long").alias(name))
