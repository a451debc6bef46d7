"""The analysis store: a keyed table with lookups, upserts, search and cache simulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

TTL_SECONDS = 604_800
CAPACITY = 1_000


def point_lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)


def by_mode(rows: DataFrame, column: str, mode: str, newest: str, tie: str, n: int = 100) -> DataFrame:
    """The n newest rows of a mode: one partial top-n per task, no full sort."""
    return rows.where(F.col(column) == mode).orderBy(F.desc(newest), F.desc(tie)).limit(n)


def recent(rows: DataFrame, newest: str, tie: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(newest), F.desc(tie)).limit(n)


def upserted(versions: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The latest version of each key and how many there were; aggregated before the shuffle, so a frequent key costs a row per task."""
    latest = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("latest")
    return versions.groupBy(key).agg(latest, F.count(F.lit(1)).alias("versions")).select(key, *[F.col(f"latest.{c}").alias(c) for c in keep], "versions")


def with_choice(rows: DataFrame, choices: DataFrame, key: str, chosen: str) -> DataFrame:
    """disambiguated and selected columns from a table of human choices."""
    own = choices.select(key, F.col(chosen).alias("st_choice"))
    return rows.join(own, key, "left").withColumn("disambiguated", F.col("st_choice").isNotNull()).withColumn("selected_parse", F.col("st_choice")).drop("st_choice")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Delete: rows whose key is not in gone."""
    return rows.join(gone.select(key), key, "left_anti")


def misses(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows that the store doesn't hold yet: only these flow on to the engines."""
    return rows.join(store.select(key), key, "left_anti")


def many(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_semi")


def corpus_stats(rows: DataFrame, done: Column, accesses: Column) -> DataFrame:
    """total, disambiguated and sum of accesses in one pass."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("disambiguated"), F.coalesce(F.sum(accesses), F.lit(0)).cast("long").alias("accesses"))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def inverted_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key), each once: rebuilt from the current rows."""
    return rows.select(key, F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))


def search_all(rows: DataFrame, text: str, query: list[str]) -> DataFrame:
    """Rows that hold all terms, by a scan; use the index where it is kept."""
    own = terms(F.col(text))
    for t in query:
        rows = rows.where(F.array_contains(own, t.lower()))
    return rows


def search_index(index: DataFrame, query: list[str], key: str) -> DataFrame:
    """Keys that the index holds under all terms."""
    wanted = sorted({t.lower() for t in query})
    return index.where(F.col("term").isin(*wanted)).groupBy(key).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select(key)


def lru(accesses: DataFrame, shard: str, key: str, order: str, capacity: int = CAPACITY, parts: int | None = None) -> DataFrame:
    """accesses with hit: an LRU cache per shard, replayed in order.

    Accesses are cut in parts by ranges of (shard, order), so a frequent shard has
    many. What a cache holds when a part begins is the capacity's last different
    keys before it, and these follow from the last keys of each part: aggregates
    and a row per part and kept key. So all parts are replayed at once, each from
    its state, by streaming a sorted partition. Rows with a null shard are a shard."""
    from corpusloom.session import importable, written

    spark = accesses.sparkSession
    importable(spark)
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = accesses.repartitionByRange(parts, shard, order).sortWithinPartitions(shard, order)
    own = written(own.withColumn("st_part", F.spark_partition_id()), "accesses")
    # the last different keys of the shard that a part ends with, the latest first
    after = F.lead("st_part").over(Window.orderBy("st_part"))  # a row per part
    ends = own.groupBy("st_part").agg(F.max(F.struct(shard)).alias("st_end")).select("st_part", F.col(f"st_end.{shard}").alias("st_shard"), after.alias("st_next")).where("st_next IS NOT NULL")
    last = own.groupBy("st_part", F.col(shard).alias("st_shard"), F.col(key).alias("st_key")).agg(F.max(order).alias("st_at"))
    last = last.join(ends, (last["st_part"] == ends["st_part"]) & last["st_shard"].eqNullSafe(ends["st_shard"])).select(last["st_part"], last["st_shard"], "st_next", "st_key", "st_at")
    nth = F.row_number().over(Window.partitionBy("st_part").orderBy(F.desc("st_at")))
    last = last.withColumn("st_nth", nth).where(F.col("st_nth") <= capacity)
    state = StructType([StructField("st_part", IntegerType()), StructField("st_seq", LongType()), StructField(key, accesses.schema[key].dataType)])

    def states(_, rows):
        """What the parts after these begin with: the keys of a shard's parts so far, the latest last."""
        import pandas as pd

        held, out = {}, []
        for part, new in rows.sort_values(["st_part", "st_nth"], ascending=[True, False]).groupby("st_next", sort=False):
            for k in new["st_key"]:
                held.pop(k, None)
                held[k] = True
            for k in list(held)[: max(0, len(held) - capacity)]:
                del held[k]
            out += [(part, i, k) for i, k in enumerate(held)]
        return pd.DataFrame(out, columns=["st_part", "st_seq", key])

    begins = own.groupBy("st_part").agg(F.min(F.struct(shard)).alias("b")).select(F.col("st_part").alias("st_begin"), F.col(f"b.{shard}").alias("st_first"))
    # a part takes over only what the part before it left of the same shard
    known = last.groupBy("st_shard").applyInPandas(lambda k, rows: states(k, rows).assign(st_shard=k[0]), StructType([*state.fields, StructField("st_shard", accesses.schema[shard].dataType)]))
    known = known.join(begins, (known["st_part"] == begins["st_begin"]) & known["st_shard"].eqNullSafe(begins["st_first"])).select("st_part", "st_seq", key, F.col("st_shard").alias(shard))
    flow = own.withColumn("st_seq", F.lit(None).cast("long")).unionByName(known, allowMissingColumns=True)
    schema = StructType([*accesses.schema.fields, StructField("hit", BooleanType())])

    columns = [*accesses.columns, "hit"]

    def replay(batches):
        from collections import OrderedDict

        cache, now = OrderedDict(), None
        for rows in batches:
            hits = []
            for part, s, k in zip(rows["st_part"], rows[shard], rows[key], strict=True):
                place = (part, None if s != s else s)
                if place != now:
                    cache, now = OrderedDict(), place
                hits.append(k in cache)
                cache[k] = True
                cache.move_to_end(k)
                if len(cache) > capacity:
                    cache.popitem(last=False)
            rows = rows.assign(hit=hits)
            yield rows[rows["st_seq"].isna()][columns]

    in_order = flow.repartition(parts, "st_part").sortWithinPartitions("st_part", F.col(shard), F.col("st_seq").asc_nulls_last(), order)
    return in_order.mapInPandas(replay, schema)


def lru_contents(accesses: DataFrame, shard: str, key: str, order: str, capacity: int = CAPACITY) -> DataFrame:
    """(shard, key, place): what each cache holds after all accesses, the latest first: its last different keys."""
    last = accesses.groupBy(shard, key).agg(F.max(order).alias("st_at"))
    place = F.row_number().over(Window.partitionBy(shard).orderBy(F.desc("st_at")))
    return last.withColumn("place", place).where(F.col("place") <= capacity).select(shard, key, "place")


def scan_prefix(rows: DataFrame, key: str, prefix: str, of_store: str = "sanskrit:") -> DataFrame:
    """Rows whose key begins with the store's prefix and this one; the prefix is pushed to the scan."""
    return rows.where(F.col(key).startswith(of_store + prefix))


def ttl_hits(accesses: DataFrame, key: str, ts: str, tie: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """hit: the key's previous access is at most ttl seconds ago."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return accesses.withColumn("hit", F.coalesce(gap <= F.lit(ttl * 1_000_000), F.lit(False)))


def tier(in_memory: Column, in_second: Column, in_third: Column) -> Column:
    """The first tier that holds the key."""
    return F.when(in_memory, "memory").when(in_second, "redis").when(in_third, "sqlite").otherwise("none")


TIERS = ("memory", "redis", "sqlite")


def tier_counters(resolved: DataFrame, tier: str = "tier") -> DataFrame:
    """A row per tier of requests and the tier that answered each: hits, misses (requests that came past it), promotions (answers from slower tiers), hit_rate.

    One aggregation to three counts, so a request costs no shuffle."""
    counts = resolved.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col(tier) == t).alias(t) for t in TIERS])
    rows, reached = [], F.col("all")
    for i, t in enumerate(TIERS):
        slower = sum((F.col(x) for x in TIERS[i + 1 :]), F.lit(0).cast("long"))
        rows.append(F.struct(F.lit(t).alias("tier"), F.col(t).alias("hits"), (reached - F.col(t)).alias("misses"), slower.alias("promotions"), F.round(hit_rate(F.col(t), reached), 6).alias("hit_rate")))
        reached = reached - F.col(t)
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def promoted(held: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """(key, memory, redis, sqlite): which tiers hold each key after the requests; a found key moves up to all faster tiers."""
    asked = requests.select(key).distinct().withColumn("st_asked", F.lit(True))
    own = held.join(asked, key, "left")
    found = F.coalesce(F.col("st_asked"), F.lit(False))
    in_memory = F.col("memory") | (found & (F.col("redis") | F.col("sqlite")))
    in_second = F.col("redis") | (found & ~F.col("memory") & F.col("sqlite"))
    return own.select(key, in_memory.alias("memory"), in_second.alias("redis"), "sqlite")


def stored_through(held: DataFrame, entries: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, memory, redis, sqlite): a set writes all tiers; other keys stay as they are."""
    new = entries.groupBy(key).agg(F.max(value).alias(value)).withColumns({t: F.lit(True) for t in TIERS})
    return without(held, new, key).select(key, value, *TIERS).unionByName(new)


def exists(keys: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, found): whether any tier holds it."""
    own = held.where(" OR ".join(TIERS)).select(key).distinct().withColumn("st_held", F.lit(True))
    return keys.select(key).join(own, key, "left").select(key, F.col("st_held").isNotNull().alias("found"))


def clear_prefix(rows: DataFrame, key: str, prefix: str, of_store: str = "sanskrit:") -> DataFrame:
    """Rows without those whose key begins with the store's prefix and this one."""
    return rows.where(~F.coalesce(F.col(key).startswith(of_store + prefix), F.lit(False)))


def remaining_ttl(entries: DataFrame, key: str, written: str, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """(key, ttl): whole seconds that each key has left since it was last written; null where its time is over."""
    last = entries.groupBy(key).agg(F.max(written).alias("st_at"))
    left = F.lit(ttl) - (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("st_at").cast("timestamp")))
    return last.select(key, F.when(left > 0, left).cast("long").alias("ttl"))


def hit_rate(hits: Column, requests: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), requests.cast("double")), F.lit(0.0))


def history(entries: DataFrame, text: str, ts: str, tie: str, n: int = 20) -> DataFrame:
    """The n texts of latest use, each once with its latest time."""
    return entries.groupBy(text).agg(F.max(F.struct(ts, tie)).alias("last")).select(text, F.col(f"last.{ts}").alias(ts), F.col(f"last.{tie}").alias(tie)).orderBy(F.desc(ts), F.desc(tie)).limit(n)


def toggled(events: DataFrame, key: str) -> DataFrame:
    """Keys that are expanded after all toggles: an odd number of them."""
    return events.groupBy(key).agg((F.count(F.lit(1)) % 2 == 1).alias("expanded"))
