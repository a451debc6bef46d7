"""Engines that propose segments: a registry of row-local producers.

A producer turns an array of tokens into an array of lemmas (and surfaces). The
reference's segmenters are third-party services; these deterministic ones take
their place, and outside engines join as a table of segments (see ``vote``).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_WEIGHT = 33


@dataclass(frozen=True)
class Producer:
    """weight and confidence are whole hundredths, so that votes add up exactly."""

    name: str
    weight: int
    confidence: int
    lemmas: Callable[[Column], Column]


def tokens(text: Column) -> Column:
    """Words between white space; an empty array for blank text."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def surface(words: Column) -> Column:
    return F.transform(words, F.lower)


def stem(words: Column) -> Column:
    """Lower-cased words without an ending: one at most, and no two end alike."""
    less = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    cut = lambda w: F.when(w.endswith("s"), less(w, 1)).when(w.endswith("ing"), less(w, 3)).when(w.endswith("ed"), less(w, 2)).when(w.endswith("tion"), less(w, 4)).otherwise(w)
    return F.transform(F.transform(words, F.lower), cut)


def lexicon(words: Column) -> Column:
    """Only words of three letters or more: it is shorter, so positions drift as in the reference."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= 3), F.lower)


DEFAULT = (Producer("surface", 35, 90, surface), Producer("stem", 40, 92, stem), Producer("lexicon", 25, 70, lexicon))


class Registry:
    """An ordered set of producers."""

    def __init__(self, producers=DEFAULT) -> None:
        self._by_name = {p.name: p for p in producers}

    def add(self, producer: Producer) -> None:
        """A known name keeps its weight."""
        old = self._by_name.get(producer.name)
        self._by_name[producer.name] = Producer(producer.name, old.weight, producer.confidence, producer.lemmas) if old else producer

    def remove(self, name: str) -> bool:
        return self._by_name.pop(name, None) is not None

    def names(self) -> list[str]:
        return list(self._by_name)

    def chosen(self, names: list[str] | None = None) -> tuple[Producer, ...]:
        own = tuple(p for p in self._by_name.values() if names is None or p.name in names)
        if not own:
            raise ValueError("No engines configured")
        return own


# ---- outside engines: Python functions from texts to segments, which may fail

#: what an engine gives for a text: a list of dicts with these keys, missing ones null
SEGMENT = "struct<pos:int,surface:string,lemma:string,morphology:string,pos_tag:string,confidence:double,meanings:array<string>>"
ENGINE_ROW = f"engine string, engine_rank int, success boolean, error string, segments array<{SEGMENT}>"


@dataclass(frozen=True)
class Outside:
    """analyze: a list of texts to a list of lists of segments; it is called on batches. ready: called once a task; an engine that isn't ready gives an error row per text."""

    name: str
    analyze: Callable[[list[str]], list[list[dict]]]
    ready: Callable[[], bool] = lambda: True


def answered(analyze: Callable, texts: list[str]) -> list[tuple[list[dict], str | None]]:
    """(segments, error) of each text. A batch that fails is halved, so that a text that an engine can't take costs its own result and no other; an engine's answer of another length is a failure."""
    if not texts:
        return []
    try:
        found = analyze(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return [(list(f or []), None) for f in found]
    except Exception as e:  # an outside function may raise anything
        if len(texts) == 1:
            return [([], f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return answered(analyze, texts[:half]) + answered(analyze, texts[half:])


def run_outside(docs, engines: tuple[Outside, ...], key: str = "doc_id", text: str = "text", batch: int = 256, together: bool = False):
    """(key, engine, engine_rank, success, error, segments): a row for each text and engine, whatever fails.

    Texts stay where they are; a null text counts as empty and has no segments. together: (key, answers), a row for each text with an array of the same
    fields, in order of the engines, so that the vote (``vote.merge_answers``) needn't bring them together again."""
    from pyspark.sql.types import StructType

    from corpusloom.session import importable

    if not engines:
        raise ValueError("No engines configured")
    importable(docs.sparkSession)
    own = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("pr_text"))
    schema = StructType([own.schema[0], *StructType.fromDDL(f"answers array<struct<{ENGINE_ROW}>>" if together else ENGINE_ROW).fields])

    def rows(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        told = list(kinds.field("answers").type.value_type) if together else list(kinds)[1:]
        inner = list(told[-1].type.value_type)

        def columns_of(lists: list[list[dict]]):
            """Lists of segments field by field, without a dict for each in between."""
            flat = [s for segments in lists for s in segments]
            places = [n for segments in lists for n in range(len(segments))]
            values = [pa.array(places if f.name == "pos" else [s.get(f.name) for s in flat], f.type) for f in inner]
            return pa.ListArray.from_arrays(pa.array(itertools.accumulate((len(x) for x in lists), initial=0), pa.int32()), pa.StructArray.from_arrays(values, fields=inner))

        ready: dict[str, bool] = {}
        for frame in batches:
            for at in range(0, frame.num_rows, batch):
                part = frame.slice(at, batch)
                keys, texts, gathered = part.column(0), part.column(1).to_pylist(), []
                for rank, engine in enumerate(engines):
                    if engine.name not in ready:
                        ready[engine.name] = bool(engine.ready())
                    some = [i for i, t in enumerate(texts) if t.strip()]
                    found = answered(engine.analyze, [texts[i] for i in some]) if ready[engine.name] else [([], "engine not available")] * len(some)
                    out: list[tuple[list[dict], str | None]] = [([], None)] * len(texts)
                    for i, f in zip(some, found, strict=True):
                        out[i] = f
                    listed = columns_of([segments for segments, _ in out])
                    columns = [pa.array([engine.name] * len(out)), pa.array([rank] * len(out), pa.int32()), pa.array([e is None for _, e in out]), pa.array([e for _, e in out], pa.string()), listed]
                    columns = [c.cast(f.type) for c, f in zip(columns, told, strict=True)]
                    if together:
                        gathered.append(pa.StructArray.from_arrays(columns, fields=told))
                    else:
                        yield pa.RecordBatch.from_arrays([keys, *columns], names=kinds.names)
                if together:
                    n, m = len(texts), len(engines)
                    dealt = pa.concat_arrays(gathered).take(pa.array([k * n + i for i in range(n) for k in range(m)]))
                    yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(range(0, n * m + 1, m), pa.int32()), dealt).cast(kinds.field("answers").type)], names=kinds.names)

    return own.mapInArrow(rows, schema)


def segments_of(rows, key: str = "doc_id"):
    """The table of segments that vote.merge_segments takes, from the rows of run_outside; engines that failed on a text take no part in its vote."""
    listed = rows.where("success").select(F.col(key).alias("sentence_id"), "engine", "engine_rank", F.explode("segments").alias("s"))
    return listed.select("sentence_id", "engine", "engine_rank", F.col("s.pos").alias("pos"), "s.surface", "s.lemma", "s.morphology", "s.pos_tag", F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"), "s.meanings")


def errors_of(rows, key: str = "doc_id"):
    """(key, errors): engine to error of each text; all engines failing is an error of its own. A text without errors has an empty map."""
    failed = F.map_from_entries(F.sort_array(F.collect_list(F.when(~F.col("success"), F.struct("engine", "error")))))
    none = F.when(F.count_if("success") == 0, "No available engines")
    return rows.groupBy(key).agg(failed.alias("errors"), none.alias("failure"))
