"""Morphological tags: ordered substring parsers, decoders and builders, as Columns.

The order of the tests is the semantics: the first key that a tag contains wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tag keys in the order in which they are tried
POS = {
    "noun": "noun", "verb": "verb", "adj": "adjective", "adjective": "adjective", "adverb": "adverb", "adv": "adverb", "pronoun": "pronoun", "pron": "pronoun",
    "indeclinable": "indeclinable", "avyaya": "indeclinable", "ind": "indeclinable", "participle": "participle", "part": "participle", "infinitive": "infinitive", "inf": "infinitive",
    "gerund": "gerund", "ger": "gerund", "prefix": "prefix", "upasarga": "prefix", "particle": "particle",
}
GENDER = {"masculine": "masculine", "mas": "masculine", "m.": "masculine", "feminine": "feminine", "fem": "feminine", "f.": "feminine", "neuter": "neuter", "neu": "neuter", "n.": "neuter"}
NUMBER = {"singular": "singular", "sing": "singular", "sg": "singular", "dual": "dual", "du": "dual", "plural": "plural", "pl": "plural"}
CASE = {
    "nominative": "nominative", "nom": "nominative", "accusative": "accusative", "acc": "accusative", "instrumental": "instrumental", "ins": "instrumental", "dative": "dative", "dat": "dative",
    "ablative": "ablative", "abl": "ablative", "genitive": "genitive", "gen": "genitive", "locative": "locative", "loc": "locative", "vocative": "vocative", "voc": "vocative",
}
PERSON = {"1": "first", "first": "first", "2": "second", "second": "second", "3": "third", "third": "third"}
TENSE = {
    "present": "present", "pres": "present", "laṭ": "present", "imperfect": "imperfect", "imperf": "imperfect", "laṅ": "imperfect", "imperative": "imperative", "imper": "imperative", "loṭ": "imperative",
    "potential": "potential", "pot": "potential", "optative": "potential", "liṅ": "potential", "perfect": "perfect", "perf": "perfect", "liṭ": "perfect", "aorist": "aorist", "aor": "aorist", "luṅ": "aorist",
    "future": "future", "fut": "future", "lṛṭ": "future",
}
VOICE = {"active": "active", "parasmaipada": "active", "para": "active", "middle": "middle", "ātmanepada": "middle", "atma": "middle", "passive": "passive"}
VERB_TAGS = ("verb", "v", "tiṅanta")
ADJECTIVE_TAGS = ("adj", "adjective", "a", "विशेषण")
NOUN_TAGS = ("n", "noun", "substantive", "नाम", "संज्ञा")
GANAS = ("bhvādi", "adādi", "juhotyādi", "divādi", "svādi", "tudādi", "rudhādi", "tanādi", "kryādi", "curādi")
NOMINAL_CASES = ("Prathama", "Dvitiya", "Trtiya", "Caturthi", "Pancami", "Sasthi", "Saptami", "Sambodhana")
LAKARAS = ("Lat", "Lit", "Lut", "Lrt", "Let", "Lot", "Lan", "Lin", "Lun", "Lrn")
GANA_TAGS = ("Bhvadi", "Adadi", "Juhotyadi", "Divadi", "Svadi", "Tudadi", "Rudhadi", "Tanadi", "Kryadi", "Curadi")


def first_key(text: Column, keys: dict[str, str]) -> Column:
    """The value of the first key that the text contains, else null."""
    out = None
    for key, value in keys.items():
        out = F.when(text.contains(key), value) if out is None else out.when(text.contains(key), value)
    return out


def pos_of(pos: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in POS.items() for x in kv])[F.lower(pos)]


def parsed(tag: Column, pos: Column) -> Column:
    """struct of pos, gender, number, case, person, tense, voice; null where the part of speech isn't known."""
    kind, low = pos_of(pos), F.lower(tag)
    nominal, verb = kind.isin("noun", "adjective", "pronoun"), kind == "verb"
    return F.when(
        kind.isNotNull(),
        F.struct(
            kind.alias("pos"), first_key(low, GENDER).alias("gender"), first_key(low, NUMBER).alias("number"), F.when(nominal, first_key(low, CASE)).alias("case"),
            F.when(verb, first_key(low, PERSON)).alias("person"), F.when(verb, first_key(low, TENSE)).alias("tense"), F.when(verb, first_key(low, VOICE)).alias("voice"),
        ),
    )


def tag_string(m: Column) -> Column:
    """pos.gen.nu.cas.1p.tens.voi, nulls left out."""
    return F.concat_ws(".", m["pos"], F.substring(m["gender"], 1, 3), F.substring(m["number"], 1, 2), F.substring(m["case"], 1, 3), F.concat(F.substring(m["person"], 1, 1), F.lit("p")), F.substring(m["tense"], 1, 4), F.substring(m["voice"], 1, 3))


def is_verb(pos: Column, parsed_pos: Column) -> Column:
    return F.coalesce(parsed_pos == "verb", F.lit(False)) | F.coalesce(F.lower(pos).isin(*VERB_TAGS), F.lit(False))


def key_values(tag: Column) -> Column:
    """'K=V, K=V' as a map with lower-case keys; parts without '=' are dropped, the last of equal keys wins."""
    parts = F.filter(F.transform(F.split(tag, ","), F.trim), lambda p: p.contains("="))
    keys = F.transform(parts, lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))))
    last = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: (i < F.size(parts)) & ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), F.get(keys, i)))
    value = lambda i: F.trim(F.substring(F.get(parts, i), F.instr(F.get(parts, i), "=") + 1, F.length(F.get(parts, i))))
    return F.map_from_arrays(F.transform(last, lambda i: F.get(keys, i)), F.transform(last, value))


def kv_pos(tags: Column) -> Column:
    has = lambda k: F.map_contains_key(tags, k)
    return F.when(has("tense") | has("mood") | has("person"), "verb").when(has("case") | has("gender"), "noun").when(has("degree"), "adjective")


def kv_tag(tags: Column) -> Column:
    """pos.tens.moo.p3.nu.cas.gen of a decoded map."""
    part = lambda k, n: F.lower(F.substring(tags[k], 1, n))
    return F.concat_ws(".", kv_pos(tags), part("tense", 4), part("mood", 3), F.concat(F.lit("p"), tags["person"]), part("number", 2), part("case", 3), part("gender", 3))


def _flag(text: Column, prefix: str, values: dict[str, str]) -> Column:
    return first_key(text, {f"{prefix}.{k}": v for k, v in values.items()})


def decoded(data: Column) -> Column:
    """The native engine's textual tag as a struct."""
    noun, verb = data.contains("Subanta"), ~data.contains("Subanta") & data.contains("Tinanta")
    number = _flag(data, "Vacana", {"Eka": "singular", "Dvi": "dual", "Bahu": "plural"})
    gana = _flag(data, "Gana", {g: str(i) for i, g in enumerate(GANA_TAGS, 1)})
    return F.struct(
        F.when(noun, "subanta").when(verb, "tinanta").alias("type"),
        F.when(noun, _flag(data, "Linga", {"Pum": "masculine", "Stri": "feminine", "Napumsaka": "neuter"})).alias("gender"),
        F.when(noun, _flag(data, "Vibhakti", {c: c.lower() for c in NOMINAL_CASES})).alias("case"),
        F.when(noun | verb, number).alias("number"),
        F.when(verb, _flag(data, "Purusha", {"Prathama": "third", "Madhyama": "second", "Uttama": "first"})).alias("person"),
        F.when(verb, _flag(data, "Lakara", {x: x.lower() for x in LAKARAS})).alias("lakara"),
        gana.cast("int").alias("gana"),
    )


def decoded_tag(d: Column) -> Column:
    return F.concat_ws(".", d["type"], F.substring(d["gender"], 1, 3), F.substring(d["case"], 1, 3), F.substring(d["number"], 1, 2), F.substring(d["person"], 1, 3), d["lakara"])


def gana_name(gana: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in enumerate(GANAS, 1) for x in kv])
    return F.coalesce(names[gana], F.concat(F.lit("gaṇa-"), gana.cast("string")))


def compound_type(words: Column) -> Column:
    """Of two words or more: bahuvrihi where the last is an adjective, else tatpurusha; words: array of structs with pos."""
    return F.when(F.size(words) >= 2, F.when(F.element_at(words, -1)["pos"] == "adjective", "bahuvrihi").otherwise("tatpurusha"))
