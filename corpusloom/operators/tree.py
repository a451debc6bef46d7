"""Parse trees: sentence, groups, words, roots as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.morphology import compound_type, parsed
from corpusloom.functions.text import confidence_bucket, parse_id

#: a parse as stored in JSON
PARSE = "struct<parse_id:string,confidence:double,groups:array<struct<surface:string,words:array<struct<lemma:string,surface:string,pos:string>>>>>"


def built(segments: Column, text: Column) -> Column:
    """One parse of merged segments; every segment is a group of one word."""
    word = lambda s: F.struct(s["lemma"].alias("lemma"), s["surface"].alias("surface"), F.lit(None).cast("string").alias("pos"))
    groups = F.transform(segments, lambda s: F.struct(s["surface"].alias("surface"), F.array(word(s)).alias("words")))
    n = F.size(segments)
    confidence = F.when(n > 0, F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + s["conf7"]) / n / F.lit(1e7)).otherwise(F.lit(0.0))
    return F.struct(parse_id(text, F.lit(0)).alias("parse_id"), confidence.alias("confidence"), groups.alias("groups"))


def line_groups(text: Column) -> Column:
    """Lines as groups, their words as members; the shape that compound inference needs."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: F.struct(x.alias("surface"), F.filter(F.split(x, "\\s+"), lambda w: w != "").alias("words")))


def all_words(groups: Column) -> Column:
    return F.flatten(F.transform(groups, lambda g: g["words"]))


def word_count(groups: Column) -> Column:
    return F.aggregate(groups, F.lit(0), lambda a, g: a + F.size(g["words"]))


def best_parse(parses: DataFrame, sentence: str, index: str, confidence: str, selected: str | None = None) -> DataFrame:
    """The selected parse where it exists, else the most confident, the first on ties; a row per sentence, aggregated before the shuffle."""
    chosen = F.lit(0) if selected is None else F.when(F.col(index) == F.col(selected), 1).otherwise(0)
    others = [c for c in parses.columns if c not in (sentence, index, confidence)]
    best = F.max_by(F.struct(index, confidence, *others), F.struct(chosen, F.col(confidence), -F.col(index)))
    return parses.groupBy(sentence).agg(best.alias("b")).select(sentence, "b.*")


def selected_by_hand(n: Column, index: Column) -> Column:
    """The stage after a human choice; null where the index is out of range."""
    return F.when((index >= 0) & (index < n), F.lit("human"))


#: a parse with everything a word has
SCRIPTS = "struct<devanagari:string,iast:string,slp1:string>"
WORD = f"struct<lemma:string,surface_form:string,scripts:{SCRIPTS},morphology:struct<pos:string,gender:string,number:string,case:string>,meanings:array<string>,dhatu:struct<dhatu_iast:string,gana:int,pada:string,meaning_english:string>,upasarga:array<string>,confidence:double>"
FULL = f"struct<parse_id:string,confidence:double,engine_votes:map<string,double>,word_count:int,sandhi_groups:array<struct<surface_form:string,sandhi_type:string,is_compound:boolean,compound_type:string,base_words:array<{WORD}>>>>"


def rooted(lemma: Column, verb: Column, roots: list[tuple]) -> Column:
    """The root of a verb's lemma as in WORD, from a short list of (root in SLP1, class, voice, meanings); null where it isn't there."""
    entry = lambda r: F.struct(F.lit(r[0]).alias("dhatu_iast"), F.lit(r[1]).alias("gana"), F.lit(r[2]).alias("pada"), F.lit(r[3][0]).alias("meaning_english"))
    table = F.create_map(*[x for r in roots for x in (F.lit(r[0]), entry(r))])
    return F.when(F.coalesce(verb, F.lit(False)), table[lemma])


def full_parse(parse: Column, confidence: Column, votes: Column, words: Column, scripts: Column | None = None, roots: list[tuple] | None = None) -> Column:
    """A parse as in FULL of words (surface, lemma, pos, gender, number, case, sandhi_type, confidence), each a group of its own; scripts: array of SCRIPTS, a word each."""
    from corpusloom.operators.lexicon import COMMON_ROOTS

    missing = F.lit(None).cast("string")
    table = COMMON_ROOTS if roots is None else roots

    def group(w: Column, i: Column) -> Column:
        spelled = F.struct(missing.alias("devanagari"), missing.alias("iast"), w["surface"].alias("slp1")) if scripts is None else F.get(scripts, i)
        marks = F.struct(*[w[c].alias(c) for c in ("pos", "gender", "number", "case")])
        root = rooted(w["lemma"], w["pos"] == "verb", table)
        meanings = F.when(root.isNotNull(), F.array(root["meaning_english"])).otherwise(F.array().cast("array<string>"))
        word = F.struct(
            w["lemma"].alias("lemma"), w["surface"].alias("surface_form"), spelled.alias("scripts"), F.when(w["pos"].isNotNull(), marks).alias("morphology"), meanings.alias("meanings"),
            root.alias("dhatu"), F.array().cast("array<string>").alias("upasarga"), w["confidence"].alias("confidence"),
        )
        return F.struct(w["surface"].alias("surface_form"), w["sandhi_type"].alias("sandhi_type"), F.lit(False).alias("is_compound"), missing.alias("compound_type"), F.array(word).alias("base_words"))

    return F.struct(parse.alias("parse_id"), confidence.alias("confidence"), votes.alias("engine_votes"), F.size(words).alias("word_count"), F.transform(words, group).alias("sandhi_groups")).cast(FULL)


def spellings(words: Column) -> Column:
    """array of SCRIPTS of words in SLP1: the words are joined, spelled at once and cut again."""
    from corpusloom.functions.translit import slp1_to_devanagari, slp1_to_latin

    whole = F.array_join(F.transform(words, lambda w: F.replace(w, F.lit("\n"), F.lit(" "))), "\n")
    of = lambda text: F.split(text, "\n")
    return F.when(F.size(words) == 0, F.array().cast(f"array<{SCRIPTS}>")).otherwise(F.arrays_zip(of(slp1_to_devanagari(whole)).alias("devanagari"), of(slp1_to_latin(whole, "iast")).alias("iast"), words.alias("slp1")).cast(f"array<{SCRIPTS}>"))


def best_of(parses: Column, selected: Column) -> Column:
    """The selected one of an array of parses where it is there, else the most confident, the first on ties; null where there is none."""
    top = F.array_position(F.transform(parses, lambda p: p["confidence"]), F.array_max(F.transform(parses, lambda p: p["confidence"]))).cast("int") - 1
    return F.when(F.size(parses) == 0, None).otherwise(F.get(parses, F.when((selected >= 0) & (selected < F.size(parses)), selected).otherwise(F.greatest(top, F.lit(0)))))


def all_roots(groups: Column) -> Column:
    """The roots of all words that have one, of groups as in FULL."""
    words = F.flatten(F.transform(groups, lambda g: g["base_words"]))
    return F.filter(F.transform(words, lambda w: w["dhatu"]), lambda d: d.isNotNull())


def full_json(parse: Column) -> Column:
    """A parse as in FULL as JSON; what is missing is written as null."""
    return F.to_json(parse, {"ignoreNullFields": "false"})


def from_full_json(text: Column) -> Column:
    return F.from_json(text, FULL)


def word_card(w: Column, verbosity: str) -> Column:
    """The fields of a word as in WORD at a verbosity: struct."""
    if verbosity == "minimal":
        return F.struct(w["lemma"].alias("lemma"), w["morphology"]["pos"].alias("pos"))
    if verbosity == "detailed":
        return w
    root = F.when(w["dhatu"].isNotNull(), F.struct(w["dhatu"]["dhatu_iast"].alias("root"), w["dhatu"]["meaning_english"].alias("meaning")))
    return F.struct(w["lemma"].alias("lemma"), w["surface_form"].alias("surface_form"), w["morphology"].alias("morphology"), F.slice(w["meanings"], 1, 3).alias("meanings"), w["confidence"].alias("confidence"), root.alias("dhatu"))


def parse_card(p: Column, verbosity: str) -> Column:
    """A parse at a verbosity, its words too, as JSON without nulls."""
    own = [p["parse_id"].alias("parse_id"), p["confidence"].alias("confidence")]
    if verbosity == "detailed":
        return F.to_json(p)
    if verbosity == "standard":
        own.append(F.transform(p["sandhi_groups"], lambda g: F.struct(g["surface_form"].alias("surface_form"), F.transform(g["base_words"], lambda w: word_card(w, verbosity)).alias("words"))).alias("sandhi_groups"))
    return F.to_json(F.struct(*own))


#: fields of a root at each verbosity; detailed has all columns
ROOT_FIELDS = {"minimal": ("dhatu_iast", "gana", "meaning_english"), "standard": ("id", "dhatu_devanagari", "dhatu_iast", "meaning_english", "gana", "pada")}


def root_card(roots: DataFrame, verbosity: str) -> Column:
    """A row of roots at a verbosity as JSON; unknown names count as standard."""
    name = verbosity.lower()
    names = roots.columns if name == "detailed" else ROOT_FIELDS.get(name, ROOT_FIELDS["standard"])
    return F.to_json(F.struct(*names))


def screen(p: Column, index: Column, text: Column, overall: Column, mode: Column) -> Column:
    """What a screen shows of a text's parse as in FULL, as JSON: ids for groups and words, roots as root, meaning and class."""
    at = lambda kind, *ns: F.concat(F.lit(kind), F.concat_ws("_", *[n.cast("string") for n in ns]))

    def word(i: Column):
        def shown(w: Column, j: Column) -> Column:
            root = F.when(w["dhatu"].isNotNull(), F.struct(w["dhatu"]["dhatu_iast"].alias("root"), w["dhatu"]["meaning_english"].alias("meaning"), w["dhatu"]["gana"].alias("gana")))
            return F.struct(at("w", index, i, j).alias("word_id"), *[w[c].alias(c) for c in ("lemma", "surface_form", "scripts", "morphology", "meanings")], root.alias("dhatu"), w["confidence"].alias("confidence"))

        return shown

    groups = F.transform(p["sandhi_groups"], lambda g, i: F.struct(at("g", index, i).alias("group_id"), g["surface_form"].alias("surface_form"), F.transform(g["base_words"], word(i)).alias("base_words")))
    parses = F.array(F.struct(p["parse_id"].alias("parse_id"), p["confidence"].alias("confidence"), groups.alias("sandhi_groups")))
    return F.to_json(F.struct(F.struct(text.alias("original")).alias("sentence"), parses.alias("parses"), overall.alias("confidence"), mode.alias("mode")), {"ignoreNullFields": "false"})


#: what a walk of parses finds, with its place: kind is parse, group, compound, word or suffix
FINDING = "struct<kind:string,parse:int,group:int,word:int,form:string,lemma:string,value:string,confidence:double>"


def _best(kind: str):
    return lambda f: (f["kind"] == kind) & (f["parse"] == 0)


#: the analysis tools as conditions on a finding; the best parse is the first one
TOOLS = {
    "explain_parse": lambda f: f["kind"].isin("parse", "word"), "split_sandhi": _best("group"), "get_morphology": _best("word"),
    "identify_compound": _best("compound"), "get_pratyaya": _best("suffix"), "resolve_ambiguity": lambda f: (f["kind"] == "parse") | _best("word")(f),
}


def findings(parses: Column, suffixes=lambda w: w["upasarga"]) -> Column:
    """All findings of an array of parses as in FULL, from the whole to its parts; suffixes: an array of strings of a word.

    A parse's form is its id; a group's value is its type of sandhi and its lemma all its words' lemmas; a compound's value is its type; a word's value is its morphology as JSON."""
    none = F.lit(None)

    def found(kind: str, i: Column, g=none, w=none, form=none, lemma=none, value=none, confidence=none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[c.cast(t).alias(n) for n, c, t in (("parse", i, "int"), ("group", g, "int"), ("word", w, "int"), ("form", form, "string"), ("lemma", lemma, "string"), ("value", value, "string"), ("confidence", confidence, "double"))])

    def of_word(i: Column, g: Column):
        def inner(w: Column, j: Column) -> Column:
            own = found("word", i, g, j, w["surface_form"], w["lemma"], F.to_json(w["morphology"]), w["confidence"])
            ends = F.transform(F.coalesce(suffixes(w), F.array().cast("array<string>")), lambda x: found("suffix", i, g, j, w["surface_form"], w["lemma"], x))
            return F.concat(F.array(own), ends)

        return inner

    def of_group(i: Column):
        def inner(g: Column, k: Column) -> Column:
            lemmas = F.array_join(F.transform(g["base_words"], lambda w: w["lemma"]), " + ")
            own = F.array(found("group", i, k, form=g["surface_form"], lemma=lemmas, value=g["sandhi_type"]))
            compound = F.when(g["is_compound"], F.array(found("compound", i, k, form=g["surface_form"], lemma=lemmas, value=F.coalesce(g["compound_type"], F.lit("unknown"))))).otherwise(F.array().cast(f"array<{FINDING}>"))
            return F.concat(own, compound, F.flatten(F.transform(g["base_words"], of_word(i, k))))

        return inner

    one = lambda p, i: F.concat(F.array(found("parse", i, form=p["parse_id"], confidence=p["confidence"])), F.flatten(F.transform(p["sandhi_groups"], of_group(i))))
    return F.flatten(F.transform(parses, one))


def walked(rows: DataFrame, key: str, parses: str = "parses", suffixes=lambda w: w["upasarga"]) -> DataFrame:
    """(key, at, FINDING): a row per finding, in order of at."""
    return rows.select(key, F.posexplode(findings(F.col(parses), suffixes)).alias("at", "f")).select(key, "at", "f.*")


def tool(found: DataFrame, name: str) -> DataFrame:
    """The findings that a tool shows."""
    if name not in TOOLS:
        raise ValueError(f"Unknown tool: {name}")
    return found.where(TOOLS[name](F.struct("kind", "parse")))


def told(found: Column) -> Column:
    """struct of how many of a row's findings each tool shows: a count in the row, so nothing is exploded, shuffled or sorted."""
    return F.struct(*[F.size(F.filter(found, of)).cast("long").alias(name) for name, of in TOOLS.items()])


def counted(parses: Column, suffixes=lambda w: w["upasarga"]) -> Column:
    """``told`` of ``findings`` of an array of parses, counted where the tree stands: no finding is made only to be counted."""
    summed = lambda xs, of: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + of(x))
    groups = lambda ps, of: summed(ps, lambda p: summed(p["sandhi_groups"], of))
    words = lambda ps: groups(ps, lambda g: F.size(g["base_words"]).cast("long"))
    ends = lambda w: F.size(F.coalesce(suffixes(w), F.array().cast("array<string>"))).cast("long")
    n, best = F.size(parses).cast("long"), F.slice(parses, 1, 1)
    counts = {
        "explain_parse": n + words(parses), "split_sandhi": groups(best, lambda g: F.lit(1).cast("long")), "get_morphology": words(best),
        "identify_compound": groups(best, lambda g: F.when(g["is_compound"], 1).otherwise(0).cast("long")), "get_pratyaya": groups(best, lambda g: summed(g["base_words"], ends)), "resolve_ambiguity": n + words(best),
    }
    return F.struct(*[counts[name].alias(name) for name in TOOLS])


def to_json(parse: Column) -> Column:
    return F.to_json(parse)


def from_json(text: Column) -> Column:
    return F.from_json(text, PARSE)


def preview(groups: Column) -> Column:
    """surface → a + b, joined; a dash for no group."""
    one = lambda g: F.concat(g["surface"], F.lit(" → "), F.array_join(F.transform(g["words"], lambda w: w["lemma"]), " + "))
    return F.when(F.size(groups) == 0, F.lit("—")).otherwise(F.array_join(F.transform(groups, one), " • "))


def response_ids(groups: Column, parse: Column) -> Column:
    """groups with ids g{p}_{s} and words w{p}_{s}_{w}."""
    p = parse.cast("string")
    word = lambda s: lambda w, j: F.struct(F.concat(F.lit("w"), p, F.lit("_"), s.cast("string"), F.lit("_"), j.cast("string")).alias("id"), w.alias("word"))
    return F.transform(groups, lambda g, s: F.struct(F.concat(F.lit("g"), p, F.lit("_"), s.cast("string")).alias("id"), g["surface"].alias("surface"), F.transform(g["words"], word(s)).alias("words")))


def verbosity_of(name: Column) -> Column:
    return F.when(F.lower(name).isin("minimal", "standard", "detailed"), F.lower(name)).otherwise("standard")


def projected(lemma: Column, pos: Column, meanings: Column, root: Column, verbosity: Column) -> Column:
    """A word as JSON: minimal has lemma and pos, standard adds three meanings and the root, detailed all meanings."""
    minimal = F.to_json(F.struct(lemma.alias("lemma"), pos.alias("pos")))
    standard = F.to_json(F.struct(lemma.alias("lemma"), pos.alias("pos"), F.slice(meanings, 1, 3).alias("meanings"), root.alias("root")))
    detailed = F.to_json(F.struct(lemma.alias("lemma"), pos.alias("pos"), meanings.alias("meanings"), root.alias("root")))
    return F.when(verbosity == "minimal", minimal).when(verbosity == "detailed", detailed).otherwise(standard)


def flagged(votes: Column) -> Column:
    """Engines whose vote is over one half."""
    return F.transform_values(votes, lambda _, v: v > 0.5)


__all__ = ["all_roots", "all_words", "best_parse", "built", "compound_type", "confidence_bucket", "flagged", "from_json", "line_groups", "parsed", "preview", "projected", "response_ids", "selected_by_hand", "to_json", "verbosity_of", "word_count"]
