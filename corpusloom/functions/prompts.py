"""Prompt building, response parsing and reasoning text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: reasoning templates
TEMPLATES = {
    "case_agreement": "Rule 'case_agreement' matched: {nominative} ({nom_case}) agrees with verb {verb}. {alternative} has {wrong_case} which cannot be the subject.",
    "verb_agreement": "Rule 'verb_agreement' matched: {verb} is {person}-person {number}, requiring {expected_subject}. {parse_issue}.",
    "sandhi_preference": "Rule 'sandhi_preference' matched: {preferred_split} follows standard {sandhi_type} sandhi rules. {alternative_split} would require irregular sandhi.",
    "semantic_coherence": "Rule 'semantic_coherence' matched: {selected_meaning} is contextually appropriate given {context}. {alternative_meaning} is semantically unlikely here.",
    "word_order": "Rule 'word_order' matched: Standard Sanskrit word order supports {selected_parse}. {alternative_parse} violates typical {construction_type} construction.",
    "gender_agreement": "Rule 'gender_agreement' matched: {adjective} ({adj_gender}) agrees with {noun} ({noun_gender}). Parse {rejected_index} incorrectly matches genders.",
}


def filled(template: str, **values: Column) -> Column:
    """A template's text with Columns in its places; unknown names and missing values raise KeyError."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(TEMPLATES[template]):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def case_reasoning(nominative: Column, verb: Column, alternative: Column, wrong_case: Column) -> Column:
    return filled("case_agreement", nominative=nominative, nom_case=F.lit("nominative"), verb=verb, alternative=alternative, wrong_case=wrong_case)


def verb_reasoning(verb: Column, person: Column, number: Column, expected_subject: Column, parse_issue: Column) -> Column:
    return filled("verb_agreement", verb=verb, person=person, number=number, expected_subject=expected_subject, parse_issue=parse_issue)


def sandhi_reasoning(preferred_split: Column, sandhi_type: Column, alternative_split: Column) -> Column:
    return filled("sandhi_preference", preferred_split=preferred_split, sandhi_type=sandhi_type, alternative_split=alternative_split)


def meaning_reasoning(selected_meaning: Column, context: Column, alternative_meaning: Column) -> Column:
    return filled("semantic_coherence", selected_meaning=selected_meaning, context=context, alternative_meaning=alternative_meaning)


def choice_reasoning(n: Column, selected: Column) -> Column:
    """Why the selected one of n parses was taken: by meaning, against the other one of the first two."""
    # fixed values: what stands for a meaning where only places are known
    alone = meaning_reasoning(F.lit("the only available interpretation"), F.lit("single parse available"), F.lit("no alternative"))
    other = F.when(selected < 2, 1 - selected).otherwise(0)
    name = lambda i: F.concat(F.lit("Parse "), i.cast("string"))
    return F.when(n < 2, alone).otherwise(meaning_reasoning(name(selected), F.lit("grammatical analysis"), name(other)))


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x)


def candidate_block(index: Column, confidence: Column, segments: Column) -> Column:
    """One numbered candidate; segments: array of structs of surface, lemma, pos, gender, number, case, person, tense."""

    def line(s: Column) -> Column:
        names = ("gender", "number", "case", "person", "tense")
        marks = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(s[n], F.lit("")) != "", F.concat(F.lit(f"{n}="), s[n])) for n in names])), ", ")
        own = F.concat(F.lit("    - "), F.coalesce(s["surface"], F.lit("?")), F.lit(" → "), F.coalesce(s["lemma"], F.lit("?")), F.lit(" ("), F.coalesce(s["pos"], F.lit("?")), F.lit(")"))
        return F.concat(own, F.when(marks != "", F.concat(F.lit(" ["), marks, F.lit("]"))).otherwise(""))

    return F.concat_ws("\n", F.concat(F.lit("Candidate "), index.cast("string"), F.lit(":")), F.concat(F.lit("  Confidence: "), two_places(confidence)), F.lit("  Segments:"), F.array_join(F.transform(segments, line), "\n"), F.lit(""))


def prompt(blocks: Column, previous: Column | None = None, following: Column | None = None, topic: Column | None = None) -> Column:
    """The whole prompt; blocks: array of candidate blocks in order; context lines only where they aren't null."""
    named = [("Previous: ", previous), ("Next: ", following), ("Topic: ", topic)]
    context = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(k), c)) for k, c in named if c is not None]
    return F.concat_ws("\n", F.lit("Parse candidates for Sanskrit text:\n"), F.array_join(blocks, "\n"), *context, F.lit("\nRank these candidates from most to least likely."))


def parsed_response(response: Column, n: Column) -> Column:
    """struct of success, error and ranking of an LLM's answer about n candidates."""
    found = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    data = F.from_json(found, "ranking string")
    is_json = F.try_parse_json(found).isNotNull()
    raw = F.coalesce(data["ranking"], F.lit("[]"))
    numbers = F.from_json(raw, "array<string>")
    whole = F.transform(F.filter(numbers, lambda x: x.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), lambda x: x.cast("double").cast("int"))
    valid = F.filter(whole, lambda i: (i >= 0) & (i < n))
    error = (
        F.when(found == "", "No JSON found in response")
        .when(~is_json, "JSON parse error")
        .when(~F.trim(raw).startswith("["), "Ranking is not a list")
        .when(F.size(valid) == 0, "No valid indices in ranking")
    )
    return F.struct(error.isNull().alias("success"), error.alias("error"), F.when(error.isNull(), valid).alias("ranking"))
