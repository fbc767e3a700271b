"""What may become a node or a relation, over arrays of tagged tokens (FIL-20..34, NLP-10..13, SCA-26..32, SCA-40, SRC-6).

Tokens are ``array<struct<text,lemma,pos>>`` as ``functions.tagger`` gives them.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fabulagraph.functions import text as T
from fabulagraph.functions.tagger import STOP

# fixed values: lemmas that are no nodes
BANNED = (
    "thing things man certain year time dress dressed something someone somebody anything anyone anybody everything everyone everybody nothing nobody "
    "this that these those"
).split()
BE_VERBS = "be is are was were been being am".split()
HAVE_VERBS = "have has had possess own".split()


def _pos(tokens: Column, *kinds: str) -> Column:
    return F.exists(tokens, lambda t: t["pos"].isin(*kinds))


def fields_text(row: list[tuple[str, str]]) -> Column:
    """SRC-6: all fields of a record as text: strings, items of lists, entries of maps; (name, type) pairs."""
    parts = []
    for name, kind in row:
        c = F.col(name)
        if kind.startswith("array"):
            parts.append(F.array_join(F.transform(c, lambda x: x.cast("string")), " "))
        elif kind.startswith("map"):
            parts.append(F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(": ", e["key"].cast("string"), e["value"].cast("string"))), " "))
        elif kind == "string":
            parts.append(c)
    return F.concat_ws(" ", *parts)


def node_gate(lemma: Column, kind: Column, provenance: Column, is_new: Column, story: Column, persona_only: Column) -> Column:
    """FIL-24: the first reason against a node, null if there is none; ``story`` and ``persona_only`` are arrays of lemmas."""
    stems = F.array(lemma, F.regexp_replace(lemma, "(ed|ing)$", ""), F.concat(F.regexp_replace(lemma, "(ed|ing)$", ""), F.lit("e")))
    grounded = F.arrays_overlap(story, stems)
    return (
        F.when(lemma.isNull() | (lemma == ""), "empty_lemmas").when(F.length(lemma) <= 1, "lemma_too_short").when(~lemma.rlike("^[a-zA-Z]+$"), "invalid_characters")
        .when(F.array_contains(persona_only, lemma), "persona_only_lemma")
        .when(is_new & (kind != "PROPERTY") & ~F.startswith(provenance, F.lit("INFERRED")) & ~grounded, "not_story_grounded")
    )


def admitted(lemma: Column, kind: Column, provenance: Column, tokens: Column, story: Column, first: Column, attached: Column) -> Column:
    """FIL-25..28: whether a node of a provenance may be made in this sentence."""
    said = F.exists(tokens, lambda t: (t["lemma"] == lemma) & ~t["pos"].isin("VERB", "AUX"))
    is_adjective = F.exists(tokens, lambda t: (t["lemma"] == lemma) & (t["pos"] == "ADJ"))
    grounded = F.array_contains(story, lemma) | F.array_contains(story, F.regexp_replace(lemma, "s$", ""))
    long_enough = first | (F.length(lemma) > 1)
    return long_enough & (
        F.when(first & (provenance == "INFERRED_RELATION"), True)
        .when((provenance == "STORY_EXPLICIT") & (kind == "PROPERTY"), is_adjective)
        .when(provenance == "STORY_EXPLICIT", said & grounded)
        .when(provenance.isin("INFERRED_RELATION", "INFERENCE_BASED"), attached).otherwise(False)
    )


def allowed(lemma: Column, story: Column, sentence: Column, known: Column, persona_only: Column, bypass: Column) -> Column:
    """FIL-29: not of the persona alone, and in the story, the sentence or the graph."""
    return ~F.array_contains(persona_only, lemma) & (bypass | F.array_contains(story, lemma) | F.array_contains(sentence, lemma) | F.array_contains(known, lemma))


def attachable(src: Column, dst: Column, said: Column, active: Column, explicit: Column, carryover: Column) -> Column:
    """FIL-30, SET-3, SET-6: an edge touches what is there, or joins two words of the sentence."""
    there = F.array_union(F.array_union(active, explicit), carryover)
    return (F.size(active) == 0) | (F.array_contains(said, src) & F.array_contains(said, dst)) | F.array_contains(there, src) | F.array_contains(there, dst)


def is_banned(lemma: Column) -> Column:
    """GRA-8's list."""
    return F.lower(lemma).isin(BANNED)


def negated(label: Column, tokens: Column) -> Column:
    """FIL-20: a negation label, or a negating particle among the tokens."""
    return T.is_negation(label) | F.exists(tokens, lambda t: t["lemma"].isin("not", "no", "never"))


def vague(embedding: Column, prototypes: list[list[float]], above: float = 0.8) -> Column:
    """FIL-21: as near as ``above`` to a vague relation's embedding; false without an embedding."""
    near = [T.cosine(embedding, F.array(*[F.lit(float(x)) for x in p])) > above for p in prototypes]
    out = near[0]
    for n in near[1:]:
        out = out | n
    return F.coalesce(out, F.lit(False))


def clean_resolved(original: Column, candidate: Column) -> Column:
    """FIL-33, FIL-34, SCA-58: a model's rewriting of a sentence without tags and scaffolding, or the original
    where it is a payload or talks about the task; no longer than twice the original."""
    plain = T.strip(F.regexp_replace(F.regexp_replace(candidate, "<[^>]+>", ""), r"\s+", " "))
    plain = F.regexp_replace(plain, r"(?i)^(the )?(resolved |rewritten |final )?(sentence|answer|text)( is)?\s*:\s*", "")
    meta = plain.rlike(r"(?i)\b(as an ai|pronoun|the sentence is|i cannot|instructions?)\b") | F.startswith(plain, F.lit("{")) | (plain == "")
    most = F.greatest(2 * F.length(original) + 40, F.lit(400))
    cut = F.when(F.length(plain) > most, F.concat(F.rtrim(F.substring(plain, F.lit(1), most - 3)), F.lit("..."))).otherwise(plain)
    return F.when(candidate.isNull() | meta, original).otherwise(cut)


def canonical_text(tokens: Column) -> Column:
    """SCA-27: the last noun's lemma, else the first adjective's, else the first token's; names keep their case."""
    noun = F.element_at(F.concat(F.array(F.lit(None).cast("struct<text:string,lemma:string,pos:string>")), F.filter(tokens, lambda t: t["pos"].isin("NOUN", "PROPN"))), -1)
    adjective = F.get(F.filter(tokens, lambda t: t["pos"] == "ADJ"), F.lit(0))
    return F.coalesce(F.when(noun["pos"] == "PROPN", noun["text"]).otherwise(noun["lemma"]), adjective["lemma"], F.get(tokens, F.lit(0))["lemma"])


def canonical_lemma(tokens: Column, subject: bool) -> Column:
    """SCA-29: the first token of an allowed kind that is no stop word."""
    kinds = ["NOUN", "PROPN", "PRON"] + ([] if subject else ["ADJ"])
    return F.get(F.filter(tokens, lambda t: t["pos"].isin(*kinds) & ~t["lemma"].isin(*sorted(STOP)) & t["text"].rlike("^[A-Za-z]+$")), F.lit(0))["lemma"]


def grounded_in_story(tokens: Column, story: Column) -> Column:
    """SCA-32."""
    return F.arrays_overlap(F.transform(tokens, lambda t: t["lemma"]), story)


def verbal_label(tokens: Column) -> Column:
    """SCA-26: verb lemma and prepositions joined by ``_``; '' for a copula with an adjective."""
    names = F.array_join(F.transform(F.filter(tokens, lambda t: t["pos"].isin("VERB", "ADP")), lambda t: t["lemma"]), "_")
    return F.when(F.exists(tokens, lambda t: t["lemma"] == "be") & _pos(tokens, "ADJ"), "").otherwise(names)


def is_verbal(tokens: Column) -> Column:
    """NLP-11: any token that acts as a verb."""
    return _pos(tokens, "VERB", "AUX") | F.exists(tokens, lambda t: t["text"].rlike("(?i)(ing|ed|es)$"))


def is_copular(label: Column) -> Column:
    """NLP-12."""
    return F.exists(F.split(F.lower(F.translate(label, "_", " ")), r"\s+"), lambda w: w.isin(BE_VERBS))


def relation_verdict(subject: Column, label: Column, object_: Column) -> Column:
    """NLP-10, NLP-15, FIL-22: struct (action, reason) for parts of speech of the ends and a label, by the first rule that holds.

    ``subject`` and ``object_`` are structs (lemma, pos).
    """
    adjective = lambda x: x["pos"] == "ADJ"
    be, have = is_copular(label), F.exists(F.split(F.lower(F.translate(label, "_", " ")), r"\s+"), lambda w: w.isin(HAVE_VERBS))
    rules = [
        (T.is_negation(label), "reject", "negation"), (~T.is_relation_label(label), "reject", "no label"), (adjective(subject) & adjective(object_), "reject", "both adjectives"),
        (have & adjective(object_), "reject", "has with an adjective"), (be & (subject["lemma"] == object_["lemma"]), "reject", "circular"),
        (adjective(subject) & ~adjective(object_), "swap", "adjective as subject"), (adjective(object_) & ~be, "add_copula", "adjective without copula"),
        (be | have, "accept", "copula or possession"),
    ]
    out = None
    for when, action, reason in rules:
        value = F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(F.lit("accept").alias("action"), F.lit("relation").alias("reason")))


def said(tokens: Column, subject: Column, label: Column, object_: Column) -> Column:
    """FIL-31: the sentence has the subject, after it the label's verb, and after that the object, as lemmas."""
    lemmas = F.transform(tokens, lambda t: t["lemma"])
    after = lambda xs, at: F.slice(xs, at + 1, F.size(xs))
    i = F.array_position(lemmas, subject).cast("int")
    rest = after(lemmas, i)
    j = F.array_position(rest, F.split_part(label, F.lit("_"), F.lit(1))).cast("int")
    return F.coalesce((i > 0) & (j > 0) & F.array_contains(after(rest, j), object_), F.lit(False))


def sequence_ratio(a: Column, b: Column) -> Column:
    """SCA-40, SCA-41: the similarity ratio of matching blocks, which no built-in gives; in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return ratio(a, b)


def similar_labels(a: Column, b: Column, least: float = 0.8) -> Column:
    """SCA-40: equal but for case and blanks, or a ratio of ``least``."""
    x, y = T.strip(F.lower(a)), T.strip(F.lower(b))
    return (x == y) | (sequence_ratio(x, y) >= least)
