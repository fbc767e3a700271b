"""Text, age, label and payload functions, Column to Column; all stay inside the JVM.

IDs in the docstrings are those of the operator inventory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fabulagraph.functions import lexicon as L

TOKEN = r"[\p{L}\p{N}_]+"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, phrases: list[str]) -> Column:
    """FIL-1..5: any phrase is a substring of the lower-cased text; null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _any([F.contains(low, F.lit(p)) for p in phrases])


def strip(text: Column) -> Column:
    """Trims all white space, not blanks alone."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def white_words(text: Column) -> Column:
    """Words between white space (AGG-4); none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def persona_id(text: Column) -> Column:
    """SCA-1."""
    return F.sha1(text)


def persona_key(source: Column, idx: Column) -> Column:
    """SCA-18."""
    return F.concat_ws("::", source, idx.cast("string"))


def relation_class(relation: Column) -> Column:
    """SCA-2: taxonomic, causal or event."""
    r = strip(F.lower(relation))
    return F.when(r.isin(L.TAXONOMIC), "taxonomic").when(r.isin(L.CAUSAL), "causal").otherwise("event")


def sentiment(words: Column) -> Column:
    """SCA-3 over an array of tokens."""
    count = lambda names: F.size(F.filter(words, lambda w: w.isin(names)))
    return ratio((count(L.POSITIVE) - count(L.NEGATIVE)).cast("double"), F.size(words))


def type_token_ratio(words: Column) -> Column:
    """SCA-4, first value."""
    return ratio(F.size(F.array_distinct(words)).cast("double"), F.size(words))


def mean_length(words: Column) -> Column:
    """SCA-4, second value."""
    return ratio(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)).cast("double"), F.size(words))


def age_bin(age: Column) -> Column:
    """SCA-5: fine bin, null between and beyond them."""
    return F.coalesce(*[F.when(age.between(lo, hi), F.lit(f"{lo}-{hi}")) for lo, hi in L.AGE_BINS])


def coarse_age_bin(age: Column) -> Column:
    """SCA-6."""
    whole = age.cast("int")
    return F.when(whole.isNull(), None).when(whole <= 10, "3–10").when(whole <= 14, "11–14").otherwise("15–18")


def normal_bin(label: Column) -> Column:
    """SCA-7: hyphen and em dash become an en dash."""
    return F.translate(strip(label.cast("string")), "-—", "––")


def normal_regime(regime: Column) -> Column:
    """SCA-8."""
    return F.regexp_replace(strip(F.lower(regime.cast("string"))), "[ _]", "")


def regime_of_file(name: Column) -> Column:
    """SCA-9."""
    low = F.lower(name)
    has = lambda *xs: _any([F.contains(low, F.lit(x)) for x in xs])
    return (
        F.when(has("primary"), "primary").when(has("secondary", "sec"), "secondary").when(has("high"), "high_school")
        .when(has("university", "freshman"), "university").otherwise("unknown")
    )


def group_of_file(name: Column) -> Column:
    """SCA-10: null where no group is named."""
    low = F.lower(name)
    return (
        F.when(low.rlike("primary"), "primary").when(low.rlike("secondary"), "secondary").when(low.rlike("high[_-]?school"), "highschool")
        .when(low.rlike("university|uni"), "university")
    )


def model_and_regime(name: Column) -> tuple[Column, Column]:
    """SRC-12: null where the name is not of the pattern."""
    pattern = r"^model_(.+?)_triplets_(.+)\.csv$"
    ok = name.rlike(pattern)
    first = F.get(F.split(F.regexp_extract(name, pattern, 2), "_"), F.lit(0))
    regime = F.when(F.lower(first).isin(L.KNOWN_REGIMES), F.lower(first)).otherwise(first)
    return F.when(ok, F.regexp_extract(name, pattern, 1)), F.when(ok, regime)


def model_family(name: Column) -> Column:
    """SCA-12: the first family that the name holds is spelled out."""
    low = strip(F.lower(name))
    out = None
    for old, new in L.MODEL_NAMES:
        hit, to = F.contains(low, F.lit(old)), F.replace(low, F.lit(old), F.lit(new))
        out = F.when(hit, to) if out is None else out.when(hit, to)
    return out.otherwise(low)


def safe_tag(name: Column) -> Column:
    """SCA-13: a tag for file names; the parts of one family's names are capitalised."""
    tag = F.lower(F.translate(name, "/: ", "--_"))
    part = lambda p: (
        F.when(p.startswith("qwen"), F.concat(F.lit("Qwen"), F.substring(p, 5, 1000)))
        .when(p.endswith("b") & p.rlike("[0-9]"), F.upper(p)).when(p.rlike("^[a-z]+$"), F.initcap(p)).otherwise(p)
    )
    return F.when(F.contains(tag, F.lit("qwen")), F.array_join(F.transform(F.split(tag, "-"), part), "-")).otherwise(tag)


def safe_file_part(text: Column, most: int = 80) -> Column:
    """SRC-23."""
    cut = F.substring(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n", " ")), 1, most)
    out = F.regexp_replace(F.regexp_replace(cut, r'[\\/:*?"<>|]', "_"), r"\s+", "_")
    return F.when(out == "", "unknown").otherwise(out)


def stated_age(text: Column) -> Column:
    """The first age that the text states in years; null if none."""
    return F.nullif(F.regexp_extract(text, L.AGE_PATTERN, 1), F.lit("")).cast("int")


def age_by_cascade(text: Column) -> Column:
    """SCA-14: a stated age, else the first condition that holds."""
    low = F.lower(text)
    holds = lambda groups: _any([reduce(lambda a, b: a & b, [F.contains(low, F.lit(p)) for p in g]) for g in groups])
    return F.coalesce(stated_age(text), *[F.when(holds(groups), F.lit(age)) for groups, age in L.AGE_CASCADE])


def age_by_phrase(text: Column) -> Column:
    """SCA-15: a stated age, else the first phrase, else the school level."""
    low = F.lower(text)
    rules = [((p,), age) for p, age in L.PHRASE_AGES] + L.SCHOOL_AGES
    return F.coalesce(stated_age(low), *[F.when(_any([F.contains(low, F.lit(p)) for p in ps]), F.lit(age)) for ps, age in rules])


def final_age(text: Column, age: Column, group: Column) -> Column:
    """SCA-16: a model's age, else its group's, each null from 18 on; else by phrase."""
    known = reduce(lambda a, kv: a.when(strip(F.lower(group)) == kv[0], F.lit(kv[1])), L.AGE_GROUPS.items(), F.when(F.lit(False), F.lit(None).cast("int")))
    minor = lambda x: F.when(x < 18, x)
    return F.when(age.isNotNull(), minor(age.cast("int"))).when(known.isNotNull(), minor(known)).otherwise(age_by_phrase(text))


def age_regime(age: Column) -> Column:
    """JOIN-15: the first regime in order that holds the age."""
    return F.coalesce(*[F.when(age.between(lo, hi), F.lit(name)) for name, lo, hi in L.AGE_REGIMES])


def age_fits(age: Column, regime: Column) -> Column:
    """FIL-13."""
    fits = [(regime == n) & ((age >= lo) if lo is not None else F.lit(True)) & (age <= hi) for n, lo, hi in L.REGIME_AGES]
    return F.coalesce(_any(fits), F.lit(False))


def drp_grade(drp: Column) -> Column:
    """SCA-19: the first band that holds the score, else beyond all."""
    out = None
    for lo, hi, grade in L.DRP_BANDS:
        inside = (drp < hi) if lo is None else drp.between(lo, hi)
        out = F.when(inside, grade) if out is None else out.when(inside, grade)
    return out.otherwise(L.DRP_BEYOND)


def is_high_school_role(text: Column) -> Column:
    """FIL-6: a role between word boundaries."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(r"\b(" + "|".join(L.HIGH_SCHOOL_ROLES) + r")\b")


def reasons(*rules: tuple[Column, str]) -> Column:
    """An array of the names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))


def high_school_reasons(text: Column, age: Column) -> Column:
    """FIL-7, FIL-11: why a persona is no high-school student; empty keeps it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *xs: _any([F.contains(low, F.lit(x)) for x in xs])
    return reasons(
        (age.isNull(), "missing age"),
        ((age < 14) | (age >= 18), "age out of range"),
        (~has("high school") & ~low.rlike(r"\bgrade\s*(9|10|11|12)\b"), "no explicit high school mention"),
        (has("university", "college", "degree"), "mentions university/college"),
        (has("full-time job", "working full time"), "mentions full-time work"),
        (has("when i was in high school", "back in high school", "used to be in high school"), "adult reflection"),
    )


def school_reasons(text: Column, age: Column, category: str) -> Column:
    """FIL-8..10: the same for the other categories: ages, phrases, and signs that should be there."""
    low, high = L.STRICT_AGES[category][0], L.STRICT_AGES[category][2]
    rules = [(age < low, L.STRICT_AGES[category][1]), (age > high, L.STRICT_AGES[category][3])]
    rules += [(contains_any(text, phrases), reason) for reason, phrases in L.STRICT_PHRASES[category]]
    if category == "primary":
        rules.append(((age <= 2) & ~contains_any(text, L.SCHOOL_OF_INFANTS), "infant without school context"))
    if category == "university":
        rules.append((~contains_any(text, L.FRESHMAN_SIGNS + L.ENROLLED_SIGNS), "no clear first-year university signal"))
    return reasons(*rules)


def preferred_text(*columns: Column, rest: Column, most: int = 1500) -> Column:
    """SRC-7: the first that isn't blank, else the start of ``rest``."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns], F.substring(rest, 1, most))


def is_control(text: Column) -> Column:
    """FIL-18: holds a control token; null doesn't."""
    return F.coalesce(_any([F.contains(text, F.lit(t)) for t in L.CONTROL_TOKENS]), F.lit(False))


def is_negation(label: Column) -> Column:
    """FIL-19."""
    low = F.translate(F.lower(F.coalesce(label, F.lit(""))), "_", " ")
    words = F.split(low, r"\s+")
    return _any([F.contains(low, F.lit(p)) for p in L.NEGATION_PHRASES]) | F.arrays_overlap(words, F.array(*map(F.lit, L.NEGATION_WORDS)))


def is_relation_label(label: Column) -> Column:
    """FIL-23."""
    return F.coalesce(label.rlike("[a-zA-Z]"), F.lit(False))


def repaired(subject: Column, relation: Column, object_: Column) -> Column:
    """SCA-20: struct (s, r, o); a bad end takes the other, a bad or blank relation is ``related_to``."""
    s0, r0, o0 = (strip(F.coalesce(x, F.lit("nan"))) for x in (subject, relation, object_))
    unknown = F.lit("UNKNOWN")
    s = F.when(~is_control(s0), s0).when(~is_control(o0), o0).otherwise(unknown)
    o = F.when(~is_control(o0), o0).when(~is_control(s), s).otherwise(unknown)
    return F.struct(s.alias("s"), F.when(is_control(r0) | (r0 == ""), "related_to").otherwise(r0).alias("r"), o.alias("o"))


def snippet(text: Column, words: int = 5) -> Column:
    """SCA-21."""
    return F.array_join(F.slice(white_words(text), 1, words), " ")


def clock(seconds: Column) -> Column:
    """SCA-22: HH:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def edge_label(label: Column) -> Column:
    """SCA-24 with SCA-23: normalised relation label; one that held ``_`` stays apart by blanks."""
    low = F.lower(F.regexp_replace(strip(F.coalesce(label, F.lit(""))), r"\s*\(edge\)\s*", ""))
    plain = F.translate(low, "_", " ")
    meaning = (
        F.when(plain.rlike(r"\blikes?\b"), "enjoys").when(plain.rlike(r"\b(is|are|was|were|be|being|been)\b"), "is")
        .when(plain.rlike(r"\b(has|have|possess|own)\b"), "has").otherwise(plain)
    )
    joined = F.regexp_replace(F.translate(low, " ", "_"), r"[^\p{L}\p{N}_]", "")
    return F.regexp_replace(F.when(meaning != low, meaning).otherwise(joined), "_+", "_")


def clean_label(label: Column) -> Column:
    """SCA-25: no dependency prefixes, trailing punctuation or longer words without a vowel; '' if too short."""
    out = strip(F.coalesce(label, F.lit("")))
    for p in L.LABEL_PREFIXES:
        out = F.regexp_replace(out, f"^(?i:{p})", "")
    out = F.regexp_replace(strip(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]+$", "")), r"\s+", " ")
    out = F.when(out.rlike(r"(.)\1{2,}"), F.regexp_replace(out, r"([bcdfghjklmnpqrstvwxyz])\1+$", "$1")).otherwise(out)
    kept = F.filter(F.split(F.lower(out), " "), lambda w: (F.length(w) <= 2) | w.rlike("[aeiou]"))
    out = strip(F.array_join(kept, " "))
    return F.when(F.length(out) < 2, "").otherwise(out)


def sentence_lemmas(text: Column) -> Column:
    """SCA-33."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z]+"), F.lit(0)), F.lower))


def mapped_words(words: Column, mapping: Column) -> Column:
    """SCA-34: words replaced where the map has them, joined by blanks."""
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(mapping, w), w)), " ")


def similar_strings(a: Column, b: Column) -> Column:
    """SCA-36: one holds the other with up to 4 more characters, or 2 edits at most part them."""
    apart = F.abs(F.length(a) - F.length(b))
    return ((F.contains(a, b) | F.contains(b, a)) & (apart <= 4)) | ((apart <= 2) & (F.levenshtein(a, b) <= 2))


def derived_lemmas(a: Column, b: Column) -> Column:
    """SCA-37: one holds the other, or adds a derivational ending."""
    ends = [F.concat(x, F.lit(e)) == y for x, y in ((a, b), (b, a)) for e in ("ed", "ing", "tion", "ity", "ness")]
    ends += [F.concat(F.substring(x, F.lit(1), F.greatest(F.length(x) - 2, F.lit(0))), F.lit("y")) == y for x, y in ((a, b), (b, a))]
    near = F.abs(F.length(a) - F.length(b)) <= 4
    return ((F.contains(a, b) | F.contains(b, a)) & near) | _any(ends)


def swapped_ends(adjective: Column, noun: Column) -> Column:
    """SCA-38: the same stem with an adjective's and a noun's ending, an e between allowed."""
    out = []
    for x in L.ADJECTIVE_ENDS:
        stem = F.substring(adjective, F.lit(1), F.length(adjective) - len(x))
        ok = adjective.endswith(x)
        out += [ok & ((F.concat(stem, F.lit(y)) == noun) | (F.concat(stem, F.lit("e" + y)) == noun)) for y in L.NOUN_ENDS]
    return _any(out)


def cosine(a: Column, b: Column) -> Column:
    """SCA-39: 0.0 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def payload(text: Column, schema: str) -> Column:
    """SCA-43..45: the JSON between the first ``{`` and the last ``}``; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def payload_list(text: Column, schema: str = "array<array<string>>") -> Column:
    """SCA-44: the list between the first ``[`` and the last ``]``; empty if there is none."""
    found = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit("")), schema)
    return F.coalesce(found, F.from_json(F.lit("[]"), schema))


def triplet_of(items: Column) -> Column:
    """SCA-46: struct (s, r, o) of a 3-list, or of a 4-list without its third; null else."""
    n = F.size(items)
    at = lambda i: F.get(items, F.lit(i))
    return F.when(n == 3, F.struct(at(0).alias("s"), at(1).alias("r"), at(2).alias("o"))).when(
        n == 4, F.struct(at(0).alias("s"), at(1).alias("r"), at(3).alias("o"))
    )


def decay_score(text: Column) -> Column:
    """SCA-48: 0 to 3; 2 where it isn't a number."""
    x = text.try_cast("int")
    return F.when(x.isNull(), 2).otherwise(F.greatest(F.lit(0), F.least(F.lit(3), x)))


def landscape(raw: Column) -> Column:
    """SCA-49: 5 minus the distance, from 0 to 5."""
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.lit(5.0) - raw.cast("double"))))


def analysis_text(text: Column, age: Column) -> Column:
    """SCA-50."""
    return F.format_string("Age: %d years old.\n%s", age.cast("int"), text)


def pretty(text: Column) -> Column:
    """SCA-52."""
    return strip(F.regexp_replace(F.translate(text, "_", " "), r"\s+", " "))


def title_line(text: Column, most: int) -> Column:
    """SCA-56: tags off, white space squeezed, cut with dots."""
    t = strip(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def log_scaled(x: Column, metric: str) -> Column:
    """SCA-11: log10(x + 1) for the metrics on a log scale."""
    return F.log10(x + 1) if metric in L.LOGGED else x


def age_by_grade(text: Column) -> Column:
    """SCA-17: a stated age from 1 to 99, else the age of a grade, else of a role, else by school level."""
    low = F.lower(text)
    stated = stated_age(low)
    grade = F.nullif(F.regexp_extract(low, r"\b(1[0-2]|[1-9])(?:st|nd|rd|th)?\s+grade\b", 1), F.lit("")).cast("int")
    grades = [F.when(grade == g, F.lit(a)) for g, a in L.GRADE_AGES.items()]
    roles = [F.when(F.contains(low, F.lit(r)), F.lit(a)) for r, a in L.ROLE_AGES]
    levels = [F.when(_any([F.contains(low, F.lit(p)) for p in ps]), F.lit(a)) for ps, a in L.LEVEL_AGES]
    return F.coalesce(F.when(stated.between(1, 99), stated), *grades, *roles, *levels)


def completed_age(age: Column, text: Column) -> Column:
    """FIL-14: a known age passes; others come from the text."""
    return F.coalesce(age.cast("int"), age_by_phrase(text))


def edit_distance(a: Column, b: Column) -> Column:
    """SCA-35."""
    return F.levenshtein(a, b)


def relation_or_null(label: Column) -> Column:
    """SCA-47: the normalised label, null where it has no letter."""
    out = edge_label(label)
    return F.when(is_relation_label(out), out)


def node_token(text: Column) -> Column:
    """SCA-51."""
    return strip(F.lower(text))


def before_final(name: Column) -> Column:
    """SCA-53."""
    return F.substring_index(name, "_FINAL_", 1)


def utc_now() -> Column:
    """SCA-54: the time as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def prefix_and_sentence(name: Column) -> tuple[Column, Column]:
    """SCA-55, VIZ-7, VIZ-8: the parts of an image's name that mosaics are grouped by."""
    pattern = r"^(.*)_sent([0-9]+)\.[A-Za-z0-9_]+$"
    ok = name.rlike(pattern)
    return F.when(ok, F.regexp_extract(name, pattern, 1)), F.when(ok, F.regexp_extract(name, pattern, 2).cast("int"))


def nodes_line(label: str, nodes: Column) -> Column:
    """SCA-57: ``label: a, b``; ``none`` where there are none; null for null."""
    names = F.array_join(F.filter(F.transform(nodes, strip), lambda n: n != ""), ", ")
    return F.when(nodes.isNotNull(), F.concat(F.lit(f"{label}: "), F.when(names == "", "none").otherwise(names)))


def hints(pairs: Column) -> Column:
    """NLP-6: lines of (adjective, noun) pairs for a prompt."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("- "), p["noun"], F.lit(" is "), p["adjective"])), "\n")


def not_a_pupil(text: Column) -> Column:
    """FIL-12: boolean exclusion; null is out."""
    low = F.lower(text)
    opens = low.rlike(r"^\s*(a|an|the|i'm|i am)\s+([\w\s-]*)?\b(student|pupil|freshman|sophomore|junior|senior|attendee)\b")
    graduate = low.rlike(r"^\s*(a|an|the)\s+([\w\s]*)\bgraduat(e|ed)\b") & ~contains_any(text, L.WILL_GRADUATE)
    sweethearts = F.contains(low, F.lit("sweetheart")) & contains_any(text, ["engaged", "married"])
    out = (
        (opens & contains_any(text, ["senior citizen", "former"])) | contains_any(text, L.NO_PUPIL) | graduate
        | low.rlike(r"class of (19[0-9]{2}|20[01][0-9])") | sweethearts | (contains_any(text, L.COMIC_SERIES) & ~opens)
    )
    return F.coalesce(out, F.lit(True))
