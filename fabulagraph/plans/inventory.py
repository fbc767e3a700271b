"""More registered queries, one or more for each operator that ``queries`` leaves out.

Parts stand for records with a name of an adjective and a noun, a size and a type; small values of a
size choose among the forms that an operator tells apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabulagraph.functions import gates as K
from fabulagraph.functions import lexicon as L
from fabulagraph.functions import text as T
from fabulagraph.functions.oracle import aged, judged
from fabulagraph.functions.tagger import node_type
from fabulagraph.operators import graph as G
from fabulagraph.operators import metrics as M
from fabulagraph.operators import stats as S
from fabulagraph.operators import tables as R
from fabulagraph.operators.lineage import folder
from fabulagraph.plans import views as V
from fabulagraph.plans.queries import _ENDS, _PERSONAS, _QUOTED, _STATED, _any_sql, _draw_sql, _personas, _stats, _words, query, r6
from fabulagraph.plans.story import sentences_of
from fabulagraph.sources import files

c = F.col


def _part(spark, d) -> DataFrame:
    return V.table(spark, d, "part")


def _choice(*forms: str) -> str:
    """SQL that reads the same in both engines: one of the forms, by size."""
    return "CASE p_size % " + str(len(forms)) + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(forms)) + " END"


def _named(spark, d, sql: str, name: str = "n") -> DataFrame:
    return _part(spark, d).selectExpr("*", f"{sql} AS {name}")


# -- names and labels --------------------------------------------------------------------

_FILE = _choice(
    "'model_' || p_brand || '_triplets_Primary_' || p_size || '.csv'", "'model_a_triplets_b_triplets_highschool_2.csv'", "'Secondary_FINAL_' || p_brand || '_FINAL_x.csv'",
    "'high-school_' || p_size || '_sent' || p_size || '.png'", "'Uni_freshman' || p_type", "'model_' || p_brand || '_triplets_Freshman_1.csv'", "lower(p_type) || '_sent.png'",
)
_OF_MODEL = r"^model_(.+?)_triplets_(.+)\.csv$"
_OF_IMAGE = r"^(.*)_sent([0-9]+)\.[A-Za-z0-9_]+$"


@query(f"""WITH f AS (SELECT p_partkey, {_FILE} AS n FROM part), g AS (SELECT *, lower(n) AS low, split_part(regexp_extract(n, '{_OF_MODEL}', 2), '_', 1) AS one FROM f)
SELECT p_partkey, CASE WHEN contains(low, 'primary') THEN 'primary' WHEN contains(low, 'sec') THEN 'secondary' WHEN contains(low, 'high') THEN 'high_school'
WHEN contains(low, 'university') OR contains(low, 'freshman') THEN 'university' ELSE 'unknown' END AS file_regime,
CASE WHEN regexp_matches(low, 'primary') THEN 'primary' WHEN regexp_matches(low, 'secondary') THEN 'secondary' WHEN regexp_matches(low, 'high[_-]?school') THEN 'highschool' WHEN regexp_matches(low, 'uni') THEN 'university' END AS file_group,
CASE WHEN regexp_matches(n, '{_OF_MODEL}') THEN regexp_extract(n, '{_OF_MODEL}', 1) END AS model,
CASE WHEN regexp_matches(n, '{_OF_MODEL}') THEN CASE WHEN list_contains({_words(L.KNOWN_REGIMES)}, lower(one)) THEN lower(one) ELSE one END END AS regime,
split_part(n, '_FINAL_', 1) AS ahead, CASE WHEN regexp_matches(n, '{_OF_IMAGE}') THEN regexp_extract(n, '{_OF_IMAGE}', 1) END AS prefix,
CASE WHEN regexp_matches(n, '{_OF_IMAGE}') THEN regexp_extract(n, '{_OF_IMAGE}', 2)::INT END AS sentence FROM g""")
def file_names(spark, d):
    """SCA-9, SCA-10, SCA-53, SCA-55, SRC-12."""
    n = c("n")
    (model, regime), (prefix, sentence) = T.model_and_regime(n), T.prefix_and_sentence(n)
    return _named(spark, d, _FILE).select(
        "p_partkey", T.regime_of_file(n).alias("file_regime"), T.group_of_file(n).alias("file_group"), model.alias("model"), regime.alias("regime"),
        T.before_final(n).alias("ahead"), prefix.alias("prefix"), sentence.alias("sentence"),
    )


_BIN, _REG = _choice("' ' || p_size || '-' || (p_size + 1)", "p_size || '—9 '", "'x'"), _choice("' High School_' || p_type", "'high_school'", "upper(p_name) || ' '")


@query(f"SELECT p_partkey, translate(trim({_BIN}), '-—', '––') AS bin, regexp_replace(trim(lower({_REG})), '[ _]', '', 'g') AS regime FROM part")
def label_forms(spark, d):
    """SCA-7, SCA-8."""
    return _part(spark, d).select("p_partkey", T.normal_bin(F.expr(_BIN)).alias("bin"), T.normal_regime(F.expr(_REG)).alias("regime"))


_MODEL = _choice("' Gemma3:27b'", "'qwen3-30b-a3b: Instruct'", "'Phi4'", "'meta/llama3.3-70b Instruct'", "p_brand", "'Qwen/Qwen3 next-80b'")


@query(f"""SELECT p_partkey, CASE {" ".join(f"WHEN contains(low, '{o}') THEN replace(low, '{o}', '{n}')" for o, n in L.MODEL_NAMES)} ELSE low END AS family,
CASE WHEN contains(tag, 'qwen') THEN array_to_string(list_transform(string_split(tag, '-'), lambda p: CASE WHEN starts_with(p, 'qwen') THEN 'Qwen' || substr(p, 5)
WHEN ends_with(p, 'b') AND regexp_matches(p, '[0-9]') THEN upper(p) WHEN regexp_matches(p, '^[a-z]+$') THEN upper(substr(p, 1, 1)) || substr(p, 2) ELSE p END), '-') ELSE tag END AS tag
FROM (SELECT p_partkey, trim(lower({_MODEL})) AS low, lower(translate({_MODEL}, '/: ', '--_')) AS tag FROM part)""")
def model_tags(spark, d):
    """SCA-12, SCA-13."""
    return _named(spark, d, _MODEL).select("p_partkey", T.model_family(c("n")).alias("family"), T.safe_tag(c("n")).alias("tag"))


_TRIM, _SQUEEZED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')", r"regexp_replace({0}, '\s+', ' ', 'g')"


@query(rf"""SELECT conv_id, turn, CASE WHEN p = '' THEN 'unknown' ELSE p END AS part FROM (SELECT conv_id, turn,
regexp_replace(regexp_replace(substr({_TRIM.format("regexp_replace(coalesce(text, ''), '\n', ' ', 'g')")}, 1, 80), '[\\/:*?"<>|]', '_', 'g'), '\s+', '_', 'g') AS p FROM conversations)""")
def file_parts(spark, d):
    """SRC-23."""
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.safe_file_part(c("text")).alias("part"))


@query(rf"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')[1:5], ' ') AS snippet,
md5({_TRIM.format(_SQUEEZED.format("replace(text, '_', ' ')"))}) AS pretty, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 57)) || '...' ELSE t END AS title
FROM (SELECT *, {_TRIM.format(_SQUEEZED.format("regexp_replace(text, '<[^>]+>', '', 'g')"))} AS t FROM conversations)""")
def text_forms(spark, d):
    """SCA-21, SCA-52, SCA-56."""
    x = c("text")
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.snippet(x).alias("snippet"), F.md5(T.pretty(x)).alias("pretty"), T.title_line(x, 60).alias("title"))


_MESSY = _choice("p_name", "'12'", "'Likes ' || p_type || ' (edge)'", "'has_been ' || p_name", "'is!'")


@query(rf"""WITH a AS (SELECT p_partkey, {_MESSY} AS n FROM part), b AS (SELECT *, lower(regexp_replace({_TRIM.format("n")}, '\s*\(edge\)\s*', '', 'g')) AS low FROM a), x AS (SELECT *, replace(low, '_', ' ') AS plain FROM b),
m AS (SELECT *, CASE WHEN regexp_matches(plain, '\blikes?\b') THEN 'enjoys' WHEN regexp_matches(plain, '\b(is|are|was|were|be|being|been)\b') THEN 'is' WHEN regexp_matches(plain, '\b(has|have|possess|own)\b') THEN 'has' ELSE plain END AS meaning FROM x),
l AS (SELECT *, regexp_replace(CASE WHEN meaning <> low THEN meaning ELSE regexp_replace(replace(low, ' ', '_'), '[^\p{{L}}\p{{N}}_]', '', 'g') END, '_+', '_', 'g') AS label FROM m)
SELECT p_partkey, CASE WHEN regexp_matches(label, '[a-zA-Z]') THEN label END AS label, trim(lower(n)) AS token FROM l""")
def relation_labels(spark, d):
    """SCA-47, SCA-51."""
    return _named(spark, d, _MESSY).select("p_partkey", T.relation_or_null(c("n")).alias("label"), T.node_token(c("n")).alias("token"))


@query("""SELECT p_partkey, printf('%02d:%02d:%02d', (p_partkey * 37) // 3600, ((p_partkey * 37) % 3600) // 60, (p_partkey * 37) % 60) AS clock, 'Age: ' || p_size || ' years old.' || chr(10) || p_name AS described,
round(log10(p_size + 1), 6) AS logged, p_size::DOUBLE AS plain FROM part""")
def scaled_values(spark, d):
    """SCA-11, SCA-22, SCA-50."""
    size = c("p_size").cast("double")
    return _part(spark, d).select(
        "p_partkey", T.clock(c("p_partkey") * 37).alias("clock"), T.analysis_text(c("p_name"), c("p_size")).alias("described"),
        r6(T.log_scaled(size, "num_triplets"), "logged"), T.log_scaled(size, "graph_density").alias("plain"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Nodes: none' ELSE 'Nodes: ' || p_brand || ', ' || p_name END AS nodes, '- ' || split_part(p_name, ' ', 2) || ' is ' || split_part(p_name, ' ', 1) || chr(10) || '- x is y' AS hints,
replace(p_name, 'red ', 'crimson ') AS mapped FROM part""")
def prompt_lines(spark, d):
    """SCA-34, SCA-57, NLP-6."""
    words = F.split("p_name", " ")
    nodes = F.when(c("p_size") % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(c("p_brand"), F.lit(" "), F.concat(F.lit(" "), c("p_name"))))
    pair = lambda a, n: F.struct(a.alias("adjective"), n.alias("noun"))
    return _part(spark, d).select(
        "p_partkey", T.nodes_line("Nodes", nodes).alias("nodes"), T.hints(F.array(pair(F.get(words, F.lit(0)), F.get(words, F.lit(1))), pair(F.lit("y"), F.lit("x")))).alias("hints"),
        T.mapped_words(words, F.create_map(F.lit("red"), F.lit("crimson"))).alias("mapped"),
    )


@query(f"""SELECT conv_id, turn, coalesce({" OR ".join(f"contains(text, '{t}')" for t in L.CONTROL_TOKENS)}, false) AS control, md5(coalesce(nullif({_TRIM.format("text")}, ''), nullif({_TRIM.format("role")}, ''), 'rest')) AS preferred FROM conversations""")
def control_tokens(spark, d):
    """FIL-18, SRC-7."""
    rows = V.table(spark, d, "conversations")
    return rows.select("conv_id", "turn", T.is_control(c("text")).alias("control"), F.md5(T.preferred_text(c("text"), c("role"), rest=F.lit("rest"))).alias("preferred"))


_LISTS = _choice("""'so [["' || p_brand || '","is","' || p_name || '"]] ok'""", """'[["a","b","c","' || p_type || '"],["x"]]'""", "'no list'", "'[]'")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand || '|is|' || p_name WHEN 1 THEN 'a|b|' || p_type ELSE '' END AS triplets, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n FROM part""")
def payload_lists(spark, d):
    """SCA-44, SCA-46."""
    rows = _named(spark, d, _LISTS).select("p_partkey", T.payload_list(c("n")).alias("found"))
    shown = F.transform(c("found"), lambda x: (lambda t: F.concat_ws("|", t["s"], t["r"], t["o"]))(T.triplet_of(x)))
    return rows.select("p_partkey", F.array_join(F.filter(shown, lambda x: x != ""), ";").alias("triplets"), F.size("found").alias("n"))


# -- personas ----------------------------------------------------------------------------

_LOW = "lower(text)"
_BY_PHRASE = f"coalesce({_STATED}, CASE " + " ".join(f"WHEN {_any_sql(ps)} THEN {age}" for ps, age in [((p,), a) for p, a in L.PHRASE_AGES] + L.SCHOOL_AGES) + " END)"
_GROUP = _choice("' Young_Child '", "'university_student'", "'unknown'", "NULL")


@query(f"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size < 18 THEN p_size END WHEN g IS NOT NULL THEN CASE WHEN g < 18 THEN g END ELSE {_BY_PHRASE} END AS age FROM
(SELECT *, CASE p_size % 4 WHEN 0 THEN 5 WHEN 1 THEN 19 END AS g FROM ({_PERSONAS}))""")
def final_ages(spark, d):
    """SCA-16."""
    p = _personas(spark, d).withColumn("age", F.when(c("p_size") % 5 == 0, c("p_size")))
    return p.select("p_partkey", T.final_age(c("text"), c("age"), F.expr(_GROUP)).alias("age"))


_GRADED = f"SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN 'A pupil of ' || (p_size % 14) || 'th grade' WHEN p_size % 5 = 1 THEN 'High School Junior and friend' ELSE text END AS text FROM ({_PERSONAS})"


def _graded(spark, d) -> DataFrame:
    text = F.when(c("p_size") % 3 == 0, F.concat(F.lit("A pupil of "), (c("p_size") % 14).cast("string"), F.lit("th grade"))).when(c("p_size") % 5 == 1, "High School Junior and friend").otherwise(c("text"))
    return _personas(spark, d).withColumn("text", text)


@query(rf"""SELECT p_partkey, coalesce(CASE WHEN {_STATED} BETWEEN 1 AND 99 THEN {_STATED} END, try_cast(nullif(regexp_extract({_LOW}, '\b(1[0-2]|[1-9])(?:st|nd|rd|th)?\s+grade\b', 1), '') AS INT) + 5,
CASE {" ".join(f"WHEN contains({_LOW}, '{r}') THEN {a}" for r, a in L.ROLE_AGES)} {" ".join(f"WHEN {_any_sql(ps)} THEN {a}" for ps, a in L.LEVEL_AGES)} END) AS age FROM ({_GRADED})""")
def grade_ages(spark, d):
    """SCA-17."""
    return _graded(spark, d).select("p_partkey", T.age_by_grade(c("text")).alias("age"))


def _quoted(phrases: list[str]) -> str:
    return _any_sql([p.replace("'", "''") for p in phrases])


def _school_sql(k: str) -> str:
    low, below, high, above = L.STRICT_AGES[k]
    rules = [(f"p_size < {low}", below), (f"p_size > {high}", above), *((_quoted(ps), why) for why, ps in L.STRICT_PHRASES[k])]
    if k == "primary":
        rules.append((f"p_size <= 2 AND NOT {_quoted(L.SCHOOL_OF_INFANTS)}", "infant without school context"))
    if k == "university":
        rules.append((f"NOT {_quoted(L.FRESHMAN_SIGNS + L.ENROLLED_SIGNS)}", "no clear first-year university signal"))
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{why}' END" for when, why in rules) + f"], lambda x: x IS NOT NULL), ';') AS {k}"


_SCHOOL_TEXTS = (
    "SELECT p_partkey, p_size, text || CASE p_size % 9 WHEN 0 THEN ' in a fairy tale' WHEN 1 THEN ', the parent of a pupil' WHEN 2 THEN '; used to be in middle school' "
    "WHEN 3 THEN ' and a university freshman' WHEN 4 THEN ', a Sophomore' WHEN 5 THEN ' with a master''s degree' WHEN 6 THEN ' who attends nursery' ELSE '' END AS text FROM ({p})"
)


@query(f"SELECT p_partkey, {', '.join(map(_school_sql, L.STRICT_PHRASES))} FROM ({_SCHOOL_TEXTS.format(p=_PERSONAS)})")
def school_filters(spark, d):
    """FIL-8, FIL-9, FIL-10."""
    _personas(spark, d).createOrReplaceTempView("_school_personas")
    p = spark.sql(_SCHOOL_TEXTS.format(p="SELECT * FROM _school_personas").replace("master''s", "master\\'s"))
    return p.select("p_partkey", *[F.array_join(T.school_reasons(c("text"), c("p_size"), k), ";").alias(k) for k in L.STRICT_PHRASES])


_PUPILS = _choice(
    "'A student at school'", "'a former pupil'", "'The senior citizen'", "'An artist who graduated'", "'A boy who hopes to graduate'", "'class of 2011'", "'class of 2031'",
    "'The graduate of a school'", "'sweetheart, engaged'", "'slice of life'", "'A student in slice of life'", "NULL", "p_name || ' teacher'",
)


@query(rf"""SELECT p_partkey, coalesce((opens AND {_quoted(["senior citizen", "former"])}) OR {_quoted(L.NO_PUPIL)} OR (regexp_matches({_LOW}, '^\s*(a|an|the)\s+([\w\s]*)\bgraduat(e|ed)\b') AND NOT {_quoted(L.WILL_GRADUATE)})
OR regexp_matches({_LOW}, 'class of (19[0-9]{{2}}|20[01][0-9])') OR (contains({_LOW}, 'sweetheart') AND {_quoted(["engaged", "married"])}) OR ({_quoted(L.COMIC_SERIES)} AND NOT opens), true) AS excluded
FROM (SELECT *, regexp_matches(lower(text), '^\s*(a|an|the|i''m|i am)\s+([\w\s-]*)?\b(student|pupil|freshman|sophomore|junior|senior|attendee)\b') AS opens FROM (SELECT p_partkey, {_PUPILS} AS text FROM part))""")
def pupil_filter(spark, d):
    """FIL-12."""
    return _named(spark, d, _PUPILS, "text").select("p_partkey", T.not_a_pupil(c("text")).alias("excluded"))


@query(f"SELECT p_partkey, p_size AS age FROM ({_PERSONAS}) WHERE p_size <= 11 AND NOT {_any_sql(L.EXCLUDE['primary'])}")
def young_personas(spark, d):
    """WIN-21."""
    p = _personas(spark, d).select("p_partkey", c("text").alias("persona_text"), c("p_size").alias("age"))
    return R.young(p, "primary").select("p_partkey", "age")


# -- words -------------------------------------------------------------------------------

_A, _B = _choice("a || 'ful'", "a", "a || 'y'", "a || 'ed'"), _choice("a || 'th'", "a || 'ness'", "a || 'eance'", "b", "a || 'ity'")
_WORDS = "SELECT p_partkey, p_size, {a} AS x, {b} AS y FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)"


def _derived_sql(a: str, b: str) -> str:
    ends = [f"{x} || '{e}' = {y}" for x, y in ((a, b), (b, a)) for e in ("ed", "ing", "tion", "ity", "ness")] + [f"substr({x}, 1, greatest(length({x}) - 2, 0)) || 'y' = {y}" for x, y in ((a, b), (b, a))]
    return f"((contains({a}, {b}) OR contains({b}, {a})) AND abs(length({a}) - length({b})) <= 4 OR {' OR '.join(ends)})"


def _swapped_sql(a: str, b: str) -> str:
    return "(" + " OR ".join(f"(ends_with({a}, '{x}') AND {b} IN ({', '.join(f'substr({a}, 1, length({a}) - {len(x)}) || {y!r}' for z in L.NOUN_ENDS for y in (z, 'e' + z))}))" for x in L.ADJECTIVE_ENDS) + ")"


def _similar_sql(a: str, b: str) -> str:
    return f"((contains({a}, {b}) OR contains({b}, {a})) AND abs(length({a}) - length({b})) <= 4 OR abs(length({a}) - length({b})) <= 2 AND levenshtein({a}, {b}) <= 2)"


def _word_pairs(spark, d) -> DataFrame:
    return _part(spark, d).selectExpr("p_partkey", "p_size", "split_part(p_name, ' ', 1) AS a", "split_part(p_name, ' ', 2) AS b").selectExpr("p_partkey", "p_size", f"{_A} AS x", f"{_B} AS y")


@query(f"SELECT p_partkey, levenshtein(x, y)::INT AS distance, {_derived_sql('x', 'y')} AS derived, {_swapped_sql('x', 'y')} AS swapped, {_similar_sql('x', 'y')} AS similar FROM ({_WORDS.format(a=_A, b=_B)})")
def word_pairs(spark, d):
    """SCA-35, SCA-37, SCA-38."""
    x, y = c("x"), c("y")
    return _word_pairs(spark, d).select("p_partkey", T.edit_distance(x, y).alias("distance"), T.derived_lemmas(x, y).alias("derived"), T.swapped_ends(x, y).alias("swapped"), T.similar_strings(x, y).alias("similar"))


_SAID = f"SELECT p_partkey % 60 AS run_id, p_partkey, 's' AS subject, CASE WHEN p_size % 3 = 0 THEN 'has' ELSE 'is' END AS relation, CASE WHEN p_size % 2 = 0 THEN x ELSE y END AS object, CASE WHEN p_size % 2 = 0 THEN 'ADJ' ELSE 'NOUN' END AS pos FROM ({_WORDS.format(a=_A, b=_B)})"


@query(f"""WITH t AS ({_SAID}), p AS (SELECT DISTINCT a.run_id, a.object AS x, a.relation AS rx, b.object AS y, b.relation AS ry FROM t a JOIN t b ON a.run_id = b.run_id WHERE a.pos = 'ADJ' AND b.pos = 'NOUN'
AND ({_derived_sql('a.object', 'b.object')} OR {_swapped_sql('a.object', 'b.object')} OR {_similar_sql('a.object', 'b.object')}) AND a.relation <> b.relation)
SELECT p_partkey FROM t WHERE NOT (relation = 'has' AND EXISTS (SELECT 1 FROM p WHERE p.run_id = t.run_id AND (rx = 'has' AND x = t.object OR rx = 'is' AND y = t.object)))""")
def distinct_meanings(spark, d):
    """JOIN-14, NLP-13, NLP-14."""
    t = _word_pairs(spark, d).select(
        (c("p_partkey") % 60).alias("run_id"), "p_partkey", F.lit("s").alias("subject"), F.when(c("p_size") % 3 == 0, "has").otherwise("is").alias("relation"),
        F.when(c("p_size") % 2 == 0, c("x")).otherwise(c("y")).alias("object"), F.when(c("p_size") % 2 == 0, "ADJ").otherwise("NOUN").alias("object_pos"),
    )
    return R.distinct_meanings(t, ["run_id"]).select("p_partkey")


# -- gates over tagged tokens --------------------------------------------------------------

#: Tokens of a part: adjective, noun (a name for some), and a verb or a copula for some.
_TOKENS_SQL = (
    "list_filter([{'text': a, 'lemma': a, 'pos': 'ADJ'}, {'text': CASE WHEN p_size % 4 = 1 THEN upper(b) ELSE b END, 'lemma': b, 'pos': CASE WHEN p_size % 4 = 1 THEN 'PROPN' ELSE 'NOUN' END},"
    " CASE p_size % 3 WHEN 0 THEN {'text': 'runs', 'lemma': 'run', 'pos': 'VERB'} WHEN 1 THEN {'text': 'is', 'lemma': 'be', 'pos': 'AUX'} END, CASE WHEN p_size % 6 = 0 THEN {'text': 'on', 'lemma': 'on', 'pos': 'ADP'} END], lambda t: t IS NOT NULL)"
)
_TAGGED = f"(SELECT *, {_TOKENS_SQL} AS t FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part))"
_STORY = ["ring", "widget", "red"]


def _token(text: Column, lemma: Column, pos: Column) -> Column:
    return F.struct(text.alias("text"), lemma.alias("lemma"), pos.alias("pos"))


def _tagged(spark, d) -> DataFrame:
    rows = _part(spark, d).withColumns({"a": F.split_part("p_name", F.lit(" "), F.lit(1)), "b": F.split_part("p_name", F.lit(" "), F.lit(2))})
    name, s = c("p_size") % 4 == 1, c("p_size")
    verb = F.when(s % 3 == 0, _token(F.lit("runs"), F.lit("run"), F.lit("VERB"))).when(s % 3 == 1, _token(F.lit("is"), F.lit("be"), F.lit("AUX")))
    toks = [_token(c("a"), c("a"), F.lit("ADJ")), _token(F.when(name, F.upper("b")).otherwise(c("b")), c("b"), F.when(name, "PROPN").otherwise("NOUN")), verb,
            F.when(s % 6 == 0, _token(F.lit("on"), F.lit("on"), F.lit("ADP")))]
    return rows.withColumn("t", F.array_compact(F.array(*toks)))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN upper(b) ELSE b END AS canonical, b AS subject_lemma, a AS object_lemma, list_contains({_words(_STORY)}, a) OR list_contains({_words(_STORY)}, b) OR len(list_intersect({_words(_STORY)}, list_transform(t, lambda x: x.lemma))) > 0 AS grounded,
CASE WHEN p_size % 3 = 1 THEN '' ELSE array_to_string(list_transform(list_filter(t, lambda x: x.pos IN ('VERB', 'ADP')), lambda x: x.lemma), '_') END AS label,
len(list_filter(t, lambda x: x.pos IN ('VERB', 'AUX') OR regexp_matches(x.text, '(?i)(ing|ed|es)$'))) > 0 AS verbal, array_to_string(list_transform(t, lambda x: CASE WHEN x.pos IN ('NOUN', 'PROPN') THEN 'CONCEPT' WHEN x.pos = 'ADJ' THEN 'PROPERTY' ELSE '-' END), ',') AS kinds
FROM {_TAGGED}""")
def canonical_nodes(spark, d):
    """SCA-26, SCA-27, SCA-29, SCA-30, SCA-32, NLP-11."""
    t, story = c("t"), F.array(*map(F.lit, _STORY))
    return _tagged(spark, d).select(
        "p_partkey", K.canonical_text(t).alias("canonical"), K.canonical_lemma(t, True).alias("subject_lemma"), K.canonical_lemma(t, False).alias("object_lemma"),
        K.grounded_in_story(t, story).alias("grounded"), K.verbal_label(t).alias("label"), K.is_verbal(t).alias("verbal"),
        F.array_join(F.transform(t, lambda x: F.coalesce(node_type(x["pos"]), F.lit("-"))), ",").alias("kinds"),
    )


_LEMMA = _choice("a", "b", "b || 's'", "'x'", "''", "'a1'", "b || 'ed'")
_KIND, _FROM = _choice("'CONCEPT'", "'PROPERTY'"), _choice("'STORY_EXPLICIT'", "'INFERRED_RELATION'", "'INFERENCE_BASED'")


@query(f"""SELECT p_partkey, CASE WHEN l = '' THEN 'empty_lemmas' WHEN length(l) <= 1 THEN 'lemma_too_short' WHEN NOT regexp_matches(l, '^[a-zA-Z]+$') THEN 'invalid_characters' WHEN l IN ('blue', 'green') THEN 'persona_only_lemma'
WHEN p_size % 5 <> 0 AND k <> 'PROPERTY' AND NOT starts_with(v, 'INFERRED') AND NOT (list_contains({_words(_STORY)}, l) OR list_contains({_words(_STORY)}, regexp_replace(l, '(ed|ing)$', '')) OR list_contains({_words(_STORY)}, regexp_replace(l, '(ed|ing)$', '') || 'e')) THEN 'not_story_grounded' END AS refused,
(p_size % 2 = 0 OR length(l) > 1) AND CASE WHEN p_size % 2 = 0 AND v = 'INFERRED_RELATION' THEN true WHEN v = 'STORY_EXPLICIT' AND k = 'PROPERTY' THEN len(list_filter(t, lambda x: x.lemma = l AND x.pos = 'ADJ')) > 0
WHEN v = 'STORY_EXPLICIT' THEN len(list_filter(t, lambda x: x.lemma = l AND x.pos NOT IN ('VERB', 'AUX'))) > 0 AND (list_contains({_words(_STORY)}, l) OR list_contains({_words(_STORY)}, regexp_replace(l, 's$', ''))) ELSE p_size % 3 = 0 END AS admitted,
l NOT IN ('blue', 'green') AND (p_size % 7 = 0 OR list_contains({_words(_STORY)}, l) OR list_contains([a, b], l) OR l = 'x') AS allowed, l IN ({", ".join(f"'{x}'" for x in K.BANNED)}) AS banned
FROM (SELECT *, {_LEMMA} AS l, {_KIND} AS k, {_FROM} AS v FROM {_TAGGED})""")
def node_gates(spark, d):
    """FIL-24..29, GRA-8's list."""
    rows = _tagged(spark, d).selectExpr("*", f"{_LEMMA} AS l", f"{_KIND} AS k", f"{_FROM} AS v")
    story, only, s = F.array(*map(F.lit, _STORY)), F.array(F.lit("blue"), F.lit("green")), c("p_size")
    return rows.select(
        "p_partkey", K.node_gate(c("l"), c("k"), c("v"), s % 5 != 0, story, only).alias("refused"),
        K.admitted(c("l"), c("k"), c("v"), c("t"), story, s % 2 == 0, s % 3 == 0).alias("admitted"),
        K.allowed(c("l"), story, F.array("a", "b"), F.array(F.lit("x")), only, s % 7 == 0).alias("allowed"), K.is_banned(c("l")).alias("banned"),
    )


@query(f"""SELECT p_partkey, (p_size % 6 = 0) OR (a IN ('red', 'blue') AND b IN ('red', 'ring')) OR a IN ('green', 'small') OR b IN ('green', 'small') OR a = 'widget' OR b = 'widget' OR a = 'gear' OR b = 'gear' AS attachable FROM {_TAGGED}""")
def attachable_edges(spark, d):
    """FIL-30, SET-3, SET-6."""
    lits = lambda *x: F.array(*map(F.lit, x))
    active = F.when(c("p_size") % 6 == 0, F.array().cast("array<string>")).otherwise(lits("green", "small"))
    return _tagged(spark, d).select("p_partkey", K.attachable(c("a"), c("b"), lits("red", "blue", "ring"), active, lits("widget"), lits("gear")).alias("attachable"))


_DENIED = _choice("'is_not'", "p_name", "'unrelated to'", "'is_a'", "'never_meets'")


@query(f"""SELECT p_partkey, {_any_sql(L.NEGATION_PHRASES, "lower(replace(n, '_', ' '))")} OR len(list_intersect(string_split(lower(replace(n, '_', ' ')), ' '), {_words(L.NEGATION_WORDS)})) > 0 OR p_size % 7 = 0 AS negated,
len(list_intersect(string_split(lower(replace(n, '_', ' ')), ' '), {_words(K.BE_VERBS)})) > 0 AS copular FROM (SELECT *, {_DENIED} AS n FROM part)""")
def negated_relations(spark, d):
    """FIL-20, NLP-12."""
    toks = F.when(c("p_size") % 7 == 0, F.array(_token(F.lit("not"), F.lit("not"), F.lit("PART")))).otherwise(F.array(_token(F.lit("x"), F.lit("x"), F.lit("NOUN"))))
    return _named(spark, d, _DENIED).select("p_partkey", K.negated(c("n"), toks).alias("negated"), K.is_copular(c("n")).alias("copular"))


@query("SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], list_transform(range(len(embedding)), lambda i: 1.0::DOUBLE)) > 0.05 OR list_cosine_similarity(embedding::DOUBLE[], list_transform(range(len(embedding)), lambda i: CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)) > 0.05 AS vague FROM embeddings")
def vague_relations(spark, d):
    """FIL-21."""
    e = V.table(spark, d, "embeddings")
    n = e.select(F.max(F.size("embedding"))).first()[0] or 1
    return e.select("vec_id", K.vague(c("embedding"), [[1.0] * n, [1.0 if i % 2 == 0 else -1.0 for i in range(n)]], 0.05).alias("vague"))


@query("""SELECT p_partkey, CASE WHEN kind = 1 THEN original WHEN kind = 2 THEN original WHEN kind = 3 THEN original ELSE p_name || ' went home.' END AS resolved FROM (SELECT p_partkey, p_name, p_size % 4 AS kind, 'It went home.' AS original FROM part)""")
def cleaned_answers(spark, d):
    """FIL-33, FIL-34, SCA-58: tags and openings fall; payloads and talk of the task give the original."""
    answer = _choice("'<b>Resolved  sentence: </b>' || p_name || ' went   home.'", "'{\"a\": 1}'", "'As an AI I cannot'", "NULL")
    return _named(spark, d, answer).select("p_partkey", K.clean_resolved(F.lit("It went home."), c("n")).alias("resolved"))


@query(f"""SELECT p_type, count(*) AS n, round(sum(len(list_filter(t, lambda x: x.pos = 'NOUN' AND regexp_matches(x.text, '^[a-zA-Z]+$')))) / sum(len(list_filter(t, lambda x: regexp_matches(x.text, '^[a-zA-Z]+$')))), 6) AS ratio FROM {_TAGGED} GROUP BY 1""")
def abstract_concepts(spark, d):
    """AGG-6."""
    return M.abstract_concept_ratio(_tagged(spark, d), ["p_type"], "t").select("p_type", "n", r6("abstract_concept_ratio", "ratio"))


@query(f"SELECT p_partkey, p_size % 5 = 0 AND p_size % 2 = 0 AS said FROM {_TAGGED}")
def said_relations(spark, d):
    """FIL-31: the adjective before a verb of its own is said, other orders and labels aren't."""
    lemma = lambda x: _token(x, x, F.lit("X"))
    toks = F.when(c("p_size") % 5 == 0, F.array(lemma(c("a")), lemma(F.lit("meet")), lemma(F.lit("with")), lemma(F.concat(c("b"), F.lit("_")))))
    toks = F.coalesce(toks, F.array(lemma(F.lit("meet")), lemma(c("a")), lemma(F.concat(c("b"), F.lit("_")))))
    label = F.when(c("p_size") % 2 == 0, "meet_with").otherwise("see")
    return _tagged(spark, d).select("p_partkey", K.said(toks, c("a"), label, F.concat(c("b"), F.lit("_"))).alias("said"))


# -- graphs --------------------------------------------------------------------------------

def _edges(spark, d) -> DataFrame:
    return V.edges(spark, d)


@query(f"""WITH {V.V_EDGES}, x AS (SELECT run_id, src, dst, label, visibility, edge_id FROM v_edges)
SELECT run_id, src, dst, label, arg_max(visibility, edge_id)::INT AS score, 3 AS parts FROM x GROUP BY run_id, src, dst, label UNION ALL SELECT run_id, src, dst, NULL, arg_max(visibility, edge_id)::INT, 2 FROM x GROUP BY run_id, src, dst""")
def activation_scores(spark, d):
    """AGG-41."""
    return G.activation_scores(_edges(spark, d))


@query(f"""WITH {V.V_EDGES}, n AS (SELECT run_id, src, dst, label, min(edge_id) AS edge_id, count(*) AS k FROM v_edges WHERE sentence_index >= 4 AND label IS NOT NULL GROUP BY ALL),
o AS (SELECT * FROM v_edges WHERE sentence_index < 4)
SELECT o.edge_id, CASE WHEN n.k IS NULL THEN o.visibility ELSE least(2, o.visibility + 1) END::INT AS visibility, o.active OR n.k IS NOT NULL AS active, n.k IS NOT NULL AS current FROM o
LEFT JOIN n ON n.run_id = o.run_id AND n.src = o.src AND n.dst = o.dst AND n.label = lower(trim(o.label)) AND o.edge_id = (SELECT min(edge_id) FROM o q WHERE q.run_id = o.run_id AND q.src = o.src AND q.dst = o.dst AND q.label = o.label)""")
def reinforced_edges(spark, d):
    """JOIN-8: edges of later sentences reinforce the first equal one of before."""
    e = _edges(spark, d)
    return G.reinforced(e.where("sentence_index < 4"), e.where("sentence_index >= 4"), 2).select("edge_id", c("visibility").cast("int").alias("visibility"), "active", "current")


@query(f"""WITH {V.V_EDGES} SELECT b.run_id, b.src, b.dst, min(a.edge_id) AS found FROM v_edges b JOIN v_edges a ON a.run_id = b.run_id AND a.src = b.src AND a.dst = b.dst AND a.sentence_index < 4 WHERE b.sentence_index >= 4 GROUP BY ALL""")
def edge_lookup(spark, d):
    """JOIN-6, JOIN-7."""
    e = _edges(spark, d)
    wanted = e.where("sentence_index >= 4").select("run_id", "src", "dst").distinct()
    return G.found_edges(e.where("sentence_index < 4"), wanted).withColumnRenamed("edge_id", "found")


@query(f"SELECT p_partkey, CASE WHEN b IN ('ring', 'widget') THEN b END AS node FROM {_TAGGED}")
def nodes_by_text(spark, d):
    """JOIN-9."""
    known = spark.createDataFrame([("ring",), ("widget",)], "lemma string")
    return G.nodes_by_text(_tagged(spark, d).select("p_partkey", F.lower(K.canonical_text(c("t"))).alias("lemma")), known, "lemma").select("p_partkey", "node")


_MARKED = f"WITH {V.V_EDGES}, {_ENDS}, deg AS (SELECT run_id, node, count(*) AS score FROM v_ends GROUP BY ALL), k AS (SELECT *, CASE WHEN substr(node, 2)::INT % 2 = 0 THEN 'TEXT_BASED' ELSE 'INFERENCE_BASED' END AS source FROM deg)"


def _marked(spark, d) -> DataFrame:
    deg = G.by_degree(_edges(spark, d)).select("run_id", "node", c("degree").alias("score"))
    return deg.withColumn("source", F.when(F.substring("node", 2, 9).cast("int") % 2 == 0, "TEXT_BASED").otherwise("INFERENCE_BASED"))


@query(f"""{_MARKED}, g AS (SELECT run_id, node, count(*) AS n FROM v_ends WHERE active GROUP BY ALL), a AS (SELECT run_id, src AS node, dst AS near FROM v_edges WHERE active UNION SELECT run_id, dst, src FROM v_edges WHERE active),
d AS (SELECT run_id, node, count(*) AS d, max((substr(near, 2)::INT % 2 = 0)::INT) AS tied FROM a GROUP BY ALL), z AS (SELECT run_id, count(*) AS size FROM d GROUP BY 1)
SELECT k.run_id, k.node, CASE WHEN k.node = 'n1' THEN 'critical' ELSE round((3 * coalesce(n, 0) + CASE WHEN source = 'TEXT_BASED' THEN 5 ELSE 20 + 15 * coalesce(tied, 0) END + CASE WHEN n > 0 THEN 8 ELSE 0 END
+ CASE WHEN coalesce(size, 0) > 1 THEN 5 * coalesce(d, 0) / (size - 1) ELSE 0 END)::DOUBLE, 4)::DECIMAL(12, 4)::VARCHAR END AS score FROM k LEFT JOIN g USING (run_id, node) LEFT JOIN d USING (run_id, node) LEFT JOIN z ON z.run_id = k.run_id""")
def inferred_scores(spark, d):
    """WIN-13 with inferred and critical nodes."""
    e = _edges(spark, d)
    on = G.endpoints(e.where("active")).withColumn("active", F.lit(True))
    nodes = _marked(spark, d).join(on, ["run_id", "node"], "left").select("run_id", "node", "source", F.coalesce("active", F.lit(False)).alias("active"))
    scores = G.node_scores(nodes, e, nodes.where("node = 'n1'"))
    shown = F.when(c("score") == float("inf"), "critical").otherwise(F.round("score", 4).cast("decimal(12,4)").cast("string"))
    return scores.select("run_id", "node", shown.alias("score"))


@query(f"{_MARKED} SELECT run_id, node FROM k WHERE score <= 3 AND source = 'TEXT_BASED'")
def scored_nodes(spark, d):
    """GRA-7."""
    return G.by_score(_marked(spark, d), 3, text_only=True).select("run_id", "node")


@query(f"{_MARKED} SELECT run_id, node FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (source <> 'TEXT_BASED')::INT, score, node) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM k) WHERE i <= n - 5")
def removal_candidates(spark, d):
    """WIN-12."""
    return G.removal_candidates(_marked(spark, d), 5).select("run_id", "node")


@query(f"{_MARKED} SELECT run_id, md5(string_agg('- ' || node || ' (type: ' || source || ') (score: ' || score || ')', chr(10) ORDER BY score, node)) AS listing FROM k GROUP BY 1")
def node_listing(spark, d):
    """WIN-8."""
    return G.node_listing(_marked(spark, d).withColumnRenamed("source", "kind")).select("run_id", F.md5("nodes").alias("listing"))


@query(f"{_MARKED} SELECT run_id, node FROM k WHERE source = 'INFERENCE_BASED' AND (run_id, node) NOT IN (SELECT (run_id, src) FROM v_edges WHERE sentence_index < 3)")
def new_inferred(spark, d):
    """WIN-15."""
    before = _edges(spark, d).where("sentence_index < 3").select("run_id", c("src").alias("node")).distinct()
    return G.newly_inferred(_marked(spark, d), before).select("run_id", "node")


@query(f"""WITH {V.V_EDGES}, m AS (SELECT run_id, src AS node, CASE WHEN edge_id % 3 = 0 THEN 'The a ' || src ELSE src || '!' END AS t, edge_id FROM v_edges), n AS (SELECT run_id, node, t, count(*) AS n, min(edge_id) AS f FROM m GROUP BY ALL)
SELECT run_id, node, regexp_replace(arg_min(t, (-n, f, t)), '(?i)^((the|a|an)\\s+)+', '') AS text FROM n GROUP BY ALL""")
def representers(spark, d):
    """WIN-10."""
    text = F.when(c("edge_id") % 3 == 0, F.concat(F.lit("The a "), c("src"))).otherwise(F.concat(c("src"), F.lit("!")))
    return G.representers(_edges(spark, d).select("run_id", c("src").alias("node"), text.alias("text"), c("edge_id").alias("seen")))


_NEAR = "src AS (SELECT run_id, min(src) AS node FROM v_edges GROUP BY 1), d1 AS (SELECT v.run_id, v.near AS node FROM src JOIN v_both v USING (run_id, node)), d2 AS (SELECT v.run_id, v.near AS node FROM d1 JOIN v_both v USING (run_id, node)), hood AS (SELECT * FROM src UNION SELECT * FROM d1 UNION SELECT * FROM d2)"


@query(f"WITH {V.V_EDGES}, {_NEAR} SELECT edge_id FROM v_edges e WHERE EXISTS (SELECT 1 FROM hood h WHERE h.run_id = e.run_id AND h.node = e.src) AND EXISTS (SELECT 1 FROM hood h WHERE h.run_id = e.run_id AND h.node = e.dst)")
def edges_around(spark, d):
    """GRA-37."""
    e = _edges(spark, d)
    return G.around(e, e.groupBy("run_id").agg(F.min("src").alias("node"))).select("edge_id")


@query(f"WITH {V.V_EDGES}, {_NEAR} SELECT edge_id FROM v_edges e WHERE EXISTS (SELECT 1 FROM hood h WHERE h.run_id = e.run_id AND h.node = e.src) AND EXISTS (SELECT 1 FROM hood h WHERE h.run_id = e.run_id AND h.node = e.dst)")
def shown_triplets(spark, d):
    """STR-31."""
    e = _edges(spark, d)
    near = G.distances(e, e.groupBy("run_id").agg(F.min("src").alias("node")))
    t = e.select("run_id", c("src").alias("subject"), c("label").alias("relation"), c("dst").alias("object"), "edge_id")
    return G.shown_triplets(t, near).select("edge_id")


@query(f"WITH {V.V_EDGES}, s AS (SELECT DISTINCT run_id, sentence_index AS sentence, src AS node FROM v_edges), p AS (SELECT run_id, node, min(visibility) AS x FROM (SELECT run_id, src AS node, visibility FROM v_edges WHERE active) GROUP BY ALL) SELECT run_id, sentence, node, x, row_number() OVER (PARTITION BY run_id ORDER BY sentence DESC, node)::INT AS step FROM s JOIN p USING (run_id, node)")
def replayed(spark, d):
    """STR-32."""
    e = _edges(spark, d)
    seen = e.select("run_id", c("sentence_index").alias("sentence"), c("src").alias("node")).distinct()
    return G.replay(seen, e.where("active").groupBy("run_id", c("src").alias("node")).agg(F.min("visibility").alias("x")))


_SETS = "a AS (SELECT run_id, list(DISTINCT src) FILTER (sentence_index <= 3) AS x, list(DISTINCT src) FILTER (sentence_index >= 3) AS y FROM v_edges GROUP BY 1)"


@query(f"WITH {V.V_EDGES}, {_SETS}, b AS (SELECT run_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a) SELECT run_id, " + ", ".join(
    f"array_to_string(list_sort(list_filter({p}, lambda z: {n} list_contains({q}, z))), ',') AS {k}" for k, p, n, q in (("left_", "x", "NOT", "y"), ("came", "y", "NOT", "x"), ("stayed", "x", "", "y"))) + " FROM b")
def parted_nodes(spark, d):
    """SET-2, SET-4."""
    sets = _edges(spark, d).groupBy("run_id").agg(F.collect_set(F.when(c("sentence_index") <= 3, c("src"))).alias("x"), F.collect_set(F.when(c("sentence_index") >= 3, c("src"))).alias("y"))
    parts = G.parted_nodes(c("x"), c("y"))
    return sets.select("run_id", *[F.array_join(F.array_sort(p), ",").alias(k) for k, p in zip(("left_", "came", "stayed"), parts)])


_PAIR = "PARTITION BY run_id, least(src, dst), greatest(src, dst)"
_BENT = f"""k AS (SELECT *, row_number() OVER ({_PAIR} ORDER BY edge_id, src, label, sentence_index) - 1 AS k, count(*) OVER ({_PAIR}) AS n FROM v_edges),
bent AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN CASE WHEN k = 0 THEN 0.15 ELSE -0.15 END ELSE -least(0.35, 0.15 * (n - 1) / 2) + 2 * least(0.35, 0.15 * (n - 1) / 2) * k / (n - 1) END::DOUBLE * CASE WHEN src > dst THEN -1 ELSE 1 END AS curvature,
CASE WHEN n = 1 THEN 0.5 WHEN n = 2 THEN CASE WHEN k = 0 THEN 0.4 ELSE 0.6 END ELSE greatest(0.3, 0.5 - 0.15 * (n - 1) / 2) + (least(0.7, 0.5 + 0.15 * (n - 1) / 2) - greatest(0.3, 0.5 - 0.15 * (n - 1) / 2)) * k / (n - 1) END::DOUBLE AS t,
substr(src, 2)::DOUBLE AS x0, visibility::DOUBLE AS y0, substr(dst, 2)::DOUBLE AS x1, sentence_index::DOUBLE AS y1 FROM k), mid AS (SELECT *, (x0 + x1) / 2 - curvature * (y1 - y0) AS mx, (y0 + y1) / 2 + curvature * (x1 - x0) AS my FROM bent),
ang AS (SELECT *, degrees(atan2((1 - t) * (my - y0) + t * (y1 - my), (1 - t) * (mx - x0) + t * (x1 - mx))) AS angle FROM mid)"""


@query(f"""WITH {V.V_EDGES}, {_BENT} SELECT edge_id, round(curvature, 6) + 0 AS curvature, round((1 - t) * (1 - t) * x0 + 2 * (1 - t) * t * mx + t * t * x1, 6) AS x, round((1 - t) * (1 - t) * y0 + 2 * (1 - t) * t * my + t * t * y1, 6) AS y,
round(CASE WHEN x0 = x1 AND y0 = y1 THEN 0 WHEN angle > 90.0000001 THEN angle - 180 WHEN angle < -90.0000001 THEN angle + 180 ELSE angle END, 3) + 0 AS angle FROM ang WHERE NOT (x0 = x1 AND y0 = y1) AND abs(abs(angle) - 90) > 0.001""")
def edge_labels_placed(spark, d):
    """GRA-40, GRA-41, GRA-42; directions straight up or down, which rounding may turn either way, are left to tests."""
    x0, y0, x1, y1 = (F.expr(f"cast({x} as double)") for x in ("substring(src, 2)", "visibility", "substring(dst, 2)", "sentence_index"))
    e = G.curvatures(_edges(spark, d), F.struct("edge_id", "src", "label", "sentence_index"))
    x, y = G.bezier(x0, y0, x1, y1, c("curvature"), c("t"))
    angle = G.label_angle(x0, y0, x1, y1, c("curvature"), c("t"))
    rows = e.where(~((x0 == x1) & (y0 == y1))).withColumns({"_x": x, "_y": y, "_a": angle}).where(F.abs(F.abs("_a") - 90) > 0.001)
    plus = lambda x, n: F.round(x, n) + F.lit(0.0)  # noqa: E731  no zero below zero
    return rows.select("edge_id", plus("curvature", 6).alias("curvature"), r6("_x", "x"), r6("_y", "y"), plus("_a", 3).alias("angle"))


_REACHED = "reach AS (SELECT run_id, node, node AS seen FROM b2 UNION SELECT r.run_id, r.node, b.near FROM reach r JOIN b2 b ON r.run_id = b.run_id AND r.seen = b.node), cc AS (SELECT run_id, node, min(seen) AS component FROM reach GROUP BY ALL)"
_ALL_CC = f"RECURSIVE {V.V_EDGES}, b2 AS (SELECT * FROM v_both), {_REACHED}"
_LIVE_CC = f"RECURSIVE {V.V_EDGES}, b2 AS (SELECT DISTINCT run_id, src AS node, dst AS near FROM v_edges WHERE active UNION SELECT run_id, dst, src FROM v_edges WHERE active), {_REACHED}"


@query(f"""WITH {_LIVE_CC}, f AS (SELECT DISTINCT run_id, src AS node FROM v_edges WHERE sentence_index <= 2), h AS (SELECT cc.run_id, component, count(f.node) AS n FROM cc LEFT JOIN f USING (run_id, node) GROUP BY ALL)
SELECT run_id, component, n AS n_focus FROM h QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, component) = 1""")
def focus_components(spark, d):
    """GRA-15."""
    e = _edges(spark, d)
    return G.focus_component(e.where("active"), e.where("sentence_index <= 2").select("run_id", c("src").alias("node")))


@query(f"""WITH {_ALL_CC}, q AS (SELECT DISTINCT run_id, src AS node FROM v_edges WHERE sentence_index <= 2) SELECT run_id, count(DISTINCT component) <= 1 AS possible FROM q JOIN cc USING (run_id, node) GROUP BY 1""")
def connectable_runs(spark, d):
    """GRA-17."""
    e = _edges(spark, d)
    return G.can_connect(e, e.where("sentence_index <= 2").select("run_id", c("src").alias("node")))


@query(f"""WITH {V.V_EDGES}, live AS (SELECT DISTINCT run_id FROM v_edges WHERE active AND sentence_index > 5) SELECT edge_id, active AND sentence_index > 5 OR (visibility > 0 AND run_id NOT IN (SELECT run_id FROM live)) AS active FROM v_edges""")
def stabilized_edges(spark, d):
    """GRA-19."""
    e = _edges(spark, d).withColumn("active", c("active") & (c("sentence_index") > 5))
    return G.stabilized(e).select("edge_id", "active")


@query(f"""WITH {_LIVE_CC}, z AS (SELECT run_id, component, count(*) AS n FROM cc GROUP BY ALL), big AS (SELECT run_id, component FROM z QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, component) = 1),
deg AS (SELECT run_id, node, count(*) AS d FROM (SELECT run_id, src AS node FROM v_edges WHERE active UNION ALL SELECT run_id, dst FROM v_edges WHERE active) GROUP BY ALL),
anchor AS (SELECT cc.run_id, cc.node FROM cc JOIN big USING (run_id, component) JOIN deg USING (run_id, node) QUALIFY row_number() OVER (PARTITION BY cc.run_id ORDER BY d DESC, cc.node) = 1)
SELECT z.run_id, z.component AS src, anchor.node AS dst, 'label of ' || z.component AS label FROM z JOIN big ON big.run_id = z.run_id AND big.component <> z.component JOIN anchor ON anchor.run_id = z.run_id""")
def forced_edges(spark, d):
    """GRA-23, GRA-27, GRA-29: an edge from the backbone's part to every other part, with a label asked for."""
    return G.forced_edges(_edges(spark, d), lambda a, b: F.concat(F.lit("label of "), a)).select("run_id", "src", "dst", "label")


# -- statistics ------------------------------------------------------------------------------

_FIVE = ", ".join(f"round(quantile_cont(x, {q}), 6) AS {k}" for k, q in (("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1)))
_BOXES = {
    "tokens by regime": ("regime", "persona_num_tokens::DOUBLE", "persona_num_tokens", False), "age by regime": ("regime", "age_refined::DOUBLE", "age_refined", False),
    "triplets by age": ("age_refined", "num_triplets::DOUBLE", "num_triplets", False), "log triplets by age": ("age_refined", "log10(num_triplets + 1)", "num_triplets", True),
    "triplets by bin": ("bin", "num_triplets::DOUBLE", "num_triplets", False), "log concepts by bin": ("bin", "log10(num_unique_concepts + 1)", "num_unique_concepts", True),
}
_BINNED = "CASE WHEN age_refined <= 10 THEN '3–10' WHEN age_refined <= 14 THEN '11–14' ELSE '15–18' END"


@query(f"WITH {V.V_STATS}, b AS (SELECT *, {_BINNED} AS bin FROM v_stats) " + " UNION ALL ".join(
    f"SELECT '{k}' AS box, g AS grp, count(x) AS n, {_FIVE} FROM (SELECT ({g})::VARCHAR AS g, {x} AS x FROM b) WHERE g IS NOT NULL GROUP BY g" for k, (g, x, _, _) in _BOXES.items()))
def box_variants(spark, d):
    """AGG-26, AGG-28, AGG-29, AGG-31..34: the five numbers of metrics by regime, age and age bin, plain and on a log scale."""
    stats = S.kept(_stats(spark, d).withColumn("bin", T.coarse_age_bin(c("age_refined"))))
    out = None
    for k, (group, _, metric, log) in _BOXES.items():
        one = S.box_summary(stats, metric, group, log).select(F.lit(k).alias("box"), c(group).cast("string").alias("grp"), "n", *[r6(x, x) for x in ("low", "q1", "median", "q3", "high")])
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {V.V_STATS} SELECT regime, round(quantile_cont(num_triplets, 0.5)::DOUBLE, 6) AS median, true AS inside FROM v_stats GROUP BY 1")
def median_intervals(spark, d):
    """AGG-27, AGG-30: the median; its bootstrap interval, which hashes decide, holds it."""
    rows = S.median_interval(_stats(spark, d), "num_triplets", times=200)
    return rows.select("regime", r6("median", "median"), ((c("low") <= c("median")) & (c("median") <= c("high"))).alias("inside"))


@query(f"""WITH {V.V_EDGES}, e AS (SELECT run_id, CASE WHEN edge_id % 5 = 0 THEN '' ELSE src END AS src, dst FROM v_edges), b AS (SELECT DISTINCT run_id, src AS node, dst AS near FROM e UNION SELECT run_id, dst, src FROM e),
m AS (SELECT run_id, count(*) AS m FROM e GROUP BY 1), g AS (SELECT run_id, node, count(*) AS d FROM b GROUP BY ALL), n AS (SELECT run_id, count(*) AS n, avg(d) AS deg FROM g GROUP BY 1)
SELECT run_id, n AS graph_num_nodes, m AS graph_num_edges, round(deg, 6) AS graph_avg_degree FROM n JOIN m USING (run_id)""")
def graph_with_blanks(spark, d):
    """AGG-44."""
    e = _edges(spark, d).withColumn("src", F.when(c("edge_id") % 5 == 0, "").otherwise(c("src")))
    g = M.graph_metrics(e, "run_id", with_components=False, blanks=True)
    return g.select("run_id", "graph_num_nodes", "graph_num_edges", r6("graph_avg_degree", "graph_avg_degree"))


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 20")
def top_rows(spark, d):
    """WIN-17, WIN-18."""
    return R.top(V.table(spark, d, "events").where("value is not null").select("event_id", "value"), [F.desc("value"), c("event_id")], 20)


@query("SELECT p_partkey, p_brand || ' ' || 'a b ' || 'k: ' || p_size || ' ' || p_name AS text FROM part")
def fields_text(spark, d):
    """SRC-6."""
    rows = _part(spark, d).select("p_partkey", "p_brand", F.array(F.lit("a"), F.lit("b")).alias("xs"), F.create_map(F.lit("k"), c("p_size")).alias("m"), "p_name")
    kinds = [("p_partkey", "bigint"), ("p_brand", "string"), ("xs", "array<string>"), ("m", "map<string,int>"), ("p_name", "string")]
    return rows.select("p_partkey", K.fields_text(kinds).alias("text"))


@query("SELECT p_partkey, unnest([0, 1]) AS island, unnest([p_name || ' goes on', p_type]) AS paragraph FROM part")
def indented_paragraphs(spark, d):
    """SRC-10."""
    text = F.format_string("  %s\ngoes on\n\n<x>\n\t%s\n", "p_name", "p_type")
    got = R.indented_paragraphs(_part(spark, d).select("p_partkey", text.alias("text")), "p_partkey")
    return got.select("p_partkey", (c("island") - 1).cast("int").alias("island"), "paragraph")


@query("SELECT count(*) AS n FROM part WHERE p_partkey < 0")
def missing_columns(spark, d):
    """FIL-32: a table without a required column gives no rows, or is skipped."""
    rows = _part(spark, d)
    assert R.require(rows, {"no such"}, "skip") is None and R.require(rows, {"p_size"}, "raise") is rows
    return R.require(rows, {"no such"}, "empty").agg(F.count("*").alias("n"))


# -- files, in the shared folder ---------------------------------------------------------------

def _folder(spark) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def _as_files(rows: DataFrame, at: str, stem: str) -> None:
    """Writes CSV files of the name ``stem`` and a number."""
    rows.write.mode("append").option("header", True).csv(f"{at}/_{stem}")
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(f"{at}/_{stem}")
    fs = source.getFileSystem(conf)
    for i, status in enumerate(x for x in fs.listStatus(source) if x.getPath().getName().startswith("part-")):
        fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{at}/{stem}_{i}.csv"))
    fs.delete(source, True)


@query("SELECT p_partkey AS idx, p_name || ', \"' || p_type || '\"' || chr(10) || 'x' AS persona_text, CASE WHEN p_size % 3 <> 0 THEN p_size::DOUBLE END AS age, 'part' AS source_config FROM part")
def persona_files(spark, d):
    """SRC-1, SRC-5: quotes, commas and line ends in a field, an age that is no number, and ``persona`` for ``persona_text``."""
    rows, at = _part(spark, d), _folder(spark)
    text = F.concat(c("p_name"), F.lit(', "'), c("p_type"), F.lit('"\nx'))
    age = F.when(c("p_size") % 3 == 0, "unknown").otherwise(c("p_size").cast("string"))
    rows.select(c("p_partkey").alias("idx"), text.alias("persona"), age.alias("age")).write.option("header", True).option("escape", '"').csv(at)
    return files.tagged_union({"part": files.personas(spark, at)}).select("idx", "persona_text", "age", "source_config")


@query(f"""WITH {V.V_TRIPLETS} SELECT 'Alpha' AS model, 'primary' AS regime, count(*) AS n, count(relation) AS n_relations FROM v_triplets WHERE regime IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'Alpha', 'University', count(*), count(relation) FROM v_triplets WHERE regime NOT IN ('BUILDING', 'MACHINERY')""")
def triplet_files(spark, d):
    """SRC-2, SRC-3, SRC-4, SRC-11, SRC-12: files by the names of a model and a regime, others aside, merged into a table."""
    t, at, out = V.triplets(spark, d).drop("run_id", "active", "edge_id"), _folder(spark), _folder(spark)
    early = c("regime").isin("BUILDING", "MACHINERY")
    _as_files(t.where(early), at, "model_Alpha_final_triplets_primary")
    _as_files(t.where(~early), at, "model_Alpha_final_triplets_University")
    _as_files(t.where(early), at, "model_beta_final_triplets_primary")
    _as_files(t.where(early), at, "model_Alpha_draft_triplets_primary")
    rows = files.of_model(files.triplets(spark, f"{at}/*.csv"), "alpha")
    files.merge_chunks(rows.withColumn("source_file", F.replace("source_file", F.lit("_final"), F.lit(""))), out)
    merged = spark.read.parquet(out)
    return merged.groupBy("model", c("file_regime").alias("regime")).agg(F.count("*").alias("n"), F.count("relation").alias("n_relations")).select(
        "model", F.when(F.lower("regime") == "university", "University").otherwise(c("regime")).alias("regime"), "n", "n_relations"
    )


@query(f"WITH {V.V_STATS} SELECT persona_id, num_triplets, num_unique_concepts FROM v_stats")
def stats_of_files(spark, d):
    """AGG-37: statistics of triplet files, whose regime is the name's."""
    at = _folder(spark)
    _as_files(V.triplets(spark, d).drop("run_id", "active", "edge_id"), at, "model_m_triplets_primary")
    return files.persona_stats_of_files(spark, f"{at}/*.csv").select("persona_id", "num_triplets", "num_unique_concepts")


@query("SELECT p_partkey, p_name FROM part")
def appended_rows(spark, d):
    """SRC-16..20: batches that overlap, and one that is written again, leave each row once."""
    rows, at = _part(spark, d).select("p_partkey", "p_name", "p_size"), _folder(spark)
    sink = files.idempotent_sink(at, ["p_partkey"])
    first, second = rows.where("p_size <= 30").drop("p_size"), rows.where("p_size > 20").drop("p_size")
    for i, batch in enumerate((first, second, second)):
        sink(batch, i)
    return spark.read.parquet(at)


@query("SELECT 'clean' AS kind, count(*) AS n FROM part WHERE p_size < 10 UNION ALL SELECT 'removed', count(*) FROM part WHERE p_size >= 20 UNION ALL SELECT 'trimmed', count(*) FROM part WHERE p_size < 20")
def saved_outputs(spark, d):
    """SRC-14: the three tables of a run; a second run takes the place of the first."""
    rows, at = _part(spark, d), _folder(spark)
    for _ in range(2):
        files.save_outputs(rows.where("p_size < 20"), rows.where("p_size < 10"), rows.where("p_size >= 20"), at)
    out = [spark.read.parquet(f"{at}/{k}").agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("clean", "removed", "trimmed")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(r"""SELECT run_id, pos - 1 AS sentence_index, md5(s[pos]) AS text FROM (SELECT *, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT conv_id || '-' || turn AS run_id,
list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM conversations))""")
def story_sentences(spark, d):
    """SRC-8: stories split after the ends of sentences."""
    t = V.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("story_id"), "text")
    return sentences_of(t).select("run_id", c("sentence_index").cast("long").alias("sentence_index"), F.md5("text").alias("text"))


@query(f"SELECT p_partkey, CASE WHEN d < 60 THEN 'yes' WHEN d < 90 THEN 'no' ELSE 'uncertain' END AS llm_label, 100 - d // 2 AS llm_confidence FROM (SELECT *, {_draw_sql(100, _QUOTED)} AS d FROM ({_PERSONAS}))")
def judged_personas(spark, d):
    """UDF-15, UDF-16, with the stub."""
    p = _personas(spark, d).select("p_partkey", c("text").alias("persona_text"))
    return judged(p).select("p_partkey", "llm_label", "llm_confidence")


@query(f"SELECT p_partkey, (5 + {_draw_sql(14, _QUOTED)})::INT AS age_asked, (50 + {_draw_sql(50, _QUOTED, "'1'")})::INT AS age_confidence FROM ({_PERSONAS})")
def aged_personas(spark, d):
    """UDF-17, UDF-18, UDF-21, with the stub."""
    p = _personas(spark, d).select("p_partkey", c("text").alias("persona_text"))
    return aged(p).select("p_partkey", "age_asked", "age_confidence")
