from pyspark.sql import functions as F

from fabulagraph.functions import text as T
from fabulagraph.operators import stats as S


def _one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first().asDict()


def test_ages(spark):
    t = F.lit
    got = _one(
        spark, a=T.age_by_cascade(t("A 16-year-old fan")), b=T.age_by_cascade(t("a university student")), c=T.age_by_phrase(t("a schoolchild")),
        d=T.age_by_phrase(t("no hint")), e=T.final_age(t("x"), t(19), t("unknown")), f=T.final_age(t("x"), t(None).cast("int"), t(" Primary_School_Child")),
        g=T.age_regime(t(17)), h=T.age_bin(t(14)), i=T.coarse_age_bin(t(14.9)), j=T.drp_grade(t(43)), k=T.age_by_phrase(t(None).cast("string")),
    )
    assert got == {"a": 16, "b": 19, "c": 5, "d": None, "e": None, "f": 9, "g": "high_school", "h": None, "i": "11–14", "j": "Grades K–1", "k": None}


def test_labels(spark):
    t = F.lit
    got = _one(
        spark, a=T.edge_label(t("is_type_of (edge)")), b=T.edge_label(t("hurries after")), c=T.edge_label(t("rides_on")), d=T.clean_label(t("nsubj:runnn")),
        e=T.clean_label(t("brr hm goes!!")), f=T.is_negation(t("not_related")), g=T.is_negation(t("knot")), h=T.relation_class(t(" Is_A ")),
    )
    assert got == {"a": "is", "b": "hurries_after", "c": "rides on", "d": "run", "e": "hm goes", "f": True, "g": False, "h": "taxonomic"}


def test_repair(spark):
    rows = spark.createDataFrame([("user", "likes", "dog"), ("user", "", "system"), ("cat", "<s>", None)], "s string, r string, o string")
    got = [tuple(x[0]) for x in rows.select(T.repaired(F.col("s"), F.col("r"), F.col("o"))).collect()]
    assert got == [("dog", "likes", "dog"), ("UNKNOWN", "related_to", "UNKNOWN"), ("cat", "related_to", "nan")]


def test_names_and_payloads(spark):
    t = F.lit
    model, regime = T.model_and_regime(t("model_qwen3-30b_triplets_Primary_3.csv"))
    got = _one(
        spark, a=model, b=regime, c=T.safe_tag(t("Qwen/Qwen3 30b-a3b")), d=T.model_family(t("Phi4")), e=T.safe_file_part(t('a/b: "c"')), f=T.safe_file_part(t("  ")),
        g=T.payload(t('text {"k": 3} more'), "struct<k:int>")["k"], h=T.payload(t("none"), "struct<k:int>")["k"], i=F.size(T.payload_list(t("x [[\"a\",\"b\",\"c\"]]"))),
        j=T.clock(t(3725)), k=T.decay_score(t("9")), m=T.decay_score(t("x")), n=T.title_line(t("<b>one  two</b> three"), 10), o=T.snippet(t(" a b  c d e f ")),
    )
    assert got == {"a": "qwen3-30b", "b": "primary", "c": "Qwen-Qwen3_30b-A3B", "d": "phi-4", "e": "a_b___c_", "f": "unknown", "g": 3, "h": None, "i": 1,
                   "j": "01:02:05", "k": 3, "m": 2, "n": "one two...", "o": "a b c d e"}


def test_relations_between_words(spark):
    t = F.lit
    got = _one(spark, a=T.swapped_ends(t("active"), t("actity")), b=T.derived_lemmas(t("jump"), t("jumping")), c=T.similar_strings(t("cat"), t("bat")), d=T.cosine(F.array(t(1.0), t(0.0)), F.array(t(0.0), t(0.0))))
    assert got == {"a": True, "b": True, "c": True, "d": 0.0}


def test_p_values():
    assert abs(S._gamma_tail(1, 5.991 / 2) - 0.05) < 1e-4  # chi-squared, 2 degrees
    assert abs(S._gamma_tail(2.5, 11.07 / 2) - 0.05) < 1e-4  # 5 degrees
    t, k = 2.228, 10  # Student's t, 10 degrees
    assert abs(S._beta(k / 2, 0.5, k / (k + t * t)) - 0.05) < 1e-4
