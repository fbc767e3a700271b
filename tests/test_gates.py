from pyspark.sql import functions as F

from fabulagraph.functions import gates as Z
from fabulagraph.functions.tagger import RuleTagger, content_words, nouns, tokens


def _tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("k"))


def test_tokens_and_canonical(spark):
    k = _tokens(spark, "The young knight saw a dragon")
    got = k.select(content_words(F.col("k")).alias("a"), nouns(F.col("k")).alias("b"), Z.canonical_text(F.col("k")).alias("c"), Z.canonical_lemma(F.col("k"), True).alias("d"), Z.verbal_label(F.col("k")).alias("e"), Z.is_verbal(F.col("k")).alias("f")).first()
    assert (got.a, got.b, got.c, got.d, got.e, got.f) == (["young", "knight", "see", "dragon"], ["dragon", "knight"], "dragon", "knight", "see", True)
    empty = _tokens(spark, None).select(F.size("k").alias("n"), Z.canonical_text(F.col("k")).alias("c")).first()
    assert (empty.n, empty.c) == (0, None)
    assert RuleTagger()("...") == [] or all(t.pos == "PUNCT" for t in RuleTagger()("..."))


def test_gates(spark):
    a, t, none = F.array, F.lit, F.array().cast("array<string>")
    gate = lambda x, new=True: Z.node_gate(t(x), t("CONCEPT"), t("STORY_EXPLICIT"), t(new), a(t("walk"), t("knight")), a(t("hobby")))
    row = spark.range(1).select(
        *[gate(x).alias(f"g{i}") for i, x in enumerate(["", "a", "x1", "hobby", "walked", "moon", "knight"])], gate("moon", False).alias("old"),
        Z.attachable(t("a"), t("b"), none, a(t("c")), none, a(t("b"))).alias("at"), Z.attachable(t("a"), t("b"), none, a(t("c")), none, none).alias("no"),
        Z.clean_resolved(t("He ran."), t("The resolved sentence is: The knight ran.")).alias("clean"), Z.clean_resolved(t("He ran."), t('{"x": 1}')).alias("kept"),
        Z.vague(a(t(1.0), t(0.0)), [[0.9, 0.1]]).alias("vague"), Z.sequence_ratio(t("abcd"), t("bcde")).alias("ratio"), Z.similar_labels(t("Rides "), t("rides")).alias("same"),
    ).first()
    assert list(row)[:8] == ["empty_lemmas", "lemma_too_short", "invalid_characters", "persona_only_lemma", None, "not_story_grounded", None, None]
    assert (row["at"], row["no"], row.clean, row.kept, row.vague, row.ratio, row.same) == (True, False, "The knight ran.", "He ran.", True, 0.75, True)


def test_verdicts(spark):
    end = lambda lemma, pos: F.struct(F.lit(lemma).alias("lemma"), F.lit(pos).alias("pos"))
    cases = [("knight", "NOUN", "is", "brave", "ADJ", "accept"), ("brave", "ADJ", "is", "knight", "NOUN", "swap"), ("knight", "NOUN", "has", "brave", "ADJ", "reject"),
             ("knight", "NOUN", "not_related", "x", "NOUN", "reject"), ("knight", "NOUN", "rides", "brave", "ADJ", "add_copula"), ("knight", "NOUN", "is", "knight", "NOUN", "reject"),
             ("knight", "NOUN", "frees", "princess", "NOUN", "accept")]
    for s, sp, label, o, op, want in cases:
        assert spark.range(1).select(Z.relation_verdict(end(s, sp), F.lit(label), end(o, op))["action"]).first()[0] == want, (s, label, o)


def test_record_text(spark):
    row = spark.createDataFrame([("a", [1, 2], {"k": "v"}, 3)], "s string, l array<int>, m map<string,string>, n int")
    assert row.select(Z.fields_text(row.dtypes)).first()[0] == "a 1 2 k: v"
