"""A rule tagger and what is read from its tokens (NLP-2..4, NLP-7..11, SCA-26..31).

Tokens are (text, lemma, pos).  ``Tagger`` is the interface; ``RuleTagger`` decides by
closed-class lists and endings, the same on every executor.  A model-backed tagger can take
its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = "array<struct<text:string,lemma:string,pos:string>>"

_CLOSED = {
    "DET": "a an the this that these those its his her their my your our some any each every".split(),
    "ADP": "in on at by for with from to of into over under through after before during about against between".split(),
    "PRON": "i you he she it we they him them us who which himself herself itself themselves".split(),
    "AUX": "is are was were be been being am has have had do does did will would can could may might shall should must".split(),
    "CCONJ": "and or but nor so yet".split(),
    "PART": "not no never".split(),
    "ADV": "very soon suddenly completely then there here now again always often last".split(),
}
_POS = {w: p for p, ws in _CLOSED.items() for w in ws}
#: Common irregular forms, each with its lemma.
_LEMMAS = dict(
    pair.split(":") for pair in (
        "is:be are:be was:be were:be been:be being:be am:be has:have had:have does:do did:do done:do went:go gone:go came:come saw:see seen:see "
        "said:say made:make took:take taken:take found:find gave:give given:give thought:think knew:know known:know rode:ride ridden:ride fought:fight "
        "freed:free ran:run began:begin begun:begin brought:bring bought:buy built:build caught:catch chose:choose chosen:choose drew:draw drank:drink drove:drive "
        "ate:eat eaten:eat fell:fall fallen:fall felt:feel flew:fly forgot:forget got:get grew:grow grown:grow heard:hear held:hold hid:hide hidden:hide kept:keep "
        "led:lead left:leave lent:lend lost:lose meant:mean met:meet paid:pay rose:rise sang:sing sat:sit sent:send shook:shake shone:shine slept:sleep sold:sell "
        "spoke:speak spoken:speak spent:spend stood:stand stole:steal stolen:steal swam:swim taught:teach told:tell threw:throw understood:understand woke:wake "
        "won:win wore:wear wrote:write written:write broke:break broken:break men:man women:woman children:child feet:foot teeth:tooth mice:mouse geese:goose "
        "people:person knights:knight wives:wife lives:life knives:knife leaves:leaf wolves:wolf"
    ).split()
)
_VERBS = frozenset(
    (
        "ride appear want fight kill free marry hurry go come see say make take find give think know like love run walk talk look use work call try ask need feel become "
        "leave put mean keep let begin seem help show hear play move live believe bring happen write sit stand lose pay meet include continue set learn change lead "
        "understand watch follow stop create speak read spend grow open win teach offer remember consider buy serve die send build stay fall cut reach remain suggest "
        "raise pass sell require report decide pull carry break thank receive join sing throw catch choose draw drink drive eat fly forget get hide hold sleep steal "
        "swim tell wake wear answer arrive climb cook cry dance dream fear hate hope jump laugh listen promise save search share smile study travel visit wait wash wish"
    ).split()
) | {w for w, lemma in _LEMMAS.items() if w not in _POS and lemma not in "man woman child foot tooth mouse goose person knight wife life knife leaf wolf".split()}
_ADJECTIVES = frozenset(
    (
        "young old big small good bad beautiful unfamiliar thankful happy sad great new red black white long short other first own same high low large little different "
        "important early hard easy strong weak true false open late full empty special clear certain free sure whole real best better only single poor rich warm cold hot "
        "wild dark light deep wide narrow quick slow loud quiet soft rough smooth sweet bitter sour clean dirty dry wet brave afraid angry calm proud shy kind cruel wise "
        "clever smart stupid honest gentle lazy tired hungry thirsty sick healthy safe dangerous blue green yellow brown grey gray pink purple golden silver wooden tall "
        "thin thick heavy round square flat straight sharp ancient modern common rare famous local foreign distant near far gifted curious"
    ).split()
)
STOP = frozenset(w for ws in _CLOSED.values() for w in ws)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?]")


class Token(NamedTuple):
    text: str
    lemma: str
    pos: str


class Tagger(Protocol):
    def __call__(self, sentence: str) -> list[Token]: ...


def _lemma(word: str, pos: str) -> str:
    if word in _LEMMAS:
        return _LEMMAS[word]
    if pos == "VERB":
        for end, to in (("ied", "y"), ("ies", "y"), ("ing", ""), ("ed", ""), ("s", "")):
            if word.endswith(end) and len(word) - len(end) >= 2:
                stem = word[: -len(end)] + to
                return stem[:-1] if len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "ls" else stem
    if pos == "NOUN":
        for end, to in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("s", "")):
            if word.endswith(end) and not word.endswith("ss") and len(word) - len(end) >= 2:
                return word[: -len(end)] + to
    return word


class RuleTagger:
    def __call__(self, sentence: str) -> list[Token]:
        out: list[Token] = []
        for m in _WORD.finditer(sentence or ""):
            w = m[0].lower().removesuffix("'s").removesuffix("’s")
            before = out[-1].pos if out else ""
            if not w[0].isalpha():
                pos = "PUNCT"
            elif w in _POS:
                pos = _POS[w]
            elif w in _VERBS:
                pos = "VERB"
            elif w in _ADJECTIVES or (w.endswith(("ful", "ous", "ive", "ic", "ish", "able", "less")) and len(w) > 4):
                pos = "ADJ"
            elif w.endswith("ly"):
                pos = "ADV"
            elif w.endswith(("ed", "ing")) and before != "DET":
                pos = "VERB"
            elif before == "PRON" or (before == "AUX" and w.endswith("n")):
                pos = "VERB"
            else:
                pos = "PROPN" if m[0][0].isupper() and out and before != "PUNCT" else "NOUN"
            out.append(Token(m[0], _lemma(w, pos), pos))
        return out


def tokens(text: Column, tagger: type = RuleTagger) -> Column:
    """Tagged tokens of a column of sentences, in Arrow batches."""

    @F.pandas_udf(TOKENS)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tagger()
        for texts in batches:
            yield texts.map(lambda x: [w._asdict() for w in t(x or "")])

    return tag(text)


def content_words(toks: Column) -> Column:
    """NLP-2: lemmas of content words, in order, each once."""
    kept = F.filter(toks, lambda t: t["pos"].isin("NOUN", "PROPN", "ADJ", "VERB") & ~t["lemma"].isin(*sorted(STOP)))
    return F.array_distinct(F.transform(kept, lambda t: t["lemma"]))


def nouns(toks: Column, least: int = 2) -> Column:
    """NLP-9: sorted distinct nouns."""
    kept = F.filter(toks, lambda t: t["pos"].isin("NOUN", "PROPN") & (F.length(t["lemma"]) >= least))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda t: t["lemma"])))


def node_type(pos: Column) -> Column:
    """SCA-30."""
    return F.when(pos.isin("NOUN", "PROPN"), "CONCEPT").when(pos == "ADJ", "PROPERTY")


def relations(toks: list[Token]) -> list[tuple[str, str, str, bool]]:
    """NLP-3, NLP-4: (subject, relation, object, object is a property) by order of words.

    Adjectives before a noun and after a form of *be* are properties; subject, verb and next
    noun are a relation; a preposition between verb and noun joins the verb's name.
    """
    out: list[tuple[str, str, str, bool]] = []
    subject = verb = None
    link: list[str] = []
    copula = False
    waiting: list[str] = []
    for t in toks:
        if t.pos == "PUNCT":
            subject, verb, link, copula, waiting = None, None, [], False, []
        elif t.pos == "ADJ":
            if copula and subject:
                out.append((subject, "is", t.lemma, True))
            waiting.append(t.lemma)
        elif t.pos in ("NOUN", "PROPN"):
            out += [(t.lemma, "is", a, True) for a in waiting if not copula]
            if subject and verb and subject != t.lemma:
                out.append((subject, "_".join([verb, *link]), t.lemma, False))
                link = []
            elif subject and copula and link and subject != t.lemma:
                out.append((subject, "is_" + link[-1], t.lemma, False))
            elif subject is None or not (verb or copula):
                subject = t.lemma
            waiting = []
        elif t.pos == "VERB":
            verb, link, copula = t.lemma, [], False
        elif t.pos == "AUX" and t.lemma == "be":
            copula = True
        elif t.pos == "ADP" and (verb or copula):
            link = [t.lemma]
    return list(dict.fromkeys(out))
