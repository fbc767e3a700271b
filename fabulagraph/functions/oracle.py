"""The place of a language model: ``Oracle``; a model behind a client; a deterministic stub; a replay of stored answers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Oracle(Protocol):
    def ask(self, method: str, **given: Any) -> Any: ...


def prompt_hash(method: str, given: dict[str, Any]) -> str:
    return hashlib.sha1(json.dumps([method, given], sort_keys=True, default=str).encode()).hexdigest()


def _first(data: bytes) -> int:
    return int.from_bytes(hashlib.sha1(data).digest()[:4], "big")


def _firsts(texts: Iterable[bytes]) -> np.ndarray:
    """``_first`` of each."""
    sha1 = hashlib.sha1
    return np.frombuffer(b"".join([sha1(x).digest() for x in texts]), ">u4")[::5]


def _number(text: str) -> int:
    return _first(text.encode())


class StubOracle:
    """A pure function of what it is asked: batch, streaming and repeated runs agree.

    The text's part of what is hashed is written once a question, and draws of triplets under one text are kept until the next.
    """

    def __init__(self) -> None:
        self._text: Any = None
        self._tail, self._drawn = b"", {}

    def _draw(self, n: int, *parts: Any) -> int:
        return _number(repr(parts)) % n

    def _under(self, text: Any) -> bytes:
        """The end of the tuples that ``text`` closes, as ``repr`` writes them."""
        if text != self._text or not self._tail:
            self._text, self._tail, self._drawn = text, f", {text!r})".encode(), {}
        return self._tail

    def _triplets(self, triplets: list[str], text: Any) -> list[int]:
        """What is drawn of each triplet and the text, before the remainder is taken."""
        tail, drawn = self._under(text), self._drawn
        new = [t for t in triplets if t not in drawn]
        drawn.update(zip(new, _firsts(b"(%b%b" % (repr(t).encode(), tail) for t in new).tolist()))
        return [drawn[t] for t in triplets]

    def _pairs(self, pairs: list[tuple[str, str]], text: Any) -> np.ndarray:
        tail = self._under(text)
        firsts = {x: b"(%b, " % repr(x).encode() for x in {a for a, _ in pairs}}
        seconds = {x: repr(x).encode() + tail for x in {b for _, b in pairs}}
        return _firsts(firsts[a] + seconds[b] for a, b in pairs)

    def ask(self, method: str, **given: Any) -> Any:
        if method == "relationships":
            nodes = given["nodes"]
            return [(a, "relates_to", b) for a, b in zip(nodes, nodes[1:]) if self._draw(3, a, b) == 0]
        if method == "infer":
            nodes = given["nodes"]
            return {"concepts": [], "properties": [(n, "is", "notable") for n in nodes if self._draw(5, n, given["text"]) == 0]}
        if method == "scores":
            return {t: d % 4 for t, d in zip(given["triplets"], self._triplets(given["triplets"], given["text"]))}
        if method == "keep":
            n = 3 if given.get("aggressive") else 8
            return [t for t, d in zip(given["triplets"], self._triplets(given["triplets"], given["text"])) if d % n]
        if method == "label":
            return "relates_to"
        if method == "attach":
            pairs = given["pairs"]
            return [(pairs[i][0], "relates_to", pairs[i][1]) for i in np.flatnonzero(self._pairs(pairs, given["text"]) % 4 == 0).tolist()]
        if method == "relevant":
            return [i for i, d in enumerate(self._triplets(given["triplets"], given["text"])) if d % 3 == 0][:10]
        if method == "validate":
            return {"valid": True, "corrected": None}
        if method == "pronouns":
            return {}
        if method == "judge":
            d = self._draw(100, given["persona"])
            return {"label": "yes" if d < 60 else "no" if d < 90 else "uncertain", "confidence": 100 - d // 2, "reason": "stub"}
        if method == "age":
            return {"age": 5 + self._draw(14, given["persona"]), "confidence": 50 + self._draw(50, given["persona"], 1), "age_group": "unknown", "reason": "stub"}
        raise KeyError(method)


class ReplayOracle:
    """Answers stored by (method, hash of what was asked); others come from ``otherwise``."""

    def __init__(self, answers: dict[tuple[str, str], Any], otherwise: Oracle | None = None):
        self.answers, self.otherwise = answers, otherwise or StubOracle()

    def ask(self, method: str, **given: Any) -> Any:
        found = self.answers.get((method, prompt_hash(method, given)))
        return self.otherwise.ask(method, **given) if found is None else found


class Client(Protocol):
    """A model: one answer for each prompt, in their order (UDF-1, UDF-3)."""

    def generate(self, prompts: list[str], temperature: float) -> list[str]: ...


#: What is asked, what the answer should look like, and what stands for one that can't be read, by method (UDF-4..16).
ASKED: dict[str, tuple[str, str, Any]] = {
    "relationships": ("Which relations between these concepts does the sentence state or imply?", "a list of [subject, relation, object]", []),
    "infer": ("Which concepts and properties would a reader infer for these concepts?", '{"concepts": [[subject, relation, object]], "properties": [...]}', {"concepts": [], "properties": []}),
    "attach": ("For which of these pairs does the sentence suggest a relation?", "a list of [first, relation, second]", []),
    "scores": ("How much does each relation still matter after this sentence, from 0 (not) to 3 (much)?", '{"scores": {relation: number}}', None),
    "keep": ("Which of these relations does the story still need?", '{"to_keep": [relation]}', None),
    "label": ("Which relation joins these two concepts?", '{"label": relation}', ""),
    "relevant": ("Which of these numbered relations does the sentence bring back to mind?", "a list of numbers", []),
    "validate": ("Does this relation follow from the sentence?", '{"valid": true or false, "corrected": [subject, relation, object] or null}', {"valid": True, "corrected": None}),
    "pronouns": ("Whom or what do the pronouns of the sentence stand for?", "{pronoun: name}", {}),
    "judge": ("Is this persona one of the category?", '{"label": "yes", "no" or "uncertain", "confidence": 0 to 100, "reason": text}', {"label": "uncertain", "confidence": 0, "reason": "unparsable"}),
    "age": ("How old is this persona?", '{"age": number or null, "confidence": 0 to 100, "age_group": text}', {"age": None, "confidence": 0, "age_group": "unknown"}),
}
#: How freely a method's answers are drawn; others as a story is read.
TEMPERATURES = {"judge": 0.0, "age": 0.3, "label": 0.3}
TEMPERATURE = 0.8


def prompt(method: str, given: dict[str, Any]) -> str:
    """UDF-2: the question, who reads, what is given, and the form of the answer."""
    question, form, _ = ASKED[method]
    lines = [f"You read as this person: {given['persona']}"] if given.get("persona") and method not in ("judge", "age") else []
    lines += [question] + (["Be strict: keep only what the story can't do without."] if given.get("aggressive") else [])
    lines += [f"{name}: {json.dumps(value, ensure_ascii=False, default=str)}" for name, value in given.items() if name not in ("aggressive", "attempt") and not (name == "persona" and len(lines) > 1)]
    return "\n".join([*lines, f"Answer with JSON alone: {form}."])


def answer(method: str, text: str) -> Any:
    """The payload after the last ``final``, between its outer brackets; the method's default if there is none of its kind."""
    default = ASKED[method][2]
    tail = (text or "").rsplit("final", 1)[-1]
    wants_list = isinstance(default, list)
    first, last = ("[", "]") if wants_list else ("{", "}")
    a, b = tail.find(first), tail.rfind(last)
    try:
        found = json.loads(tail[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        found = None
    if wants_list:
        return [tuple(x) if isinstance(x, list) else x for x in found if not isinstance(x, list) or len(x) == 3] if isinstance(found, list) else default
    if not isinstance(found, dict):
        return default
    if method == "infer":
        return {k: [tuple(x) for x in found.get(k) or [] if isinstance(x, list) and len(x) == 3] for k in ("concepts", "properties")}
    if method in ("scores", "keep", "label"):
        return found.get({"scores": "scores", "keep": "to_keep", "label": "label"}[method], default)
    return {**default, **found}


class ModelOracle:
    """Asks a model's client, one prompt a question or many at once; what can't be read is the method's default."""

    def __init__(self, client: Client, batch: int = 32):
        self.client, self.batch = client, batch

    def ask(self, method: str, **given: Any) -> Any:
        found = self.ask_all(method, [given])[0]
        if found is None and method == "keep":
            return given["triplets"]  # no answer prunes nothing
        if found is None and method == "scores":
            raise ValueError("no scores")
        return found

    def ask_all(self, method: str, given: list[dict[str, Any]]) -> list[Any]:
        """UDF-16, UDF-18: answers in order, ``batch`` prompts at a time; a batch that fails gives defaults."""
        out: list[Any] = []
        for at in range(0, len(given), self.batch):
            some = [prompt(method, g) for g in given[at : at + self.batch]]
            texts = retried(lambda p=some: self.client.generate(p, TEMPERATURES.get(method, TEMPERATURE)), default=[""] * len(some))
            out += [answer(method, t) for t in texts]
        return out


def asked(model: Oracle, method: str, given: list[dict[str, Any]]) -> list[Any]:
    """Many questions at once where the oracle can, else one by one, each retried."""
    if hasattr(model, "ask_all"):
        return model.ask_all(method, given)
    return [retried(lambda g=g: model.ask(method, **g), default=ASKED[method][2]) for g in given]


def retried(ask: Callable[[], Any], times: int = 3, default: Any = None) -> Any:
    """UDF-19: up to ``times`` tries, then the default."""
    for _ in range(times):
        try:
            return ask()
        except Exception:  # noqa: BLE001  a model's answer may be anything
            continue
    return default


def judged(personas: DataFrame, oracle: Callable[[], Oracle] = StubOracle) -> DataFrame:
    """UDF-15, UDF-16: adds llm_label, llm_confidence and llm_reason, batch by batch."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in personas.schema) + ", llm_label string, llm_confidence bigint, llm_reason string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = oracle()
        for rows in batches:
            got = asked(model, "judge", [{"persona": t} for t in rows["persona_text"]])
            yield rows.assign(llm_label=[g["label"] for g in got], llm_confidence=[g["confidence"] for g in got], llm_reason=[g["reason"] for g in got])

    return personas.mapInPandas(run, schema)


def aged(personas: DataFrame, oracle: Callable[[], Oracle] = StubOracle) -> DataFrame:
    """UDF-17, UDF-18, UDF-21: asks for the ages of the rows given (those that no rule knows)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in personas.schema) + ", age_asked int, age_confidence int, age_group string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = oracle()
        for rows in batches:
            got = asked(model, "age", [{"persona": t} for t in rows["persona_text"]])
            yield rows.assign(age_asked=[g["age"] for g in got], age_confidence=[g["confidence"] for g in got], age_group=[g["age_group"] for g in got])

    return personas.mapInPandas(run, schema)
