"""Language identification by prediction by partial matching (PPM).

Each language has context trees over UTF-8 bytes, of orders 0 to ``ORDER``: how often each
byte followed each context in the training texts.  A byte's probability under a language is
its share after the longest context; where the byte is new there, an escape probability
(method C: distinct followers over followers plus distinct) leads to the next shorter
context, down to equal shares of 256 bytes.  Statistics are frozen after training, so the
code length of a byte depends on it and the three bytes before it alone, and the code length
of a text is an exact sum over all its bytes.

That sum runs over arrays: code lengths of every trained context and byte are tabulated for
all languages at once, byte strings are looked up by a hash with the key stored beside it,
and what is not found falls back to the escape cost plus the shorter context's table.

Fitting reads a bounded sample of rows: of each language, pairwise different texts in the order of
a hash, ``DOCS_PER_LANGUAGE`` at most and as many as have ``BYTES_PER_LANGUAGE`` bytes together;
texts of more than ``MOST_BYTES`` don't train, and others train whole.  Any number of languages is
modelled, ``LANGUAGES_PER_MODEL`` at a time.  Models are a few MB each and are broadcast, as many at once
as have ``MODEL_BYTES``; with more, the texts are read again for the rest.

Nulls and edges: a null text, or one without a letter, is ``und`` with score 0; rows with a
null lang, null text or null id don't train; without any training row all is ``und``; ties
go to the first language by code point; repeated rows are scored each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulagraph.llm.store import checkpoint, map_texts, sent, written

ORDER = 3
DOCS_PER_LANGUAGE = 400
BYTES_PER_LANGUAGE = 8 << 20
MOST_BYTES = 1 << 20
LANGUAGES_PER_MODEL = 16
MODEL_BYTES = 256 << 20
#: Bytes scored at once; a text may run over several chunks.
CHUNK = 1 << 20
UNKNOWN = "und"


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes up to each position from n - 1 on, as one integer."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for k in range(n):
        out = (out << np.uint32(8)) | data[k : len(data) - n + 1 + k]
    return out


class _Table:
    """Rows of floats by 32-bit key: open addressing, probed for all keys at once."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint32)
        self.at = np.full(size, -1, np.int32)
        self.rows, self.probes = rows, 1
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            chosen, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.at[chosen], self.keys[chosen] = put, keys[put]
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[first]] = False
            left, slot = left[stay], (slot[stay] + 1) & (size - 1)
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key has none."""
        slot = self._slot(keys)
        at = self.at[slot]
        found = np.where((at >= 0) & (self.keys[slot] == keys), at, -1)
        open_ = np.flatnonzero((found < 0) & (at >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.at) - 1)
            a = self.at[slot[open_]]
            hit = (a >= 0) & (self.keys[slot[open_]] == keys[open_])
            found[open_[hit]] = a[hit]
            open_ = open_[(a >= 0) & ~hit]
        return found


class Model:
    """Frozen context trees of some languages; ``texts``: language to training texts as bytes."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        n = len(self.languages)
        counts: list[list] = [[None] * n for _ in range(ORDER + 1)]
        for j, name in enumerate(self.languages):
            # a text starts with a zero context, as in scoring
            data = np.frombuffer(b"".join(bytes(ORDER) + t for t in texts[name]), np.uint8)
            starts = np.cumsum([0] + [len(t) + ORDER for t in texts[name]])[:-1]
            real = np.ones(len(data), bool)
            for k in range(ORDER):
                real[starts + k] = False
            for order in range(ORDER + 1):
                codes = _codes(data, order + 1)[real[order:]]
                keys, number = np.unique(codes, return_counts=True)
                counts[order][j] = (keys, number)
        # costs in bits, from the shortest contexts up
        flat = np.full((256, n), 8.0)
        base = np.empty((256, n))
        for j in range(n):
            keys, number = counts[0][j]
            total, distinct = number.sum(), len(keys)
            base[:, j] = flat[:, j] - np.log2(max(distinct, 1) / (total + distinct)) if distinct else 8.0
            base[keys, j] = -np.log2(number / (total + distinct))
        self.escapes: list[_Table] = []
        self.costs: list[_Table] = []
        self.base = base.astype(np.float32)
        for order in range(1, ORDER + 1):
            contexts = np.unique(np.concatenate([k >> np.uint32(8) for k, _ in counts[order]] or [np.zeros(0, np.uint32)]))
            escape = np.zeros((len(contexts), n))
            all_keys = np.unique(np.concatenate([k for k, _ in counts[order]] or [np.zeros(0, np.uint32)]))
            cost = self._back(all_keys, order)
            for j in range(n):
                keys, number = counts[order][j]
                own, place = np.unique(keys >> np.uint32(8), return_inverse=True)
                total, distinct = np.bincount(place, number, len(own)), np.bincount(place, minlength=len(own))
                at = np.searchsorted(contexts, own)
                escape[at, j] = -np.log2(distinct / (total + distinct))
                context_at = np.searchsorted(contexts, all_keys >> np.uint32(8))
                cost[:, j] += escape[context_at, j]
                cost[np.searchsorted(all_keys, keys), j] = -np.log2(number / (total + distinct)[place])
            self.escapes.append(_Table(contexts, escape.astype(np.float32)))
            self.costs.append(_Table(all_keys, cost.astype(np.float32)))

    def _back(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Costs of the last bytes of ``keys`` under contexts one shorter than ``order``."""
        return self._cost(keys & np.uint32((1 << (8 * order)) - 1), order - 1).astype(np.float64)

    def _cost(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return self.base[keys]
        table = self.costs[order - 1]
        at = table.find(keys)
        out = table.rows[at]
        if len(lost := np.flatnonzero(at < 0)):
            escape = self.escapes[order - 1]
            e = escape.find(keys[lost] >> np.uint32(8))
            step = np.where(e[:, None] >= 0, escape.rows[e], np.float32(0))
            out[lost] = step + self._cost(keys[lost] & np.uint32((1 << (8 * order)) - 1), order - 1)
        return out

    def nbytes(self) -> int:
        return sum(t.keys.nbytes + t.at.nbytes + t.rows.nbytes for t in self.costs + self.escapes)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        group: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            group.append(i)
            held += len(t)
            if held >= CHUNK:
                self._add(texts, group, out)
                group, held = [], 0
        self._add(texts, group, out)
        return out

    def _add(self, texts: list[bytes], group: list[int], out: np.ndarray) -> None:
        if not group:
            return
        data = np.frombuffer(b"".join(bytes(ORDER) + texts[i] for i in group), np.uint8)
        ends = np.cumsum([len(texts[i]) + ORDER for i in group])
        for lo in range(0, len(data) - ORDER, CHUNK):
            hi = min(lo + CHUNK, len(data) - ORDER)
            cost = self._cost(_codes(data[lo : hi + ORDER], ORDER + 1), ORDER)  # of bytes lo + ORDER to hi + ORDER
            bounds = np.concatenate([[0], ends])
            first, last = np.searchsorted(ends, lo + ORDER, "right"), np.searchsorted(bounds, hi + ORDER, "left")
            a = np.clip(bounds[first:last] + ORDER, lo + ORDER, hi + ORDER) - lo - ORDER
            b = np.clip(ends[first:last], lo + ORDER, hi + ORDER) - lo - ORDER
            sums = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
            got = np.where((b > a)[:, None], sums[b] - sums[np.minimum(a, b)], 0)
            for g, row in zip(range(first, last), got):
                out[group[g]] += row


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder


def lowest(keys: DataFrame, group: str, by: Column, most: int) -> DataFrame:
    """Of each ``group``, the ``most`` rows that are least by the hash column ``by``, with ``rank``.

    Groups are counted first, and only rows whose hash is low for the size of their group are
    ranked, a few times ``most`` a group: a hot group isn't sorted as a whole.
    """
    c = F.col
    keys = checkpoint(keys)
    sizes = sent(keys.groupBy(c(group).alias("_g")).agg(F.count("*").alias("_n")))
    share = F.lit(4.0 * most + 64) / c("_n")
    low = keys.join(sizes, c(group) == c("_g")).where(F.pmod(by, F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.pmod(by, F.lit(1 << 30)), by))
    return low.drop("_g", "_n").withColumn("rank", rank).where(c("rank") <= most)


def training_rows(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of the sample.  Hashes are deduplicated and ranked; texts are fetched for the chosen ids alone."""
    c = F.col
    rows = docs.where(c("lang").isNotNull() & c("text").isNotNull() & c("doc_id").isNotNull() & (F.octet_length("text") <= MOST_BYTES))
    keys = rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.min(F.octet_length("text")).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = lowest(keys, "lang", c("h"), docs_per_language).withColumn("upto", upto).where(c("upto") <= BYTES_PER_LANGUAGE)
    return (
        rows.join(sent(chosen.select("lang", "h", "doc_id")), ["lang", "doc_id"])
        .where(F.xxhash64("text") == c("h"))
        .select("lang", F.encode("text", "UTF-8").alias("text"))
        .dropDuplicates(["lang", "text"])
    )


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> list[Model]:
    """Models of the rows of ``docs`` (doc_id, text, lang), all of which may train."""
    rows = checkpoint(training_rows(docs, docs_per_language))
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    models = []
    for at in range(0, len(names), LANGUAGES_PER_MODEL):
        some = names[at : at + LANGUAGES_PER_MODEL]
        texts: dict[str, list[bytes]] = {}
        for lang, text in sorted((r[0], bytes(r[1])) for r in rows.where(F.col("lang").isin(some)).collect()):
            texts.setdefault(lang, []).append(text)
        models.append(Model(texts))
    return models


def _passes(models: list[Model]) -> list[list[Model]]:
    """Models that are broadcast together."""
    out: list[list[Model]] = [[]]
    held = 0
    for m in models:
        if out[-1] and held + m.nbytes() > MODEL_BYTES:
            out.append([])
            held = 0
        out[-1].append(m)
        held += m.nbytes()
    return out


def predict(docs: DataFrame, models: list[Model]) -> DataFrame:
    """Adds lang_pred and score: the best language's posterior, with the code lengths a byte
    tempered by the square root of the length."""
    # code length of the best language so far, and the sum of all powers relative to it
    rows = docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("inf")).alias("_code_bits"), F.lit(0.0).alias("_code_sum"))
    passes = _passes(models)
    for k, some in enumerate(passes):
        rows = _scored(rows if k == 0 else written(rows), some)
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(1 / F.col("_code_sum"))
    return rows.select(*docs.columns, "lang_pred", score.alias("score"))


def _scored(rows: DataFrame, models: list[Model]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        languages = [x for m in models for x in m.languages]
        for batch in batches:
            texts = batch.column("text")
            some = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, least, total = (batch.column(k).to_pylist() for k in ("lang_pred", "_code_bits", "_code_sum"))
            which = np.flatnonzero(some & bool(languages))
            if len(which):
                data = texts.take(pa.array(which)).cast(pa.binary()).to_pylist()
                bits = np.concatenate([m.bits(data) for m in models], axis=1)
                root = np.sqrt(np.maximum(1, [len(d) for d in data]))
                best = bits.argmin(axis=1)
                low = bits.min(axis=1)
                sums = np.exp2(-(bits - low[:, None]) / root[:, None]).sum(axis=1)
                for i, name, b, s, r in zip(which, best, low, sums, root):
                    if least[i] <= b:  # an earlier pass has found a better one
                        total[i] += s * 2.0 ** ((least[i] - b) / r)
                    else:
                        total[i] = s + (total[i] * 2.0 ** ((b - least[i]) / r) if total[i] else 0.0)
                        names[i], least[i] = languages[name], float(b)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-3], pa.array(names, pa.string()), pa.array(least, pa.float64()), pa.array(total, pa.float64())],
                names=batch.schema.names,
            )

    return map_texts(rows, run, rows.schema)


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns; rows whose crc32(doc_id) leaves 1 by 3 don't train."""
    rows = docs.select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    models = fit(rows.where(~out))
    return predict(rows.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text"), models).drop("text")
