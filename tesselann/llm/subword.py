"""Supervised subword embeddings: a text is the average of hashed word and character n-gram vectors, classified by a
softmax over two classes; vectors and softmax are learned together by stochastic gradient descent in numpy.

A text's bag is counted once, where the text is; training sees bags alone, so that texts of any length can teach, and no
step needs more than the buckets that its texts touch. As the softmax is linear in the average, scoring needs one learned
number a bucket: the difference of the class scores. A score depends on its own text alone.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow, columns, numbered

ODD = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES = np.arange(256)
BLANK = (CODES == 32) | ((CODES >= 9) & (CODES <= 13))
#: Other than letters, digits and bytes of characters outside ASCII.
MARKS = ~((CODES >= 128) | ((CODES >= 48) & (CODES <= 57)) | ((CODES >= 65) & (CODES <= 90)) | ((CODES >= 97) & (CODES <= 122)))
#: The hash of the word that stands for a repeated one.
AGAIN = np.uint64(0x5DEECE66D1234567)
#: Bytes that one pass of the kernels takes; a longer text goes through in several, cut between words.
BLOCK = 1 << 18


@dataclass
class Subword:
    """``lower``: fold A-Z; ``marks``: words end at any mark, not at white space only; ``balance``: the power to which
    positive texts weigh more where they are fewer; ``common``: the share of the texts in which an n-gram has to stand to
    be learned; ``shrink``: the length that each pass takes off every vector, so that only those stay that many texts
    teach; ``start``: the range of the first vectors; ``damp``: gradients below this hardly move a vector."""

    lower: bool
    marks: bool
    balance: float = 1.0
    common: float = 0.01
    shrink: float = 0.1
    start: float = 0.01
    damp: float = 1e-2
    bits: int = 17
    dims: int = 8
    orders: tuple[int, ...] = (4, 5, 6)
    vectors: np.ndarray = field(default=None, repr=False)
    classes: np.ndarray = field(default=None, repr=False)
    bias: np.ndarray = field(default=None, repr=False)
    weights: tuple[np.ndarray, float] = field(default=None, repr=False)

    def grams(self, raw: bytes, ends: np.ndarray | None = None, before: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64 | None]:
        """Buckets of all words and n-grams, the word of each, the byte at which each word begins, and the last word's
        hash. An n-gram may have the blank before or after its word, and none inside. ``ends`` are the ends of the texts
        that ``raw`` is made of; ``before`` is the hash of the word that came before ``raw`` in its text."""
        b = np.frombuffer(b" " + raw + b" ", np.uint8)
        sep = (MARKS if self.marks else BLANK)[b]
        b = np.where(sep, np.uint8(32), LOWER[b] if self.lower else b)
        begins = np.nonzero(sep[:-1] & ~sep[1:])[0] + 1
        if not len(begins):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), begins, before
        word = np.cumsum(sep[:-1] & ~sep[1:]) - 1
        word = np.concatenate([[0], word])
        wide, marks = b.astype(np.uint64), np.cumsum(sep)
        shift = np.uint64(64 - self.bits)
        # a word's bytes weighed by their place
        place = np.arange(len(b)) - begins[np.maximum(word, 0)]
        powers = ODD ** np.arange(64, dtype=np.uint64)
        weighed = np.where(sep, np.uint64(0), (wide + np.uint64(1)) * powers[np.clip(place, 0, len(powers) - 1)])
        whole = np.add.reduceat(weighed, begins) * ODD
        ids, owner = [((whole ^ (whole >> np.uint64(32))) * ODD) >> shift], [np.arange(len(begins))]
        # a word that repeats the one before it in its text is also the word "again", as often as it has n-grams
        same = np.concatenate([[before is not None and whole[0] == before], whole[1:] == whole[:-1]])
        if ends is not None:
            text = np.searchsorted(ends, begins - 1, "right")
            same[1:] &= text[1:] == text[:-1]
        again = np.repeat(np.nonzero(same)[0], len(self.orders) + 1)
        ids.append(np.full(len(again), AGAIN, np.uint64) >> shift)
        owner.append(again)
        code = wide[:-1] | wide[1:] << np.uint64(8)
        for n in range(3, min(max(self.orders), len(b)) + 1):
            code = code[: len(b) - n + 1] | wide[n - 1 :] << np.uint64(8 * (n - 1))
            if n in self.orders:
                at = np.nonzero(marks[n - 2 : len(b) - 1] == marks[: len(b) - n + 1])[0]
                ids.append((code[at] + np.uint64(n)) * ODD >> shift)
                owner.append(word[at + 1])
        return np.concatenate(ids).astype(np.int64), np.concatenate(owner), begins - 1, whole[-1]

    def parts(self, raw: bytes) -> Iterator[np.ndarray]:
        """The buckets of one text, block by block. Blocks end between words, so that they change nothing."""
        at, before, blank = 0, None, MARKS if self.marks else BLANK
        while at < len(raw):
            end = min(len(raw), at + BLOCK)
            while end < len(raw) and not blank[raw[end]]:
                end += 1
            ids, _, _, before = self.grams(raw[at:end], before=before)
            yield ids
            at = end

    def bag(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of a text and how often each occurs; at most 2 ** bits, however long the text."""
        found = [np.unique(x, return_counts=True) for x in self.parts((text or "").encode())]
        if len(found) < 2:
            ids, n = found[0] if found else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        else:
            total = np.zeros(1 << self.bits, np.int64)
            for ids, n in found:
                total[ids] += n
            ids, n = np.nonzero(total)[0], total[total > 0]
        return ids.astype(np.int32), n.astype(np.int32)

    def fit(self, bags: Collection[tuple[np.ndarray, np.ndarray]], labels: list[int], passes: int = 4, finish: int = 40, rate: float = 0.5, seed: int = 0, batch: int = 1 << 15) -> Subword:
        """Learned from bags; a bucket that fewer than the share ``common`` of them hold has the zero vector. After ``passes``
        that take ``shrink`` off all vectors, those left learn on for ``finish`` more, by themselves. Bags are gone through twice, and need not be held."""
        rng = np.random.default_rng(seed)
        size, texts = 1 << self.bits, np.zeros(1 << self.bits, np.int64)
        for own, _ in bags:
            texts[own] += 1
        common = texts >= max(1, self.common * len(bags))
        self.vectors = (rng.uniform(-self.start, self.start, (size, self.dims)) * common[:, None]).astype(np.float32)
        ids, share = np.empty(texts[common].sum(), np.int32), np.empty(texts[common].sum(), np.float32)
        many, at = np.zeros(len(bags), np.int64), 0
        for k, (own, n) in enumerate(bags):
            keep = common[own]
            many[k] = keep.sum()
            ids[at : at + many[k]], share[at : at + many[k]] = own[keep], n[keep] / max(1, n.sum())
            at += many[k]
        self.classes, self.bias = np.zeros((2, self.dims), np.float32), np.zeros(2, np.float32)
        self.classes[1] = rng.normal(0, 0.5, self.dims)
        self.classes[0] = -self.classes[1]
        seen = [np.full((size, self.dims), self.damp**2, np.float32), np.full((2, self.dims), 1e-8, np.float32), np.full(2, 1e-8, np.float32)]
        y = np.array(labels, np.int64)
        weight = np.array([1.0, (np.bincount(y, minlength=2)[0] / max(1, y.sum())) ** self.balance])
        for turn in range(passes):
            self._pass(ids, share, many, y, weight, seen, rate * (1 - turn / passes), rng, batch)
            # what little a vector learned by chance is taken back
            norm = np.sqrt((self.vectors * self.vectors).sum(1, keepdims=True))
            self.vectors *= np.maximum(0, 1 - self.shrink / np.maximum(norm, 1e-9))
        if self.shrink:
            # the n-grams that are left learn on by themselves, with nothing taken back
            left = self.vectors.any(1)[ids]
            ends = np.cumsum(many)
            ids, share, many = ids[left], share[left], np.array([left[b - n : b].sum() for b, n in zip(ends, many, strict=True)], np.int64)
            for turn in range(finish):
                self._pass(ids, share, many, y, weight, seen, rate * (1 - turn / finish), rng, batch)
        return self

    def _pass(self, ids: np.ndarray, share: np.ndarray, many: np.ndarray, y: np.ndarray, weight: np.ndarray, seen: list, rate: float, rng: np.random.Generator, batch: int) -> None:
        order, first = rng.permutation(len(many)), np.cumsum(many) - many
        size = np.cumsum(many[order] + 1)  # a text without n-grams takes part too: it moves the bias
        batch = min(batch, max(1, int(size[-1]) // 40))  # few texts still make many steps
        for own in np.split(order, np.searchsorted(size, np.arange(batch, size[-1], batch))):
            if len(own):
                at = np.arange(many[own].sum()) + np.repeat(first[own] - np.cumsum(many[own]) + many[own], many[own])
                self._step(ids[at], share[at], many[own], y[own], weight[y[own]], seen, rate)

    def _step(self, ids: np.ndarray, share: np.ndarray, many: np.ndarray, y: np.ndarray, weight: np.ndarray, seen: list, rate: float) -> None:
        """One step on all parameters. Of two classes, the gradients of an average point along the difference of the class
        vectors, so that one number a bucket, ``pull``, says how far."""
        diff, text = self.classes[1] - self.classes[0], np.repeat(np.arange(len(many)), many)
        logit = np.bincount(text, (self.vectors @ diff)[ids] * share, len(many)) + (self.bias[1] - self.bias[0])
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / weight.sum()
        pull = np.bincount(ids, g[text] * share, len(self.vectors)).astype(np.float32)
        own = np.nonzero(pull)[0]
        push, total = pull[own] @ self.vectors[own], np.float32(g.sum())
        for value, sq, at, grad in ((self.vectors, seen[0], own, pull[own, None] * diff), (self.classes, seen[1], slice(None), np.stack([-push, push])), (self.bias, seen[2], slice(None), np.array([-total, total]))):
            sq[at] += grad * grad
            value[at] -= rate * grad / np.sqrt(sq[at])

    def light(self) -> Subword:
        """What scoring needs: one number for each bucket, and the bias."""
        diff = self.classes[1] - self.classes[0]
        told = (self.vectors @ diff).astype(np.float32), float(self.bias[1] - self.bias[0])
        return replace(self, vectors=None, classes=None, bias=None, weights=told)

    def score(self, texts: list[str | None], empty: float = 0.0) -> np.ndarray:
        """Probability of class 1 for each text; ``empty`` where a text has no word. Short texts share a block."""
        table, bias = (self if self.weights else self.light()).weights
        raw = [(t or "").encode() for t in texts]
        total, count = np.zeros(len(raw)), np.zeros(len(raw))
        own, held = [], 0
        for k, t in enumerate([*raw, b""]):
            if (last := k == len(raw)) or held + len(t) + 1 > BLOCK:
                if own:
                    ends = np.cumsum([len(raw[i]) + 1 for i in own])
                    ids, word, begins, _ = self.grams(b"\n".join(raw[i] for i in own), ends)
                    text = np.searchsorted(ends, begins, "right")[word] if len(ids) else word
                    # sums in the order of a text's own buckets, whatever stands beside it
                    order = np.argsort(text, kind="stable")
                    at = np.searchsorted(text[order], np.arange(len(own) + 1))
                    value = table[ids[order]].astype(np.float64)
                    for j, i in enumerate(own):
                        total[i], count[i] = value[at[j] : at[j + 1]].sum(), at[j + 1] - at[j]
                own, held = [], 0
            if not last and len(t) >= BLOCK:
                for ids in self.parts(t):
                    total[k], count[k] = total[k] + table[ids].astype(np.float64).sum(), count[k] + len(ids)
            elif not last:
                own, held = [*own, k], held + len(t) + 1
        value = total / np.maximum(count, 1) + bias
        return np.where(count > 0, 1 / (1 + np.exp(-np.clip(value, -30, 30))), empty)


#: Labelled rows of each class that a classifier learns from, at most.
SAMPLE = 2_500
#: Characters up to which a text takes less room than its bag; which of them the driver gets makes no difference.
SHORT = 1 << 16


def learn(docs: DataFrame, labels: DataFrame, label: str, model: Subword, sample: int = SAMPLE) -> Subword:
    """``model`` fitted on labelled rows outside the held-out fifth: of each class the ``sample`` first by a hash of
    doc_id, their texts whole. A doc_id whose labels differ teaches nothing; of rows that repeat a doc_id the one whose
    text has the smallest hash teaches. With fewer than two classes the model stays neutral.

    The driver gets at most ``2 * sample`` texts of up to ``SHORT`` characters or bags of at most ``2 ** bits`` buckets.
    """
    known = columns(labels, "doc_id", label).where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("id"), F.col(label).alias("y"))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("high")).where("y = high AND id IS NOT NULL").select("id", "y").where(~held_out(F.col("id")))
    known = reduce(DataFrame.unionByName, [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)])
    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    # at most twice `sample` ids are broadcast
    rows = own.join(F.broadcast(known), "id").select("id", "y", F.xxhash64("text").alias("th"), "text")
    empty = replace(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            bags = [empty.bag(t) if t and len(t) > SHORT else (None, None) for t in texts]
            text = pa.array([t if x[0] is None else None for t, x in zip(texts, bags, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], text, *(pa.array([x[k] for x in bags], pa.list_(pa.int32())) for k in (0, 1))], ["id", "y", "th", "text", "ids", "n"])

    arrow(docs.sparkSession)
    bags = rows.mapInArrow(run, "id long, y int, th long, text string, ids array<int>, n array<int>")
    found = bags.groupBy("id").agg(F.min(F.struct("th", "y", "text", "ids", "n")).alias("x")).select("id", "x.y", "x.text", "x.ids", "x.n").toArrow().combine_chunks()
    order = np.argsort(found.column("id").to_numpy())
    ys = found.column("y").to_numpy()[order]
    if len(set(ys.tolist())) < 2:
        model.vectors, model.classes = np.zeros((1 << model.bits, model.dims), np.float32), np.zeros((2, model.dims), np.float32)
        model.bias = np.zeros(2, np.float32)
        return model
    return model.fit(Bags(model, found, order.tolist()), ys)


class Bags(Collection):
    """The bags of the rows ``order`` of a table, made as they are asked for."""

    def __init__(self, model: Subword, found: pa.Table, order: list[int]):
        self.model, self.order, (self.text, self.ids, self.n) = model, order, (found.column(c) for c in ("text", "ids", "n"))

    def __len__(self) -> int:
        return len(self.order)

    def __contains__(self, x: object) -> bool:
        return False

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in self.order:
            yield (self.ids[k].values.to_numpy(), self.n[k].values.to_numpy()) if self.ids[k].is_valid else self.model.bag(self.text[k].as_py())


def quality(docs: DataFrame, labels: DataFrame) -> Subword:
    """Letter case and marks are signs of quality: neither is folded."""
    return learn(docs, labels, "quality", Subword(lower=False, marks=False))


def toxicity(docs: DataFrame, labels: DataFrame) -> Subword:
    """Few n-grams make a text toxic: much is taken off all vectors. Classes weigh as often as they occur."""
    return learn(docs, labels, "toxic", Subword(lower=True, marks=True, balance=0.0, shrink=0.2))


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fifth that nothing is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def scored(docs: DataFrame, model: Subword, cut: float, empty: float = 0.0) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row.

    A null text counts as empty; a text without words has the score ``empty``. A null doc_id is not held out. Equal texts
    get equal scores, wherever they stand. Columns other than doc_id and text are not read; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    arrow(spark)
    told = spark.sparkContext.broadcast(model.light())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.score(b.column(1).to_pylist(), empty), pa.float64())], ["doc_id", "score"])

    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = own.mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def below(docs: DataFrame, model: Subword, cut: float, empty: float = 0.0) -> DataFrame:
    """The rows of ``docs``, with all columns, that score less than ``cut``; no column is added, so no name can clash. A
    model that learned nothing, as it saw fewer than two classes, rejects nothing."""
    spark = docs.sparkSession
    if not np.any(model.light().weights[0]):
        return docs
    arrow(spark)
    told = spark.sparkContext.broadcast(model.light())
    at, rows = docs.columns.index("text"), numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        for b in batches:
            yield b.filter(pa.array(own.score(b.column(at).to_pylist(), empty) < cut))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
