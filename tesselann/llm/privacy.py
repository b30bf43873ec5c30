"""Personal data, and the terms that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each value is a protected entity, and so is each
e-mail domain. A term discloses an entity as far as it removes the uncertainty about it: with p(e) the share of distinct
texts that hold the entity, and p(e|t) the share of those with the term that hold it within ``NEAR`` words, disclosure is
PMI(e; t) / IC(e) = 1 - log p(e|t) / log p(e), at most 1. ``DOUBT`` texts that have the term without the entity are added
to those seen, so that a term has to recur with an entity to be removed, while one that was only ever seen beside it is
still generalised. Copies of a text are no further evidence: all counts are of distinct texts, over the whole corpus.

A term at or above ``GENERALISE`` for any entity is treated wherever it stands, also where the entity does not: it is
replaced by what it looks like (``general``), or removed at or above ``REMOVE``.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .filters import bloom, within
from .shared import arrow, columns, few, kept, numbered, shared_dir

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that may disclose it; letters of such a word, at least.
NEAR, LETTERS = 5, 3
#: Texts added to those that have a term without the entity.
DOUBT = 1.0
GENERALISE, REMOVE = 0.9, 0.97

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits, as its beginning would match too
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match of the address pattern, found from its @ on both sides."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    twice = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in code points, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if len(m[0]) >= 16 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def hashed(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def entities(kind: int, value: str) -> list[int]:
    """What a span protects: its value, and of an e-mail address the domain too."""
    if kind == 0:
        return [hashed(f"0:{value.lower()}"), hashed(f"@:{value.lower().rpartition('@')[2]}")]
    return [hashed(f"{kind}:{value if kind == 1 else digits(value)}")]


def term(word: str) -> int:
    return hashed(word.lower())


def context(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int | None]]:
    """``(entity, term)`` for the words near each span that are in no span, and ``(entity, None)`` for each span."""
    if not spans:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    begins, ends = [a for a, _ in words], [b for _, b in words]
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    first = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        k = bisect_left(first, b)
        return k == 0 or taken[k - 1][1] <= a

    out: list[tuple[int, int | None]] = []
    for kind, a, b in spans:
        left, right = bisect_right(ends, a), bisect_left(begins, b)
        near = [words[k] for k in (*range(max(0, left - NEAR), left), *range(right, min(len(words), right + NEAR)))]
        terms = [term(text[x:y]) for x, y in near if y - x >= LETTERS and free(x, y)]
        for e in entities(kind, text[a:b]):
            out += [(e, None), *((e, t) for t in terms)]
    return out


PAIRS = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64())]))


def neighbours(texts: DataFrame) -> DataFrame:
    """``(th, near array<struct<e, t>>)`` for each row of ``texts (text, th)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [[{"e": e, "t": t} for e, t in dict.fromkeys(context(x or "", base_spans(x or "")))] for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(near, PAIRS)], ["th", "near"])

    return texts.mapInArrow(run, "th long, near array<struct<e: long, t: long>>")


class Sieve(dict):
    """The hash of each word that the filter ``own`` lets through, None for others; remembers words already met."""

    def __init__(self, own: bytes, most: int = 100_000):
        super().__init__()
        self.own, self.most = own, most

    def __missing__(self, word: str) -> int | None:
        t = term(word) if len(word) >= LETTERS else None
        if t is not None and not within(t, self.own):
            t = None
        if len(self) < self.most:
            self[word] = t
        return t


def counted(texts: DataFrame, terms: DataFrame, copied: DataFrame) -> DataFrame:
    """``(t, n)``: in how many distinct texts of ``texts (text, th)`` each of ``terms (t)`` stands. ``copied (t)`` has the th
    of all texts that come more than once: their terms meet by text, those of other texts are counted where they are read."""
    told = texts.sparkSession.sparkContext.broadcast((bloom(terms), bloom(copied)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, again = told.value
        sieve = Sieve(own)
        for b in batches:
            t, h = [], []
            for text, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                have = {sieve[w] for w in set(WORD.findall(text or ""))} - {None}
                t += have
                h += [key if within(key, again) else None] * len(have)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(h, pa.int64())], ["t", "th"])

    # counted before the join, so that a frequent term is dealt out by its texts
    words = texts.mapInArrow(run, "t long, th long").groupBy("t", "th").agg(F.count(F.lit(1)).alias("n"))
    one = F.when(F.col("th").isNull(), F.col("n")).otherwise(F.lit(1))
    return words.groupBy("t").agg(F.sum(one).alias("n")).join(terms, "t", "left_semi")


def disclosing(texts: DataFrame) -> DataFrame:
    """``(t, removed)``: the terms that disclose an entity, over ``texts (text, th)``; written to the shared folder."""
    rows = kept(neighbours(texts))
    near = rows.where(F.size("near") > 0).select("th", F.explode("near").alias("x")).select("th", "x.*").distinct()
    seen = near.where("t IS NOT NULL")
    pairs = seen.groupBy("e", "t").agg(F.count(F.lit(1)).alias("both"))
    held = near.where("t IS NULL").groupBy("e").agg(F.count(F.lit(1)).alias("texts"))
    least = seen.select("t", "th").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("least"))
    copied = few(rows.groupBy("th").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select(F.col("th").alias("t"), "many"))
    total = rows.count() - (copied.agg(F.sum(F.col("many") - 1)).first()[0] or 0)

    def disclosed(of: str):
        return 1 - F.log(F.col("both") / (F.col(of) + DOUBT)) / F.log(F.col("texts") / F.lit(float(total + 1)))

    # a term stands in at least the texts in which it is near any entity: most common words end here
    pairs = few(pairs.join(held, "e").join(least, "t").where(disclosed("least") >= GENERALISE))
    whole = counted(texts, pairs.select("t").distinct(), copied.select("t"))
    told = pairs.join(whole, "t").withColumn("d", disclosed("n")).where(F.col("d") >= GENERALISE)
    return few(told.groupBy("t").agg((F.max("d") >= REMOVE).alias("removed")))


FOUND = "row long, n_email long, n_ip long, n_card long, n_phone long, base string, hits array<struct<t: long, a: int, b: int>>"
HITS = pa.list_(pa.struct([("t", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))


def found(rows: DataFrame, at: int, terms: DataFrame) -> DataFrame:
    """``rows``, whose column ``at`` is the text, with what ``FOUND`` names: a number for each row, its base spans, and
    the words outside these that may be of ``terms``."""
    told = rows.sparkSession.sparkContext.broadcast(bloom(terms))
    names = [*rows.columns, *StructType.fromDDL(FOUND).names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sieve = TaskContext.get().partitionId() << 33, Sieve(told.value)
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                spans = base_spans(text or "")
                hits = []
                if any(sieve[w] is not None for w in set(WORD.findall(text or ""))):
                    hits = outside([(t, *m.span()) for m in WORD.finditer(text) if (t := sieve[m[0]]) is not None], spans)
                count = [sum(s[0] == k for s in spans) for k in range(4)]
                out.append((row, *count, ",".join(f"{KINDS[k]}:{s}:{t}" for k, s, t in spans), [dict(zip("tab", x, strict=True)) for x in hits]))
                row += 1
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string(), HITS]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(FOUND).fields]))


def outside(hits: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The hits that overlap no span."""
    edges, out, k, end = sorted((a, b) for _, a, b in spans), [], 0, -1
    for t, a, b in hits:
        while k < len(edges) and edges[k][0] < b:
            end, k = max(end, edges[k][1]), k + 1
        if end <= a:
            out.append((t, a, b))
    return out


def resolved(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``(row, terms)``: the hits of each of ``rows`` that are of ``terms``, as ``(a, b, removed)`` by place."""
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*")
    hits = hits.join(terms, "t")
    return hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b", "removed"))).alias("terms"))


def named(docs: DataFrame) -> DataFrame:
    """``(text, th)`` with a hash of each text; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return columns(docs, "text").select(text.alias("text"), F.xxhash64(text).alias("th"))


def spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term)``, a row for each row of ``docs``.

    A null text counts as empty: no spans. A null doc_id stays null; repeated rows each have their result. Texts of any
    length are searched whole. Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    arrow(docs.sparkSession)
    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    terms = disclosing(named(docs))
    rows = kept(found(own, 1, terms).drop("text"))
    out = rows.drop("hits").join(resolved(rows, terms), "row", "left")
    told = F.array_join(F.transform("terms", lambda x: F.concat(F.lit("term:"), x["a"], F.lit(":"), x["b"])), ",")
    every = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), told)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), every.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def general(word: str) -> str:
    """The general term for a word, by its looks."""
    return "[CODE]" if word.isupper() else "[NAME]" if word[:1].isupper() else "[TERM]"


def redact(text: str, base: str, terms: list | None) -> str:
    """The text with base spans named by kind, and disclosing terms generalised or removed; of overlapping spans the first
    in the text, of those the longest, gives the name."""
    marks = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (x.split(":") for x in base.split(",") if x)]
    marks += [(x["a"], x["b"], "" if x["removed"] else general(text[x["a"] : x["b"]])) for x in terms or ()]
    out, at, end = [], 0, 0
    for a, b, name in sorted(marks, key=lambda m: (m[0], -m[1])):
        if a >= end:
            out += [text[end:a], name]
        end = max(end, b)
    return "".join(out) + text[end:] if out else text


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts redacted, and n_chars, where there is one, that of the new text.

    Rows with neither personal data nor a disclosing term stay as they are, a null text too. Repeated rows are each
    redacted; an empty table gives an empty one. Columns of any name are carried: none is added beside them under a name
    of its own. Rows are written once to the shared folder with what was found in them; only those that hold words which
    may be terms are dealt out again, to meet their terms.
    """
    spark, names = docs.sparkSession, docs.columns
    arrow(spark)
    terms = disclosing(named(docs))
    own = numbered(docs)
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    inner = own.columns
    path = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    found(own, text, terms).write.parquet(path)
    rows = spark.read.schema(StructType([*own.schema.fields, *StructType.fromDDL(FOUND).fields])).parquet(path)
    carried = [*inner, "base"]
    hit = rows.where(F.size("hits") > 0).select(*carried, "row").join(resolved(rows, terms), "row", "left").select(*carried, "terms")
    none = F.lit(None).cast("array<struct<a: int, b: int, removed: boolean>>").alias("terms")
    touched = rows.where((F.size("hits") == 0) & (F.col("base") != "")).select(*carried, none).unionByName(hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, cols = b.column(text).to_pylist(), list(b.columns[: len(names)])
            new = [x if x is None else redact(x, *y) for x, *y in zip(old, b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True)]
            cols[text] = pa.array(new, pa.string())
            if chars >= 0:
                told = [n if x == y else len(y) for x, y, n in zip(old, new, cols[chars].to_pylist(), strict=True)]
                cols[chars] = pa.array(told, pa.int64()).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, inner)

    same = rows.where((F.size("hits") == 0) & (F.col("base") == "")).select(*inner)
    return same.unionByName(touched.mapInArrow(run, own.schema)).toDF(*names)
