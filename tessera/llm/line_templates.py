"""Line dedup by a log-template tree.

A line's tokens with digits are variable. The tree's fixed levels are the token
count and the leading tokens; a leaf holds the lines that share them, and in a
leaf a line joins the most similar template (share of equal tokens at ``ALIKE`` or
more), whose differing places become variable, or begins one. Templates that occur
in many documents are dropped from all.

Work is dealt by leaf. Equal lines are merged before they are dealt, so a very
common line costs one row a task. Within a leaf lines are taken in the order of
their hashes, so results do not depend on how the input is dealt; they are read
in that order one by one, and a leaf with many templates finds those that can be
alike by an index, so a leaf of any size has the same tree and the same results.

Lines that no frequent template takes are held against each other as they are:
one of any length that an earlier document has too is a repeat.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workers import BATCH_ROWS, give_back
from tessera.plans.storage import written

LEAD = 3
#: Templates of a leaf that are compared one by one; more are looked up by place and token. Results are the same.
MAX_LEAF = 256
ALIKE = 0.7
MIN_TOKENS = 4
MIN_DOCS = 6
VARIABLE = "<*>"
#: Distinct lines that a task merges before it hands them on.
MERGED_LINES = 50_000
_DIGITS = set("0123456789")


def tokens_of(line: str) -> list[str]:
    """White-space tokens; one with a digit is variable."""
    words = line.split()
    return words if _DIGITS.isdisjoint(line) else [w if _DIGITS.isdisjoint(w) else VARIABLE for w in words]


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _leaf(tokens: list[str], lead: int) -> int:
    return _hash(f"{len(tokens)} {lead} " + " ".join(tokens[:lead]))


def _parsed(text: str | None, min_tokens: int) -> Iterator[tuple[int, list[str], str]]:
    for place, line in enumerate((text or "").split("\n")):
        tokens = tokens_of(line)
        if len(tokens) >= min_tokens:
            yield place, tokens, line


class Leaf:
    """The templates of one leaf, whose lines have ``width`` tokens and come in the order of their hashes."""

    def __init__(self, width: int, alike: float = ALIKE, max_leaf: int = MAX_LEAF) -> None:
        self.least = alike * width
        # a template as alike as that equals a line in one at least of any so many places
        self.probes = width - max(1, math.ceil(self.least)) + 1
        self.max_leaf = max_leaf
        self.codes: dict[str, int] = {VARIABLE: 0}
        self.held = np.zeros((4, width), np.int32)
        self.names = array("q")
        self.index: dict[tuple[int, int], list[int]] | None = None

    def template(self, h: int, tokens: list[str]) -> int:
        """Name (the hash of its first line) of the template that the line joins or begins."""
        own = np.array([self.codes.setdefault(t, len(self.codes)) for t in tokens], np.int32)
        at = self._alike(own)
        if at >= 0:
            for place in np.flatnonzero((self.held[at] != own) & (self.held[at] != 0)).tolist():
                self.held[at, place] = 0
                if self.index is not None:
                    self.index.setdefault((place, 0), []).append(at)
            return self.names[at]
        n = len(self.names)
        if n == len(self.held):
            self.held = np.concatenate((self.held, np.zeros_like(self.held)))
        self.held[n] = own
        self.names.append(h)
        if self.index is not None:
            self._note(n)
        elif n >= self.max_leaf:
            self.index = {}
            for i in range(n + 1):
                self._note(i)
        return h

    def _note(self, at: int) -> None:
        for key in enumerate(self.held[at].tolist()):
            self.index.setdefault(key, []).append(at)

    def _alike(self, own: np.ndarray) -> int:
        """The most similar template, the first of equals; -1 where none is alike enough."""
        n = len(self.names)
        if self.index is None:
            some, rows = None, self.held[:n]
        else:
            lists = sorted((self.index.get(key, ()) for key in enumerate(own.tolist())), key=len)[: self.probes]
            some = np.unique(np.fromiter((i for x in lists for i in x), np.int64))
            rows = self.held[some]
        if not len(rows):
            return -1
        equal = (rows == own).sum(axis=1)
        best = int(equal.argmax())
        if equal[best] < self.least:
            return -1
        return best if some is None else int(some[best])


def templates(lines: list[tuple[int, list[str]]], alike: float = ALIKE, max_leaf: int = MAX_LEAF) -> dict[int, int]:
    """Template, named by its first line's hash, of each distinct (hash, tokens) of one leaf, taken in order of hash."""
    if not lines:
        return {}
    leaf = Leaf(len(lines[0][1]), alike, max_leaf)
    return {h: leaf.template(h, tokens) for h, tokens in sorted(lines)}


def _occurrences(docs: DataFrame, min_tokens: int) -> DataFrame:
    """(key, place, form, exact): one row a line of ``docs`` (key, text) with tokens; ``form`` is null where they are too few for templates."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places, forms, exact = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for place, tokens, line in _parsed(text.as_py(), 1):
                    keys.append(key)
                    places.append(place)
                    exact.append(_hash(" ".join(line.split())))
                    same = _DIGITS.isdisjoint(line)
                    forms.append(None if len(tokens) < min_tokens else exact[-1] if same else _hash(" ".join(tokens)))
            types = pa.int64(), pa.int32(), pa.int64(), pa.int64()
            columns = [pa.array(c, t) for c, t in zip((keys, places, forms, exact), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "place", "form", "exact"])
        give_back()

    return docs.mapInArrow(rows, "key long, place int, form long, exact long")


def _forms(docs: DataFrame, min_tokens: int) -> DataFrame:
    """(leaf, form, line, n): distinct lines, merged within each task."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def batch() -> pa.RecordBatch:
            split = [line.split(" ") for line in held]
            columns = [
                pa.array([_leaf(t, LEAD) for t in split], pa.int64()),
                pa.array([_hash(line) for line in held], pa.int64()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["leaf", "form", "line", "n"])

        for b in batches:
            for text in b.column(1):
                for _, tokens, _ in _parsed(text.as_py(), min_tokens):
                    line = " ".join(tokens)
                    held[line] = held.get(line, 0) + 1
                if len(held) >= MERGED_LINES:
                    yield batch()
                    held.clear()
        if held:
            yield batch()
            held.clear()
        give_back()

    return docs.mapInArrow(rows, "leaf long, form long, line string, n long")


def _assigned(dealt: DataFrame, alike: float, min_docs: int, max_leaf: int) -> DataFrame:
    """(form, template) of the lines whose template holds ``min_docs`` lines or more; ``dealt`` is sorted by leaf and form in each partition."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        leaf: Leaf | None = None
        total = 0
        held: list[tuple[int, str, int]] = []  # the lines of a leaf until they are enough
        forms, named, size = array("q"), array("q"), {}

        def take(form: int, line: str, n: int) -> None:
            nonlocal leaf
            if forms and forms[-1] == form:  # the same line from another task
                size[named[-1]] += n
                return
            tokens = line.split(" ")
            leaf = leaf or Leaf(len(tokens), alike, max_leaf)
            t = leaf.template(form, tokens)
            forms.append(form)
            named.append(t)
            size[t] = size.get(t, 0) + n

        def close() -> Iterator[pa.RecordBatch]:
            some = [(h, t) for h, t in zip(forms, named, strict=True) if size[t] >= min_docs]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some, strict=True)], ["form", "template"])

        for b in batches:
            for key, form, line, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != at:
                    yield from close()
                    at, leaf, total, held = key, None, 0, []
                    forms, named, size = array("q"), array("q"), {}
                total += n
                held.append((form, line, n))
                if total >= min_docs:
                    for one in held:
                        take(*one)
                    held = []
        yield from close()

    return dealt.mapInArrow(rows, "form long, template long")


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: float = ALIKE, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS
) -> DataFrame:
    """One row a row of ``docs``: id_col, row_hash, n_lines, n_dropped, dropped, repeated (ascending line numbers from 0).

    A line is dropped where its template occurs in ``min_docs`` documents or more;
    rows equal in id and text are one document. Lines of fewer than ``min_tokens``
    tokens have no template. Of the lines that stay, ``repeated`` are those that occur
    in a document before this one, by ``row_hash``, equal but for white space, however
    short and in however few documents. Null and empty texts have one empty line. A
    null id is an id.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    texts = keyed.select("key", "text")
    lines = written(_occurrences(texts, min_tokens), "lines", BATCH_ROWS)
    dealt = _forms(texts, min_tokens).repartition("leaf").sortWithinPartitions("leaf", "form")
    known = written(_assigned(dealt, alike, min_docs, MAX_LEAF), "templates").dropDuplicates(["form"])
    met = written(lines.select("key", "place", "form").join(known, "form").select("key", "place", "template"), "met")
    spread = met.select("template", "key").distinct().groupBy("template").agg(F.count("*").alias("docs"))
    often = written(spread.where(F.col("docs") >= min_docs).select("template"), "recurring")
    firsts = lines.groupBy("exact").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    again = written(lines.join(written(firsts.select("exact", "first"), "repeats"), "exact").where("key <> first").select("key", "place"), "again")
    marks = met.join(often, "template").select("key", "place", F.lit(True).alias("often")).unionAll(again.select("key", "place", F.lit(False).alias("often")))
    places = lambda often: F.sort_array(F.collect_set(F.when(F.col("often") == often, F.col("place"))))
    gone = marks.groupBy("key").agg(places(True).alias("dropped"), places(False).alias("repeated"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return keyed.select("id", "key", n_lines.alias("n_lines")).join(gone, "key", "left").select(
        F.col("id").alias(id_col), F.col("key").alias("row_hash"), "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        F.coalesce(F.array_except("repeated", "dropped"), F.array().cast("array<int>")).alias("repeated"),
    )


def without_dropped(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = False) -> DataFrame:
    """``docs`` with the dropped lines of ``found`` taken out of their texts, and with ``repeats`` the repeated ones too; null texts stay null."""
    lost = F.concat("dropped", "repeated") if repeats else F.col("dropped")
    gone = found.where(F.size(lost) > 0).groupBy("row_hash").agg(F.first(lost).alias("__tessera_gone")).withColumnRenamed("row_hash", "__tessera_key")
    met = docs.join(gone, F.xxhash64(id_col, text_col) == F.col("__tessera_key"), "left")
    lines = F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains(F.col("__tessera_gone"), i))
    text = F.when(F.col("__tessera_gone").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return met.withColumn(text_col, text).select(*docs.columns)
