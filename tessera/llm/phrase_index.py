"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into shards of whole documents. For each shard the index
stores, by term, the ascending positions of that term in the shard's word
stream, in which documents are parted by a gap that no phrase can bridge. The
table lies in the shared folder and serves any test set.

A test set is taken in blocks of bounded size. Per shard, postings of a block's
terms alone are read. Each phrase starts from the list of its rarest term, whose
positions less the term's offset are candidate starts; these are intersected
with the offset-adjusted lists of the other terms, next rarest first. All phrases
of a block go through each step together, as array operations. With a slack, a
term may lie that many words from its place, which gives proximity matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workers import BATCH_ROWS, give_back, row_key
from tessera.plans.storage import concluded, written

WINDOW_WORDS = 10
#: Words between two documents of a shard; also the largest slack.
GAP = 16
#: A shard closes with the document that reaches this many words.
SHARD_WORDS = 1 << 19
#: Characters of test items taken at once, and candidate starts that a task expands at once.
BLOCK_CHARS = 4 << 20
STARTS = 1 << 20

_FOLD = bytes(
    32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b < 0x5B else b
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII digits, letters (A-Z lowered) and all characters beyond ASCII, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


_INDEX = "shard long, term binary, positions array<int>, ids array<long>, sizes array<int>, nulls array<boolean>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index table: per shard one row a term, and one row of the empty term that lists the documents.

    A shard never spans tasks, so its size is bounded by ``SHARD_WORDS`` and the
    longest document. Documents keep their order; ids may be null or repeat.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        words: list[bytes] = []
        sizes: list[int] = []
        ids: list[int | None] = []
        shard = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = words_of(text.as_py())
                words += own
                sizes.append(len(own))
                ids.append(doc)
                if len(words) >= SHARD_WORDS:
                    yield from _shard(base + shard, words, sizes, ids)
                    words, sizes, ids, shard = [], [], [], shard + 1
        if sizes:
            yield from _shard(base + shard, words, sizes, ids)
        del words
        give_back()

    return docs.select(id_col, text_col).mapInArrow(rows, _INDEX)


def _places(sizes: np.ndarray) -> np.ndarray:
    """First position of each document in its shard's stream."""
    return np.concatenate(([0], np.cumsum(sizes + GAP)[:-1])) if len(sizes) else np.zeros(0, np.int64)


def _shard(shard: int, words: list[bytes], sizes: list[int], ids: list[int | None]) -> Iterator[pa.RecordBatch]:
    size = np.array(sizes, np.int64)
    position = np.repeat(_places(size) - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(words))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    postings = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(position[order].astype(np.int32))
    )
    n = len(coded.dictionary)
    none = pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.bool_()))
    names = ["shard", "term", "positions", "ids", "sizes", "nulls"]
    table = pa.RecordBatch.from_arrays([pa.array(np.full(n, shard), pa.int64()), coded.dictionary, postings, *none], names)
    for at in range(0, n, 1 << 14):
        yield table.slice(at, 1 << 14)
    listed = [[x or 0 for x in ids]], [sizes], [[x is None for x in ids]]
    types = pa.int64(), pa.int32(), pa.bool_()
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int64()), pa.array([b""], pa.binary()), pa.array([[]], pa.list_(pa.int32()))]
        + [pa.array(x, pa.list_(t)) for x, t in zip(listed, types, strict=True)],
        names,
    )


@dataclass
class Block:
    """Distinct phrases of some test items: terms, their codes by phrase and offset, and the items of each phrase."""

    terms: list[bytes]
    codes: np.ndarray  # phrase x offset; -1 beyond a short phrase's end
    lengths: np.ndarray
    items: list[list[str]]


def block_of(items: list[tuple[str, str | None]], width: int = WINDOW_WORDS) -> Block:
    """Phrases of ``width`` consecutive words, or a shorter item's whole word list."""
    vocabulary: dict[bytes, int] = {}
    phrases: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        coded = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        for i in range(max(1, len(coded) - width + 1) if coded else 0):
            phrases.setdefault(tuple(coded[i : i + width]), set()).add(item)
    codes = np.full((len(phrases), width), -1, np.int64)
    for k, phrase in enumerate(phrases):
        codes[k, : len(phrase)] = phrase
    return Block(list(vocabulary), codes, (codes >= 0).sum(axis=1), [sorted(x) for x in phrases.values()])


def _find(block: Block, lists: dict[int, np.ndarray], slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of all matches in a shard, whose term postings are ``lists``."""
    freq = np.zeros(len(block.terms), np.int64)
    for code, found in lists.items():
        freq[code] = len(found)
    held = np.array(sorted(lists), np.int64)
    flat = np.concatenate([(c << 32) + lists[c] for c in held.tolist()]) if len(held) else np.zeros(0, np.int64)
    first = np.concatenate((np.cumsum(freq) - freq, [len(flat)]))
    count = np.where(block.codes >= 0, freq[block.codes], np.iinfo(np.int64).max)
    rarest = np.argsort(count, axis=1, kind="stable")
    phrase = np.nonzero((block.lengths > 0) & (count.min(axis=1) > 0))[0]
    ends = np.cumsum(freq[block.codes[phrase, rarest[phrase, 0]]])
    found, at = [], 0
    while at < len(phrase):  # so many phrases at once that their starts stay within STARTS, or one
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STARTS, "right")))
        found.append(_matched(block, phrase[at:upto], rarest, freq, first, flat, slack))
        at = upto
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(p for p, _ in found)]), np.concatenate([none, *(s for _, s in found)])


def _matched(
    block: Block, phrase: np.ndarray, rarest: np.ndarray, freq: np.ndarray, first: np.ndarray, flat: np.ndarray, slack: int
) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of the matches of some phrases: the list of the rarest term, intersected with the others in turn."""
    lead = block.codes[phrase, rarest[phrase, 0]]
    many = freq[lead]
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = flat[np.repeat(first[lead], many) + within] & 0xFFFFFFFF
    phrase = np.repeat(phrase, many)
    start = at - rarest[phrase, 0]
    for step in range(1, block.codes.shape[1]):
        on = block.lengths[phrase] > step
        offset = rarest[phrase, step]
        base, spot = block.codes[phrase, offset] << 32, start + offset
        low, high = base + np.maximum(spot - slack, 0), base + spot + slack
        place = np.searchsorted(flat, low)
        seen = flat[np.minimum(place, len(flat) - 1)] if len(flat) else low
        ok = ~on | ((place < len(flat)) & (seen <= high) & (spot + slack >= 0))
        phrase, start = phrase[ok], start[ok]
    return phrase, start


_HITS = "shard long, doc_no int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>, near array<string>"


def match_block(index: DataFrame, block: Block, slack: int = 0) -> DataFrame:
    """One row a document: exact hit intervals, items with exact matches, items with proximity matches alone."""
    if not 0 <= slack < GAP // 2:
        raise ValueError(f"the slack must be below {GAP // 2} words")
    spark = index.sparkSession
    codes = {t: k for k, t in enumerate(block.terms)}
    wanted = spark.createDataFrame(pa.table({"term": pa.array([b"", *block.terms], pa.binary())}))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        listing = pdf[pdf["term"].map(len) == 0].iloc[0]
        size = np.asarray(listing["sizes"], np.int64)
        begin = _places(size)
        lists = {codes[bytes(t)]: np.asarray(p, np.int64) for t, p in zip(pdf["term"], pdf["positions"], strict=True) if len(t)}
        phrase, start = _find(block, lists, 0)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        near: dict[int, set[str]] = {}
        for d, p, s in zip(np.searchsorted(begin, start, "right") - 1, phrase, start, strict=True):
            spans.setdefault(int(d), []).append((int(s - begin[d]), int(s - begin[d] + block.lengths[p])))
            items.setdefault(int(d), set()).update(block.items[p])
        if slack:
            phrase, start = _find(block, lists, slack)
            for d, p in zip(np.searchsorted(begin, start + slack, "right") - 1, phrase, strict=True):
                near.setdefault(int(d), set()).update(block.items[p])
        out = []
        for d in range(len(size)):
            merged = _merge(spans.get(d, []))
            own = items.get(d, set())
            out.append((
                listing["shard"], d, None if listing["nulls"][d] else int(listing["ids"][d]), int(size[d]),
                [a for a, _ in merged], [b for _, b in merged], sorted(own), sorted(near.get(d, set()) - own),
            ))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in _HITS.split(", ")])
        return frame.astype({"doc_id": "Int64"})

    some = index.join(F.broadcast(wanted), "term", "left_semi")  # a block's terms are bounded by BLOCK_CHARS
    return some.groupBy("shard").applyInPandas(search, _HITS)


def _merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int) -> Iterator[Block]:
    """Test items in blocks of at most ``BLOCK_CHARS`` characters and one item, read partition by partition."""
    held: list[tuple[str, str | None]] = []
    size = 0
    for item, text in items.select(F.col(id_col).cast("string"), F.col(text_col)).dropna().toLocalIterator():
        held.append((item, text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block_of(held, width)
            held, size = [], 0
    yield block_of(held, width)


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW_WORDS, slack: int = 0,
) -> DataFrame:
    """One row a row of ``docs``: id_col, n_words, n_hit, n_items, items_sha256, contaminated, starts, ends, items, near_items.

    ``starts`` and ``ends`` are merged word intervals inside matched phrases.
    ``near_items`` are items matched within ``slack`` only. Null and empty texts
    have no words; items without id or words match nothing; an empty test set
    leaves every document clean. Repeated rows are separate documents; repeated
    items count once. Ids of documents are integers.
    """
    index = written(build_index(docs, id_col, text_col), "phrase-index", BATCH_ROWS)
    blocks = _blocks(items, item_col, item_text_col, width)
    one, two = next(blocks), next(blocks, None)
    if two is None:
        whole = match_block(index, one, slack)
    else:  # each block's matches are written before the next block is read, so the driver holds two at most
        parts = [written(match_block(index, b, slack), "matches") for b in chain((one, two), blocks)]
        del one, two
        stacked = parts[0]
        for p in parts[1:]:
            stacked = stacked.unionAll(p)
        whole = stacked.groupBy("shard").applyInPandas(_joined, _HITS)

    def finish(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = [sum(int(b) - int(a) for a, b in zip(s, e, strict=True)) for s, e in zip(pdf["starts"], pdf["ends"], strict=True)]
            yield pd.DataFrame({
                "id": pdf["doc_id"], "n_words": pdf["n_words"], "n_hit": hit,
                "n_items": [len(x) for x in pdf["items"]],
                "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in pdf["items"]],
                "contaminated": [h > 0 for h in hit],
                "starts": pdf["starts"], "ends": pdf["ends"], "items": pdf["items"], "near_items": pdf["near"],
            })

    schema = (
        "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "starts array<int>, ends array<int>, items array<string>, near_items array<string>"
    )
    return whole.mapInPandas(finish, schema).withColumnRenamed("id", id_col)


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union of what several blocks found in one shard's documents."""
    out = []
    for no, g in pdf.groupby("doc_no", sort=True):
        merged = _merge((int(a), int(b)) for s, e in zip(g["starts"], g["ends"], strict=True) for a, b in zip(s, e, strict=True))
        own = {i for x in g["items"] for i in x}
        near = {i for x in g["near"] for i in x} - own
        one = g.iloc[0]
        out.append((
            one["shard"], no, None if pd.isna(one["doc_id"]) else int(one["doc_id"]), int(one["n_words"]),
            [a for a, _ in merged], [b for _, b in merged], sorted(own), sorted(near),
        ))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _HITS.split(", ")]).astype({"doc_id": "Int64"})


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which a benchmark phrase occurs; rows are told apart by all their columns, so ids may be null or repeat."""
    keyed = docs.withColumn("__tessera_key", row_key(docs))

    def hit() -> DataFrame:
        found = decontaminate(keyed, items, "__tessera_key", text_col).where("contaminated")
        return found.select(F.col("__tessera_key").alias("__tessera_bad")).distinct()

    bad = concluded(docs.sparkSession, "contaminated", hit)  # the index goes with it
    return keyed.join(bad, F.col("__tessera_key") == F.col("__tessera_bad"), "left_anti").select(*docs.columns)
