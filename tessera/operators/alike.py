"""Exact similarity join of token sets, block by block, without a row for a candidate.

At a low similarity most pairs share some token, so a join by tokens, however
filtered, writes nearly all pairs. Here sets are packed into blocks of bounded
size, every two blocks meet once in a Cartesian product that reads them from the
shared folder, and a task counts what the sets of its two blocks share: tokens
of a short frequent list by a product of 0/1 matrices, all others by merging
their sorted hashes. Only pairs that are alike leave the task, so disk grows with
the sets and the result; time still grows with the square of the distinct sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import concluded, written

#: Sets and tokens of a block at most (one larger set is a block), tokens of the frequent list, sets and matches counted at once.
BLOCK_SETS = 4096
BLOCK_TOKENS = 1 << 20
FREQUENT = 128
ROWS = 256
MATCHES = 1 << 21
BATCH_ROWS = 1024


def set_join(df: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """(a, b, similarity) of pairs of distinct token sets with Jaccard similarity of ``least`` (above 0) or more; a < b.

    Equal sets are merged first under their least key. Counts are exact: tokens go by their
    64-bit hash, and those that share theirs with another token join the frequent list, which goes by value.
    """
    return concluded(df.sparkSession, "alike", lambda: _alike(df, key, tokens, least), 1)


def _alike(df: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    keyed = df.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(tokens)).alias("s"))
    sets = written(keyed.where((F.size("s") > 0) & F.col("k").isNotNull()).groupBy("s").agg(F.min("k").alias("k")), "sets")
    words = written(sets.select(F.explode("s").alias("w")).groupBy(F.xxhash64("w").alias("h"), "w").agg(F.count("*").alias("f")), "words")
    top = words.where("f > 1").orderBy(F.desc("f"), "h", "w").limit(FREQUENT)
    twins = words.join(words.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h")
    frequent = list(dict.fromkeys(r["w"] for r in [*top.select("w").collect(), *twins.select("w").collect()]))
    kind = sets.schema["k"].dataType.simpleString()
    hashed = sets.select("k", "s", F.transform("s", lambda w: F.xxhash64(w)).alias("h"))
    blocks = written(hashed.mapInArrow(_packer(frequent), f"block long, k array<{kind}>, n array<int>, code array<int>, h array<long>, who array<int>"), "blocks", BATCH_ROWS)
    a, b = (blocks.select(*[F.col(c).alias(x + c) for c in blocks.columns]) for x in "ab")
    met = a.join(b.hint("shuffle_replicate_nl"), F.col("ablock") <= F.col("bblock"))
    pairs = met.mapInArrow(_meeter(len(frequent), least), f"x {kind}, y {kind}, similarity double")
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _packer(frequent: list):
    """Rows (k, s, h) to blocks: keys, sizes, frequent tokens as set * len(frequent) + place, hashes of the others in order and the sets they are of."""

    def block(no: int, held: list[tuple]) -> pa.RecordBatch:
        k, s, h = (pa.concat_arrays([x[c] for x in held]) for c in (0, 2, 3))
        n = np.concatenate([x[1] for x in held])
        who = np.repeat(np.arange(len(n), dtype=np.int32), n)
        place = pc.index_in(s, value_set=pa.array(frequent, s.type))
        often = place.is_valid().to_numpy(zero_copy_only=False)
        code = who[often] * np.int32(len(frequent)) + place.drop_null().to_numpy()
        rest = h.to_numpy()[~often]
        order = np.argsort(rest, kind="stable")
        columns = [k, *map(pa.array, (n, code, rest[order], who[~often][order]))]
        listed = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), *listed], ["block", "k", "n", "code", "h", "who"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        sets = tokens = 0
        for b in batches:
            k, (s, h) = b.column(0), (b.column(c).flatten() for c in (1, 2))
            n = pc.list_value_length(b.column(2)).to_numpy().astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            at = 0
            while at < len(n):
                fits = int(np.searchsorted(ends, ends[at] + BLOCK_TOKENS - tokens, "right")) - 1
                to = min(max(fits, at if held else at + 1), at + BLOCK_SETS - sets, len(n))
                if to > at:
                    held.append((k[at:to], n[at:to], s[ends[at] : ends[to]], h[ends[at] : ends[to]]))
                    sets, tokens = sets + to - at, tokens + int(ends[to] - ends[at])
                if to < len(n) or sets == BLOCK_SETS:
                    yield block(no, held)
                    no, held, sets, tokens = no + 1, [], 0, 0
                at = to
        if held:
            yield block(no, held)

    return pack


def _meeter(width: int, least: float):
    """Rows of two blocks to (x, y, similarity) of the pairs of their sets that are alike; a block that meets itself gives each pair once."""

    def dense(n: int, code: np.ndarray) -> np.ndarray:
        out = np.zeros((n, width), np.float32)
        out.reshape(-1)[code] = 1
        return out

    def found(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, ...]]:
        (n, code, h, who), (m, other, g, whose) = a, b
        left, right = dense(len(n), code), np.ascontiguousarray(dense(len(m), other).T)
        # shared >= least * union, without the division and a little too wide; both are decided below
        share = least / (1 + least) * (1 - 1e-6)
        need, more = (n * share - 0.01).astype(np.float32), (m * share).astype(np.float32)
        begin = np.searchsorted(g, h)
        times = np.searchsorted(g, h, "right") - begin
        kept = np.flatnonzero(times)
        kept = kept[np.argsort(who[kept], kind="stable")]
        who, begin, times = who[kept], begin[kept], times[kept]
        total = np.cumsum(times)
        for at in range(0, len(n), ROWS):
            shared = left[at : at + ROWS] @ right
            flat = shared.reshape(-1)
            one, end = np.searchsorted(who, (at, at + ROWS))
            while one < end:
                before = total[one] - times[one]
                to = min(max(int(np.searchsorted(total, before + MATCHES, "right")), one + 1), end)
                t = times[one:to]
                place = np.arange(total[to - 1] - before) + np.repeat(begin[one:to] - (total[one:to] - t - before), t)
                np.add.at(flat, np.repeat((who[one:to] - at).astype(np.int64) * len(m), t) + whose[place], np.float32(1))
                one = to
            hit = np.flatnonzero(shared >= need[at : at + ROWS, None] + more)
            i, j = at + hit // len(m), hit % len(m)
            c = flat[hit].astype(np.int64)
            similarity = c / (n[i].astype(np.int64) + m[j] - c)
            good = (similarity >= least) & ((i < j) | (not same))
            yield i[good], j[good], similarity[good]

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = ([batch.column(x + c)[r].values for c in ("k", "n", "code", "h", "who")] for x in "ab")
                same = batch.column("ablock")[r] == batch.column("bblock")[r]
                for i, j, similarity in found([x.to_numpy() for x in a[1:]], [x.to_numpy() for x in b[1:]], same):
                    if len(i):
                        yield pa.RecordBatch.from_arrays([a[0].take(pa.array(i)), b[0].take(pa.array(j)), pa.array(similarity)], ["x", "y", "similarity"])

    return meet
