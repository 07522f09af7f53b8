"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of their bit counts. One differing bit moves one coordinate by one at
most, so the Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints. The coordinates form eight blocks of four. Two
fingerprints within three bits differ in three blocks at most, so they share a
grid cell of the other five; a fingerprint lies in one cell for each choice of five
blocks (56), of about 30 bits of entropy. The equi-join on cells is followed by the
Manhattan bound and the exact test; a pair counts in the first cell that it shares.

Exact copies and equal fingerprints are merged before the join, so it sees each
fingerprint once, whatever the size of a group of copies.

``keep_one``, a filter without a contract of its own, takes five words and a
similarity of 0.8: texts whose fingerprints of five-word shingles lie within three bits
are linked as above, and all texts whose five-word Jaccard similarity, counted over whole
texts, is 0.8 or more. A wide fingerprint of 128 bits over distinct words, in seeded grid
cells of one-bit segments, links most of these in steps linear in a group's size; an exact
join by prefixes then compares all texts that are not yet in one component, large
components by what sets their texts apart from a centre.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.workers import BATCH_ROWS, give_back, row_key
from tessera.operators.graph import connected_components
from tessera.plans.storage import concluded, written

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 3
#: Blocks of the 32 coordinates.
BLOCKS = 8
#: The filter's shingles and similarity; bits of its wide fingerprint that may differ, its cells, and bits of a cell.
NEAR_WORDS = 5
ALIKE = Fraction(4, 5)
WIDE_DISTANCE = 24
CELLS = 32
CELL_BITS = 32
#: Frequent shingles, at most, that a prefix takes last, and the share of rows (one in so many) that they are counted on. They set the order only.
COMMON = 1 << 16
COMMON_SHARE = 16
#: Parts over which the texts of a class are dealt where they meet its centre.
SALTS = 32
_EVEN = 0x5555555555555555
_SLICE = 1 << 16


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of all shingles; of the whole sequence where it is shorter than one."""
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):  # very long texts in slices of bounded memory
        counts += np.unpackbits(hashes[at : at + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit integer; 0 without words."""
    words = _words(text)
    return _majority(_hashes(words, width)) if words else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id_col, fp): one row per row of ``docs``; null texts count as empty."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])
        give_back()

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(score, f"id {kept.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed at two bits each."""
    next_bit = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(next_bit).bitwiseAND(_EVEN), fp.bitwiseAND(next_bit).bitwiseAND(_EVEN)
    return one.bitwiseOR(F.shiftleft(two, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of the 32-coordinate embeddings of two fingerprints."""
    x = _counts(a).bitwiseXOR(_counts(b))  # 3 where one count is 1 and the other 2, or 2 where they are 0 and 2
    one, high = x.bitwiseAND(_EVEN), F.shiftrightunsigned(x, 1).bitwiseAND(_EVEN)
    return (F.bit_count(one) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(one)))).cast("int")


def grid_links(fps: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (src, dst) of distinct values of ``fp`` at ``max_distance`` bits or fewer, each once.

    Complete for every distance below ``blocks``; a divisor of 32. Cells are the more selective the smaller the distance.
    """
    if not 0 <= max_distance < blocks or 32 % blocks:
        raise ValueError("the distance must be below the number of blocks, a divisor of 32")
    size = 64 // blocks
    chosen = list(combinations(range(blocks), blocks - max_distance))
    masks = [_signed(sum(((1 << size) - 1) << size * b for b in c)) for c in chosen]
    # the first choice that has none of the differing blocks, by the set of them
    first = [next((k for k, c in enumerate(chosen) if not any(m >> b & 1 for b in c)), -1) for m in range(1 << blocks)]
    counts = _counts(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col("__c").bitwiseAND(m).alias("cell")) for k, m in enumerate(masks)])
    home = fps.select("fp", counts.alias("__c")).select("fp", F.inline(cells))
    a, b = home.withColumnRenamed("fp", "src"), home.withColumnRenamed("fp", "dst")
    x = _counts(F.col("src")).bitwiseXOR(_counts(F.col("dst")))
    differ = sum((F.when(x.bitwiseAND(_signed(((1 << size) - 1) << size * i)) != 0, 1 << i).otherwise(0) for i in range(blocks)), F.lit(0))
    near = (manhattan(F.col("src"), F.col("dst")) <= max_distance) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_distance)
    met = a.join(b.hint("merge"), (a["k"] == b["k"]) & (a["cell"] == b["cell"]) & (F.col("src") < F.col("dst")) & near)
    return met.where(F.get(F.array(*map(F.lit, first)), differ) == a["k"]).select("src", "dst")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest
    id of the rows reachable over links of three bits or fewer. Null and empty
    texts share fingerprint zero. Rows with a null id are linked like others and
    never name a component, which is null where no row has an id. Repeated rows
    come out as often as they go in; other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints", BATCH_ROWS)
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    member = connected_components(grid_links(nodes.select("fp")))
    linked = member.join(nodes.hint("merge"), member["node"] == nodes["fp"]).select("node", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    reached = linked.join(named.hint("merge"), "root").select(F.col("node").alias("fp"), "component_id")
    every = nodes.join(reached.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    ids = written(every, "components")  # so that a hot fingerprint's partition can be split in the last join
    return rows.join(ids.hint("merge"), "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def wide_fingerprint(words: list[bytes]) -> tuple[int, int]:
    """Majority bits of the 128-bit XXH3 of distinct words, as two signed 64-bit integers; zero without words."""
    some = list(set(words))
    counts = np.zeros(128, np.int64)
    for at in range(0, len(some), _SLICE):
        raw = b"".join([xxhash.xxh3_128_digest(w, SEED) for w in some[at : at + _SLICE]])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(some)).tobytes()
    return int.from_bytes(bits[:8], "big", signed=True), int.from_bytes(bits[8:], "big", signed=True)


def wide_links(nodes: DataFrame, max_distance: int = WIDE_DISTANCE, cells: int = CELLS, bits: int = CELL_BITS) -> DataFrame:
    """Candidate pairs (src, dst) of ``nodes`` (fp, hi, lo, id) whose wide fingerprints share a cell and differ in few bits.

    A cell is a seeded choice of ``bits`` of the 128 one-bit segments. Within a cell
    every member meets the one of least id, nulls last, so a cell gives fewer pairs than
    it has members, however many near copies it holds.
    """
    rng = random.Random(SEED)
    keys = []
    for k in range(cells):
        mask = sum(1 << i for i in rng.sample(range(128), bits))
        keys.append(F.xxhash64(F.lit(k), F.col("hi").bitwiseAND(_signed(mask >> 64)), F.col("lo").bitwiseAND(_signed(mask & (1 << 64) - 1))))
    dealt = nodes.select("fp", "hi", "lo", "id", F.explode(F.array(*keys)).alias("cell")).repartition("cell")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "hi", "lo")
    least = dealt.groupBy("cell").agg(F.min(order).alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = dealt.join(least.hint("merge"), "cell").where(F.col("fp") != F.col("a.fp"))
    off = F.bit_count(F.col("hi").bitwiseXOR(F.col("a.hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("a.lo")))
    return met.where(off <= max_distance).select(F.col("a.fp").alias("src"), F.col("fp").alias("dst")).distinct()


def _described(docs: DataFrame, id_col: str, text_col: str, common: np.ndarray) -> DataFrame:
    """(key, id, t, fp, hi, lo, n, prefix) of every row of ``docs``, which has a column __tessera_key.

    ``t`` names the sequence of words, ``n`` counts its distinct shingles; ``prefix`` has the first n // 5 + 1 of them,
    those of ``common`` (from the rarest) after all others. Sets of a similarity of ``ALIKE`` share a shingle of these.
    """
    by_hash = np.argsort(common)
    known = common[by_hash]

    def order(s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, s)
        at[at == len(known)] = 0
        often = known[at] == s if len(known) else np.zeros(len(s), bool)
        return np.concatenate([s[~often], common[np.sort(by_hash[at[often]])]])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in b.column(1):
                words = _words(t.as_py())
                hashes = _hashes(words, NEAR_WORDS)
                s = np.unique(hashes)
                name = int.from_bytes(xxhash.xxh3_64_digest(b" ".join(words), SEED), "big", signed=True)
                prefix = order(s)[: len(s) - -(-len(s) * ALIKE.numerator // ALIKE.denominator) + 1].view(np.int64)
                for column, value in zip(out, (name, _majority(hashes) if words else 0, *wide_fingerprint(words), len(s), prefix), strict=True):
                    column.append(value)
            columns = [*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.int32()), pa.array(out[5], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns], ["key", "id", "t", "fp", "hi", "lo", "n", "prefix"])
        give_back()

    kept = docs.select(F.col("__tessera_key").alias("key"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    return kept.mapInArrow(score, f"key long, id {kept.schema['id'].dataType.simpleString()}, t long, fp long, hi long, lo long, n int, prefix array<long>")


def _shingles(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, s): the distinct hashes of a text's five-word shingles, for rows with a column __tessera_key."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashed = [np.unique(_hashes(_words(t.as_py()), NEAR_WORDS)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashed, pa.list_(pa.int64()))], ["key", "s"])
        give_back()

    return docs.select("__tessera_key", text_col).mapInArrow(cut, "key long, s array<long>")


def _common(docs: DataFrame, text_col: str) -> np.ndarray:
    """The most frequent shingles of one row in ``COMMON_SHARE``, from the rarest, at most ``COMMON``. They order prefixes, which decides the speed of the join alone."""
    some = docs.where(F.pmod("__tessera_key", F.lit(COMMON_SHARE)) == 0)
    count = _shingles(some, text_col).select(F.explode("s").alias("w")).groupBy("w").agg(F.count("*").alias("c")).where("c > 3")
    found = count.orderBy(F.desc("c"), "w").limit(COMMON).select("w").toArrow().column("w").to_numpy()
    return found[::-1].copy().view(np.uint64)


def _sets(docs: DataFrame, nodes: DataFrame, ends: DataFrame, text_col: str) -> DataFrame:
    """(t, s): the distinct shingles of the texts ``ends`` (t). ``nodes`` is (t, key), key naming the row of ``docs`` (by its column __tessera_key) that stands for the text."""
    named = written(nodes.join(ends.hint("merge"), "t").select("t", "key"), "ends")
    texts = docs.join(named.select(F.col("key").alias("__tessera_key")).hint("merge"), "__tessera_key", "left_semi")
    return written(_shingles(texts, text_col).dropDuplicates(["key"]).join(named.hint("merge"), "key").select("t", "s"), "shingles", BATCH_ROWS)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (src, dst, ...) whose ``sets`` (t, s) have a Jaccard similarity of ``ALIKE`` or more."""
    a, b = sets.select(F.col("t").alias("src"), F.col("s").alias("x")), sets.select(F.col("t").alias("dst"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = both * (ALIKE.numerator + ALIKE.denominator) >= ALIKE.numerator * (F.size("x") + F.size("y"))
    return pairs.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where(enough).select(*pairs.columns)


def alike_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``pairs`` (src, dst, ...) whose five-word Jaccard similarity is ``ALIKE`` or more, counted over whole texts.

    ``nodes`` is (t, key) as in ``_sets``.
    """
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("src").alias("t")).union(pairs.select("dst")).distinct()
    return _alike(pairs, _sets(docs, nodes, ends, text_col))


def prefix_classes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs) of ``nodes`` (t, n, prefix, root), complete for a similarity of ``ALIKE`` between texts of different roots.

    All texts of a root and of one size that share a word of their prefixes with another root are a class; ``texts`` is (t, root, n).
    ``pairs`` (one, m, k, other, n, l), k and l counting the texts, are the classes of different roots that may hold texts that are alike.
    Classes meet on words, not texts, so the members of a large class cost no row for each class that they meet. What two sets share lies in
    both prefixes or behind the prefix that ends first, so the prefixes must share what the rest can't give. Two texts share no more words
    than their classes do, and no more than either has in common with any other root; where that is too few, the classes part.
    """
    p, d = ALIKE.numerator, ALIKE.denominator
    dealt = nodes.select("t", "n", "root", F.explode("prefix").alias("w")).repartition("w")
    mixed = dealt.groupBy("w").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("w")
    texts = written(dealt.join(mixed.hint("merge"), "w").groupBy("t", "root", "n").agg(F.collect_list("w").alias("words")), "prefixes")
    whole = texts.groupBy("root", "n").agg(F.max(F.size("words")).alias("most"), F.count("*").alias("texts"))
    words = texts.select("root", "n", F.explode("words").alias("w")).distinct()
    places = written(words.join(whole.hint("merge"), ["root", "n"]).withColumn("rest", F.ceil(F.col("n") * p / d).cast("int") - 1), "places")
    a, b = places.toDF("one", "m", "w", "u", "k", "after"), places.toDF("other", "n", "w", "v", "l", "rest")
    need = (F.col("m") + F.col("n")) * p - F.greatest("after", "rest") * (p + d)
    near = (F.col("m") * d >= F.col("n") * p) & (F.col("n") * d >= F.col("m") * p) & (F.least("u", "v") * (p + d) >= need)
    met = a.join(b.hint("merge"), (a["w"] == b["w"]) & (F.col("one") < F.col("other")) & near)
    shared = met.groupBy("one", "m", "k", "other", "n", "l").agg(F.count("*").alias("c"), F.min(need).alias("need"))
    pairs = written(shared.where(F.col("c") * (p + d) >= F.col("need")).drop("c", "need"), "classes")
    held = pairs.select(F.col("one").alias("root"), F.col("m").alias("n")).union(pairs.select("other", "n")).distinct()
    return written(texts.select("t", "root", "n").join(held.hint("merge"), ["root", "n"], "left_semi"), "held"), pairs


def _centres(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, m, centre): of the texts of each class of ``members`` (hub, m, t), the one that shares most with all of them."""
    has = members.join(sets.hint("merge"), "t").select("hub", "m", "t", F.explode("s").alias("w"))
    often = has.groupBy("hub", "m", "w").agg(F.count("*").alias("c"))
    shared = has.join(often.hint("merge"), ["hub", "m", "w"]).groupBy("hub", "m", "t").agg(F.sum("c").alias("c"))
    return shared.groupBy("hub", "m").agg(F.max(F.struct("c", "t")).alias("most")).select("hub", "m", F.col("most.t").alias("centre"))


def _apart(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (t, centre, ...) with ``z``, the shingles that one of the texts ``t`` and ``centre`` has and the other lacks."""
    salt = F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int").alias("salt")
    x = rows.join(sets.withColumnRenamed("s", "x").hint("merge"), "t").select("*", salt)
    few = sets.join(rows.select(F.col("centre").alias("t")).distinct().hint("merge"), "t")
    y = few.select(F.col("t").alias("centre"), F.col("s").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    z = F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("z")
    return x.join(y.hint("merge"), ["centre", "salt"]).select(*rows.columns, z)


def class_pairs(texts: DataFrame, pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, rest) of ``pairs`` of classes: links (one, other) of roots, and all pairs (src, dst, one, other) of texts that may be alike where there is none.

    Texts are told by what sets them apart from the centre of the larger class. Sets of m and n shingles are alike where
    they differ in at most T = (m + n)(d - p) / (d + p) places; the centre has the size of its class, so two classes have one T.
    A text within T of the centre is a link. If another, farther by z > T, is alike to a member that is y off the centre, both share at
    least (z + y - T) / 2 of these differences, over half of the member's. So among any y - (z + y - T) / 2 + 1 of the member's is one of
    the text's; those that the fewest texts have are taken. Rows grow with the members and the texts, not with their product,
    unless they share such rare differences.
    """
    p, d = ALIKE.numerator, ALIKE.denominator
    one, other = (F.struct(F.col(r).alias("root"), F.col(n).alias("n")) for r, n in (("one", "m"), ("other", "n")))
    dealt = pairs.select(F.when(F.expr("k >= l"), one).otherwise(other).alias("a"), F.when(F.expr("k >= l"), other).otherwise(one).alias("b"))
    dealt = dealt.select(F.col("a.root").alias("hub"), F.col("a.n").alias("m"), F.col("b.root").alias("far"), F.col("b.n").alias("n"))
    of_hub, of_far = texts.withColumnsRenamed({"root": "hub", "n": "m"}), texts.withColumnRenamed("root", "far")
    members = written(of_hub.join(dealt.select("hub", "m").distinct().hint("merge"), ["hub", "m"]).select("hub", "m", "t"), "members")
    centres = written(_centres(members, sets), "centres")
    others = dealt.join(of_far.hint("merge"), ["far", "n"]).join(centres.hint("merge"), ["hub", "m"])
    others = written(_apart(others, sets).withColumn("most", (F.col("m") + F.col("n")) * (d - p)), "others")
    links = written(others.where(F.size("z") * (p + d) <= F.col("most")).select("hub", "far").distinct(), "links")
    still = written(others.join(links.hint("merge"), ["hub", "far"], "left_anti"), "still")
    told = still.select("hub", "m", "far", "most", F.col("t").alias("dst"), F.size("z").alias("off"), F.explode("z").alias("w"))
    often = told.groupBy("hub", "m", "w").agg(F.count("*").alias("c"))
    around = members.join(still.select("hub", "m", "centre").distinct().hint("merge"), ["hub", "m"])
    own = _apart(around, sets).select("hub", "m", F.col("t").alias("src"), F.size("z").alias("size"), F.explode("z").alias("w"))
    counted = own.join(often.hint("merge"), ["hub", "m", "w"], "left").groupBy("hub", "m", "src", "size")
    ranked = counted.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "w"))).alias("z"))
    half = ranked.select("hub", "m", "src", "size", F.posexplode(F.slice("z", F.lit(1), F.expr("int((size + 1) div 2)"))).alias("at", "e")).where("e.c > 0")
    enough = (2 * F.col("at") + F.col("off") - F.col("size")) * (p + d) <= F.col("most")
    named = half.select("hub", "m", "src", "size", "at", F.col("e.w").alias("w"))
    met = named.join(told.withColumnRenamed("w", "v").hint("merge"), (named["hub"] == told["hub"]) & (named["m"] == told["m"]) & (F.col("w") == F.col("v")) & enough)
    return links.toDF("one", "other"), met.select("src", "dst", named["hub"].alias("one"), F.col("far").alias("other")).distinct()


def rest_links(docs: DataFrame, nodes: DataFrame, rooted: DataFrame, text_col: str = "text") -> DataFrame:
    """(one, other): links of roots of ``rooted`` (t, n, prefix, root), each for two texts that are alike; two roots with such texts have one or more.

    Classes of one text are compared first, larger ones by ``class_pairs``. ``docs`` and ``nodes`` are as in ``alike_links``.
    """
    texts, pairs = prefix_classes(rooted)
    sets = _sets(docs, nodes, texts.select("t"), text_col)
    x, y = texts.toDF("one", "m", "src"), texts.toDF("other", "n", "dst")
    single = pairs.where("k + l = 2").join(x.hint("merge"), ["one", "m"]).join(y.hint("merge"), ["other", "n"])
    found = written(_alike(single.select("src", "dst", "one", "other"), sets).select("one", "other").distinct(), "found")
    links, rest = class_pairs(texts, pairs.where("k + l > 2").join(found.hint("merge"), ["one", "other"], "left_anti"), sets)
    return found.unionAll(links).unionAll(_alike(rest, sets).select("one", "other"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id, null ids last, then the smallest ``row_key``.

    Rows are told apart by all their columns, so ids may be null or repeat; of rows
    equal in all columns one stays. Null and empty texts are copies of one another.
    """
    keyed = docs.withColumn("__tessera_key", row_key(docs))
    stay = concluded(docs.sparkSession, "stay", lambda: _staying(keyed, id_col, text_col))
    return keyed.join(stay.hint("merge"), F.col("__tessera_key") == F.col("__tessera_stay"), "left_semi").dropDuplicates(["__tessera_key"]).select(*docs.columns)


def _staying(keyed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__tessera_stay): the keys of the rows of ``keyed`` that ``keep_one`` keeps. Tables of a step are deleted once its links are written."""
    spark = keyed.sparkSession
    rows = written(_described(keyed, id_col, text_col, _common(keyed, text_col)), "described", BATCH_ROWS)
    ranked = rows.withColumn("order", F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    nodes = written(ranked.groupBy("t").agg(F.min(F.struct("order", "fp", "hi", "lo", "n", "prefix")).alias("m")).select("t", "m.*"), "nodes")
    texts = nodes.select("t", "order.key")
    # a text stands for each fingerprint
    stands = written(nodes.groupBy("fp").agg(F.min("t").alias("t")), "stands")
    equal = nodes.select("fp", F.col("t").alias("src")).join(stands.hint("merge"), "fp").where("src <> t").select("src", F.col("t").alias("dst"))
    a, b = stands.select(F.col("fp").alias("src"), F.col("t").alias("a")), stands.select(F.col("fp").alias("dst"), F.col("t").alias("b"))
    near = grid_links(stands.select("fp")).join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select("a", "b")
    cells = nodes.select(F.col("t").alias("fp"), "hi", "lo", "order.id")
    wide = concluded(spark, "wide", lambda: alike_links(keyed, texts, wide_links(cells), text_col))
    member = connected_components(equal.unionAll(near).unionAll(wide))
    rooted = nodes.join(member.hint("merge"), nodes["t"] == member["node"], "left").withColumn("root", F.coalesce("root", "t"))
    rooted = written(rooted.select("t", "n", "prefix", "root", "order"), "rooted")
    rest = concluded(spark, "rest", lambda: rest_links(keyed, texts, rooted, text_col))
    joined = connected_components(rest, "one", "other").withColumnRenamed("root", "whole")
    grouped = rooted.join(joined.hint("merge"), rooted["root"] == joined["node"], "left").groupBy(F.coalesce("whole", "root")).agg(F.min("order").alias("order"))
    return grouped.select(F.col("order.key").alias("__tessera_stay"))
