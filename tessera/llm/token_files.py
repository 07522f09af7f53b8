"""Token-ID files in patched frame-of-reference blocks.

Layout of one file, little-endian: magic ``PFB1``, then u32 block length, u64 number
of ids, u32 number of documents, u32 number of blocks, u64 payload bytes and u32 exceptions; per document i64
id, u8 whether the id is present, u64 ids with the end id; the block index (u64 offset of the block's packed bits in the
payload, u32 minimum, u8 width, u32 number of exceptions before it); the payload;
exceptions (u16 place in the block, u32 rest above the minimum). A block holds
the ids less their minimum, packed at the smallest width that a set share of
them fits; the others pack as zero and stand in the exception list.

A file's image is one binary value of a Parquet table in the shared folder, so
that it is written by Spark's committer to any store and a lost task leaves
nothing behind; ``export`` writes the images as plain files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.workers import BATCH_ROWS, give_back
from tessera.plans.storage import written

END_ID = 0
BLOCK_IDS = 1024
#: Share of a block's ids that the chosen width must fit.
FIT = 0.95
#: A file closes with the document that reaches this many ids; its image then stays below
#: half of the smallest heap region, from which on the JVM gives a value regions of its own.
FILE_IDS = 1 << 17
#: Pieces of a worker's memory, bytes of the longest one that it holds, bytes of text that
#: are encoded at once (one text at least), and words that are joined for the library.
CACHE_PIECES = 300_000
CACHE_BYTES = 64
SLICE_BYTES = 4 << 20
JOINED = 50
_MAGIC = b"PFB1"
_HEAD = np.dtype([("block", "<u4"), ("ids", "<u8"), ("docs", "<u4"), ("blocks", "<u4"), ("payload", "<u8"), ("exceptions", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("present", "u1"), ("ids", "<u8")])
_INDEX = np.dtype([("offset", "<u8"), ("least", "<u4"), ("width", "u1"), ("exceptions", "<u4")])
_EXCEPTION = np.dtype([("place", "<u2"), ("rest", "<u4")])
#: A space before another character always begins a new piece of the pre-tokenizer, whatever stands before it.
_CUT = re.compile(r"(?= \S)")


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(public_tokenizers.path(name) if not os.path.isabs(name) else name)


class Encoder:
    """Encodes whole texts with a byte-level BPE file; remembers the ids of pieces between cut points.

    The texts of a slice are split by Arrow and their pieces numbered by Arrow's
    dictionary, a full stop or comma after a letter apart, so that each distinct piece
    of a slice is looked up once and only unknown ones become Python strings; numpy
    gathers the ids of all occurrences. The memory is an Arrow array of pieces with
    their ids side by side. Where it is over ``CACHE_PIECES``, the half met least goes.
    """

    def __init__(self, name: str) -> None:
        tokenizer = _tokenizer(name)
        self._library = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self._spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes begin with a space
        self._spaced[[k for token, k in vocabulary.items() if token.startswith("Ġ")]] = True
        self._marks = self._encoded([".", ","])
        self._pieces = pa.array([], pa.string())
        self._known = Listed.of([])
        self._met = np.zeros(0, np.int64)

    def _encoded(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(c.ids, np.uint32) for c in self._library(pieces, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Listed:
        """Ids of words, each after a space. Words are joined and their ids parted again where a token begins
        with a space, as the library takes far longer for many short texts; a word with a space goes alone."""
        joined = [i for i, w in enumerate(words) if " " not in w]
        chunks = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        packed = self._encoded([" " + " ".join([words[i] for i in c]) for c in chunks])
        fits = [int(self._spaced[x].sum()) == len(c) for c, x in zip(chunks, packed, strict=True)]
        together = [i for c, ok in zip(chunks, fits, strict=True) if ok for i in c]
        single = sorted(set(range(len(words))).difference(together))
        flat = np.concatenate([np.zeros(0, np.uint32), *(x for x, ok in zip(packed, fits, strict=True) if ok)])
        starts = np.flatnonzero(self._spaced[flat])
        found = Listed(flat, np.diff(np.append(starts, len(flat)))).plus(Listed.of(self._encoded([" " + words[i] for i in single])))
        return found.take(np.argsort(together + single, kind="stable"))

    def _coded(self, pieces: pa.Array, counts: np.ndarray) -> Listed:
        """Ids of distinct pieces that occur ``counts`` times, each after a space."""
        ends, raw = _raw(pieces)
        last = raw[np.maximum(ends - 1, 0)]
        before, lead = raw[np.maximum(ends - 2, 0)], raw[np.maximum(ends - 3, 0)]
        size = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
        # Latin letters of one or two bytes; after them a mark is a piece of its own
        letter = ((before | 32) >= 0x61) & ((before | 32) <= 0x7A)
        letter |= (size > 2) & (lead == 0xC3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7)
        marked = (size > 1) & letter & ((last == 0x2E) | (last == 0x2C))
        plain, stemmed = np.flatnonzero(~marked), np.flatnonzero(marked)
        stems = pa.concat_arrays([pieces.take(pa.array(plain)), pc.utf8_slice_codeunits(pieces.take(pa.array(stemmed)), 0, -1)])
        numbered = stems.dictionary_encode()
        codes = np.empty(len(pieces), np.int64)
        codes[np.concatenate((plain, stemmed))] = numbered.indices.to_numpy()
        stems = numbered.dictionary
        met = np.bincount(codes, counts, len(stems)).astype(np.int64)
        slots = pc.fill_null(pc.index_in(stems, value_set=self._pieces), -1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(slots < 0)
        slots[unknown] = len(self._known) + np.arange(len(unknown))
        np.add.at(self._met, slots[slots < len(self._met)], met[slots < len(self._met)])
        missing = stems.take(pa.array(unknown))
        every = self._known.plus(self._words(missing.to_pylist()))
        every = every.plus(Listed.of(self._marks))
        pairs = np.full(2 * len(pieces), -1, np.int64)
        pairs[::2] = slots[codes]
        pairs[1::2][marked] = np.where(last[marked] == 0x2E, len(every) - 2, len(every) - 1)
        out = every.groups(pairs[pairs >= 0], 1 + marked)
        self._remember(missing, every, met[unknown])
        return out

    def _remember(self, missing: pa.Array, every: Listed, met: np.ndarray) -> None:
        """Add ``missing``, whose ids follow the known ones in ``every``, less pieces that are long."""
        short = np.flatnonzero(pc.binary_length(missing).to_numpy(zero_copy_only=False) <= CACHE_BYTES)
        held = np.concatenate((np.arange(len(self._known)), len(self._known) + short))
        pieces = pa.concat_arrays([self._pieces, missing.take(pa.array(short))])
        counts = np.concatenate((self._met, met[short]))
        if len(held) > CACHE_PIECES:
            often = np.sort(np.argsort(-counts, kind="stable")[: CACHE_PIECES // 2])
            held, pieces, counts = held[often], pieces.take(pa.array(often)), counts[often] // 2
        self._pieces, self._known, self._met = pieces, every.take(held), counts

    def slice(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all ``texts`` in turn, number of ids of each); with ``end`` that id closes each text."""
        split = pc.split_pattern(texts, " ")
        n, bounds = len(texts), split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        numbered = split.flatten().dictionary_encode()
        codes, pieces = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary
        firsts = codes[bounds[:-1]]
        counts = np.bincount(codes, minlength=len(pieces)) - np.bincount(firsts, minlength=len(pieces))
        odd = _odd(pieces)
        if counts[odd].any():  # a space before white space or at the end is no cut point
            inner = odd[codes]
            inner[bounds[:-1]] = False
            return self._with_odd(texts, np.unique(np.searchsorted(bounds, np.flatnonzero(inner), "right") - 1), end)
        wanted = np.flatnonzero(counts)
        place = np.zeros(len(pieces), np.int64)
        place[wanted] = np.arange(len(wanted))
        coded = self._coded(pieces.take(pa.array(wanted)), counts[wanted]).plus(Listed.of(self._encoded(pieces.take(pa.array(firsts)).to_pylist())))
        codes = place[codes]
        codes[bounds[:-1]] = len(wanted) + np.arange(n)
        if end is not None:
            codes = np.insert(codes, bounds[1:], len(coded))
            coded = coded.plus(Listed.of([np.array([end], np.uint32)]))
            bounds = bounds + np.arange(n + 1)
        got = coded.groups(codes, np.diff(bounds))
        return got.flat, got.sizes

    def _with_odd(self, texts: pa.Array, whole: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """``slice`` where the texts at ``whole`` hold spaces that are no cut points."""
        plain = np.setdiff1d(np.arange(len(texts)), whole)
        closing = [] if end is None else [np.array([end], np.uint32)]
        found = Listed(*self.slice(texts.take(pa.array(plain)), end)) if len(plain) else Listed.of([])
        for k in whole.tolist():
            first, *rest = _CUT.split(texts[k].as_py())
            numbered = pa.array([p[1:] for p in rest], pa.string()).dictionary_encode()
            codes = numbered.indices.to_numpy().astype(np.int64)
            coded = self._coded(numbered.dictionary, np.bincount(codes, minlength=len(numbered.dictionary)))
            ids = np.concatenate([*self._encoded([first]), coded.groups(codes, np.array([len(codes)])).flat, *closing])
            found = found.plus(Listed.of([ids]))
        ordered = found.take(np.argsort(np.concatenate((plain, whole)), kind="stable"))
        return ordered.flat, ordered.sizes

    def __call__(self, text: str) -> np.ndarray:
        return self.slice(pa.array([text], pa.string()))[0]


class Listed:
    """Lists of ids, one after another in one array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes = flat, sizes.astype(np.int64)

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Listed:
        return cls(np.concatenate([np.zeros(0, np.uint32), *lists]), np.fromiter(map(len, lists), np.int64, len(lists)))

    def __len__(self) -> int:
        return len(self.sizes)

    def plus(self, other: Listed) -> Listed:
        return Listed(np.concatenate((self.flat, other.flat)), np.concatenate((self.sizes, other.sizes)))

    def take(self, which: np.ndarray) -> Listed:
        return self.groups(which, np.ones(len(which), np.int64))

    def groups(self, which: np.ndarray, many: np.ndarray) -> Listed:
        """The lists ``which`` in turn, so ``many`` of them joined each time."""
        starts = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(starts[which] - ends[:-1], sizes)
        at += np.arange(len(at))
        return Listed(self.flat[at], np.diff(ends[np.concatenate(([0], np.cumsum(many)))]))


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(end of each text, bytes) of a string array; one byte at least, so that an empty array can be asked."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return ends[1:], np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(1, np.uint8)


def _odd(pieces: pa.Array) -> np.ndarray:
    """Whether each piece is empty or begins with white space."""
    ends, raw = _raw(pieces)
    sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
    first = raw[np.minimum(ends - sizes, len(raw) - 1)]
    odd = (sizes == 0) | ((first >= 9) & (first <= 13)) | ((first >= 28) & (first <= 32))
    rest = np.flatnonzero((sizes > 0) & np.isin(first, (0xC2, 0xE1, 0xE2, 0xE3)))  # first bytes of other white space
    odd[rest] = [p[0].isspace() for p in pieces.take(pa.array(rest)).to_pylist()]
    return odd


def _slices(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` (id, text) in turn, in batches that hold ``size`` bytes of text with their last row or at the end."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size - total)) + 1
            held.append(b.slice(at, upto - at))
            total += int(ends[min(upto, b.num_rows) - 1] - (ends[at - 1] if at else 0))
            at = upto
            if total >= size:
                yield pa.concat_batches(held)
                held, total = [], 0
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder a worker process, so that its memory outlasts a task."""
    return Encoder(name)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of packed bytes, most significant bit first."""
    if width == 16:
        return values.astype(">u2").view(np.uint8)
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((values[:, :, None] >> shifts) & 1).astype(np.uint8).reshape(len(values), -1), axis=1)


def _unpack(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    if width == 16:
        return np.ascontiguousarray(packed).view(">u2").astype(np.uint32)
    bits = np.unpackbits(packed, axis=1)[:, : count * width].reshape(len(packed), count, width)
    total = np.zeros((len(packed), count), np.uint32)
    for k in range(width):
        total = (total << 1) | bits[:, :, k]
    return total


def encode_file(ids: np.ndarray, docs: list[tuple[int | None, int]], block: int = BLOCK_IDS, fit: float = FIT) -> bytes:
    """The image of one file: ``ids`` of all its documents, and (id, number of ids) of each."""
    n = -(-len(ids) // block)
    padded = np.concatenate((ids, np.full(n * block - len(ids), ids[-1] if len(ids) else 0, ids.dtype))).reshape(n, block)
    least = padded.min(axis=1) if n else np.zeros(0, np.uint32)
    rest = (padded - least[:, None]).astype(np.uint32)
    at = min(block - 1, int(np.ceil(fit * block)) - 1)
    fitting = np.partition(rest, at, axis=1)[:, at] if n else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(fitting.astype(np.float64) + 1)).astype(np.uint8)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    rows, places = np.nonzero(over)
    exceptions = np.zeros(len(rows), _EXCEPTION)
    exceptions["place"], exceptions["rest"] = places, rest[rows, places]
    rest[over] = 0
    sizes = (width.astype(np.int64) * block + 7) // 8
    index = np.zeros(n, _INDEX)
    index["offset"], index["least"], index["width"] = np.cumsum(sizes) - sizes, least, width
    counts = np.bincount(rows, minlength=n)
    index["exceptions"] = np.cumsum(counts) - counts
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            own = np.nonzero(width == w)[0]
            spots = index["offset"][own].astype(np.int64)[:, None] + np.arange(int(sizes[own[0]]))
            payload[spots] = _pack(rest[own], int(w))
    listed = np.array([(d or 0, d is not None, k) for d, k in docs], _DOC)
    head = np.array([(block, len(ids), len(docs), n, len(payload), len(exceptions))], _HEAD)
    return b"".join((_MAGIC, head.tobytes(), listed.tobytes(), index.tobytes(), payload.tobytes(), exceptions.tobytes()))


def decode_file(image: bytes) -> tuple[np.ndarray, list[tuple[int | None, int]]]:
    """Ids and (id, number of ids) of each document of one file."""
    if image[:4] != _MAGIC:
        raise ValueError("not a token file")
    place = 4

    def take(kind: np.dtype, count: int) -> np.ndarray:
        nonlocal place
        got = np.frombuffer(image, kind, count, place)
        place += count * kind.itemsize
        return got

    head = take(_HEAD, 1)[0]
    docs = take(_DOC, int(head["docs"]))
    index = take(_INDEX, int(head["blocks"]))
    payload = take(np.dtype("u1"), int(head["payload"]))
    exceptions = take(_EXCEPTION, int(head["exceptions"]))
    block, n = int(head["block"]), len(index)
    rest = np.zeros((n, block), np.uint32)
    for w in np.unique(index["width"]):
        if w:
            own = np.nonzero(index["width"] == w)[0]
            spots = index["offset"][own].astype(np.int64)[:, None] + np.arange((int(w) * block + 7) // 8)
            rest[own] = _unpack(payload[spots], int(w), block)
    bounds = np.append(index["exceptions"], len(exceptions)).astype(np.int64)
    rest[np.repeat(np.arange(n), np.diff(bounds)), exceptions["place"]] = exceptions["rest"]
    ids = (rest + index["least"][:, None].astype(np.uint32)).reshape(-1)[: int(head["ids"])]
    return ids, [(int(d["id"]) if d["present"] else None, int(d["ids"])) for d in docs]


def write_files(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json",
    partitions: int | None = None, end_id: int = END_ID,
) -> DataFrame:
    """The written table of file images (part, file, n_ids, image), in ascending order of ids over (part, file).

    Ids are integers. Null ids come first; rows of equal ids follow in the order of their texts. Null
    texts are empty. ``tokenizer`` is a name that ``public_tokenizers`` knows or an absolute path.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = kept.repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer)
        ids: list[np.ndarray] = []
        listed: list[tuple[int | None, int]] = []
        size = 0

        def close() -> pa.RecordBatch:
            image = encode_file(np.concatenate(ids), listed)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([size], pa.int64()), pa.array([image], pa.large_binary())],
                ["part", "file", "n_ids", "image"],
            )

        for some in _slices(batches, SLICE_BYTES):
            got, sizes = encode.slice(some.column(1), end_id)
            began = 0
            for doc, upto, k in zip(some.column(0).to_pylist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                listed.append((doc, k))
                size += k
                if size >= FILE_IDS:
                    ids.append(got[began:upto])
                    yield close()
                    ids, listed, size, file, began = [], [], 0, file + 1, upto
            if began < len(got):
                ids.append(got[began:])
        if listed:
            yield close()
        del ids, listed
        give_back()

    return written(ordered.mapInArrow(files, "part int, file int, n_ids long, image binary"), "token-files", BATCH_ROWS)


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the images alone.

    ``start`` counts the ids of all documents before it: files before it, by sums
    over parts and then over a part's files, and documents before it in its file.
    """
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    up_to = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    parts = sums.select("part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    within = W.partitionBy("part").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    bases = files.select("part", "file", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("earlier")).join(parts, "part")

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids, docs = decode_file(image.as_py())
                ends = np.cumsum([k for _, k in docs])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, (_, k) in zip(ends.tolist(), docs, strict=True)]
                n = len(docs)
                columns = [pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array([d for d, _ in docs], pa.int64())]
                columns += [pa.array(ends - [k for _, k in docs], pa.int64()), pa.array([k for _, k in docs], pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "file", "doc_id", "at", "n_tokens", "ids_crc32"])

    schema = "part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long"
    read = files.select("part", "file", "image").mapInArrow(documents, schema)
    return read.join(bases, ["part", "file"]).select(
        "doc_id", (F.col("before") + F.col("earlier") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def export(files: DataFrame, folder: str) -> list[str]:
    """Write every image as a file of its own below a local folder, one at a time; returns their names."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for row in files.select("part", "file", "image").toLocalIterator():
        names.append(os.path.join(folder, f"{row['part']:06d}-{row['file']:06d}.pfb"))
        with open(names[-1], "wb") as out:
            out.write(row["image"])
    return names
