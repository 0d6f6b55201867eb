"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern. First tier: a pre-token that is in the vocabulary as a whole is
resolved by a minimal perfect hash over the vocabulary's byte strings (hash and displace: each bucket of keys has a
displacement that sends its keys to slots of their own, as many slots as keys; the slot's bytes are compared, so a foreign
string is never taken for a key). Second tier: other pre-tokens are merged byte by byte: their parts are a linked list, and
a heap holds every neighbouring pair that the vocabulary joins, by rank and then from the left, until none is left.

Both tiers are asked once for each distinct pre-token that a worker meets, within a bounded cache. The vocabulary is read on
the driver, as its size is that of a file of ranks, and is broadcast. Texts are encoded by the row in stretches of about
``STRETCH`` characters, cut where no pre-token can cross, so memory is bounded by a row's text and its ids.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokens of the vocabularies ``byte_bpe_50k`` and ``byte_bpe_multi_50k`` (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at once, distinct pre-tokens a worker remembers, and ids sent to Spark in one batch.
STRETCH, REMEMBERED, BATCH_IDS = 1 << 18, 500_000, 1 << 20
#: Keys for each displacement of the hash, about.
LOAD = 4
#: A heap entry is a rank above the place of a pair's left part; NONE is above all ranks.
PLACE, NONE = (1 << 40) - 1, 1 << 31
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file (a base64 byte string and its rank on each line), read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64)


class PerfectHash:
    """A minimal perfect hash: ``len(keys)`` slots, each of which holds one key."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // LOAD)
        h = hashes(keys)
        if len(np.unique(h)) < self.n:
            raise ValueError("keys must be distinct, and so must their 64-bit hashes")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends, taken = np.cumsum(sizes), np.zeros(self.n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        slot_of = np.zeros(self.n, np.int64)
        free = None
        for b in np.argsort(-sizes, kind="stable"):
            own = order[ends[b] - sizes[b] : ends[b]]
            if len(own) == 1:  # what is left is dealt to the free slots directly: -1 - slot stands for a displacement
                free = iter(np.flatnonzero(~taken)) if free is None else free
                slot = np.array([next(free)])
                self.shift[b] = -1 - slot[0]
            elif len(own):
                for first in itertools.count(0, 64):
                    tried = self._slots(h[own][None, :], np.arange(first, first + 64, dtype=np.uint64)[:, None])
                    apart = (np.diff(np.sort(tried, 1), axis=1) > 0).all(1) & ~taken[tried].any(1)
                    if apart.any():
                        k = int(np.argmax(apart))
                        slot, self.shift[b] = tried[k], first + k
                        break
            else:
                continue
            taken[slot] = True
            slot_of[own] = slot
        self.key: list[bytes] = [b""] * self.n
        self.place = np.zeros(self.n, np.int64)  # the key's number in ``keys``, by slot
        self.place[slot_of] = np.arange(self.n)
        for i, s in enumerate(slot_of.tolist()):
            self.key[s] = keys[i]

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (h ^ (shift * _MIX)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Of each string its number among the keys; -1 if it is none."""
        if not strings or not self.n:
            return np.full(len(strings), -1)
        h = hashes(strings)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, self._slots(h, np.maximum(shift, 0).astype(np.uint64)))
        key = self.key
        same = np.fromiter((key[s] == x for s, x in zip(slot.tolist(), strings, strict=True)), bool, len(strings))
        return np.where(same, self.place[slot], -1)


class Vocabulary:
    """Ranks with their perfect hash and the pairs that join: ``(left << 32) | right`` to the rank of both together."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        keys = list(ranks)
        self.whole, self.rank = PerfectHash(keys), np.array([ranks[k] for k in keys], np.int64)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pair: dict[int, int] = {}
        for key, rank in ranks.items():
            for i in range(1, len(key)):
                left, right = ranks.get(key[:i]), ranks.get(key[i:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = rank
        self.encoders: dict[str, Encoder] = {}

    def encoder(self, pattern: str) -> Encoder:
        """A worker's own encoder: the tasks that it runs one after the other share what it remembers."""
        if pattern not in self.encoders:
            self.encoders[pattern] = Encoder(self, pattern)
        return self.encoders[pattern]

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token that is not in the vocabulary as a whole: a heap over linked bytes.

        ``join[i]`` is the rank of the pair that starts at part ``i`` now (``NONE``: no pair), so what a heap entry says of
        a pair that has changed since is told by one comparison.
        """
        n, pair, single = len(piece), self.pair.get, self.single
        part = [single[b] for b in piece]
        join = [pair(a << 32 | b, NONE) for a, b in zip(part, part[1:], strict=False)]
        heap = [r << 40 | i for i, r in enumerate(join) if r < NONE]
        if not heap:
            return part
        join.append(NONE)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & PLACE, top >> 40
            if join[i] != rank:
                continue  # one of the two has been joined with another meanwhile
            j = following[i]
            part[i], part[j], join[j] = rank, -1, NONE
            k = following[i] = following[j]
            r = NONE
            if k < n:
                before[k] = i
                r = pair(rank << 32 | part[k], NONE)
                if r < NONE:
                    heappush(heap, r << 40 | i)
            join[i] = r
            h = before[i]
            if h >= 0:
                r = join[h] = pair(part[h] << 32 | rank, NONE)
                if r < NONE:
                    heappush(heap, r << 40 | h)
        return [p for p in part if p >= 0]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, enlarged to twice what is asked for if it has fewer than ``n`` places."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(2 * n - len(x), x.dtype)])


def decoder(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All byte strings end to end by id, with the offsets of each (ids that are free have none)."""
    by_id = {i: b for b, i in ranks.items()}
    lens = np.zeros(max(by_id, default=-1) + 2, np.int64)
    for i, b in by_id.items():
        lens[i + 1] = len(b)
    return np.cumsum(lens), np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut between a letter and a space before a letter: a pre-token
    never goes on there, and neither side's pre-tokens look beyond it. A text without such a place stays whole."""
    first = 0
    while len(text) - first > size:
        cut = _CUT.search(text, first + size)
        if cut is None:
            break
        yield text[first : cut.start()]
        first = cut.start()
    yield text[first:]


class Encoder:
    """Encodes texts; distinct pre-tokens are numbered, and each number's ids lie in one array."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN, remembered: int = REMEMBERED):
        self.vocabulary, self.find, self.remembered = vocabulary, regex.compile(pattern, regex.V1).findall, remembered
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.held = np.zeros(1 << 16, np.int32), 0
        self.first, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        at = self.vocabulary.whole.find(raw)
        rank = self.vocabulary.rank[at]
        new = [[r] if k >= 0 else self.vocabulary.merged(b) for k, r, b in zip(at.tolist(), rank.tolist(), raw, strict=True)]
        known, lens = len(self.number), np.fromiter(map(len, new), np.int64, len(new))
        end = self.held + int(lens.sum())
        self.ids, self.first, self.lens = _room(self.ids, end), _room(self.first, known + len(new)), _room(self.lens, known + len(new))
        self.ids[self.held : end] = np.fromiter(itertools.chain.from_iterable(new), np.int32, end - self.held)
        self.first[known : known + len(new)] = self.held + np.cumsum(lens) - lens
        self.lens[known : known + len(new)] = lens
        self.held = end
        self.number.update(zip(pieces, range(known, known + len(new)), strict=True))

    def _stretch(self, text: str) -> np.ndarray:
        pieces = self.find(text)
        codes = np.fromiter(map(self.number.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = list(dict.fromkeys(pieces[i] for i in missing.tolist()))
            if len(self.number) + len(new) > self.remembered:
                self.forget()
                missing, new = np.arange(len(pieces)), list(dict.fromkeys(pieces))
            self._learn(new)
            codes[missing] = [self.number[pieces[i]] for i in missing.tolist()]
        lens = self.lens[codes]
        within = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        return self.ids[np.repeat(self.first[codes], lens) + within]

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([self._stretch(s) for s in stretches(text)])


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``: the ids of each whole text, as an array of ints.

    Null and empty texts have no ids. Every row is encoded on its own, so repeats are encoded alike; all columns are kept,
    but one called ``out_col`` is replaced; an empty table gives no rows. Special tokens are ordinary text.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    kept = [i for i, c in enumerate(docs.columns) if c.lower() != out_col.lower()]
    at = docs.columns.index(text_col)
    schema = StructType([*(docs.schema.fields[i] for i in kept), StructField(out_col, ArrayType(IntegerType(), False), False)])

    def run(batches):
        encoder = shared.value.encoder(pattern)
        for batch in batches:
            texts = batch.column(at)
            for a, b, parts in _held(encoder.encode((texts[i].as_py()) or "") for i in range(len(texts))):
                cut = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in kept), ids], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_ids(docs: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col``: the bytes that the ids of ``ids_col`` stand for, as binary (a text's own UTF-8 bytes).

    Null and empty arrays decode to no bytes; an id that the vocabulary lacks, or a null one, is an error. A column called
    ``out_col`` is replaced.
    """
    from pyspark.sql.types import BinaryType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(decoder(ranks))
    known = docs.sparkSession.sparkContext.broadcast(np.isin(np.arange(max(ranks.values()) + 1), list(ranks.values())))
    kept = [i for i, c in enumerate(docs.columns) if c.lower() != out_col.lower()]
    at = docs.columns.index(ids_col)
    schema = StructType([*(docs.schema.fields[i] for i in kept), StructField(out_col, BinaryType(), False)])

    def run(batches):
        offset, flat = shared.value
        for batch in batches:
            column = batch.column(at)
            for a, b, parts in _held(_decoded(column[i].values, offset, flat, known.value) for i in range(len(column))):
                raw = pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in kept), raw], names=schema.names)

    return docs.mapInArrow(run, schema)


def _decoded(ids: pa.Array | None, offset: np.ndarray, flat: np.ndarray, known: np.ndarray) -> bytes:
    if ids is None or not len(ids):
        return b""
    if ids.null_count:
        raise ValueError("null is no id")
    out = []
    for first in range(0, len(ids), STRETCH):
        own = ids[first : first + STRETCH].to_numpy()
        if own.min() < 0 or own.max() >= len(known) or not known[own].all():
            raise ValueError("an id that is not in the vocabulary")
        lens = offset[own + 1] - offset[own]
        within = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        out.append(flat[np.repeat(offset[own], lens) + within].tobytes())
    return b"".join(out)


def _held(results: Iterator, most: int = BATCH_IDS) -> Iterator[tuple[int, int, list]]:
    """(first, end, results) of runs of rows whose results have about ``most`` items together."""
    first, held, parts = 0, 0, []
    for i, x in enumerate(results):
        if parts and held + len(x) > most:
            yield first, i, parts
            first, held, parts = i, 0, []
        parts.append(x)
        held += len(x)
    if parts:
        yield first, first + len(parts), parts


def digests(docs: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded"):
    """Columns of the query: the number of ids, and digests of the ids in decimal and of the decoded bytes."""
    decimal = F.array_join(F.col(ids_col).cast("array<string>"), " ")
    return [F.size(ids_col).cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col(decoded_col), 256).alias("decoded_sha256")]
