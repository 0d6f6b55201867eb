"""Language-model scoring: causal self-attention on subword ids, with word counts of the whole corpus beside it.

A text is the stream of all subwords of its words, then an end; a subword that starts a word begins with a space, so a
stream reads as words in one way only. The network has one block of causal self-attention and gives the next subword's
group and its class within the group (two small softmaxes); a class's subwords share its mass by their counts in the whole
corpus. Groups are found by which texts subwords occur in, so that the context (its language, its topic) tells them apart;
subwords that start words and others are never in one class.

A word's probability, given that a word starts, is that of its first subword's class, times a mixture of two ways within
the class: by the word's share of all words there, in the whole corpus, and spelt, subword by subword, until the next one
starts a word. The second way's share is that of words seen once. Both ways are probabilities, so all words together have
at most 1, and a text's score is the log10 probability of its words and its end. Counts, shares, classes, the network and
scores cover all texts. The network starts from a few epochs over a bounded sample on the driver, then goes through every
training text: in each of ``ROUNDS`` rounds, each task takes the network through its own share of the round's texts, and
the tasks' networks are averaged, every row of them weighted by how often it was used. Classes likewise start from
the sample's directions of ids, which one pass over all training texts makes anew.

Scoring runs over windows of ``WINDOW`` subwords that overlap by ``WINDOW - STRIDE``: each subword is scored once, in the
first window that holds it (so with at least the overlap as context, but for a text's first window), in batches of
windows with a causal mask. The counts of words that the ``HEAD`` most frequent ones don't hold are joined.
"""

from __future__ import annotations

import base64
import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, staged
from .vectors import BLOCK, byte_column, groups, groups_of, held_out, mixed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Subword ids of the vocabulary, and the one that it leaves free, which ends a text.
IDS, END = 50_257, 50_256
WINDOW, STRIDE, DIM = 32, 28, 16
#: Groups of subwords that start words, of others, and classes in each.
FIRST, INNER, LEAVES = 10, 6, 16
GROUPS = FIRST + INNER
#: The network starts from at most this many whole texts (the least hashes of id), up to this many subwords.
SAMPLE_DOCS, SAMPLE_IDS = 3_000, 800_000
#: Rows at most of the table of frequent words that every task gets; all other words are joined.
HEAD = 131_072
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: All training texts: parts that follow one another, windows of a step, and the rate of the first round, which falls from one to the next.
ROUNDS, STEP, SLOW_RATE = 2, 256, 0.002
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def load_encoder(ranks: dict[bytes, int]):
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def word_starts(ranks: dict[bytes, int]) -> np.ndarray:
    """Whether a word starts at each id: those whose bytes begin with a space, and the END."""
    starts = np.zeros(IDS, bool)
    starts[[i for b, i in ranks.items() if b.startswith(b" ")] + [END]] = True
    return starts


def read_ranks(spark, path: str = TOKENIZER) -> dict[bytes, int]:
    """The vocabulary file, read by Spark (it may lie in any store); its size is that of a vocabulary."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").collect()
    return {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in lines)}


def word_subwords(encode, starts: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of all words end to end, and how many each has; a line end is the END.

    Words that hold no white space of any kind are encoded together: each begins with the only space before the next one.
    """
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    whole = " ".join(words)
    plain = range(len(words)) if whole.split() == words else [i for i, w in enumerate(words) if w.split() == [w]]
    joined = np.array(encode(" " + whole if len(plain) == len(words) else "".join([" " + words[i] for i in plain])), np.int32)
    cut, lens = np.flatnonzero(starts[joined]), np.zeros(len(words), np.int32)
    lens[plain] = np.diff(np.append(cut, len(joined)))
    if len(plain) == len(words):
        return joined, lens
    parts, at = [], 0
    for i, w in enumerate(words):
        own = joined[at : at + lens[i]] if lens[i] else np.array([END] if w == "\n" else encode(" " + w), np.int32)
        at, lens[i] = at + lens[i], len(own)
        parts.append(own)
    return np.concatenate(parts), lens


class Words:
    """The words of some texts: ``ids`` and ``lens`` of their subwords; and the texts as subwords."""

    def __init__(self, encode, starts: np.ndarray, texts: pa.Array, learn: np.ndarray):
        """``counts`` are those of the texts to ``learn`` from."""
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        flat = pieces.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        held = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[np.append(0, np.cumsum(pieces.value_lengths().to_numpy()))]
        own = flat.filter(full).dictionary_encode()
        whole = pc.binary_join(pa.ListArray.from_arrays([0, len(own.dictionary)], own.dictionary), " ").cast(pa.binary())[0].as_py()
        ids, lens = word_subwords(encode, starts, whole.decode("utf-8", "replace").split(" ") if whole else [])
        self.ids, self.lens = np.append(ids, END).astype(np.uint16), np.append(lens, 1)
        self.first = np.cumsum(self.lens) - self.lens
        sizes, self.number = np.diff(held) + 1, np.insert(own.indices.to_numpy(), held[1:], len(own.dictionary))  # the end is the last
        self.counts = np.bincount(self.number[np.repeat(learn, sizes)], minlength=len(self.lens))
        self.ends = np.cumsum(sizes)

    def streams(self, tokens: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """By runs of texts with about so many ``tokens``: first and end of the run, subwords of its texts end to end, the ends
        included, and how many each has."""
        first = begin = 0
        while first < len(self.ends):
            last = max(first + 1, int(np.searchsorted(self.ends, begin + tokens, side="right")))
            number = self.number[begin : self.ends[last - 1]]
            held = self.lens.take(number)
            ends = np.cumsum(held)
            at = np.repeat(self.first.take(number) - (ends - held), held)
            at += np.arange(len(at))
            yield first, last, self.ids.take(at), np.diff(np.append(0, ends[self.ends[first:last] - begin - 1]))
            first, begin = last, self.ends[last - 1]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words that were counted: keys, counts, first subwords; and the counts of all subwords in them."""
        i = np.flatnonzero(self.counts)
        total = np.bincount(self.ids, np.repeat(self.counts, self.lens), IDS).astype(np.int64)
        return word_keys(self.ids, self.first, self.lens)[i], self.counts[i], self.ids[self.first[i]], total


#: A random 64-bit value for each subword, by a fixed seed, so that all workers agree.
_ID_VALUE = np.random.default_rng(20_261).integers(1, 2**64, IDS, dtype=np.uint64)


def word_keys(flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word by its subwords, which are flat[at:at + len], end to end; they spell one word only."""
    if not len(at):
        return np.zeros(0, np.int64)
    power = np.full(int(lens.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = _ID_VALUE.take(flat)
    value *= power.take(np.arange(len(flat)) - np.repeat(at, lens))
    return mixed(np.add.reduceat(value, at) + lens.astype(np.uint64)).view(np.int64)


class Head:
    """Counts of frequent words by key; of words that share a slot the most frequent one stays, others count as not held."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int = 19):
        self.shift, order = np.uint64(64 - bits), np.argsort(counts, kind="stable")
        self.keys, self.counts = np.zeros(1 << bits, np.int64), np.zeros(1 << bits)
        slot = self._slots(keys[order])
        self.keys[slot], self.counts[slot] = keys[order], counts[order]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0: not held."""
        slot = self._slots(keys)
        return np.where(self.keys.take(slot) == keys, self.counts.take(slot), 0.0)


@dataclass
class Network:
    embed: np.ndarray  # ids x DIM
    place: np.ndarray  # WINDOW x DIM
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    top: np.ndarray  # 2 DIM + 1 x GROUPS: the attended and the last subword, and the bias
    low: np.ndarray  # GROUPS x 2 DIM + 1 x LEAVES
    group: np.ndarray  # group of each id
    leaf: np.ndarray  # class within it
    share: np.ndarray  # log10 share of each id in its class
    known: np.ndarray  # log10 of what a class leaves to each count of a known word, by group and class
    new: np.ndarray  # log10 of what it leaves to spelling

    def parts(self):
        return [self.embed, self.place, self.q, self.k, self.v, self.top, self.low]

    def rows(self) -> list[np.ndarray]:
        """Views of all that is learnt, as rows of ``DIM`` values; the first ``IDS`` rows are those of the ids."""
        return [p.reshape(-1, DIM) for p in self.parts()]


def topics(streams: list[np.ndarray], rounds: int = 3, size: int = 24, seed: int = 1) -> np.ndarray:
    """A direction for each id, alike for ids that occur in alike texts; 0 for ids that don't occur."""
    rng, out = np.random.default_rng(seed), np.zeros((IDS, size), np.float32)
    pairs = np.unique(np.concatenate([np.unique(x).astype(np.int64) * len(streams) + i for i, x in enumerate(streams)] or [np.zeros(0, np.int64)]))
    ids, docs = pairs // max(1, len(streams)), pairs % max(1, len(streams))
    n_id, n_doc = np.maximum(1, np.bincount(ids, minlength=IDS)), np.maximum(1, np.bincount(docs, minlength=len(streams)))
    doc = rng.normal(size=(len(streams), size))
    for _ in range(rounds if streams else 0):
        doc -= doc.mean(axis=0)
        doc /= np.linalg.norm(doc, axis=1, keepdims=True) + 1e-9
        for j in range(size):
            out[:, j] = np.bincount(ids, doc[docs, j], IDS) / n_id
        for j in range(size):
            doc[:, j] = np.bincount(docs, out[ids, j], len(streams)) / n_doc
    out /= np.linalg.norm(out, axis=1, keepdims=True) + 1e-9
    return out


def clusters(x: np.ndarray, mass: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """``k``-means by direction, each row weighted by the root of its mass."""
    if len(x) <= k:
        return np.arange(len(x))
    rng, weight = np.random.default_rng(seed), np.sqrt(mass)
    centre = x[rng.choice(len(x), k, replace=False, p=weight / weight.sum())]
    for _ in range(12):
        own = (x @ centre.T).argmax(axis=1)
        for c in range(k):
            if (own == c).any():
                centre[c] = (x[own == c] * weight[own == c, None]).sum(axis=0)
                centre[c] /= np.linalg.norm(centre[c]) + 1e-9
    return (x @ centre.T).argmax(axis=1)


def make_network(counts: np.ndarray, starts: np.ndarray, once: np.ndarray, initial: np.ndarray, direction: np.ndarray | None = None, seed: int = 3) -> Network:
    """Untrained; classes and shares come from the corpus's counts of ids, ``starts`` those of words by their first id, ``once``
    of words seen once; ``initial``: ids that start words; ``direction``: see ``topics``. The end is a class of its own."""
    held = np.where(initial, starts, counts - starts) + 0.5
    direction = topics([]) if direction is None else direction
    group, leaf = np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
    for first, n, mine in ((0, FIRST, initial), (FIRST, INNER, ~initial)):
        ids = np.flatnonzero(mine & (np.arange(IDS) != END))
        group[ids] = first + clusters(direction[ids], held[ids], n)
    for g in range(GROUPS):
        ids = np.flatnonzero((group == g) & (np.arange(IDS) != END))
        ids = ids[np.argsort(-held[ids], kind="stable")]
        own = LEAVES - 5 if g else LEAVES - 6
        leaf[ids[:own]] = np.arange(len(ids[:own]))
        rest = ids[own:]
        mass = np.cumsum(held[rest]) / max(1e-9, held[rest].sum())
        leaf[rest] = own + np.minimum((mass * 5).astype(int), 4)
    group[END], leaf[END] = 0, LEAVES - 1
    cell = group * LEAVES + leaf
    total = np.bincount(cell, held, GROUPS * LEAVES)
    words, single = (np.bincount(cell, x, GROUPS * LEAVES) for x in (np.where(initial, starts, 0), np.where(initial, once, 0)))
    new = np.clip((single + 0.5) / (words + 1), 1e-3, 1)
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / math.sqrt(s[-2]), s).astype(np.float32)
    top, low = 0.1 * draw(2 * DIM + 1, GROUPS), 0.1 * draw(GROUPS, 2 * DIM + 1, LEAVES)
    both = total.reshape(GROUPS, LEAVES)
    top[-1], low[:, -1] = np.log(both.sum(axis=1) / both.sum() + 1e-9), np.log(both / np.maximum(1e-9, both.sum(axis=1, keepdims=True)) + 1e-9)
    shape = lambda x: x.reshape(GROUPS, LEAVES)
    known = np.log10(np.maximum(1 - new, 1e-12) / np.maximum(1, words))
    return Network(rng.normal(0, 0.3, (IDS, DIM)).astype(np.float32), rng.normal(0, 0.3, (WINDOW, DIM)).astype(np.float32), draw(DIM, DIM), draw(DIM, DIM), draw(DIM, DIM), top.astype(np.float32), low.astype(np.float32), group, leaf, np.log10(held / np.maximum(total, 1e-9)[cell]), shape(known), shape(np.log10(new)))


#: What attends at most, and what is not before it.
_MOST = np.where(np.tri(WINDOW, dtype=bool), 60, -np.inf).astype(np.float32)
_SCALE = np.float32(1 / math.sqrt(DIM))


def _qkv(net: Network) -> np.ndarray:
    """Queries (scaled), keys, values and the one by one product, of inputs with a one after them."""
    out = np.zeros((DIM + 1, 3 * DIM + 1), np.float32)
    out[:DIM, : 3 * DIM], out[-1, -1] = np.concatenate([net.q * _SCALE, net.k, net.v], axis=1), 1
    return out


def _heads(net: Network) -> np.ndarray:
    """Both output layers by group: GROUPS x 2 DIM + 1 x GROUPS + LEAVES."""
    return np.concatenate([np.broadcast_to(net.top, (GROUPS, *net.top.shape)), net.low], axis=2)


def _inputs(embed: np.ndarray) -> np.ndarray:
    """Rows of what the output layers see, with nothing attended: zeros, the id's row, and a one."""
    out = np.zeros((len(embed), 2 * DIM + 1), np.float32)
    out[:, DIM : 2 * DIM], out[:, -1] = embed, 1
    return out


def forward(net: Network, x: np.ndarray, inputs: np.ndarray | None = None):
    """What the output layers see (windows, WINDOW, 2 DIM + 1) before each next id; and what the backward pass needs.

    ``inputs``: of ``_inputs``, by ``x``; else ``x`` are ids.
    """
    h = (_inputs(net.embed) if inputs is None else inputs).take(x, axis=0)
    place = _inputs(net.place)
    place[:, -1] = 0
    h += place
    m = (h.reshape(-1, 2 * DIM + 1)[:, DIM:] @ _qkv(net)).reshape(*x.shape, 3 * DIM + 1)
    a = m[..., :DIM] @ m[..., DIM : 2 * DIM].transpose(0, 2, 1)
    np.exp(np.minimum(a, _MOST, out=a), out=a)
    c = a @ m[..., 2 * DIM :]  # the last column is the sum of weights
    np.divide(c[..., :DIM], c[..., DIM:], out=h[..., :DIM])
    return h, (m, a, c[..., DIM:])


def _outputs(net: Network, heads: np.ndarray, h: np.ndarray, rows: np.ndarray, y: np.ndarray):
    """Both output layers for what follows ``rows`` of ``h``, the ids ``y``; dealt out by group.

    The rows in order of groups; each group and its slice; what the layers see; a row for each group and leaf: exp of
    what the layers say; its sums by layer; and where in it, flat, the group and the leaf that follow stand.
    """
    own = net.group.take(y).astype(np.uint8)
    order = np.argsort(own, kind="stable")
    own = own.take(order)
    rows = rows.take(order)
    cut, seen = np.searchsorted(own, np.arange(GROUPS + 1)), h.reshape(-1, 2 * DIM + 1).take(rows, axis=0)
    p = np.empty((GROUPS + LEAVES, len(rows)), np.float32)
    spans = [(g, slice(cut[g], cut[g + 1])) for g in range(GROUPS) if cut[g + 1] > cut[g]]
    for g, s in spans:
        np.matmul(heads[g].T, seen[s].T, out=p[:, s])
    np.exp(np.minimum(p, 60, out=p), out=p)
    sums = p.reshape(2, LEAVES, -1).sum(axis=1)  # there are as many groups as leaves
    at = np.stack([own, net.leaf.take(y.take(order)) + GROUPS]) * len(rows) + np.arange(len(rows))
    return rows, spans, seen, p, sums, at


#: Windows whose gradients are made at once: their arrays stay in a core's cache.
BLOCK_WINDOWS = 128


def gradients(net: Network, x: np.ndarray, y: np.ndarray, live: np.ndarray):
    """Mean loss over live places, and the gradient of each part; ``y``: the ids that follow."""
    n = np.float32(max(1, int(live.sum())))
    heads = _heads(net)
    sums = [0.0, np.zeros((WINDOW, DIM), np.float32), np.zeros((DIM, 3 * DIM), np.float32), np.zeros_like(heads)]
    d_e = np.empty((len(x), WINDOW, DIM), np.float32)
    order = np.argsort(x.reshape(-1).astype(np.uint16), kind="stable")
    ids = x.reshape(-1).take(order)
    new = np.r_[True, ids[1:] != ids[:-1]][: len(ids)]
    first, place = np.flatnonzero(new), np.empty(len(ids), np.int64)
    ids, place[order] = ids[first], np.cumsum(new) - 1
    inputs, place = _inputs(net.embed[ids]), place.reshape(x.shape)
    for i in range(0, len(x), BLOCK_WINDOWS):
        part = slice(i, i + BLOCK_WINDOWS)
        d_e[part], *own = _block_gradients(net, heads, n, inputs, place[part], y[part], live[part])
        sums = [held + more for held, more in zip(sums, own, strict=True)]
    loss, d_place, d_qkv, d_heads = sums
    d_embed = np.zeros((0, DIM), np.float32)
    if len(ids):  # pairs of values are added as one complex number
        d_embed = np.add.reduceat(d_e.reshape(-1, DIM).take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
    d_q, d_k, d_v = np.split(d_qkv, 3, axis=1)
    return loss / n, (ids, d_embed), [d_place, d_q * _SCALE, d_k, d_v, d_heads[..., :GROUPS].sum(axis=0), d_heads[..., GROUPS:]]


def _block_gradients(net: Network, heads: np.ndarray, n: np.float32, inputs: np.ndarray, x: np.ndarray, y: np.ndarray, live: np.ndarray):
    """Gradient of each input, sum of losses, gradients of places, of ``q``, ``k`` and ``v``, and of ``heads``."""
    h, (m, a, weight) = forward(net, x, inputs)
    rows = np.flatnonzero(live)
    rows, spans, seen, p, sums, at = _outputs(net, heads, h, rows, y.reshape(-1).take(rows))
    right = p.reshape(-1).take(at)
    loss = np.log(sums).sum() - np.log(right + 1e-30).sum()
    scale, both = 1 / (n * sums), p.reshape(2, LEAVES, -1)
    both *= scale[:, None]
    p.reshape(-1)[at] = right * scale - 1 / n
    d_heads, d_seen, back = np.zeros_like(heads), np.zeros((len(rows) + 1, 2 * DIM + 1), np.float32), np.full(x.size, len(rows))
    for g, s in spans:
        d_heads[g] = (p[:, s] @ seen[s]).T
        np.matmul(p[:, s].T, heads[g].T, out=d_seen[s])
    back[rows] = np.arange(len(rows))
    d_h = d_seen.take(back, axis=0).reshape(h.shape)
    d_c = np.empty((*x.shape, DIM + 1), np.float32)
    np.divide(d_h[..., :DIM], weight, out=d_c[..., :DIM])
    # What is attended, times its gradient, is the sum over its parts: it goes with the one of keys' values.
    np.negative(np.einsum("wij,wij->wi", d_c[..., :DIM], h[..., :DIM]), out=d_c[..., DIM])
    d_a = d_c @ m[..., 2 * DIM :].transpose(0, 2, 1)
    d_a *= a
    d_m = np.empty((*x.shape, 3 * DIM), np.float32)
    np.matmul(d_a, m[..., DIM : 2 * DIM], out=d_m[..., :DIM])
    np.matmul(d_a.transpose(0, 2, 1), m[..., :DIM], out=d_m[..., DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), d_c[..., :DIM], out=d_m[..., 2 * DIM :])
    d_m = d_m.reshape(-1, 3 * DIM)
    d_e = (d_m @ _qkv(net)[:DIM, : 3 * DIM].T).reshape(*x.shape, DIM)
    d_e += d_h[..., DIM : 2 * DIM]
    # Products over all places at once are slower than those of a few windows each, then added.
    few = 8 if len(x) % 8 == 0 else 1
    d_qkv = h[..., DIM : 2 * DIM].reshape(-1, few * WINDOW, DIM).transpose(0, 2, 1) @ d_m.reshape(-1, few * WINDOW, 3 * DIM)
    return d_e, loss, d_e.sum(axis=0), d_qkv.sum(axis=0), d_heads


class Adam:
    """Steps of ``net``, in place; of the ids' rows only those that occur are touched."""

    def __init__(self, net: Network):
        self.net, self.t, self.moments = net, 0, [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]

    def step(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, rate: float) -> float:
        loss, (ids, d_embed), rest = gradients(self.net, x, y, live)
        self.t += 1
        rate *= math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for part, (m, s), g, pick in zip(self.net.parts(), self.moments, [d_embed, *rest], [ids, *[...] * 6], strict=True):
            mean, square = (x.take(pick, axis=0) if pick is ids else x.copy() for x in (m, s))
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            m[pick], s[pick] = mean, square
            mean = mean * rate
            part[pick] -= mean / (np.sqrt(square, out=square) + 1e-8)
        return loss


def train(net: Network, streams: list[np.ndarray], epochs: int | None = None, seed: int = 5) -> list[float]:
    """Adam over shuffled windows; returns each epoch's mean loss."""
    windows = [s for ids in streams for s in cut_windows(ids, WINDOW)]
    if not windows:
        return []
    x, y, live = (np.stack(c) for c in zip(*windows, strict=True))
    rng, losses, adam = np.random.default_rng(seed), [], Adam(net)
    epochs = epochs or EPOCHS
    steps = epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        rows = [order[i : i + BATCH] for i in range(0, len(x), BATCH)]
        losses.append(float(np.mean([adam.step(x[r], y[r], live[r], RATE * (1 - (adam.t + 1) / steps)) for r in rows])))
    return losses


def windows_of(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``cut_windows`` gives by ``WINDOW`` for all streams that lie end to end in ``flat``, stacked."""
    ends = np.cumsum(sizes)
    before = np.concatenate(([END], flat[:-1]))
    before[(ends - sizes)[sizes > 0]] = END
    number = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), number)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    at = ((ends - sizes)[doc] + turn * WINDOW)[:, None] + np.arange(WINDOW)
    live = at < ends[doc][:, None]
    np.minimum(at, max(0, len(flat) - 1), out=at)
    return np.where(live, before.take(at), END), np.where(live, flat.take(at), END), live


def encoded(texts: DataFrame, ranks, block: int = 32 * BLOCK) -> DataFrame:
    """``texts`` with ``ids``, the subwords of ``text`` as 16-bit numbers, in its place; staged.

    Beside them lie rows of counts ``c`` (null in the others) over the texts that are to ``learn`` from: of words by key ``w``, with
    the first subword ``i``, and, where ``w`` is null, of the subword ``i``. Counts are made by about ``block`` bytes of
    text, so there may be more than one row for a word or subword.
    """
    kept = [c for c in texts.columns if c != "text"]
    names = [*kept, "ids", "w", "i", "c"]

    def run(batches):
        encode, starts = load_encoder(ranks.value).encode_ordinary, word_starts(ranks.value)
        for batch in batches:
            held, learn = batch.column("text"), np.array(batch.column("learn"), bool)
            for a, b in groups_of(pc.binary_length(held).fill_null(0).to_pylist(), block):
                words = Words(encode, starts, held.slice(a, b - a), learn[a:b])
                for x, y, flat, sizes in words.streams():
                    cut = np.append(0, np.cumsum(sizes))
                    ids = [flat[f:t].tobytes() for f, t in zip(cut[:-1], cut[1:], strict=True)]
                    none = [pa.nulls(y - x, pa.int64())] * 3
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a + x, y - x) for c in kept), pa.array(ids, pa.binary()), *none], names=names)
                w, c, first, total = words.counted()
                i = np.flatnonzero(total)
                n = len(w) + len(i)
                key = pa.array(np.append(w, np.zeros(len(i), np.int64)), mask=np.arange(n) >= len(w))
                own = [key, pa.array(np.append(first.astype(np.int64), i)), pa.array(np.append(c, total[i]))]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, batch.schema.field(c).type) for c in kept), pa.nulls(n, pa.binary()), *own], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return staged(texts.mapInArrow(run, f"{schema}, ids binary, w long, i long, c long"))


def subword_streams(texts: DataFrame, ranks, rounds: int = ROUNDS) -> DataFrame:
    """``r, ids``: the round of each of ``texts(h, text)`` by its hash, and its subwords as 16-bit numbers."""
    rows = texts.select(F.pmod("h", F.lit(rounds)).cast("int").alias("r"), F.lit(True).alias("learn"), F.col("text").cast("string").alias("text"))
    return encoded(rows, ranks).where("c IS NULL").select("r", "ids")


def _stream_blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(subwords end to end, sizes) of the streams of ``subword_streams``, by about a million bytes."""
    for batch in batches:
        held = byte_column(batch.column("ids"))
        for a, b in groups(held):
            yield np.frombuffer(b"".join(held[a:b]), np.uint16).astype(np.int64), np.array([len(x) // 2 for x in held[a:b]])


def _row_batch(i: np.ndarray, n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    lists = pa.FixedSizeListArray.from_arrays(pa.array(v.astype(np.float64).reshape(-1)), v.shape[1]).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(n.astype(np.float64)), lists], names=["i", "n", "v"])


def _summed(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of n and of each place of v by i, of ``rows(i, n, v)``; a row for each i, so of the model's size, reaches the driver."""
    t = rows.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width))).toArrow()
    return t.column("i").to_numpy(), t.column("n").to_numpy(), np.stack([t.column(f"v{j}").to_numpy() for j in range(width)], axis=1)


def corpus_directions(streams: DataFrame, direction: np.ndarray) -> np.ndarray:
    """``direction`` made anew from all texts: a text's is the mean of its distinct ids', an id's the mean of those of the
    texts that hold it, from the mean of all texts."""
    shared, size = streams.sparkSession.sparkContext.broadcast(direction), direction.shape[1]

    def run(batches):
        held, n, total = np.zeros((IDS, size)), np.zeros(IDS), np.zeros(size + 1)
        for flat, sizes in _stream_blocks(batches):
            pairs = np.repeat(np.arange(len(sizes)) * IDS, sizes) + flat
            pairs.sort()
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
            doc = pairs // IDS
            ids = pairs - doc * IDS
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            many = np.diff(np.r_[first, len(doc)])
            mean = np.add.reduceat(shared.value.take(ids, axis=0), first, axis=0) / many[:, None]
            total += [*mean.sum(axis=0), len(mean)]
            n += np.bincount(ids, minlength=IDS)
            order = np.argsort(ids.astype(np.uint16), kind="stable")
            ids, row = ids.take(order), np.repeat(np.arange(len(mean)), many).take(order)
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            held[ids[first]] += np.add.reduceat(mean.take(row, axis=0), first, axis=0)
        i = np.flatnonzero(n)
        yield _row_batch(np.r_[i, IDS], np.r_[n[i], total[-1]], np.r_[held[i], total[None, :-1]])

    i, n, v = _summed(streams.mapInArrow(run, "i long, n double, v array<double>"), size)
    mean, out = v / np.maximum(1, n)[:, None], np.zeros_like(direction)
    out[i[i < IDS]] = (mean - mean[i == IDS].sum(axis=0))[i < IDS]
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9).astype(out.dtype)


def train_on_all(net: Network, streams: DataFrame, rounds: int = ROUNDS) -> list[int]:
    """``net`` taken through every stream, in place; returns how many subwords each round has learnt from."""
    seen = []
    for r in range(rounds):
        shared, rate = streams.sparkSession.sparkContext.broadcast(net), SLOW_RATE * (1 - r / rounds)

        def run(batches, shared=shared, rate=rate, r=r):
            own = copy.deepcopy(shared.value)
            adam, rng, used, places = Adam(own), np.random.default_rng(r), np.zeros(IDS), 0
            for flat, sizes in _stream_blocks(batches):
                x, y, live = windows_of(flat, sizes)
                order = rng.permutation(len(x))
                for i in range(0, len(x), STEP):
                    rows = order[i : i + STEP]
                    adam.step(x.take(rows, axis=0), y.take(rows, axis=0), live.take(rows, axis=0), rate)
                used += np.bincount(x[live], minlength=IDS)
                places += int(live.sum())
            if places:
                values = np.concatenate(own.rows())
                n = np.r_[used, np.full(len(values) - IDS, places)]
                i = np.flatnonzero(n)
                yield _row_batch(i, n[i], values[i] * n[i, None])

        i, n, v = _summed(streams.where(F.col("r") == r).mapInArrow(run, "i long, n double, v array<double>"), DIM)
        shared.unpersist()
        seen.append(int(n.max(initial=0)))
        first = 0
        for rows in net.rows():
            mine = (i >= first) & (i < first + len(rows))
            rows[i[mine] - first] = v[mine] / n[mine, None]
            first += len(rows)
    return seen


def cut_windows(ids: np.ndarray, stride: int):
    """(inputs, what follows, which places count) for windows of a stream that starts after an END."""
    before = np.concatenate(([END], ids[:-1]))
    first = 0
    while first < len(ids):
        begin = max(0, min(first, first + stride - WINDOW)) if first else 0
        x, y = np.full(WINDOW, END, np.int64), np.full(WINDOW, END, np.int64)
        own = slice(begin, min(len(ids), begin + WINDOW))
        n = own.stop - own.start
        x[:n], y[:n] = before[own], ids[own]
        live = np.zeros(WINDOW, bool)
        live[first - begin : n] = True
        yield x, y, live
        first = own.stop


def stream_scores(net: Network, flat: np.ndarray, sizes: np.ndarray, batch: int = 128, inputs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probabilities for each subword of the streams that lie end to end in ``flat``, each scored once: of the subword,
    of its class, and that any subword which starts a word (or the end) stands there."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    before = np.concatenate(([END], flat[:-1]))
    before[starts[sizes > 0]] = END
    # The first window of a stream scores WINDOW places, each further one the last STRIDE of its own.
    number = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(sizes)), number)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    begin = starts[doc] + turn * STRIDE
    kind, begins = np.zeros(len(flat), np.float32), np.zeros(len(flat), np.float32)
    heads, inputs = _heads(net), _inputs(net.embed) if inputs is None else inputs
    for i in range(0, len(doc), batch):
        b, d = begin[i : i + batch], doc[i : i + batch]
        at = b[:, None] + np.arange(WINDOW)
        inside = at < ends[d][:, None]
        np.minimum(at, len(flat) - 1, out=at)
        h, _ = forward(net, np.where(inside, before.take(at), END), inputs)
        rows = np.flatnonzero(inside & ((turn[i : i + batch] == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE)))
        rows, _, _, p, sums, right = _outputs(net, heads, h, rows, flat.take(at.reshape(-1).take(rows)))
        to, right = at.reshape(-1).take(rows), p.reshape(-1).take(right) / sums
        kind[to] = right[0] * right[1]
        begins[to] = p[:FIRST].sum(axis=0) / sums[0]
    kind, begins = np.log10(np.maximum(kind, 1e-30)), np.log10(np.maximum(begins, 1e-30))
    return kind + net.share.take(flat), kind, begins


def word_scores(net: Network, flat: np.ndarray, lens: np.ndarray, scores) -> tuple[np.ndarray, np.ndarray]:
    """log10, given that a word starts, of each word per count of it, and of it spelt; the end counts once.

    The words' subwords lie end to end in ``flat``; each text's last token is the end.
    """
    own, kind, begins = scores
    at = np.cumsum(lens) - lens
    first = flat.take(at)
    started, cell = begins.take(at), net.group.take(first) * LEAVES + net.leaf.take(first)
    mine, end = kind.take(at).astype(np.float64) - started, first == END
    inner = np.add.reduceat(own, at) - own.take(at) if len(at) else np.zeros(0)
    after = np.where(end, 0.0, np.r_[started[1:], 0.0][: len(at)])
    spelt = np.where(end, 0.0, net.new.take(cell)) + net.share.take(first) + inner + after
    whole = np.where(end, -300.0, net.known.take(cell))
    return mine + whole, mine + spelt


def mixed_score(c: np.ndarray, whole: np.ndarray, spelt: np.ndarray) -> np.ndarray:
    """log10 of a word that was seen ``c`` times, from ``word_scores``."""
    return np.log10(c * np.exp(whole * math.log(10)) + np.exp(spelt * math.log(10)) + 1e-300)


def sample_bound(texts: int) -> int:
    """The 63-bit hash up to which about one and a half samples of ``texts`` lie; never below what one text needs."""
    return min((1 << 63) - 1, max(1, (3 * SAMPLE_DOCS << 62) // max(1, texts)))


def score_texts(docs: DataFrame, tokenizer: str = TOKENIZER, parts: int = 5, rest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row for each input row.

    Scores are log10 probabilities of whole texts. Learnt are the texts whose crc32 of the id (as text; null: empty)
    leaves no ``rest`` by ``parts``. Null and empty texts are an end alone. Rows that agree in id and text are scored
    alike; other columns are ignored, whatever their names; an empty table gives no rows. Without any training text every
    token is unknown. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ranks = read_ranks(spark, tokenizer)
    k = row_key("doc_id", "text")
    keyed = d.select(k.alias("k"), F.shiftrightunsigned(k, 1).alias("h"), "doc_id", (~held_out(F.col("doc_id"), parts, rest)).alias("learn"), "text")
    both = encoded(keyed, spark.sparkContext.broadcast(ranks))
    texts = both.where("c IS NULL")
    by_word = staged(both.where("w IS NOT NULL").groupBy("w").agg(F.sum("c").alias("c"), F.max("i").alias("i")))
    counts = by_word.select("w", "c")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total.n), int(total.v)
    head = counts.where(F.col("c") >= threshold(by_word, HEAD)).toPandas()
    head_w, head_c = head["w"].to_numpy(np.int64), head["c"].to_numpy(np.float64)
    base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    texts_seen = by_word.where(F.col("i") == END).agg(F.coalesce(F.sum("c"), F.lit(1))).first()[0]
    every = texts.where("learn").select("h", F.pmod("h", F.lit(ROUNDS)).cast("int").alias("r"), "ids")
    least = lambda rows: staged(rows.select("h", "ids").orderBy("h", "ids").limit(SAMPLE_DOCS))
    sample = least(every.where(F.col("h") <= F.lit(sample_bound(texts_seen))))
    if n and sample.isEmpty():  # a few texts, repeated very often, share few hashes
        sample = least(every)
    streams, held = [], 0
    for r in sample.orderBy("h", "ids").toLocalIterator():
        ids = np.frombuffer(r.ids, np.uint16).astype(np.int64)
        if streams and held + len(ids) > SAMPLE_IDS:
            break
        streams.append(ids)
        held += len(ids)
    starts = word_starts(ranks)
    net = make_network(*_subword_counts(both, by_word), starts, corpus_directions(every, topics(streams)))
    train(net, streams)
    train_on_all(net, every)
    del streams
    shared = spark.sparkContext.broadcast((starts, net, head_w, head_c))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        starts, net, head_w, head_c = shared.value
        head, inputs = Head(head_w, head_c), _inputs(net.embed)
        for batch in batches:
            held, keys, own_ids = byte_column(batch.column(2)), batch.column(0), batch.column(1)
            for a, b in groups(held):
                flat, per_doc = np.frombuffer(b"".join(held[a:b]), np.uint16).astype(np.int64), np.array([len(x) // 2 for x in held[a:b]])
                at = np.flatnonzero(starts.take(flat))
                lens, sizes = np.diff(np.append(at, len(flat))), np.diff(np.append(0, np.searchsorted(at, np.cumsum(per_doc))))
                w = word_keys(flat, at, lens)
                c = head.of(w)
                whole, spelt = word_scores(net, flat, lens, stream_scores(net, flat, per_doc, inputs=inputs))
                known = c > 0
                doc = np.repeat(np.arange(b - a), sizes)
                here = np.bincount(doc[known], mixed_score(c[known], whole[known], spelt[known]), b - a)
                base = np.bincount(doc[known], base_of(c[known]), b - a)
                tail = np.flatnonzero(~known)
                cut = np.searchsorted(doc[tail], np.arange(b - a + 1))
                pairs = pa.StructArray.from_arrays([pa.array(w[tail]), pa.array(whole[tail].astype(np.float32)), pa.array(spelt[tail].astype(np.float32))], ["w", "p", "q"])
                rest_of = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), own_ids.slice(a, b - a), pa.array(sizes), pa.array(np.bincount(doc[known], minlength=b - a)), pa.array(base), pa.array(here), rest_of], names=["k", "doc_id", "n_tokens", "n_known", "base", "own", "rest"])

    scored = staged(texts.select("k", "doc_id", "ids").mapInArrow(run, f"k long, doc_id {id_type}, n_tokens long, n_known long, base double, own double, rest array<struct<w: long, p: float, q: float>>"))
    tail = scored.select("k", F.size("rest").alias("size"), F.explode("rest").alias("r")).select("k", "size", "r.w", "r.p", "r.q").join(counts, "w", "left")
    c = F.coalesce("c", F.lit(0))
    power = lambda x: F.exp(F.col(x).cast("double") * math.log(10))
    own = F.log10(c * power("p") + power("q") + F.lit(1e-300))
    base = F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))
    # Rows that agree in id and text share k, and each of them sent its words: what is summed is that many times too much.
    times = F.count("*") / F.first("size")
    more = tail.groupBy("k").agg((F.sum(own) / times).alias("own2"), (F.sum(base) / times).alias("base2"), F.round(F.sum((c > 0).cast("long")) / times).cast("long").alias("known2"))
    out = scored.drop("rest").join(more, "k", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    return out.select("doc_id", held_out(F.col("doc_id"), parts, rest).alias("held_out"), "n_tokens", plus("n_known", "known2", 0).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "base2", 0.0).alias("base_score"), plus("own", "own2", 0.0).alias("score"))


def _subword_counts(both: DataFrame, by_word: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By id: its count in all training texts, that of words by their first id, and that of words seen once.

    Rows for each id, so of the vocabulary's size, reach the driver.
    """
    total = both.where("w IS NULL AND c IS NOT NULL").groupBy("i").agg(F.sum("c").alias("total"))
    words = by_word.groupBy("i").agg(F.sum("c").alias("first"), F.sum((F.col("c") == 1).cast("long")).alias("once"))
    out = []
    for rows, names in ((total, ["total"]), (words, ["first", "once"])):
        found = rows.toPandas()
        for name in names:
            out.append(np.zeros(IDS))
            out[-1][found["i"].to_numpy(np.int64)] = found[name].to_numpy(np.float64)
    return tuple(out)


def threshold(counts: DataFrame, most: int) -> int:
    """The smallest power of 2 that at most ``most`` of the counts ``c`` reach."""
    sizes = {r.b: r.n for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    return 2 ** next((b for b in range(max(sizes, default=0) + 2) if sum(k for i, k in sizes.items() if i >= b) <= most), 0)
