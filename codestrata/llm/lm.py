"""LM scoring by online logistic context mixing.

Method: a text is its lower-case words and one end. A word of the dictionary (the most frequent words that occur twice or more, ``HOT_WORDS`` at most) is a path of
bits: a Huffman code of the language it is most used in, then one within it; all other words are the path of an escape and their spelling. The first ``MIXED`` bits of
a path are predicted by four predictors with hashed contexts: the bits so far alone, with the languages and symbols of the last words, with the word before, and
with the word two before. Each context has counted how often a 0 and a 1 followed in the training documents. Their log odds are
combined by weights that a gate chooses (how well known the contexts are); an adaptive map over (gate, quantised prediction) refines the result. Weights
and map are learned online, over the stream of documents: a step of ``STEP`` words is predicted, then learned from. The rest of a long path has the word's share
among the words that begin alike.

A longer context is matched over the whole corpus: at places that two neighbouring words' hash chooses (one in ``SPACING``), the last ``CONTEXT`` words name the
stretch to the next such place that followed them in another training document. One bit tells whether it follows again; its probability is an
adaptive one, by the number of stretches matched just before and of occurrences. If it follows, its words cost no more.

The spelling is mixed, too: the bytes of a word and a closing space, eight bits a byte, from five predictors with the last 1 to 4 bytes and the prefix as contexts
(counted over distinct words, as unknown words are new ones). It is found once per distinct word. An escaped word's probability is its discounted count among
the escaped training words, backed off to its spelling; the share of the spellings that is the dictionary's falls to the others.

A training document is predicted from counts that leave out the occurrence itself, and from stretches of other documents only; scored documents that are held out
change nothing.

Order: a document belongs to the shard that a hash of its text and id names; there are as many shards as the training words fill at ``SHARD_WORDS`` each. A shard is learned
in the order of the hash from the same beginning. So scores depend on the rows alone, not on their order or the number of partitions.

Scale: words are counted in a task and go to the buckets of a hash of their bytes, all of a bucket as one packed row, where they are summed; a bucket's
escaped words go the same way and meet its counts there. So neither the counts nor the requests pass Spark word by word. The tables have a fixed size, are summed in slices and broadcast (8 MB and
14 MB); the dictionary is bounded and broadcast. What else grows with the corpus is joined: stretches by context (whose hot ones are salted). Texts are split and their words looked up twice: once to count the words, then to number them; the numbers
and the escaped words are written once, compressed, and exchanged by shard. Arrow splits and looks up some 16 MB of texts at once. A task holds one step and a few documents of a shard, never a
whole shard.

The prefix predictor of the spelling counts a prefix if it begins ``PREFIX_MIN`` distinct words of all training documents. In sorted order these are neighbours,
so how far a word's prefixes are counted (its depth) is seen from the words at most ``PREFIX_MIN - 1`` places away. The words at the ends
of a task's range are compared with the next ranges' in one stream of such ends, a fixed number a task.

Edge cases: a null text is empty and has the end only; null ids are not held out; rows equal in id and text are one document, learned once and scored alike, each
keeping its row; an empty table gives no rows; without training documents N is 0 and every bit of a spelling costs 1 bit; other columns than doc_id, text and lang are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, crc32_mod, materialise, shuffle_partitions

END = b"\n"
TABLE_LOGS = (16, 19, 21, 21, 21)
#: The prefix predictor counts prefixes that occur so often at least: rarer ones would only fill its table.
PREFIX_MIN = 8
HOT_WORDS, HOT_LENGTH = 1 << 18, 64
#: Bytes of text whose words a task counts at once; requests and answers it holds.
FLUSH_BYTES, FLUSH_PAIRS = 1 << 24, 1_000_000
#: Words of a step of learning the spelling: an eighth of what was learned before, within these bounds; and of a shard of words that is learned in one stream.
SPELL_STEPS, SPELL_SHARD = (250, 4000), 100_000
#: Languages that classes of words are told by; all others are one more.
LANGUAGES = 7
#: Words of a step of learning, and training words of a shard.
STEP, SHARD_WORDS = 2048, 500_000
#: One place in SPACING begins a stretch that is looked up by the CONTEXT words before it.
SPACING, CONTEXT = 24, 6
#: Bits of a path that are mixed; the rest of a path is told by the words' counts. A context has 2**MIXED slots next to each other, one for each beginning of a path.
MIXED = 8
#: Predictors over words: slots of each (as logarithm), and the words that a context tells apart; others count as their class.
WORD_LOGS = (8, 16, 21, 21)
TOP_WORDS = 4094
_ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
ORDERS = len(TABLE_LOGS)
GATES, STEPS = 48, 33
SLICE = 16
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_MUL = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens, edges) of many texts: ``tokens`` of text i are those from edges[i] to edges[i + 1]."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    flat, edges = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.any(pc.invert(full)).as_py():  # white space at an end of a text
        edges = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[edges]
        flat = flat.filter(full)
    return flat.cast(pa.binary()), edges


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The rows again, some ``most`` bytes of the texts in the last column at once: small batches are joined, large ones cut."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.columns[-1]).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most - size, "right")))
            kept.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1]) - before
            at = stop
            if size >= most or at < batch.num_rows:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
    kept.clear()
    pa.default_memory_pool().release_unused()  # the process stays for later stages


_NOTHING, _SPACE = pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary())


def flat_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, where each begins and the last ends)."""
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8), edges - edges[0]


class Edges:
    """Distinct (class, prefix, next byte) of a set of words, with contexts and the sum of the words' counts."""

    def __init__(self, words: list[bytes] | pa.Array, classes: np.ndarray, counts: np.ndarray, depths: np.ndarray | None = None):
        own = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        flat, edges = flat_bytes(pc.binary_join_element_wise(own, _NOTHING, _SPACE))
        length, self.starts = np.diff(edges), edges[:-1]
        start = np.repeat(self.starts, length)
        at = np.arange(len(flat))
        power = np.cumprod(np.concatenate([[_U(1)], np.full(len(flat), _U(_P))]), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate([[_U(1)], np.full(len(flat), _U(_PINV))]), dtype=np.uint64)
        total = np.concatenate([[_U(0)], np.cumsum((flat.astype(np.uint64) + _U(1)) * power[:-1], dtype=np.uint64)])
        prefix = (total[:-1] - total[start]) * inverse[start]
        own = np.repeat(classes.astype(np.uint64), length) << _U(32)
        whole = prefix ^ ((flat.astype(np.uint64) + _U(1) + own) * _MUL[0])
        # Equal edges are alike in all that follows, so any of them may stand for the others.
        order = np.argsort(whole)
        whole = whole[order]
        new = np.concatenate([[True], whole[1:] != whole[:-1]])
        first = order[new]
        self.inverse = np.empty(len(whole), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.count = np.bincount(self.inverse, np.repeat(counts, length), len(first))
        self.byte = flat[first].astype(np.uint64)
        offset = at[first] - start[first]
        # Is the edge's prefix counted? Without depths these words are all there are.
        self.common = self.count >= PREFIX_MIN if depths is None else offset < np.repeat(depths, length)[first]
        last = np.zeros(len(first), np.uint64)
        self.contexts = []
        for k in range(1, 5):
            byte = np.where(offset >= k, flat[np.maximum(first - k, 0)], 0).astype(np.uint64)
            last = last | (byte << _U(8 * (k - 1)))
            # The class is part of the two shortest contexts: they tell the first bytes.
            self.contexts.append((last + _U(1) + (own[first] if k < 3 else _U(0))) * _MUL[k - 1])
        self.contexts.append((prefix[first] + _U(1)) * _MUL[4])

    def bit(self, b: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Table slots of each predictor, and the bit, of every edge."""
        node = (_U(1) << _U(b)) | (self.byte >> _U(8 - b))
        mark = node * _MUL[1]
        slots = [((c ^ mark) * _MUL[2] >> _U(64 - log)).view(np.int64) for c, log in zip(self.contexts, TABLE_LOGS, strict=True)]
        return slots, ((self.byte >> _U(7 - b)) & _U(1)).view(np.int64)


#: Counts are kept as bytes on a logarithmic scale, exact up to 10: code -> count.
COUNTS = 2 ** (np.arange(256) / 11) - 1
COUNTS[np.rint(np.log2(np.arange(11) + 1) * 11).astype(int)] = np.arange(11)


def encode_counts(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(np.log2(n + 1.0) * 11), 255).astype(np.uint8)


def odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.3) / (n0 + 0.3))


def _pairs() -> tuple[np.ndarray, np.ndarray]:
    """Log odds, and the number of occurrences on a logarithmic scale, of a slot's two bytes: as they are, with one 0 less and with one 1 less."""
    n0, n1 = np.tile(COUNTS, 256), np.repeat(COUNTS, 256)
    sets = [(n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))]
    return np.concatenate([odds(a, b) for a, b in sets]).astype(np.float32), np.concatenate([np.log2(a + b + 1) for a, b in sets])


LOG_ODDS, SEEN = _pairs()
#: What a slot's occurrences add to the number of the gate of the spelling: of the longest context, and of the prefix.
SPELL_GATES = np.minimum(SEEN / 3, 3).astype(np.int8), np.minimum(SEEN, 11).astype(np.int8) * np.int8(4)


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _steps(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2), -(STEPS // 2), STEPS // 2).astype(np.int64) + STEPS // 2


def count_tables(words: list[bytes] | pa.Array, classes: np.ndarray, counts: np.ndarray, tables: list[np.ndarray], depths: np.ndarray | None = None) -> None:
    """Add the words' counts to the tables, arrays of (slots, 2). ``depths``: as of prefix_depths, if the words are a part of all."""
    e = Edges(words, classes, counts, depths)
    common, count = e.common, e.count.astype(tables[0].dtype)
    for b in range(8):
        slots, bit = e.bit(b)
        for k in range(ORDERS):
            s, v, c = (slots[k], bit, count) if k < 4 else (slots[k][common], bit[common], count[common])
            np.add.at(tables[k].reshape(-1), s * 2 + v, c)


class Trainer:
    """Online learning of the gated weights and the adaptive map, over one stream of words."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = [t.reshape(-1).view(np.uint16) for t in tables]
        self.weights = np.full((GATES, ORDERS + 1), 0.25)
        self.weights[:, -1] = 0
        self.squares = np.full((GATES, ORDERS + 1), 1e-3)
        self.map = np.zeros((GATES, STEPS, 2))
        self.mass = np.zeros(GATES)

    def learn(self, words: list[bytes] | pa.Array, classes: np.ndarray, counts: np.ndarray, depths: np.ndarray | None = None) -> None:
        e = Edges(words, classes, counts, depths)
        common = e.common
        spread = np.arange(len(e.byte)) % 4 * GATES
        for b in range(8):
            slots, bit = e.bit(b)
            x = []
            g = np.zeros(len(bit), np.int8)
            less = (1 + bit) << 16
            for k in range(ORDERS):
                found = self.tables[k].take(slots[k]) + (less if k < 4 else less * common)
                x.append(LOG_ODDS.take(found))
                if k > 2:
                    g += SPELL_GATES[k - 3].take(found)
            g = g.astype(np.int64)
            weights = np.ascontiguousarray(self.weights.T, np.float32)
            z = weights[-1].take(g)
            for k in range(ORDERS):
                z += weights[k].take(g) * x[k]
            np.clip(z, -30, 30, out=z)
            self.map += np.bincount((g * STEPS + _steps(z)) * 2 + bit, e.count, self.map.size).reshape(self.map.shape)
            error = (1 / (1 + np.exp(-z)) - bit.astype(np.float32)) * e.count
            g += spread  # equal numbers next to each other are slow to count
            sums = lambda v, at=g: np.bincount(at, v, 4 * GATES).reshape(4, GATES).sum(0)
            mass = sums(e.count)
            self.mass += mass
            for k in range(ORDERS + 1):
                slope = sums(error * x[k] if k < ORDERS else error) / np.maximum(mass, 1)
                self.squares[:, k] += slope**2
                self.weights[:, k] -= 0.05 * slope / np.sqrt(self.squares[:, k])


class Model:
    """Frozen tables (bytes), weights and map."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray, map_: np.ndarray):
        self.pairs = [t.reshape(-1).view(np.uint16) for t in tables]
        self.frozen = np.ascontiguousarray(weights.T, np.float32)
        centre = squash((np.arange(STEPS) - STEPS // 2) / 2)
        seen = map_.sum(2)
        share = (map_[:, :, 1] + 20 * centre) / (seen + 20)
        self.refined = np.log(share / (1 - share)).astype(np.float32).reshape(-1)

    def log2(self, words: list[bytes] | pa.Array, classes: np.ndarray) -> np.ndarray:
        """log2 probability of each word, in a text of its class, with its closing space."""
        e = Edges(words, classes, np.zeros(len(words)))
        cost = np.zeros(len(e.byte))
        for b in range(8):
            slots, bit = e.bit(b)
            found = [t.take(s) for t, s in zip(self.pairs, slots, strict=True)]
            g = (SPELL_GATES[1].take(found[4]) + SPELL_GATES[0].take(found[3])).astype(np.int64)
            z = self.frozen[-1].take(g)
            for k in range(ORDERS):
                z += self.frozen[k].take(g) * LOG_ODDS.take(found[k])
            z += self.refined.take(g * STEPS + _steps(z))
            z *= (0.5 - bit).astype(np.float32)
            np.clip(z, -20, 20, out=z)
            cost -= np.log1p(np.exp(z))
        return np.add.reduceat(cost[e.inverse], e.starts) / np.log(2)


def buckets(words: pa.Array, n: int) -> np.ndarray:
    """The bucket of ``n`` that each word belongs to, by a hash of its bytes. No word is empty."""
    flat, edges = flat_bytes(words)
    found = np.empty(len(words), np.uint16 if n <= 1 << 16 else np.uint32)
    at = 0
    while at < len(words):
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + (1 << 20), "right")) - 1)
        starts, length = edges[at:stop] - edges[at], np.diff(edges[at : stop + 1])
        power = np.cumprod(np.concatenate([[_U(1)], np.full(int(length.max()), _U(_P))]), dtype=np.uint64)
        place = np.arange(int(length.sum())) - np.repeat(starts, length)
        h = np.add.reduceat((flat[edges[at] : edges[stop]].astype(np.uint64) + _U(1)) * power.take(place), starts)
        h = (h ^ (h >> _U(32))) * _MUL[0]
        found[at:stop] = (h >> _U(32)) % _U(n)
        at = stop
    return found


def pack_arrays(z: zstandard.ZstdCompressor, *arrays: np.ndarray) -> bytes:
    """Arrays of any kinds, compressed; unpack_arrays gives them back."""
    return z.compress(b"".join([np.array([len(a) for a in arrays], "<u4").tobytes(), *[a.tobytes() for a in arrays]]))


def unpack_arrays(z: zstandard.ZstdDecompressor, blob: bytes, *kinds: str) -> list[np.ndarray]:
    made = z.decompress(blob)
    at, out = 4 * len(kinds), []
    for n, kind in zip(np.frombuffer(made, "<u4", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(made, kind, n, at))
        at += out[-1].nbytes
    return out


def words_of(length: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Words from their lengths and all their bytes."""
    edges = np.concatenate([[0], np.cumsum(length, dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(flat))])


def _cuts(sorted_: np.ndarray) -> tuple[list, list[int]]:
    """(the values of a sorted array, where each begins and the last ends)."""
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return sorted_[first].tolist(), [*first.tolist(), len(sorted_)]


def word_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(word, c, mask, by array) over all documents and the end: counts by language, of training documents only, their sum, and the languages with a count as bits.

    Besides, rows (p, blob): the words of bucket ``p`` and their sums, packed. ``docs`` has text, train and lang. What a task counts goes to each bucket as one packed row.
    """
    size, n_buckets = len(langs) + 1, shuffle_partitions(docs.sparkSession)

    def told(z: zstandard.ZstdCompressor, words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        p = buckets(words, n_buckets)
        order = np.argsort(p, kind="stable")
        flat, edges = flat_bytes(words.take(pa.array(order)))
        row, k = np.nonzero(counts[order])
        value = counts[order[row], k].astype("<u4")
        length = np.diff(edges).astype("<u4")
        found, cuts = _cuts(p[order])
        cells = np.searchsorted(row, cuts).tolist()
        made = [pack_arrays(z, length[a:b], ((row[c:e] - a) * size + k[c:e]).astype("<u4"), value[c:e], flat[edges[a] : edges[b]]) for a, b, c, e in zip(cuts, cuts[1:], cells, cells[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(made, pa.binary())], ["p", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        ends = np.zeros((1, size), np.int64)
        for batch in _pieces(batches, FLUSH_BYTES):
            train, lang, text = batch.columns
            train = train.to_numpy(zero_copy_only=False)
            k = pc.fill_null(pc.index_in(lang, value_set=pa.array(langs, lang.type)), size - 1).to_numpy() if langs else np.zeros(len(text), np.int32)
            flat, edges = split(text)
            own = flat.dictionary_encode()
            cell = own.indices.to_numpy() * np.int32(size) + np.repeat(k, np.diff(edges))
            if not train.all():
                cell = cell[np.repeat(train, np.diff(edges))]
            # Words of held-out documents only are there without counts.
            yield told(z, own.dictionary, np.bincount(cell, minlength=len(own.dictionary) * size).reshape(-1, size))
            ends += np.bincount(k[train], minlength=size)
        yield told(z, pa.array([END], pa.binary()), ends)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        held: dict[int, list[tuple[pa.Array, np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
            own = pa.concat_arrays([words for words, _, _ in parts]).dictionary_encode()
            number = own.indices.to_numpy().astype(np.int64)
            before = np.cumsum([0, *[len(words) for words, _, _ in parts]]).tolist()
            cells = np.concatenate([number[a + cell // size] * size + cell % size for a, (_, cell, _) in zip(before, parts, strict=False)])
            sums = np.bincount(cells, np.concatenate([value for _, _, value in parts]), len(own.dictionary) * size)
            return own.dictionary, sums.astype(np.int64)

        rows: dict[int, int] = {}
        for batch in batches:
            for p, blob in zip(batch.column("p").to_pylist(), batch.column("blob"), strict=True):
                length, cell, value, flat = unpack_arrays(u, blob.as_buffer(), "<u4", "<u4", "<u4", "u1")
                parts = held.setdefault(p, [])
                parts.append((words_of(length, flat), cell.astype(np.int64), value))
                rows[p] = rows.get(p, 0) + len(length) + len(flat) // 64
                if rows[p] > FLUSH_PAIRS:
                    words, sums = merged(parts)
                    cell = np.flatnonzero(sums)
                    held[p], rows[p] = [(words, cell, sums[cell])], 0
        names = ["word", "c", "mask", "by", "p", "blob"]
        for p, parts in held.items():
            words, sums = merged(parts)
            by = sums.reshape(-1, size)
            c, mask = by.sum(1), ((by > 0) << np.arange(size)).sum(1)
            for a in range(0, len(words), 10_000):
                own = by[a : a + 10_000]
                n = len(own)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.array(own.reshape(-1)))
                yield pa.RecordBatch.from_arrays([words[a : a + n], pa.array(c[a : a + n]), pa.array(mask[a : a + n]), lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            flat, edges = flat_bytes(words)
            blob = pack_arrays(z, np.diff(edges).astype("<u4"), c.astype("<i8"), flat)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))] + [pa.array([p], pa.int32()), pa.array([blob], pa.binary())], names)

    counted = docs.select("train", "lang", "text").mapInArrow(run, "p int, blob binary")
    none = told(zstandard.ZstdCompressor(), pa.array([END], pa.binary()), np.zeros((1, size), np.int64)).to_pylist()[0]
    nothing = docs.sparkSession.range(1).select(F.lit(none["p"]).alias("p"), F.lit(none["blob"]).alias("blob"))
    return counted.unionByName(nothing).repartitionById(n_buckets, "p").mapInArrow(add, "word binary, c long, mask long, by array<long>, p int, blob binary")


def _classed(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, classes, depths, rows) of rows (word, mask, depth): a word once for every class in its mask."""
    row, classes = np.nonzero(batch.column("mask").to_numpy()[:, None] >> np.arange(LANGUAGES + 1) & 1)
    return batch.column("word").take(pa.array(row)), classes, batch.column("depth").to_numpy()[row], row


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(words, classes, depths) of rows (word, mask, depth), a word once for every class in its mask; a batch at once, or as much of it as has a million bytes or so."""
    for batch in batches:
        words, classes, depths, _ = _classed(batch)
        part = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1) // 1_000_000
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                yield words[a:b], classes[a:b], depths[a:b]


def _shared(w: pa.Array, near: int) -> np.ndarray:
    """Length of the prefix that each word has in common with the one ``near`` places after it."""
    flat, edges = flat_bytes(w)
    # Eight bytes from each place on, as one number; the first byte is the lowest.
    eight = np.ndarray(len(flat) + 1, "<u8", np.concatenate([flat, np.zeros(8, np.uint8)]), strides=(1,))
    length = np.diff(edges)
    most = np.minimum(length[:-near], length[near:])
    shared = most.copy()
    left, at = np.flatnonzero(most), 0
    while len(left):
        x = eight[edges[left] + at] ^ eight[edges[left + near] + at]
        differ = x != 0
        lowest = x[differ] & (~x[differ] + _U(1))
        own = left[differ]
        shared[own] = np.minimum(most[own], at + (np.frexp(lowest.astype(np.float64))[1] - 1) // 8)
        left, at = left[~differ & (most[left] > at + 8)], at + 8
    return shared


def _depths(w: pa.Array) -> np.ndarray:
    """Of sorted words: the longest prefix that PREFIX_MIN of them in a row have, the word among them."""
    near = PREFIX_MIN - 1
    if len(w) <= near:
        return np.zeros(len(w), np.int64)
    edge = np.zeros(near, np.int64)
    padded = np.concatenate([edge, _shared(w, near), edge])
    return np.max([padded[i : i + len(w)] for i in range(near + 1)], axis=0)


def prefix_depths(words: DataFrame, block: int = 1 << 14) -> DataFrame:
    """(word, mask, depth) of distinct words (word, mask): its prefixes of up to ``depth`` bytes begin PREFIX_MIN or more of all words.

    Words are sorted into ranges. The PREFIX_MIN - 1 words at either end of a range may share more with words of the next; all ranges' ends, ``block`` rows or so at once, are held against each other after.
    """
    near = PREFIX_MIN - 1

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        w = rows.column("word").combine_chunks()
        at = np.arange(len(w))
        place = np.where((at < near) | (at >= len(w) - near), at, -1)
        part = np.full(len(w), TaskContext.get().partitionId(), np.int32)
        for b in rows.append_column("depth", pa.array(_depths(w))).append_column("part", pa.array(part)).append_column("place", pa.array(place)).to_batches(max_chunksize=10_000):
            yield b

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(final: bool):
            """Depths of the words whose neighbours are all there."""
            nonlocal done
            w = [x[0] for x in held]
            stop = len(held) if final else max(done, len(held) - near)
            depth = np.maximum(_depths(pa.array(w, pa.binary())), [x[2] for x in held])[done:stop]
            own = held[done:stop]
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.binary()), pa.array([x[1] for x in own], pa.int64()), pa.array(depth, pa.int64())], ["word", "mask", "depth"])
            del held[: max(0, stop - near)]
            done = min(stop, near)
            return out

        held: list[tuple[bytes, int, int]] = []
        done = 0
        for batch in batches:
            held += zip(*[batch.column(c).to_pylist() for c in ("word", "mask", "depth")], strict=True)
            if len(held) > block:
                yield told(False)
        if held:
            yield told(True)

    found = materialise(words.select("word", "mask").orderBy("word").mapInArrow(ranges, "word binary, mask long, depth long, part int, place long"), "lm-depths")
    outer = found.where("place >= 0").select("word", "mask", "depth", "part", "place").repartition(1).sortWithinPartitions("part", "place").select("word", "mask", "depth")
    return found.where("place < 0").select("word", "mask", "depth").unionByName(outer.mapInArrow(ends, "word binary, mask long, depth long"))


def fit_tables(words: DataFrame) -> list[np.ndarray]:
    """The hashed tables from (word, mask, depth), summed over all tasks in slices of 2**SLICE cells."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((1 << log, 2), np.uint32) for log in TABLE_LOGS]
        some = False
        for run, classes, depths in _runs(batches):
            count_tables(run, classes, np.ones(len(run)), tables, depths)
            some = True
        for k, t in enumerate(tables if some else []):
            flat = t.reshape(-1)
            for i in range(0, len(flat), 1 << SLICE):
                where = np.flatnonzero(flat[i : i + (1 << SLICE)])
                if len(where):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i >> SLICE], pa.int32()), pa.array([where.astype(np.uint16).tobytes()], pa.binary()), pa.array([flat[i : i + (1 << SLICE)][where].astype(np.uint64).tobytes()], pa.binary())], ["k", "i", "cells", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, cells, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = sums.setdefault((k, i), np.zeros(1 << SLICE, np.uint64))
                own[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint64)
        for (k, i), own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([encode_counts(own).tobytes()], pa.binary())], ["k", "i", "counts"])

    parts = words.select("word", "mask", "depth").mapInArrow(part, "k int, i int, cells binary, counts binary")
    n = shuffle_partitions(words.sparkSession)
    sums = parts.repartition(n, "k", "i").mapInArrow(add, "k int, i int, counts binary")
    tables = [np.zeros(2 << log, np.uint8) for log in TABLE_LOGS]
    for row in sums.collect():  # the tables' fixed size in all
        tables[row["k"]][row["i"] << SLICE : (row["i"] + 1) << SLICE] = np.frombuffer(row["counts"], np.uint8)
    return [t.reshape(-1, 2) for t in tables]


def fit_weights(words: DataFrame, n_words: int, shared) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the spelling, averaged over shards of words by what each gate saw there, and the summed adaptive map. ``words``: (word, mask, depth)."""
    shards = max(1, -(-n_words // SPELL_SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            nonlocal seen, size, held
            if held:
                t.learn(pa.concat_arrays(words), np.concatenate(classes), np.ones(held), np.concatenate(depths))
                seen, size, held = seen + held, 0, 0
                for own in (words, classes, depths):
                    own.clear()

        def row():
            flush()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (t.weights, t.mass, t.map)]], ["shard", "weights", "mass", "map"])

        t, current, size, seen, held = None, None, 0, 0, 0
        words: list[pa.Array] = []
        classes: list[np.ndarray] = []
        depths: list[np.ndarray] = []
        for batch in batches:
            own, k, depth, rows = _classed(batch)
            if not len(own):
                continue
            shard = batch.column("shard").to_numpy()[rows]
            length = np.cumsum(pc.binary_length(own).to_numpy().astype(np.int64) + 1)
            last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True))  # a step ends with a row
            at = 0
            while at < len(own):
                if shard[at] != current:
                    if t is not None:
                        yield row()
                    t, current, seen = Trainer(shared.value), int(shard[at]), 0
                stop = int(np.searchsorted(shard, current, "right"))
                before = length[at - 1] if at else 0
                full = at + min(max(SPELL_STEPS[0], seen // 8), SPELL_STEPS[1]) - held
                long = int(np.searchsorted(length, before + 1_000_000 - size, "right")) + 1
                end = last[np.searchsorted(last, max(at, min(full, long) - 1))] + 1 if min(full, long) <= stop else stop
                words.append(own[at:end])
                held += int(end - at)
                classes.append(k[at:end])
                depths.append(depth[at:end])
                size += int(length[end - 1] - before)
                if min(full, long) <= stop:
                    flush()
                at = int(end)
        if t is not None:
            yield row()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((GATES, ORDERS + 1)), np.zeros(GATES), np.zeros((GATES, STEPS, 2))]
        for b in batches:
            for w, m, x in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True):
                own = np.frombuffer(m)
                sums[0] += np.frombuffer(w).reshape(sums[0].shape) * own[:, None]
                sums[1] += own
                sums[2] += np.frombuffer(x).reshape(sums[2].shape)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in sums], ["weights", "mass", "map"])

    shard = F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard")
    # The hash is a column: an expression would be computed anew for every comparison of the sort.
    ordered = words.select(shard, "word", "mask", "depth", F.xxhash64("word").alias("hash")).repartition(shuffle_partitions(words.sparkSession), "shard").sortWithinPartitions("shard", "hash", "word").drop("hash")
    # One small row a shard; they are added up as a stream, in order.
    rows = ordered.mapInArrow(run, "shard int, weights binary, mass binary, map binary").repartition(1).sortWithinPartitions("shard")
    row = rows.mapInArrow(add, "weights binary, mass binary, map binary").first()
    shapes = (GATES, ORDERS + 1), (GATES,), (GATES, STEPS, 2)
    weights, mass, map_ = (np.frombuffer(row[i]).reshape(x).copy() if row else np.zeros(x) for i, x in enumerate(shapes))
    seen = mass > 0
    overall = weights.sum(0) / max(1.0, mass.sum())
    weights[seen] /= mass[seen, None]
    weights[~seen] = overall
    return weights, map_


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a canonical Huffman code of counts in descending order; a single symbol has length 0."""
    n = len(counts)
    up = np.maximum(counts[::-1], max(1, int(counts.sum()) >> 40)).tolist()
    made: list[int] = []
    parent = [0] * max(0, 2 * n - 2)
    i = j = 0
    for k in range(n - 1):
        total = 0
        for _ in range(2):
            if j >= len(made) or (i < n and up[i] <= made[j]):
                total += up[i]
                parent[i] = n + k
                i += 1
            else:
                total += made[j]
                parent[n + j] = n + k
                j += 1
        made.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    length = np.sort(np.array(depth[:n], np.int64))
    codes, code, last = [], 0, 0
    for x in length.tolist():
        code <<= x - last
        codes.append(code)
        code, last = code + 1, x
    return length, np.array(codes, np.int64)


class Dictionary:
    """Frequent words by falling count: number 0 is the escape, 1 the end; each has a class and a path of bits."""

    def __init__(self, words: list[bytes], counts: np.ndarray, classes: np.ndarray, ends: int, escapes: int, n_classes: int, below: float):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words = [b"", END, *[words[i] for i in order]]
        self.counts = np.concatenate([[escapes, ends], np.array(counts, np.int64)[order]]).astype(np.int64)
        self.classes = np.concatenate([[n_classes, n_classes + 1], np.array(classes, np.int64)[order]]).astype(np.int64)
        self.n_classes = n_classes
        # The base model's logarithm and whether the word is known; of escaped words both are added elsewhere.
        self.base, self.known = np.log10(self.counts + 1) - below, (self.counts > 0).astype(np.int64)
        self.base[0] = self.known[0] = 0
        self.length, self.code = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        weight = np.bincount(self.classes, np.maximum(self.counts, 1), n_classes + 2)
        used = sorted(np.flatnonzero(weight).tolist(), key=lambda c: (-weight[c], c))
        for c, n, v in zip(used, *huffman(weight[used].astype(np.int64)), strict=True):
            own = np.flatnonzero(self.classes == c)
            own = own[np.argsort(-self.counts[own], kind="stable")]
            length, code = huffman(self.counts[own])
            self.length[own], self.code[own] = length + n, (v << length) | code

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words) if i}

    def open(self) -> None:
        """What a task needs besides."""
        if hasattr(self, "hash"):
            return
        i = np.arange(len(self.words))
        self.top = np.where(i < TOP_WORDS, i, TOP_WORDS + self.classes)
        left = self.length[:, None] - np.arange(MIXED + 1)
        code = self.code[:, None] >> np.maximum(left, 0)
        nodes = np.where(left >= 0, code | (1 << np.arange(MIXED + 1)), 0)
        # Twice the node plus the bit; 0 beyond the path.
        self.last = np.where(left[:, :-1] > 0, nodes[:, :-1] * 2 + (nodes[:, 1:] & 1), 0).astype(np.int16)
        # The rest of long paths: the word's share of all words whose paths begin alike, as it is and with one occurrence less.
        own = np.maximum(self.counts, 1).astype(np.float64)
        group = np.bincount(nodes[:, -1], own, 2 << MIXED)[nodes[:, -1]]
        long = left[:, -1] > 0
        self.tail = np.stack([np.where(long, np.log2(np.maximum(own - x, 0.5) / np.maximum(group - x, 0.5)), 0) for x in (0, 1)])
        flat, edges = flat_bytes(pa.array(self.words, pa.binary()))
        self.symbol = np.zeros(len(self.words), np.int64)
        self.symbol[2:] = ~np.isin(flat[edges[3:] - 1], np.array(sorted(_ALNUM), np.uint8))
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.known_words = pa.array(self.words[1:], pa.binary())
        #: Bytes that are coded for a word: its own and one after it.
        self.size = np.diff(edges) + 1
        self.size[1] = 1
        # Votes for a language are bytes of one number, of up to 32 words at once.
        self.vote = np.where(self.classes < self.n_classes, _U(1) << (8 * np.minimum(self.classes, 7)).astype(np.uint64), _U(0))

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(numbers of words, where texts begin, escaped words, how many each text has). A text's last word is the end."""
        flat, edges = split(texts)
        ends = edges[1:] + np.arange(len(edges) - 1)
        word = np.ones(len(flat) + len(ends), bool)
        word[ends] = False
        ids = np.ones(len(word), np.int64)
        ids[word] = pc.fill_null(pc.index_in(flat, value_set=self.known_words), -1).to_numpy() + 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        escapes = np.flatnonzero(ids == 0)
        doc = np.searchsorted(ends, escapes)
        return ids, starts, flat.take(pa.array(escapes - doc)).to_pylist(), np.bincount(doc, minlength=len(ends))


def contexts(d: Dictionary, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(4, words): the context of each predictor, for documents that begin at ``starts``. Only words before a word count."""
    n = len(ids)
    at = np.arange(n)
    start = np.repeat(starts, np.diff(np.append(starts, n)))
    before = lambda x, k, none: np.where(at - k >= start, x[np.maximum(at - k, 0)], none)
    none = TOP_WORDS + d.n_classes + 2
    votes = np.concatenate([[_U(0)], np.cumsum(d.vote[ids], dtype=np.uint64)])
    votes = votes[at] - votes[np.maximum(at - 32, start)]
    # The class of most votes, the first of equal ones.
    best = np.zeros(n, np.int64)
    for c in range(d.n_classes):
        np.maximum(best, (((votes >> _U(8 * c)) & _U(255)).view(np.int64) << 3) + (7 - c), out=best)
    language = np.where(votes > 0, 7 - (best & 7), d.n_classes)
    symbols = np.concatenate([[0], np.cumsum(d.symbol[ids])])
    symbols = symbols[at] - symbols[np.maximum(at - 8, start)]
    return np.stack([np.zeros(n, np.int64), language * 16 + symbols, before(d.top[ids], 1, none), before(d.top[ids], 2, none)])


def blocks(k: int, context: np.ndarray) -> np.ndarray:
    """The first slots of predictor k's contexts."""
    some = WORD_LOGS[k] - MIXED
    h = (context.astype(np.uint64) + _U(1)) * _MUL[2]
    return (((h ^ (h >> _U(32))) * _MUL[0] >> _U(64 - some)) << _U(MIXED)).astype(np.int32) if some else np.zeros(len(context), np.int32)


def count_paths(d: Dictionary, ids: np.ndarray, context: np.ndarray, tables: list[np.ndarray]) -> None:
    """Add the bits of words to the tables, arrays of slots * 2."""
    one = tables[0].dtype.type(1)
    for at in range(0, len(ids), 20_000):
        own = np.ascontiguousarray(d.last.take(ids[at : at + 20_000], axis=0).T).astype(np.int64)  # long rows are quick to add to
        for k, table in enumerate(tables):
            if WORD_LOGS[k] == MIXED:  # one context
                table += np.bincount(own.reshape(-1), minlength=len(table)).astype(table.dtype)
            else:
                np.add.at(table, (own + blocks(k, context[k, at : at + 20_000]) * 2).reshape(-1), one)
    for table in tables:  # what lies beyond a path's end has no node
        table[:: 2 << MIXED] = 0


PREDICTORS, WORD_GATES = len(WORD_LOGS), 48
#: What a context's occurrences add to the number of the gate: of the word before, and of the word two before.
GATE_OF = {2: np.minimum(SEEN, 11).astype(np.int8) * np.int8(4), 3: np.minimum(SEEN / 3, 3).astype(np.int8)}
TILED = np.tile(squash((np.arange(STEPS) - STEPS // 2) / 2), WORD_GATES)


class Mixer:
    """One shard's stream: predicts a step, then learns from it."""

    def __init__(self, d: Dictionary, tables: list[np.ndarray]):
        self.d, self.tables = d, [t.reshape(-1).view(np.uint16) for t in tables]
        self.weights = np.full((PREDICTORS + 1, WORD_GATES), 0.3)
        self.weights[-1] = 0
        self.squares = np.full(self.weights.shape, 1e-3)
        self.map = np.zeros((WORD_GATES * STEPS, 2))
        self.stretches = np.full((4, 4, 2), 0.5)

    def step(self, ids: np.ndarray, context: np.ndarray, train: np.ndarray) -> np.ndarray:
        """log2 probability of each word. ``train``: is it of a training document?"""
        d = self.d
        # A row for each bit of the paths: long rows are quick.
        last = np.ascontiguousarray(d.last.take(ids, axis=0).T).astype(np.int64)
        bit, valid, nodes = last & 1, last > 0, last >> 1
        less = (1 + bit) * (train.astype(np.int64) << 16)
        x: list[np.ndarray] = []
        gate_ = np.zeros(bit.shape, np.int8)
        for k, table in enumerate(self.tables):
            found = table.take(nodes + blocks(k, context[k])) + less
            x.append(LOG_ODDS.take(found))
            if k in GATE_OF:
                gate_ += GATE_OF[k].take(found)
        gate_ = gate_.astype(np.int64)
        weights = self.weights.astype(np.float32)
        z = weights[-1].take(gate_)
        for k in range(PREDICTORS):
            z += weights[k].take(gate_) * x[k]
        np.clip(z, -30, 30, out=z)
        near = np.rint(z + z)
        np.clip(near, -(STEPS // 2), STEPS // 2, out=near)
        cell = gate_ * STEPS + near.astype(np.int64) + STEPS // 2
        share = (self.map[:, 1] + 20 * TILED) / (self.map[:, 0] + self.map[:, 1] + 20)
        refined = np.log(share / (1 - share)).astype(np.float32)
        final = (z + refined.take(cell)) / 2
        np.clip(final, -20, 20, out=final)
        bit_ = bit.astype(np.float32)
        cost = np.log(1 + np.exp(final * (1 - 2 * bit_))) * valid
        if train.any():
            learned = valid & train
            counted = np.bincount((cell * 2 + bit).reshape(-1), learned.reshape(-1), self.map.size)
            self.map += counted.reshape(self.map.shape)
            mass = np.maximum(counted.reshape(WORD_GATES, -1).sum(1), 1)
            # Neighbours are summed apart, then together: equal numbers next to each other are slow to count.
            g = (gate_ + np.arange(len(ids)) % 8 * WORD_GATES).reshape(-1)
            sums = lambda v: np.bincount(g, v, 8 * WORD_GATES).reshape(8, WORD_GATES).sum(0)
            error = ((1 / (1 + np.exp(-z)) - bit_) * learned).reshape(-1)
            for k in range(PREDICTORS + 1):
                slope = sums(error * x[k].reshape(-1) if k < PREDICTORS else error) / mass
                self.squares[k] += slope**2
                self.weights[k] -= 0.05 * slope / np.sqrt(self.squares[k])
        total = cost[: MIXED // 2].astype(np.float64) + cost[MIXED // 2 :]
        total = total[: MIXED // 4] + total[MIXED // 4 :]
        return d.tail[train.astype(np.int64), ids] - total.sum(0) / np.log(2)

    def flags(self, found: list[tuple[int, bool, int]], train: bool) -> float:
        """log2 probability of a document's (stretch, does it follow?, occurrences), which are in order."""
        total, run = 0.0, 0
        for _, hit, n in found:
            cell = self.stretches[min(run, 3), min(n.bit_length() - 1, 3)]
            total += np.log2(cell[int(hit)] / (cell[0] + cell[1]))
            if train:
                cell[int(hit)] += 1
            run = run + 1 if hit else 0
        return float(total)


def word_hashes(d: Dictionary, ids: np.ndarray, rare: list[bytes]) -> np.ndarray:
    """64 bits of each word; ``rare`` are the words of number 0, in order."""
    h = d.hash[ids]
    h[ids == 0] = np.fromiter(map(xxhash.xxh3_64_intdigest, rare), np.uint64, len(rare))
    return h


def stretches(h: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, contexts, digests) of the stretches of documents that begin at ``edges`` (one alone without them), from their words' hashes, each end's last.

    A stretch reaches to the next one of its document or the end.
    """
    edges = np.zeros(1, np.int64) if edges is None else edges
    n = np.diff(np.append(edges, len(h)))
    pair = h[:-2] * _MUL[1] + h[1:-1] * _MUL[3]
    pair = (pair ^ (pair >> _U(31))) * _MUL[2]
    starts = np.flatnonzero((pair >> _U(20)) % _U(SPACING) == 0) + 2
    doc = np.searchsorted(edges, starts, "right") - 1
    own = starts >= edges[doc] + 2
    starts, doc = starts[own], doc[own]
    if not len(starts):
        return starts, starts.astype(np.uint64), starts.astype(np.uint64)
    first = edges[doc]
    context = np.zeros(len(starts), np.uint64)
    for i in range(CONTEXT, 0, -1):
        context = (context + np.where(starts - first >= i, h[np.maximum(starts - i, 0)], _U(0))) * _U(_P)
        context ^= context >> _U(32)
    ends = np.minimum(np.append(starts[1:], len(h)), first + n[doc])
    length = ends - starts
    power = np.cumprod(np.concatenate([[_U(1)], np.full(int(length.max()), _U(_P))]), dtype=np.uint64)
    # Words of stretches alone, one stretch after the other.
    before = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(before, length)
    mixed = h[np.repeat(starts, length) + place]
    mixed = (mixed ^ (mixed >> _U(30))) * _MUL[0]
    return starts, context, np.add.reduceat(mixed * power[place], before) ^ length.astype(np.uint64)


def escaped(c: np.ndarray, spelled: np.ndarray, n: int, discount: float, back: float) -> np.ndarray:
    """log10 probability of an escaped word from its count, of ``n`` in all, and the log10 probability of its spelling."""
    own = np.maximum(c - discount, 0) / max(n, 1)
    low = spelled + np.log10(max(back, 1e-12))  # its power of 10 may be below any float
    return np.where(own > 0, np.log10(own + 10.0 ** np.maximum(low, -300), where=own > 0, out=np.zeros_like(own)), low)


def _is_hot(vocab: DataFrame):
    """The condition that a word is in the dictionary: above the lowest count bucket by which there are at most HOT_WORDS."""
    bucket = F.floor(F.log2("c") * 16).cast("int")
    fits = (F.col("c") > 1) & (F.length("word") <= HOT_LENGTH) & (F.col("word") != F.lit(END))
    sizes, n, least = {r["bucket"]: r["count"] for r in vocab.where(fits).groupBy(bucket.alias("bucket")).count().collect()}, 0, 1 << 30
    for b in sorted(sizes, reverse=True):
        n += sizes[b]
        if n > HOT_WORDS:
            break
        least = b
    return fits & (bucket >= least)


def _groups(starts: np.ndarray, n: int, most: int = 100_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents, which begin at ``starts`` in ``n`` words, of some ``most`` words each."""
    ends = np.append(starts[1:], n)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
        yield at, stop
        at = stop


def read_numbers(docs: DataFrame, hot) -> tuple[DataFrame, DataFrame, list[np.ndarray]]:
    """What words' numbers tell before the stream: (doc_id, h, train, i, context, digest) of all stretches, (doc_id, h, held_out, blob) of all documents, and the word predictors' tables.

    The tables are counted over the training documents and summed over all tasks in slices of 2**SLICE cells.
    """
    names = ["doc_id", "h", "train", "i", "context", "digest", "k", "slice", "blob"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = hot.value
        d.open()
        tables = [np.zeros(2 << log, np.uint32) for log in WORD_LOGS]
        z = zstandard.ZstdCompressor(level=3)
        for batch in _pieces(batches):
            ids, starts, rare, n_rare = d.numbers(batch.columns[-1])
            rare_ends = np.cumsum(n_rare).tolist()
            made = [pack_document(z, ids[a:b], rare[c:e]) for a, b, c, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], [0, *rare_ends[:-1]], rare_ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], *[pa.nulls(len(made), t) for t in kinds[3:8]], pa.array(made, pa.binary())], names)
            h, train = word_hashes(d, ids, rare), batch.column("train").to_numpy(zero_copy_only=False)
            for a, b in _groups(starts, len(ids)):
                first, last = starts[a], starts[b] if b < len(starts) else len(ids)
                own, edges = ids[first:last], starts[a:b] - first
                at, context, digest = stretches(h[first:last], edges)
                doc = np.searchsorted(edges, at, "right") - 1
                i = np.arange(len(at)) - np.searchsorted(doc, doc)
                rows = pa.array(doc + a)
                made = [*[batch.column(c).take(rows) for c in ("doc_id", "h", "train")], pa.array(i.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in (context, digest)]]
                yield pa.RecordBatch.from_arrays([*made, *[pa.nulls(len(at), t) for t in kinds[6:]]], names)
                learned = np.repeat(train[a:b], np.diff(np.append(edges, len(own))))
                count_paths(d, own[learned], contexts(d, own, edges)[:, learned], tables)
        for k, flat in enumerate(tables):
            for i in range(0, len(flat), 1 << SLICE):
                own = flat[i : i + (1 << SLICE)]
                if own.any():
                    made = [pa.array([k], pa.int32()), pa.array([i >> SLICE], pa.int32()), pa.array([z.compress(own.tobytes())], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in kinds[:6]], *made], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, i, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = np.frombuffer(z.decompress(counts), np.uint32)
                sums.setdefault((k, i), np.zeros(len(own), np.uint64))[:] += own
        for (k, i), own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([encode_counts(own).tobytes()], pa.binary())], ["k", "slice", "counts"])

    read = docs.select("doc_id", "h", "train", "text").mapInArrow(part, "doc_id long, h long, train boolean, i int, context long, digest long, k int, slice int, blob binary")
    read = materialise(read, "lm-places")
    parts = read.where("k IS NOT NULL").select("k", "slice", F.col("blob").alias("counts"))
    sums = parts.repartition(shuffle_partitions(docs.sparkSession), "k", "slice").mapInArrow(add, "k int, slice int, counts binary")
    tables = [np.zeros(2 << log, np.uint8) for log in WORD_LOGS]
    for row in sums.collect():  # the tables' fixed size in all
        tables[row["k"]][row["slice"] << SLICE : (row["slice"] + 1) << SLICE] = np.frombuffer(row["counts"], np.uint8)
    return read.where("i IS NOT NULL").select("doc_id", "h", "train", "i", "context", "digest"), read.where("i IS NULL AND k IS NULL").select("doc_id", "h", (~F.col("train")).alias("held_out"), "blob"), tables


def matched(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, i, hit, n): of the stretches that another training document has after the same words, does the same follow here? n: occurrences. And the stored table it reads besides."""
    one = F.struct("h", "digest")
    source = places.where("train").groupBy("context").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.count("*").alias("n"))
    source = materialise(source, "lm-stretches")
    free(places.sparkSession)
    # Contexts of more than a thousandth of all places, a thousand at most, are salted.
    hot_n = max(50_000, places.count() // 1000)
    salted = F.broadcast(source.where(F.col("n") > hot_n).select(F.col("context").alias("hc"), F.least(F.lit(64), F.ceil(F.col("n") / hot_n)).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    ask = places.join(salted, places["context"] == salted["hc"], "left").withColumn("salt", F.pmod("h", salts).cast("int"))
    tell = source.join(salted, source["context"] == salted["hc"], "left").select("context", "low", "high", "n", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    met = ask.join(tell, ["context", "salt"])
    expected = F.when(~F.col("train") | (F.col("low.h") != F.col("h")), F.col("low.digest")).when(F.col("high.h") != F.col("h"), F.col("high.digest"))
    return met.withColumn("expected", expected).where("expected IS NOT NULL").select("doc_id", "h", "i", (F.col("expected") == F.col("digest")).alias("hit"), "n"), source


def pack_document(z: zstandard.ZstdCompressor, ids: np.ndarray, rare: list[bytes]) -> bytes:
    """The numbers of a document's words, byte by byte, and its escaped words, compressed."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T)
    return z.compress(b"".join([len(ids).to_bytes(4, "little"), planes.tobytes(), b" ".join(rare)]))


def unpack_document(z: zstandard.ZstdDecompressor, blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    made = z.decompress(blob)
    n = int.from_bytes(made[:4], "little")
    low, mid, high = np.frombuffer(made, np.uint8, 3 * n, 4).reshape(3, n).astype(np.int64)
    return low | mid << 8 | high << 16, made[4 + 3 * n :].split()


#: How a task's escaped words are packed for a bucket: lengths of the distinct words, their pairs with a class (number of the word, class, occurrences), the
#: occurrences (h, doc_id, 2 if it is coded there plus 1 if it is of training), bytes of the words.
ASKED = ("<u4", "<u4", "u1", "<u4", "<i8", "<i8", "u1", "u1")


class Pending:
    """A shard's words that wait for a full step, and its documents that wait for their scores."""

    def __init__(self, mixer: Mixer):
        self.mixer = mixer
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0
        self.scores: list[float] = []
        self.rows: list[tuple] = []

    def add(self, ids: np.ndarray, context: np.ndarray, train: np.ndarray, doc: np.ndarray, extra: list[float]) -> None:
        """Words of documents ``doc``, numbered from the first that is new; ``extra`` is what each new document has besides."""
        if len(ids):
            self.parts.append((ids, context, train, doc + len(self.scores)))
        self.scores += extra
        self.n += len(ids)

    def run(self, everything: bool) -> None:
        """Score full steps; the rest, too, at the end of the shard."""
        if not self.n or (self.n < STEP and not everything):
            return
        ids, context, train, doc = (np.concatenate([p[i] for p in self.parts], axis=-1) for i in range(4))
        at = 0
        while at + STEP <= self.n or (everything and at < self.n):
            own = slice(at, at + STEP)
            bits = self.mixer.step(ids[own], context[:, own], train[own])
            low = doc[at]
            for k, x in enumerate(np.bincount(doc[own] - low, bits).tolist()):
                self.scores[low + k] += x
            at += STEP
        self.parts = [(ids[at:], context[:, at:], train[at:], doc[at:])] if at < self.n else []
        self.n = max(0, self.n - at)

    def done(self, everything: bool) -> list[tuple]:
        """Rows (..., score) of documents with all words scored."""
        first = len(self.scores) if everything or not self.n else int(self.parts[0][3][0])
        out = [(*r[:-1], self.scores[r[-1]] * float(np.log10(2))) for r in self.rows if r[-1] < first]
        self.rows = [r for r in self.rows if r[-1] >= first]
        return out


def score_group(group: list[tuple], pending: Pending, d: Dictionary, ask) -> None:
    """Add documents of one shard in order, (h, doc_id, held_out, ids, escaped words, [(stretch, hit, n)], copies), to what waits."""
    n = np.array([len(x[3]) for x in group])
    ids = np.concatenate([x[3] for x in group])
    starts = np.cumsum(n) - n
    context = contexts(d, ids, starts)
    coded = np.ones(len(ids), bool)
    extra = [pending.mixer.flags(x[5], not x[2]) for x in group]
    met = [k for k, x in enumerate(group) if any(hit for _, hit, _ in x[5])]
    if met:
        begins = np.cumsum(n[met]) - n[met]
        at = stretches(word_hashes(d, np.concatenate([group[k][3] for k in met]), [w for k in met for w in group[k][4]]), begins)[0]
        for k, begin, a, b in zip(met, begins.tolist(), np.searchsorted(at, begins).tolist(), np.searchsorted(at, begins + n[met]).tolist(), strict=True):
            edges = [*(at[a:b] - begin).tolist(), int(n[k])]
            for i, hit, _ in group[k][5]:
                if hit:
                    coded[starts[k] + edges[i] : starts[k] + edges[i + 1]] = False
    escapes = np.flatnonzero(ids == 0)
    if len(escapes):
        times = [len(x[4]) for x in group]
        h, doc_id, train = (np.repeat(np.array(x, kind), times) for x, kind in (([g[0] for g in group], np.int64), ([g[1] or 0 for g in group], np.int64), ([not g[2] for g in group], bool)))
        ask([w for x in group for w in x[4]], context[1, escapes] // 16 % d.n_classes, h, doc_id, coded[escapes] * 2 + train)
    known, base, size = (np.add.reduceat(x[ids], starts).tolist() for x in (d.known, d.base, d.size))
    first = len(pending.scores)
    for i, (h, doc_id, held_out, own, rare, _, copies) in enumerate(group):
        pending.rows += [(doc_id, h, held_out, len(own), known[i], base[i], size[i] + sum(map(len, rare)), first + i)] * copies
    doc = np.repeat(np.arange(len(group)), n)
    train = np.repeat([not x[2] for x in group], n)
    pending.add(ids[coded], context[:, coded], train[coded], doc[coded], extra)


def score_numbers(rows: Iterator[tuple], d: Dictionary, tables: list[np.ndarray], ask, flush: int = 8 * STEP) -> Iterator[list[tuple]]:
    """score_stream of rows (shard, h, doc_id, held_out, ids, escaped words, [(stretch, hit, n)]); ``flush`` words or so at once."""
    shard, pending, size = None, None, 0
    group: list[tuple] = []
    last = None

    def flushed(everything: bool) -> list[tuple]:
        if group:
            score_group(group, pending, d, ask)
            group.clear()
        pending.run(everything)
        return pending.done(everything)

    for s, h, doc_id, held_out, ids, rare, found in rows:
        if s != shard:
            if pending and (out := flushed(True)):
                yield out
            shard, pending, size, last = s, Pending(Mixer(d, tables)), 0, None
        if last == (h, doc_id):  # the group isn't scored before another document comes
            group[-1] = (*group[-1][:-1], group[-1][-1] + 1)
            continue
        if size >= flush:
            if out := flushed(False):
                yield out
            size = 0
        last = (h, doc_id)
        group.append((h, doc_id, held_out, ids, rare, sorted(set(found)), 1))
        size += len(ids)
    if pending and (out := flushed(True)):
        yield out


def score_stream(rows: Iterator[tuple], d: Dictionary, number: dict[bytes, int], tables: list[np.ndarray], ask) -> Iterator[list[tuple]]:
    """Documents of whole shards in order, rows (shard, h, doc_id, held_out, text, [(stretch, hit, n)]) -> (doc_id, h, held_out, n_tokens, known, base, bytes, score).

    ``ask`` is called with the escaped words of some documents, one by one, and arrays of their classes, h, doc_id, and 2 if it is coded plus 1 if it is of training; they are missing
    in the sums. Rows equal in (h, doc_id) follow each other and are one document.
    """

    def numbered():
        for s, h, doc_id, held_out, text, found in rows:
            own = tokens(text)
            place = [number.get(w, 0) for w in own]
            yield s, h, doc_id, held_out, np.array([*place, 1], np.int64), [w for w, i in zip(own, place, strict=True) if not i], found

    return score_numbers(numbered(), d, tables, ask)


def free(spark: SparkSession, *stored: DataFrame) -> None:
    """Delete the folders of ``stored``, which materialise wrote and nothing reads again, and let Spark remove shuffles that no plan holds: they would stay until the driver's next full collection."""
    for folder in {f.rpartition("/")[0] for df in stored for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def score_documents(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of ``docs`` (doc_id, text).

    The bytes are those that are coded: of the words, with one byte for the space or the end after each.
    """
    spark = docs.sparkSession
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"), (crc32_mod("doc_id", modulus) == held_out).alias("held_out"))
    d = d.withColumn("train", ~F.col("held_out")).withColumn("h", F.xxhash64("text", F.col("doc_id").cast("string")))
    langs = [r["lang"] for r in d.where("train AND lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    size = len(langs) + 1
    counted = materialise(word_counts(d, langs), "lm-words")
    vocab = counted.where("word IS NOT NULL").select("word", "c", "mask", "by")
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    below = float(np.log10(n + v + 1))
    is_hot = _is_hot(vocab)
    t = vocab.where(is_hot).select("word", "c", "by").toArrow()  # HOT_WORDS rows at most
    by = np.array(t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64).reshape(t.num_rows, size)
    rare = vocab.where(~F.coalesce(is_hot, F.lit(False)) & (F.col("word") != F.lit(END)))
    n_rare, v_rare, ones, twos = rare.agg(F.coalesce(F.sum("c"), F.lit(0)), *[F.count(F.when(x, 1)) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)]).first()
    end = vocab.where(F.col("word") == F.lit(END)).first()["c"]
    dictionary = Dictionary(t.column(0).to_pylist(), t.column(1).to_numpy(), by.argmax(1) if t.num_rows else np.zeros(0), end, n_rare, size, below)
    hot = spark.sparkContext.broadcast(dictionary)
    # Every escaped word may be new: at most 0.95 of an occurrence stays with it. With one occurrence each, nearly all goes to the spelling.
    discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))
    back = min(1.0, discount * v_rare / n_rare) if n_rare else 1.0
    words = prefix_depths(vocab.where("c >= 1").select("word", "mask"))
    spelling = spark.sparkContext.broadcast(fit_tables(words))
    weights = fit_weights(words, v, spelling)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(spelling.value, *weights)
        for own, classes, _ in _runs(batches):
            p = np.bincount(classes, 2.0 ** model.log2(own, classes), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(p)], ["k", "p"])

    # A word that is escaped isn't in the dictionary, whose share of the spellings (in the classes where its words occur) falls to the others.
    taken = {r["k"]: r["p"] for r in vocab.where(is_hot).select("word", "mask", F.lit(0).cast("long").alias("depth")).mapInArrow(share, "k long, p double").groupBy("k").agg(F.sum("p").alias("p")).collect()}
    beyond = np.log10(1 - np.minimum([taken.get(k, 0.0) for k in range(size)], 0.99))
    free(spark, words)
    places, packed, tables = read_numbers(d, hot)
    paths = spark.sparkContext.broadcast(tables)
    shard = F.pmod("h", F.lit(max(1, -(-n // SHARD_WORDS)))).cast("int").alias("shard")

    none = lambda kind: F.lit(None).cast(kind)
    met, sources = matched(places)
    stream = met.select("doc_id", "h", none("boolean").alias("held_out"), none("binary").alias("blob"), "i", "hit", "n")
    stream = stream.unionByName(packed.select("*", none("int").alias("i"), none("boolean").alias("hit"), none("long").alias("n")))
    stream = stream.select(shard, "*").repartitionById(shuffle_partitions(spark), F.col("shard") % shuffle_partitions(spark)).sortWithinPartitions("shard", "h", "doc_id", F.col("blob").isNotNull())
    names = ["doc_id", "h", "held_out", "n_tokens", "known", "base", "bytes", "lp", "p", "blob"]
    n_buckets = shuffle_partitions(spark)
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two kinds of rows: a document's sums, and requests for the escaped words of a bucket."""
        d = hot.value
        d.open()
        u, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        words: list[bytes] = []
        lists: list[tuple[np.ndarray, ...]] = []  # class, h, id, whether it is coded and to leave one out

        def ask(own, *arrays):
            words.extend(own)
            lists.append(arrays)

        def requests():
            own = pa.array(words, pa.binary()).dictionary_encode()
            p = buckets(own.dictionary, n_buckets)
            by_bucket = np.argsort(p, kind="stable")
            rank = np.empty(len(p), np.int64)
            rank[by_bucket] = np.arange(len(p))
            k, *told = (np.concatenate(x) for x in zip(*lists, strict=True))
            words.clear()
            lists.clear()
            cell = rank[own.indices.to_numpy()] * size + k
            order = np.argsort(cell, kind="stable")
            pairs, first = _cuts(cell[order])
            pairs, first = np.array(pairs, np.int64), np.array(first, np.int64)
            h, doc_id, kind = (x[order] for x in told)
            flat, edges = flat_bytes(own.dictionary.take(pa.array(by_bucket)))
            length, times = np.diff(edges).astype("<u4"), np.diff(first).astype("<u4")
            found, cuts = _cuts(p[by_bucket])
            ends = np.searchsorted(pairs, np.array(cuts, np.int64) * size).tolist()
            made = []
            for a, b, c, e in zip(cuts, cuts[1:], ends, ends[1:], strict=False):
                at = slice(first[c], first[e])
                made.append(pack_arrays(z, length[a:b], (pairs[c:e] // size - a).astype("<u4"), (pairs[c:e] % size).astype(np.uint8), times[c:e], h[at], doc_id[at], kind[at].astype(np.uint8), flat[edges[a] : edges[b]]))
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(made), t) for t in kinds], pa.array(found, pa.int32()), pa.array(made, pa.binary())], names)

        def rows():
            found = []
            for batch in batches:
                for s, i, h, held, blob, at, hit, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if blob is None:
                        found.append((at, hit, n))
                    else:
                        yield s, h, i, held, *unpack_document(u, blob), found
                        found = []

        for done in score_numbers(rows(), d, paths.value, ask):
            if done:
                made = [pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*made, *[pa.nulls(len(done), t) for t in (pa.int32(), pa.binary())]], names)
            if len(words) > FLUSH_PAIRS:
                yield requests()
        if words:
            yield requests()

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over some of a document's escaped words, from a bucket's counts and the requests after them."""
        model, width, u = Model(spelling.value, *weights), len(beyond), zstandard.ZstdDecompressor()
        held: list[list[np.ndarray]] = []
        known_words, counts, current, size = None, None, None, 0

        def rows():
            own = pa.concat_arrays([words_of(x[0], x[-1]) for x in held]).dictionary_encode()
            # In the order of words, neighbours share their beginnings.
            by_word = pc.array_sort_indices(own.dictionary).to_numpy()
            distinct = own.dictionary.take(pa.array(by_word))
            rank = np.empty(len(by_word), np.int64)
            rank[by_word] = np.arange(len(by_word))
            number, before = rank[own.indices.to_numpy()], np.cumsum([0, *[len(x[0]) for x in held]]).tolist()
            asked, k, times, h, i, kind = (np.concatenate([x[at] + a if at == 1 else x[at] for a, x in zip(before, held, strict=False)]) for at in range(1, 7))
            held.clear()
            pairs, at = np.unique(number[asked] * width + k, return_inverse=True)
            classes = pairs % width
            found = pc.fill_null(pc.index_in(distinct, value_set=known_words), -1).to_numpy()
            c = np.where(found < 0, 0, counts[found])[pairs // width]
            spelled = np.empty(len(pairs))
            length = np.cumsum(pc.binary_length(distinct).to_numpy().astype(np.int64)[pairs // width] + 1)
            a = 0
            while a < len(pairs):  # a million bytes or so at once
                long = int(np.searchsorted(length, (length[a - 1] if a else 0) + 1_000_000, "right"))
                part = slice(a, max(a + 1, min(a + (1 << 14), long)))
                spelled[part] = model.log2(distinct.take(pa.array(pairs[part] // width)), classes[part]) * np.log10(2) - beyond[classes[part]]
                a = part.stop
            lp, less = (escaped(np.maximum(x, 0), spelled, n_rare, discount, back) for x in (c, c - 1))
            at = np.repeat(at, times)
            # Documents apart by h alone would do but for chance; a document that comes twice is summed later.
            order = np.argsort(h)
            h, i, kind, at = h[order], i[order], kind[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1])]))
            known, base, lp = (np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64)[at], (np.log10(c + 1) - below)[at], (kind >> 1) * np.where(kind & 1, less[at], lp[at])))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[first], i[first], known, base, lp)], ["key2", "id2", "known2", "base2", "lp2"])

        for batch in batches:
            for p, request, blob in zip(batch.column("p").to_pylist(), batch.column("request").to_pylist(), batch.column("blob"), strict=True):
                if held and (p != current or size > FLUSH_PAIRS):
                    yield rows()
                    size = 0
                current = p
                if request:
                    held.append(unpack_arrays(u, blob.as_buffer(), *ASKED))
                    size += len(held[-1][4]) + len(held[-1][-1]) // 64
                else:
                    length, counts, flat = unpack_arrays(u, blob.as_buffer(), "<u4", "<i8", "u1")
                    known_words = words_of(length, flat)
        if held:
            yield rows()

    asked = stream.mapInArrow(score, "doc_id long, h long, held_out boolean, n_tokens long, known long, base double, bytes long, lp double, p int, blob binary")
    asked = materialise(asked, "lm-asked")
    free(spark, places, sources)
    head = asked.where("p IS NULL").drop("p", "blob")
    told = asked.where("p IS NOT NULL").select("p", F.lit(True).alias("request"), "blob").unionByName(counted.where("word IS NULL").select("p", F.lit(False).alias("request"), "blob"))
    told = told.repartitionById(n_buckets, "p").sortWithinPartitions("p", "request")
    told = told.mapInArrow(answers, "key2 long, id2 long, known2 long, base2 double, lp2 double")
    told = told.groupBy("key2", "id2").agg(F.sum("known2").alias("known2"), F.sum("base2").alias("base2"), F.sum("lp2").alias("lp2"))
    out = head.join(told, (F.col("h") == F.col("key2")) & (F.coalesce("doc_id", F.lit(0)) == F.col("id2")), "left")
    zero = F.lit(0.0)
    score_ = F.col("lp") + F.coalesce("lp2", zero)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), score_.alias("score"), (-score_ / F.lit(float(np.log10(2))) / F.col("bytes")).alias("bits_per_byte"),
    )
