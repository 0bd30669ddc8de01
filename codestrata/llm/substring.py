"""Substring dedup by hashing of units.

Method: every text is cut into units; a unit is normalised (lower case, white space collapsed) and hashed; digests are grouped over all
documents, the earliest ranked occurrence stays, and every other one is removed. What is removed is given with its offsets in the
original text. Only stretches of ``MIN_RUN`` or more neighbouring words go: shorter ones are phrases and set lines that texts share anyway.

Units: a text can be cut at line starts, after sentence ends, before words that begin with a capital, and before words whose hash is the
least of some ``WINDOW`` neighbouring words. The last kind depends on the words alone, so any ``WINDOW`` words of a repeated passage have a cut
that all its copies share, wherever the passage was pasted. A unit begins at each cut and ends at the first one that is ``min_words`` or more
words further on; at line ends one also ends, that begins at the last cut ``min_words`` or more words before, so that whole lines go to their last word. Of a repeated passage at most ``WINDOW - 1`` words stay at its beginning and about three times as many at its end,
where the words after it may move the last cuts; copies broken into lines or sentences differently may keep words at those places, too. Units overlap; a word of a unit's earliest occurrence stays, even if another
unit over it goes.

Scale: a task sends each digest once, with its earliest occurrence there; the others it knows to be gone. So a unit held by a third of
all documents costs one row a task in the comparison by digest. The answer isn't joined back to the occurrences (a hot join key) but sent to the
documents that lose a unit, as numbers of units, and this join is by document, whose keys are unique. Digests of 12 bytes and positions are
shuffled besides one exchange of the texts. Words, cuts and digests are made of the bytes of many texts at once, never word by word.

Edge cases: units of fewer than ``min_words`` words (the end of a text, short texts) are kept; null and empty texts come out unchanged;
the rank is (doc_id, null last, then a hash of the text, then position), so ties are decided by content; rows equal in doc_id and text
are one document to this operator, and each gets the same result; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import carried, other_fields

MIN_WORDS = 8
#: So many neighbouring words have a cut among them.
WINDOW = 8
#: The fewest neighbouring words that are removed.
MIN_RUN = 20
FLUSH_UNITS = 200_000
#: So many characters of texts are cut at once, but for longer texts; words of so many bytes have their hashes from a table.
SLICE_CHARS, TABLE_BYTES = 1 << 18, 64
_WORDS = re.compile(r"\S+")
#: White space for str.split() beyond ASCII.
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE, _UPPER, _END = (np.array([f(chr(b)) for b in range(128)] + [False] * 128) for f in (str.isspace, str.isupper, ".!?".__contains__))
#: No capital lies beyond.
_CAPITAL = np.array([chr(c).isupper() for c in range(0x20000)])
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Two odd factors, their inverses modulo 2^64, and a number for every byte.
_FACTORS = [(f, pow(f, -1, 1 << 64)) for f in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
_BYTES = np.random.default_rng(3).integers(1, 2**63, (2, 256), dtype=np.uint64)
#: CRC-32 is linear: what a byte adds by its distance from the end, and what the length adds.
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(TABLE_BYTES + 1)], np.uint32)
_CRC = np.array([[zlib.crc32(bytes([b]) + bytes(n)) ^ zlib.crc32(bytes(n + 1)) for b in range(256)] for n in range(TABLE_BYTES)], np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _series(factor: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, factor, np.uint64))])


_LOW = {f: _series(f, 1 << 14) for pair in _FACTORS for f in pair}


def _power(factor: int, k: np.ndarray) -> np.ndarray:
    most = int(k.max(initial=0)) >> 14
    low = _LOW[factor][k & 0x3FFF]
    return low * _series(pow(factor, 1 << 14, 1 << 64), most + 1)[k >> 14] if most else low


def _slide(x: np.ndarray, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) over every WINDOW neighbours."""
    done = 1
    while done < WINDOW:
        step = min(done, WINDOW - done)
        x = least(x[:-step], x[step:])
        done += step
    return x


def content_cuts(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a word's hash is the least of some WINDOW neighbouring words of its document."""
    if len(h) < WINDOW:
        return np.zeros(len(h), bool)
    edge = np.full(WINDOW - 1, -1)
    least = np.where(doc[WINDOW - 1 :] == doc[: 1 - WINDOW], _slide(h, np.minimum), -1)
    return _slide(np.concatenate([edge, least, edge]), np.maximum) == h


def _words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in UTF-8, one after the other; their ends; the bytes as numbers; where words begin and end, as str.split() cuts."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in (_SPACES.sub(" ", t) if not t.isascii() else t for t in texts)]
    whole = b"".join(raw)
    x = np.frombuffer(whole, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[x].view(np.int8), prepend=np.int8(1)))
    return whole, np.cumsum([len(r) for r in raw]), x, edges[::2], edges[1::2]


def _capitals(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether words begin with a capital."""
    out = _UPPER[x[begins]]
    odd = np.flatnonzero(x[begins] >= 128)
    if len(odd):
        lead, *rest = (x[np.minimum(begins[odd] + i, len(x) - 1)].astype(np.int64) for i in range(4))
        code, more = lead & np.where(lead < 0xE0, 0x1F, np.where(lead < 0xF0, 0x0F, 0x07)), 1 + (lead >= 0xE0) + (lead >= 0xF0)
        for i, r in enumerate(rest):
            code = np.where(i < more, code << 6 | r & 0x3F, code)
        out[odd] = _CAPITAL[np.minimum(code, len(_CAPITAL) - 1)]
    return out


def _hashes(whole: bytes, x: np.ndarray, begins: np.ndarray, ends: np.ndarray, digested: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """CRC-32 of each word, and two hashes of 64 bits."""
    if not len(begins):
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * 2
    size = ends - begins
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first, size)
    b = x[at + np.repeat(begins, size)]
    left = np.repeat(size, size) - 1 - at
    crc = (np.bitwise_xor.reduceat(_CRC[np.minimum(left, TABLE_BYTES - 1), b], first) ^ _ZEROS[np.minimum(size, TABLE_BYTES)]).astype(np.int64)
    for i in np.flatnonzero(size > TABLE_BYTES).tolist():
        crc[i] = zlib.crc32(whole[begins[i] : ends[i]])
    return crc, [_mix(np.add.reduceat(_BYTES[k][b] * _power(f, at), first) + size.astype(np.uint64)) for k, (f, _) in enumerate(_FACTORS if digested else ())]


def _units(texts: list[str], min_words: int, digested: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of all texts in order: number of the text, first and end word, and the digest: twelve bytes as 64 and 32 bits.

    Digests are polynomials over hashes of the words, taken as differences of running sums.
    """
    _, stops, x, begins, ends = _words(texts)
    lowered = _words([t.lower() for t in texts])
    if len(lowered[3]) != len(begins):  # lower() made or removed white space; no known character does
        raise ValueError("a text's lower-case form has other words")
    order, hashes = _hashes(lowered[0], *lowered[2:], digested)
    doc = np.searchsorted(stops, begins, "right")
    marks = content_cuts(order, doc) | _capitals(x, begins)
    marks[1:] |= _END[x[ends[:-1] - 1]]
    # Every text has a place for its end after its words.
    base = np.searchsorted(doc, np.arange(len(texts) + 1))
    place = np.arange(len(begins)) + doc
    last = base[1:] + np.arange(len(texts))
    newlines = np.concatenate([[-1], np.flatnonzero(x == 10)])
    row = np.searchsorted(newlines, begins)
    opens = np.ones(len(begins), bool)
    opens[1:] = row[1:] != row[:-1]
    owner = np.zeros(len(begins) + len(texts), np.int64)
    owner[place], owner[last] = doc, np.arange(len(texts))
    cuts = np.sort(np.concatenate([place[marks | opens], last]))
    m = np.minimum(np.searchsorted(cuts, cuts + min_words), len(cuts) - 1)
    good = (owner[cuts[m]] == owner[cuts]) & (cuts[m] >= cuts + min_words)
    lines = np.concatenate([place[opens], last])
    back = np.searchsorted(cuts, lines - min_words, "right") - 1
    whole = (back >= 0) & (owner[cuts[back]] == owner[lines])
    width = len(owner) + 1
    pairs = np.sort(np.concatenate([cuts[good] * width + cuts[m[good]], cuts[back[whole]] * width + lines[whole]]))
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    first, end = pairs // width, pairs % width
    text = owner[first]
    first, end = first - text, end - text
    d: list[np.ndarray] = []
    for (f, inverse), h in zip(_FACTORS if digested else (), hashes, strict=False):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _power(f, np.arange(len(h))))])
        d.append(_mix((sums[end] - sums[first]) * _power(inverse, first) + (end - first).astype(np.uint64)))
    d0, d1 = (d[0].view(np.int64), (d[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)) if digested else (first, end)
    return text, first - base[text], end - base[text], d0, d1


def unit_bounds(text: str, min_words: int = MIN_WORDS) -> tuple[list[str], list[tuple[int, int]]]:
    """The lower-case words, and (first, end) word numbers of the units, in order."""
    _, first, end, _, _ = _units([text], min_words, False)
    return [w.lower() for w in text.split()], list(zip(first.tolist(), end.tolist(), strict=True))


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts, column ``at``, have some SLICE_CHARS bytes together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE_CHARS, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def cut(text: str, gone: list[tuple[int, int]], kept: list[tuple[int, int]], min_run: int = MIN_RUN) -> tuple[str, int, list[tuple[int, int]]]:
    """The text without the units ``gone`` but for the words of the units ``kept``; how many units went whole; the spans removed, in code points, white space after included."""
    if not gone:
        return text, 0, []
    marks = np.zeros(max(b for _, b in [*gone, *kept]) + 1, np.int64)
    for a, b in gone:
        marks[a] += 1
        marks[b] -= 1
    out = np.cumsum(marks) > 0
    for a, b in kept:
        out[a:b] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
    runs = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= min_run]
    if not runs:
        return text, 0, []
    begins = [a for a, _ in runs]
    n = sum(runs[max(0, bisect_right(begins, a) - 1)][0] <= a and b <= runs[max(0, bisect_right(begins, a) - 1)][1] for a, b in gone)
    starts = [m.start() for m in _WORDS.finditer(text)] + [len(text)]
    spans = [(starts[a], starts[b]) for a, b in runs]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]]), n, spans


def _key() -> tuple:
    return F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, hash, gone, kept): the numbers of a document's units that occur earlier, and of those whose later occurrences go; for documents that have such."""
    schema = "id long, hash long, unit int, d0 long, d1 int, again boolean"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each document its id, hash and number of units; of the units the digests, in order.
        ids: list = []
        hashes: list = []
        counts: list[np.ndarray] = []
        d0: list[np.ndarray] = []
        d1: list[np.ndarray] = []

        def rows():
            known = np.array([i or 0 for i in ids], np.int64)
            hashed = np.array(hashes, np.int64)
            none = np.array([i is None for i in ids], bool)
            by = np.lexsort((hashed, known, none))
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            begin, n = (np.cumsum(n) - n)[by], n[by]
            doc = np.repeat(by, n)
            unit = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            at = unit + np.repeat(begin, n)
            a, b = np.concatenate([np.zeros(0, np.int64), *d0])[at], np.concatenate([np.zeros(0, np.int32), *d1])[at]
            # Occurrences lie in the order of the rank, which a stable sort keeps within a digest.
            order = np.argsort(a, kind="stable")
            if ((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])).any():
                order = np.lexsort((b, a))
            a, b, doc, unit = a[order], b[order], doc[order], unit[order].astype(np.int32)
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            begin = np.flatnonzero(new)
            own = begin[np.cumsum(new) - 1]
            # Rows that repeat id and text are one document, whose units aren't later occurrences of themselves.
            lost = (unit != unit[own]) | (hashed[doc] != hashed[doc[own]]) | (known[doc] != known[doc[own]]) | (none[doc] != none[doc[own]])
            again = np.logical_or.reduceat(lost, begin) if len(begin) else np.zeros(0, bool)
            # What is lost is compared with nothing; it passes under keys of its own, its unit's number negative.
            a[lost] = hashed[doc[lost]] ^ ((-1 - unit[lost].astype(np.int64)) * np.int64(0x9E3779B97F4A7C15 >> 1))
            b[lost], unit[lost] = 0, -1 - unit[lost]
            said = np.zeros(len(a), bool)
            said[begin] = again
            # In the order of the documents, in which neighbouring rows are alike and shrink when shuffled.
            keep = np.flatnonzero(new | lost)
            keep = keep[np.argsort(order[keep])]
            at = doc[keep]
            columns = [pa.array(known[at], pa.int64(), mask=none[at]), *map(pa.array, (hashed[at], unit[keep], a[keep], b[keep], said[keep]))]
            return pa.RecordBatch.from_arrays(columns, ["id", "hash", "unit", "d0", "d1", "again"])

        size = 0
        for batch in batches:
            for part in _slices(batch, 2):
                i, h, texts = (c.to_pylist() for c in part.columns)
                text, _, _, own0, own1 = _units([t or "" for t in texts], min_words)
                ids += i
                hashes += h
                counts.append(np.bincount(text, minlength=len(texts)))
                d0.append(own0), d1.append(own1)
                size += len(text)
                if size > FLUSH_UNITS:
                    yield rows()
                    for x in (ids, hashes, counts, d0, d1):
                        x.clear()
                    size = 0
        yield rows()

    found = docs.select(_key()[0].alias("id"), _key()[1].alias("hash"), "text").mapInArrow(explode, schema)
    by = W.partitionBy("d0", "d1")
    order = by.orderBy(F.col("id").asc_nulls_last(), "hash", "unit")
    ranked = found.withColumn("place", F.rank().over(order)).withColumn("n", F.count("*").over(by))
    number = F.when(F.col("unit") < 0, -1 - F.col("unit")).otherwise(F.col("unit"))
    goes = (F.col("place") > 1) | (F.col("unit") < 0)
    said = ranked.where(goes | (F.col("n") > 1) | F.col("again")).select("id", "hash", F.when(goes, number).alias("gone"), F.when(~goes, number).alias("kept"))
    said = said.groupBy("id", "hash").agg(F.collect_set("gone").alias("gone"), F.collect_set("kept").alias("kept"))
    return said.where(F.size("gone") > 0)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with text replaced by the deduplicated one, and n_removed (units), removed (array of start, end in the original text)."""
    extra = [T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    kept = other_fields(docs, [f.name for f in extra])
    repeated = repeated_units(docs, min_words)
    columns, plain = carried(kept)
    d = docs.select(*columns, _key()[0].alias("__id"), _key()[1].alias("__hash"))
    on = d["__id"].eqNullSafe(repeated["id"]) & (d["__hash"] == repeated["hash"])
    d = d.join(repeated, on, "left").select(*[d[f.name] for f in plain], repeated["gone"].alias("__gone"), repeated["kept"].alias("__kept"))
    at = [f.name.lower() for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at):
                *own, gone, stay = part.columns
                gone, stay = gone.to_pylist(), stay.to_pylist()
                texts, n_removed, removed = own[at].to_pylist(), [0] * part.num_rows, [[] for _ in range(part.num_rows)]
                rows = [i for i, x in enumerate(gone) if x]
                of, first, end, _, _ = _units([texts[i] for i in rows], min_words, False)
                bounds = list(zip(first.tolist(), end.tolist(), strict=True))
                for i, base in zip(rows, np.searchsorted(of, np.arange(len(rows))).tolist(), strict=True):
                    texts[i], n_removed[i], spans = cut(texts[i], *[[bounds[base + u] for u in sorted(x or ())] for x in (gone[i], stay[i])], min_run)
                    removed[i] = [{"start": a, "end": b} for a, b in spans]
                own[at] = pa.array(texts, own[at].type)
                made = [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip((n_removed, removed), extra, strict=True)]
                yield pa.RecordBatch.from_arrays(own + made, [f.name for f in plain] + [f.name for f in extra])

    return d.mapInArrow(run, T.StructType(plain + extra)).toDF(*[f.name for f in kept], *[f.name for f in extra])
