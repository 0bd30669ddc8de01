"""BPE encoding and decoding with reuse of content-defined chunks.

Method: a rolling hash over the characters cuts every text into chunks, so that equal passages are cut alike wherever they stand. Chunk
digests are counted over all documents. A chunk that occurs more than once is encoded by one document, its owner, and its ids are sent to
the others. The joins are repaired: tokens near a cut depend on the text beyond it, so of a chunk only the part between two *anchors* is
reused. An anchor is a place between a word character and a space or newline, where the tokenizer's pattern splits. What lies between the last
anchor of one reused chunk and the first of the next is encoded again, together with the tokens next to it on both sides; if the new ids there differ from the reused ones, the
window is doubled until both sides agree or both chunks are encoded anew.

The byte-level encoder has the merges of the given tokenizer file; long stretches without anchors go through the tokenizers library.

Scale: texts are exchanged once, compressed, by document key; both the owners' and the readers' side use that exchange. Chunk digests are
16 bytes; of a hot chunk only (document, number) pairs and its ids for each document that needs them are moved, and the join on the
digest is salted for the at most 1000 digests that have over a thousandth of all occurrences. A task holds one document at a time.

Edge cases: a null text is the empty one (0 tokens); null ids pass; rows equal in doc_id and text are encoded alike, each keeping its
row; an empty table gives no rows; texts of any length are whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, materialise, other_fields, shuffle_partitions
from .mixing import key_of

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of the rolling hash that must be 0 at a cut: chunks of 1024 characters on average. Its window in characters is 2**WINDOW_LOG.
CUT_BITS, WINDOW_LOG = 10, 5
WINDOW_CACHE = 100_000
HOT_SHARE = 1000
_ANCHOR = re.compile(r"(?<=\w)(?=[ \n])")
_LONG = re.compile(r"\S{1000}|\s{1000}")


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.raw = {i: bytes(table[c] for c in t) for t, i in vocab.items() if t not in added}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        if order != sorted(order) or spec["model"].get("dropout") or spec["normalizer"]:
            raise ValueError("not a byte-level BPE whose ids follow its merges")
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={r: i for i, r in self.raw.items()}, special_tokens=added)
        self.raw |= {i: t.encode() for t, i in added.items()}
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.digits = {i: str(i) for i in self.raw}
        self.windows: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        if len(text) >= 1000 and _LONG.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")

    def encode_window(self, text: str) -> list[int]:
        if len(text) > 200:
            return self.encode(text)
        ids = self.windows.get(text)
        if ids is None:
            if len(self.windows) >= WINDOW_CACHE:
                self.windows.clear()
            ids = self.windows[text] = self.encode(text)
        return ids

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def chunk_cuts(text: str, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of a text, the last one its length. A cut depends on the 2**WINDOW_LOG characters before it only."""
    n = len(text)
    width = 1 << WINDOW_LOG
    if n <= width:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    power, step = np.uint32(0x85EBCA6B), 1
    for _ in range(WINDOW_LOG):  # h[i] covers the next `step` characters; doubling it takes one product and one sum
        h = h[:-step] * power + h[step:]
        power, step = np.uint32(int(power) ** 2 & 0xFFFFFFFF), step * 2
    found = (np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + width).tolist()
    return found if found and found[-1] == n else [*found, n]


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """The part of a chunk between its first and last anchor; empty if there are fewer than two. Both ends lie inside the chunk."""
    first = _ANCHOR.search(text, start + 1, end)
    if not first:
        return start, start
    a = first.start()
    b = end - 1
    while b > a and not (text[b] in " \n" and (text[b - 1].isalnum() or text[b - 1] == "_")):
        b = max(text.rfind(" ", a, b), text.rfind("\n", a, b))
    return (a, b) if b > a else (start, start)


def digest(part: str) -> tuple[int, int]:
    d = hashlib.md5(part.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def cores(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for end in chunk_cuts(text):
        out.append(core(text, at, end))
        at = end
    return out


def _edge(ids: list[int], n: int, c: Codec, last: bool) -> tuple[int, str]:
    """The text of the ``n`` last or first tokens, of more where a character would be cut; and their number."""
    while n < len(ids):
        raw = b"".join([c.raw[i] for i in (ids[-n:] if last else ids[:n])])
        try:
            return n, raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            n += 1
    return len(ids), b"".join([c.raw[i] for i in ids]).decode("utf-8", "surrogatepass")


def mend(ids: list[int], gap: str, right: list[int], c: Codec, window: int = 1) -> None:
    """Append gap and ``right`` to ``ids``: the window around the gap grows until its new ids agree with the old ones at both of its ends."""
    while True:
        (n, head), (m, tail) = _edge(ids, window, c, True), _edge(right, window, c, False)
        new = c.encode_window(head + gap + tail)
        whole = n == len(ids) and m == len(right)
        # The outer half of the window on either side must be as before; the inner half may have changed.
        x, y = (n + 1) // 2, (m + 1) // 2
        if whole or (len(new) >= x + y and new[:x] == ids[len(ids) - n :][:x] and new[len(new) - y :] == right[m - y : m]):
            del ids[len(ids) - n :]
            ids += new
            ids += right[m:]
            return
        window *= 2


def assemble(text: str, known: dict[int, list[int]], c: Codec) -> list[int]:
    """ids of the whole text: reused ids of the cores, joined by what lies between them, encoded again."""
    if not known:
        return c.encode(text)
    ids: list[int] = []
    at = 0
    for i, (a, b) in enumerate(cores(text)):
        if i in known:  # all between the last reused core and this one is one stretch: it is encoded at once
            mend(ids, text[at:a], known[i], c)
            at = b
    mend(ids, text[at:], [], c)
    return ids


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` (doc_id, text and others) with n_tokens, ids (binary, little-endian uint32) and decoded text replaced by digests.

    Columns of the result: the columns of ``docs`` without text, n_tokens, ids_sha256, decoded_sha256, exact (decoded equals the text).
    """
    outputs = ["n_tokens", "ids_sha256", "decoded_sha256", "exact"]
    others = other_fields(docs, [*outputs, "text"])
    columns, kept = carried(others)
    spark = docs.sparkSession
    base = docs.select(*columns, F.coalesce("text", F.lit("")).alias("__text"), F.unhex(key_of(F.col("doc_id"), F.col("text"))).alias("__key"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, number, d0, d1 = [], [], [], []
            for k, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                for i, (a, b) in enumerate(cores(text)):
                    if b > a:
                        x, y = digest(text[a:b])
                        key.append(k), number.append(i), d0.append(x), d1.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(number, pa.int32()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64())], ["key", "number", "d0", "d1"])

    found = materialise(base.select("__key", "__text").mapInArrow(find, "key binary, number int, d0 long, d1 long"), "bpe-chunks")
    shared = found.groupBy("d0", "d1").agg(F.count("*").alias("n"), F.min(F.struct("key", "number")).alias("own")).where("n > 1")
    shared = materialise(shared.select("d0", "d1", "n", "own.key", "own.number"), "bpe-shared")
    total = found.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            *own, text, key = batch.columns
            blobs = [z.compress(t.encode("utf-8", "surrogatepass")) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([*own, pa.array(blobs, pa.binary()), key], [*[f.name for f in kept], "__blob", "__key"])

    packed = base.mapInArrow(pack, T.StructType([*kept, T.StructField("__blob", T.BinaryType()), T.StructField("__key", T.BinaryType())]))
    packed = packed.repartition(shuffle_partitions(spark), "__key")

    def own_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, z = codec(tokenizer), zstandard.ZstdDecompressor()
        for batch in batches:
            d0, d1, out = [], [], []
            done = set()
            for blob, owned in zip(batch.column("__blob").to_pylist(), batch.column("__owned").to_pylist(), strict=True):
                if not owned:
                    continue
                text = z.decompress(blob).decode("utf-8", "surrogatepass")
                parts = cores(text)
                for i in owned:
                    a, b = parts[i]
                    x = digest(text[a:b])
                    if x not in done:  # rows that repeat a document own the same chunks
                        done.add(x)
                        d0.append(x[0]), d1.append(x[1]), out.append(np.array(c.encode(text[a:b]), np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(out, pa.binary())], ["d0", "d1", "ids"])

    owned = shared.groupBy(F.col("key").alias("__k")).agg(F.collect_list("number").alias("__owned"))
    # A left join, as below: an inner one would put a filter under the exchange, which could then not be used twice.
    coded = packed.join(owned, packed["__key"] == owned["__k"], "left").drop("__k").mapInArrow(own_ids, "d0 long, d1 long, ids binary")
    # Salts for the digests that hold more than 1/HOT_SHARE of all occurrences: at most HOT_SHARE rows.
    hot = max(1, total // HOT_SHARE)
    salts = shared.where(F.col("n") > 50_000).where(F.col("n") > hot).select(F.col("d0").alias("h0"), F.col("d1").alias("h1"), F.least(F.lit(64), F.ceil(F.col("n") / hot)).cast("int").alias("salts"))
    salts = F.broadcast(salts)
    uses = found.join(shared.select("d0", "d1"), ["d0", "d1"], "left_semi")
    uses = uses.join(salts, (uses["d0"] == salts["h0"]) & (uses["d1"] == salts["h1"]), "left").select("d0", "d1", "key", "number", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    coded = coded.join(salts, (coded["d0"] == salts["h0"]) & (coded["d1"] == salts["h1"]), "left").select("d0", "d1", "ids", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    # A document owns or uses a chunk once; repeated rows of one document would count twice, hence distinct numbers by key.
    known = uses.join(coded, ["d0", "d1", "salt"]).groupBy(F.col("key").alias("__k")).agg(F.collect_list(F.struct("number", "ids")).alias("__known"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, z = codec(tokenizer), zstandard.ZstdDecompressor()
        for batch in batches:
            n, sha, back, exact = [], [], [], []
            for blob, known in zip(batch.column("__blob").to_pylist(), batch.column("__known").to_pylist(), strict=True):
                text = z.decompress(blob).decode("utf-8", "surrogatepass")
                ids = assemble(text, {k["number"]: np.frombuffer(k["ids"], np.uint32).tolist() for k in known or ()}, c)
                decoded = c.decode(ids)
                n.append(len(ids))
                digits = c.digits
                sha.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                exact.append(decoded == text)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(exact, pa.bool_())], [*[f.name for f in kept], *outputs])

    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType())])
    return packed.join(known, packed["__key"] == known["__k"], "left").drop("__k").mapInArrow(finish, schema).toDF(*[f.name for f in others], *outputs)
