"""Each operator against brute force or a held-out measure on small tables, and on the cases that break things."""

import collections
import hashlib
import json
import math
import os
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from codestrata.llm import bpe, chat, classifier, common, graph, langid, lm, mixing, neardup, rules, substring, topk
from codestrata.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, extra string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, None, "a", "x"), (2, "", "a", None), (None, "no id here at all my friends", None, None), (3, LONG, "b", "y"), (4, "one two three", None, "z"),
    (4, "one two three", None, "z"), (5, "   \n\t ", "b", None), (6, "Größe <|endoftext|> don't   stop\r\n\n", "a", None), (7, "x" * 5000, "a", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# -- 1


def test_classifier_held_out(spark, docs):
    big = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = classifier.score(d, classifier.fit(d, labels)).join(labels, "doc_id").select("doc_id", "score", "quality", "predicted").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_classifier_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, 0), (4, 1), (99, 1)], "doc_id long, quality int")
    out = classifier.score(odd.withColumn("score", F.lit("mine")), classifier.fit(odd, labels)).collect()
    assert len(out) == len(ODD) and all(isinstance(r["score"], float) and 0 <= r["score"] <= 1 for r in out)
    assert classifier.score(odd.limit(0), classifier.fit(odd.limit(0), labels.limit(0))).count() == 0
    assert classifier.train(["a"], [1])[1] > 0


def test_classifier_separates():
    good, bad = [f"plain words number {i} here" for i in range(40)], [f"w{i}$$$ x### y***" for i in range(40)]
    weights, bias = classifier.train(good + bad, [1] * 40 + [0] * 40)
    assert classifier.pair_features(np.array([5, 5, 6]))[0] == 0 and bias == pytest.approx(bias)
    assert weights[classifier.word_features("z$$$")].sum() < weights[classifier.word_features("plain")].sum()


# -- 2


def brute_top(rows, k=5, every=50):
    v = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in e]
        v[i] = min(v.get(i, q), q)
    out = set()
    for i, q in v.items():
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in v.items() if j != i and len(x) == len(q))[:k]
            out |= {(i, n + 1, j, -t) for n, (t, j) in enumerate(s)}
    return out


@pytest.mark.parametrize("n,dims", [(260, 8), (3, 4), (120, 1)])
def test_topk(spark, n, dims):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dims), 1)]) for i in range(n)]
    rows += [(50, rows[0][1]), (0, rows[0][1]), (7000, None), (7001, [1.0] * (dims - 1) + [None]), (7002, [float("nan")] * dims), (7003, [float("inf")] * dims), (None, [1.0] * dims), (7050, [0.5] * (dims + 1)), (7051, [0.5] * (dims + 1))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.search(d).collect()} == brute_top(rows)


def test_topk_empty(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def sparse(rng, n, dims=12):
    """Vectors with few large components: lists that tell early."""
    x = np.zeros((n, dims))
    for i in range(n):
        x[i, rng.integers(0, dims)] = rng.integers(100, 4000)
        x[i, rng.integers(0, dims)] += rng.integers(1, 100)
    return x


@pytest.mark.parametrize("kind", ["sparse", "dense"])
def test_topk_bounds_lose_nothing(kind):
    rng = np.random.default_rng(3)
    x, q = (sparse(rng, 600), sparse(rng, 9)) if kind == "sparse" else (rng.integers(-40, 40, (600, 6)).astype(float), rng.integers(-40, 40, (9, 6)).astype(float))
    own = np.zeros((9, 600), bool)
    own[:, 7] = True
    alive, depth = topk.survivors(q, topk.Lists(np.arange(600), x), np.full(9, -np.inf), 5, own, segment=16)
    s = q @ x.T
    s[:, 7] = -np.inf
    for i in range(9):
        fifth = np.sort(s[i])[-5]
        assert set(np.flatnonzero(s[i] > fifth)) <= set(np.flatnonzero(alive[i])) and not alive[i, 7]
        assert set(np.flatnonzero(s[i] == fifth)) <= set(np.flatnonzero(alive[i]))  # ties are told apart by id later
    assert (depth > 0).all()
    if kind == "sparse":
        assert (depth < 600).all() and alive.sum(1).max() <= topk.RESOLVE
    high = s.max(1) + 1
    alive, depth = topk.survivors(q, topk.Lists(np.arange(600), x), high, 5, own, segment=16)
    assert alive.sum(1).max() <= topk.RESOLVE and (depth < 600).all()


def test_topk_reads_lists_in_search(spark, monkeypatch):
    """Through search: blocks are left unread or stopped early on vectors that allow it, and the result is the brute one."""
    rng = np.random.default_rng(9)
    x = sparse(rng, 900) / 256
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    assert {tuple(r) for r in topk.search(d, block=256).collect()} == brute_top(rows)
    monkeypatch.setattr(topk, "STAGE_BYTES", 500)  # many stages
    assert {tuple(r) for r in topk.search(d, block=256).collect()} == brute_top(rows)


# -- 3


def test_substring_keeps_first_occurrences(spark, docs):
    """Every unit of two or more occurrences still stands somewhere, its earliest place untouched. Words are cut and compared as text, without the operator's removal."""
    rows = sorted({(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()})
    out = {r["doc_id"]: r for r in substring.dedup(docs).collect()}
    places = collections.defaultdict(list)
    for i, text in rows:
        words = text.lower().split()
        for a, b in substring.unit_bounds(text)[1]:
            places[" ".join(words[a:b])].append((i, a, b))
    left = {i: f" {' '.join((r['text'] or '').lower().split())} " for i, r in out.items()}
    removed = {i: np.zeros(len(t.split()), bool) for i, t in rows}
    for i, text in rows:
        for n, m in enumerate(re.finditer(r"\S+", text)):
            removed[i][n] = any(s["start"] <= m.start() < s["end"] for s in out[i]["removed"])
    again = 0
    for unit, at in places.items():
        if len(at) > 1:
            i, a, b = min(at)
            gone = [not x for j, c, d in at[1:] for x in [removed[j][c:d].all()]]
            assert not removed[i][a:b].any() and f" {unit} " in left[i]
            again += len(gone) - sum(gone)
    assert again > 50
    for i, text in rows:
        # What goes is repeated: every removed word lies in a unit with an earlier occurrence, in a run of MIN_RUN words or more.
        cover = np.zeros(len(removed[i]), bool)
        for a, b in substring.unit_bounds(text)[1]:
            if min(places[" ".join(text.lower().split()[a:b])]) < (i, a, b):
                cover[a:b] = True
        assert not (removed[i] & ~cover).any()
        runs = np.flatnonzero(np.diff(np.concatenate([[0], removed[i].astype(int), [0]])))
        assert all(b - a >= substring.MIN_RUN for a, b in runs.reshape(-1, 2).tolist())
        parts, end = [], 0
        for x in out[i]["removed"]:
            parts, end = [*parts, text[end : x["start"]]], x["end"]
        assert "".join([*parts, text[end:]]) == (out[i]["text"] or "")
    changed = np.mean([r["n_removed"] > 0 for r in out.values()])
    assert changed < 0.25


def test_substring_passage_inside_a_line(spark):
    passage = "The passage that is shared has many words. It goes on with several more of them here. And it ends with one last long sentence now."
    rows = [(1, f"Alpha beta gamma.\n{passage}\nDelta."), (2, f"quite other words before it {passage} and other words after"), (3, "nothing shared in this one at all, only words of its own")]
    out = {r["doc_id"]: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[0][1] and out[3]["text"] == rows[2][1]
    assert passage[20:] not in out[2]["text"] and out[2]["text"].startswith("quite other words before it") and out[2]["text"].endswith("and other words after")
    original, s = rows[1][1], out[2]["removed"]
    assert "".join(original[x["start"] : x["end"]] for x in s).strip() in passage


def test_substring_leaves_no_long_repeat(spark):
    """Against windows of 50 words, which know no units: the windows that an earlier document has are gone but for a few words at the ends."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, f"some words of the first document and then {passage} and others that follow"), (10**6 + 1, f"another one begins in quite a different manner {passage} until it stops elsewhere")]
    out = {r["doc_id"]: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first, left = {}, []
    for i, text in sorted(rows):
        found = list(re.finditer(r"\S+", text or ""))
        low = [m[0].lower() for m in found]
        repeated = np.zeros(len(low) + 1, bool)
        for a in range(len(low) - 49):
            if first.setdefault(tuple(low[a : a + 50]), i) != i:
                repeated[a : a + 50] = True
        kept = np.array([not any(s["start"] <= m.start() < s["end"] for s in out[i]["removed"]) for m in found] + [False])
        edges = np.flatnonzero(np.diff(repeated.astype(int), prepend=0))
        left += [int(kept[a:b].sum()) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    assert len(left) > 150 and np.mean(left) < 6
    seen = {}
    for i, r in sorted(out.items()):
        low = (r["text"] or "").lower().split()
        assert all(seen.setdefault(tuple(low[a : a + 50]), i) == i for a in range(len(low) - 49))


def _plain_units(text):
    """Units word by word."""
    low, places, lines, n = text.lower().split(), set(), [], 0
    for own in filter(None, map(str.split, text.split("\n"))):
        lines.append(n)
        places |= {n + i for i in range(len(own)) if i == 0 or own[i - 1][-1] in ".!?" or own[i][0].isupper()}
        n += len(own)
    h = [zlib.crc32(w.encode()) for w in low]
    places |= {i for a in range(n - 7) for i in range(a, a + 8) if h[i] == min(h[a : a + 8])}
    cuts, m, units = sorted({*places, n}), 0, set()
    for c in cuts:
        while m < len(cuts) and cuts[m] < c + 8:
            m += 1
        if m < len(cuts):
            units.add((c, cuts[m]))
    for c in [*lines, n]:
        units |= {(x, c) for x in [max((x for x in cuts if x <= c - 8), default=-1)] if x >= 0}
    return low, sorted(units)


def test_substring_units_of_many_texts():
    """Texts cut together have the units, and equal digests where words are equal, of a plain Python version."""
    r = np.random.default_rng(1)
    pieces = ["a", "B", "c.", "d\n", "E!\n\n", "Größe", "Éa", "ñ\xa0Ⓐ", "ΑΣ", "я\u3000Я", "f" * 90, "𐐀x", "g", "h"]
    texts = [" ".join(r.choice(pieces, r.integers(0, 90))) for _ in range(300)] + ["", " \n", LONG]
    text, first, end, d0, d1 = substring._units(texts, 8)
    names, words = {}, {}
    for i, t in enumerate(texts):
        at = np.flatnonzero(text == i)
        low, units = _plain_units(t)
        assert list(zip(first[at].tolist(), end[at].tolist(), strict=True)) == units
        for k, (a, b) in zip(at.tolist(), units, strict=True):
            key, unit = (int(d0[k]), int(d1[k])), tuple(low[a:b])
            assert names.setdefault(unit, key) == key and words.setdefault(key, unit) == unit


def test_substring_cost(spark):
    """All of the units' work against a part of what it is in plain Python: digests one by one and looks at every word."""
    texts = [t for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()[:400]]
    bounds = [(t.lower().split(), substring.unit_bounds(t)[1]) for t in texts]
    plain, now = [], []
    for _ in range(3):
        t0 = time.process_time()
        for low, units in bounds:
            for a, b in units:
                hashlib.md5(" ".join(low[a:b]).encode()).digest()
            [zlib.crc32(w.encode()) for w in low]
            [w.isupper() or w[-1] in ".!?" for w in low]
        t1 = time.process_time()
        for k in range(0, len(texts), 100):
            substring._units(texts[k : k + 100], 8)
        plain.append(t1 - t0), now.append(time.process_time() - t1)
    assert min(now) < 1.5 * min(plain), (now, plain)


def test_substring_odd_rows(spark, odd):
    out = substring.dedup(odd.withColumn("n_units", F.lit("mine"))).collect()
    assert len(out) == len(ODD) and {r["doc_id"]: r["text"] for r in out}[1] is None and substring.dedup(odd.limit(0)).count() == 0
    assert sorted(r["n_removed"] for r in out if r["doc_id"] == 4) == [0, 0]


# -- 4


def call(**k):
    return f"<tool_call>{json.dumps(k)}</tool_call>"


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "x " + call(id="a", name="search", arguments={"query": "q"}) + call(id="b", name="search", arguments={"query": {"$ref": "a"}})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": "é"}})), (1, 3, "tool", '<tool_result>{"id":"none","content":1}</tool_result>'),
        (1, 4, "assistant", call(id="a", name="calculate", arguments={}) + call(id="c", name="foo", arguments={"x": {"$ref": "d"}}) + call(id="d", name="foo", arguments=[{"$ref": "c"}]) + "<tool_call>{id bad</tool_call>"),
        (2, 0, "assistant", call(id="a", name="calculate", arguments={"expression": "1"})), (None, None, None, None), (3, 0, "user", LONG), (3, 0, "user", LONG),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("json", F.lit("mine"))
    out = chat.format_chats(d).collect()
    assert len(out) == len(rows)
    at = {(r["conv_id"], r["turn"]): r for r in out}
    events = lambda c, t: [(e["id"], e["kind"], e["level"], e["status"], e.get("error")) for e in json.loads(at[c, t]["json"])["events"]]
    assert events(1, 1) == [("a", "call", 0, "linked", None), ("b", "call", 2, "unanswered", "$.query: not of type string")]
    assert events(1, 2) == [("a", "result", 1, "linked", None)] and events(1, 3) == [("none", "result", None, "orphan", None)]
    assert events(1, 4) == [("c", "call", None, "unanswered", "unknown tool"), ("d", "call", None, "unanswered", "unknown tool"), ("a", "call", 0, "duplicate", "$.expression: missing")]
    assert events(2, 0) == [("a", "call", 0, "unanswered", None)] and at[1, 4]["n_malformed"] == 1
    assert at[1, 2]["json"].startswith('{"content":"","conversation":1,"events":[{"id":"a"') and '{"a":"é","z":1}' in at[1, 2]["json"]
    assert chat.format_chats(d.limit(0)).count() == 0


def test_chat_chain(spark):
    rows = [(1, i, "assistant", call(id=f"c{i}", name="x", arguments={"p": {"$ref": f"c{i - 1}"}} if i else {})) for i in range(6)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["turn"]: r["first_level"] for r in out} == {i: 2 * i for i in range(6)}


def test_chat_deep_chain(spark):
    """Chains of any depth are put in order, whether by one task or by rounds; only cycles have no level."""
    deep = [(c, f"c{i}", [f"c{i - 1}"] if i else []) for c in (1, None) for i in range(301)]
    odd = [(1, "x", ["y"]), (1, "y", ["x"]), (1, "z", ["nowhere"]), (1, "t", ["c300", "z"]), (1, "u", ["x", "z"])]
    calls = spark.createDataFrame(deep + odd, "conv_id long, id string, refs array<string>")
    got = {(r["conv_id"], r["id"]): r["level"] for r in chat.levels(calls).collect()}
    assert got == {(c, f"c{i}"): i for c in (1, None) for i in range(301)} | {(1, "z"): 0, (1, "t"): 301}
    few = calls.where("id IN ('c0', 'c1', 'c2', 'c3', 'x', 'y', 'z', 'u')")
    by_round = [tuple(r) for r in chat.levels(few, local_edges=0).collect()]
    assert sorted(map(str, by_round)) == sorted(str(tuple(r)) for r in chat.levels(few).collect()) and len(by_round) == 9


def test_schema_validation():
    s = {"type": "object", "properties": {"n": {"type": ["integer", "null"], "minimum": 0}, "l": {"items": {"enum": [1, 2]}, "type": "array"}}, "additionalProperties": False}
    assert [chat.validate(v, s) for v in ({"n": None}, {"n": -1}, {"n": True}, {"l": [1, 3]}, {"m": 1}, [])] == [None, "$.n: out of range", "$.n: not of type integer/null", "$.l[1]: not in enum", "$.m: not allowed", "$: not of type object"]


# -- 5


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


STRANGE = ["", " ", "\n\n  \n", "a b  c", "don't we'll I'M", "日本語テキスト" * 400, "<|endoftext|><|endoftext|> x<|endoftext|>", "é" * 3000, "\x00\x1c\x85 \x0b", "x  y   z\t\n  end   ", "1234567 89,0 !!! ??", "🙂🙃 " * 600]


def test_bpe_encoder_agrees(tokenizer):
    c = bpe.codec(tokenizer_path())
    for text in STRANGE + [LONG, "ab " * 4000 + "c" * 2500]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == ids and c.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)
        parts = bpe.cores(text)
        assert all(0 <= a <= b <= len(text) for a, b in parts) and [e for _, e in parts] == sorted(e for _, e in parts)
        for every in (1, 2, 3):
            known = {i: c.encode(text[a:b]) for i, (a, b) in enumerate(parts) if b > a and i % every == 0}
            assert bpe.assemble(text, known, c) == ids


def test_bpe_join_grows_until_both_sides_agree():
    """Cuts in the middle of words and numbers: the window grows beyond the tokens that change."""
    c = bpe.codec(tokenizer_path())
    text = "The unbelievably long internationalization of 12345678 words; étrangement naïve 🙂 café"
    seen = []
    encode = c.encode_window
    c.encode_window = lambda t: (seen.append(t), encode(t))[1]
    try:
        for a in range(1, len(text) - 1):
            for b in (a, min(len(text) - 1, a + 3)):
                ids = c.encode(text[:a])
                bpe.mend(ids, text[a:b], c.encode(text[b:]), c)
                assert ids == c.encode(text), (a, b)
    finally:
        c.encode_window = encode
    assert len(seen) > 2 * len(text)


def test_bpe_chunks_are_local():
    tail = " ".join(f"word{i}" for i in range(2000))
    a, b = "one start " + tail, "another, longer beginning of the text " + tail
    ends = [{len(t) - e for e in bpe.chunk_cuts(t)} for t in (a, b)]
    assert len(ends[0]) > 5 and len(ends[0] & ends[1]) >= len(ends[0]) - 1


def test_bpe_query(spark, docs, odd, tokenizer):
    for d in (docs, odd, spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(STRANGE)], DOCS)):
        d = d.select("doc_id", "text").withColumn("exact", F.lit(1))
        got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(d, tokenizer_path()).collect())
        want = collections.Counter()
        for r in d.collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert got == want
    assert bpe.encode(odd.limit(0), tokenizer_path()).count() == 0


# -- 6


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}


def brute_groups(rows):
    k = [neardup.shingles((t or "").lower().split()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i in range(len(rows)):
        for j in range(i):
            if len(k[i]) and (neardup.similarity(k[i], k[j]) > 0 or (rows[i][1] or "").lower().split() == (rows[j][1] or "").lower().split()):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows)) if len(k[i])}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for _ in range(12):
        base = [f"v{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(6):
            words = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 4)):
                words[at] = "edit"
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, "short"), (n + 1, "Short "), (n + 2, "other"), (n + 3, rows[0][1].upper()), (n + 4, " ".join(reversed(rows[0][1].split())))]
    out = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["group_id"] for r in out} == brute_groups(rows)
    assert sum(r["kept"] for r in out) == len({r["group_id"] for r in out})


def test_near_duplicates_hot_bucket(spark):
    """Dissimilar texts of one bucket are not compared pair by pair, and the pairs that reach the threshold are all among those compared."""
    r = np.random.default_rng(5)
    common = [f"c{i}" for i in range(40)]
    texts = [common + [f"t{j}w{i}" for i in range(60)] for j in range(150)]
    for j in range(0, 150, 5):  # some near copies, of all similarities around the threshold
        texts.append(texts[j][: 100 - int(r.integers(0, 25))] + [f"x{j}y{i}" for i in range(int(r.integers(0, 8)))])
    kmers = [neardup.shingles(t) for t in texts]
    good = {(i, j) for i in range(len(texts)) for j in range(i) if neardup.similarity(kmers[i], kmers[j]) > 0}
    name = lambda i: f"{i:04d}".encode()
    classes = spark.createDataFrame([(bytearray(name(i)), len(k), bytearray(name(i))) for i, k in enumerate(kmers)], "cls binary, n int, label binary")
    blobs = spark.createDataFrame([(bytearray(name(i)), bytearray(zstandard.compress(" ".join(t).encode()))) for i, t in enumerate(texts)], "cls binary, blob binary")
    pairs = [(int(bytes(x["b"])), int(bytes(x["a"]))) for x in neardup._sharing(classes, blobs, neardup.THRESHOLD).collect()]
    assert 5 < len(good) < 30 and good <= set(pairs) and len(pairs) == len(set(pairs)) <= 60


def test_similarity():
    a = neardup.shingles([f"a{i}" for i in range(104)])
    assert neardup.similarity(a, a) == 1 and neardup.similarity(a, a[:90]) == pytest.approx(0.9) and neardup.similarity(a, a[:79]) == 0
    assert neardup.similarity(a, np.concatenate([a[50:], a[:50]])) == 0
    same = neardup.shingles(["x"] * 50)
    assert len(set(same.tolist())) == 46


def test_near_duplicates_odd_rows(spark, odd):
    out = neardup.groups(odd.select("doc_id", "text")).collect()
    assert len(out) == len(ODD) and all(r["kept"] for r in out if r["group_id"] is None and r["doc_id"] is not None)
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "None", "3", "4", "5", "6", "7"])
    assert neardup.groups(odd.limit(0).select("doc_id", "text")).count() == 0


# -- 7


def test_language_model(spark, docs):
    out = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    rows = docs.collect()
    counts = collections.Counter(w for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for w in [*lm.tokens(r["text"]), lm.END])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own, got = [*lm.tokens(r["text"]), lm.END], out[r["doc_id"]]
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert got["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert got["score"] < 0 and got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_language_model_spelling_is_a_distribution():
    words, ones = [b"abc", b"abd", b"x", lm.END], np.ones(4)
    zeros = np.zeros(4, np.int64)
    tables = [np.zeros((1 << log, 2)) for log in lm.TABLE_LOGS]
    lm.count_tables(words, zeros, ones, tables)
    tables = [lm.encode_counts(t) for t in tables]
    t = lm.Trainer(tables)
    t.learn(words, zeros, ones)
    model = lm.Model(tables, t.weights, t.map)
    # All one-byte continuations of a prefix that is closed at once, and the rest of the mass: bits of one byte sum to 1.
    total = sum(2 ** model.log2([bytes([b])], np.zeros(1, np.int64))[0] for b in range(256))
    assert 0 < total <= 1.0001
    singles = model.log2([b"ab", b"abc", b"zzz"], np.zeros(3, np.int64))
    assert singles[1] > singles[2]


def words_model(texts, train):
    """Dictionary, numbers and tables of a small corpus, as the operator makes them."""
    counts = collections.Counter(w for t, k in zip(texts, train, strict=True) if k for w in lm.tokens(t))
    hot = [w for w in counts if counts[w] > 1]
    rare = [w for w in counts if counts[w] == 1]
    d = lm.Dictionary(hot, np.array([counts[w] for w in hot]), np.array([len(w) % 2 for w in hot]), sum(train), len(rare), 2, 4.0)
    d.open()
    number = d.index()
    tables = [np.zeros(2 << log, np.uint32) for log in lm.WORD_LOGS]
    for t, k in zip(texts, train, strict=True):
        ids = np.array([*[number.get(w, 0) for w in lm.tokens(t)], 1])
        if k:
            lm.count_paths(d, ids, lm.contexts(d, ids, np.zeros(1, np.int64)), tables)
    return d, number, [lm.encode_counts(t) for t in tables]


def test_language_model_paths_are_a_distribution():
    """Over the whole dictionary, the end and the escape, the first step's probabilities sum to 1 in any context."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 300) % 700) for _ in range(12)]
    d, _, tables = words_model(texts, [True] * 12)
    for context in (np.array([0, 3, 5, 9]), np.array([0, 17, 2, 2])):
        n = len(d.words)
        bits = lm.Mixer(d, tables).step(np.arange(n), np.repeat(context[:, None], n, 1), np.zeros(n, bool))
        assert (2.0**bits).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_against_plain_python():
    """Fifty documents of two shards word by word and bit by bit, without arrays: the scores of the stream."""
    rng = np.random.default_rng(8)
    texts = [" ".join((f"w{int(x)}" + ("," if x % 5 == 0 else "")) for x in rng.zipf(1.5, int(rng.integers(0, 160))) % 300) for _ in range(50)]
    train = [i % 6 != 2 for i in range(50)]
    d, number, tables = words_model(texts, train)
    rows = [(i // 25, i, i, not train[i], texts[i], []) for i in range(50)]
    got = {r[0]: r[-1] for out in lm.score_stream(iter(rows), d, number, tables, lambda *a: None) for r in out}
    flat = [t.reshape(-1).tolist() for t in tables]
    count = lambda code: float(lm.COUNTS[code])
    mul, mask = [int(m) for m in lm._MUL], (1 << 64) - 1

    def slot(k, context, node):
        if lm.WORD_LOGS[k] == lm.MIXED:
            return node
        h = (context + 1) * mul[2] & mask
        return (((h ^ h >> 32) * mul[0] & mask) >> (64 - lm.WORD_LOGS[k] + lm.MIXED) << lm.MIXED) + node

    want = {}
    for shard in (0, 1):
        weights = [[0.3] * lm.WORD_GATES for _ in range(4)] + [[0.0] * lm.WORD_GATES]
        squares = [[1e-3] * lm.WORD_GATES for _ in range(5)]
        seen = [[[0, 0] for _ in range(lm.STEPS)] for _ in range(lm.WORD_GATES)]
        stream = []
        for i in range(shard * 25, shard * 25 + 25):
            ids = [number.get(w, 0) for w in lm.tokens(texts[i])] + [1]
            want[i] = 0.0
            for at, w in enumerate(ids):
                votes = [d.classes[x] for x in ids[max(0, at - 32) : at] if d.classes[x] < d.n_classes]
                language = max(range(d.n_classes), key=lambda c: (votes.count(c), -c)) if votes else d.n_classes
                symbols = sum(d.symbol[x] for x in ids[max(0, at - 8) : at])
                top = lambda n: int(d.top[ids[at - n]]) if at >= n else lm.TOP_WORDS + d.n_classes + 2
                stream.append((i, w, train[i], [0, int(language * 16 + symbols), top(1), top(2)]))
        for a in range(0, len(stream), lm.STEP):
            slopes = [[0.0] * lm.WORD_GATES for _ in range(5)]
            mass, updates = [0] * lm.WORD_GATES, []
            for i, w, learn, context in stream[a : a + lm.STEP]:
                path = format(int(d.code[w]), f"0{int(d.length[w])}b")
                for n, bit in enumerate(map(int, path[: lm.MIXED])):
                    node = int("1" + path[:n], 2)
                    x, totals = [], []
                    for k in range(4):
                        place = slot(k, context[k], node) * 2
                        c = [count(flat[k][place]), count(flat[k][place + 1])]
                        c[bit] = max(0, c[bit] - learn)
                        x.append(math.log((c[1] + 0.3) / (c[0] + 0.3)))
                        totals.append(math.log2(c[0] + c[1] + 1))
                    g = int(min(totals[2], 11)) * 4 + int(min(totals[3] / 3, 3))
                    z = max(-30, min(30, sum(weights[k][g] * x[k] for k in range(4)) + weights[4][g]))
                    step = int(max(-16, min(16, np.rint(np.float32(z) * 2)))) + 16
                    centre = 1 / (1 + math.exp(-(step - 16) / 2))
                    share = (seen[g][step][1] + 20 * centre) / (sum(seen[g][step]) + 20)
                    final = max(-20, min(20, (z + math.log(share / (1 - share))) / 2))
                    want[i] -= math.log10(1 + math.exp(final * (1 - 2 * bit)))
                    if learn:
                        error = 1 / (1 + math.exp(-z)) - bit
                        mass[g] += 1
                        for k in range(5):
                            slopes[k][g] += error * (x[k] if k < 4 else 1)
                        updates.append((g, step, bit))
                rest = [v for v in range(len(d.words)) if d.length[v] >= lm.MIXED and (int(d.code[v]) >> int(d.length[v] - lm.MIXED)) == int(path[: lm.MIXED], 2)] if len(path) > lm.MIXED else []
                if rest:
                    own = lambda v: max(int(d.counts[v]), 1)
                    want[i] += math.log10(max(own(w) - learn, 0.5) / max(sum(map(own, rest)) - learn, 0.5))
            for g in range(lm.WORD_GATES):
                for k in range(5):
                    slope = slopes[k][g] / max(mass[g], 1)
                    squares[k][g] += slope**2
                    weights[k][g] -= 0.05 * slope / math.sqrt(squares[k][g])
            for g, step, bit in updates:
                seen[g][step][bit] += 1
    assert len(got) == 50 and sum(map(len, map(str.split, texts))) > lm.STEP
    for i in range(50):
        assert got[i] == pytest.approx(want[i], rel=1e-5, abs=1e-4)


def test_language_model_stretches():
    """Cuts and digests depend on the words alone; a stretch that follows again is told as such and costs little."""
    words = [b"w%d" % (i * i % 211) for i in range(400)]
    h = np.array([lm.xxhash.xxh3_64_intdigest(w) for w in [*words, lm.END]], np.uint64)
    starts, contexts, digests = lm.stretches(h)
    assert len(starts) > 5
    more = np.concatenate([h[100:103], h])
    s2, c2, d2 = lm.stretches(more)
    tail = {(int(a) - 3, int(c), int(x)) for a, c, x in zip(s2, c2, d2, strict=True) if a > 12}
    assert tail == {(int(a), int(c), int(x)) for a, c, x in zip(starts, contexts, digests, strict=True) if a > 9}
    assert [len(x) for x in lm.stretches(h[:1])] == [0, 0, 0]


def test_language_model_partitions_and_gain(spark):
    """Equal scores whatever the partitions; better than the base on texts held out; doubled documents stand apart."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n, own in ((4, d), (9, d.repartition(7, "source"))):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({r["doc_id"]: r for r in lm.score_documents(own).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found[0]) == len(found[1]) == 200
    assert all(r["score"] == pytest.approx(found[1][i]["score"], rel=1e-9) for i, r in found[0].items())
    held = [r for r in found[0].values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    times = collections.Counter(texts.values())
    long = {i for i, t in texts.items() if len(t.split()) > 100}
    twice = [found[0][i]["bits_per_byte"] for i in long if times[texts[i]] > 1]
    once = [found[0][i]["bits_per_byte"] for i in long if times[texts[i]] == 1]
    assert len(twice) > 4 and np.median(twice) < 0.6 * np.median(once)


def test_language_model_prefixes_of_all_words(spark):
    """Which prefixes are counted depends on all words, not on the run they are in."""
    words = sorted({f"{a}{b}{c}".encode() for a in ("be", "bes", "überaus", "z") for b in range(40) for c in ("", "st", "ting") if (b * 7 + len(a)) % 3} | {lm.END})
    begins = collections.Counter(w[:i] for w in words for i in range(1, len(w) + 1))
    found = lm.prefix_depths(spark.createDataFrame([(bytearray(w), 1) for w in words], "word binary, mask long").repartition(5), block=16).collect()
    depth = {bytes(r["word"]): r["depth"] for r in found}
    assert len(found) == len(words) and depth == {w: sum(begins[w[:i]] >= lm.PREFIX_MIN for i in range(1, len(w) + 1)) for w in words}
    whole, parts = [[np.zeros((1 << log, 2)) for log in lm.TABLE_LOGS] for _ in range(2)]
    lm.count_tables(words, np.zeros(len(words), np.int64), np.ones(len(words)), whole)
    for i in range(0, len(words), 10):
        run = words[i : i + 10]
        lm.count_tables(run, np.zeros(len(run), np.int64), np.ones(len(run)), parts, np.array([depth[w] for w in run]))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and whole[4].any()
    assert lm.prefix_depths(spark.createDataFrame([], "word binary, mask long")).count() == 0


def test_language_model_works_on_groups_of_documents(monkeypatch):
    """Contexts are made for many documents at once, and scores don't depend on how many."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 20) % 300) for _ in range(200)]
    d, number, tables = words_model(texts, [i % 4 != 0 for i in range(200)])
    calls, contexts = [], lm.contexts
    monkeypatch.setattr(lm, "contexts", lambda *a: calls.append(1) or contexts(*a))
    rows = [(0, i, i, i % 4 == 0, t, []) for i, t in enumerate(texts)]
    rows.insert(8, rows[7])
    got = [r for out in lm.score_stream(iter(rows), d, number, tables, lambda *a: None) for r in out]
    assert len(got) == 201 and got[7] == got[8] and len(calls) < 20
    coded = [(s, h, i, held, *d.numbers(pa.array([t]))[::2], found) for s, h, i, held, t, found in rows]
    asked = []
    for flush in (1, 500):
        asked.append([])
        again = [r for out in lm.score_numbers(iter(coded), d, tables, lambda *a: asked[-1].extend(zip(*a, strict=True)), flush) for r in out]  # noqa: B023
        assert [r[:-1] for r in again] == [r[:-1] for r in got] and [r[-1] for r in again] == pytest.approx([r[-1] for r in got])
    assert asked[0] == asked[1] and len(asked[0]) == sum(w not in number for t in texts for w in lm.tokens(t)) > 0


def test_language_model_numbers_of_words():
    """Words of many texts at once are those of ``tokens``, whatever the white space; pieces and packed documents lose nothing."""
    odd = ["", " ", "a", " A  b\t", "\x0b\x0cÄ ä\x85x\u00a0y\u2028z\r\nİ", "a\x00b c\x1cd", "\n", "B a " * 50, "zz"]
    array = pa.array([*odd, *odd])
    for texts in (array, array[3:7], pa.array(["a b", "c"]), pa.array([""])):
        flat, edges = lm.split(texts)
        words = flat.to_pylist()
        assert [words[x:y] for x, y in zip(edges, edges[1:], strict=False)] == [lm.tokens(t) for t in texts.to_pylist()]
    d = lm.Dictionary([b"a", b"b", "ä".encode()], np.array([9, 5, 5]), np.zeros(3, int), 4, 2, 1, 2.0)
    d.open()
    number = d.index()
    ids, starts, rare, n_rare = d.numbers(array)
    z, u = lm.zstandard.ZstdCompressor(), lm.zstandard.ZstdDecompressor()
    for t, own, at in zip(array.to_pylist(), np.split(ids, starts[1:]), np.cumsum(n_rare) - n_rare, strict=True):
        escaped = [w for w in lm.tokens(t) if w not in number]
        assert own.tolist() == [*[number.get(w, 0) for w in lm.tokens(t)], 1]
        found = rare[at : at + len(escaped)]
        assert found == escaped
        unpacked = lm.unpack_document(u, lm.pack_document(z, own, found))
        assert unpacked[0].tolist() == own.tolist() and unpacked[1] == escaped
    batch = pa.RecordBatch.from_arrays([pa.array(range(18)), array], ["i", "text"])
    for most in (1, 7, 100, 1 << 20):
        cut = list(lm._pieces(iter([batch[:5], batch[5:5], batch[5:]]), most))
        assert [i for b in cut for i in b.column("i").to_pylist()] == list(range(18)) and all(b.num_rows for b in cut)
    assert len(cut) == 1


def test_language_model_stretches_of_many_documents():
    words = [b"w%d" % (i * i % 97) for i in range(900)]
    h = np.array([lm.xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    edges = np.array([0, 1, 2, 5, 300, 301, 302, 640, 899])
    at, context, digest = lm.stretches(h, edges)
    alone = [[x.tolist() for x in lm.stretches(own)] for own in np.split(h, edges[1:])]
    assert at.tolist() == [int(e) + x for e, a in zip(edges, alone, strict=True) for x in a[0]]
    assert [context.tolist(), digest.tolist()] == [[x for a in alone for x in a[k]] for k in (1, 2)] and len(at) > 10


def test_language_model_prefixes_over_small_ranges(spark):
    """Words that share a prefix lie in many ranges of the sort, some with fewer words than the prefix needs."""
    words = sorted({f"{a}{b}".encode() for a in ("a", "ab", "abc", "b", "bc") for b in range(60)} | {lm.END})
    begins = collections.Counter(w[:i] for w in words for i in range(1, len(w) + 1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", 60)
        found = lm.prefix_depths(spark.createDataFrame([(bytearray(w), 1) for w in words], "word binary, mask long"), block=10).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(bytes(r["word"]) for r in found) == words
    assert {bytes(r["word"]): r["depth"] for r in found} == {w: sum(begins[w[:i]] >= lm.PREFIX_MIN for i in range(1, len(w) + 1)) for w in words}


def test_language_model_words_of_buckets():
    """Every word has one bucket, whatever stands beside it; packed words and numbers come back; neighbours share what they share."""
    words = [*{bytes([97 + i % 23, 98 + i % 7]) * (i % 5 + 1) + str(i).encode() for i in range(3000)}, b"a\x00", b"a\x00\x00", "ä".encode() * 40, b"x" * (3 << 20), lm.END]
    array = pa.array(words, pa.binary())
    p = lm.buckets(array, 11)
    assert set(p.tolist()) == set(range(11)) and np.bincount(p).max() < 2 * len(words) / 11
    assert all(lm.buckets(array[i : i + 1], 11)[0] == p[i] for i in range(0, len(words), 97)) and lm.buckets(array[5:], 11).tolist() == p[5:].tolist()
    z, u = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    flat, edges = lm.flat_bytes(array[7:])
    length, numbers, none, flat = lm.unpack_arrays(u, lm.pack_arrays(z, np.diff(edges).astype("<u4"), np.arange(5), np.zeros(0, "<i8"), flat), "<u4", "<i8", "<i8", "u1")
    assert lm.words_of(length, flat).to_pylist() == words[7:] and numbers.tolist() == [0, 1, 2, 3, 4] and not len(none)
    ordered = sorted([*words, b"x" * 16, b"x" * 17, b"x" * 24 + b"y"])
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for near in (1, 7):
        assert lm._shared(pa.array(ordered, pa.binary()), near).tolist() == [common(a, b) for a, b in zip(ordered, ordered[near:], strict=False)]


def test_language_model_counts_and_requests_are_packed(spark, docs, monkeypatch):
    """Spark neither sums nor joins word by word; counts by language are right, and scores are the same with many small parts."""
    rows = docs.collect()
    d = docs.select("doc_id", "text", "lang", (F.col("doc_id") % 3 != 0).alias("train"))
    langs = sorted({r["lang"] for r in rows if r["lang"]})[:2]
    want = collections.defaultdict(lambda: [0] * (len(langs) + 1))
    for r in rows:
        for w in [*lm.tokens(r["text"]), lm.END]:
            want[w][langs.index(r["lang"]) if r["lang"] in langs else len(langs)] += r["doc_id"] % 3 != 0
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plain = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    for most in (lm.FLUSH_PAIRS, 20):
        monkeypatch.setattr(lm, "FLUSH_PAIRS", most)
        counted = lm.word_counts(d, langs)
        assert "Aggregate" not in plan(counted)
        found = counted.collect()
        got = {bytes(r["word"]): (r["by"], r["c"], r["mask"]) for r in found if r["word"] is not None}
        assert len(got) == sum(r["word"] is not None for r in found)
        assert got == {w: (by, sum(by), sum((x > 0) << i for i, x in enumerate(by))) for w, by in want.items()}
        packed = {}
        for r in found:
            if r["word"] is None:
                length, c, flat = lm.unpack_arrays(zstandard.ZstdDecompressor(), bytes(r["blob"]), "<u4", "<i8", "u1")
                own = lm.words_of(length, flat)
                assert set(lm.buckets(own, lm.shuffle_partitions(spark)).tolist()) == {r["p"]}
                packed |= dict(zip(own.to_pylist(), c.tolist(), strict=True))
        assert packed == {w: sum(by) for w, by in want.items()}
        out = lm.score_documents(docs)
        assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", plan(out).split("Initial Plan")[-1])) == 1
        for r in out.collect():
            own = plain[r["doc_id"]]
            assert r["n_known"] == own["n_known"] and r["score"] == pytest.approx(own["score"], rel=1e-9) and r["base_score"] == pytest.approx(own["base_score"], rel=1e-9)


def test_language_model_leaves_no_stored_tables(spark, docs):
    """Only what the result reads stays in the shared folder."""
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = lm.score_documents(docs)
    assert sorted(x.rpartition("-")[0] for x in set(os.listdir(folder)) - before if not x.startswith(".")) == ["lm-asked", "lm-words"]
    assert out.count() == docs.count()


def test_language_model_odd_rows(spark, odd):
    out = lm.score_documents(odd).collect()
    assert len(out) == len(ODD) and all(math.isfinite(r["score"]) for r in out)
    twice = [(r["n_known"], r["base_score"], r["score"]) for r in out if r["doc_id"] == 4]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 5)} == {1}
    assert lm.score_documents(odd.limit(0)).count() == 0


# -- 8


def test_language_id(spark):
    docs = spark.createDataFrame([("the house and the dog are here with this", "en"), ("das haus und der hund sind hier mit dieser", "de"), (None, "fr"), ("x", None)] * 5, "text string, lang string")
    page = lambda lang, text: f"<html lang={lang}><head><script>the the the</script></head><body>{text}</body></html>"
    rows = [(i, f"http://www.host.de/{i}", page('"de"', "der hund und das haus sind hier")) for i in range(20)]
    rows += [(100, "http://www.host.de/x", page("en", "")), (101, "http://other.com/", page("en", "the dog and this house")), (102, None, None), (103, "nonsense", "<html>"), (104, "https://u@h.example.org:80/a", page("zz", "the dog"))]
    rows.append(rows[-1])
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("mine"))
    out = {r["page_id"]: r for r in langid.identify(d, docs).collect()}
    assert langid.identify(d, docs).count() == len(rows)
    assert out[0]["lang"] == "de" and out[101]["lang"] == "en" and out[100]["lang"] == "de" and out[104]["declared"] == "other" and out[104]["host"] == "h.example.org"
    assert all(0 < r["probability"] <= 1 for r in out.values())
    assert langid.identify(d, docs.limit(0)).where("lang IS NOT NULL").count() == 0 and langid.identify(d.limit(0), docs).count() == 0


def test_language_id_accuracy(spark, docs):
    """Documents as pages without declaration or telling suffix, learned from the other half: the language is met."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND size(split(text, ' ')) >= 30")
    learn, ask = big.where("doc_id % 2 = 0"), big.where("doc_id % 2 = 1")
    pages = ask.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("doc_id") % 40).cast("string"), F.lit(".example.org/")).alias("url"), F.concat(F.lit("<html><body>"), "text", F.lit("</body></html>")).alias("html"))
    truth = {r["doc_id"]: r["lang"] for r in ask.select("doc_id", "lang").collect()}
    out = langid.identify(pages, learn).collect()
    assert len(out) == len(truth) > 200 and np.mean([r["lang"] == truth[r["page_id"]] for r in out]) > 0.95


# -- 9


def brute_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, (*_, x) in zip(size, rows, strict=True) if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(size), set(sources), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= over
    return size, total, target


def test_mixing(spark, docs, odd):
    for d in (docs, odd):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in d.collect()]
        _, total, target = brute_mix(rows)
        out = mixing.mix(d.withColumn("size", F.lit("mine"))).collect()
        assert len(out) == len(rows)
        taken = collections.Counter()
        for r in out:
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        for s, t in target.items():
            assert abs(taken[s] - math.floor(t + 1e-6)) <= 1
        again = mixing.mix(d.repartition(7)).select("doc_id", "taken").collect()
        assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(d).select("doc_id", "taken").collect())


def test_mixing_rows(spark, docs, odd):
    for d in (docs, odd):
        want = {(r["doc_id"], r["text"]): -(-r["taken"] // r["size"]) if r["size"] else 0 for r in mixing.mix(d).collect()}
        got = collections.Counter((r["doc_id"], r["text"]) for r in mixing.mix_rows(d).collect())
        copies = collections.Counter((r["doc_id"], r["text"]) for r in d.collect())
        assert got == collections.Counter({k: n * copies[k] for k, n in want.items() if n})
    assert mixing.mix(odd.limit(0)).count() == 0


# -- 10


def brute_repeat(words, n=8):
    windows = collections.defaultdict(list)
    for i in range(len(words) - n + 1):
        windows[tuple(words[i : i + n])].append(i)
    return len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + n)})


def test_repeat_words():
    rng = np.random.default_rng(2)
    for size in (0, 7, 8, 9, 40, 200, 900):
        for vocabulary in (1, 2, 3, 50):
            words = [b"w%d" % x for x in rng.integers(0, vocabulary, size)]
            words = words + words[: size // 3]
            assert rules.repeat_words(words) == brute_repeat(words)


def test_rules(spark, odd):
    out = rules.apply_rules(odd.withColumn("kept", F.lit("mine"))).collect()
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"] and by[6]["n_symbols"] == 4 and by[3]["n_words"] == 30_000
    assert rules.apply_rules(odd.limit(0)).count() == 0


def test_cascade_order_and_verdict(spark):
    ticks = iter(range(1000))
    order, found = rules.cascade_order(["a b"] * 4, {"never": lambda d: False, "always": lambda d: True, "half": lambda d: d.n_words > 5}, clock=lambda: next(ticks))
    assert order[0] == "always" and found["always"][1] == 1.0
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = list(rules.RULES)
    one = {r["doc_id"]: r["kept"] for r in rules.apply_rules(d, order=names).collect()}
    assert one == {r["doc_id"]: r["kept"] for r in rules.apply_rules(d, order=names[::-1], measures=False).collect()}


def test_cascade_spares_later_rules(monkeypatch):
    """A document that one rule rejects is never measured for the rules after it."""
    asked = collections.Counter()
    for name in ("_n_stop_words", "_top_pair", "_n_no_letter"):
        own = getattr(rules.Document, name)
        monkeypatch.setattr(rules.Document, name, lambda self, own=own, name=name: (asked.update([name]), own(self))[1])
    texts = ["### $$$ ***"] * 9 + ["the plain words of a text and some more of the same kind in it to make it long enough for the base rule to pass it on"]
    for t in texts:
        d = rules.Document(t)
        next((r for r in ("symbols", "stop_words", "letters", "top_pair") if rules.RULES[r](d)), None)
    assert asked == {"_n_stop_words": 1, "_top_pair": 1, "_n_no_letter": 1}


def test_cascade_counts_what_earlier_rules_leave():
    ticks = iter(range(10_000))
    kinds = {"most": lambda d: d.n_words < 6, "same": lambda d: d.n_words < 5, "other": lambda d: d.n_words > 8}
    texts = ["a b"] * 6 + ["a b c d e"] + ["a b c d e f g h i"] * 2
    assert rules.cascade_order(texts, kinds, clock=lambda: next(ticks))[0] == ["most", "other", "same"]


# -- names that clash, for every operator


def test_clashing_names(spark, odd):
    """Columns that differ from an output in case only are replaced; a dot in a name does no harm."""
    d = odd.withColumn("a.b", F.lit(1))
    for name in ("Score", "Size", "KEPT", "N_removed", "Exact", "Predicted"):
        d = d.withColumn(name, F.lit("mine"))
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    n = len(ODD)
    for out in (classifier.score(d, classifier.fit(d, labels)), mixing.mix(d), rules.apply_rules(d), substring.dedup(d), bpe.encode(d, tokenizer_path())):
        low = [c.lower() for c in out.columns]
        assert "a.b" in low and len(low) == len(set(low)) and out.count() == n
    assert neardup.keep_one(d).columns == d.columns and neardup.keep_one(d).count() == 8
    assert mixing.mix_rows(d).columns == d.columns and mixing.mix_rows(d).count() > 0
    assert lm.score_documents(d).count() == n and neardup.groups(d).count() == n
