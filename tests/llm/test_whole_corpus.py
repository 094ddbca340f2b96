"""Prefix trie, filter audit and suffix sorting against brute force, with every odd case."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import audit, prefixes, suffixes

TALK = "conv_id long, turn int, role string, text string, key int, shard string"


def _conversations() -> list[tuple]:
    random.seed(6)
    say = lambda n: "".join(random.choices("abc é", k=n))
    openings = [[("user", say(9)), ("bot", say(20))] for _ in range(4)]
    rows = []
    for conv in range(-7, 90):
        turns = list(random.choice(openings)) * random.randint(0, 3)
        turns += [(random.choice(["user", "bot", None]), random.choice([None, "", say(2), say(30)])) for _ in range(random.randint(0, 9))]
        rows += [(conv, at if at % 4 else None if at == 0 else at, *turn, 1, "x") for at, turn in enumerate(turns)]
    long = [("user", str(i % 5)) for i in range(400)]
    rows += [(200, at, *turn, None, None) for at, turn in enumerate(long)]
    rows += [(201, at, *turn, None, None) for at, turn in enumerate(long[:399])]
    rows += [(conv, 0, "user", "same", 2, "y") for conv in range(300, 420)]
    rows += [rows[3], rows[3], (5, 1, "tie", "b", 1, "z"), (5, 1, "tie", "a", 1, "z"), (None, 1, "user", "lost", 1, "x")]
    random.shuffle(rows)
    return rows


def _trie(rows: list[tuple], rebuild: bool) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    members, enders = defaultdict(list), defaultdict(list)
    for c, seq in sorted(whole.items()):
        enders[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, of in members.items():
        spared = (len(of) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += spared
    return [(min(of), len(node), min(members[node[:-1]]) if node else None, len(of), kids[node], leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, enders.get(node, []))).encode()).hexdigest()) for node, of in members.items()]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("turns, span", [(500_000, 4096), (40, 7)])
def test_trie_matches_brute_force(spark, monkeypatch, turns, span):
    monkeypatch.setattr(prefixes, "SPAN", span)
    rows = _conversations()
    frame = spark.createDataFrame(rows, TALK).repartition(4)
    assert _sorted(prefixes.prefix_trie(frame, shard_turns=turns).collect()) == _sorted(_trie(rows, True))


def test_trie_of_conversations_as_they_are(spark):
    rows = _conversations()
    frame = spark.createDataFrame(rows, TALK)
    assert _sorted(prefixes.prefix_trie(frame, family=None, shard_turns=300).collect()) == _sorted(_trie(rows, False))
    assert prefixes.prefix_trie(frame.limit(0)).collect() == []
    empty = spark.createDataFrame([(1, 1, None, None, 1, "x")], TALK)
    found = _sorted(prefixes.prefix_trie(empty).collect())
    assert found == _sorted(_trie([(1, 1, None, None)], True))


def test_ranges_of_one_shard_give_the_same_nodes():
    rows = _conversations()
    names = {t: random.Random(repr(t)).randbytes(16) for t in {((r[2] or ""), (r[3] or "")) for r in rows}}
    seqs = defaultdict(list)
    for r in rows:
        seqs[r[0]].append(names[(r[2] or "", r[3] or "")])
    distinct = sorted({b"".join(s) for s in seqs.values()})
    whole = {}
    for cells in (1 << 21, 700):
        prefixes.CELLS, kept = cells, prefixes.CELLS
        try:
            chunks = prefixes._chunks(distinct)
        finally:
            prefixes.CELLS = kept
        assert sorted(i for c in chunks for i in c.tolist()) == list(range(len(distinct)))
        assert cells > 700 or len(chunks) > 3
        total = Counter()
        for k, c in enumerate(chunks):
            part = [distinct[i] for i in c]
            low = None if k == 0 else max(distinct[i] for i in chunks[k - 1])
            high = None if k == len(chunks) - 1 else min(distinct[i] for i in chunks[k + 1])
            for found in prefixes._nodes(part, [(b"\1" + bytes(7)) * (len(x) // 16) for x in part],
                                         np.ones(len(part), np.int64), np.arange(len(part)), np.full(len(part), "e", object), low, high):
                for field in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    total[field, int(found["depth"][0])] += int(found[field].sum())
        whole[cells] = total
    assert whole[1 << 21] == whole[700]


DOCS = "doc_id long, text string, lang string, key int, block int, mask int, good boolean"


def _documents() -> list[tuple]:
    random.seed(9)
    words = ["".join(random.choices("abcdefgh", k=random.randint(1, 6))) for _ in range(200)] + ["ABC", "X#", "é€", "50%"]
    text = lambda n: " ".join(random.choices(words, k=n))
    passage, rare = text(40), "".join(chr(random.randint(0x4E00, 0x9FFF)) for _ in range(70))
    texts = [text(random.randint(0, 250)) for _ in range(60)]
    texts += [text(20) + passage + text(5) for _ in range(20)] + [text(3) + rare[random.randint(0, 30):] for _ in range(9)]
    texts += ["a" * 300, "a" * 120, "ab" * 200, "x" * 49, "x" * 50, "y" + "x" * 50, "", " \t\n", "AB" * 40 + " ok" * 90]
    texts += [texts[4]] * 40 + [texts[70]] * 3 + [passage, passage[3:60], text(30_000), None, None]
    ids = random.sample(range(-50, 1000), len(texts))
    rows = [(i, t, random.choice(["en", "de", None, ""]), 1, 2, 3, None) for i, t in zip(ids, texts)]
    rows += [rows[10], rows[10], (rows[11][0], rows[12][1], "fr", None, None, None, None)]
    rows += [(None, texts[4], "en", None, None, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("length, period", [(50, 31), (50, 7), (23, 13)])
def test_suffixes_match_brute_force(spark, monkeypatch, length, period):
    monkeypatch.setattr(suffixes, "BLOCK", 5_000)
    monkeypatch.setattr(suffixes, "BUCKET", 9_000)
    rows = _documents()
    first = {}
    for doc, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        body = (text or "").encode()
        for i in range(len(body) - length + 1):
            first.setdefault(body[i:i + length], doc)
    want = []
    for doc, text, *_ in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            if doc is not None and first[body[i:i + length]] < doc:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(body, gone) if not g)
        want.append((doc, len(body), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    got = suffixes.remove_repeated_bytes(frame, length=length, period=period)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert _sorted(got.collect()) == _sorted(want)


def test_suffixes_of_an_empty_table(spark):
    frame = spark.createDataFrame([], DOCS)
    assert suffixes.remove_repeated_bytes(frame).collect() == []
    short = spark.createDataFrame([(1, "a" * 49, None, 1, 1, 1, True), (2, "a" * 49, None, 1, 1, 1, True)], DOCS)
    assert [r["n_removed"] for r in suffixes.remove_repeated_bytes(short).collect()] == [0, 0]


def test_names_survive_packing():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        names = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        assert (suffixes.unpacked(suffixes.packed(names), len(names)) == names).all()
    edges = suffixes.bucket_edges(5)
    assert len(edges) == 4 and (np.diff(edges.astype(float)) > 0).all()


def _audited(rows, labels) -> list[tuple]:
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    judged = defaultdict(list)
    for doc, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": bool(set(text) & set("#$%&*|")),
                 "E": doc is not None and least[text] < doc}
        judged[lang or ""].append(({f for f in fails if fails[f]}, doc in good, doc in toxic))
    found, shapley = [], Counter()
    for part, docs in judged.items():
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                here = [x for x in docs if f in x[0] and not x[0] & before]
                shapley[part, f] += len(here)
                found.append([part, "".join(order), step + 1, sum(not x[0] & (before | {f}) for x in docs), len(here),
                              sum(f in x[0] and bool(x[0] & before) for x in docs), sum(x[0] == {f} for x in docs),
                              sum(x[1] for x in here), sum(x[2] for x in here), f])
    return [(*r[:-1], shapley[r[0], r[-1]]) for r in found]


@pytest.mark.parametrize("descending", [False, True])
def test_audit_takes_masks_back_over_micro_batches(spark, tmp_path, descending):
    rows = _documents()
    labels = [(r[0], random.choice([0, 1, None]), random.choice([0, 1, None])) for r in rows[::2]] + [(rows[0][0], 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(rows, DOCS)
    path = f"{tmp_path}/documents"
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0), reverse=descending)
    for at in range(0, len(ordered), 25):  # one file after the other, in order of time
        spark.createDataFrame(ordered[at:at + 25], DOCS).coalesce(1).write.mode("append").parquet(path)
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(spark, path, flags, files_per_batch=2)
    assert _sorted(got.collect()) == _sorted(_audited(rows, labels))
    assert frame.count() == len(rows)


def test_audit_goes_on_with_new_files(spark, tmp_path):
    rows, path, folder = _documents(), f"{tmp_path}/documents", f"{tmp_path}/state"
    flags = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    half = len(rows) // 2
    for part, so_far in ((rows[half:], rows[half:]), (rows[:half], rows)):
        spark.createDataFrame(part, DOCS).coalesce(2).write.mode("append").parquet(path)
        got = audit.audit(spark, path, flags, files_per_batch=1, folder=folder)
        assert _sorted(got.collect()) == _sorted(_audited(so_far, []))
    none = f"{tmp_path}/none"
    spark.createDataFrame([], DOCS).write.parquet(none)
    assert audit.audit(spark, none, flags).collect() == []
