"""The training-data operators against brute force, on a small fixture with every odd case."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import (embeddings, licenses, mixing, packing, quality, secrets, shards, shingles,
                       simhash, substrings, tokens, warc)
from cairn.llm.queries import catalog

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, size long, n int, rank int"


def _fixture() -> list[tuple]:
    random.seed(3)
    words = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(random.choices(words, k=n))
    passage, long = text(60), text(3000)
    rows = [text(random.randint(1, 200)) for _ in range(60)]
    rows += [f"{text(30)} {passage}\n{text(15)}" for _ in range(12)]
    rows += [rows[5]] * 30 + [None, "", " \t\n ", "é ü x", long, long + " " + text(5), "Aa " * 900]
    rows += [f'{text(40)} token = "{hashlib.sha1(bytes([i])).hexdigest()}" {text(4)}' for i in range(9)]
    rows += ["Released under the MIT License.", "cc by cc by", "x<|endoftext|>y", "CC BY-NC 4.0 ok"]
    rows += [text(40).replace(" ", "### ") for _ in range(8)]
    found = [(i, t, "en", 1, 2, 3) for i, t in enumerate(rows)]
    return found + [found[7], (None, rows[3], "en", 1, 2, 3), (11, rows[12], None, None, None, None)]


ROWS = _fixture()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(rows):
    return sorted((tuple((x is None, x) for x in r) for r in rows), key=repr)


def test_window_ids_are_exact():
    random.seed(1)
    for width in (1, 2, 3, 5, 8, 13):
        ids = np.array([random.randint(0, 2) for _ in range(80)])
        names = tokens.window_ids(ids, width)
        seen = {}
        for i, name in enumerate(names):
            assert seen.setdefault(tuple(ids[i:i + width]), name) == name
        assert len(set(names.tolist())) == len(seen)


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _reach(n, linked):
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = label[a], label[b]
                if x != y:
                    label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_simhash_matches_brute_force(docs, none):
    fps = [_fingerprint(r[1]) for r in ROWS]
    label = _reach(len(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    least = defaultdict(lambda: None)
    for row, g in zip(ROWS, label):
        if row[0] is not None:
            least[g] = row[0] if least[g] is None else min(least[g], row[0])
    want = [(r[0], f"{f:016x}", least[g]) for r, f, g in zip(ROWS, fps, label)]
    assert key(simhash.near_duplicates(docs).collect()) == key(want)
    assert simhash.near_duplicates(none).collect() == []


def test_crowded_blocks_give_the_same_components(spark):
    random.seed(5)
    fps = {random.getrandbits(63) for _ in range(40)}
    for seed in list(fps)[:6]:
        for _ in range(40):
            fps.add(seed ^ sum(1 << b for b in random.sample(range(63), random.randint(1, 3))))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    results = [simhash.connected_components(simhash.close_pairs(frame, crowd=c)) for c in (2, 10_000)]
    assert key(results[0].collect()) == key(results[1].collect())
    order = sorted(fps)
    label = _reach(len(order), lambda a, b: bin(order[a] ^ order[b]).count("1") <= 2)
    want = {(f, order[g]) for f, g in zip(order, label) if label.count(g) > 1}
    assert {tuple(r) for r in results[0].collect()} == want


def test_one_of_each_keeps_other_columns(docs, none):
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len({r["text"] for r in kept}) and kept[0].asDict().keys() == ROWS_NAMES
    assert simhash.one_of_each(none).collect() == []


def test_own_columns_survive_near_dedup(spark):
    rows = [(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y"), (3, "other words here", 7, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row int, _row_t string")
    for kept in (simhash.one_of_each(frame), shingles.one_of_alike(frame)):
        assert kept.columns == frame.columns
        assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


@pytest.mark.parametrize("leaders", [1, 4])
def test_near_copies_go_like_in_a_full_comparison(spark, leaders):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    texts = [None, "", "one", "One", "two words"]
    for family in range(6):
        base = [word() for _ in range(200)]
        for _ in range(30):  # an edit changes up to five shingles: similarities from 0.5 to 1
            copy = list(base)
            for at in random.sample(range(200), random.randint(0, 5)):
                copy[at] = word()
            texts.append(" ".join(copy))
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            for w in ((t or "").lower().split() for t in texts)]
    label = _reach(len(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.simhash_dedup(spark, frame, SMALL)
    assert {r["doc_id"] for r in kept.collect()} == set(label)
    nodes = spark.createDataFrame([(i, [hash(x) for x in s]) for i, s in enumerate(sets[5:])],
                                  "node long, hashes array<long>")
    block = nodes.select(F.lit(1).cast("long").alias("key"), F.lit(9 if leaders > 1 else 0).alias("band"), "node",
                         F.size("hashes").alias("size"))
    tied = simhash.connected_components(shingles.close_pairs(block, nodes, 0.8, leaders))
    assert {tuple(r) for r in tied.collect()} == {
        (i - 5, g - 5) for i, g in enumerate(label) if i >= 5 and label.count(g) > 1}
    assert corpus_pipeline.simhash_dedup(spark, frame.limit(0), SMALL).collect() == []


def test_isolated_members_of_a_family_meet_few_others(spark, monkeypatch):
    random.seed(3)
    sets = []
    for i in range(240):  # every set lacks up to 40 of 146 shingles and has as many of its own
        edits = random.randint(0, 40)
        sets.append(random.sample(range(146), 146 - edits) + [1_000 + 100 * i + j for j in range(edits)])
    sets = [{xxhash.xxh64_intdigest(str(x)) >> 1 for x in s} for s in sets]
    nodes = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "node long, hashes array<long>")
    block = nodes.select(F.lit(1).cast("long").alias("key"), F.lit(0).alias("band"), "node", F.size("hashes").alias("size"))
    asked, alike = [], shingles.alike
    monkeypatch.setattr(shingles, "alike", lambda pairs, *rest: asked.append(pairs.count()) or alike(pairs, *rest))
    tied = simhash.connected_components(shingles.close_pairs(block, nodes, 0.8))
    label = _reach(len(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {tuple(r) for r in tied.collect()} == {(i, g) for i, g in enumerate(label) if label.count(g) > 1}
    assert 60 < len(set(label)) and sum(asked) < 4 * len(sets)


def test_near_dedup_proposes_pairs_by_simhash(spark, monkeypatch):
    random.seed(4)
    fps = [random.getrandbits(63) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in random.sample(range(63), random.randint(0, 3))) for f in fps]
    frame = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    found = simhash.connected_components(shingles.simhash_pairs(frame)).collect()
    label = _reach(len(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    assert {tuple(r) for r in found} == {(i, g) for i, g in enumerate(label) if label.count(g) > 1}
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "w1 w2")], "doc_id long, text string")
    pairs, alike = [], shingles.alike
    monkeypatch.setattr(shingles, "alike", lambda asked, *rest: pairs.append(asked.count()) or alike(asked, *rest))
    assert {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, SMALL).collect()} == {1, 3}
    assert pairs == [1, 0, 0, 0]  # the fingerprints' pair is found first and needs no bands


ROWS_NAMES = {part.split()[0] for part in DOCS.split(", ")}


def _base(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            again += line in seen
            seen.add(line)
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), again, len(hit)


def test_quality_base_and_rules(spark, docs, none):
    labels = spark.createDataFrame(
        [(r[0], 0 if r[1] and "###" in r[1] else 1) for r in ROWS[:-3]] + [(None, 0), (2, None)],
        "doc_id long, quality int")
    rows, rules = quality.judge(docs, labels)
    assert rules and any("symbols_per_word" in str(c) for r in rules for c in r)
    got = {(r["doc_id"], tuple(r[n] for n in quality.BASE)): r for r in rows.collect()}
    for r in ROWS:
        base = _base(r[1])
        found = got[r[0], base]
        assert found["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        if r[1] and "###" in r[1]:
            assert not found["kept"]
        elif not found["base_failed"]:
            assert found["kept"]
    empty = labels.limit(0)
    assert quality.judge(none, empty)[0].collect() == []
    assert quality.judge(docs, empty)[1] == []
    assert set(quality.accepted(docs, labels).columns) == ROWS_NAMES


def test_shards_are_even_and_gapless(docs, none):
    got = shards.assign_shards(docs, shards=3, slots=64).collect()
    assert len(got) == len(ROWS)
    places, load = defaultdict(list), Counter()
    for r in got:
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert key((r["size"], r["text_crc32"]) for r in got) == key(
        (len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert max(load.values()) < 1.05 * sum(load.values()) / 3
    assert shards.assign_shards(none).collect() == []
    random.seed(2)
    weight = [random.randint(1, 1000) for _ in range(4096)]
    owner = shards.rebalanced(shards.first_map(24), weight, 24)
    load = Counter()
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 2


def test_packing_is_tight_whole_and_true_to_the_tokenizer(docs, none):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = []
    for r in ROWS:
        ids = np.array([*encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate([(0, first)] + [(a, a + 1024) for a in range(first, len(ids), 1024)]):
            want.append((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = packing.pack(docs).collect()
    assert key(tuple(r)[:5] for r in got) == key(want)
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in rows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(rows) <= 1 + 1.02 * sum(w[3] for w in want) / 1024
    assert packing.pack(none).collect() == []


def test_best_fit_runs_place_every_item_once():
    random.seed(4)
    for _ in range(60):
        counts = {s: random.randint(1, 9) for s in random.sample(range(1, 101), random.randint(1, 30))}
        bins, large = defaultdict(list), Counter()
        for size, low, high, first, per, at in packing.best_fit(counts, 100):
            for k in range(high - low):
                bins[first + k // per].append((at + k % per * size, size))
                large[first + k // per] += size > 33
        assert Counter(s for b in bins.values() for _, s in b) == Counter(counts)
        assert max(large.values(), default=0) <= 2
        for placed in bins.values():
            at = 0
            for offset, size in sorted(placed):
                assert offset == at
                at += size
            assert at <= 100


def test_warc_round_trip_and_damage(spark, none):
    rows = [(1, "http://a", "same"), (9, "http://b", "same"), (9, "http://b", "same"), (4, None, None),
            (5, "u\r\nx", ""), (None, "n", "same"), (7, "ü", "päge" * 50_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, id string")
    got = warc.archive_pages(pages, payloads=True).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(i, len((t or "").encode()), digest(t)) for i, _, t in rows]
    assert key((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == key(want)
    kinds = key((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == key([(1, "revisit", 9), (9, "response", None), (9, "response", None),
                         (4, "revisit", 5), (5, "response", None), (None, "revisit", 9),
                         (7, "response", None)])
    assert all(r["error"] is None for r in got)
    assert next(r for r in got if r["page_id"] == 7)["payload"].decode() == "päge" * 50_000
    assert warc.archive_pages(pages.limit(0)).collect() == []
    whole = warc.record("response", "1", "u", b"payload") + warc.record("response", "2", "u", b"more")
    assert gzip.decompress(whole).count(b"WARC/1.1") == 2
    assert [r["error"] for r in warc.read_records(io.BytesIO(whole))] == [None, None]
    assert list(warc.read_records(io.BytesIO(whole[:-9])))[-1]["error"].startswith("damaged")
    plain = gzip.decompress(warc.record("response", "1", "u", b"payload")).replace(b"payload", b"Payload")
    assert next(warc.read_records(io.BytesIO(gzip.compress(plain))))["error"] == "block digest"


def test_license_places_and_templates(docs, none):
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan_licenses(docs).collect()}
    for r in ROWS:
        words = licenses.license_words(r[1])
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.encode().split()
            hits = [i for i in range(len(words)) if words[i:i + len(p)] == p]
            places += hits
            base |= {label} if hits else set()
        found = got[r[0], len(words)]
        assert (found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == (
            len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        assert base <= set(found["labels"].split(",")) and 0 <= found["score"] <= 1
    assert licenses.scan_licenses(none).collect() == []
    scan = lambda t: licenses.scan_text(t, tuple(licenses.PHRASES.items()), tuple(licenses.TEMPLATES.items()))
    assert scan("Licensed under the Apache License, Version 2.0.")[5:] == ("apache,apache-2.0-reference", 1.0)
    assert scan("Licensed under CC BY-NC 4.0.")[5] == "cc-by,cc-by-nc-4.0-reference"
    assert scan("under the apache licence")[5:] == ("", 3 / 5)
    assert scan("under the apache license of 2.0")[5] == "apache"
    assert scan("permission is hereby granted")[5] == "" and 0 < scan("permission is hereby granted")[6] < 0.1


def _variants(template, rng):
    """A text that a template allows, and the places of its mandatory words."""
    words, fixed, skip, inside = [], [], False, False
    for part in re.findall(r"<<[^>]*>>|[^\s<>]+", template):
        if part == "<<optional>>":
            skip, inside = rng.random() < 0.5, True
        elif part == "<<end>>":
            skip, inside = False, False
        elif part.startswith("<<up to"):
            words += [f"name{rng.randrange(99)}" for _ in range(rng.randint(0, int(part[7:-2])))]
        elif not skip:
            if not inside:
                fixed.append(len(words))
            words.append(rng.choice(part[8:-2].split("|")).strip() if part.startswith("<<one of") else part)
    return words, fixed


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_templates_are_matched_whole(label):
    rng, marked = random.Random(label), tuple(licenses.TEMPLATES.items())
    for _ in range(20):
        words, fixed = _variants(licenses.TEMPLATES[label], rng)
        text = " ".join(["Intro:", *[w.upper() if rng.random() < 0.3 else w for w in words], "the end"])
        found = licenses.scan_text(text, (), marked)
        assert label in found[5].split(",") and found[6] == 1.0
    words, fixed = _variants(licenses.TEMPLATES[label], rng)
    for at in fixed:  # whatever mandatory word is altered or left out, the text is refused
        for changed in ([*words[:at], "altered", *words[at + 1:]], [*words[:at], *words[at + 1:]]):
            labels = licenses.scan_text(" ".join(changed), (), marked)[5].split(",")
            assert label not in labels, (label, at, words[at])


def test_random_templates_match_like_regular_expressions():
    rng = random.Random(11)
    for _ in range(150):
        parts, pattern = [], ""
        for _ in range(rng.randint(1, 5)):
            kind, word = rng.random(), rng.choice("ab")
            if kind < 0.5 or not parts:
                parts.append(word)
                pattern += f"{word} "
            elif kind < 0.7:
                parts += ["<<optional>>", word, "<<end>>"]
                pattern += f"(?:{word} )?"
            elif kind < 0.85:
                parts.append("<<one of a|c>>")
                pattern += "(?:a|c) "
            else:
                parts.append("<<up to 2>>")
                pattern += "(?:[abc] ){0,2}"
        for _ in range(20):
            text = " ".join(rng.choices("abc", k=rng.randint(0, 9)))
            want = re.search(rf"(?:^|(?<= )){pattern}", text + " ") is not None
            assert (licenses.scan_text(text, (), (("x", " ".join(parts)),))[5] == "x") == want, (parts, text)


def _without(rows, width=13):
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    least = {}
    for doc, words in split:
        for i in range(len(words) - width + 1 if doc is not None else 0):
            w = tuple(words[i:i + width])
            least[w] = min(least.get(w, doc), doc)
    for doc, words in split:
        gone = {i + k for i in range(len(words) - width + 1 if doc is not None else 0)
                if least[tuple(words[i:i + width])] < doc for k in range(width)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        yield doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("period", [3, 7, 13])
def test_substrings_match_brute_force(docs, none, period):
    assert key(substrings.remove_repeats(docs, period=period).collect()) == key(_without(ROWS))
    if period == 7:
        assert substrings.remove_repeats(none).collect() == []


def test_covers_meet_at_every_pair_of_residues():
    for period, cover in substrings.COVERS.items():
        assert all(any((a + k) % period in cover and (b + k) % period in cover for k in range(period))
                   for a in range(period) for b in range(period))


def test_vectors_match_brute_force(spark):
    random = np.random.default_rng(8)
    x = random.normal(size=(300, 16))
    x = np.vstack([x, x[:60] + random.normal(size=(60, 16)) * 0.05, x[:1].repeat(50, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] * 16), (904, [float("nan")] * 16),
           (905, [1.0] * 3), (None, rows[0][1])]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, node string")
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(frame, leaf_rows=64, block=40).collect()}
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    assert sum(got[i]["n_links"] for i in range(len(u))) >= 0.97 * linked.sum()
    assert all(got[i]["n_links"] <= linked[i].sum() for i in range(len(u)))
    assert got[0]["n_links"] >= 50 and got[400]["component_id"] == 0 and not got[400]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 906))
    assert embeddings.near_duplicate_vectors(frame.limit(0)).collect() == []


def test_vectors_visit_few_leaves_and_codes_decide_nothing_wrong(spark):
    random = np.random.default_rng(9)
    sample = embeddings.unit(random.normal(size=(400, 16)))
    forest = embeddings.fit_forest(sample, 400, 6, 16, 1.0)  # a margin that leads everywhere
    rows, leaves = forest.route(sample, 10)
    assert (np.bincount(rows) == 10).all() and len({*zip(rows, leaves)}) == len(rows)
    base = sample[:1]  # cosines packed around the bound, closer than a byte can tell
    side = random.normal(size=(80, 16))
    side -= (side @ base.T) * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = np.linspace(0.895, 0.905, 80)[:, None]
    x = np.vstack([base, near * base + np.sqrt(1 - near ** 2) * side])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicate_vectors(frame, leaf_rows=1000, block=10).collect()}
    linked = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.9
    assert got == dict(enumerate((linked.sum(axis=1) - 1).tolist())) and got[0] > 20


def test_secrets_are_found_masked_and_learned(docs, none):
    found, model = secrets.scan_secrets(docs)
    planted = {r[0] for r in ROWS if r[1] and "token =" in r[1]}
    hits = [r for r in found.collect() if r["is_secret"]]
    assert {r["doc_id"] for r in hits} == planted and all(r["length"] == 40 for r in hits)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).filter("doc_id is not null").collect()}
    assert all("[SECRET]" in clean[i] for i in planted)
    assert all(clean[r[0]] == r[1] for r in ROWS[:90] if r[0] not in planted and r[0] != 11)
    assert secrets.scan_secrets(none)[0].collect() == []


def test_unquoted_short_and_url_secrets(spark):
    planted = ["Zx9kQ2mP7vLt4RnB8sWd", "ghp_a8Kd93kLmQ0zX72b", "wJalrXUtnFEMIK7MDENGbPxRfiCYEX", "Tr0ub4dor&3xyz!!"]
    forms = ["run password={} now", "see https://x.org/a?token={}&page=2 there", "AWS_SECRET_ACCESS_KEY={}",
             "db_password: '{}'"]
    texts = [f.format(v) for f, v in zip(forms, planted)]
    assert [[t[a:b] for a, b in secrets.candidates(t) if b - a != 21] for t in texts] == [[v] for v in planted]
    assert [t[a:b] for t in ["pwd=aB3$xY9z.", "pwd=short"] for a, b in secrets.candidates(t)] == ["aB3$xY9z"]
    random.seed(4)
    mixed = lambda n: "".join(random.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=n))
    values = [mixed(20) + "7a" for _ in range(60)]
    rows = [f"{'some plain words here ' * 3}{forms[i % 4].format(v)}" for i, v in enumerate(values)]
    rows += [f"an internationalizationofthings{'abcdefgh'[i % 8]}andmore text" for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    _, model = secrets.scan_secrets(frame)
    clean = [r["text"] for r in secrets.redact(frame, model).orderBy("doc_id").collect()]
    assert not any(v in t for v, t in zip(values, clean)) and clean[60:] == rows[60:]
    assert "&page=2" in clean[1]


def test_language_is_counted_over_all_whole_texts(spark, none):
    texts = [f"plain{chr(97 + i % 26)} words" for i in range(900)] + ["x " * 11_000 + "zyrqwal zyrqwal", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    language = secrets.learn_language(frame, "text")
    words, pairs, firsts = Counter(), Counter(), Counter()
    for t in texts:
        found = (t or "").split()
        words.update(found)
        for w in set(found):
            pairs.update(w[i:i + 2] for i in range(len(w) - 1))
            firsts.update(w[:-1])
    assert language.words == {w for w, n in words.items() if n > 1 and len(w) >= 3} and "zyrqwal" in language.words
    assert language.pairs.keys() == {p for p, n in pairs.items() if n > 1}
    assert all(np.isclose(x, np.log2(pairs[p] / firsts[p[0]])) for p, x in language.pairs.items())
    assert secrets.learn_language(none, "text") == secrets.Language()


def test_forest_on_held_out_rows():
    random = np.random.default_rng(1)
    x = random.normal(size=(800, 5))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    forest = secrets.grow_forest(x[:600], y[:600])
    right = (np.mean([t.predict(x[600:]) for t in forest], axis=0) > 0.5) == y[600:]
    assert right.mean() > 0.93


def test_mixing_meets_its_targets(spark, docs, none):
    labels = spark.createDataFrame(
        [(r[0], "junk" if r[1] and "###" in r[1] else "good") for r in ROWS[:-3]] + [(None, "good"), (3, None)],
        "label_id long, domain string")
    rows, report = mixing.mix(docs, labels, {"good": 0.9, "junk": 0.1})
    table = rows.toPandas()
    assert report["met"] and (table["rate"] >= 0).all() and len(table) == len(ROWS)
    total = (table["p_good"] * table["tokens"] * table["rate"]).sum()
    assert abs(total - report["target"]["good"]) <= 1e-2 * table["tokens"].sum()
    assert np.allclose(table["p_good"] + table["p_junk"], 1)
    kept = mixing.resample(docs, labels, {"good": 1.0, "junk": 0.0}, budget="good")
    assert set(kept.columns) == ROWS_NAMES
    texts = [r["text"] for r in kept.collect()]
    assert not any("###" in t for t in texts if t) and len(texts) > 0.9 * (len(ROWS) - 8)
    assert mixing.mix(none, labels, {"good": 0.9, "junk": 0.1})[0].collect() == []
    assert mixing.mix(docs, labels.limit(0), {"good": 0.5, "junk": 0.5})[0].count() == len(ROWS)


def test_overlapping_posteriors_meet_their_targets(spark):
    random.seed(2)
    rows = []
    for i in range(600):
        at, uniform = i % 3, 0.3 if i % 2 else 0.6
        p = [uniform / 3 + (1 - uniform) * (j == at) for j in range(3)]
        rows.append((random.randint(1, 500), *p))
    frame = spark.createDataFrame(rows, "tokens long, p_a double, p_b double, p_c double")
    names = ("a", "b", "c")
    for weights in ((0.5, 0.25, 0.25), (0.6, 0.2, 0.2)):
        rate, report = mixing.fit_rates(frame, names, dict(zip(names, weights)), stored=2)
        got = frame.withColumn("r", rate).agg(*[F.sum(F.expr(f"p_{d} * tokens * r")) for d in names]).first()
        size = sum(r[0] for r in rows)
        assert report["met"] and all(abs(g - w * size) <= 2e-3 * size for g, w in zip(got, weights))
    rate, report = mixing.fit_rates(frame, names, {"a": 1.0, "b": 0.0, "c": 0.0}, stored=2)
    assert not report["met"] and frame.withColumn("r", rate).filter("r < 0").count() == 0
    assert report["expected"]["a"] > report["target"]["a"] / 2


@pytest.mark.parametrize("bound, most", [(1.0, 60), (float("inf"), 100)])
def test_targets_out_of_reach_end_after_few_passes(spark, bound, most):
    rng = np.random.default_rng(4)
    p = rng.dirichlet((2.0, 0.2, 0.1), 4000)
    tokens = rng.integers(1, 2000, 4000)
    frame = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(tokens, p)],
                                  "tokens long, p_a double, p_b double, p_c double")
    rate, report = mixing.fit_rates(frame, ("a", "b", "c"), {"a": 1.0, "b": 0.0, "c": 0.0}, budget="a", bound=bound)
    assert not report["met"] and report["passes"] <= most
    taken = np.array([r["r"] for r in frame.select(rate.alias("r")).collect()])
    assert taken.min() >= 0 and taken.max() <= bound
    present = (p * tokens[:, None]).sum(axis=0)
    target = np.array([present[0], 0, 0])
    cost = lambda r: (((p * (tokens * r)[:, None]).sum(axis=0) - target) ** 2 / present).sum()
    best = np.ones(4000)  # a long run of plain steps
    for _ in range(20_000):
        best = np.clip(best - p @ (((p * (tokens * best)[:, None]).sum(axis=0) - target) / present), 0, bound)
    assert (np.sqrt(cost(taken)) - np.sqrt(cost(best))) <= 5e-3 * np.sqrt(present[0])


@pytest.mark.parametrize("name", sorted(catalog.sql))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    frame = catalog.queries[name](spark, SMALL)
    result = con.execute(catalog.sql[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert key(frame.select(*names).collect()) == key(result.fetchall())


def test_pipeline_runs_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = simhash.cut(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.select("text").distinct().count() == before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == before
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_resample_keeps_clashing_columns_and_null_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({
        "row": F.lit(1), "n": F.lit("x"), "tokens": F.lit(None).cast("int"), "p_clean": F.lit(2),
        "text": F.when(F.col("doc_id") % 7 > 0, F.col("text"))})
    labelled = mixing.quality_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    weights = {"clean": 1.0, "poor": 0.0, "toxic": 0.0}
    got = mixing.resample(docs, labelled, weights, budget="clean")
    assert got.columns == docs.columns
    assert got.filter("text IS NULL").count() == docs.filter("text IS NULL").count()
    assert mixing.resample(docs.limit(0), labelled, weights, budget="clean").count() == 0
