"""Secret scans: candidates judged by a random forest that removes false positives."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_-]))?")
#: Names that announce a secret.
NAMES = ("token secret password passwd pwd apikey api_key key credential credentials "
         "authorization bearer").split()
ASSIGNED = re.compile(r"([A-Za-z0-9_.-]+)[\"']?\s{0,3}[:=]{1,2}\s{0,3}(?:(?:bearer|basic)\s{1,3})?[\"']?$", re.I)
#: A value of eight or more characters after a name that holds an announcing one and ``:`` or ``=``:
#: up to the closing quote, in a URL up to the next parameter, else up to the next space.
ANNOUNCED = re.compile(
    rf"(?:{'|'.join(NAMES)})[A-Za-z0-9_-]{{0,40}}[\"']?\s{{0,3}}[:=]{{1,2}}\s{{0,3}}(?:(?:bearer|basic)\s{{1,3}})?"
    r"(?:\"([^\s\"]{8,})\"|'([^\s']{8,})'|([^\s\"']\S{7,}))", re.I)
URL_START = re.compile(r"[?&][A-Za-z0-9_.-]*$")
WORD = re.compile(r"[^\W_]+")
FEATURES = ("length letters digits upper changes transitions coverage path quoted assigned "
            "neighbours").split()


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def near_words(text: str, start: int, end: int) -> list[str]:
    """Two words before and one after, lower-cased; looks no further than 64 characters."""
    before = WORD.findall(text[max(0, start - 64):start].lower())[-2:]
    return before + WORD.findall(text[end:end + 64].lower())[:1]


def announces(name: str | None) -> bool:
    """Whether a name is or holds an announcing one as a part: ``password``, ``db_password``."""
    return name is not None and (name in NAMES or any(x in NAMES for x in re.split(r"[_.-]", name)))


def candidates(text: str | None) -> Iterator[tuple[int, int]]:
    """Spans in order, without overlaps: announced values, and long runs outside of them."""
    text, spans = text or "", []
    low = text.lower()
    for m in ANNOUNCED.finditer(text) if any(name in low for name in NAMES) else ():
        a, b = m.span(m.lastindex)
        if m.lastindex == 3:
            if URL_START.search(text[max(0, m.start() - 64):m.start()]):
                b = a + len(re.split("[&#]", text[a:b], maxsplit=1)[0])
            b = a + len(text[a:b].rstrip(".,;:)]}>\"'`"))
        if b - a >= 8:
            spans.append((a, b))
    at = 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            yield spans[at]
            at += 1
        if at == len(spans) or m.end() <= spans[at][0]:
            yield m.span()
    yield from spans[at:]


def seed_label(value: str, name: str | None, quoted: bool) -> int | None:
    """Label of a finding where its form leaves no doubt: a mix of letters and digits assigned to a
    telling name is one if it is quoted or has twelve characters or more; a value without digits or
    without letters that nothing announces is none. All else stays unlabelled."""
    letters, digits = any(map(str.isalpha, value)), any(map(str.isdigit, value))
    if announces(name) and (quoted or len(value) >= 12) and letters and digits:
        return 1
    if name is None and not quoted and letters != digits:
        return 0
    return None


@dataclass
class Language:
    """Common words and letter pairs of the corpus."""
    words: frozenset[str] = frozenset()
    pairs: dict[str, float] = field(default_factory=dict)
    rare: float = -12.0

    def coverage(self, value: str) -> float:
        """Share of characters inside known words, longest first from the left."""
        low, at, hit = value.lower(), 0, 0
        while at < len(low):
            for size in range(min(12, len(low) - at), 2, -1):
                if low[at:at + size] in self.words:
                    hit += size
                    at += size
                    break
            else:
                at += 1
        return hit / max(1, len(low))

    def transitions(self, value: str) -> float:
        """Mean log2 probability of the letter pairs."""
        low = _fold(value.lower())
        return float(np.mean([self.pairs.get(low[i:i + 2], self.rare) for i in range(len(low) - 1)]))


#: Different words a task counts before it passes its counts on.
COUNTED = 100_000


def _letter(c: str) -> str:
    """Letters of alphabets as they are; of larger scripts one per 256, so that pairs stay few."""
    return c if c < "\u0600" else chr(ord(c) & ~0xFF)


def _fold(word: str) -> str:
    return word if word.isascii() else "".join(map(_letter, word))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``word, n, texts`` of all words of all whole texts: how often, and in how many texts."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, texts = Counter(), Counter()

        def counts() -> pd.DataFrame:
            return pd.DataFrame({"word": list(words), "n": list(words.values()),
                                 "texts": [texts[w] for w in words]}).astype({"n": "int64", "texts": "int64", "word": "object"})
        for batch in batches:
            for t in batch["t"]:
                found = WORD.findall(t.lower())
                words.update(found)
                texts.update(set(found))
                if len(words) > COUNTED:
                    yield counts()
                    words.clear()
                    texts.clear()
        yield counts()
    return (docs.select(F.col(text).alias("t")).filter("t IS NOT NULL")
            .mapInPandas(count, "word string, n long, texts long")
            .groupBy("word").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")))


def pair_counts(counted: DataFrame) -> DataFrame:
    """``pair, n`` of all letter pairs; a word counts once per text that holds it."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = Counter()
        for batch in batches:
            for word, texts in zip(batch["word"], batch["texts"]):
                w = _fold(word)
                for i in range(len(w) - 1):
                    pairs[w[i:i + 2]] += texts
        yield pd.DataFrame({"pair": list(pairs), "n": list(pairs.values())}).astype({"pair": "object", "n": "int64"})
    return (counted.select("word", "texts").mapInPandas(count, "pair string, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")))


def learn_language(docs: DataFrame, text: str, most_words: int = 4000) -> Language:
    """From all whole texts: the ``most_words`` most common words, then by the word itself, and the
    letter pairs, whose number is bounded by the alphabets. Only these two tables reach the driver."""
    counted = cut(word_counts(docs, text))
    pairs = {r["pair"]: r["n"] for r in pair_counts(counted).collect()}
    firsts = Counter()
    for p, n in pairs.items():
        firsts[p[0]] += n
    scores = {p: float(np.log2(n / firsts[p[0]])) for p, n in pairs.items() if n > 1}
    common = (counted.filter((F.col("n") > 1) & F.col("word").rlike(r"^\p{L}{3,}$"))
              .orderBy(F.desc("n"), "word").limit(most_words).collect())
    return Language(frozenset(r["word"] for r in common), scores)


def measure(text: str, start: int, end: int, language: Language) -> tuple[list[float], list[str], int | None]:
    """Features but the last, the neighbouring words, and the seed label."""
    value = text[start:end]
    before = text[max(0, start - 64):start]
    match = ASSIGNED.search(before)
    name = match[1].lower() if match else None
    quoted = before[-1:] in "\"'" and before != "" and text[end:end + 1] == before[-1:]
    kinds = [_class(c) for c in value]
    n = len(value)
    path = value.count("/") + (before[-1:] in "/.@" and before != "") + ("://" in before[-16:])
    numbers = [n, kinds.count(0) / n, kinds.count(2) / n, kinds.count(1) / n,
               sum(a != b for a, b in zip(kinds, kinds[1:])) / n, language.transitions(value),
               language.coverage(value), float(path), float(quoted), float(announces(name))]
    return numbers, near_words(text, start, end), seed_label(value, name, quoted)


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    child: list[tuple[int, int]] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        child = np.array(self.child)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            right = x[rows, feature[at[rows]]] > threshold[at[rows]]
            at[rows] = child[at[rows], right.astype(int)]
        return np.array(self.value)[at]


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray):
    """Best Gini split among ``features``: (gain, feature, threshold) or None."""
    best, n, p = None, len(y), y.sum()
    whole = 2 * p * (n - p) / n
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(np.diff(v) > 0)
        if len(at):
            k, q = at + 1, c[at]
            cost = 2 * q * (k - q) / k + 2 * (p - q) * (n - k - p + q) / (n - k)
            i = int(np.argmin(cost))
            if best is None or whole - cost[i] > best[0]:
                best = whole - cost[i], int(f), float((v[at[i]] + v[at[i] + 1]) / 2)
    return best if best and best[0] > 1e-9 else None


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 31, depth: int = 8,
                seed: int = 5) -> list[Tree]:
    """Bootstrap rows per tree, a random third of the features per split."""
    random, forest = np.random.default_rng(seed), []
    some = max(2, x.shape[1] // 3)

    def build(tree: Tree, at: np.ndarray, left: int) -> int:
        node = len(tree.value)
        tree.feature.append(-1)
        tree.threshold.append(0.0)
        tree.child.append((node, node))
        tree.value.append(float(y[at].mean()))
        if left and 0 < tree.value[node] < 1:
            found = _split(x[at], y[at], random.choice(x.shape[1], some, replace=False))
            if found:
                _, f, t = found
                right = x[at, f] > t
                tree.feature[node], tree.threshold[node] = f, t
                tree.child[node] = build(tree, at[~right], left - 1), build(tree, at[right], left - 1)
        return node

    for _ in range(trees):
        tree = Tree()
        build(tree, random.integers(0, len(y), len(y)), depth)
        forest.append(tree)
    return forest


@dataclass
class SecretModel:
    """What a task needs to judge a finding. Without findings of both labels there is no forest,
    and the seed rule alone decides."""
    language: Language
    odds: dict[str, float] = field(default_factory=dict)
    forest: list[Tree] = field(default_factory=list)
    threshold: float = 0.5

    def neighbours(self, words) -> float:
        return max((self.odds.get(w, 0.0) for w in words), key=abs, default=0.0)

    def probability(self, numbers: np.ndarray, near: list, seeds: list) -> np.ndarray:
        if not self.forest or not len(numbers):
            return np.array([1.0 if s == 1 else 0.0 for s in seeds])
        x = np.column_stack([numbers, [self.neighbours(w) for w in near]])
        return np.mean([t.predict(x) for t in self.forest], axis=0)


def train(findings: pd.DataFrame, language: Language, most_words: int = 300, **growing) -> SecretModel:
    """Forest over labelled findings with ``features, near, label``."""
    y = findings["label"].to_numpy(float)
    if len(set(y)) < 2:
        return SecretModel(language)
    good, bad = Counter(), Counter()
    for words, label in zip(findings["near"], y):
        (good if label else bad).update(set(words))
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = {w: float(np.log((good[w] + .5) / (n1 + 1)) - np.log((bad[w] + .5) / (n0 + 1)))
            for w in good.keys() | bad.keys() if good[w] + bad[w] > 2}
    top = sorted(odds.items(), key=lambda z: (-abs(z[1]), z[0]))[:most_words]
    model = SecretModel(language, dict(top))
    x = np.column_stack([np.stack(findings["features"].to_numpy()),
                         [model.neighbours(w) for w in findings["near"]]])
    model.forest = grow_forest(x, y, **growing)
    return model


FOUND = ("doc long, start long, length long, digest string, features array<double>, "
         "near array<string>, seed int")


def find(docs: DataFrame, language: Language) -> DataFrame:
    """All candidates of whole texts. Values leave the task only as a digest."""
    names = [part.split()[0] for part in FOUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc"].array, batch["text"]):
                for a, b in candidates(text):
                    numbers, near, seed = measure(text, a, b, language)
                    digest = hashlib.sha256(text[a:b].encode()).hexdigest()[:16]
                    rows.append((doc, a, b - a, digest, numbers, near, seed))
            yield pd.DataFrame(rows, columns=names).astype({"doc": "Int64", "seed": "Int64"})
    return docs.mapInPandas(run, FOUND)


def labelled_findings(found: DataFrame, most_rows: int) -> pd.DataFrame:
    """At most ``most_rows`` findings of each label (a documented bound), picked by hash. A value
    found many times counts once, so no copied secret outweighs the rest."""
    once = (found.filter("seed IS NOT NULL").groupBy("seed", "digest")
            .agg(F.min(F.struct("doc", "start", "features", "near")).alias("f")))
    parts = [once.filter(F.col("seed") == label).orderBy(F.xxhash64("digest"), "digest").limit(most_rows)
             for label in (0, 1)]
    return (parts[0].unionByName(parts[1])
            .select(F.col("seed").alias("label"), "digest", "f.features", "f.near")
            .orderBy("label", "digest").toPandas())


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id: str = "doc_id",
                 text: str = "text", most_rows: int = 4000) -> tuple[DataFrame, SecretModel]:
    """``(findings, model)``: id, ``start``, ``length`` (code points), ``digest``, ``probability``,
    ``is_secret`` of every candidate of every text.

    ``labelled`` has ``digest, label`` of reviewed findings; without it, findings whose form leaves
    no doubt are the labelled ones. The forest is fitted on at most ``most_rows`` of each label and
    the language counted over all texts; every candidate of all documents is judged. Null and
    empty texts have none; repeated rows give repeated findings; null ids come back as null; an
    empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    language = learn_language(rows, "text")
    found = cut(find(rows, language))
    reviewed = found
    if labelled is not None:
        known = labelled.select("digest", F.col("label").cast("int").alias("reviewed")).distinct()
        reviewed = (found.join(known, "digest", "left")
                    .withColumn("seed", F.col("reviewed")).drop("reviewed"))
    model = train(labelled_findings(reviewed, most_rows), language)

    @F.pandas_udf("double")
    def judge(numbers: pd.Series, near: pd.Series, seeds: pd.Series) -> pd.Series:
        if not len(numbers):
            return pd.Series([], dtype="float64")
        return pd.Series(model.probability(np.stack(numbers.to_numpy()), list(near), list(seeds)))

    probability = judge("features", "near", "seed")
    rows = found.withColumn("probability", probability)
    return rows.select(F.col("doc").alias(id), "start", "length", "digest", "probability",
                       (F.col("probability") > model.threshold).alias("is_secret")), model


def redact(docs: DataFrame, model: SecretModel, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; a map without a shuffle."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = list(candidates(t))
            if spans:
                measured = [measure(t, a, b, model.language) for a, b in spans]
                bad = model.probability(np.array([m[0] for m in measured]), [m[1] for m in measured],
                                        [m[2] for m in measured]) > model.threshold
                for (a, b), hit in reversed(list(zip(spans, bad))):
                    if hit:
                        t = t[:a] + mask + t[b:]
            out.append(t)
        return pd.Series(out, dtype="object")
    return docs.withColumn(text, clean(F.col(text)))
