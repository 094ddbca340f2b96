"""Soft-membership mixing: domain posteriors from a labelled table, rates by projected gradient."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import cut

#: Word characters of the style features; each share becomes one of a few pseudo-words.
STYLES = {"symbols": r"[#*$%&|<>]", "shouting": r"[A-Z]{2}", "marks": r"[!?]"}


@dataclass(frozen=True)
class Classifier:
    """Naive Bayes over the presence of a small vocabulary, as plain numbers."""
    domains: tuple[str, ...]
    vocabulary: tuple[str, ...]
    base: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]  # [domain][word]
    temperature: float = 1.0


def tokens(text: Column) -> Column:
    """Words of a text in lower case, cut at spaces and at punctuation; null texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D.,;:]+"), "")


def with_evidence(docs: DataFrame, text: str) -> DataFrame:
    """Add ``tokens`` (how many words) and ``_found``: the distinct words and a pseudo-word per
    style, which holds the logarithmic step of its share."""
    body, count = F.coalesce(F.col(text), F.lit("")), F.greatest(F.col("tokens"), F.lit(1))
    steps = [F.concat(F.lit(f"\u0001{name}"), F.floor(F.log2(
        1 + 64 * F.least(F.regexp_count(body, F.lit(pattern)) / count, F.lit(1.0)))).cast("string"))
        for name, pattern in STYLES.items()]
    spread = F.concat(F.lit("\u0001distinct"),
                      F.floor(4 * F.size("_distinct") / count).cast("string"))
    return (docs.withColumn("_words", tokens(F.col(text)))
            .withColumn("tokens", F.size("_words").cast("long"))
            .withColumn("_distinct", F.array_distinct("_words"))
            .withColumn("_found", F.concat("_distinct", F.array(*steps, spread)))
            .drop("_words", "_distinct"))


def train(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], most_rows: int = 4000,
          vocabulary: int = 96, least: int = 3, common: float = 0.05,
          lift: float = 2.0) -> Classifier:
    """Fit on at most ``most_rows`` labelled ids (a documented bound), picked by hash.

    ``docs`` has ``id, text``; ``labelled`` has ``label_id, domain``. Words are counted per domain
    by Spark; the driver gets the style pseudo-words and at most ``vocabulary`` words: for each
    domain but the largest those that speak most for it among the words that at least ``common`` of
    its documents have, ``lift`` times as many as of the others. The largest domain brings no words,
    since a text in a rarer language lacks those without belonging elsewhere.
    """
    picked = cut(labelled.filter(F.col("label_id").isNotNull() & F.col("domain").isin(*domains))
                 .groupBy("label_id").agg(F.min("domain").alias("domain"))
                 .orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows))
    sample = cut(with_evidence(docs.join(F.broadcast(picked), F.col("id") == F.col("label_id"))
                               .select("domain", "text"), "text").select("domain", "_found"))
    sizes = {r["domain"]: r["n"] for r in
             sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = max(sum(sizes.values()), 1)
    held = [F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    counted = cut(sample.select("domain", F.explode("_found").alias("word")).groupBy("word")
                  .agg(F.count("*").alias("n"), *held).filter(F.col("n") >= least))
    usual = max(domains, key=lambda d: sizes.get(d, 0))
    style = F.col("word").startswith("\u0001")
    chosen = {row["word"]: row for row in counted.filter(style).orderBy("word").limit(64).collect()}
    for i, d in enumerate(domains):  # the words that speak most for this domain against the rest
        if d == usual:
            continue
        inside = (F.col(f"n{i}") + 0.5) / (sizes.get(d, 0) + 1)
        outside = (F.col("n") - F.col(f"n{i}") + 0.5) / (total - sizes.get(d, 0) + 1)
        tells = (inside * F.log(inside / outside)
                 + (1 - inside) * F.log((1 - inside) / (1 - outside)))
        best = (counted.filter(~style & (inside >= lift * outside) & (inside >= common)).orderBy(F.desc(tells), "word")
                .limit(vocabulary // len(domains)).collect())
        chosen |= {row["word"]: row for row in best}
    words = sorted(chosen)
    base, weights = [], []
    for i, d in enumerate(domains):
        n = sizes.get(d, 0)
        shares = [(chosen[w][f"n{i}"] + 0.5) / (n + 1) for w in words]
        base.append(math.log((n + 1) / (total + len(domains))) + sum(math.log(1 - p) for p in shares))
        weights.append(tuple(math.log(p / (1 - p)) for p in shares))
    return Classifier(domains, tuple(words), tuple(base), tuple(weights))


def _looked_up(table: Column):
    return lambda i: F.element_at(table, i)


def classify(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add ``tokens`` and ``p_<domain>``, which sum to one; null texts have no tokens."""
    words = F.array(*[F.lit(w) for w in model.vocabulary]).cast("array<string>")
    scored = (with_evidence(docs, text)
              .withColumn("_seen", F.array_intersect("_found", words))
              .withColumn("_seen", F.transform("_seen", lambda w: F.array_position(words, w).cast("int"))))
    names = model.domains
    for d, base, weights in zip(names, model.base, model.weights):
        table = F.array(*[F.lit(w) for w in weights]).cast("array<double>")
        scored = scored.withColumn(f"_x_{d}", F.lit(base) + F.aggregate(
            F.transform("_seen", _looked_up(table)), F.lit(0.0), lambda a, b: a + b))
    top = F.greatest(*[F.col(f"_x_{d}") for d in names]) if len(names) > 1 else F.col(f"_x_{names[0]}")
    raw = scored.withColumn("_top", top).select(*docs.columns, "tokens", *[
        F.exp((F.col(f"_x_{d}") - F.col("_top")) / model.temperature).alias(f"_e_{d}") for d in names])
    total = sum((F.col(f"_e_{d}") for d in names), F.lit(0.0))
    return raw.select(*docs.columns, "tokens",
                      *[(F.col(f"_e_{d}") / total).alias(f"p_{d}") for d in names])


def _rate(start: Column, posterior: list[Column], history: list[list[float]], bound: float) -> Column:
    """From ``start``; every step moves against the errors and is projected to 0 .. ``bound``. Each
    step names the one before it once, so the expression grows by a few nodes per step."""
    for step in history:
        start = F.least(F.lit(bound), F.greatest(F.lit(0.0), start - sum(
            (p * F.lit(float(x)) for p, x in zip(posterior, step)), F.lit(0.0))))
    return start


#: Step lengths tried in one sum: of the scaled step, and of the plain one.
LENGTHS = ((4.0, 2.0, 1.0, 0.5, 0.25, 0.125), (8.0, 4.0, 2.0, 1.0))


def fit(rows: DataFrame, domains: tuple[str, ...], weights: Mapping[str, float],
        budget: float | str | None = None, tolerance: float = 1e-3, stored: int = 4,
        bound: float = math.inf, stall: float = 1e-2, look: int = 3):
    """``(rows with _r, steps, report)`` for rows with ``tokens`` and one posterior column per domain.

    Minimizes ``sum over domains of (expected tokens - target)^2 / present tokens`` over rates from 0
    to ``bound`` by projected gradient steps. A step is scaled by the matrix of posterior products
    over the rows that are free to move (inside the bounds, or at one and led off it); all lengths of
    it and of the plain step, which always descends as posteriors sum to one, are summed in one
    aggregate, and the best is taken: two distributed sums of a few numbers per step. After every
    ``stored`` steps the rates so far are written as a column, so no pass repeats an old step.

    Ends when every target is met within ``tolerance`` of the budget, or when the last ``look`` steps
    lowered the objective by less than ``look * stall`` of it, or no length lowers it. That rule is
    relative, so targets out of reach end as soon as targets within. The report says whether they
    were met, and how many steps and passes it took. ``budget`` is the sum of the targets: by default
    the present tokens; the name of a domain keeps that domain's tokens as they are.
    """
    p = [F.col(f"p_{d}") for d in domains]
    k = len(domains)
    share = sum(weights.get(d, 0.0) for d in domains)
    wanted = np.array([weights.get(d, 0.0) / share for d in domains])
    state = rows.withColumn("_r", F.lit(min(1.0, bound)))
    steps: list[list[float]] = []
    pending: list[list[float]] = []  # steps that the stored rates lack
    passes = 0

    def sums(columns: list[Column]) -> np.ndarray:
        nonlocal passes
        passes += 1
        return np.array([x or 0.0 for x in state.withColumn("_r", _rate(F.col("_r"), p, pending, bound)).agg(
            *[F.sum(c) for c in columns]).first()])

    expected = sums([q * F.col("tokens") * F.col("_r") for q in p] + [q * F.col("tokens") for q in p])
    expected, present = expected[:k], expected[k:]
    some = present > 0
    size = float(present.sum()) if budget is None else (
        present[domains.index(budget)] / wanted[domains.index(budget)]
        if isinstance(budget, str) else float(budget))
    target = wanted * size
    cost = lambda e: float((((e - target) ** 2)[some] / present[some]).sum())
    far = lambda: bool((np.abs(expected - target)[some] > tolerance * size).any())
    costs = [cost(expected)]
    while far():
        error = np.where(some, expected - target, 0.0)
        plain = np.divide(error, present, out=np.zeros(k), where=some)
        pull = sum((q * F.lit(float(x)) for q, x in zip(p, plain)), F.lit(0.0))
        free = F.when(((F.col("_r") > 0) | (pull < 0)) & ((F.col("_r") < bound) | (pull > 0)), F.col("tokens")).otherwise(0)
        upper = sums([p[i] * p[j] * free for i in range(k) for j in range(i, k)])
        matrix = np.zeros((k, k))
        matrix[np.triu_indices(k)] = upper
        matrix += np.triu(matrix, 1).T
        full = np.linalg.pinv(matrix, rcond=1e-6, hermitian=True) @ error
        tried = [(x * s).tolist() for lengths, s in zip(LENGTHS, (full, plain)) for x in lengths]
        got = sums([q * F.col("tokens") * _rate(F.col("_r"), p, [t], bound) for t in tried for q in p])
        reached = min(range(len(tried)), key=lambda i: cost(got[i * k:i * k + k]))
        if cost(got[reached * k:reached * k + k]) >= costs[-1]:
            break
        expected = got[reached * k:reached * k + k]
        steps.append(tried[reached])
        pending.append(tried[reached])
        costs.append(cost(expected))
        if len(pending) == stored:
            state, pending = cut(state.withColumn("_r", _rate(F.col("_r"), p, pending, bound))), []
        if len(costs) > look and costs[-1 - look] - costs[-1] < look * stall * costs[-1 - look]:
            break
    report = {"target": dict(zip(domains, target.tolist())),
              "expected": dict(zip(domains, expected.tolist())),
              "present": dict(zip(domains, present.tolist())),
              "steps": len(steps), "passes": passes, "met": not far()}
    return state.withColumn("_r", _rate(F.col("_r"), p, pending, bound)), steps, report


def fit_rates(rows: DataFrame, domains: tuple[str, ...], weights: Mapping[str, float],
              budget: float | str | None = None, tolerance: float = 1e-3, stored: int = 4,
              bound: float = math.inf, stall: float = 1e-2):
    """``(rate column, report)`` by ``fit``; the column needs the posteriors only."""
    narrow = rows.select("tokens", *[f"p_{d}" for d in domains])
    _, steps, report = fit(narrow, domains, weights, budget, tolerance, stored, bound, stall)
    return _rate(F.lit(min(1.0, bound)), [F.col(f"p_{d}") for d in domains], steps, bound), report


def quality_domains(labels: DataFrame) -> DataFrame:
    """Domains of a table of quality and toxicity labels; a row with a null label is left out."""
    return labels.filter("quality IS NOT NULL AND toxic IS NOT NULL").select(
        F.col("doc_id").alias("label_id"),
        F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic")
        .otherwise("clean").alias("domain"))


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], id: str = "doc_id",
        text: str = "text", budget: float | str | None = None, bound: float = math.inf, **training):
    """``(rows, report)``: id, ``tokens``, ``p_<domain>`` and ``rate`` for each row of ``docs``.

    ``labelled`` has ``label_id, domain``; ``weights`` names the domains. ``rate`` is the expected
    number of times a document is taken, at most ``bound``: expected domain totals
    ``sum(p * tokens * rate)`` meet the targets, or come as near as such rates can
    (``report["met"]`` says which). A domain
    without tokens cannot be filled and is left out of the fit. Null and empty texts have zero
    tokens and a rate like any other; without usable labels all posteriors are equal; repeated rows
    and null ids are rated alike; an empty table gives no rows. Other columns are not read.
    """
    domains = tuple(weights)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    model = train(rows, labelled, domains, **training)
    narrow = cut(classify(rows, model).drop("text"))
    rated, _, report = fit(narrow, domains, weights, budget, bound=bound)
    return rated.withColumnsRenamed({"_r": "rate", "id": id}), report


def copies(rate: Column, key: Column, snap: float = 0.1) -> Column:
    """Whole copies of a document: the rate rounded up or down by a hash of ``key``, so that the
    expected number is the rate; rates within ``snap`` of a whole number are that number."""
    chance = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    near = F.abs(rate - F.rint(rate)) <= snap
    return F.when(near, F.rint(rate)).otherwise(F.floor(rate + chance)).cast("int")


def resample(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float],
             budget: float | str | None = None, text: str = "text", key: str = "doc_id",
             bound: float = math.inf, **training) -> DataFrame:
    """``docs`` with each row as often as its rate says; the columns stay. A rate over 1 takes a row
    more than once; with a ``bound`` of 1 no row is repeated. Null and empty texts are rated like any
    other; an empty table gives no rows.

    Rows are written once with their posteriors. The fit reads and rewrites only those numbers; the
    few steps are applied to each row once at the end, which spares a join of whole rows."""
    domains = tuple(weights)
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    model = train(plain, labelled, domains, **training)
    rows = cut(classify(docs.select(F.struct("*").alias("row")), model, f"row.{text}"))
    rate, _ = fit_rates(rows, domains, weights, budget, bound=bound)
    taken = rows.select("row", copies(rate, F.col("row")).alias("n"))
    return taken.select(F.explode(F.array_repeat("row", F.col("n"))).alias("row")).select("row.*")
