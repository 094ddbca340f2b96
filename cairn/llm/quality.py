"""Quality rules: text statistics and a learned decision list of threshold conjunctions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.tokens import window_ids, word_ids, words_of
from cairn.session import cut

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_adjacent", "n_upper", "n_marks"]


def _dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _repeat_words(ids: np.ndarray, width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first included."""
    names = window_ids(ids, width)
    if len(names) < 2:
        return 0
    again = np.bincount(names)[names] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    """BASE and EXTRA of one whole text; null counts as empty, all zero."""
    if not text:
        return (0,) * (len(BASE) + len(EXTRA))
    words = words_of(text)
    ids = word_ids(words)
    count = text.count
    return (len(words), len(text) - sum(map(count, SPACES)), sum(map(count, SYMBOLS)),
            _dup_lines(text), _repeat_words(ids), int((ids[1:] == ids[:-1]).sum()),
            sum(w.isupper() for w in words), count("!") + count("?"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add a struct ``stats`` of longs, computed over whole texts."""
    names = BASE + EXTRA

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = [statistics_of(t) for t in texts]
        return pd.DataFrame(rows, columns=names, dtype="int64")

    return docs.withColumn("stats", measure(F.col(text)))


#: Interpretable ratios a rule may test: name -> (numerator, denominator) among the statistics.
#: Lengths of words and texts are left out: they tell languages apart, not good from bad.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_lines_per_word": ("n_dup_lines", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "adjacent_share": ("n_adjacent", "n_words"),
    "upper_share": ("n_upper", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
}
FEATURES = list(RATIOS)


def features(stats: Column) -> dict[str, Column]:
    """Spark columns of FEATURES; a ratio of a wordless text is zero."""
    return {name: F.coalesce(F.try_divide(stats[a].cast("double"), stats[b].cast("double")),
                             F.lit(0.0)) for name, (a, b) in RATIOS.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        x, t = columns[self.feature], F.lit(float(self.threshold))
        return x > t if self.above else x <= t

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(table.values()))), bool)
    for condition in rule:
        hit &= condition.holds(table)
    return hit


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """Information gained on the positives that a further condition keeps."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -np.inf)


def _best_condition(table, bad, hit) -> Condition | None:
    """The condition of largest gain; thresholds are midpoints between neighbouring values."""
    p0, n0 = int((bad & hit).sum()), int((~bad & hit).sum())
    best, found = 1e-9, None
    for name, values in table.items():
        x, y = values[hit], bad[hit]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        last = np.flatnonzero(np.diff(x) > 0)
        if not len(last):
            continue
        p, k = np.cumsum(y)[last], last + 1
        for above, pp, nn in ((False, p, k - p), (True, p0 - p, n0 - (k - p))):
            gain = _gain(pp.astype(float), nn.astype(float), p0, n0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best = gain[i]
                found = Condition(name, above, float((x[last[i]] + x[last[i] + 1]) / 2))
    return found


def _grow(table, bad, most: int) -> Rule:
    rule: list[Condition] = []
    hit = np.ones(len(bad), bool)
    while len(rule) < most and (~bad & hit).any():
        condition = _best_condition(table, bad, hit)
        if condition is None:
            break
        rule.append(condition)
        hit &= condition.holds(table)
    return tuple(rule)


def _prune(rule: Rule, table, bad) -> Rule:
    """Drop final conditions while that does not lower (p - n) / (p + n) on the pruning rows."""
    def worth(r: Rule) -> float:
        hit = covered(r, table)
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        return (p - n) / (p + n) if p + n else -1.0
    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.995,
                least: int = 5, most_rules: int = 24, most_conditions: int = 4,
                seed: int = 7) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune it on the rest,
    keep it if its precision over all remaining rows reaches ``precision`` and it covers at least
    ``least`` bad rows, take away what it covers, and go on. A pruned rule that falls short is
    tried as it was grown, then other splits are tried; learning stops when five fall short. The
    rules are ordered; a row that none covers is good. One class only gives no rules."""
    random = np.random.default_rng(seed)
    left, rules, failed = np.ones(len(bad), bool), [], 0
    while len(rules) < most_rules and (bad & left).sum() >= least and failed < 5:
        third = random.random(len(bad)) < 1 / 3
        grow, prune = left & ~third, left & third
        failed += 1
        if not (bad & grow).any() or not (~bad & grow).any():
            continue
        rule = _grow({k: v[grow] for k, v in table.items()}, bad[grow], most_conditions)
        if not rule:
            continue
        short = _prune(rule, {k: v[prune] for k, v in table.items()}, bad[prune])
        for candidate in (short, rule):
            hit = covered(candidate, table) & left
            p, n = int((bad & hit).sum()), int((~bad & hit).sum())
            if p >= least and p >= precision * (p + n):
                rules.append(candidate)
                left, failed = left & ~hit, 0
                break
    return rules


def verdict(rules: Iterable[Rule], stats: Column) -> Column:
    """The list as one ordered Spark conditional: 0 if no rule rejects, else the rule's number."""
    columns, result = features(stats), None
    for number, rule in enumerate(rules, 1):
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column(columns)
        result = F.when(test, number) if result is None else result.when(test, number)
    return F.lit(0) if result is None else result.otherwise(0)


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, **learning) -> list[Rule]:
    """Rules from at most ``most_rows`` labelled rows, picked by hash. ``docs`` has ``doc, text``,
    ``labels`` has ``label_id, quality``. The labels are cut before the join and the joined rows
    after it, so a hot id cannot make the sample larger than the bound."""
    picked = cut(labels.filter("quality IS NOT NULL AND label_id IS NOT NULL").distinct()
                 .orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(most_rows))
    rows = (statistics(docs.join(F.broadcast(picked), F.col("doc") == F.col("label_id")))
            .select("quality", *[c.alias(n) for n, c in features(F.col("stats")).items()])
            .orderBy(*FEATURES, "quality").limit(most_rows).toPandas())
    bad = rows["quality"].to_numpy() == 0
    return learn_rules({n: rows[n].to_numpy(float) for n in FEATURES}, bad, **learning)


def base_failed(stats: Column) -> Column:
    """Under 20 words, or over 30 % of the words in repeated 8-word windows."""
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
          label_id: str = "doc_id", quality: str = "quality", **learning) -> tuple[DataFrame, list[Rule]]:
    """``(rows, rules)``: one row per row of ``docs`` with its statistics, ``base_failed``,
    ``rule`` (the number of the rule that rejects it, 0 if none) and ``kept``.

    Statistics cover whole texts. ``most_rows`` (20,000) bounds the labelled rows the rules are
    fitted on; every document is judged. Null and empty texts have no words and fail the base;
    repeated rows are judged alike; a null id is judged like any other but never labelled; null
    labels are left out; without labels of both kinds no rule is learned and the base alone decides;
    empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    names = labels.select(F.col(label_id).alias("label_id"), F.col(quality).alias("quality"))
    rules = learn(rows, names, **learning)
    s = F.col("stats")
    judged = statistics(rows).select(
        F.col("doc").alias(id), *[s[n].alias(n) for n in BASE], base_failed(s).alias("base_failed"),
        verdict(rules, s).cast("int").alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def accepted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
             label_id: str = "doc_id", quality: str = "quality", **learning) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns; a map without a shuffle."""
    rows = docs.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    names = labels.select(F.col(label_id).alias("label_id"), F.col(quality).alias("quality"))
    rules = learn(rows, names, **learning)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    s = F.col("stats")
    return (statistics(packed).filter(~base_failed(s) & (verdict(rules, s) == 0)).select("row.*"))
