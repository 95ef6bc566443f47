"""Quality classifier: a sparse rule ensemble over text statistics.

Small regression trees are boosted on a bounded sample of labelled documents. Each path from a root to a node is a
conjunctive rule over statistics of the text; a logistic regression with an L1 penalty gives the rules their weights and
drops most of them. What remains is compiled into one Spark column expression, so scoring is a single scan in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import remainder, text_of

#: Least score of a document that is kept.
KEEP = 0.3


def occurrences(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, each a double and defined for the empty text as well."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.split(text, "[ \n]"), F.split(text, "\n")
    nw, nl = F.size(words).cast("double"), F.size(lines).cast("double")
    upper, digits = F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit("[0-9]"))
    symbols = F.regexp_count(text, F.lit(r"[#$%&*|!<>{}=+~^@/\\]"))
    return {
        "chars": F.length(text).cast("double"),
        "word_length": n / nw,
        "upper": upper / n,
        "digits": digits / n,
        "symbols": symbols / n,
        "calls": occurrences(text, "!") / n,
        "bars": occurrences(text, "|") / n,
        "stops": occurrences(text, ".") / nw,
        "commas": occurrences(text, ",") / nw,
        "wide": (F.octet_length(text) - F.length(text)) / n,
        "distinct_words": F.size(F.array_distinct(words)) / nw,
        "distinct_lines": F.size(F.array_distinct(lines)) / nl,
        "line_length": n / nl,
    }


#: The statistics in the order of a model's features.
NAMES = ["chars", "word_length", "upper", "digits", "symbols", "calls", "bars", "stops", "commas", "wide", "distinct_words", "distinct_lines", "line_length"]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold): the feature is > threshold if above, else <= threshold."""

    terms: tuple[tuple[int, bool, float], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) if above else (x[:, f] <= t)
        return out

    def column(self, value) -> Column:
        out = F.lit(True)
        for f, above, t in self.terms:
            out = out & ((value(f) > t) if above else (value(f) <= t))
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * rule.of(x)
        return 1 / (1 + np.exp(-z))

    def column(self, text: Column) -> Column:
        """The score of a text as a column. The statistics are held in a struct, so each is computed once."""
        facts = F.struct(*[c.alias(n) for n, c in statistics(text).items()])

        def whole(s: Column) -> Column:
            z = F.lit(self.bias)
            for rule, w in self.rules:
                z = z + F.when(rule.column(lambda f: s[NAMES[f]]), F.lit(w)).otherwise(F.lit(0.0))
            return 1 / (1 + F.exp(-z))

        return F.element_at(F.transform(F.array(facts), whole), 1)


def grown(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, terms: tuple, paths: list, least: int = 20):
    """A regression tree by Newton steps; adds the path of every node below the root. Returns the fitted values of rows."""
    value = np.full(len(rows), -g[rows].sum() / (h[rows].sum() + 1.0))
    if terms:
        paths.append(Rule(terms))
    if depth == 0 or len(rows) < 2 * least:
        return value
    best, split = 1e-6, None
    gs, hs = g[rows], h[rows]
    whole = gs.sum() ** 2 / (hs.sum() + 1)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        at = np.searchsorted(edges, x[rows, f], "left")  # values <= edges[k] have at <= k
        n = np.bincount(at, minlength=len(edges) + 1).cumsum()[:-1]
        gl = np.bincount(at, gs, len(edges) + 1).cumsum()[:-1]
        hl = np.bincount(at, hs, len(edges) + 1).cumsum()[:-1]
        gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - whole
        gain[(n < least) | (len(rows) - n < least)] = 0
        if gain.max() > best:
            best, split = gain.max(), (f, float(edges[gain.argmax()]))
    if split is None:
        return value
    f, t = split
    low = x[rows, f] <= t
    for side, above in ((low, False), (~low, True)):
        value[side] = grown(x, cuts, g, h, rows[side], depth - 1, (*terms, (f, above, t)), paths, least)
    return value


def fitted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 0.002, steps: int = 600) -> Ensemble:
    """The ensemble for statistics x and labels y (0 or 1). Same input, same result: nothing is drawn at random."""
    if not len(y) or y.min() == y.max():
        return Ensemble(0.0 if not len(y) else (4.0 if y[0] else -4.0), ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64))) for f in range(x.shape[1])]
    prior = float(np.log(y.mean() / (1 - y.mean())))
    z, paths = np.full(len(y), prior), []
    for k in range(trees):
        p = 1 / (1 + np.exp(-z))
        part = np.flatnonzero(np.arange(len(y)) % 4 != k % 4)  # each tree leaves another quarter out: other paths
        before = len(paths)
        grown(x, cuts, p - y, p * (1 - p), part, depth, (), paths)
        step = np.zeros(len(y))
        leaves = paths[before:]
        for rule in leaves:  # deeper rules come later and refine
            m = rule.of(x)
            step[m] = -(p - y)[m].sum() / ((p * (1 - p))[m].sum() + 1)
        z = z + rate * step
    rules = list(dict.fromkeys(paths))
    r = np.array([rule.of(x) for rule in rules], float).T
    r, keep = np.unique(r, axis=1, return_index=True)  # rules that hold for the same rows are one rule
    rules = [rules[k] for k in keep]
    size = np.sqrt(np.maximum(r.mean(0) * (1 - r.mean(0)), 1e-4))
    a = (r - r.mean(0)) / size
    w, b, v, t = np.zeros(a.shape[1]), prior, np.zeros(a.shape[1]), 1.0
    lip = np.linalg.norm(a, 2) ** 2 / (4 * len(y))
    for _ in range(steps):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(a @ v + b)))
        new = v - (a.T @ (p - y) / len(y)) / lip
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lip, 0)
        b -= 4 * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    weights = w / size
    return Ensemble(float(b - (weights * r.mean(0)).sum()), tuple((rule, float(c)) for rule, c in zip(rules, weights) if abs(c) > 1e-6))


def trained(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Ensemble:
    """An ensemble from at most `sample` labelled documents whose id has a remainder other than 0, least hash first.

    The driver gets their ids, labels and thirteen statistics each; texts stay on the executors. A document with
    several labels has their majority (a tie counts as 1). Rows that share an id teach as one, by their least statistics.
    """
    rows = labels.select("doc_id", "quality").filter((remainder("doc_id", 5) != 0) & F.col("quality").isNotNull())
    truth = dict(rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect())
    if not truth:
        return fitted(np.zeros((0, len(NAMES))), np.zeros(0))
    text = text_of()
    each = docs.select("doc_id", "text").filter(F.col("doc_id").isin(list(truth))).select("doc_id", F.struct(*[c.alias(n) for n, c in statistics(text).items()]).alias("x"))
    facts = sorted(each.groupBy("doc_id").agg(F.min("x").alias("x")).collect())
    return fitted(np.array([r[1] for r in facts], float).reshape(len(facts), len(NAMES)), np.array([truth[r[0]] for r in facts], float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text; other columns are left out).

    A null text is scored as the empty text. A null id is held out. Repeated rows each have their row; without labels
    every score is 0.5.
    """
    model = trained(docs, labels, sample)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(True))
    return docs.select("doc_id", held.alias("held_out"), model.column(text_of()).alias("score")).select("doc_id", "held_out", "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
