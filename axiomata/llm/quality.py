"""Quality classifier: a sparse rule ensemble compiled into column expressions.

Statistics of the text are plain Spark columns. Small boosted trees over a
bounded labelled sample give candidate rules (the conjunctions along tree
paths); a lasso logistic regression picks and weighs a few of them; the rules
become ``CASE WHEN`` expressions, so scoring runs inside the JVM with one scan
and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text (null: empty); all are finite, 0 where a ratio has no base."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.split(t, "\n")
    n, n_words = F.length(t), F.size(words)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    only = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]+", ""))
    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": ratio(n, n_words),
        "distinct_words": ratio(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)), F.size(lines)),
        "upper": ratio(only("\\p{Lu}"), n),
        "digits": ratio(only("0-9"), n),
        "symbols": ratio(only("#$%&*@<>{}=_~^\\\\/+\\[\\]"), n),
        "bars": ratio(only("|"), n_words),
        "shouts": ratio(only("!?"), n_words),
        "stops": ratio(only("."), n_words),
        "commas": ratio(only(","), n_words),
        "repeats": ratio(F.regexp_count(t, F.lit("(?<!\\S)(\\S+)\\s\\1(?!\\S)")), n_words),
    }


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), all of which hold


@dataclass
class RuleModel:
    """Names of the statistics, an intercept and weighted rules."""

    names: list[str]
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as a column: probability of label 1."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for i, above, at in rule:
                x = stats[self.names[i]]
                holds = holds & ((x > at) if above else (x <= at))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-total))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, at in rule:
        out &= (x[:, i] > at) if above else (x[:, i] <= at)
    return out


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int):
    """One regression tree on gradients: its paths as (rule, value, rows)."""
    found = []

    def grow(rows: np.ndarray, rule: Rule, left: int) -> np.ndarray:
        g, h = grad[rows].sum(), hess[rows].sum()
        value = np.full(len(rows), g / (h + 1.0))
        if rule:
            found.append(rule)
        if not left or len(rows) < 2 * least:
            return value
        best = (1e-6, -1, 0)
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            width = len(cuts[f]) + 1
            gs = np.cumsum(np.bincount(bins[rows, f], grad[rows], width))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, f], hess[rows], width))[:-1]
            ns = np.cumsum(np.bincount(bins[rows, f], minlength=width))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] < 0:
            return value
        _, f, k = best
        low, cut = bins[rows, f] <= k, float(cuts[f][k])
        value[low] = grow(rows[low], (*rule, (f, False, cut)), left - 1)
        value[~low] = grow(rows[~low], (*rule, (f, True, cut)), left - 1)
        return value

    return grow(np.arange(len(x)), (), depth), found


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, least: int = 10, lasso: float = 1e-3, steps: int = 600) -> RuleModel:
    """Boost trees, take their paths as rules, weigh the rules by lasso logistic regression.

    With no rows the score is 0.5 everywhere, with one class the smoothed base rate.
    """
    base = (y.sum() + 0.5) / (len(y) + 1.0)
    intercept = float(np.log(base / (1 - base)))
    if len(set(y.tolist())) < 2:
        return RuleModel(names, intercept)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 34)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    margin, rules = np.full(len(y), intercept), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        value, paths = _tree(x, bins, cuts, y - p, p * (1 - p), depth, least)
        margin += 0.3 * value
        rules.update(dict.fromkeys(paths))
    rules = list(rules)
    if not rules:  # too few rows for any split
        return RuleModel(names, intercept)
    z = np.stack([_holds(r, x) for r in rules], 1).astype(float)
    keep = np.flatnonzero((z.mean(0) > 0) & (z.mean(0) < 1))
    if not len(keep):
        return RuleModel(names, intercept)
    _, first = np.unique(z[:, keep], axis=1, return_index=True)  # rules that hold for the same rows: one of them
    keep = keep[np.sort(first)]
    z, rules = z[:, keep], [rules[i] for i in keep]
    w, b, wy, by, t = np.zeros(len(rules)), intercept, np.zeros(len(rules)), intercept, 1.0
    rate = 4 * len(y) / max(np.linalg.norm(np.hstack([z, np.ones((len(y), 1))]), 2) ** 2, 1e-9)
    for _ in range(steps):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(z @ wy + by)))
        gw, gb = z.T @ (p - y) / len(y), float((p - y).mean())
        w2 = wy - rate * gw
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * lasso, 0)
        b2, t2 = by - rate * gb, (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return RuleModel(names, float(b), [(r, float(v)) for r, v in zip(rules, w) if v])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> RuleModel:
    """Fit on at most ``sample`` labelled ids, the first by a hash; null labels are left out, and of several texts of one id all but the least by its statistics.

    The sample is a documented bound: its ids are broadcast, and only its
    statistics (a few numbers a row) come to the driver.
    """
    key, label = F.col(id_col).cast("string"), F.col(label_col)
    chosen = labels.filter(label.isNotNull() & F.col(id_col).isNotNull()).select(key.alias("__key"), label.cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__key", F.lit("quality")), "__key", "__label").limit(sample)
    stats = statistics(F.col(text_col))
    rows = docs.select(key.alias("__doc"), F.col(text_col)).join(F.broadcast(chosen), F.col("__doc") == F.col("__key"))
    rows = rows.select(F.col("__doc").alias("key"), F.col("__label").alias("label"), F.struct(*[c.alias(n) for n, c in stats.items()]).alias("stats"))
    got = rows.groupBy("key", "label").agg(F.min("stats").alias("stats")).select("key", "label", "stats.*").toPandas()
    got = got.sort_values(list(got.columns), kind="stable")  # the order rows arrive in must not matter
    return fit_rules(got[list(stats)].to_numpy(float), got["label"].to_numpy(float), list(stats), **how)


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` in 0 to 1; null and empty texts score as empty; a column of that name is replaced, others stay."""
    stats = statistics(F.col(text_col))
    used = {model.names[i] for rule, _ in model.rules for i, _, _ in rule}
    at = {n: f"__stat_{n}" for n in stats if n in used}
    wide = docs.select("*", *[stats[n].alias(a) for n, a in at.items()])
    return wide.withColumn(score, model.column({n: F.col(a) for n, a in at.items()})).drop(*at.values())


def kept(docs: DataFrame, model: RuleModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, that score ``least`` or more.

    A plain filter on the score would be pushed below the projection of the
    statistics and compute them anew for every rule that reads them; an
    explode of zero or one element keeps each statistic computed once.
    """
    stats = statistics(F.col(text_col))
    used = {model.names[i] for rule, _ in model.rules for i, _, _ in rule}
    at = {n: f"__stat_{n}" for n in stats if n in used}
    wide = docs.select("*", *[stats[n].alias(a) for n, a in at.items()])
    score = model.column({n: F.col(a) for n, a in at.items()})
    return wide.select("*", F.explode(F.when(score >= least, F.array(F.lit(1)))).alias("__kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
