"""Quality classifier: a sparse ensemble of rules from trees, compiled to columns (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SAMPLE = 20_000
TREES = 24
DEPTH = 3
BINS = 32
PENALTY = 0.003
THRESHOLD = 0.5
_PREFIX = "__tidemark_quality_"
NAMES = ("chars", "word_length", "distinct_words", "distinct_words_log", "upper", "digits", "signs", "bars", "shouts", "stops", "lines", "flagged")
LEAST_ROWS = 40
LEXICON = 64
LEXICON_SHARE = 0.1
LEXICON_LIFT = 20.0


def with_statistics(docs: DataFrame, prefix: str = "", lexicon: tuple[str, ...] = ()) -> DataFrame:
    """docs with the statistics that rules look at; null and empty texts have zeros.

    `flagged` is the share of words that are in `lexicon`, in lower case and as whole runs of letters and numbers.

    Words and counts pass through generators.  A projection would be merged with the rules and filters
    over it, and each of their mentions of a count would read the text again.
    """
    t = F.coalesce(F.col("text"), F.lit(""))

    def kept(signs: str) -> Column:
        """The number of signs that are among those of `signs`."""
        return F.length(F.regexp_replace(t, f"[^{signs}]+", ""))

    def times(sign: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))

    counts = {
        "n": F.length(t),
        "words": F.size(_PREFIX + "words"),
        "distinct": F.size(F.array_distinct(_PREFIX + "words")),
        "upper": kept(r"\p{Lu}"),
        "digits": kept(r"\p{N}"),
        "signs": kept(r"#$%&*+<>=@^~_{}\[\]\\"),
        "bars": times("|"),
        "shouts": times("!") + times("?"),
        "stops": kept(".,;:"),
        "lines": times("\n"),
        "flagged": F.regexp_count(F.lower(t), F.lit(_any_of(lexicon))) if lexicon else F.lit(0),
    }
    split = F.array_remove(F.split(t, r"[ \n\t\r]+"), "")
    rows = docs.select("*", F.inline(F.array(F.struct(split.alias(_PREFIX + "words")))))
    rows = rows.select("*", F.inline(F.array(F.struct(*[c.alias(f"{_PREFIX}n_{k}") for k, c in counts.items()]))))
    of = {k: F.col(f"{_PREFIX}n_{k}").cast("double") for k in counts}
    n, words = F.greatest(of["n"], F.lit(1.0)), F.greatest(of["words"], F.lit(1.0))
    found = {
        "chars": F.log1p(of["n"]),
        "word_length": (of["n"] - of["words"] + 1) / words,
        "distinct_words": of["distinct"] / words,
        "distinct_words_log": F.log1p(of["distinct"]) / F.log1p(words),
        **{k: of[k] / n for k in NAMES[4:-1]},
        "flagged": of["flagged"] / words,
    }
    return rows.select(*map(common.quoted, docs.columns), *[found[k].alias(prefix + k) for k in NAMES])


def _any_of(words: tuple[str, ...]) -> str:
    """A pattern for any of the words that no letter or number goes before or after; words are runs of these.

    A sign that no word starts with is passed over at once, and one within a word before any word is tried.
    """
    starts = "".join(sorted({w[0] for w in words}))
    return f"(?=[{starts}])" + r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(words)) + r")(?![\p{L}\p{N}])"


def lexicon(rows: DataFrame, most: int = LEXICON, share: float = LEXICON_SHARE, lift: float = LEXICON_LIFT) -> tuple[str, ...]:
    """Words by which the toxic rows of `rows` (text and toxic, a boolean) are known.

    They are in at least the given share of toxic rows, and in one `lift` times as large as that of the others; of more than `most`
    words those with the largest ratio, then of the most toxic rows, then first in order, are taken.
    """
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    n = rows.agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("rest")).first()
    if not n.toxic or not n.rest:
        return ()
    counts = rows.select("toxic", words.alias("word")).groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("r"))
    ratio = (F.col("t") / n.toxic) / ((F.col("r") + 1) / (n.rest + 1))
    found = counts.withColumn("ratio", ratio).where((F.col("t") >= share * n.toxic) & (F.col("t") >= 5) & (F.col("ratio") >= lift))
    return tuple(r.word for r in found.orderBy(F.desc("ratio"), F.desc("t"), "word").limit(most).collect())


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, bound)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, bound in self.terms:
            out = out & ((of[name] > bound) if above else (of[name] <= bound))
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, bound in self.terms:
            v = x[:, names.index(name)]
            out &= (v > bound) if above else (v <= bound)
        return out


@dataclass
class Ensemble:
    """Weighted rules and an intercept; the score is the logistic of their sum."""

    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 20.0
    lexicon: tuple[str, ...] = ()

    def score(self, of: dict[str, Column]) -> Column:
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            total = total + F.when(rule.column(of), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            total += w * rule.holds(x, names)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> list[Rule]:
    """The paths, from the root to every node, of small trees boosted for the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    out: dict[Rule, None] = {}
    total = np.zeros(len(y))

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, terms: tuple, left: int, step: np.ndarray) -> None:
        step[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
        if not left or len(rows) < 20:
            return
        best = (1e-3, None, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            gs = np.cumsum(np.bincount(b, g[rows], len(c) + 1))
            hs = np.cumsum(np.bincount(b, h[rows], len(c) + 1))
            ns = np.cumsum(np.bincount(b, minlength=len(c) + 1))
            gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
            gain[(ns < 5) | (ns > len(rows) - 5)] = -1
            k = int(np.argmax(gain[:-1]))
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        _, j, k = best
        if j is None:
            return
        low = binned[rows, j] <= k
        for above, part in ((False, rows[low]), (True, rows[~low])):
            longer = (*terms, (names[j], above, float(cuts[j][k])))
            out[Rule(longer)] = None
            split(part, g, h, longer, left - 1, step)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        step = np.zeros(len(y))
        split(np.arange(len(y)), y - p, p * (1 - p), (), depth, step)
        total += 0.3 * step
    return list(out)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean logistic loss and `penalty` times the weights' sizes, by accelerated proximal steps.

    Rows of z that are alike, as most are where it says which rules hold, are summed up first.
    """
    n, m = z.shape
    _, first, of = np.unique(z, axis=0, return_index=True, return_inverse=True)
    times = np.bincount(of.ravel(), minlength=len(first)).astype(float)
    good = np.bincount(of.ravel(), weights=y, minlength=len(first))
    z = np.hstack([z[first], np.ones((len(first), 1))])
    v = np.ones(m + 1)
    for _ in range(50):  # the largest eigenvalue of z'z by powers
        v = z.T @ (times * (z @ v))
        v /= np.linalg.norm(v)
    rate = 4 * n / max(1.0, 1.1 * float(np.linalg.norm(z.T @ (times * (z @ v)))))
    w = v = np.zeros(m + 1)
    t = 1.0
    bound = np.append(np.full(m, penalty * rate), 0.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        new = v - rate * (z.T @ (times * p - good)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - bound, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / u * (new - w)
        w, t = new, u
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = PENALTY) -> Ensemble:
    """An ensemble for the labels y (1 is good); labels of one kind alone, or fewer than LEAST_ROWS, give one without rules, which keeps every text that isn't empty."""
    if len(y) < LEAST_ROWS or len(np.unique(y)) < 2:
        return Ensemble()
    rules: list[Rule] = []
    seen = set()
    held = []
    for r in grow(x, y, names):
        on = r.holds(x, names)
        if 0 < on.sum() < len(y) and (key := np.packbits(on).tobytes()) not in seen:
            seen.add(key)
            rules.append(r)
            held.append(on)
    if not rules:
        return Ensemble()
    z = np.stack(held, axis=1).astype(np.float64)
    spread = np.maximum(z.std(axis=0), 1e-3)
    weights, intercept = lasso(z / spread, y.astype(np.float64), penalty)
    chosen = np.flatnonzero(weights)
    return Ensemble([rules[i] for i in chosen], (weights[chosen] / spread[chosen]).tolist(), intercept)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> Ensemble:
    """An ensemble fitted to at most `sample` labelled rows, those of the lowest hash of doc_id; a good one has quality and is not toxic.

    Labels with null doc_id or quality are not used, nor are rows of docs without text; a null toxic, or none at all, counts as 0.  The
    lexicon of the statistics is from the same rows.  With ids that repeat, the first rows by hash, id, label and statistics are taken.
    """
    toxic = F.coalesce(F.col("toxic").cast("int") > 0, F.lit(False)) if common.named(labels, "toxic") else F.lit(False)
    chosen = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("quality").cast("int").alias("q"), toxic.alias("toxic")).where("i is not null and q is not null")
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("i"), "i", "q", "toxic").limit(sample))  # the documented bound
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), "text").where("text is not null").join(chosen, "i")
    words = lexicon(rows)
    found = with_statistics(rows, "", words).select("i", ((F.col("q") > 0) & ~F.col("toxic")).cast("int").alias("y"), *NAMES)
    found = found.orderBy(F.xxhash64("i"), "i", "y", *NAMES).limit(sample).toPandas()
    found = found.sort_values(list(found.columns), kind="stable")
    model = fit(found[list(NAMES)].to_numpy(float), found["y"].to_numpy().astype(int), list(NAMES), penalty)
    model.lexicon = words
    return model


def judged(docs: DataFrame, model: Ensemble, threshold: float) -> DataFrame:
    """docs with the columns score and keep, each name after _PREFIX."""
    of = {name: F.col(_PREFIX + name) for name in NAMES}
    value = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0.0)).otherwise(model.score(of))
    rows = with_statistics(docs, _PREFIX, model.lexicon).withColumn(_PREFIX + "score", value)
    return rows.withColumn(_PREFIX + "keep", F.col(_PREFIX + "score") >= threshold)


def score(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, the chance of good quality without toxicity) and keep for each row of docs.

    Null and empty texts have score 0 and are not kept.  Repeated
    rows score alike; null ids are kept.  Columns besides doc_id and text are not looked at.
    """
    rows = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, threshold)
    return rows.select("doc_id", F.col(_PREFIX + "score").alias("score"), F.col(_PREFIX + "keep").alias("keep"))


def keep_good(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score keeps, with the columns of docs."""
    return judged(docs, model, threshold).where(_PREFIX + "keep").select(*map(common.quoted, docs.columns))
