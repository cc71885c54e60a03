"""Quality rules whose cutoffs carry an exact bound on false rejection.

A rule is a text statistic with a fixed grid of cutoffs, named before any label is seen. ``STEPS`` runs
over all pairs of a rule and a cutoff, from the loosest to the strictest; after a step a document is
rejected if it fails any cutoff so far. For each stratum the labelled good documents that pass the base
rule are a holdout: the false rejections after a step, by all rules together, are binomial, and the
Clopper-Pearson upper bound at confidence ``1 - delta'`` must stay within ``alpha``. Testing stops at the
first failure (fixed-sequence testing needs no correction for the number of steps, so ``alpha`` is spent
once); ``delta' = delta / strata`` is Bonferroni's correction across strata. A step that catches no more
labelled bad documents than the looser cutoffs of its rule is left out: this looks at bad documents only,
so the good ones still meet a sequence that does not depend on them. So with probability ``1 - delta`` no
stratum loses more than ``alpha`` of its good documents. Among the certified steps the one with the best
balance of bad documents caught and good ones lost is used. ``least_good`` is the smallest holdout that
can certify anything; a stratum with fewer labelled good documents is not judged beyond the base rule.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import map_rows, slim
from ledgerlink.runtime import materialise

#: Symbols counted by the base features.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\r\x0b\x0c"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Cutoffs run from the loosest to the strictest; a document fails above the cutoff.
RULES: dict[str, list[float]] = {
    "symbol_share": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_share": [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "echo_share": [0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05],
    "upper_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "bang_share": [2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1],
}
#: Pairs of a rule and the place of its cutoff, by how far along its grid the cutoff is.
STEPS = sorted(((r, j) for r, grid in RULES.items() for j in range(len(grid))), key=lambda x: ((x[1] + 1) / len(RULES[x[0]]), list(RULES).index(x[0])))
ALPHA = 0.03
DELTA = 0.05
_SCHEMA = (
    "doc_id long, stratum string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + ", ".join(f"{r} double" for r in RULES)
)


def statistics(text: str | None) -> tuple:
    """Base counts and rule statistics of one whole text; null counts as a text without words."""
    text = text or ""
    words = _WORDS.findall(text)
    n = len(words)
    word_chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = 0
    if n >= 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            first: dict[tuple, int] = {}
            covered = bytearray(n)
            for i, g in enumerate(grams):
                j = first.setdefault(g, i)
                if j != i:
                    covered[i : i + 3] = b"\1\1\1"
                    covered[j : j + 3] = b"\1\1\1"
            repeats = covered.count(1)
    d = max(n, 1)
    echo = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    upper = sum(map(str.isupper, words))
    return (n, word_chars, symbols, dup, repeats, symbols / d, repeats / d, dup / max(lines, 1), echo / d, upper / d, text.count("!") / d)


def _make():
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES]

    def work(ids: list, texts: list, strata: list, keys: list) -> dict:
        rows = list(zip(*map(statistics, texts), strict=True)) or [()] * len(names)
        return {"doc_id": ids, "stratum": strata, "text_key": keys} | dict(zip(names, rows, strict=True))

    return work


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k), X ~ Binomial(n, p)."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1)
    lg = np.array([math.lgamma(x) for x in range(1, k + 2)])
    lr = np.array([math.lgamma(n - x + 1) for x in range(k + 1)])
    terms = math.lgamma(n + 1) - lg - lr + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(top + math.log(np.exp(terms - top).sum()))


def upper_bound_within(k: int, n: int, delta: float, alpha: float) -> bool:
    """True if the exact (Clopper-Pearson) upper bound of the rate, at confidence 1 - delta, is at most alpha.

    The bound solves P(X <= k; p) = delta and the left side falls with p, so it suffices to look at
    p = alpha. ``n == 0`` certifies nothing. A count above its expectation at alpha never passes, which
    also keeps the sum short.
    """
    if n <= 0 or k >= alpha * n:
        return False
    return log_binomial_cdf(k, n, alpha) <= math.log(delta)


def least_good(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Labelled good documents without a false rejection that a stratum needs for a certificate."""
    return math.ceil(math.log(delta / max(strata, 1)) / math.log1p(-alpha))


def choose(good: int, good_hits: list[int], bad_hits: list[int], cutoffs: list[float], delta: float, alpha: float) -> float | None:
    """The cutoff to use, or None if none is certified or none helps."""
    best, at = 0.0, None
    for cutoff, g, b in zip(cutoffs, good_hits, bad_hits, strict=True):
        if not upper_bound_within(g, good, delta, alpha):
            break
        if b - 20 * g > best:
            best, at = b - 20 * g, cutoff
    return at


def first_steps(bad_hits: dict[str, list[int]]) -> dict[str, list[int | None]]:
    """For each rule, by the number of its cutoffs that a document passes, the first step to reject it.

    Steps that catch no bad document beyond the looser cutoffs of their rule are left out.
    """
    at = {step: k for k, step in enumerate(STEPS)}
    out: dict[str, list[int | None]] = {}
    for rule, hits in bad_hits.items():
        first: list[int | None] = [None]
        for j in range(len(hits) - 1, -1, -1):
            first.append(at[rule, j] if hits[j] > (hits[j - 1] if j else 0) else first[-1])
        out[rule] = first[::-1]
    return out


def cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum with its good labels and a column for each rule: the certified cutoff, or null.

    Counts are two partial aggregations, of bad documents by cutoff and of all by the first step that
    rejects them; only a row for each stratum reaches the choice, which runs on executors.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # the bound takes independent trials: copies of a text are one, good only if all are
    trials = features.where(~base_failed()).join(marks, "doc_id").groupBy("stratum", "text_key").agg((F.min("quality") == 1).alias("is_good"), *[F.first(r).alias(r) for r in RULES])
    known = materialise(trials.drop("text_key"), "quality-known")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    bad = known.groupBy("stratum").agg(*[F.array(*[count(~F.col("is_good") & (F.col(rule) > c)) for c in grid]).alias(f"b_{rule}") for rule, grid in RULES.items()])

    def make_order():
        def work(strata: list, *hits: list) -> dict:
            rows = [first_steps(dict(zip(RULES, row, strict=True))) for row in zip(*hits, strict=True)]
            return {"stratum": strata} | {f"first_{r}": [x[r] for x in rows] for r in RULES}

        return work

    order = materialise(map_rows(bad, "stratum string, " + ", ".join(f"first_{r} array<int>" for r in RULES), make_order), "quality-order")
    passed = lambda rule: sum((F.col(rule) <= c).cast("int") for c in RULES[rule])
    step = F.least(*[F.element_at(f"first_{rule}", passed(rule) + 1) for rule in RULES])
    hit = known.join(order, "stratum").select("stratum", "is_good", step.alias("step"))
    hits = lambda mark: F.array(*[count(mark & (F.col("step") <= k)) for k in range(len(STEPS))])
    counts = hit.groupBy("stratum").agg(count(F.col("is_good")).alias("good"), hits(F.col("is_good")).alias("g"), hits(~F.col("is_good")).alias("b"))
    rows = counts.join(order, "stratum").select("stratum", "good", "g", "b", *[f"first_{r}" for r in RULES])
    strata = order.agg(F.count(F.lit(1)).alias("strata"))
    schema = "stratum string, good long, " + ", ".join(f"cut_{r} double" for r in RULES)

    def make():
        def work(strata: list, good: list, g: list, b: list, *rest: list) -> dict:
            out: dict = {"stratum": strata, "good": good} | {f"cut_{r}": [] for r in RULES}
            *firsts, totals = rest
            for n, gs, bs, first, s in zip(good, g, b, zip(*firsts, strict=True), totals, strict=True):
                last = choose(n, gs, bs, list(range(len(STEPS))), delta / s, alpha)
                for rule, own in zip(RULES, first, strict=True):
                    done = [STEPS[k][1] for k in own if k is not None and last is not None and k <= last]
                    out[f"cut_{rule}"].append(RULES[rule][max(done)] if done else None)
            return out

        return work

    # one row joined to a row for each stratum: a broadcast of a single number
    return map_rows(rows.join(F.broadcast(strata), F.lit(True)), schema, make)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Verdict on each row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    stratum, failed_rules (comma-joined names). Rows map one to one: repeated rows stay repeated, a null
    id stays (it meets no label), null and empty texts have no words and fail the base rule, a null
    stratum is the stratum ``''``. Several labels of one id: good only if all are. No labels, or too few
    for a certificate: the method rejects nothing. Other columns are not read.
    """
    stratum = F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("")) if stratum_col else F.lit("")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), stratum.alias("stratum")).withColumn("text_key", F.xxhash64("text"))
    features = materialise(map_rows(plain, _SCHEMA, _make), "quality-features")
    cuts = materialise(cutoffs(features, slim(labels, doc_id="doc_id", quality="quality"), alpha, delta), "quality-cutoffs").drop("good")
    fails = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    return (
        features.join(cuts, "stratum", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("failed", fails)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "stratum", F.array_join("failed", ",").alias("failed_rules"),
        )
    )
