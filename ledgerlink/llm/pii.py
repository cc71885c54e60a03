"""Personal data: fixed patterns, and candidate spans that boosted trees select.

All work on rows is Spark SQL: no Python runs on executors. Positions come from splitting a text at a
pattern: a match starts where the pieces and matches before it end. High-recall generators propose
spans, which may overlap; each gets format features (digits, groups, separators, checks) and context
features (words before it, neighbouring characters). Gradient-boosted trees, fitted on the driver on a
fixed, seeded set of ``TRAIN`` made-up texts that pass through the same feature expressions, become a
sum of CASE expressions; a threshold per generator, calibrated on ``HOLDOUT`` more made-up texts for
``PRECISION``, decides.
"""

from __future__ import annotations

import json
import math
import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base patterns, written so that each scan is linear. A run of local-part characters, or of
#: digits, is tried once, at its start or where the last match ended; runs never give back characters that
#: the next part of the pattern could not use. Card runs are whole runs of digits and single separators.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP_OK = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
BASE = tuple(PATTERNS)

#: Generators of candidates; spans of different generators may overlap.
GENERATORS = {
    "mailto": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9][A-Za-z0-9-]{0,62}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}+)++",
    "number": r"(?<![0-9A-Za-z+.,/_-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,21}+(?![0-9A-Za-z_])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])",
}
KINDS = (*BASE, *GENERATORS)
#: Shapes of one number, proposed as ``number`` wherever a group of digits begins, so that each number of a
#: run is a candidate however long the run is. Matches are empty (the number is in a lookahead) and may overlap.
_SHAPES = (
    r"\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}",
    r"[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
    r"[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}",
    r"[0-9]{4}(?:[\x20-][0-9]{4}){3}",
    r"0[0-9]{3}\x20[0-9]{6}",
    r"[0-9]{7,22}+",
)
SHAPES = tuple(rf"(?<![0-9A-Za-z+.,/_-])(?=({s})(?![.,-]?[0-9A-Za-z_]))" for s in _SHAPES)
#: Characters before a span that count as its context.
REACH = 40
_CUES = {
    "mail_cue": r"(?i)(e-?mail|mail|write|contact|reach|address)",
    "phone_cue": r"(?i)(phone|tel|call|mobile|cell|fax|dial|whatsapp)",
    "card_cue": r"(?i)(card|visa|master|credit|debit|pay)",
    "id_cue": r"(?i)(iban|account|ssn|social|passport|licen[cs]e|tax|patient|member|id\b)",
    "other_cue": r"(?i)(version|order|page|isbn|issn|total|price|serial|build|section|figure|year|date|part|ticket|invoice|score|sum)",
}
FEATURES = ("length", "digits", "groups", "widest", "letters", "brackets", "dots", "dashes", "spaces", "luhn", "date_like", "even_groups", "repeated", *_CUES)

TRAIN, HOLDOUT, SEED = 1_500, 900, 11
TREES, DEPTH, RATE, LEAST_LEAF = 24, 3, 0.3, 8
PRECISION = 0.98


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits of ``t`` pass the Luhn check."""
    back = F.reverse(_digits(t))
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i)))
    return (F.length(back) > 0) & (total % 10 == 0)


_VALID = {
    "email": lambda t: F.lit(True),
    "ip": lambda t: t.rlike(_IP_OK),
    "card": luhn,
    "phone": lambda t: F.length(_digits(t)).between(8, 15),
}
_SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"


def _spans(text: Column, found: Column, pieces: Column, kind: str, empty: bool = False) -> Column:
    """Spans of matches, from the matches and the pieces between them; or of what stands at ``empty`` matches behind one character."""
    both = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("p"))
    start = F.struct(F.lit(-1 if empty else 0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + F.length(x["p"])
        last = first + F.length(x["m"])
        return F.struct((first if empty else last).alias("at"), F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), first.alias("start"), last.alias("end"), x["m"].alias("found")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(both, start, step, lambda a: a["out"])).otherwise(F.array().cast(_SPAN))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], guards: dict[str, Column]) -> DataFrame:
    """Adds a column of spans for each pattern; a text is scanned only if its guard says it may match."""
    none = F.array().cast("array<string>")
    df = df.withColumns({f"m_{k}": F.when(guards[k], F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    df = df.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split(F.col(text), p, -1)) for k, p in patterns.items()})
    return df.withColumns({f"s_{k}": _spans(F.col(text), F.col(f"m_{k}"), F.col(f"p_{k}"), k) for k in patterns}).drop(*[f"m_{k}" for k in patterns], *[f"p_{k}" for k in patterns])


def _shaped(text: Column, pattern: str) -> Column:
    """Spans of a pattern of empty matches, each before a number: pieces between them end where numbers begin."""
    led = F.concat(F.lit("\n"), text)  # a split drops the empty piece before a match at the very beginning
    return _spans(text, F.regexp_extract_all(led, F.lit(pattern), F.lit(1)), F.split(led, pattern, -1), "number", empty=True)


def _count(t: Column, chars: str) -> Column:
    return F.length(t) - F.length(F.translate(t, chars, ""))


def features(text: Column, span: Column) -> dict[str, Column]:
    """Format and context features of a span, as doubles."""
    t = span["found"]
    groups = F.filter(F.split(t, "[^0-9]+", -1), lambda g: g != "")
    before = F.substring(text, F.greatest(F.lit(1), span["start"] + 1 - REACH), F.least(span["start"], F.lit(REACH)))
    widths = F.transform(groups, F.length)
    out = {
        "length": F.length(t),
        "digits": F.length(_digits(t)),
        "groups": F.size(groups),
        "widest": F.coalesce(F.array_max(widths), F.lit(0)),
        "letters": F.length(F.regexp_replace(t, "[^A-Za-z]", "")),
        "brackets": _count(t, "()[]"),
        "dots": _count(t, "."),
        "dashes": _count(t, "-"),
        "spaces": _count(t, " "),
        "luhn": luhn(t),
        "date_like": t.rlike(r"^(?:[12][0-9]{3}[-. ][01]?[0-9][-. ][0-3]?[0-9]|[0-3]?[0-9][-. ][01]?[0-9][-. ][12][0-9]{3})$"),
        "even_groups": (F.size(groups) > 1) & (F.size(F.array_distinct(widths)) == 1),
        "repeated": F.size(F.array_distinct(F.split(_digits(t), ""))) <= 3,
    }
    out |= {name: before.rlike(p) for name, p in _CUES.items()}
    return {k: v.cast("double") for k, v in out.items()}


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``cands``: for each proposed span kind, start, end, found and its features."""
    t = F.col(text)
    digit = t.rlike("[0-9](?:[ ().-]{0,2}[0-9]){6}")
    guards = {"mailto": t.contains("@") | t.rlike("[(\\[]at[)\\]]| at [A-Za-z0-9-]+(?: dot |\\.)"), "number": digit, "account": t.rlike("[A-Z]{2}[0-9]{2}")}
    df = with_matches(df, text, GENERATORS, guards)
    # a number that stands alone is proposed by both, and counts once
    df = df.withColumn("s_shaped", F.when(digit, F.array_distinct(F.concat(*[_shaped(t, p) for p in SHAPES]))).otherwise(F.array().cast(_SPAN)))
    every = F.concat(*[F.array_sort(F.array_union(f"s_{k}", "s_shaped")) if k == "number" else F.col(f"s_{k}") for k in GENERATORS])
    return df.withColumn("raw", every).withColumn("cands", F.transform("raw", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), *[v.alias(k) for k, v in features(t, s).items()]))).drop("raw", "s_shaped", *[f"s_{k}" for k in GENERATORS])


# ---- fitting: a fixed, made-up set; nothing of the corpus is read ----


def made_up(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): a string of personal data (1) or a look-alike (0) among filler words."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = rng.choice("3456") + d(14)
        total = sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, body)))
        full = body + str(-total % 10)
        sep = rng.choice(["", " ", "-"])
        return sep.join(full[k : k + 4] for k in range(0, 16, 4))

    good = [
        (lambda: f"{word()}.{word()} at {word()} dot {rng.choice(['com', 'org', 'net', 'de'])}", ["", "email: ", "write to ", "contact "]),
        (lambda: f"{word()}{rng.choice(['(at)', ' [at] ', ' (at) '])}{word()}{rng.choice(['.', '(dot)', ' [dot] '])}com", ["", "mail ", "reach me: "]),
        (lambda: f"({d(3)}) {d(3)}-{d(4)}", ["", "tel ", "call ", "phone: "]),
        (lambda: f"{d(3)}{rng.choice('-. ')}{d(3)}{rng.choice('-. ')}{d(4)}", ["call ", "phone: ", "mobile ", "fax ", ""]),
        (lambda: f"0{d(3)} {d(6)}", ["tel. ", "phone ", "call "]),
        (card, ["", "card ", "visa: ", "pay with "]),
        (lambda: d(16), ["card number ", "credit card: "]),
        (lambda: f"{d(3)}-{d(2)}-{d(4)}", ["ssn ", "social security ", "id "]),
        (lambda: d(9), ["passport ", "ssn: ", "account "]),
        (lambda: rng.choice(["DE", "FR", "GB", "ES"]) + d(2) + " " + " ".join(d(4) for _ in range(rng.randint(3, 5))), ["", "iban ", "account "]),
    ]
    bad = [
        (lambda: f"{word()} at {word()}.{word()}", ["", "stay ", "we met ", "look "]),
        (lambda: f"{word()} at {word()} dot {word()}", ["the ", "a "]),
        (lambda: d(16), ["", "order ", "serial ", "the sum "]),
        (lambda: d(rng.randint(7, 15)), ["", "order ", "build ", "total ", "page "]),
        (lambda: f"20{d(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", ["", "date ", "year ", "on "]),
        (lambda: f"1{rng.randint(0, 9)}.0{rng.randint(1, 9)}.19{d(2)}", ["", "date ", "call date "]),
        (lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", ["isbn ", "", "see "]),
        (lambda: f"{d(1)}.{d(2)}.{d(3)}.{d(2)}", ["version ", "build ", "section "]),
        (lambda: " ".join(d(rng.randint(1, 3)) for _ in range(rng.randint(5, 8))), ["", "score ", "figure "]),
        (lambda: rng.choice("0123456789") * rng.randint(8, 16), ["", "tel ", "id "]),
        (lambda: rng.choice(["AB", "QX"]) + d(2) + " " + " ".join("".join(rng.choice("ABCDEFGHJK") for _ in range(4)) for _ in range(4)), ["part ", "serial ", "ticket "]),
    ]
    out = []
    for k in range(n):
        make, cues = rng.choice(good if k % 2 else bad)
        head = " ".join(word() for _ in range(rng.randint(0, 12)))
        head = (head + rng.choice([" ", ". ", ", "]) if head else "") + rng.choice(cues)
        core = make()
        out.append((head + core + rng.choice([" ", ". ", ", ", "\n"]) + word(), len(head), len(head) + len(core), k % 2))
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, left, right) or a leaf's value."""
    value = float(g[rows].sum() / (h[rows].sum() + 1.0))
    if not depth or len(rows) < 2 * LEAST_LEAF:
        return value
    best, split = 1e-6, None
    base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    for f in range(x.shape[1]):
        col = x[rows, f]
        for cut in np.unique(col)[:-1]:
            left = col <= cut
            n = int(left.sum())
            if n < LEAST_LEAF or len(rows) - n < LEAST_LEAF:
                continue
            gl, hl = g[rows][left].sum(), h[rows][left].sum()
            gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
            gain = gl * gl / (hl + 1.0) + gr * gr / (hr + 1.0) - base
            if gain > best:
                best, split = gain, (f, float(cut), left)
    if split is None:
        return value
    f, cut, left = split
    return f, cut, _grow(x, g, h, rows[left], depth - 1), _grow(x, g, h, rows[~left], depth - 1)


def _leaf(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(x: np.ndarray, y: np.ndarray) -> list:
    """Trees of logistic loss; the first is a constant."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    trees: list = [math.log(p / (1 - p))]
    score = np.full(len(y), trees[0])
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - q, q * (1 - q), np.arange(len(y)), DEPTH)
        trees.append(tree)
        score = score + RATE * np.array([_leaf(tree, r) for r in x])
    return trees


def margin(trees: list, row: np.ndarray) -> float:
    return trees[0] + RATE * sum(_leaf(t, row) for t in trees[1:])


def as_column(trees: list, c: Column) -> Column:
    """The trees as one expression over the features of a candidate."""

    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, cut, left, right = tree
        return F.when(c[FEATURES[f]] <= cut, one(left)).otherwise(one(right))

    return reduce(lambda a, b: a + b, [one(t) * RATE for t in trees[1:]], F.lit(float(trees[0])))


_FITTED: dict[str, tuple[list, dict[str, float]]] = {}


def fitted(spark: SparkSession) -> tuple[list, dict[str, float]]:
    """Trees and each generator's least margin; fitted once in a process, alike every time."""
    if "model" not in _FITTED:
        rows = [(k, *r) for k, r in enumerate(made_up(TRAIN + HOLDOUT, SEED))]
        data = json.dumps([{"n": k, "text": t, "a": a, "b": b, "y": y} for k, t, a, b, y in rows])
        made = spark.range(1).select(F.explode(F.from_json(F.lit(data), "array<struct<n:int,text:string,a:int,b:int,y:int>>")).alias("r")).select("r.*")
        got = candidates(made).select("n", "a", "b", "y", F.explode("cands").alias("c")).collect()  # bounded by TRAIN + HOLDOUT
        x = np.array([[r.c[f] for f in FEATURES] for r in got])
        # a span is personal data if it covers most of a planted string that is
        y = np.array([float(r.y and min(r.c.end, r.b) - max(r.c.start, r.a) >= 0.8 * (r.b - r.a)) for r in got])
        n = np.array([r.n for r in got])
        trees = boost(x[n < TRAIN], y[n < TRAIN])
        held = [(r.c.kind, margin(trees, v), t) for r, v, t in zip(got, x, y, strict=True) if r.n >= TRAIN]
        least = {}
        for kind in GENERATORS:
            own = sorted(((m, t) for k, m, t in held if k == kind), reverse=True)
            least[kind] = math.inf
            for m in sorted({m for m, _ in own}, reverse=True):
                above = [t for s, t in own if s >= m]
                # at least PRECISION by the estimate that adds half a miss
                if sum(above) >= PRECISION * (len(above) + 0.5):
                    least[kind] = m
            least[kind] = max(least[kind], 0.0)
        _FITTED["model"] = trees, least
    return _FITTED["model"]


def find(df: DataFrame, text: str, base_col: str = "base", added_col: str = "added") -> DataFrame:
    """Adds the base spans and the spans that the trees add, each an array of (kind, start, end)."""
    trees, least = fitted(df.sparkSession)
    t = F.col(text)
    guards = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": t.rlike(r"\+[0-9]")}
    df = with_matches(df, text, PATTERNS, guards)
    keep = lambda k: F.filter(F.col(f"s_{k}"), lambda s: _VALID[k](s["found"]))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    df = df.withColumn(base_col, bare(F.concat(*[keep(k) for k in BASE]))).drop(*[f"s_{k}" for k in BASE])
    df = candidates(df, text)
    bar = lambda c: reduce(lambda a, k: F.when(c["kind"] == k, F.lit(least[k])).otherwise(a), GENERATORS, F.lit(math.inf))
    chosen = F.filter("cands", lambda c: as_column(trees, c) >= bar(c))
    new = F.filter(chosen, lambda c: ~F.exists(F.col(base_col), lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    return df.withColumn(added_col, bare(new)).drop("cands")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans in each row's whole text; one row out for each row in, no shuffle, no Python on executors.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (``kind:start:end`` by kind, then
    start; code points, end exclusive), n_added. Null and empty texts have none; null ids and repeated
    rows stay; other columns are not read.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = find(plain, "text")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``[KIND]``, overlapping spans by the first's.

    Null texts stay null; all other columns stay as they are.
    """
    columns = docs.columns
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row_"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_"))
    found = find(wrapped, "text_")
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        hidden = s["start"] < a["at"]
        gap = F.substring(F.col("text_"), a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(hidden, a["out"]).otherwise(F.concat(a["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).alias("out"))

    done = F.aggregate("spans_", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text_"), a["at"] + 1, F.length("text_"))))
    text = F.when(F.col(f"row_.`{text_col}`").isNotNull(), F.when(F.size("spans_") > 0, done).otherwise(F.col("text_")))
    return found.withColumn("spans_", order).select(*[text.alias(c) if c == text_col else F.col(f"row_.`{c}`").alias(c) for c in columns])
