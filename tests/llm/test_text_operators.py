import hashlib
import math
import re
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlink.llm import bpe, quality_rules, secret_scan, toxicity, words

TEXT = "doc_id long, text string, lang string, source string, n_chars long"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = st.lists(st.sampled_from(list("aabcdeéßΣσİı 'sStTré0123½²漢字ﬁ😀́ 　\n\t\x1c\x85_-!?…“”") + ["<|endoftext|>"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def coders():
    return {p: (Tokenizer.from_file(p), words.Coder(p)) for p in (WORD, BYTE)} | {"bpe": bpe.WordBpe(WORD)}


@settings(max_examples=150, deadline=None)
@given(text=ODD)
def test_encoders_equal_the_library(coders, text):
    for path in (WORD, BYTE):
        library, own = coders[path]
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == ids
        if path == WORD:
            coded = coders["bpe"].encode_bytes([text])[0]
            assert np.frombuffer(coded, "<u4").tolist() == ids
            assert coders["bpe"].decode(coded) == library.decode(ids, skip_special_tokens=False)


def test_runs_and_long_words(coders):
    for text in ("a" * 3000, "ab" * 2000, "!" * 999, "no" * 500, "x" * 7 + "'s", " " * 50 + "y"):
        assert np.frombuffer(coders["bpe"].encode_bytes([text])[0], "<u4").tolist() == coders[WORD][0].encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark):
    rows = [(1, "Hello World", "en"), (None, None, "x"), (2, "", None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_decode(docs, WORD).collect()
    assert len(got) == 4 and sorted(r.n_tokens for r in got) == [0, 0, 0, 2]
    empty = [r for r in got if r.doc_id == 2]
    assert all(r.ids_sha256 == hashlib.sha256(b"").hexdigest() and r.decoded == "" for r in empty)
    assert bpe.encode_decode(docs.limit(0), WORD).count() == 0


def test_base_statistics():
    text = "one two three\none two three\n\n# $x\none two three"
    n, chars, symbols, dup, repeat, *_ = quality_rules.statistics(text)
    assert (n, chars, symbols, dup, repeat) == (11, 3 * 11 + 3, 2, 2, 9)
    assert quality_rules.statistics(None)[:5] == (0, 0, 0, 0, 0)


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab \n# \x1c")), max_size=60))
def test_base_statistics_by_force(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    covered = {i for k, g in enumerate(grams) if grams.count(g) > 1 for i in range(k, k + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    assert quality_rules.statistics(text)[:5] == (len(found), sum(map(len, found)), text.count("#"), dup, len(covered))


def test_binomial_bound():
    # by the sum itself
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.2), (10, 400, 0.05)):
        direct = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.exp(quality_rules.log_binomial_cdf(k, n, p)) == pytest.approx(direct)
    assert not quality_rules.upper_bound_within(0, 0, 0.05, 0.1)
    assert not quality_rules.upper_bound_within(0, 28, 0.05, 0.1) and quality_rules.upper_bound_within(0, 29, 0.05, 0.1)
    assert quality_rules.choose(1000, [0, 0, 200], [5, 9, 900], [3, 2, 1], 0.01, 0.05) == 2
    assert quality_rules.choose(5, [0], [5], [1], 0.01, 0.05) is None


def test_quality_rows(spark):
    clean = " ".join(f"word{k}" for k in range(60))
    noisy = " ".join(f"word{k}%%%" for k in range(60))
    rows = [(k, f"{clean} x{k}", "en", "s", 1) for k in range(2000)] + [(k, f"{noisy} x{k}", "en", "s", 1) for k in range(2000, 2200)] + [(9000, None, None, "s", None), (9001, "", "en", "s", 0), (None, clean, "xx", None, None)]
    docs = spark.createDataFrame(rows, TEXT)
    labels = spark.createDataFrame([(k, int(k < 2000), 0) for k in range(2150)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert all(got[k].kept for k in range(2000)) and not any(got[k].kept for k in range(2000, 2200))
    assert got[2190].failed_rules == "symbol_share"
    assert got[9000].base_failed and got[9001].base_failed and got[None].kept
    # without labels nothing is certified
    free = quality_rules.quality_rules(docs, labels.limit(0)).where("kept").count()
    assert free == 2201


def test_quality_alpha_is_spent_once(spark):
    """150 good documents of a language suffice at three strata; 100 do not. A rule without bad hits blocks nothing."""
    clean, noisy = (" ".join(f"word{k}{mark}" for k in range(60)) for mark in ("", "%%%"))
    loud = clean + " !" * 20  # good, but the loosest bang cutoffs that it fails catch no bad document
    rows = [(k, f"{loud if k < 30 else clean} x{k}", "de") for k in range(150)] + [(k, f"{clean} x{k}", "fr") for k in range(200, 300)] + [(k, f"{clean} x{k}", "en") for k in range(400, 600)]
    bad = [(1000 + k, f"{noisy} x{k}", lang) for k, lang in enumerate(("de", "fr", "en") * 10)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k, *_ in rows] + [(k, 0) for k, *_ in bad], "doc_id long, quality int")
    assert quality_rules.least_good(3) == 135 and quality_rules.least_good(4) == 144
    assert quality_rules.upper_bound_within(0, 144, 0.05 / 4, 0.03) and not quality_rules.upper_bound_within(0, 143, 0.05 / 4, 0.03)
    got = quality_rules.quality_rules(docs, labels).where("not kept").collect()
    assert {r.doc_id for r in got} == {k for k, _, lang in bad if lang != "fr"} and {r.failed_rules for r in got} == {"symbol_share"}


def test_quality_steps_by_force():
    rng = np.random.default_rng(2)
    hits = {r: np.sort(rng.integers(0, 6, len(grid))).tolist() for r, grid in quality_rules.RULES.items()}
    first = quality_rules.first_steps(hits)
    for rule, grid in quality_rules.RULES.items():
        useful = [j for j in range(len(grid)) if hits[rule][j] > max(hits[rule][:j], default=0)]
        for passed in range(len(grid) + 1):
            want = [k for k, (r, j) in enumerate(quality_rules.STEPS) if r == rule and j >= passed and j in useful]
            assert first[rule][passed] == min(want, default=None)


def test_secrets(spark):
    key = "AKIA" + "ABCD1234EFGH5678"
    text = f'ü password = "hunter2hunter2" token: short1 {key} {"0a" * 16} api_key=abcdefgh'
    rows = spark.createDataFrame([(1, text), (2, None), (None, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.secret_scan(rows).collect()}
    r = got[1]
    assert (r.n_assign, r.n_access, r.n_hex) == (2, 1, 1)
    base = [s for s in r.spans.split(",") if not s.startswith("novel")]
    assert base[0].startswith("assign:2:") and hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert got[2].spans == "" and got[None].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_novelty_tells_random_from_known():
    novelty = secret_scan.Novelty()
    rng = np.random.default_rng(0)
    random_ = "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789"), 40))
    assert novelty("key = ", random_, "") >= secret_scan.NOVEL > novelty("key = ", "authorization bearer signature certificate", "")
    assert novelty(f"{random_} and again key = ", random_, "") < 0.3
    spans = secret_scan.novel_spans(f"secret: {random_} end", novelty)
    assert spans == [("novel", 8, 48)]
    assert secret_scan.novel_spans("the key points are: readability_and_maintainability1", novelty) == []


def test_candidates_stand_behind_long_words_and_many_separators():
    novelty, rng = secret_scan.Novelty(), np.random.default_rng(8)
    key = "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"), 40))
    for lead in ("secret_for_production_database_of_all_regions: ", "token            =            ", "my-key-is secret="):
        assert secret_scan.novel_spans(lead + key + " end", novelty) == [("novel", len(lead), len(lead) + 40)]
    assert secret_scan.novel_spans("nothing: " + key, novelty) == []
    # a scan of long runs is linear
    for text in ("key" * 40_000, "a-" * 60_000, "=" * 100_000):
        assert secret_scan.novel_spans(text, novelty) == []


def test_secret_scan_edges(spark):
    rows = [(None, "password = abcdefgh1"), (1, None), (1, None), (2, ""), (3, "x " * 60_000 + "AKIA" + "A1" * 10)]
    docs = spark.createDataFrame([(*r, "n", "m") for r in rows], "doc_id long, text string, spans string, N_ASSIGN string")
    got = [(r.doc_id, r.n_assign, r.n_access, r.spans) for r in secret_scan.secret_scan(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 0, "assign:0:20"), (1, 0, 0, ""), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 1, "access:120000:120024")], key=str)
    assert secret_scan.secret_scan(docs.limit(0)).count() == 0


def test_novelty_decides_on_letters_alone_and_on_long_candidates():
    novelty = secret_scan.Novelty()
    rng = np.random.default_rng(5)
    letters = "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz"), 340))
    for key in (letters[:16], letters[:40], letters[:300], letters[:300] + "0123456789" * 2):
        assert secret_scan.novel_spans(f"auth = {key} end", novelty) == [("novel", 7, 7 + len(key))]
    assert secret_scan.novel_spans("the key points are: authorization_credential_placeholder", novelty) == []


def test_toxicity_search_is_exact():
    rng = np.random.default_rng(3)
    vocabulary = [f"t{k}" for k in range(40)]
    vectors = []
    for _ in range(300):
        at = rng.choice(40, rng.integers(1, 8), replace=False)
        w = rng.random(len(at))
        vectors.append(dict(zip(at.tolist(), (w / np.linalg.norm(w)).tolist(), strict=True)))
    index = toxicity.Index(vocabulary, np.ones(40), vectors, rng.integers(0, 2, 300), list(range(300)), (0.9, 0.1))
    for _ in range(50):
        at = np.sort(rng.choice(40, 5, replace=False))
        w = rng.random(5)
        w /= np.linalg.norm(w)
        scores = sorted(((sum(x * vectors[i].get(t, 0.0) for t, x in zip(at.tolist(), w.tolist(), strict=True)), i) for i in range(300)), reverse=True)
        near = index.nearest(at, w, 10)
        assert [round(c, 9) for c, _ in near] == [round(c, 9) for c, _ in scores[: len(near)]]


@settings(max_examples=150, deadline=None)
@given(text=ODD)
def test_toxicity_words_and_counts(text):
    assert [w.decode() for w in toxicity.words(text)] == toxicity._TERM.findall(text.lower())
    vocabulary = ["a", "é", "ß", "ab", "bcde", "^aab", "^ééß", "^漢字abc", "_", "0123"]
    index = toxicity.Index(vocabulary, np.ones(10), [{0: 1.0}], np.array([1]), [1], (0.5, 0.5))
    assert {vocabulary[k]: n for k, n in index.counts(text).items()} == {t: n for t, n in toxicity.terms(text).items() if t in vocabulary}


def test_toxicity_words_of_many_symbols():
    text = " ".join(f"w{chr(c)}é{k}" for k, c in enumerate(range(0x2190, 0x2BFF)))
    steps = []
    sys.setprofile(lambda _frame, event, _arg: steps.append(event))
    try:
        got = toxicity.words(text)
    finally:
        sys.setprofile(None)
    assert [w.decode() for w in got] == toxicity._TERM.findall(text.lower()) and len(steps) < 100


def test_toxicity_search_takes_few_steps():
    """Blocks are scored many at a time, with ties and an example left out; words that can't hold a term are not looked up."""
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(2500):
        w = np.round(rng.random(4), 1) + 0.1
        vectors.append(dict(zip(rng.choice(12, 4, replace=False).tolist(), (w / np.linalg.norm(w)).tolist(), strict=True)))
    vectors += vectors[:100] * 3
    index = toxicity.Index([f"t{k}" for k in range(12)], np.ones(12), vectors, rng.integers(0, 2, 2800), list(range(2800)), (0.9, 0.1))
    dense = np.zeros((2800, 12))
    for place, i in enumerate(index.ids):
        dense[place, list(vectors[i])] = list(vectors[i].values())
    steps = []
    for place in range(0, 2800, 70):
        at = np.flatnonzero(dense[place])
        w = dense[place][at]
        sys.setprofile(lambda _frame, event, _arg: steps.append(event))
        try:
            near = index.nearest(at, w, 15, without=place)
        finally:
            sys.setprofile(None)
        scores = dense[:, at] @ w
        scores[place] = 0
        assert [round(c, 9) for c, _ in near] == np.round(np.sort(scores)[::-1][:15], 9).tolist()
        assert all(abs(scores[p] - c) < 1e-12 for c, p in near) and place not in {p for _, p in near} and near == sorted(near, key=lambda s: (-s[0], s[1]))
    assert index.blocks == 44 and len(steps) / 40 < 150
    assert index.counts(" ".join(f"word{k} t{k}" for k in range(1000))) == {k: 1 for k in range(12)} and not any(w.startswith(b"word") for w in index._seen)


def test_toxicity_rows(spark):
    rng = np.random.default_rng(1)
    filler = lambda: " ".join(rng.choice([f"word{k}" for k in range(200)], 30))
    rows = [(k, filler() + (" you grumbly fool" if k % 4 == 0 else ""), "en", "s", 1) for k in range(600)] + [(None, None, None, None, None), (700, "", "en", "s", 0), (701, "grumblier foolish", "en", "s", 0)]
    docs = spark.createDataFrame(rows, TEXT)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [k for k in range(600) if got[k].held_out]
    assert 60 < len(held) < 180
    assert sum(got[k].predicted == int(k % 4 == 0) for k in held) / len(held) > 0.95
    assert got[None].predicted == 0 and got[700].evidence == [] and not got[None].held_out
    assert got[701].predicted == 1  # beginnings of words meet
    assert {r.score for r in toxicity.toxicity(docs.limit(3), labels.limit(0)).collect()} == {0.0}
