import pytest
from pyspark.sql import functions as F

from ledgerlink import queries
from ledgerlink.plans import blocking, corpus, evaluate, frequency, resolve
from ledgerlink.plans.prepare import prepare_records, unique_keys

COLUMNS = "source string, source_id string, legal_name string, country string, city string, postal_code string, address_lines array<string>, registration_authority string, registered_as string"


def record(name, country=None, ra=None, number=None, city=None, postal=None, lines=(), ident=None):
    return ("test", ident or name, name, country, city, postal, list(lines), ra, number)


@pytest.fixture(scope="module")
def judge(spark):
    def run(*pairs, extra=()):
        rows = [r for k, (a, b) in enumerate(pairs) for r in (a[:1] + (f"{k}l",) + a[2:], b[:1] + (f"{k}r",) + b[2:])] + list(extra)
        base = prepare_records(spark.createDataFrame(rows, COLUMNS))
        keys = spark.createDataFrame([(f"test:{k}l", f"test:{k}r") for k in range(len(pairs))], "left_key string, right_key string")
        return resolve.resolve(blocking.attach(keys, frequency.with_frequencies(base))).orderBy("left_key").collect()

    return run


ADDRESS = {"country": "GB", "city": "London", "postal": "EC1A 1BB", "lines": ("12 Featherstone Street",)}


def test_facts(judge):
    got = judge(
        (record("Acme", ra="ra1", number="00123"), record("Other", ra=" RA1 ", number="123")),
        (record("Acme", ra="RA1", number="123"), record("Acme", ra="RA1", number="124")),
        (record("Target Date 2027 Fund"), record("Target Date 2037 Fund")),
        (record("NB Holdings 7690"), record("NB Holdings")),
        (record("Acme Limited"), record("ACME Ltd.")),
        (record("Phoenix Ltd"), record("Phoenix GmbH")),
    )
    assert [r.hard_signal for r in got] == ["identifier_agreement", "identifier_conflict", "discriminator_conflict", None, "identifying_name_agreement", None]
    assert [r.decision for r in got][:3] == ["match", "no_match", "no_match"] and got[4].decision == "match"


def test_umbrella_number_falls_through(judge):
    extra = [record(f"Fund {k}", ra="RA1", number="77", ident=f"x{k}") for k in "abc"]
    got = judge((record("Alpha Growth", ra="RA1", number="77"), record("Beta Income", ra="RA1", number="77")), extra=extra)
    assert got[0].hard_signal is None


def test_anchored_scores(judge):
    got = judge((record("IBM", country="US"), record("International Business Machines", country="US")), (record("Acme Global Holdings Limited", **ADDRESS), record("Acme Global Holdings GmbH", **ADDRESS)))
    assert got[0].score == pytest.approx(0.3893, abs=2e-4)
    assert got[1].score == pytest.approx(0.9555, abs=2e-4)
    assert got[0].decision == "no_match" and got[1].decision == "review"


def test_missing_evidence_is_neutral(judge):
    r = judge((record("One Two"), record("Three Four")))[0]
    assert (r.country_agreement, r.address_similarity) == (0.5, 0.5)


def test_bands(spark):
    rows = spark.createDataFrame([(0.66,), (0.6599,), (0.9,)], "s double")
    assert [r[0] for r in rows.select(resolve.band(F.col("s"), None, 0.66)).collect()] == ["review", "no_match", "review"]
    assert [r[0] for r in rows.select(resolve.band(F.col("s"), 0.9, 0.66)).collect()] == ["review", "no_match", "match"]


def test_evidence(judge, spark):
    base = prepare_records(spark.createDataFrame([record("Acme Ltd", ident="a"), record("Acme Limited", ident="b")], COLUMNS))
    keys = spark.createDataFrame([("test:a", "test:b")], "left_key string, right_key string")
    r = resolve.evidence(resolve.resolve(blocking.attach(keys, frequency.with_frequencies(base)))).first()
    assert [c.feature for c in r.contributions] == list(resolve.ORDER)
    assert r.score == pytest.approx(sum(c.contribution for c in r.contributions), abs=1e-9)
    assert "acme ltd" in r.signal_detail


def test_oversize_block(spark):
    rows = [record(f"Consolidated Holdings {n} Limited", ident=str(n)) for n in range(206)]
    base = prepare_records(spark.createDataFrame(rows, COLUMNS))
    pos = spark.createDataFrame([("test:1", "test:2")], "left_key string, right_key string")
    r = evaluate.candidate_report(base, pos).first()
    assert (r.recall, r.recall_unbounded, r.dropped_by_ceiling) == (0.0, 1.0, 1)
    assert evaluate.missed_examples(base, pos).first().why == "oversize block"


def test_unique_keys(spark):
    base = prepare_records(spark.createDataFrame([record("A"), record("A")], COLUMNS))
    assert unique_keys(base).count() == 1


def test_confusion_definitions(spark):
    rows = spark.createDataFrame([("match", "match"), ("match", "review"), ("match", "no_match"), (None, "match"), ("no_match", "review"), ("no_match", "no_match")], "label string, decision string")
    r = evaluate.confusion(rows).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.review_positive, r.review_negative) == (1, 1, 1, 1, 1, 1)
    assert (r.precision, r.recall, r.review_rate) == (0.5, 0.3333, 0.3333)
    assert evaluate.confusion(rows.limit(0)).first().precision == 0.0


def test_clusters_and_split(spark):
    rows = [(0, "b", "a", "match"), (1, "c", "b", "match"), (2, "d", "e", "no_match")]
    pairs = spark.createDataFrame(rows, "pos int, left_id string, right_id string, label string")
    assert {r.node: r.cluster for r in corpus.clusters(pairs).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    # c is put over b's root, and so becomes the root of all three
    assert {r.node: r.root for r in corpus.ordered_roots(pairs).collect()} == {"a": "c", "b": "c", "c": "c", "d": "d", "e": "e"}
    split = corpus.split_pairs(pairs)
    assert split.count() == 3 and {r.assigned for r in split.collect()} <= {"holdout", "development", "dropped"}


def test_variants_and_demo(spark):
    rows = [record("Acme Ltd", ident="a", city="Paris"), record("ACMÉ LTD", ident="b", city="Lyon"), record("Ltd Acme", ident="c")]
    base = prepare_records(spark.createDataFrame(rows, COLUMNS))
    keys = spark.createDataFrame([("test:a", "test:b"), ("test:a", "test:c")], "left_key string, right_key string")
    got = blocking.attach(keys, base).select("right_key", corpus.variant_types().alias("v")).collect()
    assert {r.right_key: r.v for r in got} == {"test:b": ["diacritic_or_casing_drift", "address_drift"], "test:c": ["legal_form_variance", "token_order_or_abbreviation"]}
    demo = spark.createDataFrame([(f"{k:02d}", "review", k / 10) for k in range(5)], "pair_id string, decision string, score double")
    assert [r.pair_id for r in corpus.demo_sample(demo, {"review": 2}).collect()] == ["01", "00"]


def test_evidence_and_similarity_of_every_pair(spark, sf_dir):
    decided = {(r.left_key, r.right_key): (r.decision, r.score) for r in queries.decisions(spark, sf_dir).collect()}
    assert {d for d, _ in decided.values()} > {"match"}
    told = queries.decision_evidence(spark, sf_dir).collect()
    assert len(told) == len(decided) and {(r.left_key, r.right_key): (r.decision, r.score) for r in told} == decided
    assert all(r.contributions for r in told)
    alike = queries.token_sort_names(spark, sf_dir).collect()
    assert len(alike) == len(decided) and {(r.left_key, r.right_key) for r in alike} == set(decided)


def test_frequencies_of_some_pairs(spark):
    from ledgerlink.plans import frequency

    records = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "record_key string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "z")], "left_key string, right_key string")
    assert sorted(r.record_key for r in frequency.split_local(pairs, records).collect()) == ["a", "b"]


def test_kill_checks(spark):
    from ledgerlink.plans import corpus

    pairs = spark.createDataFrame([("p1", "a", "b", "match", "why", "r1"), ("p2", "a", "c", "no_match", "", "r1")], "pair_id string, left_key string, right_key string, label string, label_basis string, source_revision string")
    variants = spark.createDataFrame([("legal_form_variance", 3)], "variant string, pairs long")
    report = spark.createDataFrame([(0.9,)], "recall double")
    arms = spark.createDataFrame([("system", 0.99), ("exact", 0.97), ("fuzzy", 0.5)], "method string, precision double")
    got = {r.criterion: r for r in corpus.kill_checks(pairs, variants, report, arms).collect()}
    assert len(got) == 9 and sorted(k for k, r in got.items() if r.holds) == ["candidate recall", "precision over best baseline", "variant legal_form_variance"]
    assert (got["labelled pairs"].measured, got["pairs without provenance"].measured) == (2, 1)
