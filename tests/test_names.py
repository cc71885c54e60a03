import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerlink import queries
from ledgerlink.functions import names as N
from ledgerlink.functions import similarity as S


@pytest.fixture(scope="module")
def normalised(spark):
    def run(*names):
        rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
        return [r.v for r in rows.select("k", N.normalize_name(F.col("n")).alias("v")).orderBy("k").collect()]

    return run


def test_normalisation(normalised):
    cases = {
        "Acme Co. Ltd.": "acme ltd",
        "ACME Company Limited": "acme ltd",
        "Smith & Nephew PLC": "smith and nephew plc",
        "Spolka z ograniczona odpowiedzialnoscia X": "spzoo x",
        "Foo Gesellschaft mit beschraenkter Haftung": "foo gmbh",
        "company limited liability company": "ltd liability company",
        "Murowana Goślina": "murowana goslina",
        "SPÓŁKA KOMANDYTOWA": "społka komandytowa",
        "Gladiator P/L": "gladiator p l",
        "Fund L.P.": "fund lp",
        "a b\u0085c": "a b c",
        "ﬁrst Ｃｏ": "first co",
        "  ": "",
    }
    assert dict(zip(cases, normalised(*cases), strict=True)) == cases


def test_derived_names(spark):
    rows = spark.createDataFrame([("international business machines corp",), ("gmbh ltd",), ("",), ("fund iv 12 a",)], "n string")
    got = rows.select(N.strip_legal_form(F.col("n")), N.acronym(F.col("n")), N.legal_forms_of(F.col("n")), N.prefix_key(F.col("n")), N.longest_token(F.col("n")), F.filter(N.tokens(F.col("n")), N.is_discriminator)).collect()
    assert [tuple(r) for r in got] == [
        ("international business machines", "ibm", ["corp"], "busi", "international", []),
        ("gmbh ltd", "gl", ["gmbh", "ltd"], "gmbh", "gmbh", []),
        ("", "", [], None, None, []),
        ("fund iv 12 a", "fi1a", [], "fund", "fund", ["iv", "12", "a"]),
    ]


def test_identifiers_and_ids(spark):
    rows = spark.createDataFrame([("00-44 5790b",), ("--",), (None,)], "v string")
    assert [r[0] for r in rows.select(N.normalize_identifier(F.col("v"))).collect()] == ["00445790B", None, None]
    a, b = (spark.range(1).select(N.pair_id(F.lit(x), F.lit(y), F.lit("match"))).first()[0] for x, y in (("p", "q"), ("q", "p")))
    assert a == b and len(a) == 16


def test_drift_predicates(spark):
    rows = spark.createDataFrame([("Acme Ltd", "Acme GmbH"), ("Größe", "GRÖSSE"), ("Straße", "STRASSE"), ("Café", "CAFE"), ("A", "A")], "l string, r string")
    n = lambda c: N.normalize_name(F.col(c))
    got = rows.select(N.differs_only_by_legal_form(n("l"), n("r")), N.differs_only_by_diacritics_or_case(F.col("l"), F.col("r"), n("l"), n("r"))).collect()
    # the sharp s is folded by case, not by normalisation, so both conditions never hold for it
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False), (False, True), (False, False)]


def test_similarities():
    assert S.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert S.jaro_winkler_of("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert S.jaro_winkler_of("", "") == 0.0 and S.jaro_winkler_of("ab", "xy") == 0.0

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for a, b in [("abcbdab", "bdcaba"), ("", "x"), ("aaaa", "aa"), ("straße 12", "12 strasse")]:
        assert S.common_subsequence(a, b) == slow(a, b)
    assert unicodedata.normalize("NFKD", "é")[0] == "e"


def test_text_names_read_whole_texts(spark, tmp_path):
    def by_force(text):
        """name_norm, core, acr and keys of a text, token by token."""
        folded = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("&", " and ")
        parts = "".join(" " if c in " \n,;:/\\|+-_" else c for c in folded if c not in ".\"'`()[]{}*#").split()
        norm = []
        while parts:
            wide = next(k for k in range(min(5, len(parts)), 0, -1) if k == 1 or " ".join(parts[:k]) in N.LEGAL_FORMS)
            norm.append(N.LEGAL_FORMS.get(" ".join(parts[:wide]), parts[0]))
            parts = parts[wide:]
        core = [t for t in norm if t not in N.CANONICAL_FORMS] or norm
        long = [t for t in norm if len(t) >= 4]
        acr = "".join(t[0] for t in core)
        keys = ([f"nameprefix:{min(long)[:4]}"] if long else []) + ([f"acronym:{acr}"] if len(acr) >= 2 else []) + ([f"token:{max(long, key=len)}:EN"] if long else [])
        return " ".join(norm), " ".join(core), acr, "|".join(keys)

    filler = " ".join(f"zo{k:02}" for k in range(30))
    texts = [f"{filler} Aárdvark Company Limited & internationalisation", f"{filler}\nSpolka z ograniczona odpowiedzialnoscia, {filler} Ltd.", "Foo GmbH", "x" * 39 + " tail of a longer text"]
    rows = [(k, t, "en", "web") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.record_key: (r.name_norm, r.core, r.acr, r["keys"]) for r in queries.text_names(spark, str(tmp_path)).collect()}
    assert got == {f"web:{k}": by_force(t) for k, t in enumerate(texts)}
