import __spark_entry__
import corpus_pipeline
from ledgerlink.llm import near_dedup, pii, quality_rules, toxicity
from ledgerlink.runtime import materialise


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = {
        "toxicity": lambda d: {r.doc_id for r in toxicity.toxicity(d, labels).where("predicted = 0").collect()},
        "quality_rules": lambda d: {r.doc_id for r in quality_rules.quality_rules(d, labels).where("kept").collect()},
        "near_duplicates": lambda d: {r.doc_id for r in near_dedup.near_duplicates(d).where("kept").collect()},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, docs, sf_dir), "test")
        assert after.columns == docs.columns
        if name in verdicts:
            assert {r.doc_id for r in after.select("doc_id").collect()} == verdicts[name](docs)
        docs = after
    assert pii.personal_data(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_rows_without_or_with_shared_ids(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bad = docs.join(labels, "doc_id").where("lang = 'en'").orderBy("doc_id").first().text
    long = " ".join(f"w{k}" for k in range(12_000))
    fine = " ".join(f"v{k}" for k in range(80))
    m = 10**6
    rows = [(None, bad), (None, fine), (m, bad + " one"), (m, fine), (m, fine), (m + 2, None), (m + 3, ""), (m + 4, long), (m + 5, long + " end"), (None, fine + " further")]
    odd = spark.createDataFrame([(d, t, "en", "s", None, "x", "y") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_number string, Doc_Key string")
    odd = odd.unionByName(docs.where("doc_id is not null"), allowMissingColumns=True)
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, df):
        got = stages[name](spark, df, sf_dir)
        assert got.columns == df.columns
        return sorted(((r.doc_id, r.text) for r in got.collect() if r.doc_id is None or r.doc_id >= m), key=str)

    by = lambda keep: sorted((r for r in rows if keep(r)), key=str)
    assert kept("toxicity", odd) == by(lambda r: bad not in (r[1] or ""))
    assert [r for r in kept("quality_rules", odd) if bad not in r[1]] == by(lambda r: r[1] and bad not in r[1])
    assert kept("near_duplicates", odd) == sorted([(m, fine), (m + 2, None), (m + 3, ""), (m + 4, long)], key=str)
    assert len(kept("personal_data", odd)) == len(rows)
    packed = stages["best_fit_packing"](spark, odd, sf_dir).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows) + docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
