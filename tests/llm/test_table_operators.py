import gzip
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlink.llm import ann, near_dedup, packing, pii, sstable, warc
from ledgerlink.llm.words import coder
from ledgerlink.operators.graph import connected_components

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


# ---- near-duplicates ----


def brute_groups(texts: dict) -> dict:
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def drifting(rng, words, copies, most):
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.integers(0, most)):
            w[rng.integers(0, len(w))] = f"z{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = []
    for size in (8, 40, 150, 400):
        base = [f"w{rng.integers(0, 5000)}" for _ in range(size)]
        texts += drifting(rng, base, 25, max(2, size // 20))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [" ".join(f"u{rng.integers(0, 10**6)}" for _ in range(120)) + " " + passage for _ in range(30)]
    texts += ["same text here"] * 5 + ["Same TEXT here", "", None, "   ", "a b c d", "a b c d e f"]
    rows = dict(enumerate(texts))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_groups(rows).items()}


def test_blocks_equal_brute_force(spark, monkeypatch):
    # a group whose members drift far from its centre reaches the last rounds
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(120)]
    rows = dict(enumerate(drifting(rng, base, 60, 14)))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows).items()}


def test_dedup_edges(spark):
    docs = spark.createDataFrame([(None, "x y"), (3, "x y"), (3, "x y"), (5, "x  Y")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (5, 3, False)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, 100), (None, 1), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100}


# ---- packing ----


def test_best_fit_and_bounds():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 1024, rng.integers(1, 300))
        bins, offsets = packing.best_fit_decreasing(lengths)
        for b in range(bins.max() + 1):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert offsets[own].tolist() == np.r_[0, np.cumsum(lengths[own])[:-1]].tolist() and lengths[own].sum() <= 1024
        assert packing.lower_bound(lengths) <= bins.max() + 1
    assert packing.lower_bound(np.array([600] * 5)) == 5
    assert packing.lower_bound(np.array([], int)) == 0
    assert packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(1024) == [(0, 1024)]


def test_packing_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6, None), (None, "")], "doc_id long, text string"))
    rows = packing.pack(packing.pieces(docs, BYTE, 2), partition_pieces=60).collect()
    library = Tokenizer.from_file(BYTE)
    texts = docs.where("doc_id < 1000000").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in texts:
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by[d.doc_id], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len(by[10**6]) == 2 and len(by[None]) == 1
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    lengths = np.array([r.length for r in rows])
    whole = int(packing.best_fit_decreasing(lengths)[0].max()) + 1
    # small partitions come close to packing all at once
    assert packing.lower_bound(lengths) <= len(bins) <= 1.02 * whole + 1
    assert all(r.partition_bound <= r.partition_bins for r in rows)
    empty = packing.best_fit_packing(docs.limit(0), BYTE)
    assert empty.count() == 0 and packing.certificate(empty) == (0, 0)
    assert packing.certificate(spark.createDataFrame(rows)) == (len(bins), packing.lower_bound(lengths))


def test_certified_partitions_stay():
    import pandas as pd

    def rows(lengths):
        k = range(len(lengths))
        return pd.DataFrame({"doc_id": k, "piece": 0, "start": 0, "length": lengths, "ids_crc32": 0, "bucket": 0})

    def function(lengths):
        return packing.best_function(np.bincount(lengths, minlength=1025))

    lone = function([600] * 500)
    certified = packing._pack_bucket(1024, False, 10, lone)(rows([600] * 50))
    assert certified.settled.all() and set(certified.bins) == set(certified.bound) == {50}
    # the same partition has room for the small pieces of others
    assert not packing._pack_bucket(1024, False, 10, function([600] * 500 + [100] * 5000))(rows([600] * 50)).settled.all()
    # lengths that best fit packs into a bin more than the bound
    rng = np.random.default_rng(5)
    draws = (rng.integers(150, 600, 14).tolist() for _ in range(2000))
    lengths = next(x for x in draws if packing.best_fit_decreasing(np.array(x))[0].max() + 1 > packing.lower_bound(np.array(x)))
    gapped = packing._pack_bucket(1024, False, 10, function(lengths))(rows(lengths))
    assert 0 < (~gapped.settled).sum() < len(lengths)
    assert gapped.groupby("bin").settled.nunique().max() == 1
    assert packing._pack_bucket(1024, True, 10, function(lengths))(rows(lengths)).settled.all()


# ---- sorted-string tables ----


class Sink:
    def __init__(self):
        self.data = b""

    def write(self, b):
        self.data += b


def test_table_file():
    sink = Sink()
    writer = sstable.TableWriter(sink, 2)
    entries = {sstable.encode_key(k, 0): np.arange(k % 700, dtype="<u2").tobytes() for k in (None, *range(-5, 4000, 3)) if k is not None}
    entries = {sstable.encode_key(None, 0): b"\1\0"} | dict(sorted(entries.items()))
    for k, v in entries.items():
        writer.add(k, v)
    with pytest.raises(ValueError):
        writer.add(sstable.encode_key(0, 0), b"")
    writer.finish()
    reader = sstable.TableReader(sink.data)
    assert {k: bytes(v) for k, v in reader.scan()} == entries
    assert all(reader.get(k) == v for k, v in entries.items())
    assert all(reader.get(sstable.encode_key(k, n)) is None for k, n in ((-4, 0), (5000, 0), (1, 1), (-100, 0)))
    damaged = bytearray(sink.data)
    damaged[10] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.TableReader(bytes(damaged)).scan())


def test_tables_round_trip(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sstable, "RANGE_ROWS", 50)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "x"), (3, "zz zz"), (-7, None)], "doc_id long, text string"))
    manifest = sstable.write_tables(docs, sstable.scratch(spark, "t"), WORD)
    got = sorted(sstable.read_tables(manifest).collect(), key=lambda r: r.start)
    assert manifest.count() >= 4
    library = Tokenizer.from_file(WORD)
    at = 0
    want: dict = {}
    for d in docs.collect():
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(d.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert len(got) == docs.count() and got[0].doc_id is None and got[1].doc_id == -7
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    known = [d.doc_id for d in docs.where("doc_id % 40 = 0").collect()]
    found = sstable.lookup(manifest, [*known, -7, 10**9])
    assert sorted(found) == sorted([*known, -7]) and all((len(v), zlib.crc32(v.astype("<u4").tobytes())) in want[k] for k, v in found.items())
    keys = [(bytes(r.first_key), bytes(r.last_key)) for r in manifest.orderBy("part", "number").collect()]
    assert all(a <= b for a, b in keys) and all(x[1] < y[0] for x, y in zip(keys, keys[1:], strict=False))
    assert sstable.token_tables(docs.limit(0), WORD).count() == 0
    assert coder(WORD) is coder(WORD)


def test_lookup_reads_what_it_needs(tmp_path):
    sink = Sink()
    writer = sstable.TableWriter(sink, 2)
    value = np.arange(2000, dtype="<u2").tobytes()
    for k in range(2000):
        writer.add(sstable.encode_key(k, 0), value)
    writer.finish()
    (tmp_path / "t.sst").write_bytes(bytes(sink.data))
    with pa.OSFile(str(tmp_path / "t.sst")) as f:
        reader = sstable.TableReader(f)
        plain, taken = reader._read, []
        reader._read = lambda at, n: taken.append(n) or plain(at, n)
        assert reader.get(sstable.encode_key(777, 0)) == value and reader.get(sstable.encode_key(5000, 0)) is None
        assert len(taken) == 1 and taken[0] < 2 * sstable.BLOCK_BYTES


def test_tables_of_odd_rows(spark):
    rows = [(1, "long " * 60_000, "a"), (2, None, "b"), (2, None, "b"), (3, "", "c"), (None, "x", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("part", F.lit(9)).withColumn("start", F.lit("s"))
    got = sorted(sstable.token_tables(docs, WORD).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3] and [r.n_tokens for r in got[2:]] == [1, 1, 1]
    assert got[1].n_tokens == len(Tokenizer.from_file(WORD).encode(rows[0][1], add_special_tokens=False).ids) + 1


# ---- archives ----


def test_records_have_ids_of_their_own(spark):
    page = "y" * 150
    rows = [(1, "u", page), (1, "u", page), (2, "v", page), (None, "w", "z"), (None, "w", "z"), (7, "x", "q" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("refers_to", F.lit(5))
    manifest = warc.write_archives(pages.selectExpr("page_id", "url", "encode(html, 'UTF-8') as payload"), warc.scratch(spark, "w"))
    full = warc.read_archives(manifest, payloads=True).collect()
    assert len(full) == 6 and len({r.record_id for r in full}) == 6 and all(r.record_id.startswith("<urn:uuid:") for r in full)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in full)[2:] == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (7, "response", None)]
    assert sorted(r.payload_bytes for r in warc.archive_round_trip(pages).collect()) == [1, 1, 150, 150, 150, 2_000_000]
    archive = "0" * 32
    head = warc.info(archive)
    assert b"WARC-Type: warcinfo" in head and warc.parse(head) is None
    again = warc.record(warc.record_id(archive, 1), 2, "v", None, 150, "d" * 64, 1, "u").decode()
    assert "WARC-Refers-To-Target-URI: u\r\n" in again and again.startswith("WARC/1.1\r\n")


def test_archives(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (1, "http://c", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "é" * 60), (8, "u", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert {k: r.refers_to for k, r in got.items()} == {5: 2, 2: None, 9: 2, 1: None, 3: None, 4: None, 6: None, None: 2, 7: None, 8: 7}
    for k, _, html in rows:
        data = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert got[k].record_type == ("response" if got[k].refers_to is None else "revisit")
    full = warc.read_archives(warc.write_archives(pages.selectExpr("page_id", "url", "encode(coalesce(html, ''), 'UTF-8') as payload"), warc.scratch(spark, "w")), payloads=True).collect()
    assert {bytes(r.payload) for r in full if r.page_id == 2} == {big.encode()}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    assert gzip  # records are frames of zstandard, not members of gzip


def test_trained_dictionary():
    samples = [f"<html><head><title>{k}</title></head><body class='page'>{k * k}</body></html>".encode() * 6 for k in range(200)]
    assert 0 < len(warc.build_dictionary(samples)) <= warc.DICTIONARY_BYTES and warc.build_dictionary([b"a"]) == b"a"


# ---- neighbours ----


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 24))
    x[400:600] = x[400]  # one vector in hundreds of rows
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] + [1.0] * 23), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = 0
    for q in range(0, 700, 20):
        s = x @ x[q]
        order = sorted((-round(s[k], 9), k) for k in range(700) if k != q)[:20]
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & {k for _, k in order})
    assert hits >= 0.9 * 20 * 35 and set(by) == set(range(0, 700, 20))
    few = df.where("vec_id < 4")
    assert ann.nearest(few, few.where("vec_id = 0"), k=20).count() == 3
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# ---- personal data ----

FORCE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= sum(map(str.isdigit, t)) <= 19 and luhn(t)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= sum(map(str.isdigit, t)) <= 15),
}


def luhn(t):
    digits = [int(c) for c in reversed(t) if c.isdigit()]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def test_personal_data_by_brute_force(spark):
    rng = np.random.default_rng(1)
    pool = ["a@b.c", "@", ".", "x.y@z-1.com.", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111-0", "4111111111111112", "+1 (017) 555-7713", "+12", "+1+44 20 7946 0958", " ", "é", "😀", "0", "-", "  ", "7"]
    rows = [(k, "".join(rng.choice(pool, rng.integers(0, 9)))) for k in range(400)] + [(900, None), (901, ""), (None, "a@b.cd"), (902, "a" * 20000), (903, "1" * 20000), (904, "a@" + ".b" * 5000)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        spans = [f"{kind}:{m.start()}:{m.end()}" for kind, (p, fine) in FORCE.items() for m in re.finditer(p, t or "") if fine(m.group())]
        assert got[k].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (k, t and t[:80])
        assert got[k].spans.split(",")[: len(spans)] == (spans or [""])[: len(spans)]


def test_candidates_and_redaction(spark):
    rows = [(1, "call me: 555-123-4567 or write to jane.roe at mail dot org, isbn 978-3-1234-5678-0", "keep"), (2, None, None), (3, "mail a@b.com a@b.com 1.2.3.4", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[1].n_added == 2 and "number:9:21" in got[1].spans and "mailto:" in got[1].spans
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[1].text == "call me: [NUMBER] or write to [MAILTO], isbn 978-3-1234-5678-0" and clean[1].base == "keep"
    assert clean[2].text is None and clean[3].text == "mail [EMAIL] [EMAIL] [IP]"


def test_main_path_is_native(spark):
    plan = pii.personal_data(spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(1))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", "").split("== Physical Plan ==")[1].replace("Scan ExistingRDD", ""))


def test_each_number_of_a_run_is_proposed(spark):
    shapes = [["555-123-4567", "555-222-3333", "555-444-5555"], ["123-45-6789"] * 12, ["4111 1111 1111 1111"] * 3, ["555 123 4567"] * 9, ["(555) 123-4567"] * 4, ["123456789"] * 5]
    rows = [(k, lead + sep.join(numbers) + tail) for k, (numbers, lead, sep, tail) in enumerate(itertools.product(shapes, ("", "call é "), (" ", "\n", ", "), ("", " now")))]
    wanted = {k: n for k, n in enumerate(n for n, *_ in itertools.product(shapes, range(2), range(3), range(2)))}
    got = pii.candidates(spark.createDataFrame(rows, "id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(c.start, c.end) for c in r.cands if c.kind == "number"]
        assert sorted(set(spans)) == spans and all(r.text[c.start : c.end] == c.found for c in r.cands)
        at = 0
        for n in wanted[r.id]:
            at = r.text.index(n, at)
            assert (at, at + len(n)) in spans, (r.text, n)
            at += len(n)
