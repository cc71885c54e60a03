import json
import random

import pytest

from ledgerlink.operators import ledger as L
from ledgerlink.operators import migrations as M
from ledgerlink.sources import legacy, registry
from ledgerlink.streaming import ledger_stream


def test_legacy_tables(spark):
    reg = legacy.load_rows(spark, [{"lei": "L1", "legal_name": "Bloomberg", "registered_at": "RA000585", "registered_as": "01"}, {"lei": "L2", "legal_name": "Nordic", "address_line": ""}], legacy.REGISTRY_SCHEMA)
    names = legacy.load_rows(spark, [{"lei": "L1", "name_type": "x", "name": "Old B"}], legacy.OTHER_NAME_SCHEMA)
    num = legacy.load_rows(spark, [{"company_number": "01", "company_name": "B LTD", "previous_name_1": "P1", "previous_name_3": "P3"}], legacy.NUMBERED_SCHEMA)
    got = legacy.records(reg, num, names).collect()
    assert [(r.source, r.source_id, r.other_names, r.address_lines) for r in got] == [("companies_house", "01", ["P1", "P3"], []), ("gleif", "L1", ["Old B"], []), ("gleif", "L2", [], [])]
    assert legacy.crosswalk(reg, num).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        legacy.load_rows(spark, [{"nope": 1}], legacy.REGISTRY_SCHEMA)


def test_registry_pages(spark, tmp_path):
    page = {"meta": {"goldenCopy": {"publishDate": "2026-01-02T00:00:00Z"}}, "data": [{"attributes": {"lei": "A", "entity": {"legalName": {"name": "Acme"}, "otherNames": [{"name": "X"}, {"name": ""}, {}], "legalAddress": {"country": "GB", "addressLines": ["1 St"]}, "registeredAt": {"id": "RA1"}, "registeredAs": "9"}}}, {"attributes": {"lei": "B", "entity": {"legalName": {"name": "Bare"}}}}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    rows = registry.read_pages(spark, str(tmp_path))
    got = {r.source_id: r for r in registry.flat_record(rows).collect()}
    assert got["A"].other_names == ["X"] and got["A"].address_lines == ["1 St"] and got["B"].country is None and got["B"].address_lines == []
    assert registry.revision(rows).first().revision == "2026-01-02"
    assert registry.read_pages(spark, str(tmp_path), limit=1).count() == 1
    wanted = spark.createDataFrame([("A",), ("A",), (None,), ("",), ("C",)], "source_id string")
    flat = registry.flat_record(rows)
    assert registry.missing_ids(wanted, flat).first().source_id == "C"
    assert registry.lookup_ids(wanted, flat).count() == 1
    with pytest.raises(FileNotFoundError, match="missing"):
        registry.read_pairs(spark, str(tmp_path / "none.json"))


def merge(book, key, a, b, entity):
    return book.merge(idempotency_key=key, left=("s", a), right=("s", b), resolved_id=entity, decision="match", score=0.9, evidence=[{"feature": "f"}], approver_id="me")


def links(book):
    return {r.source_id: (r.resolved_id, r.linked_by_entry_id) for r in L.source_links(book.events()).collect()}


def test_ledger_chain(spark, tmp_path):
    book = L.Ledger(spark, str(tmp_path / "log"))
    one = merge(book, "k1", "A", "B", "e1")
    assert merge(book, "k1", "X", "Y", "zz")["entry_id"] == one["entry_id"]
    two = merge(book, "k2", "A", "C", "e2")
    assert links(book) == {"A": ("e2", 2), "B": ("e1", 1), "C": ("e2", 2)}
    with pytest.raises(L.RefusedError, match="reverse that first"):
        book.undo(one["entry_id"])
    book.undo(two["entry_id"])
    assert links(book) == {"A": ("e1", 1), "B": ("e1", 1)}
    assert book.undo(two["entry_id"])["action"] == "unmerge"
    with pytest.raises(L.RefusedError, match="reversed by"):
        book.unmerge(idempotency_key="other", reverses_entry_id=2, approver_id="me", reason="")
    with pytest.raises(L.RefusedError, match="no merge"):
        book.unmerge(idempotency_key="o2", reverses_entry_id=3, approver_id="me", reason="")
    with pytest.raises(L.AppendOnlyError):
        book.overwrite()
    assert L.violations(book.events()).count() == 0
    assert [r.entry_id for r in L.history(book.events()).collect()] == [3, 2, 1]
    assert L.health(book.events(), book.events().limit(0)).first().active_merges == 1
    with pytest.raises(L.RefusedError, match="no event"):
        book.submit("delete", idempotency_key="d")
    with pytest.raises(L.RefusedError, match="lacks"):
        book.merge(("s", "A"), ("s", None), [], idempotency_key="gap", resolved_id="e", approver_id="me")


def test_lookups_and_snapshots(spark, tmp_path):
    book = L.Ledger(spark, str(tmp_path / "log"))
    merge(book, "k1", "A", "B", "e1")
    two = merge(book, "k2", "B", "C", "e2")
    assert json.loads(two["displaced_links_json"]) == [{"source": "s", "source_id": "B", "resolved_id": "e1", "linked_by_entry_id": 1}]
    events = book.events()
    assert [r.resolved_id for r in L.resolved_id_for(events, "s", "B").collect()] == ["e2"]
    assert L.resolved_id_for(events, "s", "Z").count() == 0
    assert [r.source_id for r in L.links_for(events, "e2").collect()] == ["B", "C"]
    assert L.entry(events, 2).first().idempotency_key == "k2" and L.entry_by_key(events, "k1").first().entry_id == 1
    pair = {"pair_id": "0123456789abcdef", "left_source": "s", "left_id": "D", "right_source": "s", "right_id": "E", "decision": "review", "score": 0.7}
    done = book.approve(pair)
    assert done["resolved_id"] == "cp-0123456789ab" and book.approve(pair)["entry_id"] == done["entry_id"] == 3
    undone = book.undo(3)
    assert (undone["left_id"], undone["right_id"], undone["resolved_id"], undone["displaced_links_json"]) == ("D", "E", done["resolved_id"], None)
    resolved = spark.createDataFrame([("p1", "D", "E", "review", 0.7), ("p2", "A", "B", "review", 0.9), ("p3", "F", "G", "match", 0.9)], "pair_id string, left_id string, right_id string, decision string, score double")
    assert [r.pair_id for r in L.review_queue(resolved, book.events()).collect()] == ["p1"]
    assert L.pair_detail(resolved, "p3")["left_id"] == "F"
    with pytest.raises(LookupError):
        L.pair_detail(resolved, "p9")


def test_violations_name_broken_rules(spark):
    row = lambda n, key, action="merge", back=None, right="b": (n, key, action, "s", "a", "s", right, "e", back, "match", 0.5, "[]", "me", "t", None)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in L.SCHEMA)
    bad = spark.createDataFrame([row(1, "k1"), row(1, "k2"), row(2, "k1"), row(3, "k3", "erase"), row(4, "k4", "unmerge", 99), row(5, "k5", right=None)], schema)
    assert {r.rule: r.entries for r in L.violations(bad).collect()} == {"primary key": 1, "unique key": 1, "action": 1, "not null": 1, "reversed entry": 1}


def test_links_match_a_replay(spark):
    rng = random.Random(5)
    events, state, merges = [], {}, {}
    for n in range(1, 120):
        open_ = [m for m, (a, b, _) in merges.items() if all(state.get(x, (None, 0))[1] == m for x in (a, b))]
        if open_ and rng.random() < 0.35:
            m = rng.choice(open_)
            a, b, before = merges.pop(m)
            for x in (a, b):
                state.pop(x, None)
            state.update(before)
            events.append((n, f"k{n}", "unmerge", "s", a, "s", b, "-", m))
        else:
            a, b = rng.sample("abcdefgh", 2)
            merges[n] = (a, b, {x: state[x] for x in (a, b) if x in state})
            state[a] = state[b] = (f"e{n}", n)
            events.append((n, f"k{n}", "merge", "s", a, "s", b, f"e{n}", None))
    df = spark.createDataFrame(events, "entry_id long, idempotency_key string, action string, left_source string, left_id string, right_source string, right_id string, resolved_id string, reverses_entry_id long")
    assert {r.source_id: (r.resolved_id, r.linked_by_entry_id) for r in L.source_links(df).collect()} == state


def test_write_gate():
    assert L.write_allowed(None, "x") == (False, 403) and L.write_allowed("t", "x") == (False, 401) and L.write_allowed("t", "t") == (True, 200)


def test_migrations(spark):
    old = spark.createDataFrame([(1, "k", "merge", "s", "a", "s", "b", "e", None, "match", 0.5, "[]", "Jane Doe", "t")], "entry_id long, idempotency_key string, action string, left_source string, left_id string, right_source string, right_id string, resolved_id string, reverses_entry_id long, decision string, score double, evidence_json string, approved_by string, recorded_at string")
    half, v = M.migrate(old, 0, target=2)
    assert v == 2 and {"approved_by", "approver_id"} <= set(half.columns)
    with pytest.raises(M.MigrationRefusedError):
        M.migrate(half, 3)
    new, v = M.migrate(half, 2)
    assert v == 5 and new.first().approver_id == "jane.doe" and "approved_by" not in new.columns
    assert M.adapt(spark.createDataFrame([("x", "y")], "approver_id string, odd string"), half).first().approved_by == "x"
    with pytest.raises(M.MigrationRefusedError):
        M.guard_legacy("delete from legacy_gleif")
    M.guard_legacy("select * from legacy_gleif")
    assert len(M.fingerprint(old.schema)) == 32


def test_stream_drops_replays(spark, tmp_path):
    row = ("merge", "s", "a", "s", "b", "e", None, "match", 0.5, "[]", "me", "2026-01-01T00:00:00+00:00", None)
    spark.createDataFrame([(1, "k1", *row), (2, "k1", *row), (3, "k2", *row)], L.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ledger_stream.start(ledger_stream.first_events(ledger_stream.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r.idempotency_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k1", "k2"]
