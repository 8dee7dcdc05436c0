"""The contact network's operators against small cases, and registered queries against their SQL."""

import csv
import io
import json
import os
import sqlite3
import zipfile
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave.functions import dates as D
from kinweave.functions import phones
from kinweave.functions import text as X
from kinweave.operators import contacts as C
from kinweave.operators import mapping, matching, mutations, postings, ranks, resolve, search
from kinweave.operators.ranks import numbered
from kinweave.plans import bindings
from kinweave import api
from kinweave.schemas import CONNECTIONS, CONTACT_TAGS, CONTACTS, ITEMS, NOTES, TAGS, label, validate
from kinweave.sources import catalog, database, store, tabular, workbook
from kinweave.streaming import imports, index, rates

DATA = "/root/testdata/sf0.001"


def people(spark, rows):
    base = {"status": "active", "stage": "new", "source": "manual", "created_at": "2024-01-01", "updated_at": "2024-01-01"}
    return spark.createDataFrame([tuple((base | r).get(c) for c in CONTACTS.names) for r in rows], CONTACTS)


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, wanted", [("3. März 2021", "2021-03-03"), ("14 Mar 2023", "2023-03-14"), ("Mar 14, 2023", "2023-03-14"), ("2023/1/9 10:00", "2023-01-09"), ("31.2.2020", None), ("1/2/2023", None), ("", None), (None, None)])
def test_days(spark, given, wanted):
    assert value(spark, D.parse_day(F.lit(given).cast("string"))) == wanted


def test_texts(spark):
    assert value(spark, X.norm_text(F.lit("Ä Ñandú ß"))) == "a nandu ß"
    assert value(spark, X.tag_name(F.lit("  Machine -- Learning "))) == "machine-learning"
    assert value(spark, X.canonical_url(F.lit("de.LinkedIn.com/in/a/?x=1"))) == "https://www.linkedin.com/in/a"
    assert value(spark, X.initials(F.lit("anna-lena berg"))) == "AB"
    assert search.prefix_query("well-known  -- ÄB") == [["well", "known"], ["ab"]] and search.prefix_query(" - ") is None


def test_list_filters(spark):
    contacts = people(spark, [{"id": 1, "name": "Zoe", "city": "Köln"}, {"id": 2, "name": "adam", "city": "KOLN"}, {"id": 3, "name": "Old", "status": "archived"}])
    needs = items(spark, [(1, 1, "a", "2024-01-01", None), (2, 2, "b", "2024-01-01", "2024-02-01")])
    tags, links = spark.createDataFrame([(1, "vip")], TAGS), spark.createDataFrame([(2, 1)], CONTACT_TAGS)
    ids = lambda **k: sorted(r.id for r in C.filtered(contacts, needs, links, tags, **k).collect())
    assert ids() == [1, 2] and ids(status="archived") == [3] and ids(city=" koln") == [1, 2] and ids(tag="VIP") == [2] and ids(tag="--") == [] and ids(has_open_needs=False) == [2]
    top = C.listed(contacts, 2).orderBy("position").collect()
    assert [r.id for r in top] == [2, 3] and top[0].total_matches == 3


def test_matches_need_open_items_and_evidence(spark):
    contacts = people(spark, [{"id": 1, "name": "Founder"}, {"id": 2, "name": "Investor"}, {"id": 3, "name": "Gone", "status": "archived"}, {"id": 4, "name": "Done"}])
    needs = items(spark, [(1, 1, "Seed funding for robotics", "2024-01-01", None)])
    offers = items(spark, [(1, 2, "I give fundings to Robotics teams", "2024-01-01", None), (2, 3, "funding", "2024-01-01", None), (3, 4, "robotics", "2024-01-01", "2024-02-01")])
    tags, links = spark.createDataFrame([], TAGS), spark.createDataFrame([], CONTACT_TAGS)
    found = matching.find_matches(contacts, needs, offers, links, tags, contact_id=1).collect()
    assert [(r.id, [(e.kind, e.term) for e in r.matched_on]) for r in found] == [(2, [("offer", "funding"), ("offer", "robotics")])]
    with pytest.raises(LookupError):
        matching.find_matches(contacts, needs, offers, links, tags, contact_id=9)
    with pytest.raises(ValueError):
        matching.find_matches(contacts, needs, offers, links, tags, query="  ")


def test_matches_gather_evidence_of_the_shown_alone(spark):
    contacts = people(spark, [{"id": k, "name": f"P{k:02}"} for k in range(30)])
    needs, offers = items(spark, [(1, 0, "robotics", "2024-01-01", None)]), items(spark, [(k, k, "robotics", "2024-01-01", None) for k in range(1, 30)])
    tags, links = spark.createDataFrame([], TAGS), spark.createDataFrame([], CONTACT_TAGS)
    found = matching.find_matches(contacts, needs, offers, links, tags, contact_id=0, limit=3)
    assert [(r.place, r.id) for r in found.orderBy("place").collect()] == [(1, 1), (2, 2), (3, 3)]
    shown = {f.rsplit("/", 1)[0] for f in found.inputFiles() if "/top-" in f}
    assert len(shown) == 1 and spark.read.parquet(*shown).count() == 3


def broadcast_rows(spark, run):
    """What run gives, and the most rows that a plan of it broadcasts."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    seen = store.executionsList().size()
    out, most = run(), 0
    bus.waitUntilEmpty()
    runs = store.executionsList()
    for e in (runs.apply(k) for k in range(seen, runs.size())):
        nodes, values = store.planGraph(e.executionId()).allNodes(), store.executionMetrics(e.executionId())
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if node.name() == "BroadcastExchange" and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, most


def test_matches_of_one_contact_broadcast_candidates_alone(spark):
    """Holders of the contact's tag stand behind a pool without evidence; what is broadcast or proven does not follow their number."""
    contacts = people(spark, [{"id": k, "name": f"P{2000 - k:04}"} for k in range(1301)])
    needs = items(spark, [(k, 0, f"robotics {k}", "2024-01-01", None) for k in range(40)])
    offers = items(spark, [(k, k, "robotics", "2024-01-01", "2024-02-01") for k in range(1, 301)] + [(1300, 1300, "robotics law", "2024-01-02", None)])
    tags, links = spark.createDataFrame([(1, "ai"), (2, "law")], TAGS), spark.createDataFrame([(k, 1) for k in [0, *range(601, 1301)]] + [(1299, 2)], CONTACT_TAGS)
    found, most = broadcast_rows(spark, lambda: matching.find_matches(contacts, needs, offers, links, tags, contact_id=0, query="law"))
    rows, last = broadcast_rows(spark, lambda: found.orderBy("place").collect())
    tag = ("tag", "ai")
    assert [(r.id, [(e.kind, e.term) for e in r.matched_on]) for r in rows] == [
        (1300, [("offer", "robotics"), ("offer", "law"), tag]), (1299, [tag, ("tag", "law")]), *((k, [tag]) for k in range(1298, 1290, -1))]
    assert 0 < max(most, last) < 1000
    proofs = {f.rsplit("/", 1)[0] for f in found.inputFiles() if "/proof-" in f}
    assert spark.read.parquet(*proofs).select("id").distinct().count() <= 10 + 3 * matching.POOL + 1


def test_matches_of_all_contacts_equal_those_of_each(spark):
    """Random networks: repeated and resolved items, shared and nested tags, short and stop-word tags, candidates of every status."""
    random = np.random.default_rng(11)
    words = ["robot", "robotics", "seed", "seedling", "ai", "the", "fund", "funding", "Über", "uber", "x1y", "law"]
    text = lambda: " ".join(random.choice(words, random.integers(1, 5)))
    contacts = people(spark, [{"id": k, "name": f"N{k % 4}", "status": ["active", "active", "imported", "archived"][k % 4] if k > 3 else "active", "company": random.choice([None, "seed law"])} for k in range(1, 31)])
    some = lambda: items(spark, [(k, int(random.integers(1, 31)), text(), f"2024-01-0{random.integers(1, 4)}", random.choice([None, None, "2024-02-01"])) for k in range(60)])
    needs, offers = some(), some()
    tags = spark.createDataFrame(list(enumerate(["ai", "a", "seed", "seed-fund", "the", "law", "--"])), TAGS)
    links = spark.createDataFrame(list({(int(random.integers(1, 31)), int(random.integers(7))) for _ in range(40)}), CONTACT_TAGS)
    got = {}
    for r in matching.match_all(contacts, needs, offers, links, tags).orderBy("source_id", "place").collect():
        got.setdefault(r.source_id, []).append((r.place, r.id, r.name, [tuple(e) for e in r.matched_on]))
    for k in (1, 2, 3, 17, 30):
        want = matching.find_matches(contacts, needs, offers, links, tags, contact_id=k).orderBy("place").collect()
        assert got.get(k, []) == [(r.place, r.id, r.name, [tuple(e) for e in r.matched_on]) for r in want]
    one = matching.match_all(contacts, needs, offers, links, tags, sources=spark.createDataFrame([(17,), (17,), (99,)], "id long"))
    assert [(r.place, r.id) for r in one.orderBy("place").collect()] == [x[:2] for x in got.get(17, [])]


def test_sources_of_one_profile_are_matched_once(spark, monkeypatch):
    """Pairs grow with the profiles of sources, not with the sources; a source among its profile's best is replaced by the next."""
    sizes, settle = {}, matching.settle

    def counted(df, name):
        out = settle(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(matching, "settle", counted)
    contacts = people(spark, [{"id": k, "name": f"N{k:02}"} for k in range(1, 31)])
    needs = items(spark, [(k, k, "robot law" if k % 2 else "law robot", "2024-01-01", None) for k in range(1, 31)])
    offers = items(spark, [(100 + k, k, "law robot", "2024-01-01", None) for k in range(1, 13)])
    tags, links = spark.createDataFrame([], TAGS), spark.createDataFrame([], CONTACT_TAGS)
    got = {}
    for r in matching.match_all(contacts, needs, offers, links, tags).orderBy("source_id", "place").collect():
        got.setdefault(r.source_id, []).append((r.id, [e.term for e in r.matched_on if e.kind == "offer"]))
    for k in (13, 14, 30):
        assert got[k] == [(n, ["robot", "law"] if k % 2 else ["law", "robot"]) for n in range(1, 11)]
    assert {k: len(rows) for k, rows in got.items()} == dict.fromkeys(range(1, 31), 10) and all(k not in dict(rows) for k, rows in got.items())
    assert sizes["profiles"] == 2 and sizes["pairs"] == 12 + 30


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch):
    """A row's postings are made within the row: the plan that writes them has one exchange, by ranges of as many tasks as there are postings for."""
    plans, blocks = [], postings._blocks

    def planned(held, made):
        out = blocks(held, made)
        plans.append((made, out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(postings, "_blocks", planned)
    monkeypatch.setattr(postings, "POSTS", 2)
    corpus = spark.createDataFrame([(1, "b a b", None), (2, "", "a a"), (None, "a", "a")], "id long, s string, t string")
    index = postings.indexed(corpus, ["s", "t"], str(tmp_path / "index"))
    ((made, plan),) = plans
    assert made == 3 and plan.count("Exchange") == 1 and "rangepartitioning" in plan and ", 2)" in plan
    got = sorted((r.token, r.column, list(r.keys), [list(p) for p in r.places], list(r.sizes)) for r in index.part("postings").selectExpr("token", "column", "keys", "places", "sizes").collect())
    assert got == [("a", "s", [1], [[1]], [3]), ("a", "t", [2], [[0, 1]], [2]), ("b", "s", [1], [[0, 2]], [3])] and (index.rows, index.tokens) == (2, 5)


def test_batch_counts_only_reached_tokens(spark, monkeypatch):
    """Rows that are counted grow with the tokens that a term reaches, not with the corpus."""
    sizes, settle = {}, matching.settle

    def counted(df, name):
        out = settle(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(matching, "settle", counted)
    sources = spark.createDataFrame([(1, "robot law"), (2, "the of"), (3, "lawyer robot")], "source_id long, text string")
    corpus = spark.createDataFrame([(1, "robots and robot games", True), (2, "a lawyer at law", True), (3, "robot", False), (4, "games " * 50, True), (5, None, True)], "id long, text string, active boolean")
    got = [(r.source_id, r.place, r.id, r.n_terms, r.first_term) for r in matching.match_batch(sources, corpus, 5).orderBy("source_id", "place").collect()]
    assert got == [(1, 1, 2, 1, "law"), (1, 2, 1, 1, "robot"), (3, 1, 2, 1, "lawyer"), (3, 2, 1, 1, "robot")]
    assert sizes["reach"] == 5 and sizes["hits"] == 4


def test_ranges_follow_the_number_of_rows(spark, monkeypatch):
    """A range holds about as many rows of a large table as of a small one, whatever the session's number of partitions."""
    parts, settle = {}, ranks.settle

    def counted(df, name):
        parts[name] = df.rdd.getNumPartitions() if name == "ranges" else None
        return settle(df, name)

    monkeypatch.setattr(ranks, "settle", counted)
    monkeypatch.setattr(ranks, "RANGE", 10)
    rows = spark.range(95).selectExpr("id % 2 k", "id", "95 - id as v")
    got = ranks.numbered(rows, ["id"], "at", ["k"]).collect()
    assert parts["ranges"] == 10 and all(r["at"] == r.id // 2 + 1 for r in got) and len(got) == 95
    least = ranks.running_least(rows, "k", "id", "v").collect()
    assert parts["ranges"] == 10 and all(r.least == (None if r.id < 2 else 97 - r.id) for r in least) and len(least) == 95


def test_rules_of_mapping_and_lookup(spark):
    """Line breaks within a company stay, e-mails keep their case, each dropped field has its reason; e-mails are looked up by ASCII case."""
    rows = spark.createDataFrame([(1, " Ann\n Lee ", "Acme\nInc ", " A.B@X.org ", "soon"), (2, "Bo", None, "n/a", "2021-03-03")], "row_number long, n string, c string, e string, d string")
    got = mapping.map_rows(rows, {"n": "name", "c": "company", "e": "email", "d": "created_at"}).orderBy("row_number").collect()
    assert [(r.name, r.company, r.email, r.created_at) for r in got] == [("Ann Lee", "Acme\nInc", "A.B@X.org", None), ("Bo", None, None, "2021-03-03")]
    assert [[tuple(d) for d in r.dropped] for r in got] == [[("created_at", "soon", "unreadable day")], [("email", "n/a", "not an e-mail address")]]
    contacts = people(spark, [{"id": 5, "name": "A", "email": "Ü.x@Y.org"}, {"id": 3, "name": "B", "email": "no at"}, {"id": 2, "name": "C", "email": ""}])
    asked = spark.createDataFrame([(" Ü.X@y.ORG\t",), ("ü.x@y.org",), ("NO AT",), ("noat",), (" ",), (None,)], "email string")
    assert {r.email: r.id for r in C.by_email(contacts, asked).collect()} == {" Ü.X@y.ORG\t": 5, "ü.x@y.org": None, "NO AT": 3, "noat": None, " ": None, None: None}


def test_absent_days_are_no_fault(spark):
    rows = people(spark, [{"id": 1, "name": "A"}, {"id": 2, "name": "B", "birthday": "--02-30", "last_contact_at": "2023-02-29"}])
    assert {r.id: r.errors for r in validate(rows).collect()} == {1: [], 2: ["last_contact_at: not a day", "birthday: not a day"]}


def test_import_replay_in_order(spark):
    known = people(spark, [{"id": 5, "name": "Ann Lee", "email": "ann@x.org"}]).select("id", "name", "email", "linkedin_url")
    rows = [(1, "Bob", "bob@x.org", None), (2, "BOB", None, "https://x.org/b"), (3, "bob", "other@x.org", None), (4, "ann lee", "zzz@x.org", None), (5, " ", None, None), (6, "Ann", "ANN@x.org ", None), (7, "Q", "other@x.org", None)]
    out = resolve.replay(known, spark.createDataFrame(rows, "row_number long, name string, email string, linkedin_url string")).orderBy("row_number").collect()
    assert [(r.outcome, r.contact_id, r.matched_by) for r in out] == [("created", 6, None), ("skipped", 6, "name"), ("created", 7, None), ("created", 8, None), ("skipped", None, None), ("skipped", 5, "email"), ("skipped", 7, "email")]
    assert resolve.summary(spark.createDataFrame(out)).first().created == 3


def test_mutations(spark):
    contacts = people(spark, [{"id": 1, "name": "A", "status": "imported", "city": "X"}, {"id": 2, "name": "B", "company": ""}])
    patched = mutations.update_contacts(contacts, spark.sql("select 1L id, named_struct('value', cast(null as string)) city"), "2025-01-01").orderBy("id").collect()
    assert (patched[0].city, patched[0].status, patched[0].updated_at, patched[1].updated_at) == (None, "active", "2025-01-01", "2024-01-01")
    enriched = mutations.enrich(contacts, spark.sql("select 2L id, 'Acme' company"), "2025").orderBy("id").collect()
    assert [(r.company, r.enriched) for r in enriched] == [(None, False), ("Acme", True)]
    added = mutations.insert_contacts(contacts, spark.sql("select 'C' name"), "2025").where("id = 3").first()
    assert (added.status, added.stage) == ("active", "new")


def test_mapping():
    s = mapping.suggest(["First Name", "Last Name", "URL", "Email Address", "Company", "Position", "Connected On"])
    assert s.confident and s.mapping["URL"] == "linkedin_url" and mapping.suggest(["Name", "URL"]).unmapped == ["URL"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "cp1252"])
def test_csv_with_preamble(spark, tmp_path, encoding):
    path = tmp_path / "people.csv"
    path.write_bytes('Notes\n"Some, quoted\nprose"\n\nFirst Name;Stadt;Stadt\nJörg;"Köln; Süd";1\n;;\nAnn;"two\nlines";2\n'.encode(encoding))
    rows, warnings = tabular.read(spark, str(path))
    assert rows.columns == ["row_number", "First Name", "Stadt", "Stadt (2)"] and [tuple(r)[1:] for r in rows.collect()] == [("Jörg", "Köln; Süd", "1"), ("Ann", "two\nlines", "2")]
    assert bool(warnings) == (encoding == "cp1252")


@pytest.mark.parametrize("quoted", [False, True])
def test_csv_keeps_cells_of_late_wide_rows(spark, tmp_path, quoted):
    path = tmp_path / "late.csv"
    lines = ["Prose,with,far,more,cells,than,any,row", "First Name,City", *(f"p{k},c{k}" for k in range(5000)), "wide,x,extra,,last", *(f"q{k}," for k in range(5000))]
    path.write_text("\n".join([*lines, '"two\nlines",y,z'] if quoted else lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows, _ = tabular.read(spark, str(path))
        assert rows.columns == ["row_number", "First Name", "City", "Spalte 3", "Spalte 5"]  # the fourth has no name and no value
        assert rows.rdd.getNumPartitions() > 1
        got = {r[0]: tuple(r)[1:] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == list(range(1, 10002 + quoted)) and got[5001] == ("wide", "x", "extra", "last")
    assert got[1][:2] == ("p0", "c0") and got[10001][:2] == ("q4999", "") and (not quoted or got[10002] == ("two\nlines", "y", "z", ""))


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "utf-16-be", "cp1252"])
def test_records_in_splits_equal_the_csv_module(spark, tmp_path, encoding):
    """Random files with quoted line breaks, quotes within cells, empty and blank lines, over blocks of a few hundred bytes."""
    random = np.random.default_rng(15)
    signs = ['"', '""', ",", "\n", "\r\n", " ", "a", "Bé", "x y", "\n\n"] + ([] if encoding == "cp1252" else ["\u0a0a", "\u010a", "\u0a00", "\u0d0a", "🙂"])
    for _ in range(3):
        cell = lambda: '"' + "".join(random.choice(signs, random.integers(0, 9))).replace('"', '""') + '"' if random.random() < 0.4 else "".join(random.choice(["a", "b ", 'q"', "é", "Z"], random.integers(0, 4)))
        text = "First Name,City\n" + "".join(",".join(cell() for _ in range(random.integers(1, 4))) + str(random.choice(["\n", "\r\n", "\n\n"])) for _ in range(400))
        path = tmp_path / f"{encoding}{random.integers(1 << 30)}.csv"
        path.write_bytes((b"\xfe\xff" if encoding == "utf-16-be" else b"") + text.encode(encoding))
        grid = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
        wanted = {k + 1: tuple((r + ["", "", ""])[:3]) for k, r in enumerate(grid) if any(c.strip(" ") for c in r)}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows, warnings = tabular.read(spark, str(path))
            got = {r[0]: tuple(r)[1:] for r in rows.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == wanted and bool(warnings) == (encoding == "cp1252")


def test_late_bytes_decide_the_encoding(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"First Name,City\n" + b"Ann,Rome\n" * 20_000 + "Jörg,Köln €\n".encode("cp1252"))
    rows, warnings = tabular.read(spark, str(path))
    assert [tuple(r)[1:] for r in rows.where("row_number > 20000").collect()] == [("Jörg", "Köln €")] and warnings


def test_number_formats():
    cases = [
        (44999, "General", "44999"), (0.1 + 0.2, "General", "0.3"), (1234567890123, "General", "1.23457E+12"), (-2.5, "General", "-2.5"), (1e-12, "General", "1E-12"),
        (1234.5, "#,##0.00", "1,234.50"), (-1234.5, "#,##0.00;(#,##0.00)", "(1,234.50)"), (0.256, "0%", "26%"), (0.2565, "0.00%", "25.65%"), (7, "0000", "0007"), (0.5, "#.##", ".5"), (12345, "0.00E+00", "1.23E+04"),
        (1234567, '0.0,,"M"', "1.2M"), (0, '0;-0;"none"', "none"), (-3, "0.0", "-3.0"), (-0.001, "0.0", "0.0"), (491701234567, '"+"0', "+491701234567"), (5, '[$€-407] 0.00', "€ 5.00"), (2.005, "0.00", "2.01"),
        (44999, "m/d/yy", "3/14/23"), (44999, "d mmm yyyy", "14 Mar 2023"), (44999, "dddd, mmmm dd", "Tuesday, March 14"), (44999.75, "yyyy-mm-dd hh:mm", "2023-03-14 18:00"), (0.52, "h:mm AM/PM", "12:28 PM"), (1.5, "[h]:mm:ss", "36:00:00"),
        (60, "yyyy-mm-dd", "1900-02-29"), (61, "yyyy-mm-dd", "1900-03-01"), (59, "yyyy-mm-dd", "1900-02-28"), (1 / 86400 * 61.26, "mm:ss.0", "01:01.3"), (0.999999, "hh:mm:ss", "00:00:00"), (45.5, "@", "45.5"),
    ]
    assert [(x, f, workbook.shown(x, f)) for x, f, _ in cases] == cases
    assert workbook.shown(43537, "d.m.yyyy", epoch_1904=True) == "14.3.2023"


def test_workbook_as_displayed(spark, tmp_path):
    """The first sheet with a header row; dates, percents, kept zeros, rich and inline strings, truth values, rows left out."""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {space}><workbookPr date1904="1"/><sheets><sheet name="Notes" r:id="b"/><sheet name="People" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {space}><numFmts><numFmt numFmtId="164" formatCode="d mmm yyyy"/></numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="10"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {space}><si><t>First Name</t></si><si><r><t>An</t></r><r><t>na</t></r><rPh><t>x</t></rPh></si></sst>",
        "xl/worksheets/two.xml": f'<worksheet {space}><sheetData><row r="1"><c r="A1"><v>5</v></c></row></sheetData></worksheet>',
        "xl/worksheets/one.xml": f'<worksheet {space}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>Since</t></is></c><c r="C2" t="str"><v>Share</v></c><c r="E2" t="str"><v>Member</v></c></row>'
        '<row r="5"><c r="A5" t="s"><v>1</v></c><c r="B5" s="1"><v>43537</v></c><c r="C5" s="2"><v>0.125</v></c><c r="E5" t="b"><v>1</v></c></row></sheetData></worksheet>',
    }
    path = tmp_path / "people.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    rows, _ = tabular.read(spark, str(path))
    assert rows.columns == ["row_number", "First Name", "Since", "Share", "Member"] and [tuple(r) for r in rows.collect()] == [(3, "Anna", "14 Mar 2023", "12.50%", "TRUE")]
    for sheet, fault in (("Notes", "no header row"), (3, "no sheet 3; there are Notes, People")):
        with pytest.raises(Exception, match=fault):
            tabular.read(spark, str(path), sheet)


def test_rate_limit_matches_brute_force(spark):
    rows = [(k, k % 2, datetime(2024, 1, 1) + timedelta(minutes=k * 7 % 300)) for k in range(200)]
    out = {r.id: r.accepted for r in rates.limited(spark.createDataFrame(rows, "id long, user long, at timestamp"), "user", "at", "id").collect()}
    for user in (0, 1):
        log = []
        for k, _, at in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            ok = sum(at - x < timedelta(hours=1) for x in log) < 5
            assert out[k] == ok
            log += [at] if ok else []


def test_store_and_index(spark, tmp_path):
    contacts, none = people(spark, [{"id": 1, "name": "A"}, {"id": 2, "name": "B"}]), items(spark, [])
    store.save(spark, str(tmp_path), {"contacts": contacts})
    assert store.load(spark, str(tmp_path), ["contacts"])["contacts"].count() == 2
    old = search.indexed_text(contacts, none, none)
    new = index.refreshed(old, spark.sql("select 1L id"), contacts, items(spark, [(1, 1, "boat", "2024", None)]), none)
    assert {r.id: r.needs_text for r in new.collect()} == {1: "boat", 2: None}


def _rows(frame, columns):
    return sorted(str(tuple(None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x for x in r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ["q_list_open_counts", "q_sort_stage_domain", "q_board", "q_bm25_topk", "q_map_row", "q_dedupe_match_all", "q_validate", "q_match_all", "q_connections_ordered", "q_connection_normalise"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    wanted, got = con.execute(bindings.ORACLE_SQL[name]).df(), bindings.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(wanted.columns) and _rows(got, sorted(got.columns)) == _rows(wanted, sorted(got.columns))


def _against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    wanted, got = con.execute(bindings.ORACLE_SQL[name]).df(), bindings.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(wanted.columns) and _rows(got, sorted(got.columns)) == _rows(wanted, sorted(got.columns))
    return got


def test_count_by_status_counts_all_contacts(spark):
    got = _against_sql(spark, "q_count_by_status")
    assert got["n"].sum() == spark.read.parquet(f"{DATA}/customer.parquet").count() and (got["n"] > 0).all()
    few = people(spark, [{"id": 1, "name": "A"}, {"id": 2, "name": "B"}, {"id": 3, "name": "C", "status": "archived"}])
    assert {r.status: r.n for r in C.counts_by(few, "status").collect()} == {"active": 2, "archived": 1, "imported": 0}


@pytest.mark.parametrize("name", ["q_dedupe_match_all", "q_import_summary_all", "q_matched_histogram_all"])
def test_resolution_of_everyone_equals_sql(spark, name):
    got = _against_sql(spark, name)
    if name == "q_dedupe_match_all":
        assert len(got) == sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("customer", "supplier"))
    if name == "q_matched_histogram_all":
        assert set(got["matched_by"]) == {"url", "email", "name"}


def test_replay_takes_everyone(spark):
    got = bindings.QUERIES["q_dedupe_replay"](spark, DATA).toPandas()
    numbers = [2 * r.k for r in spark.table("parquet.`%s/customer.parquet`" % DATA).selectExpr("c_custkey k").collect()] + [2 * r.k + 1 for r in spark.table("parquet.`%s/supplier.parquet`" % DATA).selectExpr("s_suppkey k").collect()]
    assert sorted(got["row_number"]) == sorted(numbers) and {"url", "email", "name"} <= set(got["matched_by"].dropna())


def in_turn(known, rows):
    """A replay by definition: one row after another against plain lists."""
    people = [dict(p) for p in known]
    top, made, out = max([p["id"] for p in known], default=0), 0, []
    for r in rows:
        name, mail, url = (r.get(k) or None for k in ("name", "email", "linkedin_url"))
        if not name:
            out.append(("skipped", None, None))
            continue
        way = target = None
        for kind, key in (("url", "linkedin_url"), ("email", "email")):
            hits = [p for p in people if r.get(key) and p.get(key) == r.get(key)]
            if target is None and hits:
                way, target = kind, min(hits, key=lambda p: p["id"])
        if target is None:
            same = [p for p in people if p["name"].lower() == name.lower() and not (mail and p.get("email") and p["email"] != mail) and not (url and p.get("linkedin_url") and p["linkedin_url"] != url)]
            if same:
                way, target = "name", min(same, key=lambda p: p["id"])
        fields = {k: v for k, v in r.items() if v and k != "row_number"}
        if len(r.get("company") or "") > 200:
            out.append(("error", target and target["id"], way))
        elif target is None:
            made += 1
            people.append({"id": top + made, **fields})
            out.append(("created", top + made, None))
        else:
            new = {k: v for k, v in fields.items() if not target.get(k) and (way != "name" or k not in ("email", "linkedin_url"))}
            target.update(new)
            out.append(("enriched" if new else "skipped", target["id"], way))
    return out, people


def test_replay_and_apply_equal_rows_in_turn(spark):
    random = np.random.default_rng(3)
    pick = lambda prefix, n, share: f"{prefix}{random.integers(n)}" if random.random() < share else None

    def person():
        site = pick("https://x.org/p/", 40, 0.4)
        mail = pick("m", 40, 0.4)
        return {"name": pick("N", 12, 0.95), "email": mail and f"{mail}@x.org", "linkedin_url": site, "company": "y" * 201 if random.random() < 0.03 else pick("C", 5, 0.5), "city": pick("T", 5, 0.5)}

    known = [{"id": k + 1, **person(), "company": None} for k in range(25)]
    known = [k | {"name": k["name"] or "N"} for k in known]
    rows = [{"row_number": k + 1, **person()} for k in range(150)]
    contacts = people(spark, known)
    incoming = spark.createDataFrame([tuple(r.values()) for r in rows], "row_number long, name string, email string, linkedin_url string, company string, city string")
    outcomes = resolve.replay(contacts, incoming)
    got = [(r.outcome, r.contact_id, r.matched_by) for r in outcomes.orderBy("row_number").collect()]
    wanted, after = in_turn(known, rows)
    assert got == wanted and {"created", "enriched", "skipped", "error"} == {o for o, _, _ in got}
    left = {r.id: r for r in resolve.applied(contacts, outcomes, "2025-01-01").collect()}
    assert sorted(left) == [p["id"] for p in after]
    for p in after:
        assert all((left[p["id"]][c] or None) == (p.get(c) or None) for c in ("name", "email", "linkedin_url", "company", "city"))


def test_replay_of_long_chains(spark):
    # Each row shares its name with one neighbour and its e-mail with the other.
    chain = [(k, f"Person {(k + 1) // 2}", f"mail{k // 2}@x.org", None) for k in range(5000)]
    none = people(spark, [])
    out = resolve.replay(none, spark.createDataFrame(chain, "row_number long, name string, email string, linkedin_url string"))
    assert {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()} == {"created": 2500, "skipped": 2500}


def test_replay_of_one_name(spark):
    """Every known contact and row has one name; many share e-mails, and contacts gain addresses by e-mail and e-mails by address."""
    random = np.random.default_rng(8)
    pick = lambda form, n, share: form.format(random.integers(n)) if random.random() < share else None
    person = lambda: {"name": "Kim", "email": pick("m{}@x.org", 300, 0.5), "linkedin_url": pick("https://x.org/p/{}", 300, 0.5), "company": pick("C{}", 5, 0.5), "city": None}
    known = [{"id": 2 * k + 1, **person(), "company": None} for k in range(300)]
    rows = [{"row_number": k, **person()} for k in range(900)]
    contacts = people(spark, known)
    outcomes = resolve.replay(contacts, spark.createDataFrame([tuple(r.values()) for r in rows], "row_number long, name string, email string, linkedin_url string, company string, city string"))
    wanted, after = in_turn(known, rows)
    assert [(r.outcome, r.contact_id, r.matched_by) for r in outcomes.orderBy("row_number").collect()] == wanted
    left = {r.id: r for r in resolve.applied(contacts, outcomes, "2025-01-01").collect()}
    assert all((left[p["id"]][c] or None) == (p.get(c) or None) for p in after for c in ("email", "linkedin_url", "company"))


def test_replay_finds_first_givers_by_numbers(spark, monkeypatch):
    """Who gives a field first is found among row numbers in bounded shares; a task never sorts the values of its share."""
    plans, settle = {}, resolve.settle

    def told(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return settle(df, name)

    monkeypatch.setattr(resolve, "settle", told)
    monkeypatch.setattr(resolve, "RANGE", 2, raising=False)
    rows = [{"row_number": k, "name": "Kim", "email": "kim@x.org", "company": "C" if k > 1 else None, "city": f"T{k}" if k else None} for k in range(6)]
    rows += [{"row_number": 6 + k, "name": "Lee", "email": "lee@x.org", "company": f"D{k}", "city": None if k < 2 else "T"} for k in range(4)]
    known = [{"id": 1, "name": "Kim", "email": "kim@x.org"}]
    outcomes = resolve.replay(people(spark, known), spark.createDataFrame([tuple(r.values()) for r in rows], "row_number long, name string, email string, company string, city string"))
    wanted = [("skipped", {}), ("enriched", {"city": "T1"}), ("enriched", {"company": "C"}), *[("skipped", {})] * 3, ("created", {"name": "Lee", "email": "lee@x.org", "company": "D0"}), ("skipped", {}), ("enriched", {"city": "T"}), ("skipped", {})]
    assert [(r.outcome, r.written) for r in outcomes.orderBy("row_number").collect()] == wanted
    assert "SortAggregate" not in plans["outcomes"]


def test_running_least_over_ranges(spark):
    """One key fills several ranges; equal orders do not see each other."""
    random = np.random.default_rng(9)
    rows = [(None if random.random() < 0.05 else "hot" if random.random() < 0.8 else f"k{random.integers(4)}", int(random.integers(200)), int(random.integers(50)) if random.random() < 0.6 else None, k) for k in range(600)]
    got = ranks.running_least(spark.createDataFrame(rows, "key string, o int, v int, id int").repartition(7), "key", "o", "v")
    for r in got.collect():
        assert r.least == min((v for key, o, v, _ in rows if key == r.key and o < r.o and v is not None), default=None)


def test_repeated_patches_and_guards(spark):
    contacts = people(spark, [{"id": 1, "name": "A", "status": "imported"}, {"id": 2, "name": "B"}])
    patches = spark.sql("select 1L id, named_struct('value', 'X') city, 1 seq union all select 1L, named_struct('value', 'Y'), 2")
    assert [(r.id, r.city) for r in mutations.update_contacts(contacts, patches, "2025").orderBy("id").collect()] == [(1, "Y"), (2, None)]
    assert mutations.set_status(contacts, spark.sql("select 1L id union all select 1L"), "archived", "2025").count() == 2
    assert mutations.enrich(contacts, spark.sql("select 2L id, 'P' company union all select 2L, 'Q'"), "2025").where("id = 2").first().company == "Q"
    with pytest.raises(LookupError, match="id 9"):
        mutations.require(contacts, spark.sql("select 9L id"))
    none = spark.createDataFrame([], CONNECTIONS)
    with pytest.raises(ValueError):
        mutations.connect(none, spark.sql("select 1L a, 1L b, 'x' note"), "2025")
    tied = mutations.connect(none, spark.sql("select 2L a, 1L b, 'z' note, 1 seq union all select 1L, 2L, 'a', 2 union all select 1L, 2L, null, 3"), "2025").collect()
    assert [(r.contact_a_id, r.contact_b_id, r.note, r.id) for r in tied] == [(1, 2, "a", 1)]


def test_calls_of_the_library(spark, tmp_path):
    names = {"contacts": CONTACTS, "needs": ITEMS, "offers": ITEMS, "notes": NOTES, "tags": TAGS, "contact_tags": CONTACT_TAGS, "connections": CONNECTIONS}
    net = {k: spark.createDataFrame([], v) for k, v in names.items()}
    net = api.create_contact(net, "2025-01-01", name="Zoe", company="Robotics", closeness=4)
    net = api.create_contact(net, "2025-01-01", name="adam", company="robotics lab")
    net = api.add_offer(api.add_need(net, 1, "seed funding", "2025-01-02"), 2, "Funding for robots", "2025-01-02")
    net = api.add_note(api.tag_contact(net, 2, " Deep Tech "), 1, "met", "2025-02-01", "2025-01-30")
    net = api.connect(api.update_contact(net, 1, "2025-02-02", city="Köln"), 2, 1, "2025-02-02", "old friends")
    net = {k: spark.createDataFrame(df.collect(), df.schema) for k, df in net.items()}
    hits = api.search_contacts(net, "robot", city="koln").collect()
    assert [(r.id, r.open_needs_count, r.total_matches) for r in hits] == [(1, 1, 1)]
    assert [r.id for r in api.search_contacts(net).orderBy("position").collect()] == [2, 1] and api.search_contacts(net, "--").count() == 0
    one = api.get_contact(net, 1, include_notes=True).first()
    assert one.last_contact_at == "2025-01-30" and one.notes[0].body == "met" and "notes" not in api.get_contact(net, 2).columns
    assert [r.id for r in api.find_matches(net, contact_id=1).collect()] == [2]
    assert C.open_items(api.resolve_need(net, 1, "2025-03-01")["needs"]).count() == 0
    left = api.delete_contact(net, 2)
    assert left["contacts"].count() == 1 and left["connections"].count() == 0
    for fault, call in ((LookupError, lambda: api.get_contact(net, 7)), (LookupError, lambda: api.resolve_need(net, 5, "x")), (ValueError, lambda: api.update_contact(net, 1, "x", stage="?")), (ValueError, lambda: api.search_contacts(net, limit=0)), (ValueError, lambda: api.create_contact(net, "x", name="A", birthday="2023-02-30"))):
        with pytest.raises(fault):
            call()
    path = tmp_path / "people.csv"
    path.write_text("First Name,Last Name,E-Mail,City\nZoe,,zoe@x.org,Bonn\nEve,New,,Rom\n")
    dry, outcomes = api.import_file(net, spark, str(path), "2025-03-01", dry_run=True)
    assert dry is net and {r.outcome for r in outcomes.collect()} == {"created", "skipped"}
    done, _ = api.import_file(net, spark, str(path), "2025-03-01")
    assert [(r.id, r.name, r.city, r.status) for r in done["contacts"].orderBy("id").collect()] == [(1, "Zoe", "Köln", "active"), (2, "adam", None, "active"), (3, "Eve New", "Rom", "imported")]


def test_index_gives_what_the_corpus_gives(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "deep sea diving", "boats"), (2, "sea deep", None), (3, "the deep seas", "deep sea"), (4, None, None)], "id long, a string, b string")
    index = postings.indexed(corpus, ["a", "b"], str(tmp_path / "index"))
    for phrases, more in (([["deep", "se"]], {}), ([["se"]], {"allowed": ["b"]}), ([["deep", "sea"], ["bo"]], {"any_of": True}), ([["xyz"]], {})):
        slow, fast = (sorted((r.id, round(r["rank"], 9)) for r in df.collect()) for df in (search.ranked(corpus, phrases, ["a", "b"], **more), postings.found(index, phrases, **more)))
        assert slow == fast and (bool(slow) == (phrases != [["xyz"]]))
    with pytest.raises(FileExistsError):
        postings.indexed(corpus, ["a", "b"], str(tmp_path / "index"))


def _ranks(df, limit=None):
    rows = sorted((round(r["rank"], 9), r.id) for r in df.collect())
    return rows[:limit] if limit else rows


def test_index_after_random_edits_equals_a_new_one(spark, tmp_path):
    """Changed, added and deleted rows over several refreshes and a merge: as if the corpus had been indexed at the end."""
    random = np.random.default_rng(12)
    text = lambda: " ".join(random.choice(["sea", "seal", "deep", "boat", "x"], random.integers(0, 6)))
    rows = {k: (text(), text()) for k in range(40)}
    frame = lambda keys: spark.createDataFrame([(int(k), *rows[k]) for k in keys], "id long, a string, b string")
    index = postings.indexed(frame(rows), ["a", "b"], str(tmp_path / "index"))
    stale = index
    for step in range(5):
        changed = [int(k) for k in random.integers(0, 60, 6)]
        gone = [int(k) for k in random.integers(0, 60, 4) if k not in changed]
        rows.update({k: (text(), text()) for k in changed})
        for k in gone:
            rows.pop(k, None)
        index = postings.refresh(stale if step == 3 else index, frame(set(changed)), spark.createDataFrame([(k,) for k in gone], "id long"))
    assert len(index.segments) < 6 and max(s["level"] for s in index.segments) > 0
    assert (index.rows, index.tokens) == (len(rows), sum(len((a + " " + b).split()) for a, b in rows.values()))
    index, now = postings.opened(spark, index.path), frame(rows)
    for phrases, more in (([["sea"]], {}), ([["deep", "se"]], {}), ([["x"], ["boat"]], {"any_of": True}), ([["sea"], ["deep"]], {"allowed": ["a"]})):
        assert _ranks(postings.found(index, phrases, **more)) == _ranks(search.ranked(now, phrases, ["a", "b"], **more))


def test_best_of_an_index_skips_blocks(spark, tmp_path):
    """Keys over many blocks, a token in every row: the best are those of the whole ranking, ties by key."""
    random = np.random.default_rng(13)
    rows = [(int(k) * postings.SPAN // 9, " ".join(["all"] * int(random.integers(1, 9)) + ["rare"] * int(random.random() < 0.1) + ["w"] * int(random.integers(0, 30)))) for k in range(400)]
    corpus = spark.createDataFrame(rows, "id long, t string")
    index = postings.indexed(corpus, ["t"], str(tmp_path / "index"))
    assert index.part("postings").where("token = 'all'").count() > 40  # the common token is split
    for phrases, more in (([["all"]], {}), ([["rare"], ["all"]], {}), ([["rare"], ["al"]], {"any_of": True}), ([["none"]], {}), ([["all", "rare"]], {})):
        assert _ranks(postings.best(index, phrases, 7, **more)) == _ranks(search.ranked(corpus, phrases, ["t"], **more), 7)


def test_two_writers_lose_nothing(spark, tmp_path):
    """A table that changed since it was read is refused or made again; other tables pass; every version stays readable."""
    folder, rows = str(tmp_path / "store"), lambda *x: spark.createDataFrame([(k,) for k in x], "id long")
    first = store.save(spark, folder, {"a": rows(1), "b": rows(1)})
    assert store.save(spark, folder, {"b": rows(1, 2)}, based_on=first) == first + 1
    assert store.save(spark, folder, {"a": rows(1, 2)}, based_on=first) == first + 2  # only b had changed
    for tables, read in (({"a": rows(3)}, []), ({"c": rows(3)}, ["a"])):
        with pytest.raises(store.Conflict):
            store.save(spark, folder, tables, based_on=first, read=read)
    grown = lambda k: store.change(spark, folder, ["a"], lambda t: {"a": t["a"].unionByName(rows(k))})
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(grown, range(10, 14)))
    assert sorted(r.id for r in store.load(spark, folder, ["a"])["a"].collect()) == [1, 2, 10, 11, 12, 13] and len(set(numbers)) == 4
    assert [r.id for r in store.load(spark, folder, number=first)["a"].collect()] == [1] and store.version(spark, folder) == max(numbers)
    with pytest.raises(KeyError):
        store.load(spark, folder, ["nothing"])
    assert not catalog.commit(spark, folder, first, {})


def test_small_helpers(spark, tmp_path):
    tags = spark.createDataFrame([(1, "vip"), (2, "investor"), (3, "in-town")], TAGS)
    links = spark.createDataFrame([(7, 2)], CONTACT_TAGS)
    assert [r.name for r in C.tags_left(tags, links, 7, "IN").collect()] == ["in-town"] and C.tags_left(tags, links, 8).count() == 3
    shown = lambda x: value(spark, D.shown(F.lit(x).cast("string")))
    assert [shown(x) for x in ("2023-03-14", " 2023-12-01T08:00:00Z", "2023-02-30", "x", None)] == ["14. Mrz 2023", "1. Dez 2023", "–", "–", "–"]
    assert value(spark, D.shown_birthday(F.lit("--03-14"))) == "14. Mrz" and value(spark, D.shown_birthday(F.lit("--13-14"))) == "–"
    assert value(spark, D.is_iso(F.lit("2023-02-30"))) is False and value(spark, D.input_day(F.lit("--03-14"))) == ""
    code = value(spark, X.referral_code(F.lit("a@x.org")))
    assert len(code) == 8 and set(code) <= set(X.CODE_SIGNS) and code == value(spark, X.referral_code(F.lit("a@x.org")))
    contacts = people(spark, [{"id": 4, "name": "Ann Lee", "company": "Acme"}, {"id": 2, "name": "ann  lee", "company": None}])
    more = spark.createDataFrame([("ANN LEE", "acme"), ("Bo", None), ("bo", "")], "name string, company string")
    assert sorted(r.id for r in mutations.seed(contacts, more, "2025").collect()) == [2, 4, 5]
    assert [r.id for r in mutations.unseed(contacts, more).collect()] == [4]
    pairs = spark.createDataFrame([("Ann Lee", "nobody", "x"), ("ann lee", "ANN LEE", "y")], "name_a string, name_b string, note string")
    assert [(r.a, r.b, r.note) for r in C.named_pairs(contacts, pairs).collect()] == [(2, 2, "y")]
    assert mapping.decoded(mapping.coded({"Vorname": "first_name", "Ä": "nonsense"})) == {"Vorname": "first_name", "Ä": "ignore"}
    assert [r.position for r in numbered(spark.range(5000).repartition(7), [F.desc("id")]).orderBy(F.desc("id")).collect()] == list(range(1, 5001))


def test_imports_that_keep_arriving(spark, tmp_path):
    store.save(spark, str(tmp_path / "net"), {"contacts": people(spark, [{"id": 1, "name": "Ann Lee"}])})
    inbox = tmp_path / "inbox"
    for k, rows in enumerate([[(1, "Ann Lee", "ann@x.org"), (2, "Bo", "bo@x.org")], [(1, "BO", None), (2, "Cy", None)]]):
        spark.createDataFrame(rows, "row_number long, Name string, `E-Mail` string").coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema("row_number long, Name string, `E-Mail` string").option("maxFilesPerTrigger", 1).parquet(str(inbox))
        query = imports.follow(spark, stream, str(tmp_path / "net"), str(tmp_path / "checkpoint"), lambda: "2025-01-01")
        query.processAllAvailable()
        query.stop()
    after = store.load(spark, str(tmp_path / "net"), ["contacts"])["contacts"].orderBy("id").collect()
    assert [(r.id, r.name, r.email) for r in after] == [(1, "Ann Lee", None), (2, "Bo", "bo@x.org"), (3, "Cy", None)]


def test_rate_limit_of_a_stream(spark, tmp_path):
    rows = [(k % 2, datetime(2024, 1, 1) + timedelta(minutes=k * 7)) for k in range(40)]
    batch = spark.createDataFrame([(k, u, at) for k, (u, at) in enumerate(rows)], "id long, user long, at timestamp")
    wanted = sorted((r.user, r.at, r.accepted) for r in rates.limited(batch, "user", "at", "id", limit=2).collect())
    spark.createDataFrame(rows, "user long, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rates.limited_stream(spark.readStream.schema("user long, at timestamp").parquet(str(tmp_path / "in")), "user", "at", limit=2)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    for _ in range(60):  # batches without rows go on for ever: they clear state
        if query.awaitTermination(1) or (query.lastProgress or {"batchId": 0})["batchId"] >= 1:
            break
    query.stop()
    assert sorted((r.user, r.at, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == wanted and {a for _, _, a in wanted} == {True, False}


def test_rate_limit_of_a_stream_out_of_order(spark, tmp_path):
    """A key of 30,000 hits in one batch, more than an Arrow batch has, ties, and late hits over batches: as the batch form decides."""
    random, start = np.random.default_rng(14), datetime(2024, 1, 1)
    schema = "id long, user string, at timestamp"
    hot = [(k, "hot", start + timedelta(seconds=int(random.integers(0, 30_000)))) for k in range(30_000)]
    late = [(40_000 + k, f"u{k % 3}" if k % 7 else None, start + timedelta(seconds=int(min(30_000, max(0, 100 * k + random.integers(-1500, 1500)))))) for k in range(300)]
    end = [(99_999, "end", start + timedelta(days=3))]
    batches = [hot[:100] + late[:100], late[100:200], late[200:], hot[100:], end]
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
        (file,) = (tmp_path / f"made{k}").glob("*.parquet")
        file.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = rates.limited_stream(stream, "user", "at", "id", limit=3, window=600, delay="10 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    got = {r.id: (r.user, r.at, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    wanted = {r.id: (r.user, r.at, r.accepted) for r in rates.limited(spark.createDataFrame(hot + late, schema), "user", "at", "id", limit=3, window=600).collect()}
    assert {k: v for k, v in got.items() if k != 99_999} == wanted


def test_waitlist_entries(spark):
    """Numbers of several plans in national and international form, addresses, and what is neither."""
    cases = [
        ("0664 1234567", "+436641234567"), ("664 1234567", "+436641234567"), ("+43 (0) 664/123 45 67", "+436641234567"), ("0043-1-5880180", "+4315880180"), ("+49 (0)30 901820", "+4930901820"), ("+49 030 901820", "+4930901820"),
        ("+39 06 6982", "+39066982"), ("+1 (212) 155-0123", None), ("+1 212 555 2123", "+12125552123"), ("+41 44 668 18 00", "+41446681800"), ("+423 236 60 00", "+4232366000"), ("+420 221 714 444", "+420221714444"), ("+36 06 1 234 5678", None),
        ("+999 123456", None), ("0664", None), ("+43", None), ("++43 664 1234567", None), ("0664 12a4567", None), ("", None), (None, None), ("  ", None), ("(01) 5880180", "+4315880180"), ("+44 20 7946 0958", "+442079460958"),
    ]
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "id int, raw string")
    got = {r.id: r.n for r in rows.select("id", phones.e164(F.col("raw")).alias("n")).collect()}
    assert [(x, got[k]) for k, (x, _) in enumerate(cases)] == cases
    entries = spark.createDataFrame([(" A.b@X.Org ",), ("a@b",), ("0664 1234567",), ("a b@x.org",)], "raw string").select("raw", phones.waitlist_entry(F.col("raw")).alias("e"))
    assert {r.raw: r.e and tuple(r.e) for r in entries.collect()} == {" A.b@X.Org ": ("email", "a.b@x.org"), "a@b": None, "0664 1234567": ("phone", "+436641234567"), "a b@x.org": None}
    assert spark.range(1).select(phones.e164(F.lit("030 901820"), "DE").alias("n")).first().n == "+4930901820"


def embedded(url):
    return sqlite3.connect(url, timeout=60)


def test_database_upsert(spark, tmp_path):
    """New keys are inserted once, known ones return what is stored; a task that ran twice counts once; what failed leaves nothing."""
    url = str(tmp_path / "list.db")
    with embedded(url) as c:
        c.execute("create table waitlist (position integer primary key autoincrement, email text, code text)")
        c.execute("create unique index by_email on waitlist (lower(email)) where email is not null")
        c.execute("insert into waitlist (email, code) values ('Old@x.org', 'OLD'), (null, 'NONE')")
    rows = spark.createDataFrame([(k, None if k == 7 else f"{'N' if k % 2 else 'n'}{k // 2}@x.org" if k < 40 else "OLD@X.ORG", f"C{k}") for k in range(42)], "k long, email string, code string").repartition(5)
    call = lambda df: database.upsert(spark, df, "tests.test_network:embedded", url, "waitlist", "lower(email)", "k", "position long, email string, code string", where="email is not null")
    got = {r.k: r for r in call(rows).collect()}
    assert sorted(got) == [k for k in range(42) if k != 7]
    assert all(r.duplicate == (k % 2 == 1 or k >= 40) and r.code == ("OLD" if k >= 40 else f"C{k - k % 2}") for k, r in got.items())
    again = call(rows).collect()
    assert all(r.duplicate and r.position == got[r.k].position for r in again)
    with embedded(url) as c:
        assert c.execute("select count(*) from waitlist").fetchone() == (22,) and [r[0] for r in c.execute("select name from sqlite_master where name like 'stage%'")] == []
    # Two attempts of one task and one of another: only what the commit names is inserted.
    options = {"connect": "tests.test_network:embedded", "url": url, "table": "waitlist", "stage": "stage_x", "key": "lower(email)", "where": "email is not null"}
    writer = database.UpsertSource(options).writer(spark.createDataFrame([], "email string, code string, seq_ long").schema, False)
    writer.tables.open()
    writer.write(iter([("twice@x.org", "T1", 1), ("lost@x.org", "L", 2)]))
    done = [writer.write(iter([("twice@x.org", "T2", 1)])), writer.write(iter([])), None]
    writer.commit(done)
    writer.tables.drop()
    with embedded(url) as c:
        assert c.execute("select email, code from waitlist where email in ('twice@x.org', 'lost@x.org')").fetchall() == [("twice@x.org", "T2")]
    with pytest.raises(Exception):
        call(rows.withColumn("email", F.expr("if(k = 3, raise_error('broken'), 'fresh@x.org')")))
    with embedded(url) as c:
        assert c.execute("select count(*) from waitlist where email = 'fresh@x.org'").fetchone() == (0,)


def test_calls_of_a_detail_page(spark, tmp_path):
    """Reopening, editing and deleting items, status, untagging, disconnecting; what a call hands out; a preview before an import."""
    names = {"contacts": CONTACTS, "needs": ITEMS, "offers": ITEMS, "notes": NOTES, "tags": TAGS, "contact_tags": CONTACT_TAGS, "connections": CONNECTIONS}
    net = {k: spark.createDataFrame([], v) for k, v in names.items()}
    net |= {"contacts": people(spark, [{"id": 1, "name": "Zoe", "stage": "new"}, {"id": 2, "name": "Al", "stage": "close"}]), "needs": items(spark, [(1, 1, "late", "2024-02-01", "2024-03-01"), (2, 1, "open", "2024-01-01", None)]), "offers": items(spark, [(5, 2, "help", "2024-01-01", None)])}
    net |= {"tags": spark.createDataFrame([(7, "vip")], TAGS), "contact_tags": spark.createDataFrame([(1, 7)], CONTACT_TAGS), "connections": spark.createDataFrame([(3, 1, 2, None, "2024")], CONNECTIONS), "notes": spark.createDataFrame([(9, 1, "secret", "2024-01-05", "2024")], NOTES)}
    rows = lambda net, table: [tuple(r) for r in net[table].orderBy("id" if "id" in net[table].columns else "tag_id").collect()]
    assert [r[4] for r in rows(api.set_item_resolved(net, "needs", 1, None), "needs")] == [None, None]
    assert rows(api.set_item_resolved(net, "offers", 5, "2025"), "offers")[0][4] == "2025" and rows(api.set_item_text(net, "offers", 5, " new "), "offers")[0][2] == "new"
    for table, k in (("needs", 2), ("offers", 5), ("notes", 9), ("connections", 3)):
        assert k not in [r[0] for r in rows(api.delete_item(net, table, k), table)]
        with pytest.raises(LookupError):
            api.delete_item(net, table, 99)
    assert api.set_status(net, 1, "archived", "2025")["contacts"].where("status = 'archived'").count() == 1 and rows(api.untag_contact(net, 1, 7), "contact_tags") == []
    assert [r.name for r in api.search_tags(net, "VI").collect()] == ["vip"] and [(r.stage, r.id) for r in api.board(net).where("id is not null").orderBy("id").collect()] == [("new", 1), ("close", 2)]
    detail = api.get_contact(net, 1, include_notes=True)
    plain, noted = (json.loads(C.shaped(detail, notes).first().json) for notes in (False, True))
    assert plain["needs"] == [{"id": 2, "text": "open", "open": True}, {"id": 1, "text": "late", "open": False, "resolved_at": "2024-03-01"}] and plain["tags"] == ["vip"] and plain["offers"] == [] and "notes" not in plain and "company" not in plain
    assert noted["notes"] == [{"id": 9, "occurred_on": "2024-01-05", "body": "secret"}]
    found = spark.createDataFrame([(1, 2, [("offer", "help", "he")])], "place int, id long, matched_on array<struct<kind:string,text:string,term:string>>")
    assert json.loads(C.shaped_matches(found, net["contacts"]).first().json) == {"contact": {"id": 2, "name": "Al", "stage": "close"}, "matched_on": [{"kind": "offer", "text": "help", "term": "he"}]}
    path = tmp_path / "new.csv"
    path.write_text("First Name,E-Mail,Connected On,x\n" + "Al,al@x.org,2024-01-01,1\n" * 12 + ",,,\nZoe,bad,soon,2\n")
    seen = api.preview_import(spark, str(path))
    assert seen["headers"] == ["First Name", "E-Mail", "Connected On", "x"] and seen["total_rows"] == 13 and seen["rows"].count() == 10 and not seen["suggestion"].confident and seen["suggestion"].unmapped == ["x"]
    _, outcomes = api.import_file(net, spark, str(path), "2025", dry_run=True)
    mapped = mapping.map_rows(tabular.read(spark, str(path))[0], seen["suggestion"].mapping)
    lines = Counter(r.section for r in resolve.report(outcomes, mapped).collect())
    assert lines == {"skipped": 13, "name_matches": 13, "dropped": 2}  # a match by name writes no e-mail, so the next row finds none
    for name, fault in (("a.txt", "extension"), ("none.csv", "empty"), ("new.csv", "larger")):
        (tmp_path / "none.csv").write_text("")
        with pytest.raises(ValueError, match=fault):
            tabular.check_upload(spark, str(tmp_path / name), 10)


def test_more_helpers(spark, tmp_path):
    shown = lambda x: value(spark, D.shown_time(F.lit(x).cast("string")))
    assert [shown(x) for x in ("2023-03-14T09:12:31Z", "2023-03-14", "2023-02-30", None)] == ["14. Mrz 2023, 09:12", "14. Mrz 2023, 00:00", "–", "–"]
    assert value(spark, label(F.lit("new"))) == "Neu" and value(spark, label(F.lit("?"))) == "?"
    store.append_json_lines(spark.range(3), str(tmp_path / "lines"))
    lines = store.read_json_lines(spark, str(tmp_path / "lines"), "id long")
    store.replace_json_lines(lines.where("id > 0"), str(tmp_path / "lines"))
    assert sorted(r.id for r in store.read_json_lines(spark, str(tmp_path / "lines"), "id long").collect()) == [1, 2]
    entries = spark.createDataFrame([(k, f"e{k % 15}@x.org") for k in range(30)], "k long, email string")
    taken = entries.where("k = 0").select(X.referral_code(F.col("email")).alias("referral_code"))
    codes = [r.referral_code for r in mutations.with_codes(entries.select(F.concat("email", F.lit("")).alias("email")).distinct(), "email", taken).collect()]
    assert len(set(codes)) == 15 and taken.first().referral_code not in codes
    notes = spark.createDataFrame([([(1, "2024-01-01", "a"), (2, None, "z"), (3, "2024-02-01", "a"), (4, "2024-02-01", "b")],)], "n array<struct<note_id:long,occurred_on:string,created_at:string>>")
    assert [x.note_id for x in notes.select(C.sorted_notes(F.col("n")).alias("n")).first().n] == [4, 3, 1, 2]
