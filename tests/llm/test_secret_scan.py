from __future__ import annotations

import hashlib
import random
import re

import duckdb

from siltstone.llm import secret_scan
from tests.agree import assert_agree
from tests.llm import fixtures

ASSIGN = re.compile(r"((?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r"))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text: str):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def label(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def texts(n: int = 250) -> list[str]:
    r = random.Random(8)
    pieces = ["password", "Secret", "API_KEY", "apikey", "token", "=", ": ", "'", '"', " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 4, "short", "longer-value.1", "é", "𝒳", "\n", "eyJ", "ghp_" + "a1" * 20, "xoxb-12345678901", "passwordpassword"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_spans_of_every_document(spark):
    rows = fixtures.awkward() + [fixtures.row(1000 + i, t) for i, t in enumerate(texts())]
    got = scanned(spark, rows).collect()
    assert len(got) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1] or "")
    for r in got:
        want = []
        for t in by[r.doc_id]:
            spans = brute(t)
            want.append((*[sum(k == x for _, x, _ in spans) for k in range(3)], hashlib.sha256(label(spans).encode()).hexdigest()))
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in want
        base = [label(brute(t)).split(",") if brute(t) else [] for t in by[r.doc_id]]
        assert any(set(b) <= set(r.spans.split(",")) for b in base)


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = fixtures.awkward() + [fixtures.row(1000 + i, t) for i, t in enumerate(texts())]
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in rows])
    assert_agree(scanned(spark, rows), con, secret_scan.oracle_sql())


def scanned(spark, rows, folder=None):
    return secret_scan.scan_versions(fixtures.frame(spark, rows), folder or secret_scan.new_ledger(spark))


def test_ledger_scans_unseen_blobs_only(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "ledger")
    ledger = lambda: secret_scan.read_ledger(spark, folder).collect()
    scanned(spark, [fixtures.row(1, "token=abcdefgh1"), fixtures.row(2, "nothing")], folder)
    assert len(ledger()) == 2
    second = [fixtures.row(3, "token=abcdefgh1"), *[fixtures.row(4, "secret: abcdefgh2")] * 5, fixtures.row(5, "secret: abcdefgh2")]
    findings = scanned(spark, second, folder)
    assert len(ledger()) == 3  # one blob was new, and stands in six rows
    assert sorted((r.doc_id, r.n_assign) for r in findings.collect()) == [(3, 1), *[(4, 1)] * 5, (5, 1)]
    scanned(spark, second, folder)
    assert len(ledger()) == 3
    # a rule's new version is the only one scanned for, and its old findings no longer count
    monkeypatch.setitem(secret_scan.VERSIONS, "assign", 2)
    monkeypatch.setattr(secret_scan, "BASE", [("assign", secret_scan.KEYWORD + r"(:\x20[a-z0-9]+)", 8, None), *secret_scan.BASE[1:]])
    findings = scanned(spark, second, folder)
    assert sorted((r.doc_id, r.n_assign) for r in findings.collect()) == [(3, 0), *[(4, 1)] * 5, (5, 1)]
    assert sorted(r.scanned for r in ledger())[-2:] == [["assign@2"]] * 2 and len(ledger()) == 5


def test_a_blob_scanned_twice_counts_once(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    row = [fixtures.row(1, "token=abcdefgh1")]
    scanned(spark, row, folder)
    secret_scan.read_ledger(spark, folder).coalesce(1).write.mode("append").parquet(folder)
    assert [r.n_assign for r in scanned(spark, row, folder).collect()] == [1]


def test_main_path_is_native(spark):
    plan = scanned(spark, fixtures.awkward())._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    assert scanned(spark, []).count() == 0
