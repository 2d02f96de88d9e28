"""The secret scan against Python's expressions."""

import hashlib
import re

import pytest

from rostrum.llm import secrets

SPECIAL = [
    'password = "abcdef123"; PASSWORD: x', "token=abc token: token: abcdefgh", "api_key='q1w2e3r4' apikey:zzzzzzzz API-KEY=1", "AKIA" + "Z" * 16 + " AKIAA " + "AKIAAKIA" + "9" * 20,
    "0123456789abcdef01234567 " + "f" * 23, "secret=" + "a" * 30 + "🙂 token = 🙂abcdef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-1234567890-abc", "https://me:pass1@host.example/x",
    "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "Authorization: Bearer abcdefghijklmnop123", "token=secret=abcdefgh password" + " " * 50 + "=" + " " * 9 + "hunter2",
]


def plain(text):
    """Base kinds from the contract's own expressions: (start, kind, end)."""
    kinds = (
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))


@pytest.fixture(scope="module")
def rows(spark, docs):
    more = spark.createDataFrame([(1000 + i, t, None, None, 0) for i, t in enumerate(SPECIAL * 2)], docs.schema)
    return docs.unionByName(more)


def test_matches_brute_force(rows, clash):
    got = secrets.scanned(clash(rows)).select("doc_id", "text", "secrets").collect()
    assert len(got) == rows.count()
    names = [r.kind for r in secrets.BASE]
    for r in got:
        found = [(s["start"], s["end"], s["kind"]) for s in r["secrets"]]
        assert found == secrets.brute_force(r["text"])
        assert [(a, names.index(k), b) for a, b, k in found if k in names] == plain(r["text"])
    assert {s["kind"] for r in got for s in r["secrets"]} == {r.kind for r in secrets.RULES}


def test_digest(spark, rows):
    one = rows.where("doc_id = 1000").limit(1)
    text = secrets.scanned(one).select(secrets.joined(secrets.F.col("secrets"))).first()[0]
    assert text == "assign:0:21"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_every_match_satisfies_its_trigrams(rule):
    for text in SPECIAL:
        for m in re.finditer(rule.pattern, text):
            low = m[0].lower()
            for clause in secrets.trigram_query(rule.pattern):
                assert any(all(t in low for t in option) for option in clause)


def test_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert secrets.trigram_query("AKIA[A-Z]+") == [[frozenset({"aki", "kia"})]]
    assert secrets.trigram_query("(abc|abd)x?") == [[frozenset({"abc"}), frozenset({"abd"})]]
    assert secrets.trigram_query("(abc)?x") == []


def test_no_rows(no_docs):
    assert secrets.scanned(no_docs).count() == 0
