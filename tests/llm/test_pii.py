"""Spans against Python's own matching of the base patterns, planted cases, and redaction."""
from __future__ import annotations

import hashlib
import re

import pytest

from gridloom.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


TEXTS = [None, "", "a", "no data here", "a@b.c_d@e.fg, x@y z@w.de a@b@c.de é@é.de", "mail ünïcode.x@host.example.org.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.255 1.1.1.99999999999999",
         "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111  1111", "+49 (30) 123-45.67 +1 +12 3 +1(((((((2", "日本 4012888888881881 🎉 +1 (235) 555-3833",
         "1" * 3000, "@" * 500 + "a" * 3000, ("x@y.zz 10.0.0.1 " * 300), "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and GB82WEST12345698765433",
         'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "social 123-45-6789 or 123-45-6789", "$1 \\1 \n\t +1 235 555 3833\n"]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    return {r.doc_id: r for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_base_spans(found, i):
    spans = brute(TEXTS[i])
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    row = found[i]
    assert [row[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]
    assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert row.spans.startswith(want)


def test_added_kinds(found):
    kinds = lambda i: [s.split(":")[0] for s in found[i].spans.split(",") if s and s.split(":")[0] not in BASE]
    assert kinds(13) == ["iban", "iban"] and kinds(14) == ["secret"] and kinds(15) == [] and kinds(16) == ["national"]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.base_sha256 for r in pii.digests(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(r.text))
        assert got[r.doc_id] == hashlib.sha256(want.encode()).hexdigest()


def test_redact(spark):
    rows = [(1, "write to a.b@c.de now", 21, "x"), (2, None, None, "x"), (3, "clean", 5, "x"), (4, "a@b.de 10.0.0.1", 15, "x"), (4, "a@b.de 10.0.0.1", 15, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _findings string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.n_chars or 0) for r in out.collect()) == [
        (1, "write to [EMAIL] now", 20), (2, "", 0), (3, "clean", 5), (4, "[EMAIL] [IP]", 12), (4, "[EMAIL] [IP]", 12)]
    assert pii.redact(docs.limit(0)).count() == 0 and pii.digests(docs.limit(0)).count() == 0


def plain_redaction(text):
    """Base kinds only: a text without the added ones."""
    out, at = [], 0
    for start, back, kind in sorted((a, -b, k) for k, a, b in brute(text)):
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, -back)
    return "".join(out) + text[at:]


def test_many_matches_in_one_text(spark):
    n = pii.BLOCK
    texts = [("é x@y.zz" + " 10.0.0.1 a.b@c.de" * k)[:cut] for k in (n - 1, n, n + 1, 3 * n) for cut in (None, -1, -4)]
    texts += ["1." * 50_000, "+1 235 555 3833@a.bc 4111 1111 1111 1111\n" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digests(docs).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    for r in pii.redact(docs).collect():
        assert r.text == plain_redaction(texts[r.doc_id])


def test_a_hundred_thousand_addresses(spark):
    text = "".join(f"name{i}@host.example.org, " for i in range(100_000))
    row = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.text == "[EMAIL], " * 100_000


def test_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
