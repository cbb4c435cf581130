"""Detectors and risk on literal rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilgrid.functions import fixed, text
from veilgrid.operators import detect, risk
from veilgrid.sources.generate import check_digit

HINTS = ("has_email", "has_phone", "has_password", "has_financial", "has_medical", "has_government", "has_birth", "has_user")


def found(spark, value, mode="lib", page_type=None, **hints):
    df = spark.createDataFrame([(1, value)], "doc_id long, text string")
    h = None
    if hints or page_type:
        h = F.struct(*[F.lit(hints.get(n, False)).alias(n) for n in HINTS], F.lit(page_type or "unknown").alias("page_type"))
    return {(r.type, r.value): r.confidence for r in detect.detect(df, mode=mode, hints=h).collect()}


CASES = [
    ("Email: alice.johnson@securemail.net", {}, ("EMAIL", "alice.johnson@securemail.net"), 0.9),
    ("Email: alice.johnson@securemail.net", {"has_email": True}, ("EMAIL", "alice.johnson@securemail.net"), 0.98),
    ("dev@github.com", {}, ("EMAIL", "dev@github.com"), 0.7),
    ("x@example.org", {}, ("EMAIL", "x@example.org"), 0.9),
    ("Phone: 555-123-4567", {}, ("PHONE", "555-123-4567"), 0.85),
    ("Phone: 555-123-4567", {"has_phone": True}, ("PHONE", "555-123-4567"), 0.95),
    ("Card on file: 4111 1111 1111 1111", {}, ("CREDIT_CARD", "4111 1111 1111 1111"), 0.95),
    ("123-45-6789", {}, ("GOVERNMENT_ID", "123-45-6789"), 0.92),
    ("123-45-6789", {"has_government": True}, ("GOVERNMENT_ID", "123-45-6789"), 0.98),
    ("ABCDE1234F", {}, ("GOVERNMENT_ID", "ABCDE1234F"), 0.9),
    ("sk_live_" + "a" * 32, {}, ("API_KEY", "sk_live_" + "a" * 32), 0.95),
    ("ghp_0123456789abcdefghij", {}, ("API_KEY", "ghp_0123456789abcdefghij"), 0.98),
    ("Bearer abcdefghij0123456789", {}, ("AUTH_TOKEN", "Bearer abcdefghij0123456789"), 0.95),
    ("MRN-12345678", {}, ("MEDICAL_ID", "MRN-12345678"), 0.88),
    ("MRN-12345678", {"has_medical": True}, ("MEDICAL_ID", "MRN-12345678"), 0.95),
    ("Routing: 011401533", {"has_financial": True}, ("BANK_ACCOUNT", "Routing: 011401533"), 0.82),
    ("123 Main St, Springfield, CA 93801", {}, ("ADDRESS", "123 Main St, Springfield, CA 93801"), 0.88),
    ("$1,250.00", {}, ("FINANCIAL_DATA", "$1,250.00"), 0.45),
    ("€250,000.00", {}, ("FINANCIAL_DATA", "€250,000.00"), 0.65),
    ("01/15/1990", {}, ("DATE_OF_BIRTH", "01/15/1990"), 0.55),
    ("01/15/1990", {"has_birth": True}, ("DATE_OF_BIRTH", "01/15/1990"), 0.9),
    ("jsmith88", {"has_user": True, "page_type": "login"}, ("USERNAME", "jsmith88"), 0.85),
    ("hunter2!", {"has_password": True}, ("PASSWORD", "hunter2!"), 0.95),
]


@pytest.mark.parametrize(("value", "hints", "key", "confidence"), CASES)
def test_vectors(spark, value, hints, key, confidence):
    assert found(spark, value, **hints).get(key) == pytest.approx(confidence)


@pytest.mark.parametrize("value", ["admin@corp.io", "x@test.com", "Nothing sensitive here, just a sunny afternoon.", "", "   ", None])
def test_nothing(spark, value):
    assert not [k for k in found(spark, value) if k[0] != "USERNAME"]


def test_modes_differ_where_the_rules_do(spark):
    assert ("EMAIL", "x@example.org") not in found(spark, "x@example.org", "rt")
    key = "sk_live_" + "a" * 32
    assert not [k for k in found(spark, key, "rt") if k[0] == "API_KEY"]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3.abcdefghijkl"
    assert ("AUTH_TOKEN", jwt) not in found(spark, jwt) and found(spark, jwt, "rt")[("AUTH_TOKEN", jwt)] == 0.7
    amex = "378282246310005"
    assert ("CREDIT_CARD", amex) not in found(spark, amex) and ("CREDIT_CARD", amex) in found(spark, amex, "strict")
    card = "4111111111111111"
    assert [k for k in found(spark, card) if k[0] == "PHONE"] and not [k for k in found(spark, card, "strict") if k[0] == "PHONE"]


def test_boundaries_are_ascii(spark):
    assert ("CREDIT_CARD", "4111111111111111") in found(spark, "é4111111111111111é")
    assert ("PHONE", "555 123 4567") in found(spark, "call 555 123 4567")


@settings(max_examples=15, deadline=None)
@given(st.text("0123456789", min_size=12, max_size=18))
def test_luhn(spark, body):
    number = body + check_digit(body)
    wrong = body + str((int(number[-1]) + 1) % 10)
    df = spark.createDataFrame([(number, wrong)], "a string, b string")
    assert tuple(df.select(text.luhn(F.col("a")), text.luhn(F.col("b"))).first()) == (True, False)


def test_risk_vectors(spark):
    df = spark.createDataFrame([("EMAIL", 0.9, ""), ("PHONE", 0.85, ""), ("CREDIT_CARD", 0.95, ""), ("ODD", 2.0, "secret")], "type string, confidence double, context string")
    got = {r.type: (round(r.overall, 6), r.level) for r in risk.score(df, F.lit("unknown"), "rt").collect()}
    assert got["EMAIL"] == (0.64, "HIGH") and got["PHONE"] == (0.6275, "HIGH") and got["CREDIT_CARD"] == (0.7125, "HIGH")
    assert got["ODD"][0] == pytest.approx(0.15 + 0.25 + 0.08 + 0.045 + 0.1 * (0.5 + 0.5 * 0.3215127), abs=1e-5)


def test_weights():
    assert risk.weights() == fixed.WEIGHTS
    assert sum(risk.weights(dom_context=0.9).values()) == pytest.approx(1)


@pytest.mark.parametrize(("a", "b", "want"), [("x", "x", 1.0), ("555-123-4567", "555 123 4567", 0.95), ("abc", "xabcx", 0.7), ("1234567890", "0987654321", 1.0), ("", "a", 0.0), ("abcd", "abce", 0.75)])
def test_fuzzy(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(text.fuzzy(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_classifier_addition(spark):
    from veilgrid.operators import models

    rows = spark.createDataFrame([(1, "Bob Ray"), (2, "x@post.net"), (3, "plain")], "doc_id long, text string")
    got = detect.detect(rows, categories=("EMAIL",))
    p = spark.createDataFrame([(1, "Bob Ray", "NAME", 0.7), (2, "x@post.net", "EMAIL", 0.9), (3, "plain", "NONE", 0.9)], "doc_id long, text string, label string, score double")
    out = {(r.doc_id, r.type, r.source, r.confidence) for r in models.add_classified(got, p, ("doc_id",)).collect()}
    assert out == {(1, "NAME", "CLASSIFIER", 0.8), (2, "EMAIL", "REGEX", 0.9)}


def test_first_of_many_matches_in_order(spark):
    """Repeated values count once, at their first place; a text with very many ends soon."""
    numbers = [f"555-{k % 5000:03d}-{k % 5000:04d}" if k % 5000 < 1000 else f"{k % 5000:03d}-555-{k % 5000:04d}"[-12:] for k in range(20_000)]
    df = spark.createDataFrame([(1, ", ".join(numbers)), (2, ""), (3, None)], "doc_id int, text string")
    got = [r.value for r in detect.detect(df, categories=("PHONE",)).orderBy("pos").collect()]
    assert len(got) == len(set(got)) >= 1000
    text = df.first().text
    two = [r.value for r in detect.detect(spark.createDataFrame([(1, "b@x.org a@x.org b@x.org")], "doc_id int, text string"), categories=("EMAIL",)).orderBy("pos").collect()]
    assert two == ["b@x.org", "a@x.org"] and all(v in text for v in got)


def test_own_columns_dont_touch_the_callers(spark):
    df = spark.createDataFrame([("k", "p", "e", "a", "write to a@x.org")], "__context string, __pos string, __entity string, __at string, text string")
    got = detect.detect(df, keys=("__context", "__pos", "__entity", "__at")).collect()
    assert [tuple(r[:4]) + (r.value,) for r in got] == [("k", "p", "e", "a", "a@x.org")]
