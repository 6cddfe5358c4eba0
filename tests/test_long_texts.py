"""Texts of one repeated piece must neither end the JVM nor take more than linear time."""

import re
import time

import pytest
from pyspark.sql import functions as F

from ravelin.functions import identifiers
from ravelin.functions import text as T
from ravelin.operators import extraction


def one(spark, value, body):
    return spark.createDataFrame([(value,)], "t string").select(body(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("piece", ["a.", "a-", "a", ".", "-", "_", "a_", "ab.cd ", "é.", "1.", "http://", "x@", "CVE-2024-1\n", "\n", " ", "\\'", "[.]", "(dot)", "AS", "0123456789abcdef"])
def test_texts_of_one_piece(spark, piece):
    text = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    one(spark, text, lambda t: F.size(identifiers.facts(t)))
    one(spark, text, lambda t: F.size(identifiers.hashes(T.refang(t))))
    extraction.cve_candidates(spark.createDataFrame([(1, text)], "doc_id int, text string")).count()
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("kind", list(identifiers.SHAPES))
def test_long_values_have_a_shape_or_none(spark, kind):
    for value in ("u@" + "a." * 100_000 + "b", "a." * 100_000, "1." * 100_000, "https://" + "x" * 2_000, "https://" + "x" * 2_001, "f" * 100_000):
        assert one(spark, value, lambda v: identifiers.has_shape(F.lit(kind), v)) == bool(re.match(identifiers.SHAPES[kind], value)), value[:20]


@pytest.mark.parametrize("value", ["u@a.b", "u@a", "u@-a.b", "u@a..b", "u@a.b.", "u v@a.b", "@a.b", "u@" + "x" * 63 + ".c", "u@" + "x" * 64 + ".c", "u@@a.b", "u@a.b\n"])
def test_addresses_by_label(spark, value):
    assert one(spark, value, lambda v: identifiers.has_shape(F.lit("email"), v)) == bool(re.match(identifiers.SHAPES["email"], value))


@pytest.mark.parametrize("value", ["x" * 2_000, "'" * 1_500, "\\" * 1_999, "\\'" * 900, "", "a\\b'c", "= 'x'", "é" * 2_000])
def test_long_literals_come_back(spark, value):
    assert one(spark, value, lambda v: T.value_of_pattern(F.concat(F.lit("[url:value = '"), T.escape(v), F.lit("']")))) == value


@pytest.mark.parametrize("pattern", ["no literal", "[a = 'open", "[a = 'x' AND b = 'y']", r"[a = 'x\\' AND b = 'y']", r"[a = 'x\'y']", "[a = '']"])
def test_literals_as_by_pattern(spark, pattern):
    m = re.search(r"= '((?:[^'\\]|\\.)*)'", pattern)
    assert one(spark, pattern, T.value_of_pattern) == (m[1].replace("\\'", "'").replace("\\\\", "\\") if m else pattern)


def test_domains_as_by_pattern(spark):
    import random

    rng, shape = random.Random(4), re.compile(r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b")
    for _ in range(60):
        text = "".join(rng.choices(["a", "bc", "com", "x1", "9", "-", ".", ".", "..", "_", " ", "é", "/", "ñu", ",", "--", ".com", "-a.b"], k=60))
        want = [m.lstrip("-.") for m in shape.findall(text)]  # names don't begin with a hyphen
        assert one(spark, text, identifiers.domain_names) == [m for m in want if "." in m], text


def test_broken_ids(spark):
    text = "CVE-2024-12" + "\n34" * 3 + " x CVE-2024-1" + "\n2" * 9 + " y CVE-2024-1" + "\n2" * 10 + " z CVE-2024-" + "1\n" * 5_000
    found = extraction.cve_candidates(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert {r["id"] for r in found.collect()} == {"CVE-2024-12343434", "CVE-2024-1222222222"}
