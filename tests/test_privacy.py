import re

import pytest
from pyspark.sql import functions as F

from sluice.functions.text import plain_text
from sluice.operators import anonymize, pii


MASKED = {
    "jane@mail.com": "j***@m***.com",
    "a@b": "a*@b*",
    "x@y.z.org": "x*@y**.org",
    "a@b@c.de": "a**@c*.de",
    "@home.de": "@*@h***.de",
    "x@": "x*@*",
    "": "",
    "a": "*",
    "ab": "**",
    "abc": "a*c",
    "Zoë Ångström": "Z**********m",
}


def test_masks(spark):
    df = spark.createDataFrame([(t,) for t in MASKED], "t string")
    assert {r["t"]: r["m"] for r in df.select("t", anonymize.mask(F.col("t")).alias("m")).collect()} == MASKED


def test_every_value_pattern(spark):
    hits = [
        "mail jo@x.org", "555-123-4567", "123-45-6789", "4111111111111111", "5111111111111118", "341111111111111",
        "1234-5678-9012-3456", "10.0.0.255", "DE89ABCD1234567", "90210-1234", "1999/12/31", "+1 (555) 123-4567",
    ]
    df = spark.createDataFrame([(h,) for h in hits] + [("plain words",), ("v1.2",)], "t string")
    row = pii.value_matches(df).first()
    want = [sum(bool(re.search(rule[0], h)) for h in hits) for rule in pii.VALUE_RULES]
    assert [row[f"m{j + 1}"] for j in range(12)] == want
    assert all(n > 0 for n in want)


@pytest.mark.parametrize(
    "name,category,severity",
    [
        ("shipping_zip", "contact", "high"), ("message", "quasi_identifier", "low"), ("User_SSN", "national_id", "critical"),
        ("salary_band", "financial", "high"), ("total", None, None),
    ],
)
def test_names(spark, name, category, severity):
    hit = spark.range(1).select(pii.name_signal(F.lit(name)).alias("h")).first()["h"]
    assert (hit and hit["category"], hit and hit["severity"]) == (category, severity)


def test_findings_join_both_signals(spark):
    rows = [(i, f"p{i}@x.org" if i % 2 else None, f"note {i}") for i in range(20)]
    found = {r["column"]: r for r in pii.findings(spark.createDataFrame(rows, "id int, email string, n string"), "id").collect()}
    assert set(found) == {"email"}
    assert found["email"]["detection_method"] == "name_and_value"
    assert found["email"]["confidence"] == pytest.approx(min((0.92 + 0.95) / 2 + 0.05, 1.0), abs=1e-3)
    assert found["email"]["sample_values"] == ["p***@x***.org"] * 3


def test_generalize_chooses_by_content(spark):
    df = spark.createDataFrame([(1, "15", "x"), (2, "-1", "x"), (3, None, "y"), (4, "9.5", "z")], "id int, a string, b string")
    out = anonymize.anonymize(
        df, [{"column": "a", "method": "generalize"}, {"column": "b", "method": "generalize", "params": {"top_n": 2}}]
    )
    got = [(r["a"], r["b"]) for r in out.orderBy("id").collect()]
    assert got == [("10–19", "x"), ("-10–-1", "x"), (None, "y"), ("0–9", "Other")]


def test_pseudonyms_follow_first_appearance(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, None), (4, "c"), (5, "a")], "id int, v string").repartition(4)
    out = anonymize.anonymize(df, [{"column": "v", "method": "pseudonymize"}], "id").orderBy("id").collect()
    assert [r["v"] for r in out] == ["ID-00001", None, "ID-00002", "ID-00001", "ID-00003"]


def test_large_doubles_are_written_out(spark):
    df = spark.createDataFrame([(12345678.9,), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(plain_text(df, "x")).collect()] == ["12345678.9", "1.5", None]
