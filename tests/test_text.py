"""String operators on edge cases, against plain Python string methods."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.functions.draws import choice, coin, draw
from pagemill.functions.messages import chat_text, stage_prompt, wi_messages

PAGES = [
    "",
    "one paragraph",
    "  # one paragraph kept as it is  ",
    "# a\n\n## b\n\nc",
    " # keeps its hash\n\n#drops it",
    "a\n\n",
    "\n\na",
    "\n\n",
    "a\n\n\nb",
    "a\n\n\n\nb",
    " # nbsp 　\n\n# em space \n\nlast\x1f",
    "{author} %s {0}\n\n${x}",
]


def rows(spark, values, schema="seq bigint, webpage string"):
    return spark.createDataFrame(list(enumerate(values)), schema)


def one(spark, values, column):
    return [r[0] for r in rows(spark, values).orderBy("seq").select(column).collect()]


def test_whitespace_is_what_python_strips():
    assert len(text.WHITESPACE) == 29
    assert all(not chr(c).isspace() for c in range(0x3001, 0x11000))


# A page, and its cleaned paragraphs; one paragraph alone stays as it is.
SECTIONS = [
    ("", None),
    ("# alone ", None),
    ("## Title\n\n text \n\n#last", ["Title", "text", "last"]),
    ("a#\n\n# # b", ["a#", "# b"]),
    ("\n\n\n\n", ["", "", ""]),
    (" #kept\n\nline\nline", ["#kept", "line\nline"]),
    ("\u00a0x\u3000\n\n#\ty", ["x", "y"]),
]


@pytest.mark.parametrize("method", text.SECTION_METHODS)
def test_section_is_a_prefix_of_the_cleaned_paragraphs(spark, method):
    cut = text.cut_sections(rows(spark, [page for page, _ in SECTIONS * 20]), method=method).orderBy("seq").collect()
    for (page, parts), row in zip(SECTIONS * 20, cut, strict=True):
        if parts is None:
            assert row.webpage == page
        else:
            assert row.webpage in ["\n\n".join(parts[: n + 1]) for n in range(len(parts))]


def test_gaussian_section_of_two_or_three_paragraphs_is_one(spark):
    cut = text.cut_sections(rows(spark, ["a\n\nb", "a\n\nb\n\nc"] * 30), method="gaussian").collect()
    assert {r.webpage for r in cut} == {"a"}


def test_unknown_section_method(spark):
    with pytest.raises(ValueError, match="section method"):
        text.cut_sections(rows(spark, PAGES), method="normal")


@pytest.mark.parametrize(
    "value, cleaned",
    [
        ("plain", "plain"),
        ('"quoted"', "quoted"),
        ('""a" b"', 'a" b'),
        ("Here is it", ""),
        ("Here is it:\n\nbody\n\nend", "body\n\nend"),
        ("Here's it:\n\n\"body\"", "body"),
        ("here is it\n\nbody", "here is it\n\nbody"),
        ("x Here is\n\nbody", "x Here is\n\nbody"),
        ('"Here is it\n\nbody"', "Here is it\n\nbody"),
    ],
)
def test_cleaning(spark, value, cleaned):
    assert one(spark, [value], text.clean_completion(F.col("webpage"))) == [cleaned]


@pytest.mark.parametrize(
    "value, stripped",
    [
        ("plain", "plain"),
        ("Improved Answer", ""),
        ("The IMPROVED answer:\n\n---\n\nbody\n\nend\n", "body\n\nend"),
        ("a\n\n--b--\n\nimproved answer", "b--\n\nimproved answer"),
        ("improved answer\n\n \n-body- ", "-body-"),
    ],
)
def test_stripping_the_lead_of_an_improved_answer(spark, value, stripped):
    assert one(spark, [value], text.strip_improved_lead(F.col("webpage"))) == [stripped]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='a#-"\n H ', max_size=30), min_size=20, max_size=60))
def test_properties_of_cleaning(spark, bodies):
    with_lead = ["Here's\n\n" + body for body in bodies]
    for body, got in zip(bodies, one(spark, with_lead, text.clean_completion(F.col("webpage"))), strict=True):
        assert got in body and not got.startswith('"') and not got.endswith('"')
    improved = ["The Improved ANSWER\n\n" + body for body in bodies]
    for body, got in zip(bodies, one(spark, improved, text.strip_improved_lead(F.col("webpage"))), strict=True):
        assert got in body and not got[:1].isspace() and not got[-1:].isspace()
    # Without a lead, only quotes go.
    plain = ["a" + body + "a" for body in bodies]
    assert one(spark, plain, text.clean_completion(F.col("webpage"))) == plain
    assert one(spark, plain, text.strip_improved_lead(F.col("webpage"))) == plain


@pytest.mark.parametrize(
    "request_text, response, kept",
    [
        ("q", "a", True),
        ("", "a", False),
        (None, "a", False),
        ("q", "", False),
        ("q", None, False),
        (" ", "\n", True),
        ("q", "I'm sorry, no", False),
        ("q", "I apologize", False),
        ("q", "i'm sorry", True),
        ("q", "I’m sorry", True),
        ("q", " I'm sorry", True),
        ("I'm sorry", "a", True),
    ],
)
def test_usable(spark, request_text, response, kept):
    df = spark.createDataFrame([(request_text, response)], "request string, response string")
    test = text.usable(F.col("request"), F.col("response"))
    assert df.filter(test).count() == kept
    assert df.select(F.when(test, 0).otherwise(1)).first()[0] == 1 - kept


def test_values_are_not_searched_for_placeholders(spark):
    out = one(spark, ["{b} 100% {{}}"], text.render("{a}|{b}|{a}", a=F.col("webpage"), b=F.lit("B")))
    assert out == ["{b} 100% {{}}|B|{b} 100% {{}}"]


def test_null_values_are_spelled_out(spark):
    assert one(spark, [None], text.render("<{a}>", a=F.col("webpage"))) == ["<None>"]


def test_unknown_category_fails_the_job(spark):
    prompt = stage_prompt(
        "request", category=F.lit("WX"), web=F.col("webpage"), author=F.lit("a"), key=F.col("seq")
    )
    with pytest.raises(Exception, match="no prompt for category WX"):
        rows(spark, ["p"]).select(prompt).collect()


def test_stage_is_checked_before_planning(spark):
    with pytest.raises(ValueError, match="stage"):
        stage_prompt("summary", web=F.col("webpage"))
    with pytest.raises(ValueError, match="lacks a column"):
        stage_prompt("response", web=F.col("webpage"))
    with pytest.raises(ValueError, match="chat template"):
        chat_text(F.col("webpage"), "mistral")


def test_distributions(spark):
    n = 20_000
    key = F.col("id")
    got = spark.range(n).select(
        F.avg(coin("side", key).cast("int")).alias("coin"),
        F.avg(draw("x", key)).alias("draw"),
        *[F.avg((choice(["a", "b", "c"], "word", key) == w).cast("int")).alias(w) for w in "abc"],
        *[F.avg((text.section_length(F.lit(k), key) == k).cast("int")).alias(f"full{k}") for k in (2, 5)],
        F.avg(text.section_length(F.lit(20), key, "gaussian")).alias("gaussian"),
        F.min(text.section_length(F.lit(20), key, "gaussian")).alias("gaussian_min"),
        F.max(text.section_length(F.lit(20), key, "gaussian")).alias("gaussian_max"),
    ).first()
    assert abs(got.coin - 0.5) < 0.015 and abs(got.draw - 0.5) < 0.01
    assert all(abs(got[w] - 1 / 3) < 0.015 for w in "abc")
    assert abs(got.full2 - 0.75) < 0.015 and abs(got.full5 - 0.6) < 0.015
    assert abs(got.gaussian - 10) < 0.2 and got.gaussian_min == 1 and got.gaussian_max == 20


def test_page_is_on_either_side_of_the_request(spark):
    messages = wi_messages(F.lit("page"), F.lit("ask"), F.lit("answer"), F.col("id"))
    users = spark.range(2000).select(messages[0]["content"].alias("user")).groupBy("user").count().collect()
    counts = {r.user: r["count"] for r in users}
    assert counts.keys() == {"page\n\nask", "ask\n\npage"} and min(counts.values()) > 900
