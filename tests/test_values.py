"""Values of imported rows."""

import hashlib
import json

from pyspark.sql import functions as F

from curatrix.functions import values


def every(spark, given, f):
    df = spark.createDataFrame(list(enumerate(given)), "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_markup_and_tags(spark):
    assert every(spark, ["<p>a&amp;b<br/>c</p><div></div>\n\n<b>d</b>&nbsp;", None], values.markup_text) == ["a&b\nc\n\nd", ""]
    assert every(spark, ["x<t> a\nb </t><t>c</t>", "<t>None</t>", "<t>", None], lambda c: values.tagged(c, "t")) == ["a\nb", "", "", ""]


def test_lists_and_keywords(spark):
    assert every(spark, ["a、 b,c、", "a, ,b", "a\nb", "none", None], values.listed) == [["a", "b,c"], ["a", "b"], ["a", "b"], [], []]
    given = ["Senior AI role", "AI intern", "cook", None]
    assert every(spark, given, lambda c: values.wanted(c, [" ai "], ["Intern"])) == [True, False, False, False]
    assert every(spark, given, lambda c: values.wanted(c, [], ["intern"])) == [True, False, True, True]


def test_job_posting(spark):
    script = '<script type="application/ld+json">%s</script>'
    posting = {"@type": "JobPosting", "title": "x", "n": [1]}
    pages = [
        script % "{bad" + script % json.dumps({"@type": "Org"}) + script % json.dumps([{"@type": "Org"}, posting]), script % json.dumps(posting),
        "<p>", "", None
    ]
    assert [g and json.loads(g) for g in every(spark, pages, values.job_posting)] == [posting, posting, None, None, None]


def test_normalized_hash(spark):
    same = every(spark, ["Ａb１, ﬁ!", "ab1fi", None], values.normalized_hash)
    assert same[0] == same[1] == hashlib.sha1(b"ab1fi").hexdigest() and same[2] == hashlib.sha1(b"").hexdigest()
