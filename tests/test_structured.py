"""Structured data, trust signals and model files: nulls, empty inputs and blocks that are not JSON."""

from pagewright.operators import structured, trust

PAGES = "site string, url string, https boolean, schema_types array<string>, schema_data array<string>"
FILES = "domain string, path string, status_code int, body string"


def test_blocks_that_are_not_json_have_no_type(spark):
    pages = spark.createDataFrame([("s", "u", True, [], ["{broken", "null", "[]"]), ("s", None, None, None, None)], PAGES)
    got = structured.validate(pages).collect()
    assert [(r.schema_type, r.errors) for r in got] == [(None, ["no @type"])] * 3
    assert structured.validate(pages.limit(0)).count() == 0


def test_faq_and_breadcrumb_errors_name_their_place(spark):
    faq = '{"@type":"FAQPage","mainEntity":["text",{"@type":"Question","text":"Q","acceptedAnswer":{"text":""}}]}'
    crumbs = '{"@type":"BreadcrumbList","itemListElement":[{"position":null},{"name":"x"},"y"]}'
    one, two = structured.validate(spark.createDataFrame([("s", "u", True, [], [faq, crumbs])], PAGES)).orderBy("pos").collect()
    assert one.errors == ["mainEntity[0] is no object", "mainEntity[1] has no answer text"]
    assert two.errors == ["itemListElement[1] has no position"]


def test_a_site_without_articles_has_their_signals(spark):
    pages = spark.createDataFrame([("s", None, None, None, None)], PAGES)
    (r,) = trust.trust_signals(pages).collect()
    assert (r.score, r.https, r.author_schema, r.n_profiles) == (30, False, True, 0)
    assert trust.trust_signals(pages.limit(0)).count() == 0


def test_llms_text_is_taken_apart(spark):
    body = "# Title\r\n\r\nFirst\r\nsecond\r\n\r\nlater\r\n## Docs\r\n- [A](https://a)\r\n"
    rows = [("d", "/llms.txt", 200, body), ("e", "/llms.txt", 200, None), ("f", "/x", 200, "y")]
    got = {r.domain: r for r in trust.model_files(spark.createDataFrame(rows, FILES)).collect()}
    d = got["d"]
    assert (d.title, d.description, d.sections, d.n_links, d.links[0].url) == ("Title", "First second", ["Docs"], 1, "https://a")
    assert (got["e"].has_llms, got["e"].title, got["e"].n_links, got["f"].has_llms) == (True, None, 0, False)
