from pyspark.sql import functions as F

from tidemark.functions import hashing, text, urls, values


def one(spark, expr, value=None):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


def test_exact_and_fast_normal_forms(spark):
    assert text.plain_normalize("Straße  №5_a-B") == "strasse no5_a b"
    for value in ("Hello, World!", "a_b  c", "", None, "ÀÉ-ü"):
        fast = one(spark, text.normalize(F.col("x")), value)
        assert fast == text.plain_normalize(value) == (one(spark, text.normalize_exact("x"), value or ""))


def test_terms_are_whole_words(spark):
    n = text.normalize(F.col("x"))
    assert one(spark, text.contains_term(n, "Red Team"), "the red-team lead") is True
    assert one(spark, text.contains_term(n, "red"), "reduced") is False
    assert one(spark, text.contains_term(n, " "), "x") is False
    assert one(spark, text.matched_terms(n, ["b", "zz", "a"]), "a b") == ["b", "a"]


def test_html(spark):
    page = "<p>A &amp; B</p><script>x()</script><b>C</b>"
    assert one(spark, text.html_to_text_exact("x"), page) == "A & B C"
    assert one(spark, text.html_to_text(F.col("x")), "1 &lt; 2 &amp; 3") == "1 < 2 & 3"
    assert one(spark, text.html_to_text(F.col("x")), None) == ""
    assert one(spark, text.strip_tags(F.col("x")), "<a>x</a><b>y</b>") == "x y"
    assert one(spark, text.html_lines("x"), "<p>a</p>\n<p>a</p><p>b</p>\n a") == "a\nb\na"
    assert one(spark, text.distinct_lines(F.col("x")), "a\n\na \nb\na") == "a\nb\na"
    assert one(spark, text.normalize_title_exact("x"), "<b>Sr.&nbsp;Dev</b>") == "sr dev"


def test_locations_sections_and_bounds(spark):
    assert one(spark, text.normalize_location(F.col("x")), "Paris | Lyon |paris| ") == "lyon | paris"
    assert one(spark, text.normalize_location_exact("x"), "Paris | Lyon |paris| ") == "lyon | paris"
    assert one(spark, text.join_sections(F.array(F.lit("a"), F.lit(" "), F.lit("b"), F.lit("a")))) == "a\n\nb"
    assert one(spark, text.bounded(F.col("x"), 9, "|"), "0123456789abc") == "012345|abc"
    assert one(spark, text.bounded(F.col("x"), 9, "|"), "012345678") == "012345678"


def test_common_prefix(spark):
    names = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, text.common_prefix(names("Acme Bank Italy", "ACME bank Spain"))) == "Acme Bank"
    assert one(spark, text.common_prefix(names("Acme", "Acme Bank"))) == "Acme"
    assert one(spark, text.common_prefix(names("A", "B"))) == ""


def test_model_json(spark):
    assert one(spark, text.model_json(F.col("x")), '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.model_json(F.col("x")), "[1]") is None
    assert one(spark, text.model_json(F.col("x")), "{bad") is None


def test_canonical_urls(spark):
    cases = {
        "HTTPS://Example.COM:443//jobs//7/?utm_source=x&b=2&a=1&ref=q#top": "https://example.com/jobs/7?a=1&b=2",
        "http://example.com:8080": "http://example.com:8080/",
        " mailto:x@y.z ": "mailto:x@y.z",
        "": "",
    }
    for raw, want in cases.items():
        assert one(spark, urls.canonical_url(F.col("x")), raw) == want
        assert one(spark, urls.canonical_url_exact("x"), raw) == want


def test_five_url_forms_differ(spark):
    raw = "https://www.Example.com:444//A//b/?z=1&a=2#f"
    assert one(spark, urls.jobs_url(F.col("x")), raw) == "https://www.example.com:444/A/b?z=1&a=2"
    assert one(spark, urls.jobs_url(F.col("x")), "https://u:p@example.com/") is None
    assert one(spark, urls.candidate_url(F.col("x")), raw) == "https://example.com//A//b?z=1&a=2"
    assert one(spark, urls.overlap_url(F.col("x")), "example.com/") == "https://example.com"
    assert one(spark, urls.parity_url(F.col("x")), raw) == "www.example.com//a//b"
    assert one(spark, urls.trailing_id(F.col("x")), "https://x.y/job/123/") == "123"
    assert one(spark, urls.origin(F.col("x")), raw) == "https://www.example.com:444"


def test_company_tokens(spark):
    for host, want in {"jobs.acme.com": "acme", "acme.com.au": "acme", "acme.com": "acme", "localhost": "localhost", "": ""}.items():
        assert one(spark, urls.company_token(F.col("x")), host) == want
    assert one(spark, urls.is_generic_label(F.col("x")), "career5") is True
    assert one(spark, urls.names_compatible(F.col("x"), F.lit("acmebank")), "acme") is True
    assert one(spark, urls.names_compatible(F.col("x"), F.lit("abc")), "ab") is False


def test_identities(spark):
    assert one(spark, hashing.ats_key(F.lit("c"), F.col("x")), " ") is None
    a = one(spark, hashing.fingerprint(F.lit("c"), F.lit("Dev, Sr"), F.lit("b | a"), F.lit(None)), None)
    assert a == one(spark, hashing.fingerprint(F.lit("c "), F.lit("<b>dev</b> sr"), F.lit("A|B"), F.lit("")), None)
    assert one(spark, hashing.variant_id(F.col("x"), *[F.lit("t")] * 4), " ").startswith("anonymous::variant:")


def test_values(spark):
    assert one(spark, values.json_list(F.col("x")), '["a", 1]') == ["a", "1"]
    assert one(spark, values.json_list(F.col("x")), '{"a": 1}') == one(spark, values.json_list(F.col("x")), "bad") == []
    assert one(spark, values.json_get(F.col("x"), "a.1.b-c"), '{"a": [0, {"b-c": "v"}]}') == "v"
    assert one(spark, values.retry_after(F.col("x"), F.current_timestamp()), "-3") == 0.0
    assert str(one(spark, values.unix_date(F.col("x")), "1700000000")) == "2023-11-14"
    assert one(spark, values.template("a/{id}/b", {"id": F.col("x")}), "7") == "a/7/b"
    assert one(spark, values.compact_metadata(F.col("x"), ["d", "l", "z"]), '{"d": "e", "l": [{"name": "n"}, "s"]}') == "d=e; l=n, s"
    assert abs(one(spark, values.similarity("x", F.lit("acme corp")), "ACME Corp.") - 1.0) < 1e-9
