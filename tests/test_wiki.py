import pytest
from pyspark.sql import functions as F

from biblion.operators import wiki as W


def test_links():
    targets = {"Alert fatigue": "1.md", "Alert": "2.md", "AI": "3.md"}
    assert W.link_text("Alert fatigue and alert fatigue, alert.", targets) == "[Alert fatigue](1.md) and alert fatigue, [alert](2.md)."
    assert W.link_text("`alert` [alert](x) [[Alert|bell]] [[None]] AI", targets) == "`alert` [alert](x) [bell](2.md) [[None]] AI"
    assert W.link_text("anything", {}) == "anything"


def test_templates():
    assert W.render_template("a {x} {{y}}", {"x": "1"}) == "a 1 {y}"
    for bad in ("{missing}", "{open", "close}"):
        with pytest.raises(W.TemplateError):
            W.render_template(bad, {"x": "1"})


def test_pages(spark):
    e = spark.createDataFrame([(1, "A [b]", "CONCEPT", None, None, " ", "Text"), (2, "한글", None, "d", ["x", "y"], None, None), (3, None, None, None, None, None, None)], "id long, canonical_name string, entity_type string, description string, aliases array<string>, summary string, synthesis string")
    got = {r.path: r.body for r in W.entity_pages(e).collect()}
    assert got["entities/1-a-b.md"] == "# A \\[b\\]\n\n- Type: CONCEPT\n\n## Synthesis\n\nText\n" and "- Also known as: x, y" in got["entities/entity-2.md"] and len(got) == 2
    rows = W.render_rows(spark.createDataFrame([(1, "q"), (2, None)], "id long, topic string"), "On {topic}.", "id", ["topic"]).collect()
    assert {r.key: r.prompt for r in rows} == {"1": "On q.", "2": "On (not set)."}
    linked = W.link_pages(W.entity_pages(e), {"Synthesis": "s.md"})
    assert any("[Synthesis](s.md)" in r.body for r in linked.collect()) and W.entity_pages(e.limit(0)).count() == 0
    assert W.index_page(e.select("id", "canonical_name", F.lit(1).alias("n_sources"), F.lit(True).alias("stale")).where("id < 3")).first().body.count("(stale)") == 2
