"""Fixed values, written out once more: the SQL of the queries takes some of them from the implementation."""

import pytest

from pageloom import constants as c
from pageloom.kernels.structured import top_type, valid_value
from pageloom.operators.agent_perf import QUESTIONS

PROFILES = {
    "article": "25 20 20 15 10 10", "landing": "25 10 30 15 10 10", "reference": "30 10 20 15 15 10",
    "sample": "20 25 20 10 15 10", "faq": "25 15 30 15 5 10", "tutorial": "25 25 15 15 10 10",
}


def test_weights():
    assert " ".join(c.PILLARS) == "semantic_html content_extractability structured_data dom_navigability metadata_completeness http_compliance"
    assert all([float(x) / 100 for x in v.split()] == pytest.approx(c.PROFILE_WEIGHTS[k]) for k, v in PROFILES.items()) and set(PROFILES) == set(c.PROFILE_WEIGHTS)


def test_profile_maps():
    topics = "overview landing-page hub-page reference api-reference rest-api language-reference sample samples faq tutorial quickstart how-to how-to-guide"
    kinds = "landing landing landing reference reference reference reference sample sample faq tutorial tutorial tutorial tutorial"
    assert dict(zip(topics.split(), kinds.split(), strict=True)) == c.MS_TOPIC_PROFILES
    types = "faqpage howto softwaresourcecode collectionpage webpage apireference techarticle article newsarticle blogposting"
    kinds = "faq tutorial sample landing landing reference article article article article"
    assert dict(zip(types.split(), kinds.split(), strict=True)) == c.SCHEMA_PROFILES
    parts = "/api/ /reference/ /samples/ /sample/ /faq /tutorial /quickstart /how-to /overview /landing"
    kinds = "reference reference sample sample faq tutorial tutorial tutorial landing landing"
    assert tuple(zip(parts.split(), kinds.split(), strict=True)) == c.URL_PROFILES


def test_points_and_bands():
    assert c.FORMAT_POINTS == (0, 5, 12, 17, 20) and len(c.KNOWN_TYPES) == 25 and len(c.SEMANTIC_ELEMENTS) == 11
    assert c.AXE_SEVERITY == {"critical": 25, "serious": 15, "moderate": 10, "minor": 5} and c.AXE_FALLBACK == {"injection_failed": 75.0, "failed": 70.0}
    assert c.FAILURE_BANDS == ((90.0, "clean"), (75.0, "minor_issues"), (60.0, "moderate_issues"), (40.0, "significant_issues"))
    assert (c.CLUSTER_MIN, c.WEAK_BELOW, c.UPLIFT_TARGET, c.RENDER_FLAG) == (3, 70.0, 70.0, 15.0)
    assert [q[0] for q in QUESTIONS] == ["getting_started", "prerequisites", "code_example", "troubleshooting"]


def test_values_of_required_fields():
    assert all(valid_value("Article", "headline", v) for v in ("x", 0, False, 1.5)) and not valid_value("HowTo", "step", 0) and valid_value("HowTo", "step", "one")
    assert valid_value("BreadcrumbList", "itemListElement", [1, 2]) and not valid_value("BreadcrumbList", "itemListElement", [1]) and not valid_value("FAQPage", "mainEntity", "x")


def test_first_type():
    assert top_type(["{", '{"@graph": [{"@type": ["", "A"]}, {"@type": [1, "B"]}]}', '{"@type": "C"}']) == "B"
    assert top_type(['[{"@type": ""}]', '{"a": {"@type": "D"}}']) == "D" and top_type([]) is None
