"""Pages whose head is not closed, and skipped parts that close themselves."""

import pytest

from slipweave.llm.html import extract

TEXT = "A paragraph that is long enough to be the content of this page, whatever else stands here."


@pytest.mark.parametrize("start", ["<body>", "", "<body><svg/>", "<body><iframe src='x'/>"])
def test_text_after_an_open_head_or_a_self_closed_part(start):
    page = f"<html><head><title>T</title><style>p {{}}</style><meta charset='utf-8'>{start}<p>{TEXT}</p><p>{TEXT}</p></html>"
    assert extract(page) == f"{TEXT}\n{TEXT}"


def test_a_closed_head_is_skipped():
    assert extract(f"<html><head><title>T</title><script>x</script></head><body><p>{TEXT}</p></body></html>") == TEXT
