"""Code points written out in ASCII rows count as they do beside other characters."""

import pytest

from rostrum.llm import encoding


@pytest.mark.parametrize("text", [r"it\u2019s here", "it&#8217;s here", "it&#x2019;s here", "it<U+2019>s here"])
def test_written_code_points_of_ascii_rows(text):
    assert encoding.repair(text) == ("it’s here", True)
    assert encoding.repair(text + " é") == ("it’s here é", True)


def test_ascii_rows_without_written_characters():
    for t in (r"C:\users\ux", "R&D &# 5", "plain", r"\d\x"):
        assert encoding.repair(t) == (t, False)
