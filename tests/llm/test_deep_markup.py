"""Markup with very many unclosed elements."""

import time

import pytest

from postlens.llm import html_layout

REST = "<p>one<p>two<script>no()</script><style>no</style><div hidden>no</div><title>no</title><table><tr><td>ab<td>c<tr><td>d<td>e</table><ul><li>x</ul>end"


@pytest.mark.parametrize("tag", ["font", "b", "a name=x", "div"])
def test_rules_hold_behind_unclosed_elements(tag):
    plain = html_layout.render(f"<{tag}>" + REST)
    assert "no" not in plain and "ab   c" in plain
    assert html_layout.render(f"<{tag}>" * 600 + REST) == plain


def test_time_does_not_grow_with_the_square():
    start = time.time()
    html_layout.render("<b><table>" + "<i>" * 50_000 + "</b>" * 50_000 + "<p>x" * 1000)
    html_layout.render("<ul><li>x" * 2000)
    assert time.time() - start < 20
