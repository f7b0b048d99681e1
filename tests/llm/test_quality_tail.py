"""The worst stretch sees the last words of a text."""

from __future__ import annotations

import pytest

from factledger.llm import quality


@pytest.mark.parametrize("n", [65, 66, 90, 96, 97, 128, 129, 150, 159, 160, 161, 191])
def test_junk_in_the_last_words_is_seen(n):
    plain = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(n)]
    clean = dict(zip(quality.NAMES, quality.statistics(" ".join(plain)), strict=True))
    tail = n % quality.STRETCH or quality.STRETCH
    junk = [*plain[:-tail], *["XX$$"] * tail]
    found = dict(zip(quality.NAMES, quality.statistics(" ".join(junk)), strict=True))
    for name in ("worst_upper", "worst_symbols", "worst_trailing"):
        assert found[name] > clean[name], name
    if tail > 1:
        assert found["worst_repeat"] > clean["worst_repeat"] and found["worst_distinct"] > clean["worst_distinct"]


def test_stretches_of_short_texts_and_of_whole_ones_stay():
    short = dict(zip(quality.NAMES, quality.statistics("A a $$ a"), strict=True))
    assert short["worst_upper"] == pytest.approx(quality._share(1, 5))
    whole = " ".join(["a"] * 64 + ["b"] * 64)
    assert dict(zip(quality.NAMES, quality.statistics(whole), strict=True))["worst_repeat"] == pytest.approx(quality._share(63, 64))
