"""How the set join deals runs to ranges as a corpus grows."""

import pytest

from loreframe.llm import ngram_join, setjoin
from tests.llm.test_operators import brute_components, edited, frame, prose


def test_rows_stay_large():
    for tokens in (0, 10**6, 10**9, 10**11, 15 * 10**12):
        run, ranges = setjoin.sizes_for(tokens)
        assert setjoin.RUN_TOKENS <= run <= setjoin.MOST_TOKENS and 64 <= ranges <= 1 << 20
        rows = max(1, tokens // run) * ranges
        assert tokens < 10**8 or tokens / rows > 15
    assert setjoin.sizes_for(10**9) == (setjoin.RUN_TOKENS, 10**9 // setjoin.RANGE_TOKENS)


@pytest.mark.parametrize("run", [50, 5000])
def test_runs_of_any_size_give_the_same_links(spark, monkeypatch, run):
    monkeypatch.setattr(setjoin, "sizes_for", lambda tokens: (run, 64))
    texts = [prose(s, 60) for s in range(8)] + [edited(prose(s % 8, 60), 100 + s, 1) for s in range(24)] + ["", None, "a b"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, texts)).collect()}
    assert got == brute_components(texts)
