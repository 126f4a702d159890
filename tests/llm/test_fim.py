"""Fill-in-middle from compressed frames against plain string cutting."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreframe.llm import fim
from tests.llm.test_operators import frame

COMPRESS, DECOMPRESS = fim._coder()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    n, digest = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, form, a, b - a, sha(out), sha(text), out


def test_documents(spark):
    long = "é x\U0001f600<" * 40_000
    texts = [None, "", "a", "ab <P> c", "<S>", "half <M", "é", long, long + "<M>", "x" * 65_534 + "<P>", "\n\t "] + [f"{i} <S é {i * i} " * (i % 50) for i in range(300)]
    docs = frame(spark, texts)
    got = {r.doc_id: tuple(r) for r in fim.fill_in_middle(docs, texts=True).collect()}
    assert got == {i: brute(i, t) for i, t in enumerate(texts)}
    assert {r[2] for r in got.values()} == {"plain", "spm", "psm"}


def test_null_ids_repeats_clashes_and_empty(spark):
    rows = [(None, "some text"), (None, "some text"), (3, "other"), (3, "other"), (3, "more"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", "y", [1]) for r in rows], "doc_id long, text string, form string, frames string, units array<int>")
    got = sorted((tuple(r) for r in fim.fill_in_middle(docs).collect()), key=repr)
    assert got == sorted((brute(*r)[:-1] for r in rows), key=repr)
    assert fim.fill_in_middle(docs.where("false")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSMé中\U0001f600 ", max_size=80), st.integers(1, 20), st.sampled_from(["psm", "spm"]), st.data())
def test_any_cut_in_any_frames(text, size, form, data):
    frames = fim.frames_of(memoryview(text.encode()), COMPRESS, size + 3)
    stored = fim.Frames(frames, DECOMPRESS)
    assert stored.units[-1] == len(text) and stored.holds(b"<P>", b"<S>", b"<M>") == any(m in text for m in ("<P>", "<S>", "<M>"))
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    assert stored.slice(a, b) == text[a:b]
    if not stored.holds(b"<P>", b"<S>", b"<M>"):
        out = b"".join(fim.output(stored, form, a, b - a))
        pieces = (out[i : i + size] for i in range(0, len(out), size))
        assert b"".join(fim.restored(pieces, form, COMPRESS, DECOMPRESS)).decode() == text


def test_a_place_opens_one_frame():
    text = "0123456789" * 100_000
    stored = fim.Frames(fim.frames_of(memoryview(text.encode()), COMPRESS), DECOMPRESS)
    assert len(stored.frames) > 10
    assert stored.place(777_777) == 777_777 and stored.opened == [777_777 // fim.FRAME]


def test_damage_is_seen():
    with pytest.raises(ValueError):
        list(fim.restored(iter([b"no marker <P>"]), "psm", COMPRESS, DECOMPRESS))
