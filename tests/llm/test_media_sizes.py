"""Texts that share a media keep their own sizes."""

from loreframe.llm import media_chunks


def test_sizes_of_texts_that_differ_in_trailing_spaces(spark):
    long = "some words of a text " * 400
    texts = ["abc", "abc ", "abc  ", None, "", " ", "alone", long.rstrip(), long.rstrip() + " ", "abc"]
    got = {r.doc_id: r for r in media_chunks.stored_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: r.n_bytes for i, r in got.items()} == {i: len((t or "").encode()) for i, t in enumerate(texts)}
    assert got[0].media_sha256 == got[1].media_sha256 == got[2].media_sha256 and got[3].media_sha256 == got[5].media_sha256
