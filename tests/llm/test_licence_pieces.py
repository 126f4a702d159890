"""Known sentences that are cut inside, and sentences of the caller's without an anchor word."""

from loreframe.llm import licenses


def scan(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.licenses, r.n_sentences) for r in licenses.license_scan(docs, **kw).orderBy("doc_id").collect()]


def test_every_sentence_and_rule_is_found(spark):
    rules = tuple((name, (name,)) for name in licenses.SENTENCES)
    each = [(name, s) for name, found in licenses.SENTENCES.items() for s in found]
    for layout in ("{}", "first words\n{}\nlast words", "Words before.\n\n{}\n\nWords after."):
        got = scan(spark, [layout.format(s) for _, s in each], rules=rules)
        assert all(name in found and n >= 1 for (name, _), (found, n) in zip(each, got, strict=True))
    for text, rule in [("\n".join(licenses.SENTENCES[x][0] for x in run), (licence, run)) for licence, run in licenses.RULES]:
        assert scan(spark, [text], rules=(rule,))[0] == ([rule[0]], len(rule[1])) and rule[0] in scan(spark, [text])[0][0]


def test_wrapped_gpl_notice_and_lone_pieces(spark):
    notice = " ".join([*licenses.SENTENCES["gpl-free"], licenses.SENTENCES["gpl-hope"][1]])
    words = notice.split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    got = scan(spark, [wrapped, "SPDX-License-Identifier: Unknown\nMIT", "license\nmit\nSPDX-License-Identifier:\nBSD-3-Clause"])
    assert got[0][0] == ["GPL-3.0"] and got[1] == ([], 0) and got[2][0] == ["BSD-3-Clause"]


def test_own_sentences_without_anchor_words(spark):
    own = {"free": ["Take it: it is yours."], "none": ["..."]}
    assert scan(spark, ["x\nTake it: it is yours.\ny", "MIT License", None], sentences=own, rules=(("Free", ("free",)), ("None", ("none",)))) == [(["Free"], 1), ([], 0), ([], 0)]
