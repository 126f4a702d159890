"""The training-data operators against brute force, round trips and their defined edge cases."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreframe.llm import decontaminate, licenses, line_dedup, media_chunks, mixing, ngram_join, quality_lm, setjoin, token_files, toxicity, trie, url_filter
from loreframe.llm.components import components
from loreframe.llm.shared import Words, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def edited(text, seed, n):
    w, rng = text.split(), np.random.default_rng(seed)
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"e{seed}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    base, other = prose(1, 80), prose(2, 40)
    out = [base, base.upper(), base.replace(" ", "\n "), None, "", " \t\n", "one two", "One  two", "one two three four five", other]
    out += [edited(base, s, 2) for s in range(10)] + [edited(other, s, 1) for s in range(5)]
    out += [f"{prose(50 + s, 30)}\n{other}" for s in range(4)] + ["é ü " * 30, "é ü " * 31, prose(9, 3000)]
    return out


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, ["en", "de", None][i % 3], [None, "b", "a"][i % 3], len(t or "")) for i, t in enumerate(texts)], DOCS)


def brute_components(texts):
    sets = [set(shingles(t)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("chunk", [1024, 1, 3])
def test_ngram_join(spark, texts, chunk, monkeypatch):
    monkeypatch.setattr(setjoin, "CHUNK", chunk)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_ngram_join_repeats_and_empty(spark, texts):
    twice = frame(spark, texts[:3]).union(frame(spark, texts[:3]))
    assert [r.component_id for r in ngram_join.ngram_join(twice).collect()] == [0] * 6
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0
    no_id = frame(spark, texts[:2]).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.col("doc_id")))
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(no_id).collect()} == {(None, 1), (1, 1)}


def test_keep_first(spark, texts):
    kept = {r.doc_id for r in ngram_join.keep_first(frame(spark, texts)).collect()}
    assert kept == {i for i, (_, c) in brute_components(texts).items() if i == c}


def test_trie_against_pairs():
    rng = np.random.default_rng(3)
    base = [rng.choice(60, 20, replace=False) for _ in range(6)]
    sets = []
    for k in range(60):
        own = base[k % 6].copy()
        own[: rng.integers(0, 6)] = rng.integers(60, 90)
        sets.append(np.unique(own))
    keys = []
    for s in sets:
        x = np.zeros(len(s), trie.KEY)
        x["order"], x["token"] = s % 7, s
        keys.append(x[np.lexsort((x["token"], x["order"]))])
    sizes = [len(s) for s in sets]
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    found = trie.earlier(keys, sizes, 75)
    assert found == [any(linked(i, j) for j in range(i)) for i in range(60)]
    root = trie.components(keys, sizes, 75)
    for i, j in itertools.combinations(range(60), 2):
        if linked(i, j):
            assert root[i] == root[j]
    places = list(range(0, 120, 2))
    assert trie.ahead((keys[:30], sizes[:30], places[:30]), (keys[30:], sizes[30:], [31] * 30), 75) == [any(linked(i, j) for j in range(16)) for i in range(30, 60)]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000, 1000 + k) for k in range(1, 60)] + [(None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges[:-1]:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    nodes = {x for a, b in edges[:-1] if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}


@pytest.mark.parametrize("chunk", [1024, 1])
def test_line_dedup(spark, texts, chunk, monkeypatch):
    monkeypatch.setattr(setjoin, "CHUNK", chunk)
    lines = [(0, k, line) for k, line in enumerate([*texts[10:14], "", "again", "again"])]
    docs = [(0, "\n".join(x[2].replace("\n", " ") for x in lines)), (1, f"again\n{texts[0]}\nnew words here\n"), (2, None), (3, ""), (4, f"x\n{texts[14]}"), (None, "again")]
    flat = [(d, k, line) for d, t in docs if d is not None and t is not None for k, line in enumerate(t.split("\n"))]
    sets = [set(shingles(line)) for _, _, line in flat]
    expected = collections.defaultdict(list)
    for i, (d, k, _) in enumerate(flat):
        expected[d]
        if sets[i] and any(sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(i)):
            expected[d].append(k)
    found = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.removed for r in found.collect()} == dict(expected)
    left = {r.doc_id: r.text for r in line_dedup.without_lines(spark.createDataFrame(docs, "doc_id long, text string"), found).collect()}
    assert left[1] == "new words here\n" and left[None] == "again" and left[2] is None and left[3] == ""


def test_decontaminate(spark):
    items = [(0, prose(100, 20)), (1, prose(101, 40)), (2, "three word item"), (3, None), (4, ""), (5, prose(100, 20))]
    own = items[1][1].split()
    docs = [
        (0, f"{prose(7, 300)} {items[0][1].upper()} {prose(8, 50)}"), (1, " ".join(own[:20] + ["zzz"] + own[21:])), (2, prose(11, 400)), (3, None), (4, " ".join(own[:25])),
        (5, "three word item"), (9, f"{prose(13, 8)} Three  word ITEM {prose(14, 8)} three word item"), (10, "three word"), (None, prose(100, 20)), (6, f"{prose(12, 9)}\n{edited(items[1][1], 5, 1)}"), (7, " ".join(own[:30] + own[:30])), (8, items[0][1]), (8, items[0][1]),
    ]
    expected = {}
    for d, text in docs:
        s = shingles(text)
        for i, item in items:
            own_item = collections.Counter(shingles(item))
            if not own_item or not s:
                continue
            if len(words(item)) < 5:
                w, v = words(item), words(text)
                if any(v[k : k + len(w)] == w for k in range(len(v))):
                    expected[d, i] = 1.0
                continue
            width = max(1, len(words(item)) - 4)
            best = 0
            for a in range(max(1, len(s) - width + 1)):
                c = collections.Counter(s[a : a + width])
                m = sum((c & own_item).values())
                best = max(best, m / (sum(c.values()) + sum(own_item.values()) - m))
            if best >= 0.75:
                expected[d, i] = best
    D, B = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(D, B).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in rows} == expected and len(rows) == len(expected)
    assert {r.doc_id for r in decontaminate.without(D, decontaminate.contaminated(D, B)).collect()} == {d for d, _ in docs} - {d for d, _ in expected} | {None}
    assert decontaminate.contaminated(D, B.where("false")).count() == 0 and decontaminate.contaminated(D.where("false"), B).count() == 0


def test_decontaminate_blocks_of_items_and_names(spark, monkeypatch):
    """Items in several blocks, repeated rows, clashing columns, and a very long text."""
    items = [(i, prose(300 + i, 15), "t") for i in range(9)]
    docs = [(i, f"{prose(i, 40)} {items[i % 9][1]}", 1.0, 2) for i in range(12)] + [(3, f"{prose(3, 40)} {items[3][1]}", 1.0, 2), (20, f"{prose(77, 60_000)} {items[4][1]}", 0.0, 1)]
    D, B = spark.createDataFrame(docs, "doc_id long, text string, similarity double, item_id int"), spark.createDataFrame(items, "item_id long, text string, id string")
    one = {(r.doc_id, r.item_id, r.similarity) for r in decontaminate.contaminated(D, B).collect()}
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    rows = decontaminate.contaminated(D, B).collect()
    assert len(rows) == 13 and {(r.doc_id, r.item_id, r.similarity) for r in rows} == one == {(i, i % 9, 1.0) for i in range(12)} | {(20, 4, 1.0)}


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(5)
    index = decontaminate.Index(list(range(200)), [prose(s, 12) for s in range(200)], 5, decontaminate.RADIUS)
    base = index.prints[rng.integers(0, 200, 300)]
    flips = np.array([np.packbits(np.isin(np.arange(256), rng.choice(256, k, replace=False))).view(np.uint64) for k in rng.integers(1, 80, 300)])
    w, i = index.within(12, base ^ flips)
    near = decontaminate.distances((base ^ flips)[:, None], index.prints[None, :]) <= decontaminate.RADIUS
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*[x.tolist() for x in np.nonzero(near)]))
    # of random windows few are candidates in a block
    _, tables = index.tables(12)
    assert all(len(t) / (200 * 65536) < 0.011 for t in tables)


def test_fingerprints_of_long_runs(monkeypatch):
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    begins = np.unique(rng.integers(0, 2500, 200))
    for width in (1, 7, 400):
        ends = np.minimum(begins + width, 3000)
        whole = decontaminate.fingerprints(hashes, begins, ends)
        monkeypatch.setattr(decontaminate, "SPAN", 64)
        assert (whole == decontaminate.fingerprints(hashes, begins, ends)).all()
        monkeypatch.setattr(decontaminate, "SPAN", 8192)
        for k in (0, 50, len(begins) - 1):
            bits = decontaminate._bits(hashes[begins[k] : ends[k]])
            assert (np.unpackbits(whole[k].view(np.uint8)) == (2 * bits.sum(axis=0, dtype=int) > len(bits))).all()


def test_simhash_recall_near_the_threshold():
    """Of windows whose similarity lies in [0.75, 0.8], as good as all are within the radius."""
    found = total = 0
    rng = np.random.default_rng(8)
    for n in (10, 14, 30, 60, 200):
        for _ in range(300):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = a.copy()
            # changing k of n distinct shingles gives a similarity of (n - k) / (n + k)
            k = int(np.floor(n * 0.25 / 1.75))
            b[rng.choice(n, k, replace=False)] = rng.integers(0, 1 << 63, k).astype(np.uint64)
            if 0.75 <= (n - k) / (n + k) <= 0.8:
                one = [decontaminate.fingerprints(x, np.zeros(1, int), np.full(1, n)) for x in (a, b)]
                total += 1
                found += int(decontaminate.distances(*one)[0] <= decontaminate.RADIUS)
    assert total >= 900 and found / total >= 0.99


def test_mixing_targets():
    assert mixing.targets([], []) == []
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    aims = mixing.targets([1, 1000, 10], [1, 1, 1])
    assert aims == [3, 978, 30] and mixing.targets([0, 5], [1, 2]) == [0, 5]
    parts = mixing.split(np.array([10, 0, 500, 33]), 7)
    assert parts.sum(axis=0).tolist() == [10, 0, 500, 33] and parts.min() >= 0
    assert mixing.split(np.array([10, 0, 500, 33]), 7).tolist() == parts.tolist()


def test_mixing(spark, texts):
    docs = frame(spark, [prose(s, 5 + s % 40) for s in range(900)] + texts)
    rows = mixing.mix(docs).collect()
    size = {r.doc_id: r.size for r in rows}
    assert size == {r.doc_id: len(words(r.text)) for r in docs.collect()}
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies and all(0 <= s < 32 for s in r.shards)
        taken[r.source] += r.size * r.copies
    for r in rows:
        assert abs(taken[r.source] - r.target) <= max(size.values())
    again = {r.doc_id: (r.copies, r.shards) for r in mixing.mix(docs).collect()}
    assert again == {r.doc_id: (r.copies, r.shards) for r in rows}
    drawn = mixing.draws(mixing.mix(docs), ["doc_id", "text"])
    assert collections.Counter(r.doc_id for r in drawn.collect()) == collections.Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixing.mix(docs.where("false")).count() == 0
    shards = collections.Counter(r.shard for r in drawn.collect())
    assert len(shards) == 32 and max(shards.values()) < 4 * sum(shards.values()) / 32


def test_mixing_cases(spark):
    """Empty documents of a source at its cap, clashing names, repeated rows, null ids."""
    rows = [(i, "", "a", 5, 0, "k") for i in range(40)] + [(100 + i, prose(i, 6), "a", 5, 0, "k") for i in range(10)] + [(200 + i, prose(i, 60), "b", 5, 0, "k") for i in range(400)]
    rows += [(None, "x y", "b", 5, 0, "k"), (200, prose(0, 60), "b", 5, 0, "k"), (None, None, None, 5, 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shards int, _row string")
    out = mixing.mix(docs)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "source", "_row", "size", "source_size", "target", "copies", "shards"]
    assert all(r.copies == 3 for r in got if r.source == "a") and all(r.copies <= 3 and r._row == "k" for r in got)
    one = [r for r in got if r.doc_id == 200]
    assert len(one) == 2 and abs(one[0].copies - one[1].copies) <= 1
    # a draw that no shard has isn't taken
    assert {s for r in got for s in r.shards} <= set(range(32)) and sum(r.copies for r in got) == mixing.draws(out, ["doc_id"]).count()


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    docs = frame(spark, [*texts, "it's <|endoftext|> a test'll 12345 ...!!", "a b c ᄀ ᅡ ΑΣ Σ"])
    got = {r.doc_id: r for r in token_files.encoded(docs).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.encoded(docs.where("false")).count() == 0


def test_token_files_layout_and_full_table(spark, texts, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/tokens"
    token_files.write(frame(spark, texts), path, token_files.default_tokenizer(), keep=("source",))
    meta = pq.ParquetFile(next(tmp_path.glob("tokens/*.parquet"))).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings and columns["doc_id"].has_offset_index and "source" in columns
    monkeypatch.setattr(token_files, "MOST_WORDS", 3)
    token_files._tokenizers.clear()
    column = pa.array(["a b c d e a", "", None, "zz a, B!! it's 12", "c <|endoftext|>d"])
    few = [token_files.encoder(token_files.default_tokenizer())(column.slice(i, 2)) for i in (0, 1, 3, 0)]
    token_files._tokenizers.clear()
    monkeypatch.setattr(token_files, "MOST_WORDS", 1000)
    encode = token_files.encoder(token_files.default_tokenizer())
    for (ids, counts), i in zip(few, (0, 1, 3, 0), strict=True):
        expected = encode.ids([x or "" for x in column.slice(i, 2).to_pylist()])
        assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])
    assert encode.by_pieces and encode.direct


def test_token_files_of_a_byte_level_tokenizer(spark, texts):
    """A tokenizer whose ids depend on the white space before a word encodes whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.Encoder(path).by_pieces
    tokenizer, docs = Tokenizer.from_file(path), frame(spark, texts)
    got = {r.doc_id: r.ids_crc32 for r in token_files.encoded(docs, path).collect()}
    assert got == {r.doc_id: zlib.crc32(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect()}


def test_token_files_cases(spark):
    rows = [(None, "b", 1), (None, None, 2), (3, "x y", 3), (3, "x", 4), (3, "x", 5), (1, "w " * 200_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = token_files.encoded(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == [(False, 1, 200_001), (False, 3, 2), (False, 3, 2), (False, 3, 3), (True, 0, 1), (True, 0, 2)]
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert starts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(starts)) and [x[2] for x in starts] == [None, None, 1, 3, 3, 3]
    with pytest.raises(ValueError):
        token_files.write(docs, "file:///tmp/never", token_files.default_tokenizer(), keep=("ids",))


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        w = prose(i, int(rng.integers(5, 80))).split()
        if toxic:
            w[int(rng.integers(len(w)))] = ["idiot", "moron", "scum"][i % 3]
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(9000, None), (9001, "")]
    D, L = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(D, L).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = [r for r in out.values() if r.held_out and r.doc_id < 9000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.values())
    right = sum(r.predicted == int(r.doc_id % 8 == 0) for r in held) / len(held)
    assert right > 0.97 and out[9000].score == out[9001].score
    flipped = L.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {k: r.score for k, r in out.items()} == {r.doc_id: r.score for r in toxicity.toxicity(D, flipped).collect()}
    assert all(r.score < 0.01 for r in toxicity.toxicity(D, L.where("false")).collect()) and toxicity.toxicity(D.where("false"), L).count() == 0


def brute_features(text):
    """The feature strings of a text, from its definition."""
    counts = collections.Counter()
    for w in words(text):
        core = w.encode().strip(bytes(b for b in range(128) if not chr(b).isalnum()))
        if core:
            counts[core, 0] += 1
            for size in toxicity.SIZES:
                if len(core) >= size:
                    counts[core[:size], size] += 1
    return {(*f, level) for f, c in counts.items() for level in toxicity.LEVELS if c >= level}


def test_toxicity_features(texts):
    own = [*texts, "Idiot! (idiot) idiots, 'idiot' --", "!!! ... -", "\u00c9t\u00e9\u2026 \u00e9tonnant \u00e9tonnante"]
    (i, hashes, rows), names, seen = next(toxicity.features(pa.array(own, pa.string()))), {}, {}
    assert i == 0
    for k, text in enumerate(own):
        found, expected = hashes[rows == k].tolist(), brute_features(text)
        assert len(found) == len(set(found)) == len(expected)
        seen[k] = set(found), expected
    # equal features have equal hashes: shared ones are as many for every pair of texts
    for a, b in itertools.combinations(range(len(own)), 2):
        assert len(seen[a][0] & seen[b][0]) == len(seen[a][1] & seen[b][1])


def brute_fit(positive, unlabelled, width, prior):
    """The same descent on dense rows, with the risk differentiated numerically."""
    rng = np.random.default_rng(5)
    dense = lambda rows: np.array([[float(k in r) for k in range(width)] + [1.0] for r in rows])
    deals = [rng.permutation(len(rows)) % toxicity.BATCHES for rows in (positive, unlabelled)]
    x, m, v, step = np.append(np.zeros(width), np.log(prior / (1 - prior))), np.zeros(width + 1), np.zeros(width + 1), 0
    loss = lambda z: np.logaddexp(0, z).mean()
    for _ in range(toxicity.EPOCHS):
        for b in range(toxicity.BATCHES):
            p, u = (dense([rows[i] for i in np.flatnonzero(deal == b)]) for rows, deal in zip((positive, unlabelled), deals))
            rest = lambda w: loss(u @ w) - prior * loss(p @ w)  # noqa: B023, E731
            risk = (lambda w: prior * loss(-(p @ w)) + rest(w)) if rest(x) >= 0 else (lambda w: -rest(w))  # noqa: B023
            unit = np.eye(width + 1) * 1e-6
            gradient = np.array([(risk(x + e) - risk(x - e)) / 2e-6 for e in unit]) + toxicity.DECAY * np.append(x[:-1], 0)
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            x = x - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x


def test_nonnegative_risk():
    rng = np.random.default_rng(0)
    positive = [np.unique([1, 2, int(rng.integers(4, 9))]) for _ in range(80)]
    unlabelled = [np.unique([3, int(rng.integers(4, 9))]) for _ in range(300)] + positive[:20]
    weights, bias = toxicity.fit(positive, unlabelled, 9, 0.06)
    assert weights[1] > 0 and bias + weights[[1, 2]].sum() > bias + weights[3]
    assert np.append(weights, bias) == pytest.approx(brute_fit(positive, unlabelled, 9, 0.06), abs=0.02)


def test_toxicity_cases(spark):
    rows = [(i, "idiot here" if i % 7 == 0 else prose(i, 9), 0.5, 9) for i in range(600)] + [(None, "idiot here", 0.1, 9), (7, "idiot here", 0.2, 9), (8, "x " * 300_000, 0.3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, row int")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(0, 600, 2)] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels)
    got = out.collect()
    assert len(got) == len(rows) and sorted(out.columns) == ["doc_id", "held_out", "predicted", "row", "score", "text"]
    assert len({r.score for r in got if r.text == "idiot here"}) == 1 and {r.row for r in got} == {9}


def test_media(spark, texts):
    docs = frame(spark, [*texts, "x" * 40_000, texts[-1] + " tail"])
    got = {r.doc_id: r for r in media_chunks.stored_media(docs).collect()}
    for r in docs.collect():
        text = (r.text or "").encode()
        payload = text + b" " * ((-len(text)) % 192 or (192 if not text else 0))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert g.media_bytes == len(payload) + 44 and g.media_sha256 == hashlib.sha256(media_chunks.to_media(payload)).hexdigest()
    assert got[3].feature == got[4].feature and media_chunks.stored_media(docs.where("false")).count() == 0


def test_media_chunks_cut_by_content():
    rng = np.random.default_rng(4)
    media = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    ends = media_chunks.cuts(media)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(media) and sizes.max() <= media_chunks.MOST and sizes[:-1].min() >= media_chunks.LEAST
    chunk = lambda m: {m[a:b] for a, b in zip([0, *media_chunks.cuts(m)[:-1]], media_chunks.cuts(m))}
    assert len(chunk(media) & chunk(b"inserted" + media)) > 0.9 * len(ends)
    with pytest.raises(ValueError):
        media_chunks.assembled([{"digest": b"", "length": 1, "bytes": b"x"}], b"")


def brute_lm(train, docs):
    """The model on words themselves, level by level."""
    few = lambda counter: [sum(c == k for c in counter.values()) for k in range(1, 5)]
    words = lambda t: (t or "").lower().split()
    triples, starts = collections.Counter(), collections.Counter()
    for t in train:
        x = ["<s>", *words(t)]
        triples.update(zip(x, x[1:], x[2:]))
        starts.update([("<s>", w) for w in x[1:2]])
    pairs = collections.Counter((v, w) for _, v, w in triples) + starts
    single = collections.Counter(w for _, w in pairs)
    d3, d2, d1 = (quality_lm.discounts(few(x)) for x in (triples, pairs, single))
    everything, taken = sum(single.values()), sum(d1[min(c, 3)] for c in single.values())

    def level(counts, context, gram, d, below):
        own = [c for g, c in counts.items() if g[:-1] == context]
        c, total = counts[gram], sum(own)
        return below if not total else (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in own) * below) / total

    out = []
    for t in docs:
        x, logs = ["<s>", *words(t)], []
        for i in range(1, len(x)):
            p = (max(single[x[i]] - d1[min(single[x[i]], 3)], 0) + taken / (len(single) + 1)) / everything
            p = level(pairs, (x[i - 1],), (x[i - 1], x[i]), d2, p)
            logs.append(np.log(level(triples, (x[i - 2], x[i - 1]), (x[i - 2], x[i - 1], x[i]), d3, p) if i > 1 else p))
        out.append(-np.mean(logs) if logs else None)
    return out


def test_quality_lm(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice([f"v{k}" for k in range(60)], int(rng.integers(1, 60)), p=np.arange(60, 0, -1) / 1830)) for _ in range(80)] + ["junk ### $$$ %%% @@@", None, ""]
    docs = frame(spark, texts)
    trusted = docs.where("doc_id < 60").select("doc_id")
    train = [t for i, t in enumerate(texts) if i < 60 and zlib.crc32(str(i).encode()) % 5]
    rows = {r.doc_id: r for r in quality_lm.quality(docs, trusted, 0.9).collect()}
    for i, expected in enumerate(brute_lm(train, texts)):
        assert rows[i].log_perplexity == (pytest.approx(expected, rel=1e-5) if expected is not None else None)
    assert not rows[80].keep and not rows[81].keep and not rows[82].keep and sum(rows[i].keep for i in range(60)) > 40
    assert quality_lm.quality(docs, trusted.where("false")).where("keep").count() == 81 and quality_lm.quality(docs.where("false"), trusted).count() == 0


@pytest.mark.parametrize("most", [40, 700])
def test_quality_lm_runs(monkeypatch, most):
    """Runs hold every text's words in order, wherever they are cut; repeated, null and empty texts too."""
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice([f"v{k}" for k in range(40)], int(rng.integers(0, 40)))) for _ in range(60)] + [None, "alone"]
    rows = lambda ts: [pa.RecordBatch.from_pydict({"id": [i], "lang": [None], "text": pa.array([x], pa.string())}) for i, x in enumerate(ts)]
    monkeypatch.setattr(quality_lm, "RUN_WORDS", most)
    runs = [r for b in quality_lm._runs(iter(rows(texts))) for r in b.to_pylist()]
    assert sum(len(r["ids"]) for r in runs) == len(texts) and len({r["run"] for r in runs}) == len(runs) > 1
    got = [w for r in runs for w in quality_lm.Run(r).words.tolist()]
    assert got == [int(h) for t in texts for h in Words(*utf8(pa.array([t or ""], pa.string()))).hashes]


def test_licenses(spark):
    mit = "\n".join(licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "as-is-mit"))
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance\nwith the License."
    docs = [(0, f"Copyright (c) 2020\n\n{mit}\nrest"), (1, apache), (2, "text\nReleased under the MIT License.\nmore"), (3, None), (4, ""), (5, "no licence named"), (6, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (7, "permission is hereby granted")]
    got = {r.doc_id: r.licenses for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: ["MIT"], 1: ["Apache-2.0"], 2: ["MIT"], 3: [], 4: [], 5: [], 6: ["CC-BY-NC-4.0", "MIT"], 7: []}
    assert all(any(a in s for a in licenses.ANCHORS) or "spdx" in s or "cc by" in s for s in licenses.known_sentences())


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/x?y", "https://www.example.com/en/1#a", "https://x.net/es/2", "https://x.net/de", None, "nothing", "ftp://bad.org", "http://bad.org/a", "http://bad.org/b", "http://good.org/a/b?c", "http://com/?q", "http://", "://h.io"]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, bound string")
    outcomes = spark.createDataFrame([(6, 1), (7, 1), (8, 1), (9, 0), (3, 0)], "page_id long, bad int")
    rows = url_filter.url_filter(pages, outcomes, limit=0.2, z=0.5).collect()
    got, bound = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}, {r.page_id: r.bound for r in rows}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3][2] is None and got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None)
    assert got[7][3] == "block" and bound[7] > bound[9] and bound[6] == bound[7] and got[10][:3] == ("com", "/", "com/") and got[11][:2] == ("", "") and got[12][:2] == ("h.io", "")
    assert url_filter.url_filter(pages.where("false"), outcomes).count() == 0 and url_filter.url_filter(pages, outcomes.where("false")).count() == len(urls)


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    item = prose(500, 25)
    own = [*texts, *[prose(600 + s, 60) for s in range(40)], f"{prose(700, 30)} {item}"]
    sf = f"file://{tmp_path}"
    frame(spark, own).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen.append((name, docs.columns, docs.count()))
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, columns, _ in seen[:-1])
    kept = len({c for _, c in brute_components(own).values()})
    assert [n for _, _, n in seen[:3]] == [len(own), kept, kept - 1]
    result = corpus_pipeline.run(spark, sf).collect()
    assert len(result) == seen[-1][2] == seen[3][2] and sorted(r.start for r in result)[0] == 0


def test_pipeline_with_clashing_names_nulls_and_repeats(spark, tmp_path):
    """Every stage keeps the columns and values of documents, whatever they are named."""
    import corpus_pipeline

    item = prose(500, 25)
    rows = [(i, prose(800 + i, 30), "en", "a", 9, 5, 0.25, "x", True) for i in range(30)]
    rows += [rows[3], (None, prose(890, 30), None, None, None, None, None, None, None), (77, None, "en", "b", 0, 5, 0.25, "x", False), (78, f"{prose(891, 9)} {item}", "en", "b", 9, 5, 0.25, "x", True)]
    names = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, row string, held_out boolean"
    for k, own in enumerate((rows, rows[:0])):
        sf = f"file://{tmp_path}/{k}"
        spark.createDataFrame(own, names).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        before = {tuple(r) for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == [x.split()[0] for x in names.split(", ")]
            after = [tuple(r) for r in docs.collect()]
            assert set(after) <= before
            if own:
                assert len(after) == {"toxicity": 34, "ngram_join": 33, "decontaminate": 32}.get(name, len(after)) and (None in {r[0] for r in after} or name == "mixing")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(after)
