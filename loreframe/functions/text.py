"""Text, name and vector functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words without subject matter; fixed values.
STOPWORDS = tuple("""a an the and or but if then than that this these those of in on at to
for from by with without into onto over under again further once is are
was were be been being am do does did doing have has had having will would
shall should can could may might must it its he she they them his her
their there here as not no nor so too very just about after before""".split())
#: Relationship labels that read the same from either side; fixed values.
SYMMETRIC = (
    "spouse_of", "spouse", "married_to", "marriage", "husband_of", "wife_of", "sibling_of", "sibling", "brother_of", "sister_of", "twin_of",
    "cousin_of", "cousin", "friend_of", "friend", "best_friend_of", "colleague_of", "coworker_of", "co-worker_of", "partner_of", "business_partner_of",
    "ally_of", "allied_with", "rival_of", "rival", "enemy_of", "nemesis_of", "neighbor_of", "roommate_of", "classmate_of", "engaged_to", "in-law_of", "related_to",
)
#: Phrases that mark a sentence as a promise to the reader; fixed values.
FLAG_WORDS = ("promise", "prophecy", "someday", "if only")


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(name: str | Column) -> Column:
    """Unicode compatibility form; ASCII is in that form already, so callers keep it off this path."""
    return F.pandas_udf(_nfkc, T.StringType())(_col(name))


def fold_name(name: str | Column) -> Column:
    """An NFKC name in the form in which equal names are equal: quotes, spaces, case, one leading article and ending marks."""
    name = F.coalesce(_col(name), F.lit(""))
    n = F.translate(name, "’‘", "''")
    n = F.trim(F.regexp_replace(F.trim(n), "^[\"'“”]+|[\"'“”]+$", ""))
    n = F.lower(F.regexp_replace(n, r"\s+", " "))
    n = F.regexp_replace(n, r"^(?:the |an |a )(?=.)", "")
    n = F.regexp_replace(n, r"[.,;:!?]+$", "")
    return F.when(n != "", n).otherwise(F.lower(F.trim(name)))


def fold_text(text: str | Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"\s+", " "))


def content_words(folded: str | Column) -> Column:
    """Distinct words of a folded text that carry subject matter, in order."""
    return F.array_except(F.filter(F.split(_col(folded), " "), lambda w: w != ""), F.array(*[F.lit(w) for w in STOPWORDS]))


def words_overlap(a: Column, b: Column, least: int, ratio: float) -> Column:
    """The words that two arrays of content words share, where they are at least max(least, floor(size(a) * ratio)); else none."""
    shared = F.array_intersect(a, b)
    enough = F.size(shared) >= F.greatest(F.lit(least), F.floor(F.size(a) * F.lit(ratio)).cast("int"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & enough, shared).otherwise(F.array().cast("array<string>"))


def fold_value(value: str | Column) -> Column:
    """A canon value without separators and punctuation."""
    spaced = F.regexp_replace(fold_text(value), r"[-_/]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def is_symmetric(rel_type: str | Column, stored: Column | None = None) -> Column:
    known = F.coalesce(F.lower(F.trim(_col(rel_type))).isin(*SYMMETRIC), F.lit(False))
    return known if stored is None else F.coalesce(stored, known)


def sentences(text: str | Column) -> Column:
    return F.filter(F.split(F.trim(_col(text)), r"(?<=[.!?])\s+"), lambda s: s != "")


def flag_sentences(text: str | Column, words: tuple[str, ...] = FLAG_WORDS) -> Column:
    """The sentences that have one of the words, in any case."""
    return F.filter(sentences(text), lambda s: F.rlike(F.lower(s), F.lit("|".join(words))))


def candidate_names(text: str | Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct capitalised words of three letters or more that aren't stop words, in order."""
    words = F.regexp_extract_all(_col(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: F.rlike(w, F.lit("^[A-Z][a-z]{2,}$")) & ~F.lower(w).isin(*(stop or STOPWORDS))))


def level(value: str | Column) -> Column:
    """high, medium and low as numbers."""
    v = F.lower(F.trim(_col(value)))
    return F.when(v == "high", 1.0).when(v == "medium", 0.6).when(v == "low", 0.3)


def union_aliases(name: Column, existing: Column, absorbed: Column) -> Column:
    """Aliases of both in order, distinct, without the own name."""
    return F.filter(F.array_distinct(F.concat(existing, absorbed)), lambda x: x != name)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine over the common beginning of two vectors; 0 for an empty or zero one."""
    a, b = _col(a), _col(b)
    n = F.least(F.size(a), F.size(b))
    a, b = F.transform(F.slice(a, 1, n), lambda x: x.cast("double")), F.transform(F.slice(b, 1, n), lambda x: x.cast("double"))
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), add))
    size = norm(a) * norm(b)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).when(size <= 0, 0.0).otherwise(dot / size)


def similarity_of_distance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def hash_embed(text: str | Column, dimensions: int) -> Column:
    """A deterministic vector: SHA-256 of the text and a little-endian counter, eight numbers from -1 to 1 a digest."""
    text = F.when(F.coalesce(_col(text), F.lit("")) == "", F.lit("seed")).otherwise(_col(text))
    numbers = []
    for counter in range(-(-dimensions // 8)):
        digest = F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit(counter.to_bytes(4, "little").hex()))), 256)
        for k in range(8):
            at = lambda i, k=k: F.substring(digest, 8 * k + 2 * i + 1, 2)  # noqa: B023, E731
            numbers.append(F.conv(F.concat(at(3), at(2), at(1), at(0)), 16, 10).cast("double") / 4294967295.0 * 2 - 1)
    return F.array(*numbers[:dimensions])


def vector_text(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))


def prefixes(name: str | Column) -> Column:
    """All beginnings of a name that end with a word."""
    words = F.split(_col(name), " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))


def grams(folded: str | Column, most: int) -> Column:
    """Distinct runs of up to ``most`` words of a folded text; each length is one zip of the shorter runs with the words that follow."""
    words = F.regexp_extract_all(_col(folded), F.lit(r"([\p{L}\p{N}_']+)"), F.lit(1))
    runs, out = words, [words]
    for k in range(1, most):
        runs = F.filter(F.zip_with(runs, F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
        out.append(runs)
    return F.array_distinct(F.concat(*out))


def merge_json(old: str | Column, new: str | Column) -> Column:
    """The JSON object ``old`` with the keys of ``new`` put over it, one level deep; values keep their types. What is no object counts as empty."""
    fields = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(_col(c)), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    patch = fields(new)
    kept = F.map_filter(fields(old), lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.to_json(F.map_concat(kept, patch))
