"""Continuity checks: claims of many drafts against the as-of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.functions import text as X
from loreframe.operators import textjoin
from loreframe.operators.asof import held_entering
from loreframe.sources.files import stored


def check_possession(claims: DataFrame, edges: DataFrame, keys: list[str], chapter: str = "chapter") -> DataFrame:
    """Claims of things that aren't held when the chapter begins."""
    held = edges.select(*[F.col(k).alias(f"_{k}") for k in keys], "since", "until")
    fits = [F.col(k) == F.col(f"_{k}") for k in keys]
    return claims.join(held, [*fits, held_entering("since", "until", chapter)], "left_anti")


def check_canon(mentions: DataFrame, canon: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions (keys, chapter, claimed) that contradict the canon before their chapter (keys, chapter, value, locked): FAIL where locked, else WARN."""
    met = mentions.join(canon, [*keys, "chapter"]).where(X.fold_value("claimed") != X.fold_value("value"))
    return met.withColumn("severity", F.when(F.col("locked"), "fail").otherwise("warn"))


def check_knowledge(claims: DataFrame, facts: DataFrame, keys: list[str], least: int = 2, ratio: float = 0.5) -> DataFrame:
    """Claims (keys, claim_id, chapter, claim) that nobody of the keys knew: no fact (keys, learned, fact) equal, containing, contained or overlapping.

    Equal texts of a key meet once: a fact by when it was first learned, a claim by the last chapter in which it is made. Which
    texts meet is ``textjoin``'s; all pairs of a key are never compared. An empty claim is contained in every fact.
    """
    said = claims.select(*keys, "claim_id", "chapter", X.fold_text("claim").alias("_a"))
    a = said.where("_a <> ''").groupBy(*keys, "_a").agg(F.max("chapter").alias("_last"))
    b = facts.select(*keys, "learned", X.fold_text("fact").alias("_b")).where("_b <> ''").groupBy(*keys, "_b").agg(F.min("learned").alias("_learned"))
    a, b = stored(a.withColumn("_i", F.xxhash64("_a")), "claims"), stored(b.withColumn("_j", F.xxhash64("_b")), "facts")  # read ten times below
    needed = F.greatest(F.lit(least), F.floor(F.size("_w") * F.lit(ratio)).cast("int"))
    mine = a.withColumn("_w", X.content_words("_a")).withColumn("_need", needed).drop("_a")
    shared = textjoin.overlaps(mine, b.withColumn("_w", X.content_words("_b")).drop("_b"), keys, F.col("_learned") <= F.col("_last"))
    told, known = a.select(*keys, F.col("_a").alias("_s")), b.select(*keys, F.col("_b").alias("_s"))
    held = textjoin.contained(known, told.withColumnRenamed("_s", "_l"), keys).select(*keys, F.col("_l").alias("_a"), F.col("_s").alias("_b"))
    held = held.union(textjoin.contained(told, known.withColumnRenamed("_s", "_l"), keys).select(*keys, F.col("_s").alias("_a"), F.col("_l").alias("_b")))
    met = shared.select(*keys, "_i", "_j").union(held.select(*keys, F.xxhash64("_a"), F.xxhash64("_b")))
    # a text is known by its number here: one in 2**64 of the pairs of texts of a key share theirs
    first = met.join(b.select(*keys, "_j", "_learned"), [*keys, "_j"]).groupBy(*keys, "_i").agg(F.min("_learned").alias("_learned"))
    every = said.where("_a <> ''").withColumn("_i", F.xxhash64("_a")).join(first, [*keys, "_i"])
    empty = said.where("_a = ''").join(b.groupBy(*keys).agg(F.min("_learned").alias("_learned")), keys)
    done = every.select(*keys, "claim_id", "chapter", "_learned").union(empty.select(*keys, "claim_id", "chapter", "_learned")).where("_learned <= chapter")
    return claims.join(done.select(*keys, "claim_id").distinct(), [*keys, "claim_id"], "left_anti")


def check_commitments(events: DataFrame, commitments: DataFrame, keys: list[str], least: int = 3, ratio: float = 0.4) -> DataFrame:
    """(keys, draft, commitment_id, event_seq, terms): for each pending commitment the first event of a draft that may pay it off.

    Commitments of ``due_commitments`` have a draft, and meet the events of their own. Events (keys, draft, event_seq, description) meet commitments (keys, commitment_id, foreshadow) on shared content words.
    """
    keys = [*keys, "draft"] if "draft" in commitments.columns else keys  # those that are due for each draft
    a = commitments.withColumn("_w", X.content_words(X.fold_text("foreshadow"))).withColumn("_n", F.size("_w"))
    b = events.withColumn("_v", F.explode(X.content_words(X.fold_text("description"))))
    shared = a.select(*keys, "commitment_id", "_n", F.explode("_w").alias("_v")).join(b.select(*dict.fromkeys([*keys, "draft"]), "event_seq", "_v"), [*keys, "_v"])
    hits = shared.groupBy(*dict.fromkeys([*keys, "draft"]), "commitment_id", "event_seq", "_n").agg(F.array_sort(F.collect_set("_v")).alias("terms"))
    hits = hits.where(F.size("terms") >= F.greatest(F.lit(least), F.floor(F.col("_n") * F.lit(ratio)).cast("int")))
    first = F.row_number().over(W.partitionBy(*dict.fromkeys([*keys, "draft"]), "commitment_id").orderBy("event_seq"))
    return hits.withColumn("_r", first).where("_r = 1").drop("_r", "_n")


def critique(drafts: DataFrame, findings: DataFrame, unresolved: DataFrame | None = None, key: str = "draft") -> DataFrame:
    """A row for each draft: fails, warns, and passed: reviewable and without a failure. findings: draft, check, severity."""
    if unresolved is not None:
        findings = findings.select(key, "check", "severity").unionByName(unresolved.select(key).distinct().withColumns({"check": F.lit("claim_resolution"), "severity": F.lit("warn")}))
    counts = findings.groupBy(key).agg(F.count_if(F.col("severity") == "fail").alias("fails"), F.count_if(F.col("severity") == "warn").alias("warns"), F.array_join(F.array_sort(F.collect_set("check")), ",").alias("checks"))
    out = drafts.join(counts, key, "left").withColumns({"fails": F.coalesce("fails", F.lit(0)), "warns": F.coalesce("warns", F.lit(0)), "checks": F.coalesce("checks", F.lit(""))})
    return out.withColumn("passed", F.col("reviewable") & (F.col("fails") == 0))


def latest_reports(reports: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The report that stands for each key: the last one whose verdict is ok."""
    columns = [c for c in reports.columns if c not in keys]
    return reports.where("verdict = 'ok'").groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def draft_queue(drafts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """drafts with state: pending for the newest parked one of a key, superseded for older ones, refused or accepted else.

    Drafts with failures, errors or nothing to review are parked; those whose critic was unavailable are refused.
    """
    parked = F.col("verdict").isin("fail", "error", "unreviewable")
    n = F.row_number().over(W.partitionBy(*keys, parked).orderBy(*[F.desc(c) for c in order]))
    state = F.when(F.col("verdict") == "unavailable", "refused").when(parked, F.when(n == 1, "pending").otherwise("superseded")).otherwise("accepted")
    return drafts.withColumn("state", state)


def override_flags(accepted: DataFrame, findings: DataFrame, key: str = "draft") -> DataFrame:
    """One flag for each blocking finding of a draft accepted in spite of it."""
    said = F.when(F.col("edited"), "accepted after editing: ").otherwise("accepted unedited: ")
    return accepted.join(findings.where("severity = 'fail'"), key).select(key, F.concat(said, F.col("message")).alias("flag"))


def resolve_claims(claims: DataFrame, surfaces: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(claims with id, claims whose name is unknown): surfaces (keys, surface, id, is_name), names before aliases."""
    best = surfaces.groupBy(*keys, "surface").agg(F.max_by("id", F.struct("is_name", -F.col("id"))).alias("id"))
    met = claims.withColumn("surface", X.fold_name("name")).join(best, [*keys, "surface"], "left").drop("surface")
    return met.where("id is not null"), met.where("id is null").drop("id")


def claim_coverage(claims: DataFrame, surfaces: DataFrame, keys: list[str], draft: str = "draft") -> DataFrame:
    """(keys, draft, kind, resolved, unresolved, later) of the claims (keys, draft, chapter, kind, name) of drafts.

    Surfaces (keys, surface, id, is_name, first) count as known where they appeared before the draft's chapter, or never say when;
    later are claims of names that appear only from the chapter on, and are among the unresolved.
    """
    named = claims.withColumn("surface", X.fold_name("name"))
    begun = surfaces.groupBy(*keys, "surface").agg(F.min(F.coalesce("first", F.lit(-1))).alias("_first"))
    met = named.join(begun, [*keys, "surface"], "left")
    known = F.coalesce(F.col("_first") < F.col("chapter"), F.lit(False))
    return met.groupBy(*keys, draft, "kind").agg(F.count_if(known).alias("resolved"), F.count_if(~known).alias("unresolved"), F.count_if(~known & F.col("_first").isNotNull()).alias("later"))


def due_commitments(commitments: DataFrame, drafts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, draft, the commitments' columns): what a draft of a chapter may pay off: planted by then, and still open when it begins."""
    met = commitments.join(drafts.select(*keys, "draft", "chapter"), keys)
    return met.where((F.col("foreshadow_chapter") <= F.col("chapter")) & (F.col("payoff_chapter").isNull() | (F.col("payoff_chapter") >= F.col("chapter")))).drop("chapter")
