"""Entity resolution: dictionary, nearest canonical, decisions, new canonicals; links of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizmill.operators.numbering import numbered
from quizmill.operators.search import encode, hashed_grams, nearest
from quizmill.session import small, stored


def post_aliases(mentions: DataFrame) -> DataFrame:
    """Distinct trimmed non-empty aliases per post and type from ``mentions(post_id, entity_type, alias)``."""
    return mentions.select("post_id", "entity_type", F.trim("alias").alias("alias")).filter(F.length("alias") > 0).distinct()


def post_canonicals(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """The canonical of each mention, ``post_id, entity_type, canonical_id``, from ``mentions(post_id, entity_type, alias)`` and
    ``resolved(entity_type, alias, canonical_id)``. Names leave before anything is dealt by post; repeated rows stay."""
    names = mentions.select("post_id", "entity_type", F.trim("alias").alias("alias")).filter(F.length("alias") > 0)
    return names.join(resolved.select("entity_type", "alias", "canonical_id"), ["entity_type", "alias"]).select("post_id", "entity_type", "canonical_id")


def resolve_dictionary(aliases: DataFrame, alias_dict: DataFrame) -> DataFrame:
    """Aliases with ``canonical_id`` (null: not in the dictionary) and confidence 1."""
    known = alias_dict.select("entity_type", "alias", "canonical_id")
    return aliases.join(known, ["entity_type", "alias"], "left").withColumn("confidence", F.when(F.col("canonical_id").isNotNull(), 1.0))


def resolve_vector(aliases: DataFrame, canonicals: DataFrame, k: int = 5, high: float = 0.85) -> DataFrame:
    """The ``k`` nearest canonicals of each alias: ``alias_id, canonical_id, similarity, rank, matched``; the best one
    matches from ``high``. Inputs: ``aliases(alias_id, embedding)``, ``canonicals(canonical_id, embedding)`` of one type."""
    found = nearest(aliases.select(F.col("alias_id").alias("query_id"), "embedding"), canonicals.select(F.col("canonical_id").alias("id"), "embedding"), k)
    return found.select(F.col("query_id").alias("alias_id"), F.col("id").alias("canonical_id"), "similarity", "rank", ((F.col("rank") == 1) & (F.col("similarity") >= high)).alias("matched"))


def review_candidates(ranked: DataFrame, low: float = 0.55) -> DataFrame:
    """For review, per alias: candidates of at least ``low``, best first."""
    item = F.struct("rank", "canonical_id", "similarity")
    return ranked.filter(F.col("similarity") >= low).groupBy("alias_id").agg(F.array_sort(F.collect_list(item)).alias("candidates"))


def apply_decisions(unresolved: DataFrame, decisions: DataFrame, min_conf: float = 0.7) -> DataFrame:
    """Aliases with the decision on them: accepted with an id and a confidence of at least ``min_conf`` (missing: 0.5)."""
    d = decisions.select("entity_type", "alias", F.col("canonical_id").alias("d_id"), F.coalesce("confidence", F.lit(0.5)).alias("d_conf"), "is_match", "proposed")
    out = unresolved.join(d, ["entity_type", "alias"], "left")
    ok = F.coalesce(F.col("is_match") & F.col("d_id").isNotNull() & (F.col("d_conf") >= min_conf), F.lit(False))
    return out.withColumn("canonical_id", F.when(ok, F.col("d_id"))).withColumn("confidence", F.when(ok, F.col("d_conf"))).drop("d_id", "d_conf", "is_match")


def create_canonicals(unresolved: DataFrame, canonicals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved aliases, new canonicals). The name is the proposed one or the alias; an existing name gives its id, others
    the next ids of their type by name. Only distinct new names are numbered, in ranges of names."""
    named = unresolved.withColumn("name", F.coalesce(F.nullif(F.trim("proposed"), F.lit("")), "alias"))
    fresh = named.select("entity_type", F.col("name").alias("canonical")).distinct().join(canonicals, ["entity_type", "canonical"], "left_anti")
    top = canonicals.groupBy("entity_type").agg(F.max("id").alias("top"))
    fresh = numbered(fresh, ["canonical"], ["entity_type"])
    new = fresh.join(small(top), "entity_type", "left").select("entity_type", (F.coalesce("top", F.lit(0)) + F.col("number")).cast("long").alias("id"), "canonical")
    every = canonicals.select("entity_type", "id", "canonical").unionByName(new)
    out = named.drop("canonical_id", "confidence").join(every.withColumnRenamed("canonical", "name").withColumnRenamed("id", "canonical_id"), ["entity_type", "name"])
    return out.withColumn("confidence", F.lit(0.5)), new


def learn_aliases(alias_dict: DataFrame, resolved: DataFrame) -> DataFrame:
    """The dictionary with aliases that it lacks, never overwriting one. New canonicals are learned with confidence 1, also
    under their own name. Of several ids for an alias the smallest is learned."""
    conf = F.when(F.col("source") == "new", 1.0).otherwise(F.col("confidence"))
    rows = resolved.filter("source <> 'dictionary'").select("entity_type", "alias", "canonical_id", conf.alias("confidence"))
    if "name" in resolved.columns:
        rows = rows.unionByName(resolved.filter("source = 'new'").select("entity_type", F.col("name").alias("alias"), "canonical_id", F.lit(1.0).alias("confidence")))
    first = Window.partitionBy("entity_type", "alias").orderBy("canonical_id", F.desc("confidence"))
    new = rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").join(alias_dict, ["entity_type", "alias"], "left_anti")
    return alias_dict.select("entity_type", "alias", "canonical_id", F.col("confidence").cast("double").alias("confidence")).unionByName(new)


def vector_tier(names: DataFrame, canonicals: DataFrame, encoder=hashed_grams, k: int = 5, high: float = 0.85, low: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """(matches, review) of ``names(entity_type, alias)``: ``entity_type, alias, canonical_id, similarity`` of those whose nearest
    canonical of the type reaches ``high``, and ``entity_type, alias, candidates`` of the others, with canonicals from ``low``
    on, best first (none: an empty array). Names and canonicals are encoded alike; each type, of the few that there are, is searched alone.
    """
    asked = stored(encode(names.select(F.monotonically_increasing_id().alias("alias_id"), "entity_type", "alias"), "alias", encoder), "names")
    known = stored(encode(canonicals.select("entity_type", "id", "canonical"), "canonical", encoder), "canonicals")
    ranked = None
    for (kind,) in asked.select("entity_type").distinct().collect():  # a closed domain: companies and positions
        own = F.col("entity_type").eqNullSafe(F.lit(kind))
        one = resolve_vector(asked.filter(own).select("alias_id", "embedding"), known.filter(own).select(F.col("id").alias("canonical_id"), "embedding"), k, high)
        ranked = one if ranked is None else ranked.unionByName(one)
    if ranked is None:
        ranked = asked.sparkSession.createDataFrame([], "alias_id long, canonical_id long, similarity double, rank int, matched boolean")
    ranked = stored(ranked, "ranked")
    ids = asked.select("alias_id", "entity_type", "alias")
    matches = ids.join(ranked.filter("matched").select("alias_id", "canonical_id", "similarity"), "alias_id")
    review = ids.join(matches.select("alias_id"), "alias_id", "left_anti").join(review_candidates(ranked, low), "alias_id", "left")
    kind = review.schema["candidates"].dataType
    return matches.drop("alias_id"), review.select("entity_type", "alias", F.coalesce("candidates", F.array().cast(kind)).alias("candidates"))


def resolve(aliases: DataFrame, alias_dict: DataFrame, canonicals: DataFrame, decisions, encoder=None, high: float = 0.85, low: float = 0.55) -> DataFrame:
    """Distinct aliases ``entity_type, alias`` through all tiers: ``canonical_id, source, confidence, name``.

    Tiers: dictionary, vector (with an ``encoder``), decision, new canonical. ``decisions`` is a table, see ``apply_decisions``, or a
    function that makes one from the names under review, ``entity_type, alias, candidates`` (see ``vector_tier``; without an
    encoder there are no candidates). Several decisions on a name count as one, the least.
    """
    names = stored(aliases.select("entity_type", "alias").distinct(), "names")  # every tier reads them
    first = stored(resolve_dictionary(names, alias_dict), "dictionary")
    none = F.lit(None).cast("string").alias("name")
    done = [first.filter("canonical_id is not null").select("entity_type", "alias", "canonical_id", F.lit("dictionary").alias("source"), "confidence", none)]
    rest = first.filter("canonical_id is null").select("entity_type", "alias")
    review = rest.withColumn("candidates", F.array().cast("array<struct<rank:int,canonical_id:bigint,similarity:double>>"))
    if encoder is not None:
        matches, review = vector_tier(rest, canonicals, encoder, high=high, low=low)
        done.append(matches.select("entity_type", "alias", "canonical_id", F.lit("vector").alias("source"), F.col("similarity").alias("confidence"), none))
        review = stored(review, "review")
        rest = review.select("entity_type", "alias")
    given = decisions(review) if callable(decisions) else decisions
    fields = ["canonical_id", "confidence", "is_match", "proposed"]
    given = given.groupBy("entity_type", "alias").agg(F.min(F.struct(*fields)).alias("d")).select("entity_type", "alias", "d.*")
    decided = stored(apply_decisions(rest, given), "decided")
    done.append(decided.filter("canonical_id is not null").select("entity_type", "alias", "canonical_id", F.lit("decision").alias("source"), "confidence", none))
    new, _ = create_canonicals(decided.filter("canonical_id is null"), canonicals)
    done.append(new.select("entity_type", "alias", "canonical_id", F.lit("new").alias("source"), "confidence", "name"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def rebuild_links(resolved: DataFrame, links: DataFrame) -> DataFrame:
    """Per post every company with every position, replacing the links of these posts; none if a side is empty. ``resolved`` is read
    three times, so it is best stored; each side is dealt once, by post, for its distinct rows and the join."""
    def side(kind: str, out: str) -> DataFrame:
        return resolved.filter(F.col("entity_type") == kind).select("post_id", F.col("canonical_id").alias(out)).repartition("post_id").distinct()

    new = side("company", "company_id").join(side("position", "position_id"), "post_id")
    kept = links.join(resolved.select("post_id").distinct(), "post_id", "left_anti")
    return kept.select("post_id", "company_id", "position_id").unionByName(new.select("post_id", "company_id", "position_id"))


def alias_growth(alias_dict: DataFrame) -> DataFrame:
    return alias_dict.groupBy("entity_type").agg(F.count("*").alias("n"))


def learned_aliases(alias_dict: DataFrame, limit: int) -> DataFrame:
    """Aliases of a confidence below 1, newest first."""
    order = [F.desc_nulls_last("learned_at")] if "learned_at" in alias_dict.columns else []
    return alias_dict.filter("confidence < 1").orderBy(*order, "entity_type", "alias").limit(limit)


def list_aliases(alias_dict: DataFrame, canonicals: DataFrame, entity_type: str) -> DataFrame:
    named = canonicals.filter(F.col("entity_type") == entity_type).select(F.col("id").alias("canonical_id"), "canonical")
    return alias_dict.filter(F.col("entity_type") == entity_type).join(named, "canonical_id").select("canonical", "alias", "confidence").orderBy("canonical", "alias")


def tier_shares(resolved: DataFrame) -> DataFrame:
    n = resolved.groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
