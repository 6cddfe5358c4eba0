"""Ranked search in catalogs: posting lists with frequencies and lengths, the best few entities of each keyword by relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

#: What a repeated term adds, and how much long entities are held back.
SATURATION, LENGTH = 1.2, 0.75


def terms(text: Column) -> Column:
    """Runs of letters and digits in lower case, with repeats; none of a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def postings(entities: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """(term, key, gain): what each term of an entity adds to its relevance, in whole thousandths.

    The gain is the term's rarity times its saturated frequency, held back by the entity's length against the mean.
    Rows of one key count as one text; a null key is left out."""
    split = entities.where(F.col(key).isNotNull()).select(key, F.posexplode(terms(text)).alias("_p", "term"))
    found = split.groupBy(key, "term").agg(F.count("*").alias("_tf"))
    sizes = found.groupBy(key).agg(F.sum("_tf").alias("_n"))
    total = sizes.agg(F.count("*").alias("_all"), F.sum("_n").alias("_words"))
    held = found.groupBy("term").agg(F.count("*").alias("_df"))
    rows = found.join(sizes, key).join(held, "term").crossJoin(F.broadcast(total))  # one row of totals
    rarity = F.log(1 + (F.col("_all") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    back = SATURATION * (1 - LENGTH + LENGTH * F.col("_n") * F.col("_all") / F.col("_words"))
    return rows.select("term", key, F.floor(1000 * rarity * F.col("_tf") * (SATURATION + 1) / (F.col("_tf") + back)).cast("bigint").alias("gain"))


def best(keywords: DataFrame, lists: DataFrame, most: int = 5, keyword: str = "keyword", key: str = "id") -> DataFrame:
    """(keyword, rank, key, score): the entities of highest score for each keyword, equal scores by key; none where no term fits.

    A keyword's score of an entity is the sum of its different terms' gains. The `most`-th gain of one list is a floor
    for the last place, so terms whose largest gains together stay under the highest such floor can't lift an entity
    into it on their own: their lists are read only for entities that another term brings. No score is lost by that.

    Entities of the same terms and gains have the same scores, so one of them, that of the least key, is scored for all;
    the best groups hold the best entities, and of each the `most` least keys are given out at the end."""
    groups = lists.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "gain"))).alias("_g")).select(key, F.sha2(F.to_json("_g"), 256).alias("_g"))
    groups = groups.withColumns({"_n": F.row_number().over(W.partitionBy("_g").orderBy(key)), "_first": F.min(key).over(W.partitionBy("_g"))}).where(F.col("_n") <= most)
    groups = stored(groups.select(F.col("_first"), F.col(key).alias("_member")), "groups")
    lists = stored(lists.join(groups.where("_first = _member").select(F.col("_first").alias(key)), key, "left_semi").select("term", key, "gain"), "postings")
    ends = W.partitionBy("term").orderBy(F.desc("gain"), key)
    tops = lists.withColumn("_r", F.row_number().over(ends)).where(F.col("_r") <= most).groupBy("term")
    tops = tops.agg(F.max("gain").alias("_max"), F.max(F.when(F.col("_r") == most, F.col("gain"))).alias("_floor"))
    asked = keywords.where(F.col(keyword).isNotNull()).select(F.col(keyword).alias("_q")).distinct().select("_q", F.explode(F.array_distinct(terms(F.col("_q")))).alias("term"))
    asked = asked.join(tops, "term")
    every = W.partitionBy("_q")  # a keyword's own terms
    rising = every.orderBy("_max", "term").rowsBetween(W.unboundedPreceding, 0)
    asked = asked.withColumns({"_least": F.coalesce(F.max("_floor").over(every), F.lit(0)), "_sum": F.sum("_max").over(rising)})
    asked = stored(asked.select("_q", "term", (F.col("_sum") >= F.col("_least")).alias("_leads")), "terms")
    led = asked.where("_leads").join(lists, "term").groupBy("_q", key).agg(F.sum("gain").alias("_s"))
    led = stored(led, "led")
    more = asked.where("not _leads").join(lists, "term").join(led.select("_q", key), ["_q", key], "left_semi").select("_q", key, F.col("gain").alias("_s"))
    score = led.unionByName(more).groupBy("_q", key).agg(F.sum("_s").alias("score"))
    place = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), key))
    ranked = score.withColumn("rank", place).where(F.col("rank") <= most)
    ranked = ranked.withColumnRenamed(key, "_first").join(groups, "_first").select("_q", F.col("_member").alias(key), "score")
    ranked = ranked.withColumn("rank", place).where(F.col("rank") <= most)
    return ranked.select(F.col("_q").alias(keyword), "rank", key, "score")


def first_hits(keywords: DataFrame, entities: DataFrame, text: Column, keyword: str = "keyword", key: str = "id") -> DataFrame:
    """keywords with the key of the entity that ranks first; those without any are left out."""
    lists = stored(postings(entities, text, key), "postings")
    hits = best(keywords, lists, 1, keyword, key).select(F.col(keyword).alias("_k"), key)
    return keywords.join(hits, F.col(keyword) == F.col("_k")).drop("_k")
