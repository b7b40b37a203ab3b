"""Severity, density, impact score and the per-hotspot impact rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.operators.temporal import KEY, hotspots, lookup
from gridwarden.session import written


def severity(c: Column, settings: Settings) -> Column:
    """Highest weight among the contained keywords, never below the default."""
    body = F.coalesce(c, F.lit(""))
    default = F.lit(float(settings.default_severity))
    hits = [
        F.when(body.contains(F.lit(word)), float(weight))
        for word, weight in settings.severity_rules.items()
    ]
    return F.greatest(default, *hits) if hits else default


def add_severity(df: DataFrame, settings: Settings) -> DataFrame:
    return df.withColumn("severity", severity(F.col("violation_type_clean"), settings))


GRAM = 3  # characters


def _grams(size: int) -> Column:
    """All stretches of so many characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def severity_by_rule_table(df: DataFrame, rules: DataFrame, settings: Settings) -> DataFrame:
    """The same answer for a rule table (keyword, weight) of any length.

    Texts are cut into their grams of three characters, and of one or two if a keyword is so
    short, so the table of grams grows with the length of the texts alone. Each keyword is
    indexed by the one of its grams that the fewest texts have; a text that has that gram is
    then searched for the keyword. A keyword with a gram that no text has is in none. The empty
    keyword is in every text. Offence texts repeat, so only the distinct ones are taken apart;
    a null text counts as the empty one.
    """
    rules = rules.groupBy("keyword").agg(F.max("weight").cast("double").alias("weight"))
    rules = written(rules.where("keyword IS NOT NULL"), "rules")
    gram_size = F.least(F.length("keyword"), F.lit(GRAM))
    sizes = [r[0] for r in rules.select(gram_size).distinct().collect()]  # at most four
    always = rules.where("keyword = ''").agg(F.max("weight")).first()[0]
    anywhere = max([float(settings.default_severity), *([always] if always is not None else [])])

    text = F.coalesce("violation_type_clean", F.lit(""))
    texts = df.select(text.alias("_text")).distinct().withColumn("_nth", F.monotonically_increasing_id())
    texts = written(texts, "texts")
    pieces = [_grams(s) for s in sizes if s] or [F.array().cast("array<string>")]
    grams = written(texts.select("_nth", F.explode(F.concat(*pieces)).alias("gram")), "grams")
    found_in = grams.groupBy("gram").agg(F.count("*").alias("n"))

    stretches = F.sequence(F.lit(1), F.length("keyword") - F.col("size") + 1)
    own = F.array_distinct(F.transform(stretches, lambda i: F.substring("keyword", i, F.col("size"))))
    index = (
        rules.where("keyword <> ''")
        .withColumn("size", gram_size)
        .select("keyword", "weight", F.explode(own).alias("gram"))
        .join(found_in, "gram", "left")
        .groupBy("keyword", "weight")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
        .where("rarest.n > 0")
        .select("keyword", "weight", F.col("rarest.gram").alias("gram"))
    )
    hits = (
        grams.join(index, "gram")
        .join(texts, "_nth")
        .where(F.contains("_text", "keyword"))
        .groupBy("_nth")
        .agg(F.max("weight").alias("_best"))
    )
    hits = texts.join(hits, "_nth").select("_text", "_best")
    best = F.greatest(F.lit(anywhere), F.coalesce("_best", F.lit(anywhere)))
    joined = df.join(hits, text == F.col("_text"), "left")
    return joined.withColumn("severity", best).drop("_text", "_best")


def density(df: DataFrame) -> DataFrame:
    return hotspots(df).groupBy(*KEY).agg(F.count("*").alias("cluster_density"))


def add_density(df: DataFrame) -> DataFrame:
    joined = lookup(df, density(df), KEY)
    return joined.withColumn(
        "cluster_density", F.coalesce("cluster_density", F.lit(1)).cast("double")
    )


def impact_score() -> Column:
    return (
        F.col("cluster_density")
        * F.col("severity")
        * F.col("vehicle_weight")
        * F.col("rush_hour_factor")
    )


def hotspot_impact(scored: DataFrame, settings: Settings) -> DataFrame:
    """One row per hotspot; the commonest junction and station, smallest name on a tie."""
    return (
        hotspots(scored)
        .groupBy(*KEY)
        .agg(
            F.mode("junction_name", True).alias("junction_name"),
            F.mode("police_station", True).alias("police_station"),
            F.avg("latitude").alias("center_latitude"),
            F.avg("longitude").alias("center_longitude"),
            F.count("*").alias("total_violations"),
            F.sum("impact_score").alias("total_impact_score"),
            F.avg("impact_score").alias("average_impact_per_vehicle"),
            F.count_if(F.col("severity") >= settings.high_severity).alias(
                "high_severity_incidents"
            ),
        )
        .fillna({"junction_name": "Unknown", "police_station": "Unknown"})
    )
