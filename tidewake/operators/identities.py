"""People of two systems matched by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import facts, query
from ..sources.store import checkpointed

#: Confidence from which a match is kept.
LEAST = 0.5
#: People that share a part of a name, above which the part tells too little to look them up by alone.
COMMON = 200


def _parts(name: Column) -> Column:
    """The parts of a name: lower-case runs of letters and digits without accents, in order, each once."""
    plain = F.translate(F.lower(name), "áàâäãåéèêëíìîïóòôöõúùûüñçß", "aaaaaaeeeeiiiiooooouuuuncs")
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, "[^a-z0-9]+"), lambda p: p != "")))


def _likeness(a: Column, b: Column) -> Column:
    """How alike two names are, 0 to 1: the mean of the share of parts in common and of the letters kept between the parts joined."""
    common = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    x, y = F.array_join(a, ""), F.array_join(b, "")
    return (common + 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))) / 2


def match_identities(ours: DataFrame, theirs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(our, their, confidence): people who are each other's best match. ours, theirs: (id, name); known: (our, their) pairs already mapped, whose people take no part.

    Pairs are looked at if they share a part of a name that few have, or, where all
    parts are common, two parts at once, so a frequent first name makes no pairs of
    its own. The best is the likeliest, then the least id; a pair stays if each
    side prefers the other and its confidence is ``LEAST`` or more. People without
    letters or digits in their names match nobody; several names of one id are one
    person.
    """
    if known is not None:
        ours, theirs = ours.join(known.select(F.col("our").alias("id")), "id", "left_anti"), theirs.join(known.select(F.col("their").alias("id")), "id", "left_anti")
    # Of people named alike only the first can be anyone's best, so each name is looked up once.
    named = lambda df: checkpointed(df.where("name is not null").select("id", _parts(F.col("name")).alias("parts")).where("size(parts) > 0").groupBy("parts").agg(F.min("id").alias("id")))
    ours, theirs = named(ours), named(theirs)
    frequent = ours.unionByName(theirs).select(F.explode("parts").alias("part")).groupBy("part").agg((F.count("*") > COMMON).alias("common"))  # names, not people

    def keys(df: DataFrame) -> DataFrame:
        told = df.select("id", "parts", F.explode("parts").alias("part")).join(frequent, "part").groupBy("id", "parts").agg(F.array_sort(F.collect_list(F.when(F.col("common"), F.col("part")))).alias("often"), F.collect_list(F.when(~F.col("common"), F.col("part"))).alias("rare"))
        pairs = F.flatten(F.transform("often", lambda a: F.transform(F.filter(F.col("often"), lambda b: b > a), lambda b: F.concat(a, F.lit(" "), b))))
        whole = F.when(F.size("parts") == 1, F.transform("often", lambda a: F.concat(a, F.lit(" ")))).otherwise(F.array())
        return told.select("id", "parts", F.explode(F.concat("rare", pairs, whole)).alias("key"))

    left, right = keys(ours).withColumnsRenamed({"id": "our", "parts": "a"}), keys(theirs).withColumnsRenamed({"id": "their", "parts": "b"})
    scored = left.join(right, "key").select("our", "their", F.round(_likeness(F.col("a"), F.col("b")), 6).alias("confidence")).groupBy("our", "their").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") >= LEAST)
    first = lambda side, other: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("confidence"), other))
    return scored.withColumn("x", first("our", "their")).withColumn("y", first("their", "our")).where("x = 1 and y = 1").select("our", "their", "confidence")


_WORDS = "greatest(length(x), length(y))"
_PEOPLE = f"""people AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda p: p <> ''))) AS parts FROM part),
ours AS (SELECT id, parts, array_to_string(parts, '') AS x FROM people WHERE id % 2 = 0), theirs AS (SELECT id, parts, array_to_string(parts, '') AS y FROM people WHERE id % 2 = 1),
common AS (SELECT part, count(*) > 200 AS common FROM (SELECT unnest(parts) AS part FROM (SELECT DISTINCT id % 2, parts FROM people)) GROUP BY 1),
keys AS (SELECT id, part AS key FROM (SELECT id, unnest(parts) AS part FROM people) JOIN common USING (part) WHERE NOT common UNION SELECT a.id, a.part || ' ' || b.part FROM (SELECT id, unnest(parts) AS part FROM people) a JOIN (SELECT id, unnest(parts) AS part FROM people) b ON a.id = b.id AND a.part < b.part WHERE a.part IN (SELECT part FROM common WHERE common) AND b.part IN (SELECT part FROM common WHERE common) UNION SELECT id, parts[1] || ' ' FROM people WHERE len(parts) = 1 AND parts[1] IN (SELECT part FROM common WHERE common)),
met AS (SELECT DISTINCT a.id AS our, b.id AS their FROM keys a JOIN keys b USING (key) WHERE a.id % 2 = 0 AND b.id % 2 = 1),
scored AS (SELECT our, their, round((len(list_intersect(o.parts, t.parts)) / len(list_distinct(list_concat(o.parts, t.parts))) + 1 - levenshtein(x, y) / {_WORDS}) / 2, 6) AS confidence FROM met JOIN ours o ON o.id = our JOIN theirs t ON t.id = their)"""


@query("issues", "SELECT our, their, confidence FROM (SELECT *, row_number() OVER (PARTITION BY our ORDER BY confidence DESC, their) AS a, row_number() OVER (PARTITION BY their ORDER BY confidence DESC, our) AS b FROM scored WHERE confidence >= 0.5) WHERE a = 1 AND b = 1", _PEOPLE)
def f26_matched_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names taken as people's: those of even number matched to those of odd number."""
    people = facts(spark, sf_dir, "parts").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return match_identities(people.where("id % 2 = 0"), people.where("id % 2 = 1"))
