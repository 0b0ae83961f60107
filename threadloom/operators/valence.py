"""Valence of words in their context: negation, boosters, capitals, contrast and stress change what a word counts.

The rules and weights are those published with the VADER lexicon (Hutto and Gilbert, 2014); the lexicon and the lists of
boosters and negations are the caller's. All is Spark's own functions: a text's words are exploded with the text's
word list, so that each sees those before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published weights.
CAPITALS, BOOST, NEGATED, EXCLAIMED, ASKED, ASKED_MOST = 0.733, 0.293, -0.74, 0.292, 0.18, 0.96
FADING = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT, ALPHA = 0.5, 1.5, 15.0


@dataclass(frozen=True)
class Context:
    """Words that strengthen, weaken or negate what follows within three words; none of them need be in the lexicon."""

    stronger: tuple[str, ...] = ("absolutely", "completely", "deeply", "extremely", "incredibly", "really", "so", "totally", "truly", "utterly", "very")
    weaker: tuple[str, ...] = ("almost", "barely", "hardly", "kinda", "less", "little", "partly", "scarcely", "slightly", "somewhat")
    negations: tuple[str, ...] = ("aint", "ain't", "cannot", "can't", "cant", "didn't", "doesn't", "don't", "dont", "isn't", "neither", "never", "no", "none", "nor", "not", "nothing", "nowhere", "without", "won't", "wouldn't")
    contrast: str = "but"


def words_of(body: Column) -> Column:
    """Runs without white space, less the punctuation around them; what is punctuation alone is left out."""
    edge = "[" + "".join("\\" + c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "]+"
    bare = lambda t: F.regexp_replace(t, f"^{edge}|{edge}$", "")
    return F.filter(F.transform(F.split(F.trim(F.regexp_replace(body, r"(?U)\s+", " ")), " "), bare), lambda t: t != "")


def _shouted(t: Column) -> Column:
    return (t == F.upper(t)) & (t != F.lower(t))


def scores(texts: DataFrame, lexicon: DataFrame, context: Context | None = None, rows: int = 500_000) -> DataFrame:
    """(key, score) of texts (key, body) that hold a word of the lexicon (word, valence): within -1 and 1; other texts score 0 and aren't listed.

    A word in capitals, where not all are, counts more. Boosters among the three words before it add or take, less from
    farther off, and each negation there turns it. Before the contrast word words count half, after it half more.
    Exclamation marks (four at most) and repeated question marks stress the sum. The lexicon is broadcast up to `rows` words.
    """
    c = context or Context()
    made = texts.select("key", F.coalesce("body", F.lit("")).alias("body")).withColumn("words", words_of(F.col("body")))
    loud = F.size(F.filter("words", _shouted))
    made = made.withColumn("mixed", (loud > 0) & (loud < F.size("words"))).withColumn("but", F.array_position(F.transform("words", F.lower), c.contrast))
    few = lexicon.limit(rows + 1).count() <= rows
    each = made.select("*", F.posexplode("words").alias("pos", "said")).join((F.broadcast(lexicon) if few else lexicon).select(F.col("word").alias("_w"), F.col("valence").cast("double").alias("_v")), F.lower("said") == F.col("_w"))
    sign = F.signum("_v")
    v = F.col("_v") + F.when(F.col("mixed") & _shouted(F.col("said")), sign * CAPITALS).otherwise(0.0)
    for k, fading in enumerate(FADING, 1):
        before = F.when(F.col("pos") >= k, F.element_at("words", F.greatest(F.col("pos") - k + 1, F.lit(1))))
        low = F.lower(before)
        boost = F.when(low.isin(*c.stronger), BOOST).when(low.isin(*c.weaker), -BOOST)
        more = sign * boost + F.when(F.col("mixed") & _shouted(before), sign * CAPITALS * F.signum(boost)).otherwise(0.0)
        v = v + F.coalesce(more * fading, F.lit(0.0))
        v = F.when(low.isin(*c.negations), v * NEGATED).otherwise(v)
    v = v * F.when(F.col("but") == 0, 1.0).when(F.col("pos") + 1 < F.col("but"), BEFORE_BUT).when(F.col("pos") + 1 > F.col("but"), AFTER_BUT).otherwise(1.0)
    total = each.withColumn("v", v).groupBy("key").agg(F.sum("v").alias("s"), F.first("body").alias("body"))
    marks = lambda m: F.length("body") - F.length(F.replace("body", F.lit(m), F.lit("")))
    stress = F.least(marks("!"), F.lit(4)) * EXCLAIMED + F.when(marks("?") > 3, ASKED_MOST).when(marks("?") > 1, marks("?") * ASKED).otherwise(0.0)
    s = F.col("s") + F.signum("s") * stress
    return total.select("key", (s / F.sqrt(s * s + ALPHA)).alias("score"))
