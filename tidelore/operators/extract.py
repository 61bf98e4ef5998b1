"""Typed atoms from turns by ordered cue rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as K
from ..functions.features import distinct_features
from ..functions.text import any_cue, has_anchor, looked_up, sentences, strip


def _first_cue(low: Column, rules: list[tuple[str, float, str]], case: Column | None = None) -> Column:
    for kind, conf, cues in rules:
        hit = F.struct(F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"))
        case = F.when(any_cue(low, cues), hit) if case is None else case.when(any_cue(low, cues), hit)
    return case


def classify_user(s: Column, low: Column | None = None) -> Column:
    low = F.lower(s) if low is None else low
    contrast = F.contains(low, F.lit("不是")) & any_cue(low, "而是|是我们要|实际上")
    case = F.when(contrast, F.struct(F.lit("DECISION").alias("kind"), F.lit(0.98).alias("confidence")))
    return _first_cue(low, K.USER_CUES, case).when(low.rlike("(?<!能)不能"), F.struct(F.lit("WARNING").alias("kind"), F.lit(0.92).alias("confidence")))


def classify_other(s: Column, low: Column | None = None) -> Column:
    return _first_cue(F.lower(s) if low is None else low, K.OTHER_CUES)


def is_question(s: Column) -> Column:
    t = strip(s)
    return t.rlike("[?？]$") | any_cue(F.lower(t), K.QUESTION_CUES) | t.rlike("[吗呢么][,，。.!！]?$")


def has_number(s: Column) -> Column:
    return s.rlike(r"(?U)\b\d{2,}\b|\d+\s*[–-]\s*\d+")


def fact_confidence(s: Column, role: Column, low: Column) -> Column:
    """Confidence of a factual sentence, else null. What costs least is tested first."""
    size = F.length(s)
    anchored, number = has_anchor(s), has_number(s)
    user = (role == "user") & (size >= 18) & (anchored | number)
    other = (role != "user") & size.between(20, 420) & ((any_cue(low, K.DEFINITION_CUES) & anchored) | (any_cue(low, K.UNIT_CUES) & number))
    return F.when((user | other) & ~s.rlike(r"^\[(Image|PDF)") & ~is_question(s) & (distinct_features(s) >= 3), F.when(role == "user", 0.70).otherwise(0.67))


def sentence_atoms(turns: DataFrame, keys: list[str], text: str = "content", role: str = "role") -> DataFrame:
    """(keys, role, pos, content, kind, confidence) of every sentence that some rule takes."""
    parts = F.transform(sentences(F.col(text)), lambda x: F.struct(x.alias("content"), F.lower(x).alias("low")))
    s = turns.select(*keys, F.col(role).alias("role"), F.posexplode(parts).alias("pos", "s")).select(*keys, "role", "pos", "s.content", "s.low").filter(F.length("content") <= 700)
    user, said, low = F.col("role") == "user", F.col("content"), F.col("low")
    fact = F.transform(F.array(fact_confidence(said, F.col("role"), low)), lambda f: F.when(f.isNotNull(), F.struct(F.lit("FACT").alias("kind"), f.alias("confidence"))))[0]
    ruled = F.coalesce(F.when(user, classify_user(said, low)).otherwise(classify_other(said, low)), fact)
    # The rules are tested once, in compiled code: a filter on their result isn't moved below a generator, as it is below a
    # projection; the outer one infers no filter of its own.
    s = s.withColumn("_c", F.array(ruled)).select(*keys, "role", "pos", "content", F.explode_outer("_c").alias("c")).filter("c is not null").select(*keys, "role", "pos", "content", "c.kind", F.col("c.confidence").alias("raw"))
    conf = F.when(user, F.least(F.lit(0.99), F.col("raw") + 0.03)).when(F.col("role") == "assistant", F.greatest(F.lit(0.1), F.col("raw") - 0.08)).otherwise(F.col("raw"))
    return s.select(*keys, "role", "pos", "content", "kind", F.round(conf, 4).alias("confidence"))


def atoms(turns: DataFrame, keys: list[str], text: str = "content", role: str = "role") -> DataFrame:
    """The best atoms of each turn: distinct by kind and lower-cased content, 8 of a user's and 2 of others'; `rank` from 1."""
    order = [F.desc("priority"), F.desc("confidence"), F.length("content"), F.col("pos")]
    # Dealt once, by turn; both rankings are made there.
    s = sentence_atoms(turns, keys, text, role).repartition(*keys).withColumn("priority", looked_up(F.col("kind"), K.KIND_PRIORITY, 0))
    s = s.withColumn("copy", F.row_number().over(W.partitionBy(*keys, "kind", F.lower("content")).orderBy(*order))).filter("copy = 1")
    s = s.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return s.filter(F.col("rank") <= F.when(F.col("role") == "user", 8).otherwise(2)).select(*keys, "role", "rank", "kind", "content", "confidence")
