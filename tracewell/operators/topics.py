"""Topic segmentation and grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import Config
from tracewell.functions import text as T
from tracewell.functions import vector as V

_STATE = "struct<cur:int,next:int,any:boolean,feats:array<string>,last:string,out:array<struct<turn:bigint,topic:int,switch:boolean>>>"


def water_pressure(tokens: Column, config: Config = Config()) -> Column:
    """What a long history takes off a similarity: 0 up to the start, all beyond the peak."""
    share = (tokens - config.pressure_start) / float(config.pressure_peak - config.pressure_start)
    return F.when(tokens <= config.pressure_start, 0.0).when(tokens >= config.pressure_peak, config.pressure_max).otherwise(share * config.pressure_max)


def representative_text(rows: DataFrame) -> DataFrame:
    """The text that stands for a turn: ``session_id, turn, fct``.

    That is the summary of the row at seq 0, else the last one of a final row, else the last one
    there is; null if there is none. ``rows`` has session_id, turn, seq, role, finish_reason and
    ``fct`` (as text, not as JSON).
    """
    has = F.coalesce(F.col("fct") != "", F.lit(False))
    user = F.max(F.when(has & (F.col("seq") == 0), F.col("fct")))
    fin = F.max_by("fct", F.when(has & (F.col("role") == "assistant") & (F.col("finish_reason") == "stop"), F.col("seq")))
    last = F.max_by("fct", F.when(has, F.col("seq")))
    return rows.groupBy("session_id", "turn").agg(F.coalesce(user, fin, last).alias("fct"))


def segment(turns: DataFrame, config: Config = Config()) -> DataFrame:
    """Topic of every turn: ``session_id, turn, topic_id, is_switch``.

    ``turns`` has ``session_id, turn, message`` and may have ``fct`` (the turn's representative text)
    and ``total_tokens``. One fold per session, in order of turn; sessions are independent. The
    profile of the open topic is a feature set: appending a text is a union plus the one pair that
    spans the joint, so the fold never carries the text.

    A turn of 0 or less, or an empty message, has no topic and leaves none open. A forced phrase
    opens a topic; a short message goes on with the open one and leaves its profile; the first
    turn opens topic 1; any other stays if its similarity less the pressure is high enough.
    """
    fct = F.col("fct") if "fct" in turns.columns else F.lit(None).cast("string")
    tokens = F.col("total_tokens") if "total_tokens" in turns.columns else F.lit(0)
    own = F.when(fct != "", fct)
    rows = turns.select("session_id", F.col("turn").cast("long").alias("turn"), F.coalesce("message", F.lit("")).alias("message"), own.alias("own"), F.coalesce(tokens, F.lit(0)).alias("tokens"))
    text = F.coalesce("own", "message")
    cjk = T.cjk_characters(text)
    step = F.struct(
        "turn", (F.col("message") == "").alias("empty"), T.is_forced(F.col("message")).alias("forced"),
        T.is_confirmatory(F.col("message"), config.confirm_chars).alias("confirm"), water_pressure(F.col("tokens"), config).alias("pressure"),
        T.topic_features(text).alias("feats"), F.try_element_at(cjk, F.lit(1)).alias("first"), F.try_element_at(cjk, F.lit(-1)).alias("last"),
        F.col("own").isNotNull().alias("known"),
    )
    steps = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    def fold(a: Column, x: Column) -> Column:
        none = F.lit(None).cast("int")
        nothing = F.expr("cast(array() as array<string>)")
        new = lambda feats, last, topic, nxt: F.struct(topic.alias("cur"), nxt.alias("next"), F.lit(True).alias("any"), feats.alias("feats"), last.alias("last"), put(topic).alias("out"))
        put = lambda topic: F.concat(a["out"], F.array(F.struct(x["turn"].alias("turn"), topic.alias("topic"), F.coalesce(a["cur"].isNotNull() & (topic != a["cur"]), F.lit(False)).alias("switch"))))
        own = F.when(x["known"], x["feats"]).otherwise(nothing)
        own_last = F.when(x["known"], x["last"])
        stays = a["cur"].isNotNull() & (T.jaccard(x["feats"], a["feats"]) - x["pressure"] >= config.jaccard_entry)
        joint = F.when(a["last"].isNotNull() & x["first"].isNotNull(), F.array(F.concat(a["last"], x["first"]))).otherwise(nothing)
        grown = F.array_union(F.array_union(a["feats"], x["feats"]), joint)
        return (
            F.when((x["turn"] <= 0) | x["empty"], F.struct(none.alias("cur"), a["next"].alias("next"), a["any"].alias("any"), a["feats"].alias("feats"), a["last"].alias("last"), put(none).alias("out")).cast(_STATE))
            .when(x["forced"], new(own, own_last, a["next"], a["next"] + 1).cast(_STATE))
            .when(a["cur"].isNotNull() & x["confirm"], new(a["feats"], a["last"], a["cur"], a["next"]).cast(_STATE))
            .when(~a["any"], new(own, own_last, F.lit(1), F.greatest(a["next"], F.lit(2))).cast(_STATE))
            .when(stays, new(grown, F.coalesce(x["last"], a["last"]), a["cur"], a["next"]).cast(_STATE))
            .otherwise(new(x["feats"], x["last"], a["next"], a["next"] + 1).cast(_STATE))
        )

    start = F.struct(
        F.lit(None).cast("int").alias("cur"), F.lit(1).alias("next"), F.lit(False).alias("any"), F.expr("cast(array() as array<string>)").alias("feats"),
        F.lit(None).cast("string").alias("last"), F.expr("cast(array() as array<struct<turn:bigint,topic:int,switch:boolean>>)").alias("out"),
    ).cast(_STATE)
    done = steps.select("session_id", F.explode(F.aggregate("steps", start, fold)["out"]).alias("o"))
    return done.select("session_id", F.col("o.turn").alias("turn"), F.col("o.topic").alias("topic_id"), F.col("o.switch").alias("is_switch"))


def switches(segments: DataFrame) -> DataFrame:
    """A row for each switch: the closed topic, its turns, and the turn that closed it."""
    closed = segments.where("topic_id is not null").groupBy("session_id", "topic_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    order = Window.partitionBy("session_id").orderBy("turn")
    at = segments.withColumn("closed", F.lag("topic_id").over(order)).where("is_switch").select("session_id", F.col("turn").alias("switch_turn"), F.col("closed").alias("topic_id"), F.col("topic_id").alias("opened"))
    return at.join(closed, ["session_id", "topic_id"])


def open_blocks(segments: DataFrame) -> DataFrame:
    """What a reset submits: the last topic of every session with its turns."""
    order = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    last = segments.withColumn("k", F.row_number().over(order)).where("k = 1 and topic_id is not null").select("session_id", "topic_id")
    turns = segments.groupBy("session_id", "topic_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return turns.join(last, ["session_id", "topic_id"])


def topic_geometry(members: DataFrame, keys: list[str], topic: str, vec: str, config: Config = Config(), symmetric: bool = False) -> DataFrame:
    """Centroid, radius within, and distance to the nearest centroid: one row per topic.

    Only topics before a topic count as its neighbours, as they are filled in order; ``symmetric``
    takes all. A topic without a centroid keeps the default radius and the distance 0.
    """
    cents = V.centroids(members, [*keys, topic], vec)
    far = members.where(F.col(vec).isNotNull()).join(cents, [*keys, topic])
    far = far.groupBy(*keys, topic).agg(F.max(1 - V.cosine(F.col(vec), F.col("centroid"))).alias("m"))
    other = cents.select(*keys, F.col(topic).alias("o_topic"), F.col("centroid").alias("o_centroid")).where("o_centroid is not null")
    apart = F.col("o_topic") != F.col(topic) if symmetric else F.col("o_topic") < F.col(topic)
    on = [cents[k] == other[k] for k in keys]
    near = cents.where("centroid is not null").join(other, [*on, apart] if keys else apart)
    near = near.groupBy(*[cents[k] for k in keys], topic).agg(F.min(1 - V.cosine(F.col("centroid"), F.col("o_centroid"))).alias("nearest"))
    out = cents.join(far, [*keys, topic], "left").join(near, [*keys, topic], "left")
    radius = F.when(F.col("m") > 0, F.col("m")).otherwise(config.default_radius)
    return out.select(*keys, topic, "centroid", "n", radius.alias("max_intra"), F.coalesce("nearest", F.lit(0.0)).alias("nearest"))


def radius_grade(query: Column, centroid: Column, max_intra: Column, nearest: Column, background: Column, config: Config = Config()) -> Column:
    """Act within half the radius, Rel within it, else Far. The radius is the topic's own, at most
    half the way to the nearest topic. No query or no centroid gives Rel."""
    half = nearest / config.radius_weight
    r = F.when(nearest > 0, F.when(max_intra > 0, F.least(max_intra, half)).otherwise(half)).otherwise(max_intra)
    r = F.when(r <= 0, config.default_radius).otherwise(r)
    d = 1 - V.cosine(query, centroid)
    return F.when(background, config.background_grade).when(query.isNull() | centroid.isNull(), "Rel").when(d <= r / 2, "Act").when(d <= r, "Rel").otherwise("Far")


def frozen_grades(segments: DataFrame, switch_grades: DataFrame) -> DataFrame:
    """The grade of every turn as of the last switch: ``session_id, turn, grade``.

    ``switch_grades`` has ``session_id, switch_turn, topic_id, grade``. The topic that a switch opens is
    Act. Turns without a topic, and topics that the switch didn't grade, are Act.
    """
    last = switch_grades.groupBy("session_id").agg(F.max("switch_turn").alias("switch_turn"))
    opened = segments.join(last, ["session_id"]).where(F.col("turn") == F.col("switch_turn")).select("session_id", F.col("topic_id").alias("opened"))
    now = switch_grades.join(last, ["session_id", "switch_turn"], "left_semi").select("session_id", "topic_id", "grade")
    out = segments.join(now, ["session_id", "topic_id"], "left").join(opened, "session_id", "left")
    grade = F.when((F.col("turn") <= 0) | F.col("topic_id").isNull() | (F.col("topic_id") == F.col("opened")), "Act")
    return out.select("session_id", "turn", F.coalesce(grade, "grade", F.lit("Act")).alias("grade"))


def recall_triggers(segments: DataFrame, switch_grades: DataFrame) -> DataFrame:
    """Switches whose closed topic was graded Far: only these ask for recall."""
    found = switches(segments).select("session_id", "switch_turn", "topic_id")
    return found.join(switch_grades, ["session_id", "switch_turn", "topic_id"]).where(F.col("grade") == "Far").select("session_id", "switch_turn", "topic_id")
