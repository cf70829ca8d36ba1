"""One surviving record per group of duplicates: a latent two-sided quality model of the sources."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixturelake.operators.skew import attach
from fixturelake.session import broadcast_checked, durable

CREWS = ["referees", "table_officials", "medics", "statisticians", "observers", "commissioners"]
SCALARS = ["match_name", "date_text", "time_text", "venue", "category", "sub_category", "group_name", "week", "season", "league_type"]
#: Expectation and maximisation end when no source moves by more than this, or after so many rounds; a value is judged true from this probability on.
MOVED, ROUNDS, TRUE_FROM = 0.01, 8, 0.5
#: Starting sensitivity, specificity and share of true values, and the weight with which they hold a source with few values.
SENSITIVITY, SPECIFICITY, PRIOR, HOLD = 0.8, 0.7, 0.7, 10.0
#: Names a stand-in row must have to be recognised by its crew.
STANDIN_NAMES = 3

# Wording of names that stand in for teams not known yet, on text folded to plain letters.
STANDIN = (
    r"^(?:[^\p{L}\p{N}]*|[a-h][ .]?\d{1,2}|tb[adc]|.*\b(?:elemeler\p{L}*|galip|galib\p{L}*|maglup|maglub\p{L}*|kazanan|kaybeden|birincisi|ikincisi|ucuncusu|dorduncusu|"
    r"belirlen\p{L}*|belli (?:ol|degil)\p{L}*|netles\p{L}*|kura|eslesme\p{L}*|bekleniyor|bekleyen|aciklan\p{L}*|final|playoff|gelecek takim\p{L}*|winner|loser)\b.*)$"
)


def is_name(x: Column) -> Column:
    return x.rlike(r"\p{L}")


def names_of(columns: list[str]) -> Column:
    """All crew entries that are names, in field order; null fields count as empty."""
    return F.filter(F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns))), lambda x: x.isNotNull() & is_name(x))


def stands_in(name: Column) -> Column:
    """Whether every side of a match name stands in for a team not known yet."""
    low = F.lower(F.translate(name, "İIıÇçĞğÖöŞşÜü", "iiiccggoossuu"))
    sides = F.transform(F.split(low, r"\s+[-–—‑:/_|]\s+"), lambda s: F.trim(s))
    return F.coalesce(name.isNotNull() & F.forall(sides, lambda s: s.rlike(STANDIN)), F.lit(False))


def groups_of(active: DataFrame) -> DataFrame:
    """(g, id, known): rows with the same content key, and stand-in rows with the known row whose crew holds theirs.

    A stand-in row meets known rows of its slot through one of its names only (its first in order), so no slot
    is ever paired all with all; the whole crew is compared afterwards. A slot with null in date, time or venue
    is a slot of its own, null equal to null.
    """
    slot = [F.coalesce(F.col(c), F.lit("\0")).alias(f"_{c}") for c in ("date_text", "time_text", "venue")]
    at = ["_date_text", "_time_text", "_venue", "_name"]
    keyed = active.where("content_key IS NOT NULL").select(F.concat(F.lit("k"), "content_key").alias("g"), "id", F.lit(True).alias("known"))
    open_rows = active.where("_standin").where(F.size("_names") >= STANDIN_NAMES)
    known = active.where("NOT _standin").select(F.col("id").alias("known_id"), F.col("_names").alias("_all"), *slot, F.explode(F.array_distinct("_names")).alias("_name"))
    met = open_rows.select("id", "_names", *slot, F.array_min("_names").alias("_name")).join(known, at)
    held = met.where(F.forall("_names", lambda x: F.array_contains("_all", x)))
    best = held.groupBy("id").agg(F.max_by("known_id", F.struct(-F.size("_all"), -F.col("known_id"))).alias("known_id"))
    g = F.concat(F.lit("s"), F.col("known_id").cast("string")).alias("g")
    standin = best.select(g, "id", F.lit(False).alias("known")).unionByName(best.select("known_id").distinct().select(g, F.col("known_id").alias("id"), F.lit(True).alias("known")))
    return keyed.unionByName(standin)


def judged_values(members: DataFrame, claims: DataFrame, rounds: int = ROUNDS, value: tuple[str, ...] = ("field", "value")) -> DataFrame:
    """(g, *value, p): probability that each value claimed in a group is true.

    members: (g, source), a row each; claims: (g, source, *value), each a value a row lists. A row that
    doesn't list a value speaks against it. Sources' sensitivity and specificity and the share of true values are
    re-estimated from the probabilities until no source moves by more than MOVED. What all rows of a group say by
    silence is one sum per group, and each claim corrects it, so a round costs as much as there are claims, however
    large a group is: rows first shrink to their number by group and source, claims by value too, so no group is left with more rows than sources and values.
    """
    members = durable(members.groupBy("g", "source").agg(F.count(F.lit(1)).alias("_n")))
    claims = durable(claims.groupBy("g", "source", *value).agg(F.count(F.lit(1)).alias("_n")))
    params = members.select("source").distinct().select("source", F.lit(SENSITIVITY).alias("a"), F.lit(SPECIFICITY).alias("b"), F.lit(1.0).alias("_moved"))
    prior, k, values = PRIOR, 0, None
    clip = lambda c: F.greatest(F.least(c, F.lit(0.98)), F.lit(0.02))
    while True:
        sent = broadcast_checked(params.select("source", "a", "b"))
        silence = F.log((1 - F.col("a")) / F.col("b"))
        voice = F.log(F.col("a") / (1 - F.col("b")))
        base = members.join(sent, "source").groupBy("g").agg(F.sum(silence * F.col("_n")).alias("base"))
        lifted = claims.join(sent, "source").groupBy("g", *value).agg(F.sum((voice - silence) * F.col("_n")).alias("lift"))
        odds = F.lit(log(prior / (1 - prior))) + F.col("base") + F.col("lift")
        both = lifted.join(base, "g")
        values = durable(both.select("g", *value, (1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))).alias("p")))
        if k == rounds:
            break
        per_group = values.groupBy("g").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f"))
        said = claims.join(values, ["g", *value]).groupBy("source").agg(F.sum(F.col("p") * F.col("_n")).alias("hit"), F.sum((1 - F.col("p")) * F.col("_n")).alias("false"))
        could = members.join(per_group, "g").groupBy("source").agg(F.sum(F.col("t") * F.col("_n")).alias("t"), F.sum(F.col("f") * F.col("_n")).alias("f"))
        hit, false = F.coalesce("hit", F.lit(0.0)), F.coalesce("false", F.lit(0.0))
        a = clip((hit + HOLD * SENSITIVITY) / (F.col("t") + HOLD))
        b = clip((F.col("f") - false + HOLD * SPECIFICITY) / (F.col("f") + HOLD))
        was = params.select("source", F.col("a").alias("_a"), F.col("b").alias("_b"))
        new = could.join(said, "source", "left").select("source", a.alias("a"), b.alias("b")).join(was, "source")
        params = durable(new.select("source", "a", "b", F.greatest(F.abs(F.col("a") - F.col("_a")), F.abs(F.col("b") - F.col("_b"))).alias("_moved")))
        share = values.agg(F.sum("p").alias("t"), F.count(F.lit(1)).alias("n")).first()
        prior = min(0.98, max(0.02, ((share["t"] or 0.0) + HOLD * PRIOR) / (share["n"] + HOLD)))
        k += 1
        if not params.where(F.col("_moved") > MOVED).limit(1).count():
            k = rounds
    return values


def survivors(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One record per group of two or more active rows of one game.

    Columns: group_id (smallest id), survivor_id, n_rows, the scalar fields, and the six crew arrays. All values are
    judged by one quality model of the sources: a scalar field keeps its most probable value (then the latest, then the one of the smallest id),
    a crew every value judged true. A null field says nothing, an empty crew speaks against every name; a row that
    stands in for unknown teams says nothing of the match name. The row kept is the one of known teams, then with
    most names, then latest, then with the values most likely true, then with the smallest id. Cancelled rows and
    rows in no group are left out; entries without a letter are no names; repeated entries of one crew count once as
    values but each as a name. Scalar fields the table lacks are left out.
    """
    scalars = [c for c in SCALARS if c in rows.columns]
    active = rows.where("cancelled_at IS NULL").select(
        "id", "content_key", "created_at", *scalars, F.coalesce("src_file", F.lit("")).alias("source"), *CREWS,
        names_of(CREWS).alias("_names"), stands_in(F.col("match_name")).alias("_standin"),
    )
    grouped = groups_of(active)
    sized = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("group_id")).where("n_rows > 1")
    members = durable(attach(grouped, sized, ["g"], "n_rows").join(active.drop("content_key", "_standin"), "id").withColumn("g", F.xxhash64("g")))
    # what each row says of each field: null where it says nothing
    text = lambda c: F.when(F.lit(c != "match_name") | F.col("known"), F.col(c).cast("string"))
    single = [F.struct(F.lit(c).alias("field"), F.when(text(c).isNotNull(), F.array(text(c))).alias("vs")) for c in scalars]
    crews = [F.struct(F.lit(c).alias("field"), F.array_distinct(F.filter(F.col(c), lambda x: x.isNotNull() & is_name(x))).alias("vs")) for c in CREWS]
    told = members.select("g", "id", "created_at", F.xxhash64("source").alias("source"), F.explode(F.array(*single, *crews)).alias("l"))
    told = told.where("l.vs IS NOT NULL").select("g", "id", "created_at", "source", "l.field", "l.vs", F.xxhash64("g", "l.field").alias("q"))
    listed = durable(told.select("g", "q", "id", "created_at", "source", "field", F.explode("vs").alias("value")).withColumn("v", F.xxhash64("value")))
    # the rounds run on 64-bit names of a group's fields, of values and of sources; the texts come back at the end
    values = durable(judged_values(told.select(F.col("q").alias("g"), "source"), listed.select(F.col("q").alias("g"), "source", "v"), rounds, ("v",)).withColumnRenamed("g", "q"))
    counted = durable(values.join(listed.groupBy("q", "v").agg(F.count(F.lit(1)).alias("_m")), ["q", "v"]))
    judged = durable(attach(listed, counted, ["q", "v"], "_m"))
    best = judged.groupBy("g", "field").agg(F.max_by("value", F.struct("p", "created_at", (-F.col("id")).alias("i"))).alias("value"))
    true = judged.where(F.col("p") >= TRUE_FROM).groupBy("g").agg(*(F.sort_array(F.collect_set(F.when(F.col("field") == c, F.col("value")))).alias(c) for c in CREWS))
    chosen = best.where(F.col("field").isin(scalars)).groupBy("g").agg(*(F.max(F.when(F.col("field") == c, F.col("value"))).cast(rows.schema[c].dataType).alias(c) for c in scalars))
    trust = judged.where(F.col("field").isin(CREWS)).groupBy("id").agg(F.avg("p").alias("trust"))
    rank = F.struct("known", F.size("_names").alias("n"), "created_at", F.coalesce("trust", F.lit(0.0)).alias("t"), (-F.col("id")).alias("i"))
    kept = members.join(trust, "id", "left").groupBy("g").agg(F.min("id").alias("group_id"), F.max_by("id", rank).alias("survivor_id"), F.count(F.lit(1)).alias("n_rows"))
    empty = F.array().cast("array<string>")
    return kept.join(chosen, "g", "left").join(true, "g", "left").select("group_id", "survivor_id", "n_rows", *scalars, *(F.coalesce(c, empty).alias(c) for c in CREWS))
