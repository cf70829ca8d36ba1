"""Name cells resolved to profiles: exact rule first, similarity for the rest; assignments built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.functions import text as X
from fixturelake.functions.keys import CREWS, ROLES, crew
from fixturelake.functions.namerule import cell_match


def active_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Profiles of active and approved users (semi join)."""
    ok = users.where("is_active AND is_approved").select(F.col("id").alias("user_id"))
    return profiles.join(ok, "user_id", "left_semi")


def crew_cells(rows: DataFrame, key: str) -> DataFrame:
    """(key, crew, pos, cell): one row a crew entry; role order is the order of crews."""
    entry = lambda k: lambda x, i: F.struct(F.lit(k).alias("crew"), i.alias("pos"), x.alias("cell"))
    parts = [F.transform(crew(c), entry(k)) for k, c in enumerate(CREWS)]
    return rows.select(key, F.explode(F.flatten(F.array(*parts))).alias("e")).select(key, "e.crew", "e.pos", "e.cell")


def _delete_one(w: Column) -> Column:
    """The word itself and the word with one letter left out: two words one edit apart share one of these."""
    n = F.length(w)
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
    return F.array_union(F.array(w), F.when(n >= 3, shorter).otherwise(F.array(w)))


def candidate_pairs(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """(cell, user_id, first_name, last_name) that can match by the name rule, found by equal keys only.

    Every match spends a word of the cell on the profile's first surname, equal or one edit away, so both sides
    meet on the word with at most one letter left out. Nothing is compared all with all.
    """
    named = profiles.where("first_name <> '' AND last_name <> ''").select("user_id", "first_name", "last_name").distinct()
    surname = F.split(X.normalize_tr(F.col("last_name")), " ")[0]
    by_profile = named.withColumn("_k", F.explode(_delete_one(surname)))
    by_cell = cells.where(F.length("cell") >= 3).select("cell").distinct().withColumn("_w", F.explode(X.words(F.col("cell")))).withColumn("_k", F.explode(_delete_one(F.col("_w"))))
    return by_cell.select("cell", "_k").join(by_profile, "_k").drop("_k").distinct()


def matched_pairs(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidates that match, with kind, covered words and whether a misspelling was forgiven; best form per user."""
    got = candidate_pairs(cells, profiles).withColumn("m", cell_match("cell", "first_name", "last_name")).where("m.kind IS NOT NULL")
    rank = F.when(F.col("m.kind") == "short", -1).when(F.col("m.kind") == "partial", 0).when(F.col("m.typo"), 1).otherwise(2)
    best = F.max_by("m", F.struct(rank, F.col("first_name"), F.col("last_name")))
    return got.groupBy("cell", "user_id").agg(best.alias("m")).select("cell", "user_id", "m.kind", "m.covered", "m.typo")


def resolve_cells(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """(cell, user_id, ambiguous): to whom each distinct cell belongs.

    One exact owner takes the cell; of several, those without a misspelling; all misspelt, nobody. Without an
    exact one, partial owners whose words clash with another's are ambiguous, the others stand side by side.
    Only a single short owner is believed.
    """
    pairs = matched_pairs(cells, profiles)
    w = W.partitionBy("cell")
    exact, clean = F.col("kind") == "exact", (F.col("kind") == "exact") & ~F.col("typo")
    counted = pairs.withColumns({
        "_e": F.count(F.when(exact, 1)).over(w), "_c": F.count(F.when(clean, 1)).over(w),
        "_p": F.count(F.when(F.col("kind") == "partial", 1)).over(w), "_n": F.count(F.lit(1)).over(w),
    })
    # a word covered twice among partial owners makes both ambiguous
    spent = counted.where("_e = 0 AND kind = 'partial'").select("cell", "user_id", F.explode("covered").alias("i"))
    clash = spent.withColumn("_t", F.count(F.lit(1)).over(W.partitionBy("cell", "i"))).where("_t > 1").select("cell", "user_id", F.lit(True).alias("_clash")).distinct()
    joined = counted.join(clash, ["cell", "user_id"], "left")
    owned = (
        F.when(F.col("_e") == 1, exact)
        .when(F.col("_e") > 1, clean)
        .when(F.col("_p") > 0, (F.col("kind") == "partial") & F.col("_clash").isNull())
        .otherwise(F.col("_n") == 1)
    )
    side = F.when(F.col("_e") == 1, exact).when(F.col("_e") > 1, exact).when(F.col("_p") > 0, F.col("kind") == "partial").otherwise(True)
    return joined.where(side).select("cell", "user_id", (~owned).alias("ambiguous"))


def similar_pairs(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """(cell, user_id, similarity >= 0.90): best form per user, blocked without loss.

    At 0.90 the edit distance d obeys d <= longest / 10. Cut into d + 1 pieces, the shorter name keeps one piece
    unchanged in the other, moved by at most d, so both sides meet on (piece, its place).
    """
    a = cells.select("cell", X.squash(F.col("cell")).alias("a")).distinct().where("a <> ''")
    b = profiles.where("first_name <> '' AND last_name <> ''").select("user_id", X.squash(F.concat_ws(" ", "first_name", "last_name")).alias("b")).distinct().where("b <> ''")
    # pieces of the profile name for every number of edits it allows; cells offer every piece at shifted places
    most = F.floor(F.length("b") / 9).cast("int")  # the longer name has at most 10/9 of its letters
    size = F.floor(F.length("b") / (most + 1)).cast("int")
    left = b.withColumns({"most": most, "size": size})
    left = left.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("most")))).select(
        "user_id", "b", "most", "size", (F.col("p") * F.col("size")).alias("at"), F.substring(F.col("b"), F.col("p") * F.col("size") + 1, F.col("size")).alias("piece")
    )
    left = left.withColumn("place", F.explode(F.sequence(F.greatest(F.col("at") - F.col("most"), F.lit(0)), F.col("at") + F.col("most")))).drop("at")
    sizes = left.select("size").distinct()
    right = a.crossJoin(F.broadcast(sizes)).where("length(a) >= size").withColumn("place", F.explode(F.sequence(F.lit(0), F.length("a") - F.col("size"))))
    right = right.withColumn("piece", F.substring(F.col("a"), F.col("place") + 1, F.col("size")))
    met = right.join(left, ["size", "place", "piece"]).select("cell", "a", "user_id", "b").distinct()
    scored = met.withColumn("similarity", X.similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= X.SIMILAR)
    return scored.groupBy("cell", "user_id").agg(F.max("similarity").alias("similarity"))


def resolve_similar(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """(cell, user_id, similarity): the most similar user, when no other comes within the least lead."""
    w = W.partitionBy("cell").orderBy(F.desc("similarity"), "user_id")
    ranked = similar_pairs(cells, profiles).withColumns({"_r": F.row_number().over(w), "_next": F.lead("similarity").over(w)})
    clear = F.col("_next").isNull() | (F.col("similarity") - F.col("_next") >= X.LEAD)
    return ranked.where((F.col("_r") == 1) & clear).select("cell", "user_id", "similarity")


def last_events(events: DataFrame) -> DataFrame:
    """(user_id, content_key, last_at): when each user was last assigned to each identity; null identities belong to none."""
    return events.where("content_key IS NOT NULL").groupBy("user_id", "content_key").agg(F.max("created_at").alias("last_at"))


def not_cancelled_since(last: DataFrame, sent: DataFrame) -> DataFrame:
    """Of last_events those after which no cancellation (user_id, content_key, sent_at) was sent."""
    latest = sent.groupBy("user_id", "content_key").agg(F.max("sent_at").alias("_sent"))
    return last.join(latest, ["user_id", "content_key"], "left").where("_sent IS NULL OR _sent <= last_at OR last_at IS NULL").drop("_sent")


def with_new_flag(assigned: DataFrame, last: DataFrame) -> DataFrame:
    """assigned (user_id, content_key, ...) with is_new: whether the user wasn't on the identity before."""
    return assigned.join(last.select("user_id", "content_key", F.lit(True).alias("_had")), ["user_id", "content_key"], "left").withColumn("is_new", F.col("_had").isNull()).drop("_had")


def build_assignments(rows: DataFrame, profiles: DataFrame, existing: DataFrame, sent_cancels: DataFrame | None = None) -> DataFrame:
    """(user_id, match_id, role, name_in_sheet, is_new): assignments of a delivery.

    rows: fixtures with id and content_key. Distinct cells are resolved once and joined back; a user on a row
    twice gets the first role in fixed order. is_new is false for a (user, content key) assigned before, unless
    a cancellation was sent after the last assignment. existing: (user_id, content_key, created_at);
    sent_cancels: (user_id, content_key, sent_at).
    """
    cells = crew_cells(rows, "id").where(F.length("cell") >= 1)
    exact = resolve_cells(cells, profiles)
    open_cells = cells.join(exact.select("cell").distinct(), "cell", "left_anti")
    owners = exact.where("NOT ambiguous").select("cell", "user_id").unionByName(resolve_similar(open_cells, profiles).select("cell", "user_id"))
    placed = cells.join(owners, "cell").groupBy("id", "user_id").agg(F.min_by(F.struct("crew", "cell"), F.struct("crew", "pos")).alias("f"))
    named = placed.select(F.col("id").alias("match_id"), "user_id", F.element_at(F.array(*map(F.lit, ROLES)), F.col("f.crew") + 1).alias("role"), F.col("f.cell").alias("name_in_sheet"))
    last = last_events(existing)
    if sent_cancels is not None:
        last = not_cancelled_since(last, sent_cancels)
    keyed = named.join(rows.select(F.col("id").alias("match_id"), "content_key"), "match_id")
    return with_new_flag(keyed, last).select("user_id", "match_id", "role", "name_in_sheet", "is_new")
