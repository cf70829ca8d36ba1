"""Differences between two states of a fixture and the plan of what to tell whom."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixturelake.functions.days import format_day, format_time
from fixturelake.functions.text import collapse, has_letter, lower_tr, trim

# Crews in the order in which they are told, their seats, and the name used while seats are open.
GROUPS = [
    ("referees", ["Baş Hakem", "Yardımcı Hakem"], "Hakem"),
    ("table_officials", ["Sayı Görevlisi", "Saat Görevlisi", "Şut Saati Görevlisi"], "Masa Görevlisi"),
    ("statisticians", ["İstatistikçi 1", "İstatistikçi 2"], "İstatistikçi"),
    ("observers", [], "Gözlemci"), ("medics", [], "Sağlıkçı"), ("commissioners", [], "Saha Komiseri"),
]
_NONE = "array<string>"


def same_text(c: Column) -> Column:
    return lower_tr(collapse(F.coalesce(c, F.lit(""))))


def names_of(m: Column, crew: str) -> Column:
    """Trimmed entries of a crew that are names."""
    return F.filter(F.transform(F.coalesce(m[crew], F.array().cast(_NONE)), trim), has_letter)


def seat(group: tuple, index: Column, total: Column) -> Column:
    """The seat's name once all seats are taken, else the crew's."""
    _, seats, other = group
    if not seats:
        return F.lit(other)
    return F.when(total >= len(seats), F.coalesce(F.get(F.array(*map(F.lit, seats)), index), F.lit(other))).otherwise(other)


def _crew_lines(g: tuple, a: Column, b: Column) -> list[Column]:
    ka, kb = F.transform(a, same_text), F.transform(b, same_text)
    went = F.filter(a, lambda n: ~F.array_contains(kb, same_text(n)))
    came = F.filter(F.transform(b, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda s: ~F.array_contains(ka, same_text(s["n"])))
    k = F.least(F.size(went), F.size(came))
    pairs = F.zip_with(F.slice(went, F.lit(1), k), F.slice(came, F.lit(1), k), lambda w, c: F.struct(w.alias("w"), c.alias("c")))
    lines = [F.transform(pairs, lambda p: F.concat(F.lit("🔁 "), seat(g, p["c"]["i"], F.size(b)), F.lit(": "), p["w"], F.lit(" yerine "), p["c"]["n"], F.lit(" geldi")))]
    if g[0] == "referees":
        full = (F.size(a) >= len(g[1])) & (F.size(b) >= len(g[1]))
        moved = lambda n, i: F.array_contains(ka, same_text(n)) & (F.array_position(ka, same_text(n)) - 1 != i) & (i < len(g[1]))
        swaps = F.transform(b, lambda n, i: F.when(moved(n, i), F.concat(F.lit("🔁 "), seat(g, i, F.size(b)), F.lit(" artık "), n)))
        lines.append(F.when(full, swaps).otherwise(F.array().cast(_NONE)))
    return lines


def change_lines(old: Column, new: Column) -> Column:
    """What to tell about a fixture that changed: day, time, venue, replaced people, changed referee seats.

    Values that were blank and got filled are no change; people who only came or only went aren't told; the k-th
    who went is paired with the k-th who came. Null on either side gives no lines.
    """
    day = F.when((trim(F.coalesce(old["date_text"], F.lit(""))) != "") & (same_text(old["date_text"]) != same_text(new["date_text"])),
                 F.concat(F.lit("📅 Tarih: "), format_day(old["date_text"]), F.lit(" → "), format_day(new["date_text"])))
    t0, t1 = format_time(old["time_text"]), format_time(new["time_text"])
    time = F.when((t0 != "") & (t1 != "") & (t0 != t1), F.concat(F.lit("⏰ Saat: "), t0, F.lit(" → "), t1))
    v0, v1 = (trim(F.coalesce(m["venue"], F.lit(""))) for m in (old, new))
    venue = F.when((v0 != "") & (v1 != "") & (same_text(v0) != same_text(v1)), F.concat(F.lit("🏟️ Salon: "), v0, F.lit(" → "), v1))
    parts = [F.array(day, time, venue)]
    for g in GROUPS:
        parts += _crew_lines(g, names_of(old, g[0]), names_of(new, g[0]))
    lines = F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull())
    return F.when(old.isNull() | new.isNull(), F.array().cast(_NONE)).otherwise(lines)


def when_text(m: Column) -> Column:
    t = format_time(m["time_text"])
    return F.concat(F.lit("📅 "), format_day(m["date_text"]), F.when(t != "", F.concat(F.lit(" · ⏰ "), t)).otherwise(F.lit("")))


def detail_lines(m: Column, crews: bool = True) -> Column:
    """All of a fixture, line by line."""
    kinds = F.filter(F.array(*(trim(F.coalesce(m[c], F.lit(""))) for c in ("league_type", "category", "sub_category"))), lambda x: x != "")
    category = F.when(F.size(kinds) > 0, F.concat(F.lit("🏷️ "), F.array_join(kinds, " · ")))
    venue = trim(F.coalesce(m["venue"], F.lit("")))
    head = F.array(F.concat(F.lit("🏀 "), trim(m["match_name"])), category, when_text(m), F.when(venue != "", F.concat(F.lit("🏟️ "), venue)))
    if crews:
        told = lambda g, names: F.transform(names, lambda n, i: F.concat(F.lit("• "), seat(g, i, F.size(names)), F.lit(": "), n))
        people = F.flatten(F.array(*(told(g, names_of(m, g[0])) for g in GROUPS)))
        head = F.concat(head, F.when(F.size(people) > 0, F.concat(F.array(F.lit(""), F.lit("👥 Görevliler")), people)).otherwise(F.array().cast(_NONE)))
    return F.filter(head, lambda x: x.isNotNull())


def message(kind: Column, m: Column, old: Column, lines: Column) -> Column:
    """struct(title, body) of a notice of one of four kinds."""
    join = lambda *parts: F.array_join(F.concat(*parts), "\n")
    one = lambda *texts: F.array(*(F.concat(*t) if isinstance(t, tuple) else t for t in texts))
    blank = F.lit("")
    t = format_time(m["time_text"])
    short = F.concat(F.lit("📅 "), format_day(m["date_text"]), F.when(t != "", F.concat(F.lit(" ⏰ "), t)).otherwise(blank))
    before = F.coalesce(old, m)
    body = (
        F.when(kind == "ASSIGNED", join(one((when_text(m), F.lit(" — Detaylar için dokunun 👉")), blank), detail_lines(m)))
        .when(kind == "CANCELLED", join(one((when_text(m), F.lit(" maçındaki göreviniz kaldırıldı.")), blank), detail_lines(m, False)))
        .when(kind == "UPDATED", join(F.coalesce(lines, F.array().cast(_NONE)), one(blank), detail_lines(m)))
        .otherwise(join(one((F.lit("Eski maçınız kaldırıldı, yeni maçınız: "), short, F.lit(" 🏀")), blank), detail_lines(m), one(blank, (F.lit("❌ Eski maç: "), trim(before["match_name"]), F.lit(" · "), when_text(before)))))
    )
    title = F.when(kind == "ASSIGNED", "🔔 Maç Atamanız Geldi!").when(kind == "CANCELLED", "❌ Maç Atamanız İptal Edildi").when(kind == "UPDATED", "📝 Maçınız Güncellendi").otherwise("🔄 Atamanızda Değişiklik Var")
    return F.struct(title.alias("title"), body.alias("body"))


def push_message(title: Column, body: Column, kind: Column) -> Column:
    """The message as JSON; the data part carries title and body too."""
    data = F.struct(kind.alias("type"), title.alias("title"), body.alias("body"), F.lit("matches").alias("channel"))
    return F.to_json(F.struct(F.struct(title.alias("title"), body.alias("body")).alias("notification"), data.alias("data"), F.struct(F.lit("high").alias("priority")).alias("android")))


def pair_events(events: DataFrame) -> DataFrame:
    """(user_id, kind, event_id, other_id, other_queued): each user's cancellations paired with new assignments, greedily, one to one.

    events: (user_id, side 'cancel' | 'assign', event_id, content_key, fixture, day, queued boolean). In event
    order, waiting cancellations last, a cancellation takes the first assignment of its content key or fixture
    (UPDATED), else the first of its day (CHANGED), else stands alone (CANCELLED, unless it is queued already);
    assignments left over are ASSIGNED. Consuming rows in order has no relational form: partitions sorted by user
    stream past, and of one user at a time only the assignments still free are held, as ids under their keys.
    """
    sides = ["user_id", "side", ((F.col("side") == "cancel") & F.coalesce("queued", F.lit(False))).alias("queued"), "event_id", "content_key", "fixture", "day"]
    ordered = events.where("user_id IS NOT NULL").select(*sides).repartition("user_id").sortWithinPartitions("user_id", "side", "queued", "event_id")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, free, by, out = None, {}, {}, []

        def first(key: tuple) -> int | None:
            line = by.get(key)
            while line and line[0] not in free:
                line.popleft()
            return line[0] if line else None

        def rows() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["user_id", "kind", "event_id", "other_id", "other_queued"]).astype({"other_id": "Int64"})
            out.clear()
            return made

        for pdf in batches:
            clean = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in ("user_id", "side", "queued", "event_id", "content_key", "fixture", "day")]
            for u, side, queued, event, content, fixture, day in zip(*clean):
                if u != user:
                    out += [(user, "ASSIGNED", e, None, False) for e in free]
                    user, free, by = u, {}, {}
                keys = [(k, v) for k, v in (("k", content), ("f", fixture), ("d", day)) if v is not None]
                if side == "assign":
                    free[event] = True
                    for k in keys:
                        by.setdefault(k, deque()).append(event)
                    continue
                near = min((e for k in keys if k[0] != "d" and (e := first(k)) is not None), default=None)
                taken = near if near is not None else next((e for k in keys if k[0] == "d" and (e := first(k)) is not None), None)
                if taken is not None:
                    del free[taken]
                    out.append((u, "UPDATED" if near is not None else "CHANGED", taken, event, queued))
                elif not queued:
                    out.append((u, "CANCELLED", event, None, False))
            yield rows()
        out += [(user, "ASSIGNED", e, None, False) for e in free]
        yield rows()

    return ordered.mapInPandas(pair, "user_id long, kind string, event_id long, other_id long, other_queued boolean")


def first_of_each(planned: DataFrame, order: str = "event_id") -> DataFrame:
    """One notice per (kind, user, content key, or name and day without one): the first in event order."""
    key = F.coalesce("content_key", F.concat_ws("|", "match_name", "date_text"))
    best = planned.withColumn("_k", key).groupBy("kind", "user_id", "_k").agg(F.min_by(F.struct(*planned.columns), order).alias("p"))
    return best.select("p.*")
