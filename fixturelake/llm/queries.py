"""Queries of the text and record problems over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.llm.canonical import CategoryMapper, VenueMapper, map_values
from fixturelake.llm.charforms import hidden_forms
from fixturelake.llm.folded_copies import group_copies
from fixturelake.llm.packing import pack
from fixturelake.llm.persons import resolve_cells, same_accounts
from fixturelake.llm.residue import residue
from fixturelake.llm.survivor import survivors
from fixturelake.llm.transducer import encode_texts
from fixturelake.session import read_table, shared_dir


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    m = hidden_forms(read_table(spark, d, "matches"), "match_name", "rec_id", "match_name")
    return m.unionByName(hidden_forms(read_table(spark, d, "assignments"), "name_in_sheet", "id", "name_in_sheet"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_forms(spark, d).select("field", "row_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    shared_dir(spark)
    m, a, accounts = (read_table(spark, d, t) for t in ("matches", "assignments", "profiles"))
    cells = None
    for c in ("referees", "table_officials"):
        part = m.select(F.lit(c).alias("field"), F.col("rec_id").alias("row_id"), F.posexplode(c).alias("pos", "cell"))
        cells = part if cells is None else cells.unionByName(part)
    cells = cells.unionByName(a.where("user_id IS NULL").select(F.lit("name_in_sheet").alias("field"), F.col("id").alias("row_id"), F.lit(0).alias("pos"), F.col("name_in_sheet").alias("cell")))
    owners = same_accounts(accounts)
    twins = owners.where("user_id <> owner").select(F.lit("last_name").alias("field"), F.col("user_id").alias("row_id"), F.lit(0).alias("pos"), F.col("owner").alias("user_id"))
    return resolve_cells(cells, accounts, owners).unionByName(twins)


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors(read_table(spark, d, "match_rows"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_survivors(spark, d).select("group_id", "survivor_id")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "matches")
    return group_copies(m, "rec_id", ["match_name", "venue", "time_text"], ("src_row", "seen_at"), ("time_text",))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_records(spark, d).where("rec_id <> keep_id").select("keep_id", F.col("rec_id").alias("copy_id"))


def p7_mapped(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "matches")
    venues = read_table(spark, d, "venues").select("venue_id", "venue_name", "district")
    kinds = read_table(spark, d, "categories").select("category_id", "category_name", F.lit(None).cast("string"))
    return map_values(m, "venue", "rec_id", "venue", venues, VenueMapper).unionByName(map_values(m, "category", "rec_id", "category", kinds, CategoryMapper))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_mapped(spark, d).where("NOT exact").select("field", "rec_id", "ref_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(read_table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = encode_texts(read_table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.size("ids").alias("n"))
    capacities = [(r[0], r[1]) for r in read_table(spark, d, "capacities").orderBy("capacity_id").collect()]
    return pack(sizes, "doc_id", "n", capacities)


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue(read_table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_residue(spark, d).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (p1_found, p1_forms, p2_found, p3_found, p3_survivors, p6_found, p6_records, p7_found, p7_mapped, p8_ids, p9_containers, p10_found, p10_residue)
    return {f.__name__: f for f in made}


_FOLD = "lower(replace(replace(replace({0}, 'İ', 'i'), 'I', 'i'), 'ı', 'i'))"


def _words(c: str) -> str:
    low = f"regexp_replace({_FOLD.format(c)}, '[.''’`´\\p{{Cf}}\\p{{Mn}}]', '', 'g')"
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({low}, '[\\p{{P}}\\p{{S}}\\s\\p{{Z}}]+'), lambda w: w <> '')), ' ')"


def _clock(c: str) -> str:
    low = _FOLD.format(c)
    letters = f"array_to_string(list_sort(list_filter(regexp_split_to_array(replace({low}, '.', ''), '[^\\p{{L}}]+'), lambda w: w <> '')), ' ')"
    return f"regexp_replace({low}, '[^0-9]', '', 'g') || ' ' || {letters}"


def oracle_sql() -> dict[str, str]:
    key = f"""{_words('match_name')}, date_text, {_clock('time_text')}, {_words('venue')}, category, sub_category, group_name, week, season, league_type,
        referees, table_officials, medics, statisticians, observers, commissioners, src_file, src_sheet"""
    records = f"SELECT rec_id, min(rec_id) OVER (PARTITION BY {key}) AS keep_id, count(*) OVER (PARTITION BY {key}) AS n_copies FROM matches"
    standin = """('GRUP BİRİNCİSİ - GRUP İKİNCİSİ', 'Kura sonrası', 'elemelerden gelecek takım - elemelerden gelecek takım', '? - ?', 'Takımlar belli olunca yazılacak',
        'A1 - B2', 'Yarı final 1. maç', 'TBD - TBD', 'GALİP 1 - GALİP 2', 'DAHA SONRA BELİRLENECEK', 'Eşleşme bekleniyor')"""
    return {
        "p6_records": records,
        "p6_found": f"SELECT keep_id, rec_id AS copy_id FROM ({records}) WHERE rec_id <> keep_id",
        "p3_found": f"""
WITH a AS (SELECT *, list_filter(referees || table_officials || medics || statisticians || observers || commissioners, lambda x: regexp_matches(x, '\\p{{L}}')) AS names
           FROM match_rows WHERE cancelled_at IS NULL),
keyed AS (SELECT min(id) AS group_id, arg_max(id, (len(names), created_at, -id)) AS survivor_id FROM a WHERE content_key IS NOT NULL GROUP BY content_key HAVING count(*) > 1),
met AS (SELECT s.id AS sid, k.id AS kid FROM a s JOIN a k ON s.date_text IS NOT DISTINCT FROM k.date_text AND s.time_text IS NOT DISTINCT FROM k.time_text
        AND s.venue IS NOT DISTINCT FROM k.venue WHERE s.match_name IN {standin} AND k.match_name NOT IN {standin}
        AND len(s.names) >= 3 AND len(list_filter(s.names, lambda x: NOT list_contains(k.names, x))) = 0)
SELECT * FROM keyed UNION ALL SELECT least(min(sid), kid) AS group_id, kid AS survivor_id FROM met GROUP BY kid""",
    }
