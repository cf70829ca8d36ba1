"""The SQL equivalents of the catalogue, written independently of the Spark plans."""

from __future__ import annotations

NOW = "TIMESTAMP '2025-11-01 12:00:00'"
SPACE = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CREWS = ["referees", "table_officials", "medics", "statisticians", "observers", "commissioners"]
ROLES = ["HAKEM", "MASA", "SAGLIK", "ISTATISTIK", "GOZLEMCI", "KOMISER"]
ALL = " || ".join(f"coalesce({c}, [])" for c in CREWS)
COUNT = " + ".join(f"coalesce(len({c}), 0)" for c in CREWS)


def low(x: str) -> str:
    return f"lower(replace({x}, 'İ', 'i̇'))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'), ' ')"


def part(c: str) -> str:
    return low(collapse(f"coalesce({c}, '')"))


def normal(x: str) -> str:
    return collapse(f"replace(lower(translate(coalesce({x}, ''), 'Iİ', 'ıi')), 'i̇', 'i')")


def fold(x: str) -> str:
    return collapse(f"regexp_replace(lower(replace(translate(coalesce({x}, ''), 'İIıĞğÜüŞşÖöÇçÂâ', 'iiigguussooccaa'), 'i̇', 'i')), '[^a-z \\t\\n\\r\\x{{00A0}}]', '', 'g')")


NAMELESS = f"coalesce({low(trim('match_name'))} = '3x3 - 3x3', false)"
RAW = f"concat_ws('|', {part('match_name')}, {part('date_text')}, {part('time_text')}) || CASE WHEN {NAMELESS} AND src_row IS NOT NULL THEN '|#' || src_row ELSE '' END"
CONTENT = f"substr(sha256({RAW}), 1, 32)"
_T = lambda c: low(trim(f"coalesce({c}, '')"))
CREW_KEY = f"""substr(sha256(concat_ws('|', {_T('match_name')}, {_T('date_text')}, {_T('time_text')}, {_T('venue')},
    array_to_string(list_sort(coalesce(referees, [])), '|'), array_to_string(list_sort(coalesce(table_officials, [])), '|'))), 1, 32)"""
_MONTHS = "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split()
_SPELLED = {"subat": 2, "mayis": 5, "agustos": 8, "eylul": 9, "kasim": 11, "aralik": 12}


def day(c: str) -> str:
    """A text's day; numbers first, else a month name; days past the month's end roll over."""
    num, word = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:\D|$)", r"(\d{1,2})\s+([A-Za-zÇĞÖŞÜçğıöşü]+)\s+(\d{4})(?:\D|$)"
    name = f"lower(translate(regexp_extract({c}, '{word}', 2), 'Iİ', 'ıi'))"
    month = f"CASE {name} " + " ".join(f"WHEN '{m}' THEN {i}" for m, i in {**{m: i for i, m in enumerate(_MONTHS, 1)}, **_SPELLED}.items()) + " END"
    get = lambda p, k: f"try_cast(nullif(regexp_extract({c}, '{p}', {k}), '') AS INT)"
    build = lambda y, m, d: f"CASE WHEN {y} BETWEEN 2015 AND 2100 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN CAST(make_date({y}, {m}, 1) + ({d} - 1) AS DATE) END"
    return f"(CASE WHEN regexp_matches({c}, '{num}') THEN {build(get(num, 3), get(num, 2), get(num, 1))} ELSE {build(get(word, 3), '(' + month + ')', get(word, 1))} END)"


def begun(d: str, t: str) -> str:
    clock = r"(\d{1,2})[:.](\d{2})"
    h, m = (f"try_cast(nullif(regexp_extract(coalesce({t}, ''), '{clock}', {k}), '') AS INT)" for k in (1, 2))
    minutes = f"coalesce(CASE WHEN {h} < 24 AND {m} < 60 THEN {h} * 60 + {m} END, 1439)"
    return f"coalesce(CAST({day(d)} AS TIMESTAMP) + to_minutes(CAST({minutes} - 180 AS INT)) <= {NOW}, false)"


SNAP = """snaps AS (SELECT *, row_number() OVER (PARTITION BY snap_no, content_key ORDER BY received_at DESC, src_row DESC, coalesce(venue, '') DESC, coalesce(time_text, '') DESC) AS rn
    FROM match_snapshots WHERE content_key IS NOT NULL),
fst AS (SELECT * FROM snaps WHERE rn = 1 AND snap_no = (SELECT min(snap_no) FROM match_snapshots WHERE content_key IS NOT NULL)),
lst AS (SELECT * FROM snaps WHERE rn = 1 AND snap_no = (SELECT max(snap_no) FROM match_snapshots WHERE content_key IS NOT NULL))"""
ACTIVE = "act AS (SELECT * FROM match_rows WHERE cancelled_at IS NULL)"
CANON = f"canon AS (SELECT content_key, arg_max(id, ({COUNT}, created_at, -id)) AS canonical_id, count(*) AS n FROM act WHERE content_key IS NOT NULL GROUP BY 1)"
_SAME = f"lower(replace({trim('e.cell')}, 'İ', 'i̇')) = lower(replace({trim('x.name_in_sheet')}, 'İ', 'i̇'))"
PLAN = f"""WITH {ACTIVE}, {CANON},
held AS (SELECT x.id, x.user_id, x.match_id, x.name_in_sheet, c.content_key, c.canonical_id FROM assignments x JOIN act r ON r.id = x.match_id JOIN canon c ON c.content_key = r.content_key WHERE c.n >= 2),
entry AS (SELECT DISTINCT id AS row_id, content_key, unnest({ALL}) AS cell FROM act WHERE content_key IN (SELECT content_key FROM canon WHERE n >= 2)),
seen AS (SELECT x.id, bool_or(e.row_id = x.canonical_id) AS on_best FROM held x JOIN entry e ON e.content_key = x.content_key AND e.row_id <> x.match_id AND {_SAME} GROUP BY 1)
SELECT x.content_key, x.canonical_id, x.id AS assignment_id, x.user_id, x.match_id AS from_row_id,
    CASE WHEN x.user_id IS NOT NULL AND EXISTS (SELECT 1 FROM held h WHERE h.content_key = x.content_key AND h.user_id = x.user_id AND h.match_id = h.canonical_id) THEN 'DELETE_DUPE'
         WHEN s.on_best THEN 'MOVE' WHEN NOT s.on_best THEN 'DELETE_ON_SIBLING' ELSE 'AMBIGUOUS' END AS action
FROM held x LEFT JOIN seen s ON s.id = x.id WHERE x.match_id <> x.canonical_id"""
KEYED = "keyed AS (SELECT x.*, r.content_key, r.cancelled_at FROM assignments x JOIN match_rows r ON r.id = x.match_id WHERE x.user_id IS NOT NULL AND r.content_key IS NOT NULL)"
TOKENS = """tok AS (SELECT user_id + 1000 AS user_id, event_type = 'purchase' AND value > 60 AS success, CASE event_type WHEN 'error' THEN 'messaging/quota-exceeded' WHEN 'view' THEN 'messaging/invalid-token'
    WHEN 'click' THEN 'messaging/not-registered' END AS code FROM events),
cls AS (SELECT user_id, CASE WHEN bool_or(success) THEN 'delivered' WHEN bool_or(NOT success AND (code IS NULL OR code = 'messaging/quota-exceeded')) THEN 'transient' ELSE 'permanent' END AS outcome,
    count(*) AS n_tokens, array_to_string(list_sort(list(DISTINCT coalesce(code, 'unknown')) FILTER (NOT success)), ',') AS error_codes FROM tok GROUP BY 1)"""
_CHANGES = """
WITH v AS (SELECT DISTINCT snap_no, content_key, match_name, date_text, time_text, venue, category, referees, table_officials, src_file, cancelled_at, cancel_reason
           FROM match_snapshots WHERE content_key IS NOT NULL),
s AS (SELECT snap_no, lead(snap_no) OVER (ORDER BY snap_no) AS nxt FROM (SELECT DISTINCT snap_no FROM match_snapshots)),
side AS (SELECT v.snap_no AS snap_no, content_key, struct_pack(match_name, date_text, time_text, venue, category, referees, table_officials, src_file, cancelled_at, cancel_reason) AS what, true AS new FROM v
         UNION ALL SELECT s.nxt, content_key, struct_pack(match_name, date_text, time_text, venue, category, referees, table_officials, src_file, cancelled_at, cancel_reason), false FROM v JOIN s USING (snap_no) WHERE s.nxt IS NOT NULL),
g AS (SELECT snap_no, content_key, list_sort(list(what) FILTER (new)) AS n, list_sort(list(what) FILTER (NOT new)) AS o FROM side GROUP BY 1, 2)
SELECT snap_no, content_key, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM g WHERE snap_no > (SELECT min(snap_no) FROM match_snapshots) AND n IS DISTINCT FROM o
"""


def oracle_sql() -> dict[str, str]:
    sq = lambda x: f"replace({fold(x)}, ' ', '')"
    words = lambda x: f"list_filter(regexp_split_to_array({normal(x)}, '[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}},.;\\-/()]+'), lambda w: regexp_matches(w, '\\p{{L}}'))"
    placeholder = "(contains(lower(translate(coalesce(match_name, ''), 'İ', 'i')), 'belirlen') OR contains(lower(translate(coalesce(match_name, ''), 'İ', 'i')), 'elemelerden gelecek') OR regexp_matches(lower(translate(coalesce(match_name, ''), 'İ', 'i')), '^[^a-z0-9_]*tbd[^a-z0-9_]') OR NOT regexp_matches(coalesce(match_name, ''), '\\p{L}'))"
    league = "CASE " + " ".join(f"WHEN regexp_matches(upper(name), '{p}') THEN '{v}'" for p, v in (
        ("OKUL|İL VE İLÇE|IL VE ILCE", "OKUL İL VE İLÇE"), ("ÖZEL LİG|ÜNİVERSİTE|OZEL LIG|UNIVERSITE", "ÖZEL LİG VE ÜNİVERSİTE"), ("BÖLGE|BOLGE", "BÖLGE LİGİ"),
        ("TBF|MİLLİ|FIBA|AVRUPA", "TBF / MİLLİ"), ("HÜKMEN", "HÜKMEN"), ("CEZA", "CEZA KARARLARI"))) + " ELSE 'Yerel Lig' END"
    numeric, clock = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:\D|$)", r"(\d{1,2})[:.](\d{2})"
    g = lambda k: f"CAST(nullif(regexp_extract(date_text, '{numeric}', {k}), '') AS INT)"
    rolled = f"(make_date({g(3)}, {g(2)}, 1) + ({g(1)} - 1))"
    fields = [("date", [0]), ("time", [1]), ("venue", [2]), ("team", [3]), ("category", [4]), ("group", [5]), ("referee", [6, 7]), ("table", [8]), ("observer", [9])]
    sides = lambda t: f"(SELECT content_key, src_file FROM {t})"
    prefix = lambda c: trim(rf"regexp_replace({c}, '^{SPACE}*(?:\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{4}}{SPACE}*(?:-{SPACE}*)?|-{SPACE}*)', '')")
    seats = ", ".join(f"coalesce({c}, '')" for c in ("date_text", "time_text", "venue", "match_name", "category", "group_name", "referees[1]", "referees[2]", "table_officials[1]", "observers[1]"))
    cells = rf"""c AS (SELECT src_file AS file, src_sheet AS sheet, CAST(rec_id + 1 AS INT) AS row_no, coalesce(date_text, '') AS d, {prefix("coalesce(venue, '')")} AS v, coalesce(match_name, '') AS n,
                [x FOR x IN [coalesce(referees[1], ''), coalesce(referees[2], '')] IF length(x) > 2] AS referees, list_filter([{seats}], lambda x: regexp_matches(x, '\d{{1,2}}\s*[./-]\s*\d{{1,2}}\s*[./-]\s*\d{{4}}'))[1] AS found FROM matches),
            k AS (SELECT *, CASE WHEN regexp_matches(d, '\d') THEN d WHEN d = '' THEN {trim("found")} END AS cd, CASE WHEN length(v) > 2 THEN v END AS cv FROM c),
            l AS (SELECT *, file AS name, last_value(cd IGNORE NULLS) OVER w AS ld, last_value(cv IGNORE NULLS) OVER w AS lv FROM k WINDOW w AS (PARTITION BY file, sheet ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
            parsed AS (SELECT sheet AS src_sheet, row_no AS src_row, {prefix("n")} AS match_name, CASE WHEN d <> '' THEN d ELSE coalesce(ld, '') END AS date_text, CASE WHEN v <> '' THEN v ELSE coalesce(lv, '') END AS venue,
                try_cast(nullif(regexp_extract(name, '(?i)(\d+)\.?\s*hafta', 1), '') AS INT) AS week, {league} AS league_type, referees FROM l WHERE length(n) > 1)"""
    return {
        "p4_found": _CHANGES,
        "p4_changes": _CHANGES.replace("AS change_kind", "AS change_kind, coalesce(len(o), 0) AS n_before, coalesce(len(n), 0) AS n_after"),
        "q57_tab_values": f"""SELECT 'tab' || CAST(id // 4000 AS VARCHAR) AS sheet, CAST(id % 4000 + 2 AS INT) AS row_no, strftime(match_date, '%d.%m.%Y') AS day, lpad(CAST((id % 96) // 4 AS VARCHAR), 2, '0') || ':' || lpad(CAST((id % 4) * 15 AS VARCHAR), 2, '0') AS clock, {trim("coalesce(match_name, '')")} AS name
            FROM match_rows WHERE match_date IS NOT NULL""",
        "q55_renamed_moves": f"WITH {ACTIVE}, {CANON}, w AS (SELECT DISTINCT r.id AS from_id, c.canonical_id AS to_id FROM match_rows r JOIN canon c ON c.content_key = r.content_key WHERE r.cancelled_at IS NOT NULL) SELECT x.id, coalesce(w.to_id, x.match_id) AS match_id FROM assignments x LEFT JOIN w ON w.from_id = x.match_id",
        "q08_consolidated": f"""WITH plan AS ({PLAN}), m AS (SELECT x.id, x.user_id, CASE WHEN p.action = 'MOVE' THEN p.canonical_id ELSE x.match_id END AS match_id, coalesce(p.action = 'MOVE', false) AS came FROM assignments x LEFT JOIN plan p ON p.assignment_id = x.id
                WHERE coalesce(p.action, '') NOT IN ('DELETE_DUPE', 'DELETE_ON_SIBLING')),
            r AS (SELECT *, row_number() OVER (PARTITION BY user_id, match_id, CASE WHEN user_id IS NULL THEN id END ORDER BY came, id) AS rn FROM m) SELECT id, match_id FROM r WHERE rn = 1""",
        "q12_upsert_fixtures": f"""WITH f AS (SELECT {CREW_KEY} AS match_key, {CONTENT} AS content_key, row_number() OVER (PARTITION BY {CREW_KEY} ORDER BY src_file DESC, src_row DESC) AS rn FROM matches), n AS (SELECT * FROM f WHERE rn = 1)
            SELECT coalesce(r.match_key, n.match_key) AS match_key, CASE WHEN n.match_key IS NULL THEN r.content_key ELSE n.content_key END AS content_key, CASE WHEN n.match_key IS NULL THEN r.cancelled_at END AS cancelled_at FROM match_rows r FULL JOIN n ON n.match_key = r.match_key""",
        "q43_parse_cells": f"WITH {cells} SELECT * FROM parsed",
        "q01_content_key": f"SELECT id, {CONTENT} AS key FROM match_rows",
        "q02_crew_key": f"SELECT id, {CREW_KEY} AS key, {COUNT} AS n FROM match_rows",
        "q03_duplicate_groups": "SELECT content_key, count(*) AS n FROM match_rows WHERE cancelled_at IS NULL AND content_key IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
        "q04_canonical_row": f"WITH {ACTIVE}, {CANON} SELECT content_key, canonical_id FROM canon",
        "q05_canonical_in_pool": f"SELECT content_key, arg_max(id, (cancelled_at IS NULL, {COUNT}, id)) AS canonical_id FROM match_rows WHERE content_key IS NOT NULL GROUP BY 1",
        "q06_carry_forward": f"WITH {cells} SELECT src_sheet, src_row, venue, date_text FROM parsed",
        "q07_group_ordinal": f"SELECT rec_id, CAST(CASE WHEN {NAMELESS} THEN row_number() OVER (PARTITION BY src_file, {part('date_text')}, {part('time_text')}, {part('venue')}, {NAMELESS} ORDER BY src_row NULLS FIRST, rec_id) - 1 ELSE src_row END AS INT) AS src_row FROM matches",
        "q08_consolidation_plan": PLAN,
        "q09_snapshot_diff": f"WITH {SNAP} SELECT coalesce(f.content_key, l.content_key) AS content_key, CASE WHEN l.content_key IS NULL THEN 'gone' WHEN f.content_key IS NULL THEN 'new' ELSE 'both' END AS side FROM fst f FULL JOIN lst l ON f.content_key = l.content_key",
        "q10_moved_semi": f"WITH {SNAP}, f AS (SELECT min(src_file) AS file FROM lst) SELECT DISTINCT content_key FROM lst, f WHERE cancelled_at IS NULL AND src_file IS DISTINCT FROM file AND content_key NOT IN (SELECT content_key FROM lst, f WHERE src_file = file)",
        "q11_change_detection": "SELECT file_id, last_md5 IS NULL OR CASE WHEN mime = 'application/vnd.google-apps.spreadsheet' THEN coalesce(modified > date_trunc('day', modified), true) ELSE coalesce(md5 <> '' AND md5 IS DISTINCT FROM last_md5, false) END AS process FROM files",
        "q12_upsert_reopen": f"""WITH {SNAP} SELECT r.id, coalesce(r.content_key, l.content_key) AS content_key, CASE WHEN l.content_key IS NULL THEN r.venue ELSE l.venue END AS venue,
            CASE WHEN l.content_key IS NULL THEN r.time_text ELSE l.time_text END AS time_text, CASE WHEN l.content_key IS NULL THEN r.cancelled_at ELSE l.cancelled_at END AS cancelled_at FROM match_rows r FULL JOIN lst l ON r.content_key = l.content_key""",
        "q13_outcome_decision": f"""WITH {SNAP}, {ACTIVE}, here AS (SELECT content_key FROM lst WHERE cancelled_at IS NULL), moved AS (SELECT content_key FROM fst WHERE content_key NOT IN (SELECT content_key FROM here)),
            pool AS (SELECT a.content_key, arg_max(a.id, (l.content_key IS NOT NULL, {COUNT.replace('len(', 'len(a.')}, a.id)) AS canonical_id FROM act a LEFT JOIN lst l ON l.content_key = a.content_key AND l.src_file = a.src_file WHERE a.content_key IS NOT NULL GROUP BY 1),
            entry AS (SELECT DISTINCT id AS row_id, unnest({ALL}) AS cell FROM act),
            x AS (SELECT s.*, a.content_key, a.date_text, a.time_text, p.canonical_id FROM assignments s JOIN act a ON a.id = s.match_id LEFT JOIN pool p ON p.content_key = a.content_key),
            o AS (SELECT x.id, x.match_id, x.canonical_id, CASE WHEN x.content_key IS NULL THEN 'KEPT'
                WHEN x.content_key NOT IN (SELECT content_key FROM here) THEN CASE WHEN x.content_key IN (SELECT content_key FROM moved) THEN 'MOVED' WHEN {begun('x.date_text', 'x.time_text')} THEN 'EXPIRED_WINDOW' ELSE 'CANCELLED' END
                WHEN EXISTS (SELECT 1 FROM entry e WHERE e.row_id = x.canonical_id AND {_SAME}) THEN CASE WHEN x.match_id = x.canonical_id THEN 'KEPT' ELSE 'ROW_SHIFTED' END
                WHEN {begun('x.date_text', 'x.time_text')} THEN 'EXPIRED_WINDOW' ELSE 'CANCELLED' END AS outcome FROM x)
            SELECT id, outcome, CASE WHEN outcome = 'ROW_SHIFTED' THEN canonical_id END AS to_match_id FROM o""",
        "q14_safety_valve": "SELECT src_file, count(cancelled_at) AS n, count(*) AS total, NOT (count(cancelled_at) >= 25 AND count(cancelled_at) > 0.4 * count(*)) AS safe FROM match_rows GROUP BY 1",
        "q15_missing_rows_valve": f"""WITH {SNAP}, cur AS (SELECT match_key FROM match_rows WHERE content_key IN (SELECT content_key FROM lst)),
            r AS (SELECT *, cancelled_at IS NULL AND NOT {begun('date_text', 'time_text').replace(NOW, "TIMESTAMP '2015-01-01 00:00:00'")} AS o, match_key NOT IN (SELECT match_key FROM cur) AS gone, id IN (SELECT match_id FROM assignments) AS busy FROM match_rows),
            f AS (SELECT src_file, count(*) FILTER (o) AS n_all, count(*) FILTER (o AND gone) AS n_gone FROM r GROUP BY 1)
            SELECT r.src_file, count(*) FILTER (o AND gone AND NOT busy AND n_gone <= 0.5 * n_all) AS n FROM r JOIN f ON f.src_file = r.src_file GROUP BY 1""",
        "q16_not_started": f"SELECT rec_id, {begun('date_text', 'time_text')} AS started FROM matches",
        "q17_date_parse": f"SELECT rec_id, {day('date_text')} AS day FROM matches",
        "q18_serial_dates": r"""WITH t AS (SELECT rec_id, CASE WHEN regexp_full_match(date_text, '\d{5}(\.\d+)?') THEN CAST(date_text AS DOUBLE) END AS d, CASE WHEN regexp_full_match(time_text, '0\.\d+') THEN CAST(time_text AS DOUBLE) END AS f FROM matches)
            SELECT rec_id, strftime(DATE '1899-12-30' + CAST(floor(d + 0.5) AS INT), '%d.%m.%Y') AS day, CASE WHEN f IS NOT NULL THEN printf('%02d:%02d', CAST(floor(f * 24 * 60) AS INT) // 60, CAST(floor(f * 24 * 60) AS INT) % 60) END AS clock FROM t WHERE d IS NOT NULL OR f IS NOT NULL""",
        "q19_normalize_fold": f"SELECT user_id, kind, {normal('n')} AS normal, {fold('n')} AS folded, {sq('n')} AS squashed FROM (SELECT user_id, kind, concat_ws(' ', first_name, last_name) AS n FROM profiles)",
        "q20_tokens": f"SELECT word, count(*) AS n FROM (SELECT unnest({words('cell')}) AS word FROM (SELECT unnest({ALL}) AS cell FROM matches)) GROUP BY 1",
        "q21_similarity_join": f"""WITH c AS (SELECT DISTINCT name_in_sheet AS cell, {sq('name_in_sheet')} AS a FROM assignments WHERE user_id IS NULL AND name_in_sheet IS NOT NULL),
            p AS (SELECT DISTINCT user_id, {sq("first_name || ' ' || last_name")} AS b FROM profiles WHERE first_name <> '' AND last_name <> ''),
            s AS (SELECT cell, user_id, max(1 - levenshtein(a, b) / greatest(length(a), length(b))) AS similarity FROM c, p WHERE a <> '' AND b <> '' AND abs(length(a) - length(b)) <= 0.1 * greatest(length(a), length(b)) AND 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.9 GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER w AS rn, lead(similarity) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY cell ORDER BY similarity DESC, user_id))
            SELECT cell, user_id, round(similarity, 6) AS similarity FROM r WHERE rn = 1 AND (nxt IS NULL OR similarity - nxt >= 0.05)""",
        "q22_typo_pairs": f"WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split({fold('last_name')}, ' ')) AS w FROM profiles) WHERE length(w) >= 5) SELECT x.w AS a, y.w AS b FROM w x JOIN w y ON x.w < y.w AND abs(length(x.w) - length(y.w)) <= 1 AND levenshtein(x.w, y.w) <= 1",
        "q25_role_of_name": "SELECT x.id, CASE " + " ".join(f"WHEN list_contains(r.{c}, x.name_in_sheet) THEN '{v}'" for c, v in zip(CREWS, ROLES)) + " END AS role FROM assignments x JOIN match_rows r ON r.id = x.match_id",
        "q26_profile_union": "SELECT user_id, first_name, last_name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY kind = 'REFEREE' DESC, first_name DESC NULLS LAST, last_name DESC NULLS LAST) AS rn FROM profiles) WHERE rn = 1",
        "q27_last_event_per_key": f"WITH {KEYED} SELECT user_id, content_key, max(created_at) AS last_at FROM keyed GROUP BY 1, 2",
        "q28_inequality_anti": f"WITH {KEYED}, l AS (SELECT user_id, content_key, max(created_at) AS last_at FROM keyed GROUP BY 1, 2) SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.user_id = l.user_id AND k.content_key = l.content_key AND k.cancelled_at > l.last_at)",
        "q29_is_new_flag": f"WITH {KEYED} SELECT id, NOT EXISTS (SELECT 1 FROM keyed o WHERE o.user_id = k.user_id AND o.content_key = k.content_key AND o.created_at < TIMESTAMP '2025-10-01') AS is_new FROM keyed k WHERE created_at >= TIMESTAMP '2025-10-01'",
        "q30_multiset_diff": f"WITH {SNAP} SELECT f.content_key, list_filter(coalesce(f.referees, []), lambda x: NOT list_contains(coalesce(l.referees, []), x)) AS went, list_filter(coalesce(l.referees, []), lambda x: NOT list_contains(coalesce(f.referees, []), x)) AS came FROM fst f JOIN lst l ON f.content_key = l.content_key",
        "q33_confirm_queue": f"""WITH q AS (SELECT x.id, x.user_id, r.content_key, CASE WHEN r.cancelled_at IS NULL THEN 'ASSIGNED' ELSE 'CANCELLED' END AS kind, {begun('r.date_text', 'r.time_text')} AS b FROM assignments x JOIN match_rows r ON r.id = x.match_id WHERE x.user_id IS NOT NULL),
            c AS (SELECT q.*, EXISTS (SELECT 1 FROM assignments y JOIN match_rows r ON r.id = y.match_id WHERE y.user_id = q.user_id AND r.content_key = q.content_key AND r.cancelled_at IS NULL) AS o FROM q)
            SELECT id, CASE WHEN kind = 'ASSIGNED' THEN CASE WHEN NOT o OR b THEN 'drop' ELSE 'send' END ELSE CASE WHEN o OR b THEN 'drop' ELSE 'send' END END AS action,
                CASE WHEN kind = 'ASSIGNED' THEN CASE WHEN NOT o THEN 'not on the fixture' WHEN b THEN 'begun' END ELSE CASE WHEN o THEN 'back on the fixture' WHEN b THEN 'begun' END END AS reason FROM c""",
        "q34_due_topk": f"SELECT id, created_at AS due_at FROM assignments WHERE user_id IS NULL AND created_at <= {NOW} ORDER BY id LIMIT 500",
        "q35_retry_schedule": "WITH t AS (SELECT match_id, CAST(count(*) AS INT) AS attempt, max(created_at) AS last_at FROM assignments GROUP BY 1) SELECT match_id, attempt, CASE WHEN attempt > 5 THEN 'FAILED' ELSE 'PENDING' END AS status, last_at + to_minutes([1, 2, 5, 15, 30][attempt]) AS due_at FROM t",
        "q36_delivery_class": f"WITH {TOKENS} SELECT user_id, outcome, n_tokens, nullif(error_codes, '') AS error_codes FROM cls",
        "q36_delivery_rows": f"WITH {TOKENS} SELECT u.id AS user_id, CASE WHEN outcome IS NULL THEN 'NO_TOKEN' WHEN outcome = 'delivered' THEN CASE WHEN u.push_permission = 'denied' THEN 'PERMISSION_DENIED' ELSE 'DELIVERED' END WHEN outcome = 'transient' THEN 'TRANSIENT_FAIL' ELSE 'PERMANENT_FAIL' END AS status, coalesce(n_tokens, 0) AS n_tokens, nullif(error_codes, '') AS error_codes FROM users u LEFT JOIN cls c ON c.user_id = u.id",
        "q37_partition_diff": f"WITH p AS (SELECT DISTINCT content_key AS o, {CREW_KEY} AS n FROM match_rows WHERE content_key IS NOT NULL) SELECT o AS group_key, 'split' AS kind, count(*) AS n FROM p GROUP BY o HAVING count(*) > 1 UNION ALL SELECT n, 'merged', count(*) FROM p GROUP BY n HAVING count(*) > 1",
        "q38_slot_duplicates": f"WITH {ACTIVE}, {CANON} SELECT date_text, time_text, venue, count(*) AS n_keys, arg_max(r.id, (NOT {placeholder}, {COUNT}, r.created_at, -r.id)) AS canonical_id FROM canon c JOIN act r ON r.id = c.canonical_id WHERE date_text IS NOT NULL AND time_text IS NOT NULL AND venue IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1",
        "q39_category_counts": "WITH c AS (SELECT user_id, coalesce(category, '') AS category, count(*) AS n FROM assignments x JOIN match_rows r ON r.id = x.match_id WHERE user_id IS NOT NULL GROUP BY 1, 2) SELECT user_id, list(category || '=' || n ORDER BY category) AS categories FROM c GROUP BY 1",
        "q40_cutoff_filter": f"WITH t AS (SELECT rec_id, {day('date_text')} AS day FROM matches) SELECT rec_id, day, CASE WHEN month(day) >= 8 THEN year(day) || '-' || (year(day) + 1) WHEN day IS NOT NULL THEN (year(day) - 1) || '-' || year(day) ELSE '' END AS season_key FROM t WHERE day IS NULL OR day >= DATE '2025-08-01'",
        "q41_fingerprint": f"""WITH {SNAP}, a AS (SELECT src_file, list(struct_pack(content_key, match_name, date_text, time_text, venue) ORDER BY content_key) AS r FROM fst GROUP BY 1), b AS (SELECT src_file, list(struct_pack(content_key, match_name, date_text, time_text, venue) ORDER BY content_key) AS r FROM lst GROUP BY 1)
            SELECT coalesce(a.src_file, b.src_file) AS src_file, a.r IS NOT NULL AND b.r IS NOT NULL AND a.r IS NOT DISTINCT FROM b.r AS skip FROM a FULL JOIN b ON a.src_file = b.src_file""",
        "q42_latest_partition": r"WITH f AS (SELECT file_id, nullif(regexp_extract(name, '(\d{4})-(\d{4})', 0), '') AS season FROM files) SELECT file_id, season FROM f WHERE season IS NOT NULL AND substr(season, 1, 4) = (SELECT max(substr(season, 1, 4)) FROM f)",
        "q43_header_classify": "SELECT DISTINCT src_file AS file, src_sheet AS sheet, 1 AS header_row, field, positions FROM matches, (VALUES " + ", ".join(f"('{f}', {p})" for f, p in fields) + ") t(field, positions)",
        "q44_announcement_agg": "SELECT match_id, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS user_ids FROM (SELECT DISTINCT x.match_id, x.user_id FROM assignments x JOIN match_rows r ON r.id = x.match_id WHERE r.cancelled_at IS NOT NULL AND x.user_id IS NOT NULL) GROUP BY 1",
        "q45_url_parse": "SELECT id, file_id, 'k-' || id AS resource_key FROM files",
        "q46_wrongly_cancelled": f"WITH {ACTIVE}, {CANON} SELECT x.id AS assignment_id, x.match_id AS from_row_id, c.canonical_id AS to_row_id FROM assignments x JOIN match_rows r ON r.id = x.match_id JOIN canon c ON c.content_key = r.content_key WHERE r.cancelled_at IS NOT NULL",
        "q47_shifted_groups": f"""WITH n AS (SELECT * FROM match_rows WHERE {NAMELESS}), g AS (SELECT date_text, time_text, venue, count(cancelled_at) AS n_cancelled, count(*) - count(cancelled_at) AS n_active FROM n GROUP BY 1, 2, 3 HAVING count(cancelled_at) >= 2),
            e AS (SELECT date_text, time_text, venue, cancelled_at IS NULL AS live, unnest({ALL}) AS x FROM n), p AS (SELECT date_text, time_text, venue, x, bool_or(live) AS live, bool_or(NOT live) AS dead FROM e WHERE regexp_matches(x, '\\p{{L}}') GROUP BY 1, 2, 3, 4)
            SELECT g.*, CAST((SELECT count(*) FROM p WHERE p.date_text IS NOT DISTINCT FROM g.date_text AND p.time_text IS NOT DISTINCT FROM g.time_text AND p.venue IS NOT DISTINCT FROM g.venue AND dead AND NOT live) AS INT) AS n_lost FROM g""",
        "q48_reactivate": f"""WITH k AS (SELECT * FROM match_rows WHERE {NAMELESS} AND content_key IS NOT NULL), skip AS (SELECT content_key FROM k WHERE id IN (SELECT match_id FROM assignments WHERE paid_at IS NOT NULL)),
            pick AS (SELECT arg_max(id, ({COUNT}, updated_at, -id)) AS id FROM k WHERE content_key NOT IN (SELECT content_key FROM k WHERE cancelled_at IS NULL) AND content_key NOT IN (SELECT content_key FROM skip) GROUP BY content_key)
            SELECT id FROM match_rows WHERE cancelled_at IS NULL OR id IN (SELECT id FROM pick)""",
        "q49_active_profiles": "SELECT user_id, kind FROM profiles WHERE user_id IN (SELECT id FROM users WHERE is_active AND is_approved)",
        "q50_backfill_days": f"SELECT id, coalesce(CASE WHEN week IS NOT NULL THEN match_date END, {day('date_text')}) AS match_date FROM match_rows",
        "q51_file_metadata": f"""SELECT id, try_cast(nullif(regexp_extract(name, '(?i)(\\d+)\\.?\\s*hafta', 1), '') AS INT) AS week, {league} AS league,
            {trim("regexp_replace(regexp_replace(name, '(?i)[.](xlsx|xls|csv)$', ''), '(?i)ARŞ[İI]V' || '" + SPACE + "*', '')")} AS category, regexp_matches({trim('name')}, '(?i)^(sheet\\s*\\d*|sayfa\\s*\\d*|worksheet\\s*\\d*|[çÇ]al[ıI]şma\\s*sayfas[ıI]\\s*\\d*|data\\s*\\d*)$') AS generic FROM files""",
        "q52_formats": f"""SELECT rec_id, CASE WHEN regexp_matches(coalesce(date_text, ''), '{numeric}') AND {g(2)} BETWEEN 1 AND 12 AND {g(1)} BETWEEN 1 AND 31 AND {g(3)} > 0
                THEN {g(1)} || ' ' || ['Ocak', 'Şubat', 'Mart', 'Nisan', 'Mayıs', 'Haziran', 'Temmuz', 'Ağustos', 'Eylül', 'Ekim', 'Kasım', 'Aralık'][{g(2)}] || ' ' || ['Pazar', 'Pazartesi', 'Salı', 'Çarşamba', 'Perşembe', 'Cuma', 'Cumartesi'][dayofweek({rolled}) + 1]
                ELSE {trim("coalesce(date_text, '')")} END AS day,
            CASE WHEN regexp_matches(coalesce(time_text, ''), '{clock}') THEN lpad(regexp_extract(time_text, '{clock}', 1), 2, '0') || ':' || regexp_extract(time_text, '{clock}', 2) ELSE {trim("coalesce(time_text, '')")} END AS clock FROM matches""",
        "q53_enqueue": f"WITH {KEYED}, q AS (SELECT user_id, content_key, CASE WHEN cancelled_at IS NULL THEN 'UPDATED' ELSE 'CANCELLED' END AS kind FROM keyed) SELECT kind, 'PENDING' AS status, count(*) AS n FROM q GROUP BY 1",
        "q54_group_cancels": f"WITH {KEYED} SELECT content_key AS fixture, array_to_string(list_sort(list(DISTINCT CAST(user_id AS VARCHAR))), ',') AS user_ids, count(DISTINCT user_id) AS n FROM keyed WHERE cancelled_at IS NOT NULL GROUP BY 1",
    }
