"""Continuous working periods and gaps of each resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.functions.dates import written_period
from vitaeflow.operators.intervals import merge_intervals
from vitaeflow.sources.tables import read_table

#: The month that "still running" stands for.
RUNNING = 2026 * 12 + 9 - 1


def dated_entries(df: DataFrame, running: int = RUNNING, kept: tuple[str, ...] = ()) -> DataFrame:
    """``resume_id, *kept, s, e`` (month indexes) of every entry; ``date_interval`` first, else the two strings."""
    i = F.col("date_interval")
    whole = i.isNotNull() & i.start_year.isNotNull() & i.start_month.between(1, 12) & i.end_year.isNotNull() & i.end_month.between(1, 12)
    p = F.when(whole, F.array(i.start_year * 12 + i.start_month - 1, i.end_year * 12 + i.end_month - 1)).otherwise(
        written_period(F.col("start_date_str"), F.col("end_date_str"), running)
    )
    # As a generated row the pair is computed once; filters on it aren't pushed below, where they'd repeat it.
    return df.select("resume_id", *kept, F.inline(F.array(F.struct(p.alias("p")))).alias("p")).select("resume_id", *kept, F.col("p")[0].alias("s"), F.col("p")[1].alias("e"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """``resume_id, kind, start_ym, end_ym``. Repeated entries needn't be dropped first: a period of equal
    intervals is that interval."""
    rows = merge_intervals(dated_entries(read_table(spark, folder, "experience_entry")), "resume_id", "s", "e")
    ym = lambda c: (F.floor(F.col(c) / 12) * 100 + F.col(c) % 12 + 1).cast("int")
    return rows.select("resume_id", "kind", ym("s").alias("start_ym"), ym("e").alias("end_ym"))


P4_SQL = """
WITH names(w, m) AS (VALUES ('jan',1),('ene',1),('feb',2),('fev',2),('mar',3),('apr',4),('abr',4),('avr',4),('may',5),('mai',5),('jun',6),('jul',7),('aug',8),('ago',8),('aou',8),('sep',9),('set',9),('oct',10),('okt',10),('nov',11),('dec',12),('dez',12),('dic',12)),
src AS (SELECT DISTINCT entry_id, resume_id, date_interval AS i, trim(start_date_str) AS a, nullif(trim(end_date_str), '') AS b FROM experience_entry WHERE resume_id IS NOT NULL),
sides AS (
  SELECT entry_id, resume_id, i,
    CASE WHEN b IS NULL AND regexp_matches(lower(a), '\\s(-|–|—|to|until)\\s') THEN regexp_split_to_array(lower(a), '\\s+(-|–|—|to|until)\\s+')[1]
         ELSE regexp_replace(regexp_replace(lower(a), '^(since|from)\\s+', ''), '\\s+onwards?$', '') END AS sa,
    CASE WHEN b IS NULL AND regexp_matches(lower(a), '\\s(-|–|—|to|until)\\s') THEN regexp_split_to_array(lower(a), '\\s+(-|–|—|to|until)\\s+')[2]
         WHEN b IS NULL AND regexp_matches(lower(a), '^(since|from)\\s|\\sonwards?$') THEN 'present' ELSE lower(b) END AS sb
  FROM src),
ends AS (
  SELECT entry_id, 's' AS side, strip_accents(sa) AS t FROM sides WHERE sa IS NOT NULL
  UNION ALL SELECT entry_id, 'e', strip_accents(sb) FROM sides WHERE sb IS NOT NULL),
parsed AS (
  SELECT entry_id, side,
    CASE WHEN regexp_full_match(t, '\\d{4}') THEN t::INT * 12 + CASE side WHEN 'e' THEN 11 ELSE 0 END
         WHEN regexp_full_match(t, '\\d{4}-\\d{1,2}(-\\d{1,2})?') THEN split_part(t, '-', 1)::INT * 12 + split_part(t, '-', 2)::INT - 1
         WHEN regexp_full_match(t, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN split_part(t, '/', 3)::INT * 12 + split_part(t, '/', 2)::INT - 1
         WHEN regexp_full_match(t, '\\d{1,2}[/.]\\d{4}') THEN right(t, 4)::INT * 12 + regexp_extract(t, '^\\d+')::INT - 1
         WHEN regexp_matches(t, '[a-z]{3,}.*\\d{4}$') THEN right(t, 4)::INT * 12 + (SELECT m FROM names WHERE w = left(regexp_extract(t, '[a-z]{3,}'), 3)) - 1
         WHEN regexp_full_match(t, '[a-z]{3,}\\.?[ -]*''?\\d{2}') THEN (CASE WHEN right(t, 2)::INT < 50 THEN 2000 ELSE 1900 END + right(t, 2)::INT) * 12 + (SELECT m FROM names WHERE w = left(regexp_extract(t, '[a-z]{3,}'), 3)) - 1
         WHEN side = 'e' AND t IN ('present', 'current', 'to date', 'till date', 'today', 'now', 'ongoing') THEN 2026 * 12 + 8 END AS ix
  FROM ends),
pair AS (SELECT entry_id, max(ix) FILTER (side = 's') AS s, max(ix) FILTER (side = 'e') AS e FROM parsed GROUP BY 1),
spans AS (
  SELECT DISTINCT x.resume_id,
    CASE WHEN x.i IS NOT NULL THEN x.i.start_year * 12 + x.i.start_month - 1 ELSE b.s END AS s,
    CASE WHEN x.i IS NOT NULL THEN x.i.end_year * 12 + x.i.end_month - 1 ELSE b.e END AS e
  FROM sides x LEFT JOIN pair b USING (entry_id)),
good AS (SELECT * FROM spans WHERE s IS NOT NULL AND e >= s),
seen AS (SELECT *, max(e) OVER (PARTITION BY resume_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM good),
isl AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY s, e) AS g FROM seen),
per AS (SELECT resume_id, g, min(s) AS s, max(e) AS e FROM isl GROUP BY 1, 2),
gap AS (SELECT resume_id, lag(e) OVER (PARTITION BY resume_id ORDER BY g) + 1 AS s, s - 1 AS e FROM per),
out AS (SELECT resume_id, 'period' AS kind, s, e FROM per UNION ALL SELECT resume_id, 'gap', s, e FROM gap WHERE s IS NOT NULL)
SELECT resume_id, kind, CAST((s // 12) * 100 + s % 12 + 1 AS INTEGER) AS start_ym, CAST((e // 12) * 100 + e % 12 + 1 AS INTEGER) AS end_ym FROM out
"""
