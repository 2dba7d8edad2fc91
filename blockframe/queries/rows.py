"""Queries of problems 1 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe.operators.ingest import rejects, strict_load
from blockframe.operators.skew import fragment_replicate_join, key_statistics, unpivot_keys
from blockframe.plans.runtime import table

RATINGS, RAW = "sample_movielens_ratings", "sample_movielens_ratings_raw"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each failure of each line."""
    bad = rejects(table(spark, sf_dir, RAW))
    return bad.select("line_id", F.explode("reasons").alias("reason"))


def p1_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines as typed rows."""
    return strict_load(table(spark, sf_dir, RAW))


def p1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other lines, with their reasons joined by commas."""
    return rejects(table(spark, sf_dir, RAW)).select("line_id", "file_name", "line", F.array_join("reasons", ",").alias("reasons"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of c0 and c1 that hold at least 2 % of the rows."""
    stats = key_statistics(table(spark, sf_dir, RATINGS), ["c0", "c1"], "c2", "c3")
    return stats.filter("is_heavy").select("field", "key_value")


def p4_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings, mean c2, last c3 and heaviness of every c0 and c1."""
    stats = key_statistics(table(spark, sf_dir, RATINGS), ["c0", "c1"], "c2", "c3")
    return stats.select("field", "key_value", "n_rows", F.round("mean_value", 6).alias("mean_c2"), F.col("last_time").alias("last_c3"), "is_heavy")


def p4_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of c2 from the mean of its key: the key's mean is joined to every rating, heavy keys split."""
    ratings = table(spark, sf_dir, RATINGS)
    means = key_statistics(ratings, ["c0", "c1"], "c2", "c3").select("field", "key_value", "mean_value")
    rows = unpivot_keys(ratings, ["c0", "c1"], "c2", "c3", F.xxhash64(*ratings.columns).alias("row")).select("field", "key_value", "v", "row")
    joined = fragment_replicate_join(rows.filter("v IS NOT NULL"), means, ["field", "key_value"], spread=["row"])
    return joined.groupBy("field", "key_value").agg(F.round(F.avg(F.abs(F.col("v") - F.col("mean_value"))), 9).alias("spread"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ratings, p1_rejects, p4_found, p4_keys, p4_spread)}

_FIELD = '("([^"]|"")*"|[^",]*)'
_CUT = f"""
cut AS (
  SELECT line_id, file_name, line, regexp_full_match(line, '{_FIELD}(,{_FIELD})*', 's') AS ok,
         regexp_extract_all(',' || line, ',{_FIELD}', 1, 's') AS f
  FROM sample_movielens_ratings_raw),
plain AS (
  SELECT line_id, file_name, line, ok, len(f) AS n,
         list_transform(f, lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, chr(32) || chr(9) || chr(13))) AS f
  FROM cut),
judged AS (
  SELECT *, (f[3] = '' OR regexp_full_match(f[3], '0*[1-5]')) AS c2_ok,
         regexp_full_match(f[4], '0*[0-9]{{1,18}}') AND coalesce(TRY_CAST(f[4] AS BIGINT) BETWEEN 946684800 AND 1893455999, false) AS c3_ok
  FROM plain),
cases AS (
  SELECT line_id, file_name, line, f,
         CASE WHEN NOT ok THEN ['quoting'] WHEN n <> 4 THEN ['columns']
              ELSE list_filter([CASE WHEN NOT c2_ok THEN 'c2' END, CASE WHEN NOT c3_ok THEN 'c3' END], lambda x: x IS NOT NULL) END AS reasons
  FROM judged)
"""
_KEYS = """
long AS (
  SELECT 'c0' AS field, c0::BIGINT AS key_value, c2, c3 FROM sample_movielens_ratings
  UNION ALL SELECT 'c1', c1::BIGINT, c2, c3 FROM sample_movielens_ratings),
stats AS (
  SELECT field, key_value, count(*) AS n_rows, avg(c2) AS mean_value, max(c3) AS last_c3,
         count(*) >= 0.02 * (SELECT count(*) FROM sample_movielens_ratings) AS is_heavy
  FROM long WHERE key_value IS NOT NULL GROUP BY ALL)
"""
ORACLES = {
    "p1_found": f"WITH {_CUT} SELECT line_id, unnest(reasons) AS reason FROM cases",
    "p1_ratings": f"""WITH {_CUT}
        SELECT line_id, file_name,
               CASE WHEN regexp_full_match(f[1], '-?[0-9]+') THEN TRY_CAST(f[1] AS INT) END AS c0,
               CASE WHEN regexp_full_match(f[2], '-?[0-9]+') THEN TRY_CAST(f[2] AS INT) END AS c1,
               TRY_CAST(f[3] AS INT) AS c2, TRY_CAST(f[4] AS BIGINT) AS c3
        FROM cases WHERE len(reasons) = 0""",
    "p1_rejects": f"WITH {_CUT} SELECT line_id, file_name, line, array_to_string(reasons, ',') AS reasons FROM cases WHERE len(reasons) > 0",
    "p4_found": f"WITH {_KEYS} SELECT field, key_value FROM stats WHERE is_heavy",
    "p4_keys": f"WITH {_KEYS} SELECT field, key_value, n_rows, round(mean_value, 6) AS mean_c2, last_c3, is_heavy FROM stats",
    "p4_spread": f"""WITH {_KEYS} SELECT field, key_value, round(avg(abs(c2 - mean_value)), 9) AS spread
        FROM long JOIN stats USING (field, key_value) WHERE c2 IS NOT NULL GROUP BY ALL""",
}
