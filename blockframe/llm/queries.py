"""Registered queries of the problems tagged llm, with DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe.llm import abuse, bpe, clusters, neighbours, packing, pairs, proportions
from blockframe.plans.runtime import durable, table

IRIS, RATINGS = "iris_csv", "sample_movielens_ratings"
FLOWER = ["sepallength", "petallength", "petalwidth"]
MEASURES = ["sepallength", "sepalwidth", "petallength", "petalwidth"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of usable rows of which one is among the 5 nearest of the other."""
    near = neighbours.nearest(table(spark, sf_dir, IRIS), "row_idx", MEASURES)
    pair = near.select("row_idx", F.explode("near").alias("e")).select(
        F.least("row_idx", "e.id").alias("row_a"), F.greatest("row_idx", "e.id").alias("row_b")
    )
    return pair.distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest other usable rows of every usable row, with rank and distance."""
    near = neighbours.nearest(table(spark, sf_dir, IRIS), "row_idx", MEASURES)
    ranked = near.select("row_idx", F.posexplode("near").alias("rank", "e"))
    return ranked.select("row_idx", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("neighbour"), F.round(F.sqrt("e.d"), 9).alias("distance"))


def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, IRIS).select("row_idx", "block_id", "class", *MEASURES)
    return proportions.distinct_units(rows, "row_idx", "block_id", "class", MEASURES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose need exceeds the supply."""
    return p3_report(spark, sf_dir).filter("gap > 0").select("block_id", "class")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with need, supply, rows drawn and missing, and the mean inclusion probability."""
    cells = proportions.calibrate(p3_units(spark, sf_dir), table(spark, sf_dir, "class_targets"), "block_id", "class")
    return proportions.report(cells, "block_id", "class").withColumn("p", F.round("p", 6))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled rows."""
    units = durable(p3_units(spark, sf_dir))
    cells = durable(proportions.calibrate(units, table(spark, sf_dir, "class_targets"), "block_id", "class"))
    return proportions.draw(units, cells, "row_idx", "block_id", "class")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sampled rows of every block and class."""
    return p3_sample(spark, sf_dir).groupBy("block_id", "class").agg(F.countDistinct("row_idx").alias("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with 12 common baskets, 0.5 % of all baskets and 2.5 times as many as by chance."""
    found = pairs.co_occurrence(table(spark, sf_dir, RATINGS), "c0", "c1", min_common=12, min_share=0.005)
    lifted = 2 * F.col("common") * F.col("n_baskets") >= 5 * F.col("support_a") * F.col("support_b")
    return found.filter(lifted).select("item_a", "item_b")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of items of a common user."""
    found = pairs.co_occurrence(table(spark, sf_dir, RATINGS), "c0", "c1")
    return found.select("item_a", "item_b", "common", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the clusters of at least 3 rows joined by steps of at most 0.02."""
    return clusters.linked(table(spark, sf_dir, IRIS), "row_idx", FLOWER, eps=0.02)


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine clusters with their sizes and five most typical rows each."""
    assigned, _ = clusters.cluster(table(spark, sf_dir, IRIS), "row_idx", FLOWER, clusters=9, threshold=0.1)
    return clusters.describe(assigned, "row_idx")


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in all clusters, their number, and whether every typical row is usable and listed once."""
    described = p6_clusters(spark, sf_dir)
    sizes = described.groupBy("cluster").agg(F.first("size").alias("size"), F.countDistinct("row_idx").alias("typical"))
    return sizes.agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("clusters"), F.max("typical").alias("typical"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids stand for."""
    return bpe.decode(p7_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece."""
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, unused space and relaxed conflicts in total."""
    packed = packing.pack_texts(table(spark, sf_dir, "documents")).filter("container IS NOT NULL")
    total = packed.agg(
        F.countDistinct("container").alias("containers"),
        F.sum("size").alias("tokens"),
        F.sum(F.when(F.col("relaxed") == 1, 1).otherwise(0)).alias("source_shared"),
        F.sum(F.when(F.col("relaxed") == 2, 1).otherwise(0)).alias("cluster_shared"),
    )
    return total.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * packing.CAPACITY), 6))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with and without space, pieces that do not follow on each other, and containers over their capacity."""
    packed = durable(packing.pack_texts(table(spark, sf_dir, "documents")))
    by_document = packed.groupBy("doc_id").agg(F.max("container").alias("c"), F.sum("size").alias("size"), F.max(F.col("start") + F.col("size")).alias("end"))
    by_container = packed.filter("container IS NOT NULL").groupBy("container").agg(F.sum("size").alias("size"))
    names = ("placed", "empty", "broken", "overfull")
    one = by_document.select(F.col("c").isNotNull(), F.col("c").isNull(), F.col("size") != F.col("end"), F.lit(False))
    other = by_container.select(F.lit(False), F.lit(False), F.lit(False), F.col("size") > packing.CAPACITY)
    return one.toDF(*names).unionByName(other.toDF(*names)).agg(*[F.count(F.when(F.col(k), 1)).alias(k) for k in names])


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, verdict and evidence of every document."""
    documents = table(spark, sf_dir, "documents")
    return abuse.score(documents, abuse.fit(documents, table(spark, sf_dir, "doc_labels")), keep=("source",))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abusive documents."""
    return p9_scores(spark, sf_dir).filter("abusive").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, abusive documents and their rate of every source."""
    return abuse.rates(p9_scores(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def p9_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every source, and whether its rate is their share."""
    rates = abuse.rates(p9_scores(spark, sf_dir))
    return rates.select("source", "documents", (F.abs(F.col("rate") * F.col("documents") - F.col("abusive")) < 1e-6).alias("is_share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p3_found, p3_report, p3_sample, p3_counts, p5_found, p5_pairs, p6_found, p6_clusters, p6_totals, p7_ids, p7_text, p8_containers, p8_report, p8_totals, p9_found, p9_scores, p9_rates, p9_totals)}

#: Column statistics leave NaN out and isnan() is folded over them, hence the text comparison.
_USABLE = " AND ".join(f"{m} IS NOT NULL AND {m}::VARCHAR <> 'nan' AND {m} > 0" for m in MEASURES)
_CELLS = f"""
units AS (
  SELECT DISTINCT block_id, class, {", ".join(MEASURES)} FROM iris_csv WHERE {_USABLE} AND block_id IS NOT NULL AND class IS NOT NULL),
supplies AS (SELECT block_id, class, count(*) AS supply FROM units GROUP BY ALL),
cells AS (
  SELECT t.block_id, t.class, greatest(min_rows::BIGINT, floor(target_share * sample_size + 0.5)::BIGINT) AS need, coalesce(supply, 0) AS supply
  FROM class_targets t LEFT JOIN supplies s ON t.block_id = s.block_id AND t.class = s.class)
"""
_PAIRS = """
baskets AS (SELECT DISTINCT c0, c1 FROM sample_movielens_ratings WHERE c0 IS NOT NULL AND c1 IS NOT NULL),
supports AS (SELECT c1, count(*) AS n FROM baskets GROUP BY c1),
total AS (SELECT count(DISTINCT c0) AS n FROM baskets),
common AS (
  SELECT a.c1 AS item_a, b.c1 AS item_b, count(*) AS common FROM baskets a JOIN baskets b ON a.c0 = b.c0 AND a.c1 < b.c1 GROUP BY ALL),
scored AS (
  SELECT item_a, item_b, common, a.n AS na, b.n AS nb, total.n AS n
  FROM common JOIN supports a ON a.c1 = item_a JOIN supports b ON b.c1 = item_b, total)
"""
_NEAR = f"""
usable AS (SELECT row_idx, {", ".join(MEASURES)} FROM iris_csv WHERE {_USABLE}),
distances AS (
  SELECT a.row_idx AS row_idx, b.row_idx AS neighbour, {" + ".join(f"(a.{m} - b.{m}) * (a.{m} - b.{m})" for m in MEASURES)} AS d
  FROM usable a, usable b WHERE a.row_idx <> b.row_idx),
near AS (
  SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY d, neighbour) AS rank FROM distances QUALIFY rank <= 5)
"""
ORACLES = {
    "p2_found": f"WITH {_NEAR} SELECT DISTINCT least(row_idx, neighbour) AS row_a, greatest(row_idx, neighbour) AS row_b FROM near",
    "p2_neighbours": f"WITH {_NEAR} SELECT row_idx, rank::INT AS rank, neighbour, round(sqrt(d), 9) AS distance FROM near",
    "p6_found": f"""WITH RECURSIVE
        points AS (SELECT row_idx, {", ".join(FLOWER)} FROM iris_csv WHERE {" AND ".join(f"{m} IS NOT NULL AND {m}::VARCHAR <> 'nan' AND {m} > 0" for m in FLOWER)}),
        links AS (SELECT a.row_idx AS u, b.row_idx AS v FROM points a, points b
                  WHERE {" + ".join(f"(a.{m} - b.{m}) * (a.{m} - b.{m})" for m in FLOWER)} <= 0.02 * 0.02 + 4e-13),
        reach AS (SELECT u AS root, u AS v FROM links UNION SELECT root, links.v FROM reach JOIN links ON reach.v = links.u WHERE links.v > root OR root IS NULL),
        labels AS (SELECT v AS row_idx, min(root) AS cluster_row FROM reach GROUP BY v)
        SELECT cluster_row, row_idx FROM labels QUALIFY count(*) OVER (PARTITION BY cluster_row) >= 3""",
    "p3_found": f"WITH {_CELLS} SELECT block_id, class FROM cells WHERE need > supply",
    "p3_report": f"""WITH {_CELLS} SELECT block_id, class, need, supply, greatest(need - supply, 0) AS gap, least(need, supply) AS expected,
        CASE WHEN supply = 0 THEN 0.0 ELSE round(least(need, supply) / supply, 6) END AS p FROM cells""",
    "p3_counts": f"WITH {_CELLS} SELECT block_id, class, least(need, supply) AS n FROM cells WHERE least(need, supply) > 0",
    "p6_totals": f"""SELECT count(*) AS rows, 9::BIGINT AS clusters, 5::BIGINT AS typical FROM iris_csv
        WHERE {" AND ".join(f"{m} IS NOT NULL AND {m}::VARCHAR <> 'nan' AND {m} > 0 AND {m}::VARCHAR <> 'inf'" for m in FLOWER)}""",
    "p7_text": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p8_totals": """SELECT count(*) FILTER (text <> '') AS placed, count(*) FILTER (coalesce(text, '') = '') AS empty, 0::BIGINT AS broken, 0::BIGINT AS overfull FROM documents""",
    "p9_totals": "SELECT source, count(*) AS documents, true AS is_share FROM documents GROUP BY source",
    "p5_found": f"""WITH {_PAIRS} SELECT item_a, item_b FROM scored
        WHERE common >= 12 AND 200 * common >= n AND 2 * common * n >= 5 * na * nb""",
    "p5_pairs": f"""WITH {_PAIRS} SELECT item_a, item_b, common, round(common * n / (na * nb), 6) AS lift,
        CASE WHEN common < na THEN round((1 - nb / n) / (1 - common / na), 6) END AS conviction FROM scored""",
}
