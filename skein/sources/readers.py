"""Readers: JSON documents, JSON arrays, JSON lines, Parquet vectors, cluster snapshots."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import text as TX
from skein.functions import vector as V
from skein.sources.sinks import STRATEGY

CLAIM = "struct<id:string,statement:string,assumptions:array<string>,evaluation:struct<dataset:string,period:string,metrics:array<string>>,year:int,strength:double>"
PAPER = f"""paper_id string, id string, title string, originalFilename string, filePath string, version int, year int, firstReadAt string, ingestedAt string,
summary string, introSummary string, methodSummary string, resultsSummary string, clusterIndex int, primaryClusterK10 int, primaryClusterK50 int,
userTags array<string>, keywords array<string>, assumptions array<string>, takeaways array<string>, pageCount int, readingStatus string, isImportant boolean, noteEmbedding array<float>,
embedding array<float>, claims array<{CLAIM}>, methodPipeline struct<steps:array<struct<stage:string,label:string,detail:string>>>,
tradingScores struct<novelty:double,usability:double,strategyImpact:double,confidence:double>, tradingTags array<string>"""
CHUNK = "id string, paperID string, text string, embedding array<float>, `order` int, pageHint int"


def instant(c):
    """A time from an ISO text, or from a number of seconds since 2001-01-01 UTC."""
    return F.coalesce(F.timestamp_seconds(c.try_cast("double") + 978_307_200), F.try_to_timestamp(c))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per paper; papers without a vector are dropped, tags fall back to keywords."""
    raw = spark.read.schema(PAPER).json(path, multiLine=True, mode="PERMISSIVE").where(F.size("embedding") > 0)
    s = F.col("tradingScores")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return raw.select(
        F.coalesce("paper_id", "id").alias("paper_id"), "title", F.col("originalFilename").alias("original_filename"), F.col("filePath").alias("file_path"), F.coalesce("version", F.lit(1)).alias("version"), "year",
        instant(F.col("firstReadAt")).alias("first_read_at"), instant(F.col("ingestedAt")).alias("ingested_at"), "summary", F.col("introSummary").alias("intro_summary"), F.col("methodSummary").alias("method_summary"), F.col("resultsSummary").alias("results_summary"),
        F.col("clusterIndex").alias("cluster_id"), F.coalesce("primaryClusterK10", "clusterIndex").alias("primary_cluster_k10"), F.col("primaryClusterK50").alias("primary_cluster_k50"),
        F.when(F.size("userTags") > 0, F.col("userTags")).otherwise(F.coalesce("keywords", F.array().cast("array<string>"))).alias("tags"), "keywords", F.coalesce("assumptions", F.array().cast("array<string>")).alias("assumptions"), "takeaways",
        F.col("pageCount").alias("page_count"), F.col("readingStatus").alias("reading_status"), F.col("isImportant").alias("is_important"), F.col("noteEmbedding").alias("note_embedding"), "embedding", "claims", F.col("methodPipeline").alias("method_pipeline"),
        F.coalesce("tradingTags", F.array().cast("array<string>")).alias("trading_tags"), s.alias("scores"), (zero(s["strategyImpact"]) * zero(s["usability"]) * zero(s["confidence"])).alias("priority"))


def read_chunks(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """A JSON array of chunks; those with a vector, fitted to dim if given."""
    c = spark.read.schema(CHUNK).json(path, multiLine=True).where(F.size("embedding") > 0)
    e = V.fit_dimension(F.col("embedding"), dim) if dim else F.col("embedding")
    return c.select(F.col("id").alias("chunk_id"), F.col("paperID").alias("paper_id"), "text", e.alias("embedding"), F.col("order").alias("ord"), F.col("pageHint").alias("page_hint"))


EVENT_NAMES = ("event_id", "timestamp", "event_type", "paper_id")


def parse_events(lines: DataFrame) -> DataFrame:
    """ts, event_type, paper_id, extras (the other fields as text) of JSON lines; blank and malformed ones are skipped."""
    m = F.from_json("value", "map<string,string>")
    got = lines.where(F.trim("value") != "").withColumn("m", m).where("m IS NOT NULL AND map_contains_key(m, 'event_type')")
    return got.select(F.col("m")["event_id"].alias("event_id"), instant(F.col("m")["timestamp"]).alias("ts"), F.col("m")["event_type"].alias("event_type"), F.col("m")["paper_id"].alias("paper_id"), F.map_filter("m", lambda k, v: ~k.isin(*EVENT_NAMES)).alias("extras"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.readStream.schema("value string").text(path))


def read_claim_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, kind, rationale from a snapshot document; none where it has no list of edges."""
    edge = "struct<source:string,target:string,sourceClaimID:string,targetClaimID:string,source_claim_id:string,target_claim_id:string,kind:string,rationale:string>"
    doc = spark.read.schema(f"edges array<{edge}>").json(path, multiLine=True)
    e = doc.select(F.explode("edges").alias("e"))
    return e.select(F.coalesce("e.sourceClaimID", "e.source_claim_id", "e.source").alias("src"), F.coalesce("e.targetClaimID", "e.target_claim_id", "e.target").alias("dst"), "e.kind", "e.rationale").where("src IS NOT NULL AND dst IS NOT NULL")


GALAXY = "version string, clusters array<struct<id:int,name:string,memberPaperIDs:array<string>,layoutPosition:struct<x:double,y:double>,subclusters:array<struct<id:int,name:string,memberPaperIDs:array<string>,layoutPosition:struct<x:double,y:double>>>>>"


def read_galaxy(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of the snapshot of a version, else of the newest file; keyed by (level, cluster_id)."""
    raw = spark.read.schema(GALAXY).json(path, multiLine=True).select("*", "_metadata.file_modification_time", "_metadata.file_path")
    order = [F.desc(F.col("version") == version)] if version else []
    one = raw.orderBy(*order, F.desc("file_modification_time"), F.desc("file_path")).limit(1)
    mega = one.select(F.explode("clusters").alias("c"))
    top = mega.select(F.lit(0).alias("level"), F.col("c.id").alias("cluster_id"), F.lit(None).cast("int").alias("parent_id"), F.col("c.name").alias("name"), F.col("c.layoutPosition.x").alias("x"), F.col("c.layoutPosition.y").alias("y"), F.col("c.memberPaperIDs").alias("m"))
    sub = mega.select(F.col("c.id").alias("parent_id"), F.explode("c.subclusters").alias("c")).select(F.lit(1).alias("level"), F.col("c.id").alias("cluster_id"), "parent_id", F.col("c.name").alias("name"), F.col("c.layoutPosition.x").alias("x"), F.col("c.layoutPosition.y").alias("y"), F.col("c.memberPaperIDs").alias("m"))
    both = top.unionByName(sub)
    return both.where("x IS NOT NULL").drop("m"), both.select("level", "cluster_id", F.explode("m").alias("paper_id"))


def attach_clusters(papers: DataFrame, members: DataFrame, level: int = 0) -> DataFrame:
    """papers with the cluster of their membership, their own where they have none."""
    m = members.where(F.col("level") == level).select("paper_id", F.col("cluster_id").alias("_c"))
    return papers.join(m, "paper_id", "left").withColumn("cluster_id", F.coalesce("_c", "cluster_id")).drop("_c")


def newest_per(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key, the newest; ties to the last of all columns."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def valid_years(papers: DataFrame, last_year: int) -> DataFrame:
    return papers.withColumn("year", F.when(F.col("year").between(1900, last_year), F.col("year")))


def read_vectors(spark: SparkSession, path: str, id_col: str = "paper_id") -> DataFrame:
    """A Parquet table of ids and float vectors; any other type of the vector column is an error."""
    df = spark.read.parquet(path)
    kind = df.schema["embedding"].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        raise TypeError(f"embedding must be an array of float or double, not {kind.simpleString()}")
    return df.select(F.col(id_col).alias("paper_id"), "embedding")


def load_papers(papers: DataFrame, last_year: int, dim: int) -> DataFrame:
    """Papers as an application shows them: the newest of each file, plausible years, vectors fitted to dim, clean takeaways."""
    one = valid_years(newest_per(papers, "file_path", "mtime"), last_year)
    return one.withColumns({"embedding": V.fit_dimension(F.col("embedding"), dim), "takeaways": TX.clean_takeaways(F.coalesce("takeaways", F.array().cast("array<string>")))})


def list_files(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    """path, mtime of the files of a kind below several roots, each once; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(roots)
    return files.select("path", F.col("modificationTime").alias("mtime")).distinct()


def read_newest_chunks(spark: SparkSession, roots: list[str], dim: int, glob: str = "*.json") -> DataFrame:
    """The chunks of the newest index file below several roots, vectors fitted to dim."""
    newest = list_files(spark, roots, glob).orderBy(F.desc("mtime"), F.desc("path")).first()
    return spark.createDataFrame([], "chunk_id string, paper_id string, text string, embedding array<double>, ord int, page_hint int") if newest is None else read_chunks(spark, newest["path"], dim)


def apply_galaxy(papers: DataFrame, clusters: DataFrame, members: DataFrame, pins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers with their subtopic, subtopics in order of id, pins of clusters there are)."""
    sub = members.where("level = 1").groupBy("paper_id").agg(F.min("cluster_id").alias("subtopic_id"))
    return papers.join(sub, "paper_id", "left"), clusters.where("level = 1").orderBy("cluster_id"), pins.join(clusters.select("cluster_id").distinct(), "cluster_id", "left_semi")


def read_strategies(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per strategy, of each id the newest file; the last updated first."""
    raw = spark.read.schema(STRATEGY).json(path, multiLine=True).where("strategy_id IS NOT NULL").select("*", F.col("_metadata.file_modification_time").alias("modified"))
    return newest_per(raw, "strategy_id", "modified").drop("modified").orderBy(F.desc_nulls_last("updated_at"), "strategy_id")


CLUSTER = "id:int,name:string,centroid:array<float>,memberPaperIDs:array<string>"


def read_clusters(spark: SparkSession, path: str, version: str, wanted: int = 10) -> DataFrame:
    """cluster_id, name, centroid (unit), members of the snapshot of a version whose k is closest to the wanted one.

    A document is {version, k, clusters} or, in the older form, a bare array of clusters: its
    version is "legacy" and its k their number. Of equally close ones the lesser k, then the path.
    """
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    now = F.from_json("value", f"struct<version:string,k:int,clusters:array<struct<{CLUSTER}>>>")
    old = F.from_json("value", f"array<struct<{CLUSTER}>>")
    bare = F.ltrim("value").startswith("[")
    each = text.select("file", F.when(bare, F.struct(F.lit("legacy").alias("version"), F.size(old).alias("k"), old.alias("clusters"))).otherwise(now).alias("s")).select("file", "s.*")
    one = each.where((F.col("version") == version) & F.col("k").isNotNull()).orderBy(F.abs(F.col("k") - wanted), "k", "file").limit(1)
    return one.select(F.explode("clusters").alias("c")).select(F.col("c.id").alias("cluster_id"), "c.name", V.unit(F.col("c.centroid")).alias("centroid"), F.col("c.memberPaperIDs").alias("members"))
