"""Writers: the export tables, appended events, upserts, the summary document, the knowledge graph."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T


def export(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each table that has columns as Parquet with zstd; returns the names written."""
    done = []
    for name, df in tables.items():
        if df.columns:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
            done.append(name)
    return done


def export_tables(papers: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """papers, paper_embeddings, paper_chunks, claims (flat) and methods (as JSON)."""
    nested = [c for c, t in papers.dtypes if t.startswith("struct")]
    c = papers.select("paper_id", F.explode_outer("claims").alias("c")).where("c IS NOT NULL")
    return {
        "papers": papers.drop("embedding", "note_embedding", "claims", "method_pipeline", *nested),
        "paper_embeddings": papers.select("paper_id", "embedding"),
        "paper_chunks": chunks,
        "claims": c.select("paper_id", "c.id", "c.statement", "c.assumptions", F.col("c.evaluation.dataset").alias("dataset"), F.col("c.evaluation.period").alias("period"), F.col("c.evaluation.metrics").alias("metrics"), "c.year", "c.strength"),
        "methods": papers.where("method_pipeline IS NOT NULL").select("paper_id", F.to_json("method_pipeline").alias("pipeline")),
    }


def exploded_tags(papers: DataFrame, column: str) -> DataFrame:
    """paper_id, value of an array column; blanks are dropped, repetitions stay."""
    return papers.select("paper_id", F.explode(column).alias("value")).select("paper_id", F.trim("value").alias("value")).where("value <> ''")


def append_events(events: DataFrame, folder: str) -> None:
    """JSON lines: the event's fields and its extras side by side."""
    base = F.map_from_arrays(F.array(F.lit("timestamp"), F.lit("event_type"), F.lit("paper_id")), F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "event_type", F.coalesce("paper_id", F.lit(""))))
    line = F.to_json(F.map_concat(F.map_filter(base, lambda k, v: v != ""), F.coalesce("extras", F.create_map().cast("map<string,string>"))))
    events.select(line.alias("value")).write.mode("append").text(folder)


CAPS = {"novelty": 50, "centrality": 200, "factor_loadings": 500, "topic_metrics": 400, "influence": 200, "coverage": 600, "blindspots": 18, "questions": 80, "duplicate_pairs": 120, "issues": 200}


def summary(sections: dict[str, tuple[DataFrame, list]]) -> DataFrame:
    """One row, one JSON document: each section's first rows in its order; sections are small by their caps."""
    parts, spark = [], next(iter(sections.values()))[0].sparkSession
    for name, (df, order) in sections.items():
        n = CAPS.get(name, 1000)
        top = df.orderBy(*order).limit(n)
        parts.append(top.agg(F.lit(name).alias("name"), F.to_json(F.collect_list(F.struct(*top.columns))).alias("body")))
    body = parts[0]
    for p in parts[1:]:
        body = body.unionByName(p)
    joined = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "body"))), lambda s: F.concat(F.lit('"'), s["name"], F.lit('":'), s["body"])), ","), F.lit("}"))
    return body.agg(joined.alias("document"))


def knowledge_graph(papers: DataFrame, claims: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): papers, clusters, tags and claims as nodes of their kinds, each id once."""
    node = lambda d, i, kind, label: d.select(F.concat(F.lit(f"{kind}:"), i.cast("string")).alias("id"), F.lit(kind).alias("kind"), label.cast("string").alias("label"))
    tags = papers.select("paper_id", F.explode("tags").alias("tag"))
    nodes = node(papers, F.col("paper_id"), "paper", F.col("title")).unionByName(node(papers.where("cluster_id IS NOT NULL"), F.col("cluster_id"), "cluster", F.col("cluster_id"))).unionByName(node(tags, F.col("tag"), "tag", F.col("tag"))).unionByName(node(claims, F.col("claim_id"), "claim", F.col("statement")))
    edge = lambda d, a, b, kind: d.select(a.alias("src"), b.alias("dst"), kind.alias("kind"))
    of = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))
    links = edge(papers.where("cluster_id IS NOT NULL"), of("paper", "paper_id"), of("cluster", "cluster_id"), F.lit("belongsTo")).unionByName(edge(tags, of("paper", "paper_id"), of("tag", "tag"), F.lit("tagged"))).unionByName(edge(claims, of("paper", "paper_id"), of("claim", "claim_id"), F.lit("claims"))).unionByName(edge(edges, of("claim", "src"), of("claim", "dst"), F.col("kind")))
    return nodes.groupBy("id").agg(F.first("kind").alias("kind"), F.min("label").alias("label")), links.distinct()


REF = "array<struct<id:string,symbol:string,path:string>>"
STRATEGY = f"""strategy_id string, title string, updated_at timestamp, archived boolean, idea string, paper_ids array<string>, features array<struct<id:string,name:string,code_refs:{REF}>>,
model struct<id:string,name:string,feature_ids:array<string>,code_refs:{REF}>, trade_plan struct<id:string,horizon:string,code_refs:{REF}>, decisions array<struct<id:string,kind:string,model_id:string,feature_ids:array<string>>>,
outcomes array<struct<id:string,kind:string,sharpe:double>>, code_refs {REF}"""


def strategy_graph(papers: DataFrame, strategies: DataFrame, claims: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of nine kinds each: papers, strategies with their ideas, features, models, trades, decisions, outcomes and code.

    papers: paper_id, title; strategies: see STRATEGY; claims: claim_id, paper_id; relations: src, dst,
    kind of claims, which relate their papers. A node id occurs once, with the least label.
    """
    text = lambda c: c.cast("string")
    of = lambda kind, c: F.concat(F.lit(f"{kind}:"), text(c))
    nodes, edges = [], []

    def node(rows, kind, key, label):
        nodes.append(rows.select(of(kind, key).alias("id"), F.lit(kind).alias("kind"), text(label).alias("label")))

    def edge(rows, source, target, kind, note=None):
        edges.append(rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if note is None else note).alias("note")))

    def code(rows, owner, refs):
        each = rows.select(owner.alias("owner"), F.explode(refs).alias("r"))
        node(each, "code", F.col("r.id"), F.coalesce("r.symbol", F.regexp_extract("r.path", "[^/]+$", 0)))
        edge(each, F.col("owner"), of("code", F.col("r.id")), "implementedInCode")

    node(papers, "paper", F.col("paper_id"), F.col("title"))
    home = lambda n: claims.select(F.col("claim_id").alias(n), F.col("paper_id").alias(f"{n}_paper"))
    related = relations.join(home("src"), "src").join(home("dst"), "dst").where("src_paper <> dst_paper")
    edge(related, of("paper", F.col("src_paper")), of("paper", F.col("dst_paper")), "related", F.col("kind"))
    s, me = strategies, of("strategy", F.col("strategy_id"))
    node(s, "strategy", F.col("strategy_id"), F.col("title"))
    edge(s.select("strategy_id", F.explode("paper_ids").alias("p")), me, of("paper", F.col("p")), "referencesPaper")
    ideas = s.where("trim(idea) <> ''")
    node(ideas, "idea", F.col("strategy_id"), T.first_sentence(F.col("idea")))
    edge(ideas, me, of("idea", F.col("strategy_id")), "defines")
    features = s.select("strategy_id", F.explode("features").alias("f"))
    node(features, "feature", F.col("f.id"), F.col("f.name"))
    edge(features, me, of("feature", F.col("f.id")), "defines")
    code(features, of("feature", F.col("f.id")), F.col("f.code_refs"))
    models = s.where("model IS NOT NULL")
    node(models, "model", F.col("model.id"), F.col("model.name"))
    edge(models, me, of("model", F.col("model.id")), "defines")
    edge(models.select("model.id", F.explode("model.feature_ids").alias("f")), of("model", F.col("id")), of("feature", F.col("f")), "usesFeature")
    code(models, of("model", F.col("model.id")), F.col("model.code_refs"))
    trades = s.where("trade_plan IS NOT NULL")
    named = F.trim(F.coalesce("trade_plan.horizon", F.lit(""))) != ""
    node(trades, "trade", F.col("trade_plan.id"), F.when(named, F.concat(F.lit("Trade ("), "trade_plan.horizon", F.lit(")"))).otherwise("Trade"))
    edge(trades, me, of("trade", F.col("trade_plan.id")), "defines")
    edge(trades.select("trade_plan.id", F.explode("outcomes").alias("o")), of("trade", F.col("id")), of("outcome", F.col("o.id")), "leadsTo")
    code(trades, of("trade", F.col("trade_plan.id")), F.col("trade_plan.code_refs"))
    decisions = s.select("strategy_id", F.explode("decisions").alias("d"))
    node(decisions, "decision", F.col("d.id"), F.col("d.kind"))
    edge(decisions, me, of("decision", F.col("d.id")), "makesDecision")
    edge(decisions.where("d.model_id IS NOT NULL"), of("decision", F.col("d.id")), of("model", F.col("d.model_id")), "usesModel")
    edge(decisions.select("d.id", F.explode("d.feature_ids").alias("f")), of("decision", F.col("id")), of("feature", F.col("f")), "usesFeature")
    outcomes = s.select("strategy_id", F.explode("outcomes").alias("o"))
    node(outcomes, "outcome", F.col("o.id"), F.col("o.kind"))
    edge(outcomes, me, of("outcome", F.col("o.id")), "leadsTo")
    code(s, me, F.col("code_refs"))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return union(nodes).groupBy("id").agg(F.min("kind").alias("kind"), F.min("label").alias("label")), union(edges)


def neighbour_json(neighbours: DataFrame, folder: str) -> None:
    """One JSON line for each paper: its neighbours with their scores, best first."""
    near = F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst", "score"))), lambda s: F.struct(s["dst"].alias("paper_id"), s["score"].alias("score")))
    neighbours.groupBy(F.col("src").alias("paper_id")).agg(near.alias("neighbors")).write.mode("overwrite").json(folder)


def save(df: DataFrame, folder: str, form: str = "json") -> None:
    """All or nothing: written beside the folder and put in its place when it is complete."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old, place = (hadoop.Path(folder.rstrip("/") + end) for end in (f".{uuid.uuid4().hex}.new", f".{uuid.uuid4().hex}.old", ""))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.format(form).save(new.toString())
    had = fs.exists(place)
    if had:
        fs.rename(place, old)
    fs.rename(new, place)
    if had:
        fs.delete(old, True)
