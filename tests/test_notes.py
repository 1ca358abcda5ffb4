"""Loaders, writers and bullets on small tables by hand."""
import json
import os
import time

from skein.operators import notes
from skein.sources import readers, sinks, storage


def put(folder, name, doc, at=None):
    os.makedirs(folder, exist_ok=True)
    path = folder / name
    path.write_text(json.dumps(doc))
    if at:
        os.utime(path, (at, at))


def test_bullets_shrink_then_drop_from_the_middle():
    chunks = [f"{i} " + "word " * 200 for i in range(10)]
    full = notes._bullets(chunks, 100_000)
    assert full.count("\n") == 9 and all(len(line) <= 480 + 12 for line in full.split("\n"))
    some = notes._bullets(chunks, 1_000)
    assert len(some) <= 1_000 and some.count("\n") == 9
    few = notes._bullets(chunks, 200)
    assert len(few) <= 200 and [line.split(":")[0] for line in few.split("\n")] == ["Chunk 1", "Chunk 10"]
    assert len(notes._bullets(chunks, 30)) <= 30
    assert notes._bullets([], 100) == "" and notes._bullets([None, " a  b "], 100) == "Chunk 1: \nChunk 2: a b"


def test_the_newest_file_of_a_strategy_counts(spark, tmp_path):
    now = time.time()
    put(tmp_path, "a.json", {"strategy_id": "s1", "title": "old", "updated_at": "2024-01-01T00:00:00Z"}, now - 100)
    put(tmp_path, "b.json", {"strategy_id": "s1", "title": "new", "updated_at": "2024-01-02T00:00:00Z"}, now)
    put(tmp_path, "c.json", {"strategy_id": "s2", "title": "other", "updated_at": "2024-01-03T00:00:00Z"}, now - 50)
    put(tmp_path, "d.json", {"title": "no id"}, now)
    assert [(r["strategy_id"], r["title"]) for r in readers.read_strategies(spark, str(tmp_path)).collect()] == [("s2", "other"), ("s1", "new")]


def test_the_snapshot_closest_to_ten_clusters_is_taken(spark, tmp_path):
    cluster = lambda i: {"id": i, "name": f"c{i}", "centroid": [3.0, 4.0], "memberPaperIDs": ["p"]}
    put(tmp_path, "a.json", {"version": "v", "k": 4, "clusters": [cluster(0)]})
    put(tmp_path, "b.json", {"version": "v", "k": 12, "clusters": [cluster(1), cluster(2)]})
    put(tmp_path, "c.json", {"version": "w", "k": 10, "clusters": [cluster(3)]})
    put(tmp_path, "d.json", [cluster(4), cluster(5), cluster(6)])
    got = readers.read_clusters(spark, str(tmp_path), "v").collect()
    assert sorted(r["cluster_id"] for r in got) == [1, 2] and all(abs(a - b) < 1e-12 for a, b in zip(got[0]["centroid"], [0.6, 0.8]))
    assert sorted(r["cluster_id"] for r in readers.read_clusters(spark, str(tmp_path), "legacy").collect()) == [4, 5, 6]
    assert readers.read_clusters(spark, str(tmp_path), "none").count() == 0


def test_the_newest_index_of_several_roots_is_read(spark, tmp_path):
    now = time.time()
    chunk = lambda i: {"id": i, "paperID": "p", "text": "t", "embedding": [1.0], "order": 0}
    put(tmp_path / "one", "chunks.json", [chunk("old")], now - 100)
    put(tmp_path / "two", "chunks.json", [chunk("a"), chunk("b")], now)
    put(tmp_path / "two", "other.txt", [chunk("no")], now + 10)
    roots = [str(tmp_path / "one"), str(tmp_path / "two")]
    assert readers.list_files(spark, roots, "*.json").count() == 2
    got = readers.read_newest_chunks(spark, roots, 3).collect()
    assert sorted(r["chunk_id"] for r in got) == ["a", "b"] and got[0]["embedding"] == [1.0, 0.0, 0.0]
    assert readers.read_newest_chunks(spark, roots, 3, "*.none").count() == 0


def test_pins_and_subtopics_are_applied(spark):
    papers = spark.createDataFrame([("p",), ("q",)], "paper_id string")
    clusters = spark.createDataFrame([(0, 1), (1, 9), (1, 3)], "level int, cluster_id int")
    members = spark.createDataFrame([(0, 1, "p"), (1, 9, "p")], "level int, cluster_id int, paper_id string")
    pins = spark.createDataFrame([(1,), (77,)], "cluster_id int")
    p, sub, kept = readers.apply_galaxy(papers, clusters, members, pins)
    assert {r["paper_id"]: r["subtopic_id"] for r in p.collect()} == {"p": 9, "q": None}
    assert [r["cluster_id"] for r in sub.collect()] == [3, 9] and [r["cluster_id"] for r in kept.collect()] == [1]


def test_a_saved_table_is_replaced_whole(spark, tmp_path):
    folder = f"{tmp_path}/t"
    sinks.save(spark.range(5), folder)
    sinks.save(spark.range(3), folder)
    assert spark.read.schema("id long").json(folder).count() == 3
    assert os.listdir(tmp_path) == ["t"]


def test_neighbours_are_written_best_first(spark, tmp_path):
    n = spark.createDataFrame([(1, 3, 2, 0.5), (1, 2, 1, 0.9)], "src long, dst long, rank int, score double")
    sinks.neighbour_json(n, f"{tmp_path}/n")
    (r,) = spark.read.json(f"{tmp_path}/n").collect()
    assert [x["paper_id"] for x in r["neighbors"]] == [2, 3]


def test_a_table_is_built_once_for_its_key(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(4)

    assert storage.cached(spark, str(tmp_path), "v/1", build).count() == storage.cached(spark, str(tmp_path), "v/1", build).count() == 4
    assert len(calls) == 1 and storage.cached(spark, str(tmp_path), "v/2", build).count() == 4 and len(calls) == 2
