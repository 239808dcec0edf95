import json

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import embedding
from corpusloom.sources import readers, writers
from corpusloom.streaming import ingest


def test_read_corpus(spark, tmp_path):
    for name, text in (("laws/b.md", "B"), ("laws/a ə.md", "A"), ("aml/c.md", "C"), ("laws/skip.txt", "no")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text, encoding="utf-8")
    files = readers.read_corpus(spark, str(tmp_path))
    got = [(r["category"], r["source_relative_path"], r["text"]) for r in readers.discover(files).collect()]
    assert got == [("aml", "aml/c.md", "C"), ("laws", "laws/a ə.md", "A"), ("laws", "laws/b.md", "B")]
    assert [r["text"] for r in readers.discover(files, document="b").collect()] == ["B"]
    assert readers.discover(files, limit=2).count() == 2


def test_chunk_policies(spark, tmp_path):
    rows = [{"chunk_id": "a", "text": "1"}, {"chunk_id": "a", "text": "2"}, {"chunk_id": "b", "content": "3"}]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    first = {r["chunk_id"]: r["text"] for r in readers.read_chunks(spark, str(tmp_path), "first_wins").collect()}
    last = {r["chunk_id"]: r["text"] for r in readers.read_chunks(spark, str(tmp_path), "last_wins").collect()}
    assert first == {"a": "1", "b": "3"} and last == {"a": "2", "b": "3"}
    with pytest.raises(Exception, match="duplicate chunk_id a"):
        readers.read_chunks(spark, str(tmp_path), "strict").collect()
    (tmp_path / "y.jsonl").write_text("{broken")
    assert readers.read_chunks(spark, str(tmp_path), "skip_bad").count() == 3
    with pytest.raises(Exception, match="bad JSON"):
        readers.read_chunks(spark, str(tmp_path), "first_wins").collect()


def test_publish_keeps_the_old_version_on_failure(spark, tmp_path):
    good, bad = spark.range(3), spark.range(5)
    check = [lambda t: t.filter("id > 3")]
    writers.publish_version(good, str(tmp_path), "1", "published", check)
    with pytest.raises(writers.PublishError):
        writers.publish_version(bad, str(tmp_path), "2", "published", check)
    with pytest.raises(writers.PublishError):
        writers.publish_version(good, str(tmp_path), "1", "published", check)
    assert spark.table("published").count() == 3


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")

    def send(rows):
        df = spark.createDataFrame([(d, "laws", f"laws/{d}.md", t) for d, t in rows], ingest.INBOX_SCHEMA)
        df.coalesce(1).write.mode("append").json(inbox)

    send([("a", "Maddə 1. Bir\n1.1. Mətn"), ("b", "Maddə 2. İki")])
    ingest.run_once(spark, inbox, root)
    before = sorted(r["chunk_id"] for r in ingest.current(spark, root, "chunks").collect())
    send([("a", "Maddə 1. Bir\n1.1. Mətn"), ("c", "Maddə 3. Üç")])
    ingest.run_once(spark, inbox, root)
    ingest.run_once(spark, inbox, root)
    after = ingest.current(spark, root, "chunks")
    whole, vectors = ingest.process(
        spark.createDataFrame(
            [("a", "laws", "p", "Maddə 1. Bir\n1.1. Mətn"), ("b", "laws", "p", "Maddə 2. İki"), ("c", "laws", "p", "Maddə 3. Üç")], ingest.INBOX_SCHEMA
        )
    )
    assert sorted(r["chunk_id"] for r in after.collect()) == sorted(r["chunk_id"] for r in vectors.collect())
    assert set(before) <= {r["chunk_id"] for r in after.collect()} and whole.count() == 3
    assert after.filter(F.size("dense") != 64).count() == 0


def test_a_text_that_comes_back_is_current_again(spark, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    hashes = []
    for text in ("A", "B", "A"):
        spark.createDataFrame([("a", "laws", "p", text)], ingest.INBOX_SCHEMA).coalesce(1).write.mode("append").json(inbox)
        ingest.run_once(spark, inbox, root)
        hashes += [r["content_hash"] for r in ingest.current(spark, root, "documents").collect()]
    assert len(hashes) == 3 and hashes[0] == hashes[2] != hashes[1]


def test_strict_chunks_fail_without_the_id_column(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"chunk_id": "a", "text": "1"}\n{"chunk_id": "a", "text": "2"}')
    with pytest.raises(Exception, match="duplicate chunk_id a"):
        readers.read_chunks(spark, str(tmp_path), "strict").select("text").collect()


def test_vectors_written_twice_are_there_once_and_in_the_manifest_s_shard(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("chunk_id"), F.lit("m").alias("model_id"), F.lit("v").alias("corpus_version"), F.rand(1).alias("x"))
    for _ in range(2):
        writers.write_embeddings(rows, str(tmp_path / "e"), shards=4)
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.count() == 20
    counted = {r["shard"]: r["rows"] for r in writers.shard_hashes(rows, ["chunk_id"], shards=4).collect()}
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == counted


def test_forced_version_replaces_the_old_one(spark, tmp_path):
    writers.publish_version(spark.range(3), str(tmp_path), "1", "forced")
    writers.publish_version(spark.range(5), str(tmp_path), "1", "forced", force=True)
    assert spark.table("forced").count() == 5
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("_")] == ["_current"]


def test_the_pointer_is_seen_by_other_sessions_and_has_one_winner(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(writers.PublishError):
        writers.read_current(spark, root)
    writers.publish_version(spark.range(3), root, "1", "mine")
    other = spark.newSession()
    assert writers.read_current(other, root).count() == 3
    with pytest.raises(writers.PublishError):
        writers.publish_version(spark.range(9), root, "2", "mine", [lambda t: t.filter("id > 3")])
    assert writers.current_version(other, root) == (1, "1")

    def overtaken(table):  # while this build is checked, another session publishes
        writers.publish_version(other.range(5), root, "other", "theirs")
        return table.filter("false")

    with pytest.raises(writers.PublishError, match="meanwhile"):
        writers.publish_version(spark.range(7), root, "3", "mine", [overtaken])
    assert writers.current_version(spark, root) == (2, "other") and writers.read_current(spark, root).count() == 5


def test_embedding_run_resumes_with_the_missing_shards(spark, tmp_path):
    root = str(tmp_path / "v")
    chunks = spark.createDataFrame([(f"c{i}", f"text number {i}") for i in range(80)], "chunk_id string, embedding_text string")
    part = embedding.embed_corpus(chunks, root, shards=8, wave=2, stop_after=2, run="killed")
    shards = {r["shard"] for r in part.select("shard").distinct().collect()}
    assert len(shards) == 4
    whole = embedding.embed_corpus(chunks, root, shards=8, wave=2, run="resumed")
    got = {r["chunk_id"]: (r["run"], r["shard"]) for r in whole.collect()}
    assert len(got) == 80 and all((run == "killed") == (shard in shards) for run, shard in got.values())
    again = embedding.embed_corpus(chunks, root, shards=8, run="again")
    assert {r["run"] for r in again.select("run").distinct().collect()} == {"killed", "resumed"}


def test_stale_shards_are_refused_or_redone(spark, tmp_path):
    root = str(tmp_path / "v")
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "chunk_id long, embedding_text string")
    embedding.embed_corpus(chunks, root, shards=4, run="1")
    changed = chunks.filter("chunk_id <> 7").withColumn("embedding_text", F.when(F.col("chunk_id") == 3, "new").otherwise(F.col("embedding_text")))
    with pytest.raises(embedding.StaleShards):
        embedding.embed_corpus(changed, root, shards=4, run="2")
    got = {r["chunk_id"]: r["run"] for r in embedding.embed_corpus(changed, root, shards=4, run="2", redo_stale=True).collect()}
    assert got == {i: "2" if i == 3 else "1" for i in range(40) if i != 7}
    with pytest.raises(embedding.StaleShards):  # another revision makes every shard stale
        embedding.embed_corpus(changed, root, revision="2", shards=4)


def test_a_build_is_written_whole(spark, tmp_path):
    """documents, references, reports and the manifest are written too; parents come from the stored children."""
    from corpusloom.plans import corpus
    from corpusloom.session import persist_to_shared

    words = " ".join(f"söz{i}" for i in range(60))
    long = "\n".join(f"{a}. Bölmə\n" + "\n".join(f"{a}.{b}. Cümlə {words}. Bax Maddə {b}" for b in range(1, 9)) for a in range(1, 4))
    table = "# Cədvəl\n<!-- PAGE: 2 -->\n| ad | qeyd |\n| --- | --- |\n| a | b |\nMaddə 1. Ad\n1.1. Bənd\nƏlavə 1. Son\n1. Mətn"
    rows = [("laws", "laws/a.md", long), ("laws", "laws/b.md", table), ("other", "other/c.md", table), ("other", "other/empty.md", "  ")]
    docs = persist_to_shared(corpus.describe_documents(spark.createDataFrame(rows, "category string, source_relative_path string, text string")), "described")
    root = f"{tmp_path}/build"
    stored = {}
    out = corpus.write_corpus(docs, root, stage=lambda df, name: stored.setdefault(name, persist_to_shared(df, name)))
    # chunks are not stored beside the build, nor titles of nodes again as headings and paths
    assert set(stored) == {"facts", "nodes"} and not {"path", "heading"} & set(stored["nodes"].columns)
    assert {p.name for p in (tmp_path / "build").iterdir()} == set(out) == {"documents", "children", "parents", "references", "approved", "quality", "manifest"}
    want = corpus.build_corpus(docs)
    for name, df in (("children", want.children), ("parents", want.parents), ("references", want.references)):
        got = spark.read.parquet(f"{root}/{name}").select(*df.columns)
        assert df.count() > 0 and sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    told = out["manifest"].first()
    assert (told["discovered"], told["duplicate_documents"]) == (4, 1) and told["parent_count"] == want.parents.count()
    assert sum(r["is_canonical_document"] for r in out["documents"].collect()) == 3
    reports = {r["document_id"]: r for r in out["quality"].collect()}
    assert len(reports) == 4 and sorted(r["child_count"] for r in reports.values())[0] == 0
