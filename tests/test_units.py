"""Goldens of chunker, hashes, hybrid parts, readers, publication and streams."""

import dataclasses
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from inkwell import engine
from inkwell.functions import text as T
from inkwell.operators import chunking, generation, hybrid, maintenance, policy, remote, text_search
from inkwell.sources import notes as N
from inkwell.sources import publish, vectors_file
from inkwell.streaming import events as E


def test_chunker_goldens():
    assert chunking.chunks_of("") == chunking.chunks_of(" \n\t ") == []
    assert chunking.chunks_of("mafarrrico\n\num dó li tá") == ["mafarrrico um dó li tá"]
    assert len(chunking.chunks_of("searchable " * 80, 100, 20)) > 1


def test_short_note_is_found_with_and_without_accents(spark):
    notes = spark.createDataFrame([(1, "Short.md", "Short", "mafarrrico\n\num dó li tá")], "doc_id long, path string, basename string, text string")
    for query in ("um dó", "um do"):
        found = text_search.search_text(notes, chunking.chunk_notes(notes), query).collect()
        assert [(r.path, r.origin) for r in found] == [("Short.md", "conteudo")]
    assert text_search.search_text(notes, chunking.chunk_notes(notes), " ").count() == 0


def test_heading_and_tag_bonuses(spark):
    rows = [("h", "# plano geral\ntexto"), ("t", "corpo #plano aqui"), ("k", "tags: plano\ncorpo"), ("n", "um plano"), ("far", "# x " + "y " * 100 + "plano")]
    found = {r.path: r.score for r in text_search.score_chunks(spark.createDataFrame(rows, "path string, text string"), "plano").collect()}
    base = found["n"]
    assert found == {"h": base + 22, "t": base + 20, "k": base + 20, "n": base, "far": base}


def test_hash_is_the_31_polynomial(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,), ("😀" * 5,), ("x" * 70000,)], "t string")

    def slow(t):
        h = 0
        units = t.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h * 31 + units[i] + 256 * units[i + 1]) % 2**32
        return format(abs(h - 2**32 if h >= 2**31 else h), "x")

    assert [r.h for r in df.select(T.content_hash("t").alias("h")).collect()] == [slow("abc"), slow(""), None, slow("😀" * 5), slow("x" * 70000)]


def test_hybrid_weights_and_query():
    assert hybrid.weights_of(None, -1) == (0.7, 0.3) and hybrid.weights_of(0, 0) == (0.7, 0.3) and hybrid.weights_of(1, 3) == (0.25, 0.75)
    assert hybrid.prepared_query("um dó") == "um dó" and hybrid.prepared_query("para a Casa") == "casa"


def test_coalescing_goldens(spark):
    rows = [(1, "create", "a", None), (2, "modify", "a", None), (3, "modify", "b", None), (4, "delete", "b", None), (5, "rename", "d", "c"), (6, "rename", "e", "d"), (7, "rename", "g", "f"), (8, "delete", "g", None)]
    found = {r.key: (r.type, r.path, r.old_path) for r in maintenance.coalesce_events(spark.createDataFrame(rows, "seq long, type string, path string, old_path string")).collect()}
    assert found == {"a": ("create", "a", None), "b": ("delete", "b", None), "c": ("rename", "d", "c"), "d": ("rename", "e", "d"), "f": ("rename", "g", "f"), "g": ("delete", "g", None)}


def test_readers(spark, tmp_path):
    good = {"chunkId": "a::0", "path": "a", "chunkIndex": 0, "text": "t", "textHash": "h", "createdAt": "x"}
    (tmp_path / "chunks.jsonl").write_text("\n".join([json.dumps(good), "not-json", "", json.dumps(good | {"chunkId": "a::1"})]))
    assert N.read_chunks(spark, str(tmp_path / "chunks.jsonl")).count() == 2
    with pytest.raises(Exception):
        N.read_chunks(spark, str(tmp_path / "chunks.jsonl"), strict=True).collect()
    (tmp_path / "e.jsonl").write_text('{"chunkId": "a", "dimensions": 3}\nbroken\n{"path": "x"}\n')
    records, bad = N.read_embeddings(spark, str(tmp_path / "e.jsonl"))
    assert (records.count(), bad.count()) == (1, 2)
    (tmp_path / "notes" / "sub").mkdir(parents=True)
    (tmp_path / "notes" / "sub" / "x.md").write_text("olá")
    (tmp_path / "notes" / "y.txt").write_text("no")
    assert [(r.basename, r.text, r.size) for r in N.scan_files(spark, str(tmp_path / "notes")).collect()] == [("x", "olá", 4)]


def test_publish_and_sweep(spark, tmp_path):
    root = str(tmp_path / "pub")
    assert publish.current(spark, root) is None and publish.sweep(spark, root) == []
    first = publish.publish(spark, root, {"index": spark.range(3), "more": spark.range(2)}, manifest={"text": {"notes": 3}})
    start = publish.pointer(spark, root)
    second = publish.publish(spark, root, {"index": spark.range(5)}, {"index": "id"}, {"embeddings": {"model": "m"}}, since=start)
    now = publish.pointer(spark, root)
    assert now.version == second and now.manifest["text"] == {"notes": 3} and now.manifest["embeddings"] == {"model": "m"}
    assert publish.read(spark, root, "index").count() == 5 and publish.read(spark, root, "more").count() == 2
    with pytest.raises(publish.Conflict):
        publish.publish(spark, root, {"index": spark.range(9)}, since=start)
    third = publish.publish(spark, root, {"more": spark.range(1)})
    assert publish.sweep(spark, root) == []  # too young
    assert publish.sweep(spark, root, 0) == [first] and publish.read(spark, root, "index").count() == 5 and third
    publish.activate(spark, root, {"seen": "index"})
    assert spark.table("seen").count() == 5


def publish_records(spark, root, *args):
    with publish.writer(spark, root, "records") as own:
        return publish.publish_records(own, *args)


def test_a_writer_is_one_operation(spark, tmp_path):
    root = str(tmp_path / "pub")
    with pytest.raises(PermissionError), publish.writer(spark, root, "rebuild", publish.Role(False)):
        pass
    with publish.writer(spark, root, "rebuild") as own:
        with pytest.raises(publish.Busy) as e, publish.writer(spark, root, "automatic-batch"):
            pass
        assert e.value.kind == "rebuild" and own.since is None
        first = own.publish({"a": spark.range(3), "b": spark.range(2)})
        assert first.manifest["rows"] == {"a": 3, "b": 2}
        assert own.publish({"a": spark.range(4)}, drop=["b"]) == own.since and own.since.tables == ("a",) and not own.has("b")
        publish.publish(spark, root, {"c": spark.range(1)})  # someone else, between two publications of one operation
        assert own.read("a").count() == 4 and not own.has("c")
        with pytest.raises(publish.Conflict):
            own.publish({"a": spark.range(5)})
    assert publish.read(spark, root, "a").count() == 4
    with pytest.raises(RuntimeError), publish.writer(spark, root, "x"):
        raise RuntimeError
    with publish.writer(spark, root, "y"):
        pass


def test_records_are_checked_before_publication(spark, tmp_path):
    root, identity = str(tmp_path / "pub"), {"provider": "p", "model": "m", "dimensions": 2}
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    good = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    with pytest.raises(ValueError):
        publish_records(spark, root, good.unionByName(good), chunks, identity)
    assert publish.pointer(spark, root) is None
    publish_records(spark, root, good, chunks, identity)
    assert publish.pointer(spark, root).manifest["embeddings"]["total"] == 2


def test_copy_follows_the_publication(spark, tmp_path):
    root, folder = str(tmp_path / "pub"), str(tmp_path / "copy")
    identity = {"provider": "p", "model": "m", "dimensions": 2}
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    rows = spark.createDataFrame([("b", "p.md", 1, "h", None, [1.0, 2.5]), ("a", "p.md", 0, "h", "i", [0.0, 1.0])], "chunk_id string, path string, index int, textHash string, embeddingInputHash string, embedding array<float>")
    publish_records(spark, root, rows, chunks, identity)
    made = []

    def copy(records, manifest):
        made.append(manifest["publication_id"])
        vectors_file.write_set(spark, folder, records.withColumnRenamed("chunk_id", "chunkId"), manifest, manifest["publication_id"])
        if len(made) == 1:
            publish_records(spark, root, rows, chunks, identity)  # a newer one supersedes it

    now = publish.maintain_copy(spark, root, lambda: vectors_file.copied_publication(spark, folder), copy)
    assert len(made) == 2 and now == made[1] == vectors_file.copied_publication(spark, folder)
    assert publish.maintain_copy(spark, root, lambda: vectors_file.copied_publication(spark, folder), copy) == now and len(made) == 2
    found = vectors_file.read_set(spark, folder).orderBy("vectorOrdinal").collect()
    assert [(r.chunkId, r.embedding) for r in found] == [("a", [0.0, 1.0]), ("b", [1.0, 2.5])]

    def code(change):
        change()
        with pytest.raises(vectors_file.BadSet) as e:
            vectors_file.read_set(spark, folder).collect()
        return e.value.code

    there = vectors_file.read_manifest(spark, folder)
    manifest, vectors = tmp_path / "copy" / vectors_file.manifests(spark, folder)[0], tmp_path / "copy" / there["vectorsFile"]
    for p in (tmp_path / "copy").glob(".*.crc"):
        p.unlink()
    said, data = json.loads(manifest.read_text()), vectors.read_bytes()
    assert code(lambda: vectors.write_bytes(data[:-4])) == "binary-size-mismatch"
    assert code(lambda: vectors.write_bytes(data[:-1] + b"x")) == "binary-digest-mismatch"
    assert code(lambda: manifest.write_text(json.dumps(said | {"version": 2}))) == "binary-unsupported-version"
    assert code(lambda: manifest.write_text(json.dumps(said | {"recordCount": 300_000}))) == "binary-record-limit-exceeded"
    assert code(lambda: vectors.unlink()) == "binary-vectors-missing" and vectors_file.copied_publication(spark, folder) is None


def test_a_crash_leaves_a_copy_that_can_be_read(spark, tmp_path, monkeypatch):
    folder, identity = str(tmp_path / "copy"), {"provider": "p", "model": "m", "dimensions": 2}
    rows = lambda x: spark.createDataFrame([("a", "p.md", 0, "h", "i", [x, 1.0])], "chunkId string, path string, index int, textHash string, embeddingInputHash string, embedding array<float>")
    assert vectors_file.recover_set(spark, folder) is None
    first = vectors_file.write_set(spark, folder, rows(1.0), identity, "one")
    write, files = publish.write_file, []

    def dies(spark, path, content, overwrite=False):
        if len(files) == stop:
            raise OSError("killed")
        files.append(path)
        write(spark, path, content, overwrite)

    for stop in (0, 1, 2):  # before the vectors, before the metadata, before the manifest
        files.clear()
        monkeypatch.setattr(publish, "write_file", dies)
        with pytest.raises(OSError):
            vectors_file.write_set(spark, folder, rows(2.0), identity, "two")
        monkeypatch.setattr(publish, "write_file", write)
        assert vectors_file.copied_publication(spark, folder) == "one" and [r.embedding for r in vectors_file.read_set(spark, folder).collect()] == [[1.0, 1.0]]
    assert vectors_file.recover_set(spark, folder) == first and len([p for p in (tmp_path / "copy").iterdir() if not p.name.startswith(".")]) == 3
    monkeypatch.setattr(vectors_file, "check_set", lambda *a: (_ for _ in ()).throw(OSError("killed")))  # after the manifest, before it is checked
    with pytest.raises(OSError):
        vectors_file.write_set(spark, folder, rows(3.0), identity, "three")
    monkeypatch.undo()
    assert vectors_file.copied_publication(spark, folder) == "three"
    for p in (tmp_path / "copy").glob("*.f32"):
        if first not in p.name:
            p.with_name(f".{p.name}.crc").unlink()
            p.write_bytes(b"torn")
    with pytest.raises(vectors_file.BadSet):
        vectors_file.read_set(spark, folder)
    assert vectors_file.recover_set(spark, folder) == first and vectors_file.copied_publication(spark, folder) == "one"


def test_batches_are_halved_around_what_is_refused():
    asked = []

    def provider(inputs):
        asked.append(len(inputs))
        return generation.word_embedder(16, "bad")(inputs)

    done = generation.embed_batch([f"text {i}" + " bad" * (i == 5) for i in range(8)], provider, 16)
    assert done.fatal is None and done.results[5] == (None, "input-rejected") and sorted(done.results) == list(range(8)) and asked == [8, 4, 4, 2, 1, 1, 2]
    assert generation.embed_batch(["a"], lambda x: generation.Reply(category="rate-limit"), 16).fatal == "rate-limit"
    assert generation.embed_batch(["a"], lambda x: generation.Reply([[1.0], [2.0]]), 1).fatal == "invalid-response"
    assert generation.embed_batch(["a"], lambda x: generation.Reply([[float("nan")]]), 1).fatal == "invalid-vector"
    assert generation.ordered_vectors([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]] and generation.ordered_vectors([(1, [2.0]), (1, [1.0])], 2) is None


def update(spark, root, *args, **settings):
    with publish.writer(spark, root, "vectors") as own:
        return generation.update_vectors(own, *args, **settings)


def MD5(c):
    return F.md5(c.cast("binary"))


def input_chunks(spark, texts):
    rows = [(f"c{i}", t, "p.md", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, input string, path string, chunk_index int").withColumn("text_hash", MD5(F.col("input")))


def test_vectors_are_brought_up_to_date(spark, tmp_path):
    root = str(tmp_path / "pub")
    run = lambda texts, provider: update(spark, root, input_chunks(spark, texts), provider, "local", "words", MD5, 2, part_inputs=2)
    one = run(["a b", "c", "refuse me"], generation.word_embedder(16, "refuse"))
    assert (one["mode"], one["to_generate"], one["errors"], one["published"]) == ("initial-build", 3, {"input-rejected": 1}, True)
    assert publish.read(spark, root, "embeddings").count() == 2 and publish.pointer(spark, root).tables == ("embeddings",)
    two = run(["a b", "changed", "fine"], generation.word_embedder(16))
    assert (two["mode"], two["reusable"], two["to_generate"], two["published"]) == ("incremental", 1, 2, True)
    three = run(["a b", "changed", "fine", "new"], lambda x: generation.Reply(category="connection"))
    assert (three["to_generate"], three["errors"], three["published"]) == (1, {"connection": 1}, False)
    assert publish.read(spark, root, "embeddings").count() == 3
    four = run(["a b", "changed", "fine", "new"], generation.word_embedder(16))
    assert (four["reusable"], four["to_generate"], four["published"]) == (3, 1, True)
    assert publish.read(spark, root, "embeddings").count() == 4 and publish.pointer(spark, root).tables == ("embeddings",)
    same = run(["a b", "changed", "fine", "new"], generation.word_embedder(16))
    assert (same["to_generate"], same["published"]) == (0, False)


def test_a_killed_run_asks_for_the_rest_only(spark, tmp_path):
    root, asked, texts = str(tmp_path / "pub"), tmp_path / "asked", [f"text {i}" for i in range(40)]
    asked.mkdir()

    def provider(kill_at):
        folder, embed = str(asked), generation.word_embedder(16)

        def run(inputs):
            for text in inputs:
                with open(f"{folder}/{os.getpid()}", "a") as f:
                    f.write(text + "\n")
            done = sum(len(open(f"{folder}/{n}").readlines()) for n in os.listdir(folder))
            if kill_at is not None and done > kill_at:
                raise RuntimeError("killed")
            return embed(inputs)

        return run

    def said():
        found = [line.strip() for p in asked.iterdir() for line in p.read_text().splitlines()]
        for p in asked.iterdir():
            p.unlink()
        return found

    run = lambda provider: update(spark, root, input_chunks(spark, texts), provider, "local", "words", MD5, 4, part_inputs=10)
    with pytest.raises(Exception, match="killed"):
        run(provider(22))
    first = said()
    with publish.writer(spark, root, "look") as own:
        kept = {f"text {r.chunk_id[1:]}" for r in generation.read_checkpoint(own).collect()}
    assert kept and kept < set(first) and len(publish.pointer(spark, root).tables) >= 1
    result = run(provider(None))
    second = said()
    probes = [t for t in second if second.count(t) > 1]
    assert result["recoverable"] == len(kept) and result["to_generate"] == 40 - len(kept) and result["published"]
    assert not kept & set(second) and set(second) == set(texts) - kept and not probes
    assert publish.read(spark, root, "embeddings").count() == 40 and publish.pointer(spark, root).tables == ("embeddings",)


def test_vectors_file(spark, tmp_path):
    content = vectors_file.pack_vectors([[1, -2.5, 3.25], [0, 1, 0]])
    (tmp_path / "v.f32").write_bytes(content)
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"chunkId": f"c{i}", "path": "p", "index": i, "textHash": "h", "vectorOrdinal": i}) for i in range(2)))
    found = vectors_file.read_vectors(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "v.f32"), 3, hashlib.sha256(content).hexdigest()).orderBy("vectorOrdinal").collect()
    assert [r.embedding for r in found] == [[1, -2.5, 3.25], [0, 1, 0]]
    with pytest.raises(Exception):
        vectors_file.read_vectors(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "v.f32"), 3, "no").collect()


VAULT = "path string, hash string, size long, mtime long, text string"


def vault_of(spark, texts, times=()):
    """Notes (path to text) as a vault."""
    rows = [(p, hashlib.md5(t.encode()).hexdigest(), len(t), dict(times).get(p, 1), t) for p, t in texts.items()]
    return spark.createDataFrame(rows, VAULT)


def rules_of():
    chunk = lambda n: chunking.chunk_notes(n.withColumn("k", F.lit(0)), "k").drop("k")
    return E.Rules(F.col("path").startswith("x/") | ~policy.is_markdown(F.col("path")), F.col("text").contains("secret"), chunk)


def published(spark, root):
    """The index and the chunks, which must be those of a rebuild of the same notes."""
    index = {r.path: r.hash for r in publish.read(spark, root, "index").collect()}
    return index, sorted((r.chunk_id, r.text) for r in publish.read(spark, root, "chunks").collect())


def rebuilt(spark, root, texts):
    with publish.writer(spark, root, "rebuild") as own:
        E.rebuild(own, vault_of(spark, texts), rules_of())
    return published(spark, root)


LONG = "many words of a long note " * 100


def test_streams_keep_index_and_chunks(spark, tmp_path):
    source, root, events = str(tmp_path / "events"), str(tmp_path / "index"), "seq long, type string, path string, old_path string"
    texts = {"a.md": "old a", "b.md": LONG, "c.md": LONG + "c", "d.md": "d", "s.md": "to be secret", "m.md": LONG + "m"}
    start = {**texts, "s.md": "not yet"}
    rebuilt(spark, root, start)
    batches = [
        ([(1, "create", "n.md", None), (2, "modify", "a.md", None), (3, "delete", "b.md", None), (4, "modify", "gone.md", None)], {"n.md": LONG + "n", "a.md": LONG + "a"}, ["b.md"]),
        ([(5, "rename", "e.md", "c.md"), (6, "modify", "s.md", None), (7, "rename", "x/d.md", "d.md"), (8, "modify", "m.md", None)], {"e.md": LONG + "c", "s.md": "now secret"}, ["c.md", "s.md", "d.md"]),
        ([(9, "modify", "m.md", None), (10, "create", "y.txt", None)], {"y.txt": "no note"}, ["y.txt"]),
    ]
    now, versions, stream = dict(start), [publish.current(spark, root)], None
    for k, (rows, written, gone) in enumerate(batches):
        now = {p: t for p, t in (now | written).items()}
        spark.createDataFrame(rows, events).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events).parquet(source)
        E.apply_stream(stream, root, vault_of(spark, now), rules_of(), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        left = {p: t for p, t in now.items() if p not in gone}
        now = left
        got = published(spark, root)
        assert got == rebuilt(spark, str(tmp_path / f"fresh{k}"), left) and len({c.split("::")[0] for c, _ in got[1]}) == len(left)
        versions.append(publish.current(spark, root))
    assert len(set(versions)) == 3 and publish.names_in(spark, f"{root}/staged") == []  # the last batch changed nothing
    with pytest.raises(Exception, match="companion"):
        spark.createDataFrame([(11, "delete", "a.md", None)], events).write.mode("append").parquet(source)
        E.apply_stream(stream, root, vault_of(spark, now), rules_of(), str(tmp_path / "ck"), publish.Role(False)).trigger(availableNow=True).start().awaitTermination()
    timed = spark.createDataFrame([("a.md", 1, 10)], "path string, seq long, s long").select("path", "seq", F.timestamp_seconds("s").alias("ts"))
    timed.write.parquet(f"{source}-timed")
    bursts = E.debounced(spark.readStream.schema(timed.schema).parquet(f"{source}-timed"))
    bursts.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {r.path for r in spark.table("bursts").collect()} <= {"a.md"}


def test_texts_that_change_during_a_batch_leave_one_version(spark, tmp_path):
    root, calls = str(tmp_path / "pub"), spark.sparkContext.accumulator(0)
    rebuilt(spark, root, {"a.md": "old"})
    first = vault_of(spark, {"a.md": LONG})

    def moving(n):  # another text at each evaluation
        calls.add(1)
        return n

    drawn = F.udf(lambda t: f"{t} {os.urandom(4).hex()}")
    vault = first.withColumn("text", drawn.asNondeterministic()("text")).withColumn("hash", F.md5(F.col("text").cast("binary")))
    with publish.writer(spark, root, "batch") as own:
        changes = spark.createDataFrame([("modify", "a.md", None)], "type string, path string, old_path string")
        assert E.apply_changes(own, changes, vault, E.Rules(F.lit(False), F.lit(False), lambda n: n.withColumn("chunk_id", F.concat("path", F.lit("::0"))).select("path", F.lit(0).alias("chunk_index"), "chunk_id", "text"))) == 1
    index, chunks = published(spark, root)
    assert index["a.md"] == hashlib.md5(chunks[0][1].encode()).hexdigest() and moving(1) == 1


def test_batches_find_notes_and_chunks_without_a_shuffle_of_texts(spark, tmp_path, monkeypatch):
    from inkwell.plans import stream_queries

    docs = [(i, f"text {i} of a document", "en", "s", 20) for i in range(12)] + [(None, "nobody's", "en", "s", 8), (12, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bought = [(100 + i, i, "purchase") for i in (0, 1, 5, 40)] + [(101, 1, "purchase"), (200, 3, "view"), (201, None, "purchase")]
    spark.createDataFrame([(e, None, u, t, 0.0, "") for e, u, t in bought], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    wanted = spark.createDataFrame([("u/1.md",), ("u/12.md",), ("u/99.md",), ("u/5-105.md",), ("u/3-200.md",), ("u/1-101.md",), ("u/40-140.md",)], "path string")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (10**6, 0):
            monkeypatch.setattr(E, "BROADCAST_PATHS", few)
            notes = stream_queries.vault(spark, str(tmp_path))(wanted, E.marked(wanted.count()))
            found = sorted((r.path, r.text, r.size) for r in notes.collect())
            assert found == [("u/1-101.md", "text 1 of a document", 20)] * 2 + [("u/1.md", "text 1 of a document", 20), ("u/12.md", "", 0), ("u/5-105.md", "text 5 of a document", 20)]
            assert ("hashpartitioning" in notes._jdf.queryExecution().executedPlan().toString()) == (not few)
            root = str(tmp_path / f"pub{few}")
            rebuilt(spark, root, {"u/1.md": "old", "u/7.md": "stays"})
            with publish.writer(spark, root, "batch") as own:
                changes = spark.createDataFrame([("modify", "u/1.md", None), ("rename", "u/5-105.md", "u/7.md")], "type string, path string, old_path string")
                assert E.apply_changes(own, changes, stream_queries.vault(spark, str(tmp_path)), rules_of()) == 3
            index, chunks = published(spark, root)
            assert set(index) == {"u/1.md", "u/5-105.md"} and {c.split("::")[0] for c, _ in chunks} == set(index)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_hybrid_query_terms_read_whole_texts(spark, tmp_path):
    from inkwell.plans import search_queries

    texts = ["lorem " * 100 + "Endword", "short text", ""]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.terms for r in search_queries.hybrid_query_terms(spark, str(tmp_path)).collect()}
    assert found == {0: " ".join(["lorem"] * 100 + ["endword"]), 1: "short text", 2: ""}


def test_dirty_states_fire(spark, tmp_path):
    source = str(tmp_path / "events")
    rows = [[("a", 0, None), ("b", 0, None), ("p", 0, None), ("p", 1, "pause"), ("m", 0, None), ("m", 4, "manual")], [("a", 5, None), ("b", 30, None), ("a", 14, None), ("p", 40, "resume")], [("z", 500, None)], [("z", 1000, None)]]
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, "path string, s int, kind string").select("path", F.timestamp_seconds(F.col("s") + 10_000).alias("ts"), "kind").coalesce(1).write.mode("append").parquet(f"{source}/{k}")
        for file in (tmp_path / "events" / str(k)).iterdir():
            os.utime(file, (1_700_000_000 + 60 * k,) * 2)  # read in this order
    stream = spark.readStream.schema("path string, ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    query = E.scheduled(stream, 10, 12).writeStream.format("memory").queryName("fires").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.path, int(r.dirty_since.timestamp()) - 10_000, int(r.fires_at.timestamp()) - 10_000, r.events) for r in spark.table("fires").collect()}
    assert {("a", 0, 12, 2), ("b", 0, 10, 1), ("p", 0, 40, 1), ("m", 0, 4, 1), ("a", 14, 24, 1), ("b", 30, 40, 1)} <= got


def test_rebuild_and_catch_up(spark, tmp_path):
    root = str(tmp_path / "pub")
    listener = E.Diagnostics(2)
    with publish.writer(spark, root, "rebuild") as own:
        counts = E.rebuild(own, vault_of(spark, {"a.md": "text", "x/b.md": "text", "c.md": "a secret", "d.md": LONG, "e.md": "e", "f.md": "f"}), rules_of())
    assert counts == {"notes": 4, "excluded_by_path": 1, "excluded_by_content": 1, "chunks": 3 + len(chunking.chunks_of(LONG))}
    texts = {"a.md": LONG + "new", "x/b.md": "text", "c.md": "a secret", "d.md": LONG, "e.md": "now secret", "n.md": "new", "s.md": "new secret"}
    vault = vault_of(spark, texts, {"a.md": 2, "e.md": 2}.items())

    def caught(vault, rules, **settings):
        with publish.writer(spark, root, "catch-up") as own:
            return E.catch_up(own, vault, rules, **settings)

    # f is gone; c and s are candidates that their texts keep out; e has to leave; a touched note changes nothing.
    assert caught(vault, rules_of()) == {"create": 3, "modify": 2, "delete": 1, "changed": 4}
    left = {p: texts[p] for p in ("a.md", "d.md", "n.md")}
    assert published(spark, root) == rebuilt(spark, str(tmp_path / "fresh"), left)
    assert caught(vault, rules_of())["changed"] == 0
    touched = vault_of(spark, texts, {"a.md": 2, "e.md": 2, "d.md": 9}.items())
    before = publish.current(spark, root)
    assert caught(touched, rules_of())["changed"] == 0 and publish.current(spark, root) == before
    stricter = dataclasses.replace(rules_of(), content_excluded=F.col("text").rlike("secret|new"))
    assert caught(vault, stricter)["changed"] == 0  # nothing was changed in the vault
    assert caught(vault, stricter, reread=True) == {"create": 0, "modify": 0, "delete": 2, "changed": 2}
    assert published(spark, root) == rebuilt(spark, str(tmp_path / "fresh2"), {"d.md": LONG}) and listener.last.maxlen == 2
    with pytest.raises(LookupError), publish.writer(spark, str(tmp_path / "nothing"), "catch-up") as own:
        E.catch_up(own, vault, rules_of())


def test_remote_providers():
    asked = []

    def answers(*replies):
        asked.clear()
        rest = list(replies)

        def transport(url, headers, body):
            asked.append((url, headers, body))
            reply = rest.pop(0)
            if isinstance(reply, Exception):
                raise reply
            return reply[0], json.dumps(reply[1]) if not isinstance(reply[1], str) else reply[1]

        return transport

    item = lambda *r: remote.ItemProvider(answers(*r), "https://x/v1", "m", "key")
    assert item((200, {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}))(["a", "b"]).vectors == [[1.0], [2.0]]
    assert asked == [("https://x/v1/embeddings", {"Authorization": "Bearer key"}, {"model": "m", "input": ["a", "b"]})]
    assert item((200, {"data": [{"embedding": [1.0]}]}))(["a"]).vectors == [[1.0]]
    for reply, category, fatal in [
        ((200, {"data": [{"index": 0, "embedding": [1.0]}] * 2}), "invalid-response", True), ((200, {"data": [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": [1.0, 2.0]}]}), "dimension-mismatch", True), ((200, {"data": [{"index": 0, "embedding": []}, {"index": 1, "embedding": [1.0]}]}), "invalid-vector", True),
        ((200, "no"), "invalid-response", True), ((413, {"error": "too long"}), "input-rejected", False), ((429, {}), "rate-limit", True), ((500, ""), "connection", True), (TimeoutError(), "timeout", True), (OSError("gone"), "connection", True),
    ]:
        got = item(reply)(["a", "b"])
        assert (got.category, got.fatal) == (category, fatal), reply
    assert remote.ItemProvider(answers(), "u", "m", " ")(["a"]).category == "configuration" and not asked

    batch = lambda *r: remote.BatchProvider(answers(*r), "http://h:1", "m")
    assert batch((200, {"embeddings": [[1.0], [2.0]]}))(["a", "b"]).vectors == [[1.0], [2.0]]
    old = batch((404, {"error": "no such page"}), (200, {"embedding": [1.0]}), (200, {"embedding": [2.0]}))(["a", "b"])
    assert old.vectors == [[1.0], [2.0]] and old.requests == 3 and [a[0] for a in asked] == ["http://h:1/api/embed", *["http://h:1/api/embeddings"] * 2]
    assert batch((404, {"error": "model m not found, try pulling it"}))(["a"]).category == "model-not-found" and len(asked) == 1
    assert batch((200, {"odd": 1}), (200, {"embedding": [1.0]}))(["a"]).vectors == [[1.0]]
    assert batch((200, {"embeddings": [[1.0], [2.0, 3.0]]}))(["a", "b"]).category == "dimension-mismatch"
    assert batch((400, {}), (500, {}))(["a"]).category == "connection" and batch((500, {}))(["a"]).category == "connection"


def test_engine_modes_and_roles(spark):
    notes = spark.createDataFrame([("a/erth.md", "erth"), ("b.md", "b")], "path string, basename string")
    chunks = spark.createDataFrame([("a/erth.md", 0, "c0", "the erth is round"), ("b.md", 0, "c1", "something else")], "path string, chunk_index int, chunk_id string, text string")
    made = generation.embed_inputs(chunks.select("chunk_id", F.col("text").alias("input")), generation.word_embedder(16), 16).withColumn("ord", F.col("chunk_id"))
    own = engine.SearchEngine(notes, chunks, made, generation.word_embedder(16), "words", 16)
    assert own.search("semantic", "the erth is round").results.first().chunk_id == "c0" and own.search("hybrid", "erth round").semantic
    bare = engine.SearchEngine(notes, chunks)
    found = bare.search("hybrid", "erth")
    assert not found.semantic and found.warnings and found.results.first().path == "a/erth.md"
    assert bare.search("semantic", "erth").results.count() == 0
    with pytest.raises(ValueError):
        own.search("odd", "x")
    with engine.cancellable(spark, "t1"):
        assert spark.range(3).count() == 3
    assert engine.cancel(spark, "t1") == []


def test_columns_strip_accents_as_queries_do(spark):
    import sys
    import unicodedata

    points = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Cn", "Co")]
    rows = [(f"x{c}y",) for c in points] + [("Ἀθῆναι Йод ё ǖ ḉ 각나다릿 が",), ("plain ascii  text",), ("",), (None,)]
    found = spark.createDataFrame(rows, "t string").select("t", T.normalise(F.col("t")).alias("n")).collect()
    other = [r.t for r in found if r.t is not None and r.n != T.normalise_value(r.t)]
    # Java and Python may be of different versions of Unicode where case is concerned; nothing else may differ.
    assert all(len({unicodedata.normalize("NFD", r).lower(), unicodedata.normalize("NFD", r)}) > 1 or r[1:-1].lower() != r[1:-1].upper() for r in other) and len(other) < 40, other[:20]


def test_names_are_sorted_as_readers_do(spark):
    names = ["b.md", "B.md", "á.md", "a.md", "Z.md", "z.md", "é.md", "e.md", "я.md", "α.md", "a/b.md", "a b.md", "a-b.md"]
    found = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(*T.in_order(F.col("n"))).collect()]
    assert [n for n in found if len(n) == 4] == ["a.md", "á.md", "b.md", "B.md", "e.md", "é.md", "z.md", "Z.md", "α.md", "я.md"]


def test_packed_similarities_equal_folds(spark):
    from inkwell.operators import vectors

    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.99, 0.01, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0]), (5, None), (6, [1.0, None, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [])]
    for kind in ("float", "double"):
        records = spark.createDataFrame(rows, f"k long, embedding array<{kind}>").repartition(2)
        found = {r.k: r.similarity for r in vectors.scored(records, [1, 0, 0]).collect()}
        folds = {r.k: r.s for r in records.where(F.size("embedding") == 3).select("k", vectors.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("s")).collect()}
        assert set(found) == set(folds) == {0, 1, 2, 3, 6, 7} and found[6] is None and found[3] == 0 and found[0] == found[7] == 1
        assert all(abs(found[k] - folds[k]) < 1e-9 for k in (0, 1, 2, 3, 7))
        assert [r.k for r in vectors.top_similar(records.withColumn("note", F.col("k")), [1, 0, 0], "note", "k", -1.0).collect()] == [0, 7, 1, 2, 3]
    assert vectors.scored(records.where("false"), [1, 0, 0]).collect() == [] and vectors.scored(records, []).count() == 1


def test_providers_by_name():
    asked = []

    def transport(url, headers, body):
        asked.append((url, headers, body["model"]))
        return 200, json.dumps({"data": [{"index": 0, "embedding": [1.0]}]} if "Authorization" in headers else {"embeddings": [[1.0]]})

    for settings, url, model in [
        (remote.Settings(" Ollama "), "http://localhost:11434/api/embed", "nomic-embed-text-v2-moe"), (remote.Settings("ollama", "http://h:1/", "m"), "http://h:1/api/embed", "m"),
        (remote.Settings("MISTRAL", api_key="k"), "https://api.mistral.ai/v1/embeddings", "mistral-embed"), (remote.Settings("openrouter", model="x/y", api_key="k"), "https://openrouter.ai/api/v1/embeddings", "x/y"),
    ]:
        assert remote.dispatch(settings, transport)(["a"]).vectors == [[1.0]] and asked[-1][0] == url and asked[-1][2] == model
    n = len(asked)
    assert remote.dispatch(remote.Settings("other"), transport)(["a"]).category == "unsupported-provider" and remote.dispatch(remote.Settings("other"), transport)([]).category == "configuration" and len(asked) == n
    assert remote.dispatch(remote.Settings("mistral"), transport)(["a"]).category == "configuration"


def test_values_that_are_used_again_are_made_once(spark):
    """A note of many lines: work per line, not per pair of lines."""
    import time

    from inkwell.operators import edits, metadata

    lines = [f"K{i % 1500}: Válue {i} " for i in range(3000)]
    text = "\n---\n" + "\n".join([*lines, "tags: [A b, 'Ç', c]"]) + "\n---\n" + "\n".join(f"#Côr{i % 5} Line {i % 1000}" for i in range(20000)) + " \n"
    rows = spark.createDataFrame([(text,), (None,), ("",), (" ﻿",), ("---\na: 1\na: 2\n--- x",)], "text string")
    began = time.time()
    found = rows.select(edits.existing_tags(F.col("text")).alias("tags"), F.size(edits.distinct_lines(F.split("text", "\n"))).alias("lines"), metadata.properties(metadata.frontmatter(F.col("text"))[1]).alias("map")).collect()
    assert time.time() - began < 60
    assert found[0].tags == ["a_b", "c", "cor0", "cor1", "cor2", "cor3", "cor4"] and found[0].lines == 3000 + 2 + 1000
    assert found[0].map == {f"K{i}": f"Válue {i + 1500}" for i in range(1500)} | {"tags": "[A b, 'Ç', c]"}
    assert [(r.tags, r.lines) for r in found[2:4]] == [([], 0), ([], 0)]
    assert found[4].map == {"a": "2"}


def test_workers_hold_a_part_of_a_batch(spark):
    """Chunks of a large batch leave the worker in parts, and the session's batches are small."""
    from inkwell.functions import batches

    notes = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.format_string("n%d.md", "id").alias("path"), F.repeat(F.lit("wörd "), 400).alias("text"))
    chunks = chunking.chunk_notes(notes)
    assert int(spark.conf.get(batches.BATCH_CONF)) <= batches.BATCH_BYTES
    assert chunks.groupBy("doc_id").count().where("count = 2").count() == 3000
    import pyarrow as pa

    whole = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 10_000})
    parts = list(batches.slices(whole))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == 10_000 and not list(batches.slices(whole.slice(0, 0)))


def test_matches_inside_words_are_counted_where_there_are_some(spark):
    rows = spark.createDataFrame([("aa aab baa baab aaaa xaa  b aa",), ("b",), ("",)], "t string").select(text_search.match_counts(text_search.padded(F.col("t")), "aa").alias("m"))
    assert [tuple(r.m) for r in rows.collect()] == [(2, 2, 3), (0, 0, 0), (0, 0, 0)]
    spaced = spark.createDataFrame([("a  b\tc\n \td  e ",)], "t string").select(T.collapse(F.col("t"))).first()[0]
    assert spaced == "a b c d e"
