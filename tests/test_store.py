import pytest
from pyspark.sql import functions as F

from tallyquill.functions.embedding import hash64_model
from tallyquill.operators import answers, store


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, collection string, source string, text string, version int")


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_upsert_is_idempotent(spark):
    base = chunks(spark, ("a", "c", "s", "old", 1), ("b", "c", "s", "old", 1))
    new = chunks(spark, ("b", "c", "s", "newer", 3), ("b", "c", "s", "new", 2), ("d", "c", "s", "new", 2))
    once = store.upsert(base, new, ["id"], [F.col("version")])
    twice = store.upsert(once, new, ["id"], [F.col("version")])
    want = [("a", "old"), ("b", "newer"), ("d", "new")]
    assert sorted((r.id, r.text) for r in once.collect()) == sorted((r.id, r.text) for r in twice.collect()) == want


def test_replace_removes_the_stale_tail(spark):
    base = chunks(spark, *((f"s_{i}", "c", "s", f"t{i}", 1) for i in range(5)), ("o_0", "c", "o", "t", 1))
    new = chunks(spark, ("s_0", "c", "s", "t", 2))
    assert ids(store.replace_sources(base, new)) == ["o_0", "s_0"]
    assert ids(store.delete_sources(base, new)) == ["o_0"]


def test_stored_table(spark, tmp_path):
    path = str(tmp_path / "store")
    base = chunks(spark, ("a", "1", "s", "old", 1), ("b", "2/x", "s", "old", 1), ("c", "3", "t", "old", 1))
    store.create(base, path)
    store.add(chunks(spark, ("d", "1", "u", "new", 1)), path)
    current = lambda: store.read(spark, path, base.schema)
    assert ids(store.get(current(), "1", ["text"])) == ["a", "d"]
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "store" / "collection=3").iterdir()}
    store.upsert_into(current(), path, chunks(spark, ("a", "1", "s", "newer", 2)), ["id"], [F.col("version")])
    assert sorted((r.id, r.text) for r in current().collect()) == [("a", "newer"), ("b", "old"), ("c", "old"), ("d", "new")]
    store.delete_sources_in(current(), path, spark.createDataFrame([("s",)], "source string"))
    assert ids(current()) == ["c", "d"]
    store.replace_sources_in(current(), path, chunks(spark, ("e", "4", "u", "new", 1)))
    assert ids(current()) == ["c", "e"]
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "store" / "collection=3").iterdir()}


def test_rows_without_a_collection_are_a_collection(spark, tmp_path):
    path = str(tmp_path / "store")
    base = chunks(spark, ("n1", None, "s", "old", 1), ("n2", None, "t", "old", 1), ("x", "None", "s", "old", 1), ("c1", "c", "s", "old", 1))
    store.create(base, path)
    current = lambda: store.read(spark, path, base.schema)
    store.upsert_into(current(), path, chunks(spark, ("n1", None, "s", "new", 2)), ["id"], [F.col("version")])
    rows = lambda: sorted((r.id, str(r.collection), r.text) for r in current().collect())
    assert rows() == [("c1", "c", "old"), ("n1", "None", "new"), ("n2", "None", "old"), ("x", "None", "old")]
    assert current().where("collection IS NULL").count() == 2
    store.delete_sources_in(current(), path, spark.createDataFrame([("t",)], "source string"))
    assert ids(current()) == ["c1", "n1", "x"]
    store.replace_sources_in(current(), path, chunks(spark, ("n3", None, "s", "new", 3)))
    assert ids(current()) == ["n3"] and current().where("collection IS NULL").count() == 1
    store.delete_sources_in(current(), path, spark.createDataFrame([("s",)], "source string"))
    assert ids(current()) == []
    store.add(chunks(spark, ("m", None, None, "new", 3), ("k", "k", "u", "new", 3)), path)
    store.delete_sources_in(current(), path, spark.createDataFrame([(None,)], "source string"))
    assert ids(current()) == ["k"]
    store.delete_sources_in(current(), path, spark.createDataFrame([], "source string"))
    assert ids(current()) == ["k"]


def files_of(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("part-*.parquet")}


def scanned(frame, metric):
    """Sum of a metric over the file scans of a plan, once it has run."""
    plan = frame._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())]
    return sum(leaf.metrics().apply(metric).value() for leaf in leaves if "Scan parquet" in leaf.nodeName())


@pytest.fixture()
def many_files(spark, tmp_path):
    """Two collections of eight files each; the ids and sources of a file are its own."""
    path = tmp_path / "store"
    rows = spark.range(0, 32000, 1, 8).select(
        F.concat(F.lit("id"), "id").alias("id"),
        F.when(F.col("id") % 2 == 0, "even/one").alias("collection"),
        F.concat(F.lit("s"), (F.col("id") / 2).cast("int")).alias("source"),
        F.lit("t").alias("text"),
        F.lit(1).alias("version"),
    )
    store.create(rows, str(path))
    return path, store.read(spark, str(path), rows.schema)


def test_a_change_rewrites_only_files_that_hold_its_keys(spark, many_files):
    path, stored = many_files
    before = files_of(path)
    assert len(before) == 16
    store.delete_sources_in(stored, str(path), spark.createDataFrame([("s7",), ("none",)], "source string"))
    after = files_of(path)
    assert len(before.items() - after.items()) == 2  # one file of each collection
    current = lambda: store.read(spark, str(path), stored.schema)
    assert current().count() == 31998 and current().where("source = 's7'").count() == 0
    update = chunks(spark, ("id9000", "even/one", "s4500", "new", 2))
    store.upsert_into(current(), str(path), update, ["id"], [F.col("version")])
    assert len(after.items() - files_of(path).items()) == 1
    assert [r.text for r in current().where("id = 'id9000'").collect()] == ["new"]
    assert current().count() == 31998 and not list(path.glob("_changes/*"))


def test_bloom_filters_skip_files(spark, many_files):
    _, stored = many_files
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        named = spark.createDataFrame([("s7",), ("s15999",)], "source string")
        found = store.holding(stored, named, ["source"])
        assert scanned(found, "numOutputRows") <= 4 * 2000 and found.count() == 4
        names = [r.file for r in found.collect()]
        assert scanned(stored.where(F.col(store.FILE).isin(names)), "numFiles") == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_few_and_many_keys_find_the_same_files(spark, many_files, monkeypatch):
    _, stored = many_files
    named = spark.createDataFrame([(f"s{i}",) for i in range(0, 4000, 150)] + [(None,)], "source string")
    few = sorted(r.file for r in store.holding(stored, named, ["source"]).collect())
    monkeypatch.setattr(store, "FEW_KEYS", 3)
    assert few == sorted(r.file for r in store.holding(stored, named, ["source"]).collect()) and len(few) == 4


@pytest.mark.parametrize("moved", [False, True])
def test_an_interrupted_change_is_finished_by_the_next(spark, many_files, monkeypatch, moved):
    path, stored = many_files
    gone = spark.createDataFrame([("s7",)], "source string")
    with monkeypatch.context() as patch:
        if moved:  # the files are in, the replaced ones are still there
            patch.setattr(store, "discard", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        else:
            patch.setattr(store, "_finish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.delete_sources_in(stored, str(path), gone)
    store.recover(spark, str(path))
    store.recover(spark, str(path))
    current = store.read(spark, str(path), stored.schema)
    assert current.count() == 31998 and current.select("id").distinct().count() == 31998
    assert not list(path.glob("_changes/*"))


def test_a_change_that_was_not_written_whole_is_dropped(spark, many_files):
    path, stored = many_files
    stray = path / "_changes" / "x" / "collection=even%2Fone"
    stray.mkdir(parents=True)
    (stray / "part-0.parquet").write_bytes(b"half")
    store.delete_sources_in(stored, str(path), spark.createDataFrame([("s7",)], "source string"))
    assert store.read(spark, str(path), stored.schema).count() == 31998


def test_null_keys_are_replaced(spark, tmp_path):
    path = str(tmp_path / "stock")
    stock = lambda *rows: spark.createDataFrame(list(rows), "product_id int, warehouse string, units int, version int")
    base = stock((1, None, 5, 1), (1, "None", 6, 1), (None, "w", 7, 1))
    store.create(base, path, by="warehouse")
    updates = stock((1, None, 9, 2), (None, "w", 8, 2))
    keys = ["product_id", "warehouse"]
    store.upsert_into(store.read(spark, path, base.schema), path, updates, keys, [F.col("version")], by="warehouse")
    rows = store.read(spark, path, base.schema).collect()
    assert sorted(((r.product_id, r.warehouse, r.units) for r in rows), key=str) == [(1, "None", 6), (1, None, 9), (None, "w", 8)]


def test_an_empty_name_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="EmptyName"):
        store.create(chunks(spark, ("a", "", "s", "old", 1)), str(tmp_path / "store"))


def test_dedup(spark):
    rows = [("a", "c", "s", "x y", 1), ("b", "c", "s", "x y", 1), ("c", "d", "s", "x y", 1), ("d", "c", "s", "y  X", 1), ("e", "c", "s", "?!", 1), ("f", "c", "s", "?!", 1)]
    frame = chunks(spark, *rows)
    kept = store.dedup_content(frame, ["id"])
    assert ids(kept) == ["a", "c", "d", "e"]
    assert ids(store.dedup_content(kept.drop("content_id"), ["id"])) == ["a", "c", "d", "e"]
    assert ids(store.dedup_content(frame, ["id"], kept.where("collection = 'd'"))) == ["a", "d", "e"]
    assert ids(store.dedup_nearest(frame, ["id"])) == ["a", "c", "e"]


def test_add_missing(spark):
    base = chunks(spark, ("a", "c", "s", "x", 1))
    assert ids(store.add_missing(base, chunks(spark, ("a", "c", "s", "x", 2), ("b", "c", "s", "x", 2)), ["id"])) == ["b"]


def test_retries_keep_every_chunk(spark):
    def model(text):
        if text == "bad":
            raise ValueError("refused")
        return [float(len(text))]

    frame = chunks(spark, ("a", "c", "s", "ok", 1), ("b", "c", "s", "bad", 1), ("c", "c", "s", "fine", 1))
    rows = {r.id: r for r in store.embed_with_retry(frame, model, wait_seconds=0).collect()}
    assert rows["a"].embedding == [2.0] and rows["c"].embedding == [4.0]
    assert rows["b"].embedding is None and rows["b"].error == "ValueError: refused" and rows["b"].attempts == 3


def test_passing_failure_is_retried(spark):
    calls = []

    def model(text):
        calls.append(text)
        if len(calls) % 2:
            raise OSError("busy")
        return [1.0]

    frame = chunks(spark, ("a", "c", "s", "x", 1)).coalesce(1)
    row = store.embed_with_retry(frame, model, wait_seconds=0).first()
    assert (row.embedding, row.error, row.attempts) == ([1.0], None, 2)


def test_only_failed_texts_are_sent_again(spark):
    calls = []

    def model(texts):
        calls.append(list(texts))
        if "poison" in texts:
            raise OSError("broken call")
        return [ValueError("refused") if text == "bad" else [1.0, float(len(text))] for text in texts]

    texts = [f"t{i}" for i in range(14)] + ["bad", "poison"]
    found = store._answers(model, texts, 3, 0)
    assert [vector for vector, _, _ in found[:14]] == [[1.0, float(len(text))] for text in texts[:14]]
    assert found[14] == (None, "ValueError: refused", 3) and found[15] == (None, "OSError: broken call", 3)
    assert [len(call) for call in calls[:5]] == [16, 4, 4, 4, 4]  # then the failed ones alone
    assert sorted(sum(calls[5:], [])) == ["bad", "poison", "t12", "t13"] and all(len(call) == 1 for call in calls[5:])
    assert store._answers(lambda texts: [], ["a"], 1, 0) == [(None, "ValueError: 0 answers to 1 texts", 1)]
    assert store._answers(model, [], 3, 0) == []


def test_batches_equal_the_built_in_embedder(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["Red apple, red", "", None, "?", "Ä ß 12", "x"])], "id int, text string")
    rows = {r.id: r for r in store.embed_batches(frame, hash64_model, wait_seconds=0, batch=2).collect()}
    want = {r.id: r.embedding for r in store.embed(frame).collect()}
    assert {i: r.embedding for i, r in rows.items()} == want
    assert [rows[i].error for i in range(6)] == [None, "ValueError: no words", "ValueError: no text", "ValueError: no words", None, None]
    assert [rows[i].attempts for i in range(6)] == [1, 3, 0, 3, 1, 1]
    assert store.embed_batches(frame.limit(0), hash64_model).count() == 0


def test_reports(spark):
    frame = store.embed(chunks(spark, ("a", "c", "s", "x" * 60, 1), ("b", "c", "s", "?", 1), ("d", "e", "u", "x", 1), ("f", "e", "u", "x", 1)))
    report = {r.collection: r for r in store.inspect(frame, "id").collect()}
    assert (report["c"].documents, report["c"].embeddings, len(report["c"].sample_document)) == (2, 1, 50)
    counts = {r.source: tuple(r)[1:] for r in store.ingest_metrics(frame).collect()}
    assert counts == {"s": (2, 1, 1, 0), "u": (2, 2, 0, 1)}
    assert {r.total_collections for r in store.list_collections(frame).collect()} == {2}
    assert store.preview(frame, 3).where("id = 'a'").first()["preview"] == "xxx..."


# --- answers --------------------------------------------------------------------------


def questions(spark, *asked):
    return spark.createDataFrame(list(enumerate(asked)), "qid bigint, question string")


def test_routes_and_replies(spark):
    frame = answers.route(questions(spark, " HI ", "List sources", "what is x", "how are you?"))
    assert [r.route for r in frame.orderBy("qid").collect()] == ["casual", "sources", "database", "casual"]
    replies = frame.select(answers.canned_reply(F.col("question")), answers.greeting_reply(F.col("question"), "long")).collect()
    assert [tuple(r) for r in replies][0] == ("Hello! How can I assist you today?", "Hello! I'm here to assist you with your queries.")
    assert tuple(replies[2]) == (None, None)


def test_source_listing_is_whole(spark):
    frame = chunks(spark, *((str(i), "c", f"s{i % 10}", "x", 1) for i in range(40))).repartition(3)
    assert sorted(r.line for r in answers.source_listing(frame).collect()) == [f"- s{i}" for i in range(10)]
    assert answers.source_listing(frame.limit(0)).count() == 0


def test_every_question_has_one_row(spark):
    stored = store.embed(chunks(spark, *((str(i), "c", f"s{i}", "x", 1) for i in range(5))))
    asked = questions(spark, "list sources", "List sources", "hi")
    rows = sorted(tuple(r) for r in answers.answer_all(asked, stored).select("qid", "formatted").collect())
    assert rows == [(0, "Available Sources: 5"), (1, "Available Sources: 5"), (2, answers.REPLIES["hi"])]
    none = answers.answer_all(asked, stored.limit(0)).where("qid = 0").first()
    assert none["formatted"] == answers.NO_SOURCES


def test_answers(spark):
    stored = store.embed(chunks(spark, ("1", "c", "s1", "red apple\nsweet", 1), ("2", "c", "s2", "blue sea " * 50, 1)))
    asked = questions(spark, "red apple", "??", "hi", "list sources")
    rows = {r.qid: r.formatted for r in answers.answer_all(asked, stored).collect()}
    assert rows[0].startswith("Answer:\nred apple\nsweet\n\nSources:\n1. s1\n - \nred apple\nsweet...\n\n\n2. s2\n - \nblue sea")
    assert rows[1] == "Answer:\nI don't know the answer to that.\n\nSources:\nNone"
    assert rows[2] == "Hello! How can I assist you today?"
    assert rows[3] == "Available Sources: 2"


def test_other_embedders_are_not_compared(spark):
    stored = store.embed(chunks(spark, ("1", "c", "s1", "red apple", 1)), embedder_id="other")
    assert answers.retrieve(questions(spark, "red apple"), stored).count() == 0


def test_personalize_and_review(spark):
    frame = spark.createDataFrame([("a\nb", "concise"), ("a\nb", "detailed"), ("", "concise")], "answer string, preference string")
    got = [r[0] for r in frame.select(answers.personalize(F.col("answer"), F.col("preference"))).collect()]
    assert got == ["a", "a\nb", ""]
    empty = F.array().cast("array<string>")
    got = [r[0] for r in frame.select(answers.review(F.col("answer"), empty)).collect()]
    assert got == ["Answer:\na\nb\n\nSources:\nNone"] * 2 + [answers.NOTHING_RELEVANT]
