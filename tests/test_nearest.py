import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyquill.operators import codes, nearest
from tallyquill.plans import vectors as plans


def frames(spark, queries, vectors):
    q = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(queries)], "qid bigint, embedding array<double>")
    v = spark.createDataFrame([(f"v{i:04d}", None if x is None else [float(y) for y in x]) for i, x in enumerate(vectors)], "id string, embedding array<double>")
    return q, v


def brute(queries, vectors, k, metric):
    out = {}
    for qid, q in enumerate(queries):
        if q is None:
            continue
        scored = []
        for i, v in enumerate(vectors):
            if v is None:
                continue
            dot = float(np.dot(q, v))
            if metric == "l2sq":
                far = float(((np.array(q) - v) ** 2).sum())
            elif metric == "ip":
                far = 1 - dot
            else:
                far = 1 - dot / float(np.linalg.norm(q) * np.linalg.norm(v))
            scored.append((round(far, 9), f"v{i:04d}"))
        out[qid] = [name for _, name in sorted(scored)[:k]]
    return out


def listed(found):
    out = {}
    for row in found.orderBy("qid", "rank").collect():
        out.setdefault(row.qid, []).append(row.id)
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (400, 6)).astype(float) + 0.5
    vectors[:150] = vectors[0]  # a crowd of copies
    queries = [*rng.integers(-3, 4, (7, 6)).astype(float), vectors[0], None]
    return queries, [*vectors, None]


@pytest.mark.parametrize("metric", nearest.METRICS)
@pytest.mark.parametrize("group, rows", [(4_000_000, 10_000), (20, 7), (6, 100)])
def test_exact_search(spark, points, metric, group, rows, monkeypatch):
    monkeypatch.setattr(nearest, "GROUP_ELEMENTS", group)
    monkeypatch.setattr(nearest, "FILE_ROWS", 2)
    monkeypatch.setattr(nearest, "ROWS", rows)
    q, v = frames(spark, *points)
    found = nearest.nearest(q, v.repartition(3), k=4, metric=metric)
    assert listed(found) == brute(*points, 4, metric)
    assert found.where("distance IS NULL OR isnan(distance)").count() == 0


def test_block_height_does_not_matter(spark, points, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ELEMENTS", 500)
    q, v = frames(spark, *points)
    assert listed(nearest.nearest(q, v, k=3)) == brute(*points, 3, "l2sq")


def test_no_vector_is_shuffled(spark, points):
    q, v = frames(spark, *points)
    plan = nearest.nearest(q, v, k=4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert all("embedding" not in line for line in plan.splitlines() if "Exchange" in line)


def test_shuffle_follows_queries_and_tasks(spark, points):
    """Rows that leave the scan: at most k per query and task, whatever the number of stored rows."""
    q, v = frames(spark, *points)
    schema = nearest._result_schema(q, v, "qid", "id")
    found = nearest._scanned(q, v.unionAll(v).unionAll(v).repartition(5), schema, 2, "l2sq", "embedding")
    assert found.count() == 5 * 2 * sum(x is not None for x in points[0])


def test_search_inside_groups(spark, points, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 25)
    queries, vectors = points
    q, v = frames(spark, queries, vectors)
    q = q.withColumn("box", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd"))
    number = F.substring("id", 2, 4).cast("int")
    v = v.withColumn("box", F.when(number % 2 == 0, "even").otherwise("odd"))
    found = listed(nearest.nearest_in_group(q, v, "box", k=3))
    assert nearest.nearest_in_group(q, v.withColumn("box", F.lit(None).cast("string")), "box").count() == 0
    for qid, names in found.items():
        own = [x if i % 2 == qid % 2 else None for i, x in enumerate(vectors)]
        assert names == brute([queries[qid]], own, 3, "l2sq")[0]


def test_more_wanted_than_stored_and_empty_sides(spark):
    q, v = frames(spark, [[1, 0]], [[0, 0], [1, 1]])
    assert listed(nearest.nearest(q, v, k=5)) == {0: ["v0000", "v0001"]}
    assert nearest.nearest(q.limit(0), v).count() == 0
    assert nearest.nearest(q, v.limit(0)).count() == 0
    assert nearest.nearest(frames(spark, [None], [])[0], v).count() == 0


def test_large_norms_keep_their_digits(spark):
    base = np.full(4, 1e5)
    q, v = frames(spark, [base], [base + 2e-3, base + [1e-3, 0, 0, 0], base, base + [0, 2e-3, 0, 0], base * 2])
    found = nearest.nearest(q, v, k=4).orderBy("rank").collect()
    assert [r.id for r in found] == ["v0002", "v0001", "v0003", "v0000"]
    assert [r.distance for r in found] == pytest.approx([0.0, 1e-6, 4e-6, 1.6e-5], rel=1e-4)


def test_many_queries_and_queries_without_vectors_behave_alike(spark):
    many = spark.range(6000).selectExpr("id as qid", "array(cast(id % 7 as double), 1D) as embedding")
    stored = spark.range(7).selectExpr("id", "array(cast(id as double), 1D) as embedding")
    found = nearest.nearest(many, stored, k=1)
    assert found.where("id = qid % 7 AND distance = 0").count() == 6000
    none = many.withColumn("embedding", F.lit(None).cast("array<double>"))
    assert nearest.nearest(none, stored, k=1).count() == 0


def test_unknown_metric(spark):
    q, v = frames(spark, [[1]], [[1]])
    with pytest.raises(ValueError):
        nearest.nearest(q, v, metric="other")


@pytest.fixture(scope="module")
def crowds(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 9)) + rng.integers(0, 6, (900, 1)) * 4
    vectors[100:160] = vectors[0]
    return frames(spark, [*(vectors[::40] + 0.01), None], [*vectors, None])


def test_approximate_recall(spark, crowds):
    q, v = crowds
    book = codes.fit(v)
    coded = codes.encode(v, book)
    assert {len(r.code) for r in coded.where("code IS NOT NULL").collect()} == {9}
    assert coded.where("code IS NULL").count() == 1
    row = codes.recall(codes.nearest_coded(q, coded, book, k=5), q, v, k=5).first()
    assert (row["queries"], row["wanted"]) == (23, 115) and row["recall"] >= 0.9
    whole = codes.nearest_coded(q, coded, book, k=5, short=200)
    assert listed(whole) == listed(nearest.nearest(q, v, k=5))


def test_codes_are_the_same_again(spark, crowds):
    _, v = crowds
    one, two = codes.fit(v), codes.fit(v.repartition(3))
    assert (one.centres == two.centres).all() and (one.rotation == two.rotation).all()
    square = one.rotation @ one.rotation.T
    assert np.allclose(square, np.eye(9))


def test_distances_from_codes(crowds):
    """Exact at the mean, and off by the product of the rest with the way to the row elsewhere."""
    _, v = crowds
    book = codes.fit(v)
    points = np.random.default_rng(2).normal(size=(20, 9)) * 5
    lines, length, lean = book.encode(points)
    decoded = np.stack([centres[line] for centres, line in zip(book.centres, lines.T, strict=True)], axis=1).reshape(20, -1)
    turned = points @ book.rotation
    mean = book.mean @ book.rotation.T
    for queries in (points, np.stack([mean, mean + 1e-9])):
        products, own, from_mean = book.tables(queries)
        near = own[:, None] + length + sum(table[:, column] for table, column in zip(products, lines.T, strict=True))
        rest = turned - decoded
        flat = queries @ book.rotation
        true = ((flat[:, None] - turned[None]) ** 2).sum(2)
        assert np.allclose(near, true + 2 * np.einsum("ijk,jk->ij", flat[:, None] - decoded[None], rest))
        assert np.allclose(from_mean, ((queries - mean) ** 2).sum(1))
    assert np.allclose(near[0] + lean, true[0])


def test_codes_of_nothing(spark, crowds):
    q, v = crowds
    none = v.where("false")
    assert codes.fit(none) is None
    assert codes.nearest_coded(q, none, None).count() == 0
    book = codes.fit(v.limit(3))
    assert codes.nearest_coded(q, codes.encode(none, book), book).count() == 0
    assert codes.nearest_coded(q.where("false"), codes.encode(v, book), book).count() == 0


def test_the_scan_of_codes_reads_no_vectors(spark, crowds, tmp_path):
    q, v = crowds
    book = codes.fit(v)
    codes.encode(v, book).write.parquet(str(tmp_path / "coded"))
    lists = codes.short_lists(q, spark.read.parquet(str(tmp_path / "coded")), book, 6)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,code:binary,code_length:double,code_lean:double>" in plan


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_search(spark, size):
    sf_dir = f"/root/testdata/{size}"
    stored = plans.vectors(spark, sf_dir)
    exact = listed(nearest.nearest(plans.approx_queries(spark, sf_dir), stored))
    near = listed(plans.knn_approx(spark, sf_dir))
    rows = {q for q in exact if q.startswith("vec_")}
    assert len(rows) == stored.where("id % 100 = 0").count() > 0 and len(exact) > len(rows)
    for asked in (rows, set(exact) - rows):
        # A row finds itself, so that only its other neighbours count.
        true = {q: {i for i in exact[q] if f"vec_{i}" != q} for q in asked}
        hits = sum(len(true[q] & set(near.get(q, []))) for q in asked)
        wanted = sum(map(len, true.values()))
        print(f"recall {size}, {len(asked)} queries: {hits} of {wanted}")
        assert hits >= 0.9 * wanted


@pytest.mark.parametrize("size, share", [("sf0.001", 0.18), ("sf0.01", 0.18), ("sf0.1", 0.1)])
def test_reported_recall(spark, size, share):
    """15 queries of 500 rows want 45 rows themselves, so small tables read a larger share."""
    row = plans.knn_approx_recall(spark, f"/root/testdata/{size}").first()
    assert row["recall"] >= 0.9 and row["hits"] <= row["wanted"]
    assert row["full_vectors"] <= share * row["rows"]


def test_parts_of_several_dimensions(spark, crowds, monkeypatch):
    monkeypatch.setattr(codes, "PART", 2)
    q, v = crowds
    book = codes.fit(v)
    coded = codes.encode(v, book)
    assert {len(r.code) for r in coded.where("code IS NOT NULL").collect()} == {5}
    assert codes.recall(codes.nearest_coded(q, coded, book, k=5, short=4), q, v, k=5).first()["recall"] >= 0.9


@pytest.mark.parametrize("metric", nearest.METRICS)
@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e8, 1e20])
def test_rows_ruled_out_by_single_precision(metric, scale):
    """Nearly equal distances, copies and lengths of all kinds, in batches of which the later ones have bounds."""
    pick = np.random.default_rng(5)
    queries, vectors = pick.normal(size=(7, 6)), pick.normal(size=(2000, 6))
    vectors[700:900] = vectors[0] + pick.normal(size=(200, 6)) * 1e-8  # closer together than single precision tells
    vectors[1500:1600] = vectors[0]
    queries[0] = vectors[0]
    queries, vectors, ids = queries * scale, vectors * scale, np.array([f"v{i:04d}" for i in range(2000)], dtype=object)
    best = nearest._Best(queries, 5, metric)
    for start in range(0, 2000, 600):
        best.add(ids[start : start + 600], vectors[start : start + 600])
    normed = (nearest._normed(queries), nearest._normed(vectors)) if metric == "cosine" else (queries, vectors)
    for i, query in enumerate(normed[0]):
        far = nearest._exact(np.tile(query, (2000, 1)), normed[1], metric)
        found = sorted((f, name) for row, f, name in zip(best.rows, best.far, best.ids) if row == i)
        assert found == sorted(zip(far, ids))[:5]


def test_most_rows_are_ruled_out_before_their_distances_are_sorted(monkeypatch):
    """Rows beyond the first ones are compared with a bound, not ranked."""
    pick, ranked = np.random.default_rng(6), []
    partition = np.partition
    monkeypatch.setattr(nearest.np, "partition", lambda block, *a, **b: ranked.append(block.size) or partition(block, *a, **b))
    best = nearest._Best(pick.normal(size=(20, 8)), 3, "l2sq")
    for start in range(0, 40_000, 10_000):
        best.add(np.arange(start, start + 10_000).astype(object), pick.normal(size=(10_000, 8)))
    assert sum(ranked) < 20 * 40_000 / 50


def test_later_rows_cost_one_product(monkeypatch):
    """Rows that no query keeps are ruled out by products in single precision, in small tiles: nothing is sorted."""
    pick, sorted_rows, tiles = np.random.default_rng(8), [], []
    best = nearest._Best(pick.normal(size=(300, 8)), 5, "l2sq")
    lexsort, matmul = np.lexsort, np.matmul
    monkeypatch.setattr(nearest.np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    monkeypatch.setattr(nearest.np, "matmul", lambda *a, out: tiles.append(out.size) or matmul(*a, out=out))
    monkeypatch.setattr(nearest, "_products", None)
    for start, away in ((0, 0.0), (10_000, 50.0), (20_000, 50.0)):
        best.add(np.arange(start, start + 10_000).astype(object), pick.normal(size=(10_000, 8)) + away)
        if not away:
            assert sorted_rows
            sorted_rows.clear()
    assert not sorted_rows
    assert sum(tiles) == 300 * 30_000 and max(tiles) <= nearest.TILE_ELEMENTS


@pytest.mark.parametrize("metric", nearest.METRICS)
@pytest.mark.parametrize("seeds", [1, 80, 4_000_000])
def test_first_bounds_alter_no_result(spark, points, metric, seeds, monkeypatch):
    """With fewer first rows than wanted ones, with some, and with all, among them a crowd of copies."""
    monkeypatch.setattr(nearest, "SEED_ELEMENTS", seeds)
    monkeypatch.setattr(nearest, "SEED_QUERIES", 2)
    q, v = frames(spark, *points)
    assert listed(nearest.nearest(q, v.repartition(3), k=4, metric=metric)) == brute(*points, 4, metric)
    q, v = q.withColumn("box", F.lit("one")), v.withColumn("box", F.when(F.substring("id", 4, 2) < "50", "one"))
    own = [None if x is None or i % 100 >= 50 else x for i, x in enumerate(points[1])]
    assert listed(nearest.nearest_in_group(q, v, "box", k=4, metric=metric)) == brute(points[0], own, 4, metric)


def test_tasks_put_out_only_rows_within_the_first_bounds(spark, monkeypatch):
    """The rows that leave the scan do not grow with the number of tasks."""
    pick, ranked, left = np.random.default_rng(9), nearest._ranked, []
    q, v = frames(spark, pick.normal(size=(30, 4)), pick.normal(size=(600, 4)))
    monkeypatch.setattr(nearest, "_ranked", lambda found, *a: left.append(found.count()) or ranked(found, *a))
    few = listed(nearest.nearest(q, v.repartition(2), k=5))
    many = listed(nearest.nearest(q, v.repartition(40), k=5))
    assert few == many and left == [30 * 5, 30 * 5]


def test_bounded_queries_look_at_few_rows(monkeypatch):
    """With first bounds, products are made in tiles of few stored rows, and only rows within the bounds are compared."""
    pick, tiles, compared = np.random.default_rng(10), [], []
    queries, vectors = pick.normal(size=(300, 8)), pick.normal(size=(30_000, 8))
    first = nearest._Best(queries, 5, "l2sq")
    first.add(np.arange(3_000).astype(object), vectors[:3_000])
    matmul, exact = np.matmul, nearest._exact
    monkeypatch.setattr(nearest.np, "matmul", lambda *a, out: tiles.append(out.shape) or matmul(*a, out=out))
    monkeypatch.setattr(nearest, "_exact", lambda q, v, m: compared.append(len(q)) or exact(q, v, m))
    best = nearest._Best(queries, 5, "l2sq", first.bound)
    for start in range(0, 30_000, 10_000):
        best.add(np.arange(start, start + 10_000).astype(object), vectors[start : start + 10_000])
    assert sum(rows * columns for rows, columns in tiles) == 300 * 30_000
    assert max(columns for _, columns in tiles) <= nearest.TILE_ROWS
    assert sum(compared) < 300 * 5 * 20
    whole = nearest._Best(queries, 5, "l2sq")
    whole.add(np.arange(30_000).astype(object), vectors)
    assert sorted(zip(best.rows, best.far, best.ids)) == sorted(zip(whole.rows, whole.far, whole.ids))


def test_a_search_of_codes_sends_no_tables(spark, monkeypatch):
    """A query's table takes hundreds of times its own room: it is made a block at a time, in the tasks."""
    pick = np.random.default_rng(7)
    q, v = frames(spark, pick.normal(size=(50, 4)), pick.normal(size=(300, 4)))
    book = codes.fit(v)
    coded = codes.encode(v, book)
    before = sorted(map(tuple, codes.short_lists(q, coded, book, 6).collect()))
    monkeypatch.setattr(codes.Codes, "tables", None)
    made = []
    products = codes.Codes.products
    monkeypatch.setattr(codes.Codes, "products", lambda self, turned: made.append(len(turned)) or products(self, turned))
    monkeypatch.setattr(codes.exact, "BLOCK_ELEMENTS", 4 * 256 * 8)
    best = codes._Short(book, book._parts(pick.normal(size=(50, 4))), 6)
    rows = coded.toArrow()
    lines = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(300, -1)
    best.add_codes(np.array(rows["id"].to_pylist(), dtype=object), lines, rows["code_length"].to_numpy(), rows["code_lean"].to_numpy())
    assert max(made) <= 8 and sum(made) == 50
    assert sorted(map(tuple, codes.short_lists(q, coded, book, 6).collect())) == before
