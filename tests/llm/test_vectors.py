"""Near duplicates, neighbours, clusters and subsets against brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vectrine.llm import ballhash as B
from vectrine.llm import knn as K
from vectrine.llm.components import components
from vectrine.llm.coverage import varied_subset
from vectrine.llm.linkage import described_clusters, linked_clusters, merge_rounds
from vectrine.llm.tree import Tree, unit

WIDTH = 24


def made(seed=0, groups=12, each=40, noise=60):
    """Vectors in groups of similarity about 0.9, single ones, near copies, exact copies and stretched ones."""
    rng = np.random.default_rng(seed)
    c = unit(rng.standard_normal((groups, WIDTH)))
    x = np.concatenate([unit(g + 0.065 * rng.standard_normal((each, WIDTH))) for g in c] + [unit(rng.standard_normal((noise, WIDTH)))])
    near = unit(x[:30] + 0.004 * rng.standard_normal((30, WIDTH)))
    return np.concatenate([x, near, x[100:104], 3 * x[200:204]]).astype(np.float32)


def table(spark, x, extra=True):
    rows = [(f"v{i:04d}", v.tolist(), f"m{i}", 1, "q", 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, vector array<float>, metadata string, leaf int, shelf string, key int").repartition(3)


def cosines(x):
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    return y @ y.T


@pytest.fixture(scope="module")
def data(spark):
    x = made()
    return x, table(spark, x).cache(), cosines(x)


def ids(i):
    return f"v{i:04d}"


def empty(spark):
    return spark.createDataFrame([], "id string, vector array<float>, metadata string")


# near duplicates


def test_near_pairs(data):
    x, df, s = data
    expected = {(ids(i), ids(j)) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.99}
    found = [tuple(r) for r in B.near_pairs(df, WIDTH).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) >= 38


def test_near_groups(spark, data):
    x, df, s = data
    found = {r.id: r for r in B.near_groups(df, WIDTH).collect()}
    assert len(found) == len(x)
    for i in range(len(x)):
        like = [j for j in range(len(x)) if s[i, j] >= 0.99]
        assert found[ids(i)].group_id == found[ids(min(like))].group_id <= ids(min(like))


def test_many_copies_make_no_pairs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.standard_normal((1, WIDTH)), 400, 0), rng.standard_normal((200, WIDTH))]).astype(np.float32)
    records = B.keyed(table(spark, x), WIDTH)
    assert B.candidates(records.select("key", "raw"), WIDTH, len(x), 0.99).isEmpty()
    groups = {r.id: r.group_id for r in B.near_groups(table(spark, x), WIDTH).collect()}
    assert {groups[ids(i)] for i in range(400)} == {ids(0)} and len(groups) == 600


def test_buckets_with_lead_bits(data):
    x, df, s = data
    records = B.keyed(df, WIDTH)
    one = B.candidates(records.select("key", "raw"), WIDTH, len(x), 0.99)
    cut = B.candidates(records.select("key", "raw"), WIDTH, len(x), 0.99, bucket_rows=32)
    assert set(map(tuple, one.collect())) == set(map(tuple, cut.collect()))


def test_hot_buckets_are_cut(spark, monkeypatch):
    """Most vectors are near copies of one, so a bucket of each band holds them all; copies are paired over several salts."""
    rng = np.random.default_rng(3)
    x = np.concatenate([unit(rng.standard_normal((1, WIDTH))) + 0.002 * rng.standard_normal((120, WIDTH)), rng.standard_normal((60, WIDTH))]).astype(np.float32)
    x = np.concatenate([x, x[:1].repeat(20, 0)])
    s, plain = cosines(x), B.candidates
    monkeypatch.setattr(B, "COPIES", 4)
    monkeypatch.setattr(B, "candidates", lambda v, w, n, least: plain(v, w, n, least, bucket_rows=20))
    pairs = B.pairs_of_parts
    assert {p for p, _ in pairs(np.array([(k, 0, 0, (0, 0)) for k in range(40)], B.CODE), 3)} == {0, 1, 2, (1 << 16) | 1, (1 << 16) | 2, (2 << 16) | 2}
    expected = {(ids(i), ids(j)) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.99}
    found = [tuple(r) for r in B.near_pairs(table(spark, x), WIDTH).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 9000


def test_runs_are_all_pairs():
    key = np.array([1, 1, 1, 2, 3, 3])
    got = {(int(a), int(b)) for i, j in B.runs(key) for a, b in zip(i, j)}
    assert got == {(0, 1), (0, 2), (1, 2), (4, 5)}


def test_no_vectors(spark):
    for f in (B.near_pairs, B.near_groups, linked_clusters, described_clusters):
        assert f(empty(spark), WIDTH).isEmpty()
    assert varied_subset(empty(spark), 5, WIDTH).isEmpty()
    one = spark.createDataFrame([("a", [1.0] * WIDTH, None)], "id string, vector array<float>, metadata string")
    assert B.near_pairs(one, WIDTH).isEmpty() and linked_clusters(one, WIDTH).isEmpty()
    assert [r.id for r in varied_subset(one, 5, WIDTH).collect()] == ["a"]


# components


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 230)] + [(300, i) for i in range(301, 340)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([*edges, (5, None), *edges[:3]], "a bigint, b bigint")
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    for hot in (10, 100_000):  # a star of 39 is spread, or not
        assert {r.node: r.label for r in components(df, hot=hot).collect()} == {n: x for n, x in label.items() if n not in alone}
    assert components(df.limit(0)).isEmpty()


# neighbours


def test_tree_visits_every_leaf(data):
    t = Tree(unit(data[0]), 16)
    for order in t.best_bins(unit(data[0][:5]), t.leaves):
        assert sorted(order) == list(range(t.leaves))
    own = t.assign(unit(data[0]))
    assert own.min() >= 0 and own.max() < t.leaves and len(t.directions()) == t.leaves


def asked(df, k=8):
    return df.select(F.col("id").alias("query"), F.col("id").alias("own"), F.lit(k).alias("k"), K.raw_bytes("vector").alias("raw"))


def test_recall_of_neighbours(data):
    x, df, s = data
    found: dict = {}
    for r in K.nearest(df, asked(df), WIDTH, 8).collect():
        found.setdefault(r.query, set()).add(r.id)
    hits = 0
    for i in range(len(x)):
        true = sorted((-round(s[i, j], 12), ids(j)) for j in range(len(x)) if j != i)[:8]
        assert len(found[ids(i)]) == 8 and ids(i) not in found[ids(i)]
        hits += len({j for _, j in true} & found[ids(i)])
    assert hits / len(x) / 8 >= 0.97


def test_hot_leaves_are_spread_without_loss(data):
    x, df, _ = data
    tree, rows = K.fit(df, WIDTH)
    base = K.placed(df, tree, WIDTH)
    plain, spread = K.build(base, tree, WIDTH, rows), K.build(base, tree, WIDTH, rows, shelf_rows=10)
    assert spread.salts.max() > 1 and spread.shelves > plain.shelves
    q = asked(df.where("id < 'v0040'"))
    a, b = (sorted((r.query, r.id, r.n) for r in K.search(base, q, i, tree.leaves).collect()) for i in (plain, spread))
    assert a == b and len(a) == 40 * 8


def peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_does_not_follow_leaves_and_shelves():
    """A block of queries over a whole shelf, and a batch of them over a tree of thousands of leaves, beside the result itself."""
    rng = np.random.default_rng(5)
    s = rng.standard_normal((2048, 8192), np.float32)
    assert peak_mb(lambda: K.top_of(s, 14)) < 80
    tree = Tree(unit(rng.standard_normal((6_000, WIDTH))), 4)
    q = unit(rng.standard_normal((4096, WIDTH)))
    assert tree.leaves > 1500 and peak_mb(lambda: tree.best_bins(q, 1)) < 60
    index = K.Index(tree, WIDTH, 10**7, np.arange(tree.leaves) * 2, np.full(tree.leaves, 2))  # each leaf has two shelves
    b = pd.DataFrame({"query": np.arange(100), "own": "v", "k": 8, "raw": [v.tobytes() for v in q[:100]]})
    frames = list(K.routed(b, index, 400, np.ones(index.shelves, np.int64)))
    assert max(map(len, frames)) <= K.ROUTE_ROWS and len(pd.concat(frames)[["query", "shelf"]].drop_duplicates()) == sum(map(len, frames)) == 100 * 800


def test_products_by_pieces(monkeypatch):
    """Ties are taken in order, and pieces find what one product finds."""
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (300, WIDTH)).astype(np.float32)  # products are exact
    x[100:200] = x[:100]
    whole = K.top_pairs(x, x, 9, own=0)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    i, j = np.nonzero(np.argsort(np.argsort(-s, 1, "stable"), 1, "stable") < 9)
    monkeypatch.setattr(K, "PIECE", 2100)
    for got in (whole, K.top_pairs(x, x, 9, own=0)):
        assert len(got[0]) == 300 * 9 and np.array_equal(got[0], i) and np.array_equal(np.sort(got[2]), np.sort(s[i, j]))
        assert np.array_equal(got[1], j)
    assert len(K.top_pairs(x[:0], x, 9)[0]) == 0


def test_ties_and_repeated_queries(spark):
    x = np.array([[1, 0], [1, 0], [1, 0], [0, 1], [2, 0]], np.float32)
    df = table(spark, x)
    q = asked(df, 2)
    found = sorted((r.query, r.n, r.id) for r in K.nearest(df, q.unionByName(q), 2, 2).collect())
    assert found[:2] == [("v0000", 1, "v0001"), ("v0000", 2, "v0002")] and len(found) == 10
    assert K.nearest(df, q.limit(0), 2, 2).isEmpty()


def true_neighbours(s, i, k):
    return [j for _, j in sorted((-round(s[i, j], 9), ids(j)) for j in range(len(s)) if j != i)[:k]]


@pytest.mark.parametrize("shelf_rows", [20, 60, 8192])
def test_neighbours_of_every_row(data, monkeypatch, shelf_rows):
    """Over one shelf, over many, and with leaves divided again."""
    x, df, s = data
    monkeypatch.setattr(K, "BIN_ROWS", 10)
    plain = K.neighbours_of_different
    monkeypatch.setattr(K, "neighbours_of_different", lambda v, w, k, t: plain(v, w, k, t, shelf_rows=shelf_rows))
    found: dict = {}
    for r in K.neighbours_of_all(df, WIDTH, 8).collect():
        found.setdefault(r.query, []).append((r.n, r.id))
    assert len(found) == len(x) and all([n for n, _ in sorted(f)] == list(range(1, 9)) for f in found.values())
    hits = sum(len({j for _, j in found[ids(i)]} & set(true_neighbours(s, i, 8))) for i in range(len(x)))
    assert hits / len(x) / 8 >= (1.0 if shelf_rows == 8192 else 0.99)


def test_a_large_leaf_is_divided(data):
    x, df, _ = data
    tree = Tree(unit(x), 10**6)
    base = K.placed(df, tree, WIDTH)
    bins = K.divided(base, tree, WIDTH, len(x), 100)
    shelved = K.binned(base, bins, 100)
    assert tree.leaves == 1 and len(bins.directions) > 1
    rows = shelved.groupBy("shelf").count().collect()
    assert sum(r["count"] for r in rows) == len(x) and len(rows) > 3


def test_neighbours_among_many_copies(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.standard_normal((1, WIDTH)), 300, 0), rng.standard_normal((90, WIDTH))]).astype(np.float32)
    s = np.round(cosines(x), 9)
    found: dict = {}
    for r in K.neighbours_of_all(table(spark, x), WIDTH, 5).collect():
        found.setdefault(r.query, []).append((r.n, r.id))
    assert {q: [j for _, j in sorted(f)] for q, f in found.items()} == {ids(i): true_neighbours(s, i, 5) for i in range(len(x))}
    assert K.neighbours_of_all(table(spark, x[:3]), WIDTH, 5).count() == 6 and K.neighbours_of_all(table(spark, x[:1]), WIDTH, 5).isEmpty() and K.neighbours_of_all(empty(spark), WIDTH, 5).isEmpty()


# clusters


def exact_clusters(s, least):
    label = list(range(len(s)))
    for i in range(len(s)):
        for j in np.flatnonzero(s[i] >= least):
            a, b = label[i], label[j]
            if a != b:
                low, high = min(a, b), max(a, b)
                label = [low if x == high else x for x in label]
    return label


def test_linked_clusters(data):
    x, df, s = data
    label = exact_clusters(s, 0.74)
    expected = {ids(i): ids(label[i]) for i in range(len(x)) if label.count(label[i]) > 1}
    assert {r.id: r.cluster_id for r in linked_clusters(df, WIDTH).collect()} == expected


def test_clusters_over_many_shelves(data, monkeypatch):
    from vectrine.llm import linkage

    x, df, s = data
    label = exact_clusters(s, 0.74)
    c = linkage.Clusters(df, WIDTH, 0.74, shelf_rows=60)
    found = {r.id: r.cluster_id for r in c.assigned(connected=True).collect()}
    assert found == {ids(i): ids(label[i]) for i in range(len(x))}


def test_a_single_link_between_shelves_is_found(spark, monkeypatch):
    """Two large clusters over many shelves of a hot leaf, connected by one pair of points."""
    from vectrine.llm import linkage

    rng = np.random.default_rng(8)
    e = np.eye(WIDTH)
    x = np.concatenate([c + 0.03 * rng.standard_normal((400, WIDTH)) for c in e[:2]] + [[0.8 * e[0] + 0.6 * e[1]], [0.3 * e[0] + 0.9 * e[1] + 0.3 * e[2]]]).astype(np.float32)
    s = cosines(x)
    assert (s[:400, 400:800] < 0.74).all() and (s[800, 400:800] < 0.74).all() and (s[801, :400] < 0.74).all() and s[800, 801] >= 0.74
    monkeypatch.setattr(linkage, "fit", lambda usable, width: K.fit(usable, width, leaf_rows=10**6))
    c = linkage.Clusters(table(spark, x), WIDTH, 0.74, shelf_rows=200)
    assert {r.cluster_id for r in c.assigned(connected=True).collect()} == {"v0000"}


def test_blocks_hold_every_part_once(spark):
    from vectrine.llm import linkage

    sums = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate([9] * 3 + [5] * 40 + [1] * 500)], "cluster string, n bigint")
    found = linkage.blocks(sums, 100)
    inside = [sums.where(F.col("n").between(low, high) & (F.pmod(F.xxhash64("cluster"), F.lit(salts)) == salt)).count() for low, high, salt, salts in found]
    assert sum(inside) == 543 and len(found) == 6 and max(inside) <= 150


def slow_linkage(x, least):
    """Merges of the best pair of all, one at a time; averages over all pairs of members."""
    s, groups = unit(x).astype(float) @ unit(x).astype(float).T, [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = max((s[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] < least:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_averages_count_pairs_without_a_link():
    from vectrine.llm import linkage

    rng = np.random.default_rng(3)
    for _ in range(20):
        x = unit(np.eye(6)[0] + 0.35 * rng.standard_normal((24, 6)))
        label = linkage.chain_merges(x.astype(float), np.ones(len(x), int), 0.74)
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)} == slow_linkage(x, 0.74)


def test_a_stray_of_one_part_does_not_join_the_hub(spark):
    """A stray is like one of three parts of a hub, at 0.8, and not like the hub on average."""
    from vectrine.llm import linkage

    angles = np.deg2rad([0, 2, -8, -10, -12, -14, 37])
    x = np.stack([np.cos(angles), np.sin(angles)], 1)
    total = np.stack([x[:2].sum(0), x[2:4].sum(0), x[4:6].sum(0), x[6]])
    sums = spark.createDataFrame([(c, t.tobytes(), n, i, 0.1) for i, (c, t, n) in enumerate(zip("abcd", total, (2, 2, 2, 1)))], "cluster string, sum binary, n bigint, shelf int, radius double")
    near = linkage.near_parts(sums, 0.74)
    pairs = {(min(r.a, r.b), max(r.a, r.b)): r.average for r in near.collect()}
    assert set(pairs) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")}
    assert {(r.a, r.b) for r in linkage.average_merges(near, sums, 0.74).collect()} == {("a", "b"), ("a", "c")}


def test_a_hub_takes_any_number_of_satellites():
    """Each has the hub as its best partner, and none is like another: one merge a round in rounds of mutual best pairs."""
    from vectrine.llm import linkage

    x = np.zeros((151, 152))
    x[:, 0], x[0, 0] = 0.85, 10_000
    x[np.arange(1, 151), np.arange(1, 151)] = np.sqrt(1 - 0.85**2)
    assert set(linkage.chain_merges(x, np.r_[10_000, np.ones(150, int)], 0.74)) == {0}


def test_average_linkage_merges_the_mutual_best_first():
    x = unit(np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1], [-1, -1]], float))
    label, total, n = merge_rounds(x, 0.9)
    assert label[0] == label[1] and label[2] == label[3] and len(n) == 3 and total.shape == (3, 2)
    same, _, n = merge_rounds(np.repeat(x[:1], 6, 0), 0.9)
    assert set(same) == {0} and n.tolist() == [6]


def test_described_clusters(data):
    x, df, s = data
    found = described_clusters(df, WIDTH).collect()
    by: dict = {}
    for r in found:
        by.setdefault(r.cluster_id, []).append(r)
    for cluster in by.values():
        cluster.sort(key=lambda r: r.place)
        assert [r.place for r in cluster] == list(range(1, len(cluster) + 1)) and len(cluster) == min(3, cluster[0].size)
        assert all(a.closeness >= b.closeness - 1e-12 for a, b in zip(cluster, cluster[1:])) and cluster[0].metadata == f"m{int(cluster[0].id[1:])}"


# subsets


@pytest.mark.parametrize("size", [1, 20, 60, 10_000])
def test_subset_has_the_size(data, size):
    x, df, _ = data
    found = [r.id for r in varied_subset(df, size, WIDTH).collect()]
    assert len(found) == len(set(found)) == min(size, len(x))


def test_subset_covers_every_group_and_curbs_large_ones(spark):
    rng = np.random.default_rng(4)
    c = unit(rng.standard_normal((10, WIDTH)))
    sizes = [600, 100, 40, 40, 20, 20, 10, 10, 5, 5]
    x = np.concatenate([unit(g + 0.05 * rng.standard_normal((n, WIDTH))) for g, n in zip(c, sizes)]).astype(np.float32)
    group = np.repeat(np.arange(10), sizes)
    picks = np.bincount([group[int(r.id[1:])] for r in varied_subset(table(spark, x), 40, WIDTH).collect()], minlength=10)
    assert (picks > 0).all() and picks[0] <= 16 and picks.sum() == 40


def test_subset_of_equal_vectors(spark):
    df = table(spark, np.ones((50, WIDTH), np.float32))
    assert varied_subset(df, 7, WIDTH).count() == 7 and varied_subset(df, 0, WIDTH).isEmpty()


def test_subset_does_not_depend_on_the_layout(spark, data):
    x, df, _ = data
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts, shuffles, pieces in ((1, "3", "128m"), (7, "16", "4k"), (40, "5", "64m")):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            spark.conf.set("spark.sql.files.maxPartitionBytes", pieces)
            found.append(sorted(tuple(r) for r in varied_subset(df.repartition(parts), 60, WIDTH, pack_rows=100).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2] and len(found[0]) == 60


def test_threshold_rounds_come_close_to_greedy(spark, data):
    from vectrine.llm import coverage as C

    x, df, _ = data
    tree, _ = K.fit(df, WIDTH, leaf_rows=C.LEAF_ROWS, alike=C.ALIKE)
    feature, mass = C.Features(tree, WIDTH)(unit(x))
    mass = mass / C.UNIT
    total = np.bincount(feature.ravel(), mass.ravel())
    weight = total**C.POWER

    def worth(rows):
        return (weight * np.sqrt(np.bincount(feature[rows].ravel(), mass[rows].ravel(), len(total)))).sum()

    greedy, state = [], np.zeros(len(total))
    for _ in range(60):
        g = C.gains(weight, state, feature, mass)
        g[greedy] = -1
        greedy.append(int(g.argmax()))
        np.add.at(state, feature[greedy[-1]], mass[greedy[-1]])
    found = [int(r.id[1:]) for r in varied_subset(df, 60, WIDTH).collect()]
    assert worth(found) >= 0.95 * worth(greedy)


def test_cut_of_equal_gains(spark):
    from vectrine.llm import coverage as C

    rows = spark.createDataFrame([(f"a{i}", float(i % 3)) for i in range(900)], "id string, gain float")
    for most in (0, 1, 299, 300, 301, 650, 900, 1000):
        found = C._cut(rows, most, few=5).collect()
        assert len({r.id for r in found}) == len(found) == min(most, 900) and sorted(r.gain for r in found) == sorted((float(i % 3) for i in range(900)), reverse=True)[: len(found)][::-1]
