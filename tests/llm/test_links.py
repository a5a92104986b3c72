"""Near-duplicate operators against brute force."""

import itertools
import random

import numpy as np
import xxhash

from plumbago.llm import embeddings, graph, simhash


def closure(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_few_links_are_few_files(spark, monkeypatch):
    files = []
    monkeypatch.setattr(graph, "table", lambda df, *rows, put=graph.table: (out := put(df, *rows), files.append(len(out.inputFiles())))[0])
    monkeypatch.setattr(graph, "drop", lambda *tables: None)
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("40", "false")):
            spark.conf.set(k, v)
        got = graph.components(edges).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r.node: r.component for r in got} == dict.fromkeys(range(301), 0)
    # all but the first, whose number of links isn't known before: one a core
    assert max(files[1:]) <= spark.sparkContext.defaultParallelism


def test_components_without_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_trie_links_are_all_links(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << k
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 1 << 63, 7}
    fps = sorted(fps)
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    want = closure(fps, links)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    for rows in (20000, 30):  # whole tries in one task; many subtrees and blocks
        got = simhash.links(df, 3, rows).collect()
        pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in got]
        assert closure(fps, pairs) == want


def test_simhash_odd_rows(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    fp = [fingerprint(r.text) for r in rows]
    got = simhash.near_duplicates(odd_docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r.doc_id), f"{f:016x}") for r, f in zip(rows, fp))
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[6] == 3 and by[5] == 5
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted([1, 3, 5, 5, 7, 8])
    assert simhash.near_duplicates(odd_docs.limit(0)).collect() == []


def test_similar_documents_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(400)]
    texts = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = closure(range(len(texts)), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (20000, 40):
        got = simhash.near_duplicates(df, words=5, similarity=0.8, cell_rows=rows).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_similar_texts_share_a_prefix_shingle():
    rng = random.Random(4)
    counts = np.random.default_rng(4).integers(0, 9, simhash.SKETCH)
    for _ in range(300):
        w = [str(rng.randrange(60)) for _ in range(rng.randint(1, 60))]
        v = list(w)
        for _ in range(rng.randint(0, 3)):
            v[rng.randrange(len(v))] = "other"
        text, h, size = simhash.shingle_sets([" ".join(w).encode(), " ".join(v).encode()], 5)
        x, y = set(h[text == 0].tolist()), set(h[text == 1].tolist())
        at, p, rank = simhash.prefixes(text, h, size, counts, 0.8)
        if 5 * len(x & y) >= 4 * len(x | y):
            a, b = (dict(zip(p[at == k].tolist(), rank[at == k].tolist())) for k in (0, 1))
            first = min(set(a) & set(b), key=a.get)
            assert a[first] == min(a[c] for c in x & y if c in a) and b[first] == min(b[c] for c in x & y if c in b)
            # early in the smaller set, and enough shingles left in both for the bound of the join
            fewer, i = min((size[0], a[first]), (size[1], b[first]))
            assert fewer - i >= 1.6 / 1.8 * fewer - 1e-9
            assert min(size[0] - a[first], size[1] - b[first]) >= 0.8 / 1.8 * size.sum() - 1e-9


def test_one_shingle_in_many_different_texts(spark):
    """A shingle that many dissimilar texts share links none of them; similar ones among them link."""
    texts = []
    for g in range(60):
        w = ["same"] * 3 + [f"g{g}w{k}" for k in range(3)]
        texts += [" ".join(w), " ".join(w)] if g % 3 else [" ".join(w)]
    texts += ["same same same same same", "same same same same same same"]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(df, words=5, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == closure(range(len(texts)), links)


def test_similar_odd_rows(spark, odd_docs):
    kept = simhash.deduplicate(odd_docs, words=5, similarity=0.8)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted([1, 3, 5, 5, 7, 8])
    assert simhash.deduplicate(odd_docs.limit(0), words=5, similarity=0.8).collect() == []


def test_vectors_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        for _ in range(40):
            rows.append((len(rows), c % 2, (centre + rng.normal(size=16) * rng.choice([0.02, 0.06, 0.4])).tolist()))
    rows += [(len(rows) + i, lab, v) for i, (lab, v) in enumerate([(None, rows[0][2]), (0, None), (0, [0.0] * 16), (0, [float("nan")] * 16), (0, [None] * 16), (0, []), (0, rows[0][2]), (0, rows[0][2][:8])])]
    rows.append((None, 0, rows[0][2]))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumnRenamed("vec_id", "vec_id")

    def good(r):
        return r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])

    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a], rows[b]
        if good(x) and good(y) and x[1] == y[1] and len(x[2]) == len(y[2]):
            u, v = np.array(x[2]), np.array(y[2])
            if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links.append((a, b))
    n = np.bincount([i for p in links for i in p], minlength=len(rows))
    comp = closure(range(len(rows)), links)
    for size in (2000, 25):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, 0.98, cell_rows=size).collect()}
        for i, r in enumerate(rows):
            if r[0] is not None:
                assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], comp[i], comp[i] == i), i
        assert got[None].n_links == n[len(rows) - 1] and got[None].component_id == 0 and not got[None].kept
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_similar_documents_beyond_the_budget(spark):
    rng = random.Random(5)
    texts = []
    for g in range(150):
        w = [f"g{g}w{rng.randrange(10**6)}" for _ in range(50)]
        texts += [" ".join(w), " ".join([*w[:25], "other", *w[26:]])]
    far = [g for g in range(150) if (simhash.fingerprint(texts[2 * g].encode(), 5) ^ simhash.fingerprint(texts[2 * g + 1].encode(), 5)).bit_count() > 11]
    assert far
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(df, words=5, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(300)}


def test_hubs_meet_once_over_a_shared_passage(spark):
    """Texts that share a passage make one row a pair, not one a shingle or from each side, and no pair is lost."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rng, rows = random.Random(9), []
    for t in range(40):
        h = sorted({*range(50, 62), *rng.sample(range(1000), 8)} if t % 2 else rng.sample(range(70), 9))
        rows += [(x, t, 60, i, i < 6, t // 3, t % 5 > 0) for i, x in enumerate(h)]
    df = spark.createDataFrame(rows, "h long, th long, n long, i long, early boolean, component long, now boolean")
    near = lambda n, i, m, j: F.least(n - i, m - j) >= F.lit(0.8 / 1.8) * (n + m) - 1e-9
    earlier = F.array(*[F.lag("h", k).over(Window.partitionBy("th").orderBy("i")) for k in range(1, simhash.EARLIER + 1)])
    got = [tuple(sorted((r.a, r.th))) for r in simhash._meetings(df.withColumn("earlier", earlier), near).collect()]
    every = [
        (a[1], b[1]) for a in rows for b in rows
        if a[0] == b[0] and a[1] < b[1] and a[5] != b[5] and (a[6] or b[6]) and (a[4] or b[4]) and min(60 - a[3], 60 - b[3]) >= 0.8 / 1.8 * 120 - 1e-9
    ]
    assert set(got) == set(every)
    assert len(got) < 1.2 * len(set(every)) < len(every) / 2
