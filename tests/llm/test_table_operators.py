"""URL rules, nearest neighbours, the classifier, components, groups of similar texts, the pipeline, and odd inputs to all."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import annindex, bpe, decontam, htmltext, pii, quality, queries, simhash, similar, suffixdedup, tokencount, urlfilter
from umbra.llm.common import components

P = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"


def test_url_rules(spark):
    urls = {
        1: ("http://example.org/es/x", "block", "example.org/es/"), 2: ("https://A.Example.org/en/12?q", "block", "example.org/en/1"), 3: ("http://example.org", "allow", None),
        4: ("http://x.com/de/", "block", "com/de/"), 5: ("http://xcom/de/", "allow", None), 6: ("http://x.com/fr/casino", "allow", "com/fr/"), 7: ("http://my.casino-win.net/a", "block", None),
        8: (None, "allow", None), 9: ("no scheme", "allow", None), 10: ("http://casinos.net/", "allow", None), 11: ("http://notexample.org/es/", "allow", "org/"), 12: ("http://x.com:80/de/", "allow", None),
    }
    df = spark.createDataFrame([(i, u[0], "z") for i, u in urls.items()] + [(1, urls[1][0], "z")], "page_id long, url string, token string")
    rows = urlfilter.judge(df).collect()
    assert len(rows) == len(urls) + 1
    assert {r.page_id: (r.verdict, r.rule) for r in rows} == {i: u[1:] for i, u in urls.items()}
    assert {r.page_id: r.host for r in rows}[2] == "a.example.org" and {r.page_id: (r.host, r.path) for r in rows}[9] == ("", "")


def test_rules_lie_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://cheap-x.net/",), ("http://cheap-y.net/",), ("http://pills.net/",)], "url string")
    index = {r.rule: r.token for r in urlfilter.rule_index(spark, df, urlfilter.PATTERN_RULES + (urlfilter.Rule("^cheap-pills^"), urlfilter.Rule("ad*s"))).collect()}
    assert index["^cheap-pills^"] == "pills" and index["^cheap-*pills^"] == "cheap" and index["ad*s"] == urlfilter.ANY


def test_patterns_of_rules(spark):
    """Anchors, wildcards, edges, exceptions and rules without a token against the same rules read one by one."""
    R = urlfilter.Rule
    rules = (R("|http://ads."), R(".gif|"), R("^track*id=^"), R("ad*s"), R("^Shop^", "allow"), R("||cdn.net/a*/x", "allow"), R("||cdn.net/"), R("||cdn.net"), R("banner^"))
    urls = ["http://ads.x.org/", "http://x.org/ads.", "http://x.org/a.gif", "http://x.org/a.gif?", "http://x.org/track/1?id=&x", "http://x.org/track1", "http://x.org/shop/ads", "http://q.cdn.net/abc/x", "http://cdn.net/b", "http://cdn.network/", "http://x.org/banner", "http://x.org/banners/A.GIF", "HTTP://ADS.x.org/SHOP", "plain", "", None]

    def verdict(url):
        low, rest = (url or "").lower(), (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        subject = re.match("[^?#]*", re.sub("^[^/?#]*", lambda m: m[0].lower(), rest))[0]
        sites = [r for r in rules if r.is_site and re.search(r.regex, subject)]
        others = {r.verdict for r in rules if not r.is_site and url is not None and re.search(r.regex, low)}
        best = max(sites, key=lambda r: (len(r.name), r.name), default=None)
        return (best.verdict if best else "allow" if "allow" in others or not others else "block"), best and best.name

    got = {r.page_id: (r.verdict, r.rule) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == {i: verdict(u) for i, u in enumerate(urls)}
    assert [got[i][0] for i in range(13)] == ["block", "block", "block", "allow", "block", "allow", "allow", "allow", "block", "block", "block", "block", "allow"]


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (150, 2))]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == find(x) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_reach_the_recall(spark):
    x = vectors(1500, 16, 0)
    x[300:700] = x[300]  # a large group of equal vectors
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, cell int")
    rows = annindex.search(df, block_rows=200).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r)
    y, hit = x.astype(float), 0
    assert set(by) == {i for i in range(1500) if i % 20 == 0}
    for q, found in by.items():
        score = y @ y[q]
        score[q] = -9
        order = np.lexsort((np.arange(1500), -score.round(12)))[:20]
        hit += len(set(order.tolist()) & {r.vec_id for r in found})
        assert [r.rank for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        assert [(r.score, -r.vec_id) for r in found] == sorted(((r.score, -r.vec_id) for r in found), reverse=True)
        assert all(r.score == pytest.approx(y[q] @ y[r.vec_id]) for r in found)
    assert hit >= 0.9 * 20 * len(by)
    tied = by[400]
    assert [r.vec_id for r in tied] == list(range(300, 320))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (3, [1.0]), (2, [0.9, 0.1]), (2, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in annindex.search(df).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 0] == [2, 2, 1] and {g[0] for g in got} == {0}
    assert annindex.search(df.limit(0)).count() == 0


def test_repeated_vectors_are_candidates_each(spark):
    """One id stands 25 times and is nearest; the query's own id stands three times with two vectors."""
    x = vectors(60, 8, 4).astype(float)
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(20, x[5].tolist())] * 2 + [(6, x[5].tolist())] * 24
    got = {}
    for r in annindex.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == {20, 40, 60} and all([r for r, _ in g] == list(range(1, 21)) for g in got.values())
    own = min(x[19].tolist(), x[5].tolist())
    score = [(-float(np.dot(own, v)), i) for i, v in rows if i != 20]
    assert [v for _, v in got[20]] == [i for _, i in sorted(score)[:20]]


def test_measured_share_reaches_the_recall():
    """On vectors with structure a small share is enough, without structure it is not."""
    rng = np.random.default_rng(1)
    loose = vectors(3000, 16, 6).astype(float)
    tight = np.repeat(vectors(60, 16, 7).astype(float), 50, axis=0) + rng.standard_normal((3000, 16)) * 0.02
    shares = []
    for x in (loose, tight):
        q = annindex.Quantiser(annindex.kmeans(x[:, :8], 16), annindex.kmeans(x[:, 8:], 16))
        shares.append(annindex.measured_share(x, q, len(x), 20, 0.95))
        sizes = np.bincount(q.cells(x), minlength=256)
        hit = 0
        for i in range(0, 3000, 100):
            cells = set(q.visit(x[i], sizes, int(np.ceil(shares[-1] * len(x)))))
            score = x @ x[i]
            score[i] = -9
            hit += sum(c in cells for c in q.cells(x[np.argsort(-score)[:20]]).tolist())
        assert hit >= 0.9 * 20 * 30
    assert 2 * shares[1] < shares[0]


def test_pairs_of_cells_come_by_distance():
    q = annindex.Quantiser(vectors(9, 4, 1), vectors(7, 4, 2))
    sizes = np.ones(63, np.int64)
    v = vectors(1, 8, 3)[0]
    order = q.visit(v, sizes, 63)
    cost = [-(q.first[c // 7] @ v[:4]) - (q.second[c % 7] @ v[4:]) for c in order]
    assert sorted(order) == list(range(63)) and all(a <= b + 1e-6 for a, b in zip(cost, cost[1:]))


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(2000):  # as many rated documents as the smallest table of the corpus has
        t = " ".join(rng.choice(words, rng.integers(20, 200)))
        grade = int(rng.choice([0, 1, 2], p=[0.15, 0.2, 0.65]))
        t = t + " vile awful" if grade == 0 else t.replace(" ", "### ") if grade == 1 else t
        docs.append((i, t, "en", 0.5))
        labels.append((i, int(grade == 2), int(grade == 0)))
    return docs, labels


def test_classifier_on_held_out_documents(spark, rated):
    docs, labels = rated
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string, p_best double")
    train = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, None, 0), (None, 1, 0), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.select(documents, train).collect()}
    held = [x for x in labels if x[0] % 2 == 0]
    share = lambda rows: sum(x[0] in kept for x in rows) / len(rows)
    good, poor, toxic = ([x for x in held if (x[1], x[2]) == g] for g in ((1, 0), (0, 0), (0, 1)))
    assert share(good) >= 0.97 and share(toxic) <= 0.02 and share(poor) <= 0.15


def test_classifier_on_odd_rows(spark, rated):
    """Repeated rows share a fate, null and empty texts get the prior grade, null ids are scored like others; labels may repeat."""
    docs, labels = rated
    schema = "doc_id long, text string, lang string, p_best double"
    odd = [(i, *docs[i][1:]) for i in (5, 5, 9)] + [(None, docs[5][1], None, None), (9001, None, None, 0.1), (9002, "", None, 0.1), (9003, docs[5][1], "x", None)]
    train = spark.createDataFrame([*labels, *labels[:50], (9001, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    whole = spark.createDataFrame([*docs, *odd], schema)
    model = quality.fit(quality.training_rows(whole, train, 6000))
    rows = quality.graded(spark.createDataFrame(odd, schema), model).collect()
    by = {}
    for r in rows:
        by.setdefault((r.text or None), set()).add((r.expected_grade, r.p_best))
    assert len(rows) == len(odd) and all(len(x) == 1 for x in by.values()) and len(by) == 3
    kept = quality.select(whole, train)
    assert kept.columns == ["doc_id", "text", "lang", "expected_grade", "p_best"] and kept.count() == quality.graded(whole, model).where("p_best >= 0.5").count()
    assert quality.select(whole.limit(0), train).count() == 0


def test_classifier_needs_two_grades(spark, rated):
    documents = spark.createDataFrame(rated[0][:5], "doc_id long, text string, lang string, p_best double")
    none = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.select(documents, none).count() == 5
    assert quality.select(documents, none.limit(0)).count() == 5


def test_repeated_labelled_documents_do_not_crowd_out_others(spark):
    """A toxic id that stands 60 times counts as one row, with the text of the smallest hash."""
    rows = [(i, f"good text number{i}") for i in range(20)] + [(100, "vile")] * 60 + [(100, "vile too")] + [(101, None), (101, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100, 0, 1), (100, 1, 0), (101, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, 22)
    assert sorted(g for g, _, _ in got) == [0, 1] + [2] * 20
    assert len(quality.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, 7)) == 7


def test_gradient_of_the_classifier():
    rng = np.random.default_rng(2)
    n, used = 40, rng.integers(0, 1 << quality.BITS, 30)
    row, column = np.repeat(np.arange(n), 4), rng.choice(used, 4 * n)
    shares, grade = rng.random((n, len(quality.SHAPES))), rng.integers(0, 3, n)
    w, theta = np.zeros((1 << quality.BITS) + len(quality.SHAPES)), np.array([-0.4, 0.7])
    w[used], w[-5:] = rng.standard_normal(30), rng.standard_normal(5)
    _, g, gt = quality.loss(w, theta, grade, row, column, shares)

    def slope(values, place):
        ends = []
        for step in (1e-5, -2e-5):
            values[place] += step
            ends.append(quality.loss(w, theta, grade, row, column, shares)[0])
        values[place] += 1e-5
        return (ends[0] - ends[1]) / 2e-5

    for place in [*used[:10].tolist(), *range(-5, 0)]:
        assert slope(w, place) == pytest.approx(g[place], abs=1e-7)
    assert [slope(theta, j) for j in (0, 1)] == pytest.approx(gt.tolist(), abs=1e-7)


def test_thresholds_are_ordered(rated):
    codes = quality.Codes()
    rows = []
    for (_, t, *_), (_, good, toxic) in zip(*rated):
        x, y = quality.features(t, codes)
        rows.append((0 if toxic else 2 if good else 1, x.astype(np.int32).tobytes(), y.tobytes()))
    model = quality.fit(rows)
    assert model.thresholds[0] < model.thresholds[1]
    low = model.at_most(np.array([-5.0, 0.0, 5.0]))
    assert (np.diff(low, axis=0) <= 0).all() and (low[:, 0] <= low[:, 1]).all()


@pytest.mark.parametrize("limit", [128, 4])
def test_groups_of_similar_texts(spark, limit):
    rng = np.random.default_rng(5)
    docs = []
    for _ in range(12):
        words = [f"t{w}" for w in rng.integers(0, 5000, 150)]
        for _ in range(int(rng.integers(1, 9))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = f"e{rng.integers(10**6)}"
            docs.append((len(docs) * 3 % 1000, " ".join(copy)))
    docs += [(2001, None), (2002, ""), (2003, "one two"), (2004, "ONE  two"), (None, "x"), (None, "x")]
    df = spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, node string")
    got = {r.doc_id: r.group for r in similar.groups(df, shard_limit=limit).collect()}
    named = [(d, set(similar.shingles(t, 5).tolist())) for d, t in docs if d is not None]
    root = {d: d for d, _ in named}
    for _ in named:
        for a, x in named:
            for b, y in named:
                if (not x and not y) or len(x & y) >= 0.8 * len(x | y) > 0:
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root
    left = similar.representatives(df, shard_limit=limit)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(set(root.values())) and left.where("doc_id IS NULL").count() == 2


def connected(sets, least=0.8):
    """Components by brute force over all pairs, as the smallest position."""
    names = sorted(set().union(*sets))
    held = np.zeros((len(sets), len(names)), np.float32)
    for i, x in enumerate(sets):
        held[i, np.searchsorted(names, sorted(x))] = 1
    both, size = held @ held.T, held.sum(1)
    near, root = both >= least * (size[:, None] + size[None, :] - both) - 1e-4, np.arange(len(sets))
    while True:
        low = np.where(near, root[None, :], len(sets)).min(1)
        if (low == root).all():
            return root.tolist()
        root = low


def test_templates_are_linked_completely(spark, monkeypatch):
    """Six one-word fields of ten values in 100 words: texts link where two fields at most differ, in crowded shards only."""
    rng = np.random.default_rng(8)
    texts = set()
    while len(texts) < 2500:
        words = [f"w{i}" for i in range(100)]
        for f in range(6):
            words[8 + 16 * f] = f"f{f}v{rng.integers(10)}"
        texts.add(" ".join(words))
    texts = sorted(texts)
    want = connected([set(similar.shingles(t, 5).tolist()) for t in texts])
    assert 1 < len(set(want)) < 400
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowd in (4096, 700):
        monkeypatch.setattr(similar, "CROWD", crowd, raising=False)
        got = {r.doc_id: r.group for r in similar.groups(df).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_short_copies_with_far_fingerprints(spark):
    """An eight-word text with a word added, 4 shingles within 5: pairs of fingerprints further apart than 18 bits."""
    rng, docs = np.random.default_rng(3), []
    while len(docs) < 40:
        words = [f"s{w}" for w in rng.integers(0, 10**6, 9)]
        pair = " ".join(words[:8]), " ".join(words)
        if (simhash.fingerprint(pair[0], 5) ^ simhash.fingerprint(pair[1], 5)).bit_count() > 18:
            docs += pair
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r.doc_id: r.group for r in similar.groups(df).collect()} == {i: i - i % 2 for i in range(40)}


def test_near_duplicates_by_fingerprints_and_by_sets(spark):
    """The pipeline's stage: links of fingerprints within two bits count, and those that fingerprints miss do too."""
    import corpus_pipeline as C

    rng = np.random.default_rng(6)
    words = lambda n: [f"n{w}" for w in rng.integers(0, 10**6, n)]
    chorus, tails = words(3) * 60, [words(20) for _ in range(3)]
    texts = [" ".join(chorus + t) for t in tails] + [" ".join(w[:cut]) for w in (words(9) for _ in range(12)) for cut in (9, 8)]
    texts += [texts[3], None, "", " ".join(words(50)), " ".join(words(50))]
    fps, sets = [simhash.fingerprint(t) for t in texts], [set(similar.shingles(t, 5).tolist()) for t in texts]
    assert all(len(sets[0] & x) < 0.8 * len(sets[0] | x) for x in sets[1:3]) and any((fps[i] ^ fps[i + 1]).bit_count() > 2 for i in range(3, 27, 2))
    root = list(range(len(texts)))
    for _ in root:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if (fps[a] ^ fps[b]).bit_count() <= 2 or (not x and not y) or len(x & y) >= 0.8 * len(x | y) > 0:
                    root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in C.near_duplicate_stage(spark, df, "").collect()) == sorted(set(root))
    for limit in (128, 2):
        assert {r.doc_id: r.group for r in similar.groups(df, shard_limit=limit, radius=2).collect()} == dict(enumerate(root))
    assert C.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def test_texts_that_share_an_id(spark):
    first, second = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    rows = [(1, first), (1, second), (1, second), (2, second + " more"), (3, first.upper()), (1, first + " end")]
    left = similar.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in left] == [1, 1] and {r.text for r in left} in ({first, second}, {first + " end", second})


def test_forest_against_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(60):
        pool = [rng.integers(0, 40, rng.integers(1, 14)) for _ in range(6)]
        sets = [set(p.tolist()) ^ set(rng.integers(0, 40, rng.integers(0, 3)).tolist()) for p in pool for _ in range(12)]
        sets = [set(x) for x in {frozenset(x) for x in sets if x}]
        root = list(range(len(sets)))
        links = similar.forest([np.array(sorted(x), np.uint64) for x in sets], 0.8)
        assert len(links) < len(sets) and all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)
        for a, b in links:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        assert root == connected(sets)


ODD = [(1, "a"), (1, "a"), (2, None), (None, None), (None, "b c"), (3, ""), (4, " \n\t "), (5, "x" * 300_000), (6, "word " * 40_000), (7, "😀é\x00\u0558")]


@pytest.fixture(scope="module")
def odd(spark):
    clash = "doc_id long, text string, block long, shard string, fp string, node long, ids string, hash long, spans string, size int, a long, b long, key string, n long"
    return spark.createDataFrame([(d, t, *[None] * 12) for d, t in ODD], clash)


def operators():
    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    tagger = pii.Tagger(hidden=2, embedding=2)
    return {
        "bpe": lambda d: bpe.digests(d, path, pattern),
        "encode": lambda d: bpe.decode(bpe.encode(d, path, pattern), path),
        "counts": lambda d: tokencount.token_counts(d, P.path("byte_bpe_50k.json")),
        "suffix": suffixdedup.remove_repeats,
        "simhash": simhash.near_duplicates,
        "pii": lambda d: pii.find(d, tagger),
        "redact": lambda d: pii.redact(d, tagger),
        "clean": lambda d: decontam.clean(d, d.sparkSession.createDataFrame([(1, "nothing like it anywhere in here"), (None, None), (2, "")], "item_id long, text string")),
        "graded": lambda d: quality.graded(d, quality.Model(np.zeros((1 << quality.BITS) + 5), np.array([-1.0, 0.0]))),
    }


@pytest.mark.parametrize("name", operators())
def test_odd_rows_are_kept(odd, name):
    run = operators()[name]
    assert run(odd).count() == len(ODD)
    assert run(odd.limit(0)).count() == 0


def test_round_trip_of_odd_texts(odd):
    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    rows = bpe.decode(bpe.encode(odd.select("doc_id", "text", F.col("text").alias("before")), path, pattern), path).collect()
    assert len(rows) == len(ODD) and all(bytes(r.decoded) == (r.before or "").encode() for r in rows)
    both = bpe.encode(odd, path, pattern, raw="bytes").collect()
    assert len(both) == len(ODD) and {bytes(r.bytes) for r in both} == {(t or "").encode() for _, t in ODD}


def test_odd_pages(spark):
    df = spark.createDataFrame([(None, None, None), (1, "", ""), (1, "", ""), (2, "http://x", "<" * 5000), (3, "://", "<p>" * 3000 + "deep"), (4, "a://b", "x" * 200_000)], "page_id long, url string, html string")
    assert htmltext.extract(df).count() == 6 and urlfilter.judge(df).count() == 6
    assert htmltext.extract(df.limit(0)).count() == 0 and urlfilter.judge(df.limit(0)).count() == 0


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "some text of a document that is long enough")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "text of a document that is")], "item_id long, text string")
    assert [tuple(r)[:2] for r in decontam.matches(docs, items).collect()] == [(1, 9)]
    assert decontam.matches(docs, items.limit(0)).count() == 0 and decontam.matches(docs.limit(0), items).count() == 0
    assert decontam.clean(docs, items.limit(0)).count() == 1 and decontam.clean(docs, items).count() == 0
    assert [tuple(r)[:2] for r in decontam.matches(docs, items.union(items.selectExpr("10L", "text")), block_bytes=10).orderBy("item_id").collect()] == [(1, 9), (1, 10)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    docs = C.table(spark, SMALL, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert k == len(C.STAGES) - 1 or docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert 0 < docs.count() < 200 and docs.where("n_tokens <> size(token_ids)").count() == 0
    clean = spark.read.parquet(str(tmp_path / "pii")).select("doc_id", "text").join(docs.select("doc_id", F.col("text").alias("back")), "doc_id")
    assert clean.where("text <> back").count() == 0


def test_every_query_has_a_stable_schema(spark):
    for name, query in queries.queries().items():
        if name in ("op5_url_filter", "op6_token_counts", "op10_html_text"):
            assert query(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{'documents' if '6' in name else 'pages'}.parquet").count()
