"""Spelling variants, hard negatives and lattice hashing against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import audio, byte_bpe, hard_negatives, lattice, pii, quality, simhash, spelling, token_counts, url_filter, warc


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=str)


# --- spelling -------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, one_in):
    counts = Counter()
    for doc_id, text in docs:
        for run in spelling.RUN.findall(text or ""):
            run = run.translate(spelling.LOWER)
            if one_in:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % one_in == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    others = {w: sorted((o for o in words if near(w, o)), key=lambda o: (-words[o], o)) for w in words}
    form = {w: o[0] if o and words[o[0]] >= 2 * words[w] else None for w, o in others.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(others[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


@pytest.mark.parametrize("members", [spelling.LIST_MEMBERS, 3])
def test_spelling_variants(spark, members):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abÉéß") for _ in range(rng.randint(4, 6))) for _ in range(300)] + ["aaaaa", "aaaaaa", "abababab", "babababa", "listen", "silent"]
    docs = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(pool, weights=[1 + k % 17 for k in range(len(pool))], k=200))) for i in range(40)]
    docs += [(40, None), (41, ""), (None, "aaaaa aaaaaa listen"), (42, "a" * 20_000 + " " + "a" * 20_000 + " " + "a" * 20_000 + " " + ("a" * 19_999 + " ") * 6), (3, docs[3][1]), (43, "12 5x _ ~")]
    df = spark.createDataFrame([(i, t, "w", 7) for i, t in docs], "doc_id long, text string, word string, n int")
    for one_in in (3, None):
        got = spelling.variants(df, one_in=one_in, list_members=members).select("word", "form", "root", "n", "n_near", "form_n")
        want = brute_variants(docs, one_in)
        assert rows(got) == want
        assert max(w[4] for w in want) > 3 and any(w[2] not in (w[0], w[1]) for w in want)
    assert spelling.variants(df.where("false")).count() == 0


def test_anagrams_share_lists_but_not_orders():
    assert spelling.near_in([("abcde", 9, "c", None), ("abxde", 2, "x", None), ("edcba", 5, "c", None)]) == {"abcde": (1, 2, "abxde"), "abxde": (1, 9, "abcde")}
    assert spelling.near_in([("aabbb", 4, "b", None), ("aabb", 3, None, None)]) == {"aabbb": (1, 3, "aabb"), "aabb": (1, 4, "aabbb")}


# --- hard negatives -------------------------------------------------------------------------


def brute_negatives(data):
    ones = {}
    for i, v, label in data:
        if i is None or v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        own = (label, [float(np.floor(256.0 * x)) for x in v])
        ones[i] = min(own, ones.get(i, own))
    out = []
    for a, (label, q) in ones.items():
        if a % 50:
            continue
        score = {i: int(np.dot(q, v)) for i, (_, v) in ones.items() if i != a and len(v) == len(q)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if ones[i][0] == label][:5]:
            fit = [i for i in order if ones[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k, n, score[p], score[n]) for k, n in enumerate(fit[:3], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "block", "leaf"), [(4096, 2048, 128), (64, 2, 4)])
def test_hard_negatives(spark, chunk, block, leaf):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    data = [(i, [float(x) for x in centers[i % 6] * (i % 3) + rng.normal(size=8) * 0.4], i % 4) for i in range(700)]
    data += [(i, data[50][1], i % 4) for i in range(700, 760)]  # copies tie by id
    data += [(800, None, 1), (850, [], 1), (900, [1.0, None] * 4, 1), (950, [float("nan")] * 8, 1), (951, [float("inf")] * 8, 1), (952, [0.0] * 8, None), (None, [1.0] * 8, 1), (1000, [1.0, 2.0], 1), (1001, [1.0, 2.0], 1), (1002, [0.7, 1.4], 2), (1050, [0.0] * 8, 2), (100, [9.0] * 8, 3), (100, [9.0] * 8, 0)]
    df = spark.createDataFrame([(*r, 0, 0) for r in data], "vec_id long, embedding array<double>, label int, id int, v int").repartition(5)
    got = hard_negatives.mine(df, F.col("id") % 50 == 0, chunk=chunk, block=block, leaf=leaf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(data)
    assert rows(got) == want and len(want) > 100
    assert hard_negatives.mine(df.where("false"), F.col("id") % 50 == 0).count() == 0


def test_ball_trees_prune_and_stay_exact():
    rng = np.random.default_rng(4)
    x = np.floor(256 * (np.repeat(rng.normal(size=(40, 6)), 50, axis=0) * 3 + rng.normal(size=(2000, 6)) * 0.05))
    ids, labels = np.arange(2000), np.arange(2000) // 50 % 7
    tree = hard_negatives.build(ids, labels, x, 16)
    q, low, high = x[::100], np.full((20, 1), 1000.0), np.full((20, 1), 200_000.0)
    best = hard_negatives.Best(20, 1, 3)
    work = hard_negatives.search(tree, ids[::100], labels[::100], q, low, high, False, best)
    for k in range(20):
        scores = x @ q[k]
        fit = sorted((-scores[i], i) for i in range(2000) if labels[i] != labels[100 * k] and 1000 <= scores[i] <= 200_000)[:3]
        assert [(-s, i) for s, i in fit] == [(s, i) for s, i in zip(best.scores[k, 0], best.ids[k, 0], strict=True) if s > hard_negatives.NONE]
    assert work < 20 * 2000 / 2


# --- lattice --------------------------------------------------------------------------------


def brute_links(data, threshold=0.98):
    good = {k: np.array(v, float) for k, (i, v, label) in enumerate(data) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {k: {k} for k in good}
    for a, x in good.items():
        for b, y in good.items():
            if a < b and data[a][2] == data[b][2] and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(data):
        seen, todo = {k}, [k]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        least = min((data[j][0] for j in seen), default=None) if i is not None else None
        out.append((i, len(links.get(k, {k})) - 1, least, i is not None and i == least))
    return sorted(out, key=str)


def lattice_rows():
    rng = np.random.default_rng(9)
    data = []
    for g in range(30):
        center = rng.normal(size=16)
        data += [(len(data) + k, [float(np.float32(x)) for x in center + rng.normal(size=16) * (0.02 + 0.006 * g)], g % 3) for k in range(int(rng.integers(1, 12)))]
    n = len(data)
    data += [(n + k, data[5][1], data[5][2]) for k in range(4)] + [(n + 4, data[5][1], data[5][2] + 1)]
    data += [(n + 5, None, 1), (n + 6, [], 1), (n + 7, [0.0] * 16, 1), (n + 8, [1.0, None] * 8, 1), (n + 9, [float("nan")] * 16, 1), (n + 10, [1.0] * 16, None), (None, data[5][1], data[5][2]), (n + 11, [1.0, 0.0], 1), (n + 12, [3.0, 0.0], 1), (n + 13, [-0.0, -1.0], 1), (n + 14, [0.0, -1.0], 1), (2, data[40][1], data[40][2])]
    return data


@pytest.mark.parametrize(("kind", "block"), [("float", 4096), ("double", 3)])
def test_lattice_links_equal_brute_force(spark, kind, block):
    data = lattice_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in data], f"vec_id long, embedding array<{kind}>, label int, node int, digest string").repartition(4)
    got = lattice.near_duplicates(df, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert rows(got) == brute_links(data)
    assert lattice.near_duplicates(df.where("false")).count() == 0


def test_points_of_the_lattice():
    assert len(np.unique(lattice.shortest(), axis=0)) == 240 and ((lattice.shortest() ** 2).sum(axis=1) == 2).all()
    x = np.random.default_rng(1).normal(size=(300, 8)) * 3
    points = lattice.decode(x)
    assert ((points * 2).sum(axis=1) % 4 == 0).all() and len({*(points * 2 % 2).sum(axis=1)} - {0.0, 8.0}) == 0
    here = ((x - points) ** 2).sum(axis=1)
    assert (here <= 1 + 1e-9).all()  # the covering radius
    for v in lattice.shortest():
        assert (here <= ((x - points - v) ** 2).sum(axis=1) + 1e-9).all()


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1)[:, None] * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1)[:, None]
    salt = np.zeros(3000, np.int64)
    x, y = lattice.cells(a, salt), lattice.cells(b, salt)
    met = (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean()
    far = (x[:, :, None] == np.roll(x, 1, axis=0)[:, None, :]).any(axis=(1, 2)).mean()
    assert met > 0.995 and far < 0.01


# --- mended earlier operators ---------------------------------------------------------------


def test_long_secrets_and_addresses_are_masked_whole(spark):
    key, local, labels = "aB3" * 3_333 + "z", "x" * 300, ".".join(f"d{i}" for i in range(10))
    plain = [f"the word {i} password = secret{i}42z and mail{i} (at) host{i} (dot) com" for i in range(200)]
    texts = [f"so token = '{key}' ends", f"write {local} (at) {labels}.com now", *plain, "x" * 200_000 + " (at) " + "y." * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert key[-100:] not in got[0] and got[0].endswith("ends")
    assert local not in got[1] and "d9" not in got[1] and got[1].endswith("now")


def test_context_labelers_vote(spark):
    df = spark.createDataFrame([(0, 'so token = "ab8ca1b325bc4f85aa6a79e7" and | a.b@c.org | 12, 13, 212-555-0188 x')], "doc_id long, text string")
    found = pii.find(df).first()
    votes = {s.kind: dict(zip(pii.LABELERS, s.votes, strict=True)) for s in [*found.base, *found.proposed]}
    assert votes["email"]["context"] == 1 and votes["local_phone"]["counter"] == -1


def test_decode_beside_a_column_of_its_name(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    encoded = byte_bpe.encode(df).withColumn("decoded", F.lit(5))
    got = byte_bpe.decode(encoded)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded", "decoded_"]
    assert {bytes(r.decoded_) for r in got.collect()} == {b"one two", b""}


def test_limits_are_those_of_each_language(spark):
    rng = random.Random(8)
    data = [(i, lang, 100 + i % 50, int((100 + i % 50) * quality.SCALE * (2 + k) + rng.gauss(0, 1) * quality.SCALE * 30 * (1 + k))) for k, lang in enumerate(("en", "de", None)) for i in range(1000 * k, 1000 * k + 300)]
    data += [(9000 + i, "fr", 100, 100 * quality.SCALE) for i in range(5)]
    scores = spark.createDataFrame(data, "id long, lang string, symbols long, cost long")
    found = {(r.every, r.lang): r for r in quality.limits(scores, scores.select("id")).collect()}
    assert set(found) == {(False, "en"), (False, "de"), (False, None), (True, None)}
    for (every, lang), r in found.items():
        own = [x for x in data if every or x[1] == lang]
        mean = sum(x[3] for x in own) / quality.SCALE / sum(x[2] for x in own)
        over = sorted(np.ceil((x[3] / quality.SCALE - mean * x[2]) * 1000 / np.sqrt(x[2])) for x in own)
        assert abs(r.mean - mean) < 1e-9 and abs(r.threshold - over[int(np.ceil(len(own) * quality.QUANTILE)) - 1]) <= 1


def test_clashing_names_in_more_operators(spark):
    extra = ("id", "ID_", "value", "n", "row", "lane", "frames", "payload", "size", "sha1", "first", "host", "path", "key", "listed", "verdict", "symbols", "cost", "mean", "own_lang", "fp", "component", "node", "list", "n_tokens", "docs", "ids")
    clash = lambda df: df.withColumns({n: F.lit("x") for n in extra if n not in df.columns})
    docs = clash(spark.createDataFrame([(1, "a b c", "en"), (2, None, "de")], "doc_id long, text string, lang string"))
    assert token_counts.histogram(docs).agg(F.sum("docs")).first()[0] == 2
    assert audio.features(clash(audio.store(docs))).count() == simhash.cluster(docs).count() == quality.judge(docs, docs.select("doc_id")).count() == 2
    web = clash(spark.createDataFrame([(1, "http://a.org/x", "h"), (2, None, None)], "page_id long, url string, html string"))
    judged = url_filter.judge(web, ("block a.org/",), clash(spark.createDataFrame([("b.org",)], "key string")))
    assert rows(judged, "page_id", "verdict") == [(1, "block"), (2, "allow")]
    assert rows(warc.read_manifest(warc.write(web)), "record_id", "payload_bytes") == [("1", 1), ("2", 0)]
