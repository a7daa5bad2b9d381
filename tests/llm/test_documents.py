"""The document operators against brute force, on whole small tables and on awkward rows."""

import gc
import hashlib
import math
import random
import re
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pointloom.llm import bm25, components, langid, linededup, mixing, nearcopies, ngrams, quality, queries, repetition, simhash, spm, toxicity, urlfilter
from pointloom.llm.common import word_count

SQL = queries.oracle_sql()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word%d " * 3000 % tuple(i % 911 for i in range(3000)) + "\n" + "line\n" * 300


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and columns whose names clash."""
    rows = [
        (1, "a b c d\ne f g h\nsame tail here\n", "en", "s1", 3), (1, "a b c d\ne f g h\nsame tail here\n", "en", "s1", 3), (2, "a b c d\ne f g h\nsame tail here\n", None, "s1", None),
        (3, None, "en", None, 0), (4, "", "fr", "s2", 0), (5, "   \n\t ", "fr", "s2", 5), (None, "a b c d", "en", "s2", 7), (None, None, None, None, None),
        (6, LONG, "en", "s3", 1), (7, LONG, "en", "s3", 1), (8, "12 34 !!", None, "s1", 8), (50, "a b c d e", "en", "s1", 9), (100, "über straße x", "de", "s9", 9), (100, "another text of one id", "de", "s9", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    names = "fp component_id score copies size n_lines n_removed idx ids key term rank y held_out kept row of on rate source_size target below named id th a b ch lines full codes gone place of_id of_th row_th cut what n label"
    clash = {c: F.lit("clash") for c in names.split()} | {f"_{c}": F.lit("clash") for c in ("lines", "h", "chunks", "gone", "kth", "gid", "gth", "rank", "rate", "copy", "url", "on", "below")} | {"a.b": F.lit("clash")}
    return rows, df.select("*", *[v.alias(k) for k, v in clash.items()]).cache()


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd[1].limit(0)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], SQL[name])


# -- 1 ----------------------------------------------------------------------------------


def bm25_brute(rows, asked, k):
    tf = [Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())) for _, t in rows]
    df = Counter(t for c in tf for t in c)
    mean = max(1.0, sum(sum(c.values()) for c in tf) / max(1, len(rows)))
    out = {}
    for q, text in asked.items():
        want = Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()))
        scored = []
        for (i, _), c in zip(rows, tf):
            s = sum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * n * (bm25.K3 + 1) / (n + bm25.K3) * c[t] * (bm25.K1 + 1) / (c[t] + bm25.K1 * (1 - bm25.B + bm25.B * sum(c.values()) / mean)) for t, n in want.items() if t in c)
            if s > 0:
                scored.append((s, i))
        out[q] = [round(s, 6) for s, _ in sorted(scored, key=lambda x: -x[0])[:k]]
    return out


@pytest.mark.parametrize("shard", [7, 32768])
def test_bm25_is_brute_force(spark, sf_dir, monkeypatch, shard):
    monkeypatch.setattr(bm25, "SHARD_ROWS", shard)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = defaultdict(list)
    for r in bm25.top_k(docs, docs.where("doc_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(round(r.score, 6))
    assert got == bm25_brute(rows, {i: t for i, t in rows if i % 20 == 0}, 5)


def test_bm25_in_query_blocks(spark, sf_dir, monkeypatch):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    whole = sorted(map(tuple, bm25.top_k(docs, docs.where("doc_id % 50 = 0"), 3).collect()))
    monkeypatch.setattr(bm25, "QUERY_TERMS", 100)
    assert [r[:3] for r in sorted(map(tuple, bm25.top_k(docs, docs.where("doc_id % 50 = 0"), 3).collect()))] == [r[:3] for r in whole]


def test_bm25_odd_rows(odd, none):
    rows = [(r[0], r[1]) for r in odd[0]]
    got = defaultdict(list)
    for r in bm25.top_k(odd[1], odd[1].where("doc_id % 50 = 0"), 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append(round(r.score, 6))
    assert got == bm25_brute(rows, {50: "a b c d e", 100: "another text of one id"}, 4)
    assert bm25.top_k(none, odd[1]).count() == 0 and bm25.top_k(odd[1], none).count() == 0


# -- 2 ----------------------------------------------------------------------------------


def test_hosts_of_awkward_urls(spark):
    want = {"http://[2001:DB8::1]:80/p": "[2001:db8::1]", "http://u:p@[::1]/": "[::1]", "ftp://A.b.": "a.b", "http://a:1@b:2/c@d": "b", "mailto:x@y": "", "": ""}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.h for r in df.select("u", urlfilter.host(F.col("u")).alias("h")).collect()} == want


def test_url_intervals_and_ties(spark):
    log = [
        ("host", "a.com", "x", "add", "2024-01-10"), ("host", "a.com", "x", "add", "2024-01-10"), ("host", "a.com", "x", "remove", "2024-02-01"), ("domain", "b.org", None, "add", "2024-01-05"),
        ("path", "c.net/p/q", "y", "add", "2024-01-01"), ("host", "d.com", "x", "add", "2024-01-03"), ("host", "d.com", "x", "remove", "2024-01-03"), (None, "a.com", "x", "add", "2024-01-01"), ("host", None, "x", "add", None),
    ]
    entries = spark.createDataFrame(log, "kind string, value string, category string, action string, effective_on string").withColumn("effective_on", F.col("effective_on").cast("date"))
    seen = [
        (1, "http://A.com:80/z", "2024-01-09"), (2, "http://u@a.com./", "2024-01-10"), (3, "http://a.com", "2024-01-31"), (4, "http://a.com", "2024-02-01"), (5, "https://x.b.org?q", "2024-03-01"), (6, "https://xb.org", "2024-03-01"),
        (7, "http://c.net//p/q/r", "2024-01-01"), (8, "http://c.net/p", "2024-01-01"), (9, "http://d.com", "2024-01-04"), (10, None, "2024-01-04"), (11, "http://a.com", None), (12, "nonsense", "2024-01-04"), (2, "http://u@a.com./", "2024-01-10"),
    ]
    captures = spark.createDataFrame(seen, "page_id long, url string, fetched_on string").withColumn("fetched_on", F.col("fetched_on").cast("date")).withColumn("blocked", F.lit("clash")).withColumn("kind", F.lit("clash"))
    got = sorted((r.page_id, r.blocked, r.n_matches, r.categories) for r in urlfilter.evaluate(captures, entries).collect())
    hit = {2: "x", 3: "x", 5: "", 7: "y"}
    assert got == sorted((i, i in hit, int(i in hit), hit.get(i, "")) for i, _, _ in seen)
    assert urlfilter.evaluate(captures, entries.limit(0)).where("blocked").count() == 0
    assert urlfilter.evaluate(captures.limit(0), entries).count() == 0


# -- 3, 6 -------------------------------------------------------------------------------


@pytest.mark.parametrize("name, column, modulus, held, most", [("op3_toxicity", "toxic", 3, 1, 0.02), ("op6_quality", "quality", 4, 2, 0.25)])
def test_classifiers_on_held_out_rows(spark, name, column, modulus, held, most):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()[name](spark, d).collect()}
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = [(truth[i], got[i].predicted) for i in truth if got[i].held_out]
    false = sum(1 for t, p in out if p and not t) / max(1, sum(1 for t, _ in out if not t))
    assert false <= most
    hits = sum(1 for t, p in out if p and t) / sum(1 for t, _ in out if t)
    assert hits >= (0.35 if column == "toxic" else 0.9)  # half of the toxic labels mark texts without any sign of it


@pytest.mark.parametrize("operator, column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, odd, none, operator, column):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(r.choices(words, k=20)) + (" zonk blarg" if i % 2 else ""), i % 2) for i in range(120)]
    train = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows] + [(None, 1), (5, None)], f"doc_id long, {column} int")
    model = operator.train(train, labels)
    scores = {x.doc_id: x.predicted for x in operator.score(train, model).collect()}
    assert scores == {i: i % 2 for i, _, _ in rows}
    got = operator.score(odd[1], model).collect()
    assert len(got) == len(odd[0]) and all(0 <= x.score <= 1 for x in got)
    assert len({x.score for x in got if x.doc_id in (3, 4, 5)}) == 1
    assert operator.score(none, model).count() == 0
    clashing = odd[1].select("doc_id", "text", "y", "label", "below")
    assert operator.score(clashing, operator.train(clashing, spark.createDataFrame([(1, 1), (6, 0)], f"doc_id long, {column} int"))).count() == len(odd[0])
    one = operator.train(train, labels.where(f"{column} = 1"))
    assert {x.score for x in operator.score(train, one).collect()} == {1.0}
    assert {x.score for x in operator.score(train, operator.train(train, labels.limit(0))).collect()} == {0.0}


def buckets_brute(text):
    """Buckets of all byte n-grams of 3 to 5, one at a time, in plain whole numbers."""
    raw = b" " + b" ".join((text or "").lower().encode().split()) + b" "
    out = set()
    for n in (3, 4, 5):
        for k in range(len(raw) - n + 1):
            out.add(((int.from_bytes(raw[k : k + n], "big") + (n << 56)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 44)
    return out


def features_brute(rows):
    """(text, y) -> kept buckets in order, their ratios, and the design matrix of ratios where a bucket is present."""
    sets, y = [buckets_brute(t) for t, _ in rows], np.array([y for _, y in rows], float)
    n0, n1 = Counter(b for s, v in zip(sets, y) if not v for b in s), Counter(b for s, v in zip(sets, y) if v for b in s)
    p, q = y.sum(), len(y) - y.sum()
    found = []
    for b in {*n0, *n1}:
        share = (n0[b] + n1[b]) / len(y)
        z = abs(n1[b] / p - n0[b] / q) / math.sqrt(max(share * (1 - share), 1e-9) * (1 / p + 1 / q))
        if n0[b] + n1[b] >= 3 and z >= 5:
            found.append((-z, b))
    kept = sorted(b for _, b in sorted(found)[: ngrams.FEATURES])
    ratio = np.array([math.log((n1[b] + 1) / (p + 2)) - math.log((n0[b] + 1) / (q + 2)) for b in kept])
    return kept, ratio, np.array([[r if b in s else 0.0 for b, r in zip(kept, ratio)] for s in sets]), y


def labelled(spark, d, column, modulus, held):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = docs.select("doc_id", "text").join(labels, "doc_id").select("doc_id", "text", column).collect()
    return sorted({(r.text, r[column]) for r in rows if zlib.crc32(str(r.doc_id).encode()) % modulus != held and r[column] is not None}, key=str), docs.select("doc_id", "text").collect()


def test_toxicity_is_brute_force(spark):
    """Scores of all rows against a dense logistic regression by plain Newton steps."""
    rows, every = labelled(spark, "/root/testdata/sf0.01", "toxic", 3, 1)
    kept, ratio, x, y = features_brute(rows)
    x = np.hstack([x, np.ones((len(y), 1))])
    penalty = np.append(np.full(len(kept), toxicity.RIDGE), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    got = {r.doc_id: r.score for r in queries.op3_toxicity(spark, "/root/testdata/sf0.01").collect()}
    for r in every[::5]:
        s = buckets_brute(r.text)
        want = 1 / (1 + math.exp(-(sum(v * q for b, v, q in zip(kept, w, ratio) if b in s) + w[-1])))
        assert got[r.doc_id] == pytest.approx(want, abs=0.01)


def test_quality_is_brute_force(spark):
    """Scores of all rows against a dense dual of the hinge loss, solved to the end by sweeps in order, with the sigmoid fitted by bisection."""
    rows, every = labelled(spark, "/root/testdata/sf0.01", "quality", 4, 2)
    kept, ratio, x, y = features_brute(rows)
    model = quality.train(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"), spark.createDataFrame([(i, int(v)) for i, (_, v) in enumerate(rows)], "doc_id long, quality int"))
    assert model.scaled.buckets.tolist() == kept and model.scaled.ratios.tolist() == pytest.approx(ratio.tolist())
    x = np.hstack([x, np.full((len(y), 1), quality.CONSTANT)])
    sign, gram = np.where(y > 0, 1.0, -1.0), x @ x.T
    alpha, f = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(400):
        for i in range(len(y)):
            new = min(max(alpha[i] - (sign[i] * f[i] - 1) / gram[i, i], 0.0), quality.COST)
            f += (new - alpha[i]) * sign[i] * gram[i]
            alpha[i] = new
    w = x.T @ (alpha * sign)
    marks, dense = model.scaled.marks(), model.dense()
    loss = lambda v: 0.5 * v @ v + quality.COST * np.maximum(0, 1 - sign * (x @ v)).sum()
    mine = np.append(model.weights, model.bias / quality.CONSTANT)
    assert loss(mine) <= loss(w) * 1.01
    got = {r.doc_id: r.score for r in queries.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    for r in every[::5]:
        s = buckets_brute(r.text)
        margin = sum(v * q for b, v, q in zip(kept, w, ratio) if b in s) + quality.CONSTANT * w[-1]
        want = 1 / (1 + math.exp(-(model.slope * margin + model.shift)))
        assert got[r.doc_id] == pytest.approx(want, abs=0.03) and model.score(r.text, marks, dense) == pytest.approx(want, abs=0.03)


def test_ngram_hashes_cross_slices(monkeypatch):
    text = " ".join(f"w{i}" for i in range(400))
    whole = ngrams.present(text)
    monkeypatch.setattr(ngrams, "STRIDE", 64)
    assert ngrams.present(text).tolist() == whole.tolist()


# -- 4 ----------------------------------------------------------------------------------


def simhash_brute(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_brute(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[ids[a]] ^ prints[ids[b]]).count("1") <= 2:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_is_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    prints = {i: simhash_brute(t) for i, t in rows}
    got = queries.queries()["op4_simhash"](spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == groups_brute(prints)


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_links_near_fingerprints(spark, hot):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randrange(4))) for b in base for _ in range(12)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), hot).collect()
    mask = (1 << 64) - 1
    assert all(bin((e.u ^ e.v) & mask).count("1") <= 2 for e in edges)
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame([(e.u, e.v) for e in edges], "u long, v long")).collect()}
    want = groups_brute({s[0]: s[0] & mask for s in signed})
    assert {s[0]: found.get(s[0], s[0]) for s in signed} == want


def test_components_of_a_path_and_none(spark):
    got = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 90), (70, 60)], "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(41)} | {60: 60, 70: 60}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_odd_rows(odd, none):
    got = simhash.simhash_groups(odd[1]).collect()
    assert len(got) == len(odd[0])
    zero = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in zero} == {3, 4, 5, None} and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    kept = simhash.one_of_each(odd[1]).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [1, 3, 6, 8, 50, 100] and sum(r.doc_id is None for r in kept) == 2
    assert simhash.one_of_each(odd[1]).columns == odd[1].columns
    assert simhash.simhash_groups(none).count() == 0 and simhash.one_of_each(none).count() == 0


def five_words(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_brute(rows):
    """doc_id -> smallest id reachable over fingerprints within two bits or a similarity of 0.8."""
    sets, root = {i: five_words(t) for i, t in rows}, groups_brute({i: simhash_brute(t) for i, t in rows})
    for a in sorted(sets):
        for b in sets:
            x, y = sets[a], sets[b]
            if root[a] != root[b] and 10 * len(x & y) >= 8 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def near_families(seed):
    """Families of edited copies, some longer, some shorter, texts that share a passage, and pairs on the threshold."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage, rows = [word() for _ in range(40)], []
    for size in (1, 4, 9, 30, 55, 120, 300):
        base = [word() for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(r.randrange(1 + size // 25)):
                copy[r.randrange(len(copy))] = word()
            rows.append(copy + [word() for _ in range(r.randrange(1 + size // 10))])
    rows += [[word() for _ in range(60)] + passage + [word() for _ in range(20)] for _ in range(40)]
    rows += [passage + [word() for _ in range(k)] for k in range(14)]
    for n in (10, 25, 45):  # n shingles, of which 8 n / 10 and one less or more
        base = [word() for _ in range(n + 4)]
        rows += [base, *([*base, *[word() for _ in range(n // 4 + d)]] for d in (-1, 0, 1))]
    r.shuffle(rows)
    return [(i, " ".join(w).title() if i % 3 else " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("hot", "block", "group", "seen"), [(64, 1024, 1 << 22, 1 << 16), (3, 5, 2000, 2)])
def test_near_groups_are_brute_force(spark, monkeypatch, hot, block, group, seen):
    for name, value in (("HOT_LIST", hot), ("BLOCK", block), ("GROUP", group), ("REMEMBERED", seen)):
        monkeypatch.setattr(nearcopies, name, value)
    rows = near_families(11)
    want = near_brute(rows)
    got = nearcopies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert 20 < len(set(want.values())) < len(rows) - 20
    assert len(set(groups_brute({i: simhash_brute(t) for i, t in rows}).values())) > len(set(want.values())) + 20


def test_near_family_costs_no_square(spark, monkeypatch):
    """Copies with one to five words changed: most pairs are not similar, and all share most of their shingles."""
    r, asked, similar = random.Random(5), [], nearcopies._similar
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(400):
        copy = list(base)
        for at in r.sample(range(150), 1 + i % 5):
            copy[at] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(copy)))

    def counted(candidates, *more):
        kept = nearcopies.stored(candidates)
        asked.append(kept.count())
        return similar(kept, *more)

    monkeypatch.setattr(nearcopies, "_similar", counted)
    got = nearcopies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == near_brute(rows)
    assert sum(asked) < 20 * len(rows)


def test_near_groups_send_small_batches(spark, monkeypatch):
    """Rows that go to Python together are bounded, and the session's own bound comes back."""
    name, bound, own, printed = "spark.sql.execution.arrow.maxRecordsPerBatch", 7, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), nearcopies._printed

    def bounded(batches):
        for batch in batches:
            assert batch.num_rows <= bound
            yield from printed(iter([batch]))

    monkeypatch.setattr(nearcopies, "BATCH", bound, raising=False)
    monkeypatch.setattr(nearcopies, "_printed", bounded)
    rows = [(i, f"a text of number {i}") for i in range(40)] + [(40, "a text of number 3")]
    got = {r.doc_id: r.component_id for r in nearcopies.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[40] == 3 and len(got) == 41 and spark.conf.get(name) == own


def test_pipeline_stages_bound_batches(spark):
    """What a stage returns is read and sent to Python in small batches; a session's smaller ones stay."""
    import corpus_pipeline

    before = {name: spark.conf.get(name) for name in corpus_pipeline.BATCHES}
    try:
        for set_to, want in ((4096, 500), (7, 7)):
            for name in before:
                spark.conf.set(name, set_to)
            corpus_pipeline._bounded(lambda s, docs, sf_dir: docs)(spark, None, "")
            assert {int(spark.conf.get(name)) for name in before} == {want}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_near_groups_odd_rows(odd, none):
    got = nearcopies.near_groups(odd[1]).collect()
    assert len(got) == len(odd[0])
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert nearcopies.near_groups(none).count() == 0 and simhash.one_of_each(none, nearcopies.near_groups(none)).count() == 0


# -- 5 ----------------------------------------------------------------------------------


def test_targets_by_rounds(spark):
    r = random.Random(2)
    for _ in range(5):
        sizes = {f"s{i:02}": r.randrange(0, 1000) for i in range(9)} | {None: 77}
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
        order = sorted((k for k in sizes if k is not None)) + [None]
        w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
        total, full = 1.5 * sum(sizes.values()), set()
        while True:
            left = total - sum(2 * sizes[k] for k in full)
            weight = sum(w[k] for k in order if k not in full)
            above = {k for k in order if k not in full and left * w[k] / weight > 2 * sizes[k]}
            if not above:
                break
            full |= above
        want = {k: 2 * sizes[k] if k in full else left * w[k] / weight for k in order}
        got = {x.source: x.target for x in mixing.targets(df).collect()}
        assert got == pytest.approx(want)
        assert sum(got.values()) == pytest.approx(total)


def test_mix_odd_rows(odd, none):
    plan = mixing.mix_plan(odd[1]).collect()
    assert len(plan) == len(odd[0]) and all(0 <= r.copies <= 2 for r in plan)
    assert sorted(r["size"] for r in plan) == sorted(len(WORD.findall(t or "")) for _, t, *_ in odd[0])
    mixed = mixing.mix(odd[1])
    assert mixed.columns == odd[1].columns
    times = defaultdict(int)
    for r in plan:
        times[r.doc_id, r.source] += r.copies
    seen = Counter((r.doc_id, r.source) for r in mixed.collect())
    assert seen == Counter({k: v for k, v in times.items() if v})
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_sources_miss_their_targets_by_a_document_at_most(spark):
    """Evenly spread coins: also for a source that few large documents make up, and for documents without ids, which have coins of their texts."""
    r = random.Random(4)
    rows = [(i, "w " * (r.choice([1, 5, 400, 3000]) if i % 7 else 0), None, f"s{i % 5}" if i % 5 else None, None) for i in range(600)]
    rows += [(None, f"t{i} " * (i % 40), None, "nameless", None) for i in range(300)]
    by = defaultdict(list)
    for p in mixing.mix_plan(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect():
        by[p.source].append(p)
    assert len(by) == 6
    for plan in by.values():
        assert abs(sum(p["size"] * p.copies for p in plan) - plan[0].target) <= max(p["size"] for p in plan)
        assert {p.copies for p in plan} <= {math.floor(plan[0].target / plan[0].source_size), math.ceil(plan[0].target / plan[0].source_size)}


def test_words_are_counted_by_six_spaces(spark):
    texts = ["a  b", " a b c ", "", None, "\x1fa\x0bb\x0cc\rd\te\nf", "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(word_count(F.col("text"))).collect()] == [len(WORD.findall(t or "")) for t in texts]


# -- 7 ----------------------------------------------------------------------------------


def test_languages_of_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = queries.queries()["op7_langid"](spark, d).collect()
    truth = {r.doc_id: r.lang for r in documents(spark, d).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def trigrams_brute(text):
    raw = b" " + b" ".join(bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()).split()) + b" "
    return Counter((int.from_bytes(raw[k : k + 3], "big") * 2654435761 % (1 << 32)) >> 17 for k in range(len(raw) - 2)) if len(raw) > 2 else Counter()


def language_brute(p, text):
    """Mixture of the columns of ``p`` (language -> trigram -> probability), languages added one by one, in plain Python."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    n = trigrams_brute(text)

    def em(chosen):
        pi = {k: 1 / len(chosen) for k in chosen}
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(chosen, 0.0)
            for g, c in n.items():
                below = sum(pi[k] * p[k][g] for k in chosen)
                for k in chosen:
                    new[k] += c * pi[k] * p[k][g] / below
            pi = {k: v / sum(new.values()) for k, v in new.items()}
        return sum(c * math.log(sum(pi[k] * p[k][g] for k in chosen)) for g, c in n.items()), pi

    best, pi = max((em([k]) for k in p), key=lambda f: f[0])
    while len(pi) < len(p):
        fit, more = max((em([*pi, k]) for k in p if k not in pi), key=lambda f: f[0])
        if fit - best <= langid.PENALTY * 0.5 * math.log(max(sum(n.values()), 2)):
            break
        best, pi = fit, more
    lang = min(pi, key=lambda k: (-pi[k], k))
    return lang, pi[lang]


def test_langid_is_brute_force(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text", "lang").collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts[r.lang].update(trigrams_brute(r.text))
    size = 1 << langid.BITS
    p = {k: defaultdict(lambda t=sum(c.values()): 0.5 / (t + 0.5 * size), {g: (x + 0.5) / (sum(c.values()) + 0.5 * size) for g, x in c.items()}) for k, c in sorted(counts.items())}
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op7_langid(spark, sf_dir).collect()}
    odd = [r for r in rows if r.text is None or len(r.text) < 4000][:60]
    for r in odd:
        lang, score = language_brute(p, r.text)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score, abs=2e-3)


def test_language_model_starts_no_row_workers(spark, monkeypatch):
    """The shares of the sample are a local table: rows from a list would be dealt to Python workers of a second kind, which stay beside the others."""
    df = spark.createDataFrame([(i, "some words" if i % 2 else "des mots", "en" if i % 2 else "fr") for i in range(20)], "doc_id long, text string, lang string")
    monkeypatch.setattr(spark.sparkContext, "parallelize", None)
    assert langid.train(df).languages == ["en", "fr"]


def test_mixture_finds_both_languages(spark):
    r = random.Random(3)
    en, de = ["the", "and", "with", "think", "light"], ["der", "und", "nicht", "schön", "zwei"]
    say = lambda words, n: " ".join(r.choices(words, k=n))
    rows = [(i, say(en if i % 2 else de, 30), "en" if i % 2 else "de") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows + [(99, "x", None), (98, None, "en")], "doc_id long, text string, lang string"))
    shares = model.proportions(say(en, 60) + " " + say(de, 60))
    assert set(shares) == {"en", "de"} and shares["en"] == pytest.approx(0.5, abs=0.15)
    assert set(model.proportions(say(en, 60))) == {"en"}
    for text in (None, "", " 12 3! ", "\n"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("é")[0] in ("en", "de")


def test_sample_of_rows_without_an_id(spark):
    """The share of rows that are counted holds for rows without an id, too."""
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("wort "), F.col("id").cast("string"), F.lit(" und")).alias("text"), F.lit("de").alias("lang"))
    mark = langid.grams("wort und")[0]
    model = langid.train(df, 400)
    smoothed = np.exp(model.logp[mark, 0].astype(float))
    assert model.languages == ["de"] and smoothed.min() > 0.01
    some = df.where(F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < int(0.1 * (1 << 31))).count()
    assert 300 < some < 500


def test_langid_odd_rows(spark, odd, none):
    model = langid.train(odd[1])
    got = langid.identify(odd[1], model).collect()
    assert len(got) == len(odd[0]) and {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 8)} == {"und"}
    assert langid.keep_identified(odd[1], model).columns == odd[1].columns
    assert langid.identify(none, model).count() == 0
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.identify(odd[1], empty).collect()} == {"und"}


# -- 8 ----------------------------------------------------------------------------------


def line_brute(rows):
    """Chunkings one by one: of each, boundaries, chunks, and the first place of every chunk of two lines."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    codes = [c for c in range(256) if bin(c).count("1") == 4]
    texts, first, chunks = {(i, t) for i, t in rows if t is not None}, {}, defaultdict(set)
    for i, t in texts:
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if WORD.search(x)]
        of = {k: codes[int(md5(lines[k])[:2], 16) % 70] for k in full}
        for bit in range(8):
            now = []
            for k, after in zip(full, [*full[1:], None]):
                now.append(k)
                if after is None or of[k] >> bit & 1 or not of[after] >> bit & 1:  # a boundary behind line k
                    assert len(now) < 3
                    if len(now) == 2:
                        key = lines[now[0]], lines[now[1]]
                        place = (i is None, i or 0, md5(t), now[0])
                        first[key] = min(first.get(key, place), place)
                        chunks[i, t].add((key, place, now[1]))
                    now = []
    res = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        gone = {k for key, place, last in chunks.get((i, t), ()) if first[key] != place for k in range(place[3], last + 1)}
        res.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return res


def test_line_dedup_is_brute_force(spark, sf_dir, odd, none):
    order = lambda rows: sorted(rows, key=str)
    for df in (documents(spark, sf_dir), odd[1]):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in linededup.line_dedup(df).collect()]
        assert order(got) == order(line_brute(rows))
    assert linededup.line_dedup(none).count() == 0
    assert linededup.line_dedup(odd[1]).columns == [*[c for c in odd[1].columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"]


def test_chunks_resist_shifts(spark):
    r = random.Random(9)
    body = [f"line {r.random()}" for _ in range(60)]
    df = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["new", *body])), (3, "\n".join([*body[:30], "mid", *body[31:]]))], "doc_id long, text string")
    gone = {x.doc_id: x.n_removed for x in linededup.line_dedup(df).collect()}
    assert gone[1] == 0 and gone[2] >= 58 and gone[3] >= 57


@pytest.mark.parametrize("n", [2, 3, 6])
def test_planted_passages_go_and_one_copy_stays(spark, n):
    """Passages of a few lines, among lines of their own, are all but all found; nothing else is."""
    r = random.Random(n)
    fresh = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(12))
    passages = [[fresh() for _ in range(n)] for _ in range(60)]
    rows = [(i, "\n".join([*[fresh() for _ in range(r.randrange(1, 5))], *passages[i % 60], "", *[fresh() for _ in range(r.randrange(1, 5))]])) for i in range(180)]
    got = {x.doc_id: x for x in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_removed == 0 for i in range(60))
    assert sum(got[i].n_removed for i in range(60, 180)) >= 0.95 * 120 * n
    assert all(set(got[i].text.split("\n")) >= set(rows[i][1].split("\n")) - set(passages[i % 60]) for i in range(60, 180))
    left = Counter(x for y in got.values() for x in y.text.split("\n"))
    assert all(left[x] for p in passages for x in p)


# -- 9 ----------------------------------------------------------------------------------


def repetition_brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    w = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    rep = {k for i in range(len(words) - 4) if w[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    longest, spans = 0, set()
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            k = 0
            while j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= repetition.MIN_WORDS:
                spans |= set(range(i, i + k)) | set(range(j, j + k))
    n, chars = len(words), sum(map(len, words))
    failed = n < 10 or 100 * len(rep) > 20 * n
    covered = sum(len(words[k]) for k in spans) / chars if spans else 0.0
    kept = not failed and covered <= repetition.MAX_COVERED and longest <= max(repetition.MAX_LONGEST, n * repetition.MAX_LONGEST_SHARE)
    return n, chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep), failed, kept, pytest.approx(covered), longest


def test_repetition_is_brute_force(spark, sf_dir, odd, none):
    docs = documents(spark, sf_dir).where("length(text) < 2500")  # the brute force is slow on the rest
    for df in (docs, odd[1].where("doc_id is null or doc_id not in (6, 7)")):
        rows = df.select("doc_id", "text").collect()
        got = repetition.repetition(df).collect()
        assert [tuple(r)[1:] for r in got] == [repetition_brute(r.text) for r in rows]
    assert repetition.repetition(none).count() == 0


def test_one_long_repeat_in_a_long_text(spark):
    """Repeats of 50 words pass in a text of any length, longer ones that pass the base rules do not."""
    fresh = lambda name, n: [f"{name}{i}" for i in range(n)]
    texts = {n: " ".join([*fresh("a", 9000), *fresh("p", n), *fresh("b", 9000 - 2 * n), *fresh("p", n), *fresh("c", 2000)]) for n in (50, 51, 1900)}
    got = {r.doc_id: r for r in repetition.repetition(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(not r.base_failed and r.covered <= repetition.MAX_COVERED and r.longest_repeat == n for n, r in got.items())
    assert {n: r.kept for n, r in got.items()} == {50: True, 51: False, 1900: False}


def test_suffix_repeats_random():
    r = random.Random(3)
    for _ in range(150):
        docs = [[r.randrange(r.choice([1, 2, 5])) for _ in range(r.randrange(30))] for _ in range(r.randrange(1, 5))]
        want = []
        for d in docs:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    k = 0
                    while i != j and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        got = repetition.suffix_repeats(np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        assert got.tolist() == want


def test_texts_longer_than_a_batch_of_words(monkeypatch):
    texts = ["a b c d e f g h i j k l " * 3, None, "x " * 50, ""]
    whole = repetition.measured(texts)
    monkeypatch.setattr(repetition, "TOGETHER", 10)
    assert repetition.measured(texts) == whole


# -- 10 ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    try:
        with open(queries.TOKENIZER, "rb") as f:
            return f.read()
    except OSError:
        pytest.skip("no vocabulary file")


AWKWARD = ["", " ", "  a", " a", "a ", "a  b\n\n c", "\n", "x\n", " \n a", "héé 漢字 a\x00b", "😀" * 3, "word" * 40, "\t\t x", "no space" * 9]


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def random_texts(n=300):
    r = random.Random(10)
    return ["".join(r.choices("abcdehinorst▁ \né漢.,", k=r.randrange(1, 80))) for _ in range(n)]


def test_ids_are_the_librarys(spark, sf_dir, model, library):
    v = spm.Vocabulary(model)
    texts = [r.text for r in documents(spark, sf_dir).collect()] + AWKWARD + random_texts()
    for text, (ids, _) in zip(texts, v.encode_all(texts)):
        assert ids.tolist() == library.encode(text) == v.encode(text)[0].tolist()
        assert "▁" in text or v.decode(ids) == text


def test_one_path_of_fitting_pieces(model, library):
    """Of all ways to cut a text into pieces one has neighbours that all fit, and it is the encoding."""
    v = spm.Vocabulary(model)
    for text in ("thethere", "ainationer", "xaaaaaab", "  in  er", "nicht漢é"):
        marked = v.marked(text)
        ways = [[]]
        for _ in range(len(marked)):  # one piece more at a time
            ways = [w if sum(map(len, w)) == len(marked) else [*w, marked[at : at + n]] for w in ways for at in [sum(map(len, w))] for n in ([n for n, _ in v.starts(marked, at)] if at < len(marked) else [0])]
        fitting = [w for w in map(list, set(map(tuple, ways))) if all(v.fit(a, b) for a, b in zip(["", *w[:-1]] if len(w) == 1 else w[:-1], w if len(w) == 1 else w[1:]))]
        assert len(fitting) == 1 and v.emit(fitting[0]) == library.encode(text)


@pytest.mark.parametrize("chunk", [1, 3, 17, 40])
def test_scan_gives_the_ids_of_the_whole(model, library, chunk):
    v = spm.Vocabulary(model)
    for text in [x for x in AWKWARD if x] + random_texts(60) + ["a" * 700, "aaaab" * 200, "1234567890" * 20]:
        marked = v.marked(text)
        rows = [(marked[max(0, s - v.longest) : s + chunk + v.longest - 1], min(s, v.longest), min(chunk, len(marked) - s)) for s in range(0, len(marked), chunk)]
        m = [v.transfer(*r) for r in rows]
        at = spm.states(m, spm.CUT, spm.CUT)
        assert [i for r, a, b in zip(rows, at[:-1], at[1:]) for i in v.backtrace(*r, a, b)] == library.encode(text)
        assert sum(x[a][b] for x, a, b in zip(m, at[:-1], at[1:])) == v.encode(text)[1]


@pytest.mark.parametrize("chunk", [17, 1000])
def test_parallel_scan_on_tables(spark, sf_dir, model, library, chunk):
    docs = documents(spark, sf_dir).where("length(text) < 1500").limit(25).unionByName(spark.createDataFrame([(-1, "aaaa" * 1000, None, None, 0)], SCHEMA))
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    v = spm.Vocabulary(model)
    for r in spm.encode(docs, model, giant=30, chunk=chunk).collect():
        assert r.ids == library.encode(rows[r.doc_id]) and r.score == float(v.encode(rows[r.doc_id])[1])


def test_max_plus_is_associative(model):
    v = spm.Vocabulary(model)
    text = v.marked("the parallel scan of a giant document without\nany break " * 3)
    m = [v.transfer(text[max(0, k - v.longest) : k + 20 + v.longest - 1], min(k, v.longest), min(20, len(text) - k)) for k in range(0, len(text), 20)]
    assert spm.max_plus(spm.max_plus(m[0], m[1]), m[2]) == spm.max_plus(m[0], spm.max_plus(m[1], m[2]))


def test_vocabulary_goes_with_its_broadcast(spark, model):
    """A worker that goes on to other work keeps no vocabulary and no memo."""
    held = spark.sparkContext.broadcast(model)
    gc.collect()
    gc.disable()  # nothing may wait for the collector of cycles
    try:
        v = spm._vocabulary(held)
        assert spm._vocabulary(held) is v and len(v.encode_all(["a plain text of some words", "and one more"])) == 2
        kept = weakref.ref(v)
        del v, held
        assert kept() is None
    finally:
        gc.enable()


def test_vocabulary_without_word_cuts(model, library):
    v = spm.Vocabulary(model)
    v._part, v.line_cuts = None, False
    for text in (*AWKWARD, "a plain text of some words"):
        assert v.encode(text)[0].tolist() == library.encode(text)


def test_other_models_are_refused(model):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        spm.Vocabulary(proto.SerializeToString())


def test_sentencepiece_odd_rows(odd, none, model):
    rows = spm.round_trips(odd[1], model, giant=1000, chunk=300).collect()
    assert len(rows) == len(odd[0])
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[3][0].n_tokens == 0 and by[3][0].round_trip is None and by[4][0].n_tokens == 0 and by[4][0].round_trip
    assert all(r.round_trip for r in rows if r.doc_id not in (3, None)) and len({r.ids_md5 for r in by[6] + by[7]}) == 1
    coded = spm.encode(odd[1], model)
    texts = sorted((str(r.doc_id), str(r.decoded)) for r in spm.decode(coded, model).collect())
    assert texts == sorted((str(r[0]), str(r[1])) for r in odd[0])
    assert spm.round_trips(none, model).count() == 0


def test_tokens_stage_returns_the_ids(spark, odd, none, model):
    import corpus_pipeline

    v = spm.Vocabulary(model)
    rows = corpus_pipeline.tokens(spark, odd[1], None).collect()
    assert len(rows) == len(odd[0]) and all(r.n_tokens == len(r.ids or []) for r in rows)
    texts = sorted((str(r.doc_id), str(None if r.ids is None else v.decode(np.array(r.ids, np.int32)))) for r in rows)
    assert texts == sorted((str(r[0]), str(r[1])) for r in odd[0])
    assert all(r.round_trip is (None if r.ids is None else True) for r in rows)
    for giant in (1000, spm.GIANT):  # the parallel scan and the whole search
        assert all(r.round_trip for r in spm.tokenised(odd[1], model, giant, 300).where("ids is not null").collect())
    assert spm.tokenised(none, model).count() == 0


# -- pipeline ---------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf_dir, model):
    import corpus_pipeline

    docs = documents(spark, sf_dir)
    steps = dict(corpus_pipeline.STAGES)
    a = corpus_pipeline.language(spark, docs, sf_dir).cache()
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))).collect()}
    assert {r.doc_id for r in a.collect()} == {i for i, (lang, s) in found.items() if lang != "und" and s >= 0.5}
    b = corpus_pipeline.lines(spark, a, sf_dir).cache()
    want = line_brute([(r.doc_id, r.text) for r in a.collect()])
    assert sorted((r.doc_id, r.text, r.n_chars) for r in b.collect()) == sorted((i, t, len(t)) for i, t, _, _ in want)
    c = corpus_pipeline.near_copies(spark, b, sf_dir).cache()
    roots = near_brute([(r.doc_id, r.text) for r in b.collect()])
    assert sorted(r.doc_id for r in c.collect()) == sorted(set(roots.values()))
    e = corpus_pipeline.mixture(spark, c, sf_dir).cache()
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(c).collect()}
    assert Counter(r.doc_id for r in e.collect()) == Counter({k: v for k, v in plan.items() if v})
    assert all(x.columns == docs.columns for x in (a, b, c, e))
    last = corpus_pipeline.tokens(spark, e, sf_dir).collect()
    v = spm.Vocabulary(model)
    sizes = {r.doc_id: len(v.encode(r.text)[0]) for r in c.collect()}
    assert Counter((r.doc_id, r.n_tokens) for r in last) == Counter((r.doc_id, sizes[r.doc_id]) for r in e.collect()) and all(r.round_trip for r in last)
    assert list(steps) == ["language", "lines", "near_copies", "mixture", "tokens"]
    assert corpus_pipeline.run(spark, sf_dir).count() == len(last)


def test_pipeline_stages_on_odd_rows(odd, none, spark, sf_dir, model):
    """Nulls, empty and long texts, repeated rows, clashing names and an empty table, in every stage by itself."""
    import corpus_pipeline

    rows, docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        assert stage(spark, none, sf_dir).count() == 0
        if name == "tokens":
            continue
        assert out.columns == docs.columns and all(r["a.b"] == r.rank == "clash" for r in got)
        ids = Counter(r.doc_id for r in got)
        if name == "language":
            assert not ids.keys() & {3, 4, 5, 8}
        elif name == "lines":
            assert ids == Counter(r[0] for r in rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        elif name == "near_copies":
            assert ids == Counter([1, 3, 6, 8, 50, 100, None, None])
        else:
            assert all(n <= 2 * sum(r[0] == i for r in rows) for i, n in ids.items())
