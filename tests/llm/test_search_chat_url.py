import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.ann import Settings, fit, nearest, probed
from tessera.llm.chat import format_chats
from tessera.llm.url_filter import Settings as Mining
from tessera.llm.url_filter import filter_urls, mine


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in {i: q for i, q in good if i % 20 == 0}.items():
        near = sorted({(-float(q @ v), j) for j, v in good if j != i})
        out[i] = [(j, -s) for s, j in near[:k]]
    return out


@pytest.mark.parametrize("n", [0, 1, 15, 900])
def test_neighbours_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16) + 2 * (i % 3)]) for i in range(n)]
    rows += [(10_000 + 20 * i, rows[0][1]) for i in range(40 if n > 500 else 0)]
    rows += [(20_000, None), (20_020, []), (20_040, [0.0] * 16), (20_060, [float("nan")] * 16), (20_080, [None] * 16), (20_100, [1.0]), (None, [1.0] * 16)]
    rows += [rows[3]] if n > 10 else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, settings=Settings(chunk=200)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute(rows, 20)
    if n <= 1:
        assert got == {}
        return
    assert got.keys() == want.keys()
    hits = 0
    vec = dict(rows)
    for q, near in got.items():
        assert len(near) == len(want[q]) and near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in {j for j, _ in near}
        hits += len({j for j, _ in near} & {j for j, _ in want[q]})
        for j, s in near:
            assert s == pytest.approx(float(np.dot(vec[q], vec[j])), rel=1e-12)
    assert hits >= 0.9 * sum(map(len, want.values()))


def chats(rows):
    by = {}
    for c, t, r, x in rows:
        if c is None:  # of no conversation
            continue
        by.setdefault(c, set()).add((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    logs = {c: [(a[3] if a[2] else None, a[5] if a[4] else None) for a in sorted(v)] for c, v in by.items()}
    logs = {c: [(r, x) for r, x in v] for c, v in logs.items()}
    kept = {}
    for c, v in logs.items():
        if any(len(o) > len(v) and o[: len(v)] == v for o in logs.values()):
            continue
        same = [d for d, o in logs.items() if o == v]
        first = min(same)
        if c == first:
            kept[c] = (len(v), len(same), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in v))
    return kept


def test_snapshots_collapse(spark):
    rng = random.Random(5)
    rows, c = [], 0
    for _ in range(30):
        turns = [(("user", "assistant")[k % 2], rng.choice(["hi", "", "é" * 400, "ok", None])) for k in range(rng.randrange(1, 9))]
        for n in {rng.randrange(1, len(turns) + 1) for _ in range(3)} | {len(turns)}:
            rows += [(c, k, r, x) for k, (r, x) in enumerate(turns[:n])]
            c += 1
    rows += [(c, 0, None, None), (c + 1, 0, "", ""), (None, 0, "user", "x"), (None, 1, "user", "y"), (c + 2, 0, "user", "x")]
    rows += rows[:4] + rows[:2] + [(c + 3, k, "user", "start") if k == 0 else (c + 3, k, "user", "t" * 5000) for k in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in format_chats(df).collect()}
    assert got == chats(rows)
    assert format_chats(df.limit(0)).count() == 0


RULES = ((("net", "/"), "block"), (("example.net", "/en/"), "allow"), (("example.com", "/de/"), "block"), (("org", "/fr/"), "allow"))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host.translate({i: i + 32 for i in range(65, 91)}), path


def fixed(host, path):
    fits = [(len(h + p), h + p, v) for (h, p), v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_against_brute_force(spark):
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://NET/", "x://a.net", "x://a.net?q=/", "http://www.Example.NET/en/1", "http://xexample.net/en/", "http://example.com/de/x#y", "http://b.example.com/den", "ftp://é.org/fr/?a=1", "http://org/fr", "a://b://net/x", "http://a.org/fr/\nnew?x"]
    rows = [(i, u) for i, u in enumerate(urls)]
    for i in range(100, 500):
        spam = i % 4 == 0
        rows.append((i, f"https://h{i % 17}.site.io/{rng.choice(['a', 'b'])}/{'casino/bonus' if spam else rng.choice(['casino', 'bonus', 'news'])}/{i}?{rng.choice(['ref', 'utm'])}=1"))
    rows += [(None, rows[0][1]), (100, rows[14][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(100, 400)] + [(None, 0, 1), (100, None, None)], "doc_id long, quality int, toxic int")
    got = filter_urls(pages, labels, settings=Mining(confidence=0.95)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parts(r.url)
        rule, verdict = fixed(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        mined = "casino" in path and "bonus" in path
        assert r.verdict == (verdict or ("block" if mined else "allow")), r.url
    assert filter_urls(pages.limit(0), labels).count() == 0
    assert all(r.verdict in ("allow", "block") and r.matched == 0 for r in filter_urls(pages, labels.limit(0)).collect())


def test_rules_that_are_mined(spark):
    rng = random.Random(8)
    rows = [(i, sorted({rng.choice("abcd") for _ in range(3)} | {"always", "too"}), bool(i % 3 == 0)) for i in range(200)]
    rows = [(i, sorted({*t, "x", "y"}) if b else t, b) for i, t, b in rows]
    s = Mining(support=0.05, least=5, confidence=0.9, lift=1.5)
    got = mine(spark.createDataFrame(rows, "id long, tokens array<string>, block boolean"), s).collect()
    # x and y always come together, so they are one token; rules with more tokens are implied by it
    assert [(r["items"], r["confidence"]) for r in got] == [(["x", "y"], 1.0)]


def test_any_twin_meets_a_rule(spark):
    """h:spam and p:casino are in the same labelled URLs; a page with either is blocked, and meets one rule."""
    bad = [(i, f"http://spam.example.com/casino/{i}") for i in range(12)]
    good = [(100 + i, f"http://site.example.com/{'news' if i % 2 else 'poker'}/{i}") for i in range(60)]
    pages = [*bad, *good, (900, "http://spam.example.com/poker/1"), (901, "http://site.example.com/casino"), (902, "http://site.example.com/poker"), (903, "http://other.org/")]
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i, _ in bad + good], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {*range(12), 900, 901}
    assert all(got[i].matched == 1 and got[i].confidence == 1.0 for i in (0, 900, 901)) and len(got) == len(pages)


def test_one_twin_of_each_group(spark):
    """A rule of two groups of twins asks for one of each."""
    word = lambda i: ("a/b/c/d", "a/b", "c/d", "n")[i % 4]
    known = [(i, f"http://x.net.io/{word(i)}?{i}") for i in range(200)]
    more = [(900, "http://y.io/a/c"), (901, "http://y.io/b/d"), (902, "http://y.io/a/b"), (903, "http://y.io/d")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in known], "doc_id long, quality int, toxic int")
    got = filter_urls(spark.createDataFrame(known + more, "page_id long, url string"), labels, settings=Mining(confidence=0.95)).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {*range(0, 200, 4), 900, 901}
    assert all(r.matched == (r.verdict == "block") for r in got)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(40, 16))
    return [(i, [float(np.float32(x)) for x in middles[i % 40] + rng.normal(size=16) / 2]) for i in range(n)]


def answers(spark, rows, s):
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, settings=s).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    return {q: [j for _, j in sorted(v)] for q, v in got.items()}


def test_neighbours_come_from_the_probed_lists(spark):
    """With a sample that is the whole table, as with any other, nothing but the probed lists gives rows."""
    rows, s = clustered(3000, 1), Settings(recall=0.0)
    x = np.array([v for _, v in rows])
    order = spark.createDataFrame([(i,) for i, _ in rows], "id long").orderBy(F.xxhash64("id"), "id").toArrow().column("id").to_numpy()
    index = fit(x[order], len(x), s)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    place = (unit @ index.centroids.T).argmax(axis=1)
    got = answers(spark, rows, s)
    assert len(got) == 150 and index.probes < len(index.centroids)
    near, far = probed(x[sorted(got)], index, s.k)
    for q, a, b in zip(sorted(got), near, far, strict=True):
        assert len(got[q]) == 20 and {place[j] for j in got[q]} <= {*a.tolist(), *b.tolist()}


def test_neighbours_with_a_small_sample(spark):
    rows = clustered(3000, 2)
    got, want = answers(spark, rows, Settings(sample=200)), brute(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & {j for j, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_short_lists_go_on(spark):
    """Rows repeated often fill the best list, yet every query gets its 20."""
    rows = clustered(800, 3)
    rows += [rows[0]] * 300 + [(40_001, [x + 1e-3 * n for x in rows[0][1]]) for n in range(1, 200)]
    got = answers(spark, rows, Settings(sample=200, recall=0.0))
    assert len(got) == 40 and all(len(v) == 20 and q not in v for q, v in got.items())


def test_one_id_with_several_vectors(spark):
    """An id is a candidate once, by the nearest of its vectors, and asks with the least of them; other dimensions take no part."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(300)]
    twice = [(i, [float(np.float32(2 * x)) for x in v]) for i, v in rows[:50]]
    other = [(i, [1.0] * 8) for i in range(500, 560)]
    got = {}
    for r in nearest(spark.createDataFrame(rows + twice + other, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    by = {}
    for i, v in rows + twice:
        by.setdefault(i, []).append(np.array(v))
    assert got.keys() == {i for i in range(0, 300, 20)}
    for q, near in got.items():
        v = min((tuple(x) for x in by[q]), key=lambda t: np.array(t).tobytes())
        asked = [x for x in by[q]]
        scores = [{j: max(float(a @ x) for x in xs) for j, xs in by.items() if j != q} for a in asked]
        assert len(near) == 20 and len(v) == 16
        assert any(all(s == pytest.approx(best[j], rel=1e-9) for j, s in near.items()) for best in scores)


def test_lists_grow_with_the_rows():
    s = Settings()
    assert s.sampled(1_000, 64) == 20_000 and s.sampled(10**8, 64) == 200_000 and s.sampled(10**8, 10**6) < 100
    x = np.random.default_rng(0).normal(size=(4000, 8))
    assert [len(fit(x, n, s).centroids) for n in (100, 40_000, 10**6, 10**9)] == [5, 100, 500, 1000]


def test_a_scan_that_finds_nothing_gives_nothing(spark):
    """Without the scan's rows there is no answer: nothing stands in for the lists."""
    rows = clustered(3000, 5)
    want = brute(rows, 20)
    bad = answers(spark, rows, Settings(sample=400, recall=0.0, epsilon=-4.0, first=21))
    assert sum(len(set(bad.get(q, ())) & {j for j, _ in want[q]}) for q in want) < 0.6 * 20 * len(want)


def test_rules_need_evidence(spark):
    """Labels that have nothing to do with URLs give no rules, however few URLs a word has."""
    rng = random.Random(3)
    rows = [(i, [f"w{rng.randrange(60)}", f"v{rng.randrange(9)}"], rng.random() < 0.25) for i in range(1500)]
    assert mine(spark.createDataFrame(rows, "id long, tokens array<string>, block boolean")).count() == 0
    told = [(i, [*t, "bad"], rng.random() < 0.8) if i % 10 == 0 else (i, t, b) for i, t, b in rows]
    got = mine(spark.createDataFrame(told, "id long, tokens array<string>, block boolean")).collect()
    assert [r["items"] for r in got] == [["bad"]]


def test_rules_by_a_shuffle_and_long_urls(spark):
    """Rules that are too many to be broadcast meet the same URLs; a very long URL is taken whole."""
    rows = [(i, f"http://a{i % 7}.io/{'spam' if i % 5 == 0 else 'ham'}/{i}") for i in range(300)] + [(900, "http://b.io/" + "x/" * 200_000 + "spam"), (901, "http://b.io/" + "y" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    both = [sorted((r.page_id, r.verdict, r.matched, r.mined_rules) for r in filter_urls(pages, labels, settings=Mining(broadcast=n)).collect()) for n in (20_000, 0)]
    assert both[0] == both[1] and dict((i, v) for i, v, *_ in both[0])[900] == "block" and dict((i, v) for i, v, *_ in both[0])[901] == "allow"
    assert {r[3] for r in both[0]} == {1}
