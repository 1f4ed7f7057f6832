import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.near_dup import Settings, _facing, _told_apart, keep_one, near_duplicates


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = roots(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return sorted((d is None, d or 0, len(sets[i]), least.get(root[i], -1)) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(900)] + ["É", "naïve", "ÀB"]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 6, 30, 120, 400]))]
        for k in range(rng.choice([1, 2, 14])):
            copy = list(base)
            for _ in range(k // 2):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((n, " ".join(copy)))
            n += 1
    # one far from the smallest of its group, but near its middle
    chain = [f"c{i}" for i in range(100)]
    for k in range(6):
        rows.append((n, " ".join([f"x{k}{i}" for i in range(2 * k)] + chain[2 * k :])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, "one two three"), (None, rows[0][1]), (None, "alone with no id at all"), (0, rows[0][1]), (1, "same id other text here"), (n + 6, "long " * 30_000 + "x")]
    return rows


def test_components_of_a_chain_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201)]
    rows = components(spark.createDataFrame(links, "u long, v long")).collect()
    got = {r.node: r.root for r in rows}
    want = roots({x for e in links for x in e}, links)
    assert got == want and len(rows) == len(got)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x"))
    for settings in (Settings(), Settings(block=2, slice=100, salts=3, hot=1), Settings(cells=50, slice=1)):
        got = near_duplicates(docs, settings=settings).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == expected(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, class long")
    kept = keep_one(docs).collect()
    groups = {(c, n) for _, _, n, c in expected(rows) if n}
    assert len([r for r in kept if shingles(r.text)]) == len({c for c, _ in groups})
    assert len([r for r in kept if not shingles(r.text)]) == 3
    assert keep_one(docs).columns == docs.columns


def test_sets_with_one_first_hash_are_told_apart(spark):
    sets = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 5), (5, None, None)], "doc_id long, class long, other long")
    got = {r.doc_id: r["class"] for r in _told_apart(sets).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 8 and got[5] is None and len(set(got.values())) == 4
    assert {r["class"] for r in _told_apart(sets.filter("doc_id <> 2")).collect()} == {7, 8, None}


def test_blocks_hold_every_pair_of_strays_and_stay_small(spark):
    """A bucket of one large component and some strays makes few rows; every stray meets every class of another component."""
    rows = [(1, k, 0 if k < 3000 else k, 10) for k in range(3005)] + [(2, k, 0, 10) for k in range(50)] + [(3, 1, 1, 10), (3, 2, 2, 10)]
    members = spark.createDataFrame(rows, "band long, class long, root long, n_shingles long")
    got = _facing(members, len(rows), Settings()).collect()
    assert len(got) < 3005 + 3 * 5 + 10 and {r.band for r in got} == {1, 3}
    left, right = {}, {}
    for r in got:
        (left if r.side == 0 else right).setdefault((r.band, r.i, r.j), []).append(r["class"])
    met = {(b, x, y) for (b, i, j), xs in left.items() for x in xs for y in right[b, i, j]}
    assert {(1, x, y) for x in range(3000, 3005) for y in range(3005)} <= met and ((3, 1, 2) in met or (3, 2, 1) in met)


def test_keep_one_with_clashing_names_and_repeated_rows(spark):
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "y"), (5, "A b c d e f", "z"), (9, "a b c d e f", "x"), (None, None, "n"), (None, "", "n"), (None, "only nulls have this one text here", "q"), (None, "only nulls have this one text here", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_dup_key_ string")
    got = sorted(keep_one(docs).collect(), key=str)
    assert len(got) == 4 and len([r for r in got if r.doc_id == 5]) == 1 and len([r for r in got if r.near_dup_key_ == "q"]) == 1
    assert got == sorted(keep_one(docs.repartition(5)).collect(), key=str) and keep_one(docs.limit(0)).count() == 0


def test_sketches_of_similar_sets_are_not_passed_over():
    """The gate on sketches, over pairs at the threshold and just above it: no pair that links is far below."""
    from tessera.llm.near_dup import sketches

    s, rng = Settings(), np.random.default_rng(2)
    agree, likeness = [], []
    for size in (20, 60, 400):
        for _ in range(400):
            n = size - size % 4
            pool = rng.integers(1, 2**63, n + n // 4, dtype=np.uint64)
            # |A & B| = n - n / 4 + ..., similarity at 0.75 or a little over
            both, rest = pool[: 3 * n // 4], pool[3 * n // 4 :]
            a, b = np.concatenate([both, rest[: n // 8]]), np.concatenate([both, rest[n // 8 : n // 4]])
            likeness.append(len(both) / len(set(a.tolist()) | set(b.tolist())))
            x = sketches([np.unique(a), np.unique(b)], s.size)
            agree.append(int((x[0] == x[1]).sum()))
    assert min(likeness) >= 0.75 and min(agree) >= s.agree
    assert abs(np.mean(agree) / s.size - np.mean(likeness)) < 0.01
