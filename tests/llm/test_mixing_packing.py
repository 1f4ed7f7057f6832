import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import Settings, apply_mix, mix
from tessera.llm.packing import Settings as Packing
from tessera.llm.packing import WordTokenizer, cut, pack, plan


def documents(seed=1, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 3, 40, 200]))), rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "", "empty"), (0, rows[0][1], rows[0][2]), (None, "x y z", "b"), (n + 2, "w " * 20_000, "b")]


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        if not over:
            out.update({s: weight[s] * unit for s in free})
            break
        out.update({s: 2.0 * sizes[s] for s in over})
        free -= over
    return out


def test_mix_meets_its_targets(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), s
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mix(docs.repartition(7)).collect()))
    out = apply_mix(docs.withColumn("n_chars", F.length("text").cast("long")), mix(docs))
    words = out.select(F.sum(F.expr("size(filter(split(text, ' '), x -> x <> ''))")).alias("n"), F.sum("n_chars").alias("c"), F.sum(F.length("text")).alias("l")).first()
    assert abs(words.n - sum(taken.values())) <= 2 and words.c == words.l


def test_slots_interleave_sources(spark):
    """Every stretch of the schedule has each source in about the share it has of the whole; the slots' words are what is taken."""
    rows = [(i, " ".join(["w"] * (5 + i % 40)), "abc"[i % 3]) for i in range(3000)]
    got, filled, of = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect(), defaultdict(int), {}
    for r in got:
        assert r.taken == sum(x.words for x in r.slots) and [x.slot for x in r.slots] == sorted({x.slot for x in r.slots})
        for x in r.slots:
            assert of.setdefault(x.slot, r.source) == r.source
            filled[x.slot] += x.words
    order = [of[n] for n in sorted(of)]
    for s in "abc":
        share = order.count(s) / len(order)
        assert len({filled[n] for n in of if of[n] == s}) <= 2  # equal blocks, and a last one
        for k in range(0, len(order) - 200, 200):
            assert abs(order[k : k + 200].count(s) - 200 * share) <= 6


def test_mix_of_nothing(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)]


def check_plan(histogram, settings):
    steps, sequences = plan(histogram, settings)
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, rank, count, first, offset in steps.tolist():
        ranks[length].append((rank, count))
        for k in range(count):
            fill[first + k].append((offset, length))
    for length, n in histogram.items():
        at = 0
        for rank, count in sorted(ranks[length]):
            assert rank == at
            at += count
        assert at == n
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= settings.capacity
    assert len(fill) == sequences
    return sequences


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2048, 4000), rng.integers(1, 60, 4000), rng.integers(1100, 2048, 500), np.full(999, 682), rng.integers(1, 2048, 3), np.minimum(2047, rng.geometric(0.002, 4000))][seed]
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    n = check_plan(histogram, Packing())
    bound = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    assert n <= bound * 1.03 + 1
    assert check_plan(histogram, Packing(small=0, groups=5)) >= n * 0.9
    assert plan({}, Packing())[1] == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [None, "", "It's ΣΑΣ é é x y <|endoftext|> naïve!?", "İstanbul\x0bʼn ﬁ\r\n", "word " * 30_000, *(" ".join("".join(rng.choice("abcdé ") for _ in range(9)) for _ in range(rng.randrange(900))) for _ in range(120))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = pack(cut(docs, path)).collect()
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((d is None, d or 0, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(cut(docs.limit(0), path)).count() == 0


@pytest.mark.parametrize("size", [1, 37, 1 << 22])
def test_cut_at_any_slice_and_length(spark, size):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [None, "", " \n\x0b ", *("a " * n for n in (1, 7, 8, 15, 16, 17)), "\u00a0é\u2003x " * 9, "<|startoftext|> no. , 12 " * 4, "x" * 90, "日本 語" * 5]
    s = Packing(capacity=8, slice=size)
    got = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, settings=s).collect()
    want = []
    for d, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 8):
            want.append((d, k // 8, k, len(ids[k : k + 8]), zlib.crc32(np.array(ids[k : k + 8], "<u4").tobytes())))
    assert sorted(map(tuple, got)) == want


def test_pack_leaves_other_columns_alone(spark):
    pieces = spark.range(40).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1000L AS length", "id AS ids_crc32", "'x' AS h_", "id AS b_", "'y' AS rank_", "'z' AS offset")
    got = pack(pieces)
    assert got.columns == [*pieces.columns, "sequence_id", "offset_"]
    rows = got.collect()
    assert len({r.sequence_id for r in rows}) == 20 and {(r.h_, r.b_ - r.doc_id, r.rank_, r.offset) for r in rows} == {("x", 0, "y", "z")}


def test_ids_of_odd_texts():
    """Ids put together from distinct words against the whole tokenizer, on texts of odd characters."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own, rng = Tokenizer.from_file(path), WordTokenizer(path), random.Random(5)
    bits = [*"abcXYZ éßÀñİıſŉŐ.,;'’-_0123¼²<|>日本   ́é😀ﬁΣς\t\n", "<|endoftext|>", "it's", "'LL", "don't.", "a.b", "x,", "É", "NAÏVE,", "ǅ"]
    for _ in range(60):
        slices = [["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(9)] for _ in range(2)]
        for texts, (ids, ends) in zip(slices, own.texts([pa.array(x) for x in slices]), strict=True):
            want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            assert np.frombuffer(ids, "<u4").tolist() == [i for x in want for i in x] and ends.tolist() == np.cumsum([len(x) for x in want]).tolist()
