import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kneser_ney as kn
from tessera.llm import toxicity as tox
from tessera.llm.toxicity import INSULTS, Scorer, Settings, held_out, learn, score, toxicity
from tessera.llm.transducers import TAGS, compose, grammar, insults, negation, reported_speech, threats


def naive_bits(texts, order, a=kn.A):
    """Interpolated modified Kneser-Ney by dictionaries."""
    grams = {k: {} for k in range(1, order + 1)}
    for t in texts:
        s = [int(kn._CLASS[b]) for b in b"\n" * (order - 1) + t]
        for i in range(len(s) - order + 1):
            g = tuple(s[i : i + order])
            grams[order][g] = grams[order].get(g, 0) + 1
    types = set(grams[order])
    for k in range(order - 1, 0, -1):
        for g in types:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
        types = {g[1:] for g in types}

    def discount(k):
        n = [max(1, sum(c == j for c in grams[k].values())) for j in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05), 0.95 * j) for j in (1, 2, 3))]

    d = {k: discount(k) for k in grams}

    def p(g):
        if not g:
            return 1 / a
        k, h = len(g), g[:-1]
        follow = [c for x, c in grams[k].items() if x[:-1] == h]
        if not follow:
            return p(g[1:])
        c = grams[k].get(g, 0)
        return max(c - d[k][min(c, 3)], 0) / sum(follow) + sum(d[k][min(c, 3)] for c in follow) / sum(follow) * p(g[1:])

    return lambda g: -math.log2(p(g))


def test_kneser_ney_against_dictionaries(spark):
    s = kn.Settings(order=3)
    texts = ["the cat sat", "the hat, the cat!", "", None, "Über den Ähren 12"]
    table = kn.fit(spark.createDataFrame([(t,) for t in texts], "text string"), s)
    assert table.shape == (kn.A**3,) and np.exp2(-table.astype(float)).reshape(-1, kn.A).sum(axis=1) == pytest.approx(1, abs=1e-4)
    bits = naive_bits([t.encode() for t in texts if t], 3)
    for g in [*itertools.product((0, 7, 19, 28, 29), repeat=3), (26, 37, 1)]:
        assert table[g[0] * kn.A**2 + g[1] * kn.A + g[2]] == pytest.approx(bits(g), rel=1e-4)
    n, total, _ = kn.document_bits([b"the cat", None, b"", b"the cat"], table, 3)
    want = sum(bits(tuple(int(x) for x in kn._CLASS[list((b"\n\n" + b"the cat")[i : i + 3])])) for i in range(7))
    assert n.tolist() == [7, 0, 0, 7] and total[[0, 3]] == pytest.approx([want, want], rel=1e-4)
    long = b"the cat sat on the mat. " * 100_000
    whole, parts = kn.document_bits([long], table, 3), [kn.document_bits([long[:1000]], table, 3)]
    assert whole[0][0] == len(long) and abs(whole[1][0] / whole[0][0] - parts[0][1][0] / 1000) < 0.05


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(1)
    prose = lambda: ". ".join(" ".join(rng.choice(["the", "river", "stone", "under", "and", "garden", "of", "light"]) for _ in range(9)) for _ in range(8))
    rows = [(i, prose(), "en") for i in range(120)] + [(200 + i, prose().upper().replace(" ", "## "), "en") for i in range(20)] + [(300, None, None), (301, "", "fr"), (302, "the", "fr"), (0, prose(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("bits", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in (*range(110), *range(200, 210), 5)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out, names = kn.classify(docs, labels)
    got = {(r.doc_id, r.lang): r[names["kept"]] for r in out.collect()}
    wrong = {k for k, v in got.items() if v == (200 <= k[0] < 300)}
    assert len(got) == len(rows) and not wrong
    none, names = kn.classify(docs, labels.limit(0))
    assert all(r[names["kept"]] for r in none.collect())
    assert kn.classify(docs.limit(0), labels)[0].count() == 0


def test_quality_without_unseen_documents(spark):
    """Few labels: all trusted documents may fall to one share; then all of them train, or set the threshold."""
    texts = [(i, "the river under the stone " * 9, None) for i in range(30)]
    docs = spark.createDataFrame([*texts, (99, "#### " * 90, None)], "doc_id long, text string, lang string")
    away = {r.id for r in spark.range(30).filter(kn.unseen(F.col("id"), kn.Settings())).collect()}
    for ids in (away, set(range(30)) - away):
        out, m = kn.classify(docs, spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int"))
        assert {r.doc_id for r in out.collect() if not r[m["kept"]]} == {99}


def test_quality_threshold_is_the_quantile(spark):
    """The threshold is the perplexity of a trusted document of the language that did not train, the least that the quantile's share do not exceed."""
    rng = random.Random(2)
    words = ["the", "river", "stone", "under", "and", "garden", "of", "light"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)), ("en", "fr")[i % 2]) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(words) + "#" * (rng.random() < i / 100) for _ in range(2000)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    out, m = kn.classify(docs, labels)
    got = out.collect()
    away = {r.id for r in spark.range(300).filter(kn.unseen(F.col("id"), kn.Settings())).collect()}
    assert 40 < len(away) < 110
    table = kn.fit(docs.filter(F.col("doc_id").isin([i for i in range(300) if i not in away])).select("text"))
    assert [r[m["bits"]] for r in sorted(got)] == pytest.approx([x / n for n, x in zip(*(v.tolist() for v in kn.document_bits([r.text.encode() for r in sorted(got)], table, 4)[:2]), strict=True)])
    for lang in ("en", "fr"):
        (limit,) = {r[m["threshold_bits"]] for r in got if r.lang == lang}
        trusted = sorted(r[m["bits"]] for r in got if r.lang == lang and r.doc_id in away)
        assert limit == trusted[math.ceil(0.98 * len(trusted)) - 1]
        assert all(r[m["kept"]] == (r[m["floor_bits"]] <= limit) for r in got if r.lang == lang)
    assert not all(r[m["kept"]] for r in got)


def test_quality_joins_count_shards(spark, monkeypatch):
    """Perplexities come from joins with the sharded counts, block by block; no table of them is gathered or broadcast."""
    rng = random.Random(3)
    words = ["the", "river", "Stone", "under", "and", "12", "of", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))), "en") for i in range(60)]
    rows += [(60, "no such thing? " * 400, None), (61, None, "en"), (62, "", "en"), (None, "the river", "en"), rows[5], (5, "another #text", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(5, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    s = kn.Settings(order=3, slice=300, block=800)
    away = {r.id for r in spark.range(60).filter(kn.unseen(F.col("id"), s)).collect()}
    trained = [t for i, t, _ in rows if i in {*range(0, 60, 2), 5} - away]
    bits = naive_bits([t.encode() for t in trained], 3)

    def gathered(*args, **more):
        raise AssertionError("a table of the model is gathered")

    with monkeypatch.context() as m:
        m.setattr(type(docs), "toArrow", gathered)
        m.setattr(type(docs), "toPandas", gathered)
        m.setattr(spark.sparkContext, "broadcast", gathered)
        out, names = kn.classify(docs, labels, settings=s)
        got = out.collect()
    assert sorted(map(str, (tuple(r[:3]) for r in got))) == sorted(map(str, rows))
    for r in got:
        x = [int(kn._CLASS[b]) for b in b"\n\n" + (r.text or "").encode()]
        known = {g: bits(g) for g in {tuple(x[i : i + 3]) for i in range(len(x) - 2)}}
        assert r[names["n_bytes"]] == len(x) - 2
        assert r[names["bits"]] == (pytest.approx(sum(known[tuple(x[i : i + 3])] for i in range(len(x) - 2)) / (len(x) - 2), rel=1e-5) if len(x) > 2 else None)
    counts = kn.count_ngrams(docs.select("text"), s)
    plan = kn.ngram_bits(kn.model(counts, 3), counts.select("gram"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    blocks = kn.blocks_of(docs, "text", F.col("doc_id"), s)
    assert blocks.count() > 10
    plan = kn._meet(blocks, blocks.select("block"), lambda a, b: b, "block long")._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan and not [x for x in plan.splitlines() if "RoundRobin" in x or "Exchange hashpartitioning(of_block" in x]


WEIGHTS = Settings().weights


def clause(tags):
    return grammar(WEIGHTS).run(tags)[1]


def test_grammar_composes_its_parts():
    rng = random.Random(4)
    inner = (*TAGS, "denied", "quoted")
    whole = grammar(WEIGHTS)
    for _ in range(300):
        tags = [rng.choice(TAGS) for _ in range(rng.randrange(9))]
        out, total = tags, 0.0
        for t in (negation(), reported_speech(), threats(WEIGHTS), insults(WEIGHTS)):
            out, w = t.run(out)
            total += w
        assert whole.run(tags) == (out, pytest.approx(total))
    assert compose(negation(), insults(WEIGHTS), inner).run(["insult"])[1] == WEIGHTS["insult"]


def test_grammar_reads_clauses():
    assert clause(["target", "insult"]) > clause(["insult"]) > clause(["report", "insult"]) > clause(["negation", "insult"]) > 0
    assert clause(["will", "threat", "target"]) > 0 == clause(["threat"]) == clause(["will", "negation", "threat", "target"])
    assert clause(["negation", "word", "word", "word", "insult"]) == clause(["insult"])
    aimed = clause(["will", "threat", "target"])
    assert clause(["word", "modal", "target", "threat"]) == clause(["target", "modal", "word", "threat"]) == clause(["modal", "threat", "target"]) == aimed
    assert clause(["modal", "negation", "target", "threat"]) == clause(["negation", "person", "modal", "word", "threat"]) == clause(["modal", "threat"]) == clause(["target", "threat"]) == clause(["will", "target", "threat"]) == 0


@pytest.mark.parametrize("text", ["I will kill you.", "Ich werde dich töten.", "Je vais te tuer !", "Te voy a matar.", "du idiot, dich mag ich", "tu es une ordure", "eres un estúpido, tú"])
def test_threats_and_insults_in_four_languages(text):
    scorer = Scorer({f"{w}$": 1e-6 for w in INSULTS}, math.log(0.1), Settings())
    quiet = [text.split()[0], "Ich werde dich nicht töten.", "Er sagte, ich werde dich töten.", "Je ne vais pas te tuer", "il a dit ordure", "no te voy a matar"]
    assert scorer.score(text.encode()) >= 0.3 > max(scorer.score(t.encode()) for t in quiet)


def test_scores():
    s = Settings()
    scorer = Scorer({"idiot$": 1e-6, "vequ": 1e-5}, math.log(0.1), s)
    p = lambda t: scorer.score(t.encode() if t is not None else None)
    assert p("You idiot.") > p("An idiot") > p("They said idiot") > p("not an idiot") > p("a lovely day") == p("") == p(None)
    assert p("VEQUTA là, idiot") > 0.3 > p("not an idiot") and p("idiotic") == p("")
    assert p("I will kill you") > 0.3 > p("kill the process")
    often = Scorer({"idiot$": 1e-3}, math.log(0.1), s)
    assert often.score(b"you idiot") > 0.3 > often.score(b"you idiot " + b"word " * 2000)


def make_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ru", "te", "so"]) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(60)]
        y = i % 5 == 0
        for _ in range(3 if y else 0):
            words[rng.randrange(60)] = rng.choice(["grumb", "xelva" + word(), "xelva" + word()])
        rows.append((i, " ".join(words) + "."))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, int(y)))
    rows += [(10_000, None), (10_001, ""), (None, "grumb"), (0, rows[0][1])]
    return rows, labels


def test_lexicon_is_learned_from_training_rows_only(spark):
    rows, labels = make_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon, base = learn(docs, marks)
    assert any(f.startswith("grumb") for f in lexicon) and any(f.startswith("xelv") for f in lexicon) and all(f.startswith(("grum", "xelv")) for f in lexicon)
    ids = spark.createDataFrame([(i,) for i in range(600)], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    import zlib

    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ids)
    flipped = spark.createDataFrame([(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in labels], marks.schema)
    assert learn(docs, flipped) == (lexicon, base)
    out, name = score(docs, lexicon, base)
    got = {(r.doc_id, r.text): r[name] for r in out.collect()}
    for i, t in rows:
        assert 0 < got[i, t] < 1 and (got[i, t] >= 0.3) == (bool(t) and ("grumb" in t or "xelva" in t))
    assert toxicity(docs.limit(0), marks)[0].count() == 0
    plain, name = toxicity(spark.createDataFrame([(1, "you stupid idiot"), (2, "fine")], "doc_id long, text string"), marks.limit(0))
    assert [r[name] >= 0.3 for r in plain.orderBy("doc_id").collect()] == [True, False]


def test_mining_against_plain_counts(spark):
    rows, _ = make_rows()
    rows = [(i, t) for i, t in rows if i is not None and i < 90] + [rows[3], (2_000, "É" + "ab" * 3000 + " x " + "abc d " * 9), (2_001, "")]
    s = Settings(contexts=3, slice=50)
    n, got = tox._mined(spark.createDataFrame(rows, "id long, text string"), s)
    texts, in_rows, contexts = set(rows), {}, {}
    for r in texts:
        words, mine = tox._words((r[1] or "").encode()), {}
        for k, w in enumerate(words):
            context = (words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "")
            for f in [w + "$"] * (len(w) >= 3) + [w[:j] for j in range(3, min(12, len(w)) + 1)]:
                mine.setdefault(f, context)
        for f, context in mine.items():
            in_rows.setdefault(f, set()).add(r)
            contexts.setdefault(f, set()).add(context)
    assert n == len(texts)
    assert sorted(got) == sorted((f, len(x), len(contexts[f])) for f, x in in_rows.items() if len(x) >= 3 and len(contexts[f]) >= 3)


def test_score_against_a_plain_reading(spark):
    """Scores recomputed clause by clause, with the four transducers run one after another."""
    lexicon, base, s = {"idiot$": 1e-4, "vequ": 1e-3}, math.log(0.05), Settings(slice=40)
    rng = random.Random(6)
    words = ["you", "idiot", "vequta", "not", "said", "will", "kill", "them", "tree", "idiotic", '"', ",", ".", "!", "\n"]
    texts = [None, "", "idiot " * 3000, *(" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(80))]
    out, name = score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon, base, settings=s)
    parts = (negation(), reported_speech(), threats(WEIGHTS), insults(WEIGHTS))
    for r in out.collect():
        every, total, clause_ = tox._words((r.text or "").encode()), 0.0, []
        for token in [*tox._TOKEN.findall((r.text or "").lower()), "."]:
            if token not in ".!?;:\n":
                rate = lexicon["idiot$"] if token == "idiot" else lexicon["vequ"] if token.startswith("vequ") else None
                clause_.append((token, 0.0 if rate is None else math.log1p(s.hits / max(s.chance, rate * len(every)))))
                continue
            kinds = {"you": "target", "them": "target", "not": "negation", "said": "report", '"': "report", "will": "will", "kill": "threat"}
            tags, weight = ["insult" if w else kinds.get(t, "word") for t, w in clause_], 0.0
            for p in parts:
                tags, w = p.run(tags)
                weight += w
            total += weight * (max([w for _, w in clause_], default=0) or math.log1p(s.hits / s.chance))
            clause_ = []
        z = base + math.log1p(math.exp(min(total, 60) - s.hits)) - math.log1p(math.exp(-s.hits))
        assert r[name] == pytest.approx(1 / (1 + math.exp(-min(30, z)))), r
