"""Toxicity by a weighted finite-state grammar over clauses.

Words are tagged by a lexicon and each clause is read by one transducer, composed of four (negation,
reported speech, threats, insults with targets). Matched clauses, not isolated words, add to a document's
log-odds; denied and quoted matches add less.

The insult lexicon is learned: from a bounded sample of labelled training rows (Settings.toxic and
Settings.clean rows at most, those with the smallest hashes of their ids) come words and word beginnings
that toxic rows hold significantly more often than clean ones, in several different contexts, so copies of one text
prove nothing; of those that begin alike the most telling one is taken. Each has the rate at which clean
text holds it by chance: a match weighs log(1 + hits / expected), with what its document's length lets
expect, so long clean texts do not add up to toxic ones. A fixed list of common insults serves where
labels say nothing.

Defined results: a null or empty text scores the base rate, under the threshold; a null doc_id counts as
held out of nothing (its checksum is of no text) and never trains; repeated labels of a document agree if
any says toxic; repeated rows score alike; an empty table gives an empty result; without labels the fixed
list alone is used; all columns of the input pass through score(). Texts are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.support import as_bytes, free_name, materialize, release, slices, tidy
from tessera.llm.transducers import grammar

#: Function words of the grammar in English, German, French and Spanish.
TARGETS = frozenset(
    "you your you're youre yourself he she they him them her u ur everyone nobody people these those that this it "
    "dich dir euch tu toi vous tú usted ustedes".split()
)
#: Of the other languages, those that only a threat is looked at for: by themselves they are too common.
PERSONS = frozenset("du ihr sie ihn ihm er te il elle ils elles lui leur ti vosotros os él ella ellos ellas".split())
NEGATIONS = frozenset(
    "not no never isn't isnt aren't arent wasn't wasnt don't dont doesn't doesnt didn't didnt won't wont cannot can't cant neither nor "
    "nicht kein keine keinen keiner nie niemals pas jamais rien aucun aucune ni nunca jamás ningún ninguna".split()
)
REPORTS = frozenset(
    "said says say saying told tells wrote writes called calls claimed claims quoted quote quotes according alleged reported reportedly "
    "sagt sagte sagen behauptet behaupten schrieb schreibt laut nannte nennt dit disent selon écrit affirme prétend appelle dijo dicen según escribió afirma afirmó llamó".split()
)
WILLS = frozenset("will i'll ill we'll gonna shall going should must".split())
#: The same of languages in which the target may stand before the verb.
MODALS = frozenset("werde werden wirst wird vais vas va allons voy vamos van".split())
THREATS = frozenset(
    "kill hurt beat destroy stab shoot murder smash burn punch strangle hunt crush "
    "töten umbringen schlagen verprügeln erschießen verbrennen zerstören erwürgen erstechen tuer frapper tabasser détruire brûler étrangler poignarder abattre "
    "matar golpear apuñalar destruir quemar estrangular disparar".split()
)
#: Insults known without labels.
INSULTS = frozenset(
    "idiot idiots moron morons stupid pathetic worthless disgusting scum loser losers trash clown imbecile filth vermin "
    "dummkopf trottel arschloch abschaum widerlich versager imbécile imbéciles crétin ordure minable idiota idiotas estúpido estúpida imbécil basura escoria".split()
)

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]|[\"“”«»]")
_ENDS = frozenset(".!?;:\n")
_QUOTES = frozenset('"“”«»')


@dataclass(frozen=True)
class Settings:
    #: Rows that may train, by label: the bound of the sample.
    toxic: int = 2_000
    clean: int = 8_000
    #: Shortest and longest word beginning that is looked at, in characters.
    shortest: int = 3
    longest: int = 12
    #: A feature's least distinct contexts in toxic rows, and least log-likelihood ratio.
    contexts: int = 4
    evidence: float = 24.0
    #: Most of the toxic rows' share that its share of clean rows may reach.
    clean_share: float = 0.5
    threshold: float = 0.3
    #: Matches that a toxic document is expected to have at least, and the least expected of a clean one.
    hits: float = 3.0
    chance: float = 0.06
    #: Bytes of text that a task takes at a time (about).
    slice: int = 4 << 20
    weights: dict[str, float] = field(default_factory=lambda: {"insult": 1.0, "denied": 0.25, "quoted": 0.4, "target": 0.5, "threat": 1.5})


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


# --- learning -------------------------------------------------------------------------------------


def _words(text: bytes | None) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.decode("utf-8", "replace").lower()) if text else []


def _features(word: str, s: Settings) -> list[str]:
    """The word itself, with $ at its end, and its beginnings."""
    return [f"{word}$", *(word[:k] for k in range(s.shortest, min(len(word), s.longest) + 1))] if len(word) >= s.shortest else []


def _mined(texts: DataFrame, s: Settings) -> tuple[int, list[tuple[str, int, int]]]:
    """Number of distinct texts of (id, text), and (feature, rows, distinct contexts) of words and beginnings in so many of both.

    A context is the word before and the one after; each text gives a feature the context of its first
    occurrence. Features are spread over the tasks as hashes and counted by shuffles; only those that pass
    come to the driver, and their names after them.
    """
    once = materialize(texts.groupBy("id", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
        for b in batches:
            for at, n in slices(b.column(0), s.slice):
                yield from map(_words, as_bytes(b.column(0).slice(at, n)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for words in words_of(batches):
            first: dict[str, int] = {}
            for k, w in enumerate(words):
                first.setdefault(w, k)
            found, contexts = [], []
            for w, k in first.items():
                if w not in known:
                    known[w] = np.array([_hash(f) for f in _features(w, s)], np.int64)
                if len(known[w]):
                    found.append(known[w])
                    contexts.append(_hash(f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}"))
            if found:
                sizes = [len(x) for x in found]
                each, at = np.unique(np.concatenate(found), return_index=True)  # a beginning's first word counts
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.repeat(np.array(contexts, np.int64), sizes)[at])], names=["f", "context"])
            if len(known) > 200_000:
                known.clear()

    pairs = once.select("text").mapInArrow(tidy(emit), "f long, context long").groupBy("f", "context").agg(F.count("*").alias("n"))
    passed = pairs.groupBy("f").agg(F.sum("n").alias("rows"), F.count("*").alias("contexts")).filter((F.col("rows") >= s.contexts) & (F.col("contexts") >= s.contexts)).toArrow()
    counts = dict(zip(passed.column("f").to_pylist(), zip(passed.column("rows").to_pylist(), passed.column("contexts").to_pylist(), strict=True), strict=True))
    # the tasks look hashes up in an array: a set of as many would take ten times the memory
    wanted = texts.sparkSession.sparkContext.broadcast(np.sort(passed.column("f").to_numpy()))
    del passed

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        hashes = wanted.value
        for words in words_of(batches):
            new = set(words) - seen
            seen |= new
            names = sorted({f for w in new for f in _features(w, s)})
            keys = np.array([_hash(f) for f in names], np.int64)
            hit = hashes[np.minimum(np.searchsorted(hashes, keys), max(len(hashes) - 1, 0))] == keys if len(hashes) else np.zeros(len(keys), bool)
            yield pa.RecordBatch.from_pydict({"f": pa.array([f for f, h in zip(names, hit.tolist(), strict=True) if h], pa.string())})

    names = once.select("text").mapInArrow(tidy(name), "f string").distinct().toArrow().column("f").to_pylist()
    return once.count(), [(f, *counts[_hash(f)]) for f in names]


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _ratio(a: float, n1: float, b: float, n0: float) -> float:
    """Twice the log-likelihood ratio of a feature in a of n1 and b of n0 rows against one common rate."""
    g = 0.0
    for x, n in ((a, n1), (b, n0)):
        rate = (a + b) / (n1 + n0)
        for got, expected in ((x, n * rate), (n - x, n * (1 - rate))):
            if got > 0 and expected > 0:
                g += 2 * got * math.log(got / expected)
    return g


def _select(toxic: list[tuple[str, int, int]], clean: dict[str, tuple[int, int]], n1: int, n0: int, words: int, s: Settings) -> dict[str, float]:
    """feature -> its rate per clean word. The strongest first, the longest of equals; one that begins like a chosen one, or the other way round, adds nothing."""
    found = []
    for f, rows, contexts in toxic:
        a, b = min(rows, contexts), clean.get(f, (0, 0))[0]
        if contexts >= s.contexts and b / max(1, n0) <= s.clean_share * a / max(1, n1):
            g = _ratio(a, n1, b, n0)
            if g >= s.evidence:
                found.append((-g, -len(f), f))
    kept: dict[str, float] = {}
    for _, _, f in sorted(found):
        bare = f.rstrip("$")
        if not any(bare.startswith(k.rstrip("$")) or k.startswith(bare) for k in kept):
            kept[f] = clean.get(f, (0, 0))[1]
    # a chosen feature stands for its kin: what begins alike meets clean text by chance together
    kin: Counter = Counter()
    for f, n in kept.items():
        kin[f[: s.shortest]] += n
    return {f: (kin[f[: s.shortest]] + 0.2) / max(1, words) for f in kept}


#: Rate of the fixed insults in clean text.
_RARE = 1e-6


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", settings: Settings = Settings()) -> tuple[dict[str, float], float]:
    """Insult features (word$ or beginning) with their rates per clean word, and the base log-odds, from training rows only."""
    s = settings
    c = lambda n: F.col(f"`{n}`")
    known = labels.select(c(doc_id).cast("long").alias("id"), c(toxic).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")).filter(~held_out(F.col("id")))
    base = known.agg(F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("k")).first()
    if not base["k"] or base["k"] == base["n"]:
        return {f"{w}$": _RARE for w in INSULTS}, math.log(0.1)
    h = F.xxhash64("id")
    ids = {y: known.filter(F.col("y") == y).orderBy(h, "id").limit(n).select("id") for y, n in ((1, s.toxic), (0, s.clean))}
    read = docs.select(c(doc_id).cast("long").alias("id"), c(text).alias("text"))
    # broadcast: at most settings.toxic or settings.clean ids
    n1, ready = _mined(read.join(F.broadcast(ids[1]), "id"), s)
    # what no clean count could save is left out before clean rows are read
    wanted = frozenset(r[0] for r in ready)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, times, known = Counter(), Counter(), {}
        for b in batches:
            for t in (t for at, n in slices(b.column(1), s.slice) for t in as_bytes(b.column(1).slice(at, n))):
                words = Counter(_words(t))
                docs_[""] += 1
                times[""] += sum(words.values())
                hit: Counter = Counter()
                for w, n in words.items():
                    if w not in known:
                        known[w] = [f for f in _features(w, s) if f in wanted]
                    for f in known[w]:
                        hit[f] += n
                docs_.update(hit.keys())
                times.update(hit)
                if len(known) > 200_000:
                    known.clear()
        if docs_:
            yield pa.RecordBatch.from_pydict({"f": list(docs_), "r": pa.array(docs_.values(), pa.int64()), "k": pa.array([times[f] for f in docs_], pa.int64())})

    counted = read.join(F.broadcast(ids[0]), "id").mapInArrow(tidy(count), "f string, r long, k long").groupBy("f").agg(F.sum("r").alias("r"), F.sum("k").alias("k")).toArrow()
    clean = dict(zip(counted.column("f").to_pylist(), zip(counted.column("r").to_pylist(), counted.column("k").to_pylist(), strict=True), strict=True))
    del counted
    n0, words = clean.pop("", (0, 0))
    lexicon = _select(ready, clean, n1, n0, words, s)
    if not lexicon:
        lexicon = {f"{w}$": _RARE for w in INSULTS}
    del ready, clean, wanted
    release()
    return lexicon, math.log(base["k"] / (base["n"] - base["k"]))


# --- scoring ----------------------------------------------------------------------------------------


class Scorer:
    def __init__(self, lexicon: dict[str, float], base: float, settings: Settings):
        self.words = {f[:-1]: r for f, r in lexicon.items() if f.endswith("$")}
        self.starts = {f: r for f, r in lexicon.items() if not f.endswith("$")}
        self.lengths = sorted({len(f) for f in self.starts})
        self.base, self.s = base, settings
        self.transducer = grammar(settings.weights)
        self.plain = math.log1p(settings.hits / settings.chance)

    def weight(self, word: str, length: int) -> float:
        """What a match of this word weighs in a text of so many words; 0 for words out of the lexicon."""
        rates = [self.words[word]] if word in self.words else []
        rates += [self.starts[word[:n]] for n in self.lengths if word[:n] in self.starts]
        return math.log1p(self.s.hits / max(self.s.chance, min(rates) * length)) if rates else 0.0

    def tag(self, word: str, weight: float) -> str:
        if weight:
            return "insult"
        for tag, words in (("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS), ("will", WILLS), ("modal", MODALS), ("target", TARGETS), ("person", PERSONS)):
            if word in words:
                return tag
        return "word"

    def clauses(self, text: str, length: int) -> float:
        """Sum of the matched clauses' weights."""
        total, tags, weights, memo = 0.0, [], [], {}
        for token in [*_TOKEN.findall(text), "."]:
            if token in _ENDS:
                if tags and (any(weights) or "threat" in tags):
                    total += self.transducer.run(tags)[1] * (max(weights) or self.plain)
                tags, weights = [], []
            elif token in _QUOTES:
                tags.append("report")
                weights.append(0.0)
            else:
                if token not in memo:
                    x = self.weight(token, length)
                    memo[token] = (self.tag(token, x), x)
                t, x = memo[token]
                tags.append(t)
                weights.append(x)
        return total

    def score(self, text: bytes | None) -> float:
        every = _words(text)
        words = set(every)
        hit = not self.words.keys().isdisjoint(words) or not THREATS.isdisjoint(words) or any(not self.starts.keys().isdisjoint({w[:n] for w in words}) for n in self.lengths)
        total = self.clauses(text.decode("utf-8", "replace").lower(), len(every)) if hit else 0.0
        # log-odds of the matches against those of a toxic document that has no match: nothing matched changes nothing
        m = self.s.hits
        z = self.base + math.log1p(math.exp(min(total, 60.0) - m)) - math.log1p(math.exp(-m))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, lexicon: dict[str, float], base: float, text: str = "text", settings: Settings = Settings()) -> tuple[DataFrame, str]:
    """docs with the score in 0 to 1, and that column's name."""
    name, at, s = free_name(docs, "score"), docs.columns.index(text), settings
    base = min(base, math.log(0.8 * s.threshold / (1 - s.threshold)))  # nothing matched is never over the threshold
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, base, s)
        for b in batches:
            for first, n in slices(b.column(at), s.slice):
                part = b.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([scorer.score(t) for t in as_bytes(part.column(at))], pa.float64())], names=schema.names)

    return docs.mapInArrow(tidy(run), schema), name


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> tuple[DataFrame, str]:
    """docs with their scores under a grammar learned from labels, and the score's name."""
    lexicon, base = learn(docs, labels, doc_id, text, settings=settings)
    return score(docs, lexicon, base, text, settings)
