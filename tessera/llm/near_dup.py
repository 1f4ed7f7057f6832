"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

A document's set: the distinct 64-bit hashes of its five-word shingles (with fewer words, of the whole
sequence). Documents with equal sets form a class, told apart by two independent 64-bit hashes of the set;
only classes are compared.

Sketch: t coordinates. In round i < t every element is hashed to a bin and a value in [i, i+1); in rounds
t..2t-1 every element goes to bin i - t. A bin keeps its least value, so rounds stop once every bin is
filled, and after 2t rounds each is. Equality of coordinates then estimates Jaccard similarity with
Chernoff-type concentration.

Banding: bands of r coordinates. In a bucket every class is compared with the bucket's smallest class
(linear in the bucket). In buckets that still hold several components afterwards, the classes outside the
largest component are compared with all others, block against block: each one's two best candidates of other
components, by their sketches, are verified, which connects real groups; then what is still apart is compared
inside the group's task, on full sets through an index of shingles, and only links that join components
become rows. So a bucket is never expanded into rows for its pairs, and no candidate is dropped: every pair of
a bucket is verified, already connected, or has a sketch more than six standard deviations under the threshold.

Scale: texts are hashed once, in slices of bounded bytes, and found again by their id and a hash of the text.
A block is bounded by its classes and by the size of their sets. Keys that hold over a ten-thousandth of a
join's rows (so at most 10,000 of them, which are broadcast) are salted.

Verification recomputes both full sets from the texts: linked iff 100 * |A & B| >= 75 * |A | B|.

Defined results: null and wordless texts have the empty set and link with nothing; repeated rows and equal
texts share a component; a document's component is the smallest doc_id reachable; a null doc_id counts
only if nothing else is reachable; rows with one doc_id and different texts are different documents; an
empty table gives an empty result; other columns are not looked at. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.support import SPACES, as_bytes, batch_word_hashes, free_name, materialize, mix, slices, tidy


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Percent of similarity that links.
    least: int = 75
    #: A pair at the threshold shares no band with probability (1 - 0.75**5)**36 < 6e-5.
    bands: int = 36
    rows: int = 5
    #: Classes of a bucket that one task compares with as many others, and the shingles that these hold at most (about).
    block: int = 1024
    cells: int = 2_000_000
    #: Bytes of text that a task hashes at a time (about).
    slice: int = 4 << 20
    #: Copies of the other side that a hot key is dealt to.
    salts: int = 64
    #: Rows that a key holds at least to be hot.
    hot: int = 1000

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def agree(self) -> int:
        """Coordinates that must agree in the block comparison: six standard deviations under the threshold."""
        p = self.least / 100
        return int(self.size * p - 6 * (self.size * p * (1 - p)) ** 0.5)


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    keys = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    out = []
    for h in batch_word_hashes(texts):
        if len(h) >= words:
            s = h[: len(h) - words + 1] * keys[0]
            for k in range(1, words):
                s = s + h[k : len(h) - words + 1 + k] * keys[k]
            out.append(np.unique(mix(s)))
        elif len(h):
            out.append(mix(np.array([(h * keys[: len(h)]).sum() + np.uint64(len(h))], np.uint64) ^ np.uint64(0xA5A5A5A5)))
        else:
            out.append(h)
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each (non-empty) set."""
    n = len(sets)
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    if not n:
        return out.reshape(0, t)
    sizes = np.array([len(s) for s in sets])
    element, owner, live = np.concatenate(sets), np.repeat(np.arange(n), sizes), np.ones(n, bool)
    for i in range(2 * t):
        h = mix(element + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = owner * t + ((h >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if i < t else owner * t + (i - t)
        # the round in the high bits: a value of an earlier round is always smaller
        value = (np.uint64(i) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        np.minimum.at(out, place, value)
        del h, place, value
        if i % 2 or n < 64:
            full = (out.reshape(n, t) != np.iinfo(np.uint64).max).all(axis=1)
            if full.all():
                break
            if (live & full).any():
                live = ~full
                keep = live[owner]
                element, owner = element[keep], owner[keep]
    return out.reshape(n, t)


def class_keys(sets: list[np.ndarray]) -> tuple[list[int | None], list[int | None]]:
    """Two independent 64-bit hashes of each set; null for the empty one."""
    size = [mix(np.array([len(x)], np.uint64))[0] for x in sets]
    first = [int((mix(x).sum() ^ n).astype(np.int64)) if len(x) else None for x, n in zip(sets, size, strict=True)]
    other = [int((mix(x ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum() + n).astype(np.int64)) if len(x) else None for x, n in zip(sets, size, strict=True)]
    return first, other


def _prepare(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_key, n_shingles, class, other, sketch of one byte a coordinate, bands) of docs (doc_id, text_key, text).

    Sketch and bands are given for the first document of a class in a slice; the others' are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, s.bands + 1, dtype=np.uint64))
        for b in batches:
            for at, n in slices(b.column(2), s.slice):
                sets = shingle_sets(as_bytes(b.column(2).slice(at, n)), s.words)
                keys, other = class_keys(sets)
                first = list({k: i for i, k in reversed(list(enumerate(zip(keys, other, strict=True)))) if k[0] is not None}.values())
                sk = sketches([sets[i] for i in first], s.size)
                parts = mix(sk).reshape(len(sk), s.bands, s.rows)
                band = np.zeros((len(sk), s.bands), np.uint64) + salt
                for k in range(s.rows):
                    band = mix(band * np.uint64(3) + parts[:, :, k])
                small = (mix(sk) >> np.uint64(56)).astype(np.uint8)
                sketch, bands = [None] * n, [None] * n
                for k, i in enumerate(first):
                    sketch[i], bands[i] = small[k].tobytes(), band[k].astype(np.int64)
                counts = pa.array([len(x) for x in sets], pa.int64())
                made = [counts, pa.array(keys, pa.int64()), pa.array(other, pa.int64()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), *made], names=["doc_id", "text_key", "n_shingles", "class", "other", "sketch", "bands"])

    return docs.mapInArrow(tidy(run), "doc_id long, text_key long, n_shingles long, class long, other long, sketch binary, bands array<long>")


def _told_apart(sets: DataFrame) -> DataFrame:
    """sets, where classes whose first hashes are equal and others differ get different keys."""
    clash = sets.filter("class IS NOT NULL").groupBy("class").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b").select("class", F.lit(True).alias("clash"))
    clash = materialize(clash)
    if clash.isEmpty():
        return sets.drop("other")
    key = F.when(F.col("clash"), F.xxhash64("class", "other")).otherwise(F.col("class"))
    return materialize(sets.join(clash, "class", "left").withColumn("class", key).drop("other", "clash"))


def _salted(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, s: Settings) -> DataFrame:
    """big joined with small (one row for each key, with its weight: the number of big's rows) where keys over 1/10,000 of total are salted."""
    hot = F.col(weight) > max(s.hot, total // 10_000)
    marks = F.broadcast(small.filter(hot).select(key, F.lit(s.salts).alias("salts_")))  # 10,000 rows at most
    salt = F.pmod(F.xxhash64(*big.columns), F.coalesce("salts_", F.lit(1))).cast("int")
    copies = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.when(hot, s.salts - 1).otherwise(0))))
    return big.join(marks, key, "left").withColumn("salt_", salt).drop("salts_").join(copies, [key, "salt_"]).drop("salt_")


def _texts(read: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, text) of the classes in pairs: the text of a document that represents the class."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct().join(classes.select("class", F.col("row.*")), "class")
    found = read.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key", "text").join(wanted, ["id", "text_key"])
    return materialize(found.groupBy("class").agg(F.first("text").alias("text")))


def _verify(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Of the pairs (u, v) of classes, those whose full sets are similar enough."""
    a = texts.select(F.col("class").alias("u"), F.col("text").alias("tu"))
    b = texts.select(F.col("class").alias("v"), F.col("text").alias("tv"))
    of_u = materialize(pairs.groupBy("u").agg(F.count("*").alias("n_")))
    total = int(of_u.agg(F.sum("n_")).first()[0] or 0)
    joined = _salted(pairs.select("u", "v").join(b, "v"), of_u.join(a, "u"), "u", "n_", total, s).select("u", "v", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, n in slices(batch.column(3), s.slice, batch.column(2)):
                part = batch.slice(at, n)
                us, vs = part.column(0).to_pylist(), part.column(1).to_pylist()
                first = {u: i for i, u in reversed(list(enumerate(us)))}
                new = [u for u in first if u not in held]
                got = shingle_sets(as_bytes(part.column(2).take(pa.array([first[u] for u in new], pa.int64()))), s.words)
                held = {u: x for u, x in held.items() if u in first} | dict(zip(new, got, strict=True))
                keep = np.zeros(n, bool)
                for k, (u, v_set) in enumerate(zip(us, shingle_sets(as_bytes(part.column(3)), s.words), strict=True)):
                    a, n_both = held[u], len(held[u]) + len(v_set)
                    if 100 * min(len(a), len(v_set)) >= s.least * max(len(a), len(v_set)):
                        both = n_both - len(np.union1d(a, v_set))
                        keep[k] = 100 * both >= s.least * (n_both - both)
                held = {us[-1]: held[us[-1]]}
                yield pa.RecordBatch.from_arrays([pa.array(np.array(us, np.int64)[keep]), pa.array(np.array(vs, np.int64)[keep])], names=["u", "v"])

    return joined.mapInArrow(tidy(run), "u long, v long")


def _canonical(bands: DataFrame) -> DataFrame:
    """(band, n, leader) of buckets of two classes or more; one of those with the same classes."""
    low = F.xxhash64("class").bitwiseAND(F.lit(0x7FFFFFFF))
    each = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("class").alias("leader"), F.max("class").alias("most"), F.sum(low).alias("sum")).filter("n > 1")
    return each.groupBy("n", "leader", "most", "sum").agg(F.min("band").alias("band")).select("band", "n", "leader")


def _facing(members: DataFrame, total: int, s: Settings) -> DataFrame:
    """members (band, class, root, n_shingles, ...) of buckets that hold several components, dealt to block pairs (band, i, j).

    On the left (side 0) are the classes outside the bucket's largest component, on the right all: of a
    bucket with one large component and few strays, hardly more rows are made than it has classes.
    """
    per = members.groupBy("band", "root").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("w"))
    main = F.max(F.struct("c", "root", "w"))
    split = per.groupBy("band").agg(main.alias("m"), F.sum("c").alias("n_"), F.sum("w").alias("w"), F.count("*").alias("k")).filter("k > 1")
    blocks = lambda n, w: F.ceil(F.greatest(n / s.block, w / s.cells)).cast("int")
    split = materialize(split.select("band", "n_", F.col("m.root").alias("main"), blocks(F.col("n_") - F.col("m.c"), F.col("w") - F.col("m.w")).alias("lefts"), blocks(F.col("n_"), F.col("w")).alias("rights")))
    dealt = _salted(members, split, "band", "n_", total, s)
    deal = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = [x for x in members.columns if x != "n_shingles"]
    other = (F.col("root") != F.col("main")).alias("stray")
    left = dealt.filter("root <> main").select(*names, other, F.lit(0).alias("side"), deal("lefts").alias("i"), every("rights").alias("j"))
    right = dealt.select(*names, other, F.lit(1).alias("side"), deal("rights").alias("j"), every("lefts").alias("i"))
    return left.unionByName(right)


def _pair_frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    side = pdf["side"].to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _promising(members: DataFrame, total: int, s: Settings, best: int = 2) -> DataFrame:
    """Of each class outside the largest component of its bucket, its best few pairs with other components, by sketches."""
    agree = s.agree

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        found = []
        if len(left) and len(right):
            sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
            root, key = pdf["root"].to_numpy(), pdf["class"].to_numpy()
            for k in left:
                look = right[root[right] != root[k]]
                same = (sketch[look] == sketch[k]).sum(axis=1)
                look, same = look[same >= agree], same[same >= agree]
                for o in look[np.lexsort((key[look], -same))[:best]]:
                    found.append((min(key[k], key[o]), max(key[k], key[o])))
        return _pair_frame(found)

    return _facing(members, total, s).groupBy("band", "i", "j").applyInPandas(run, "u long, v long").distinct()


def _joining(members: DataFrame, sets: DataFrame, total: int, s: Settings) -> DataFrame:
    """Links that join components of a bucket; every pair of its components is compared on the full sets, those that sketches rule out aside.

    sets: (class, set) of the members. Pairs are compared within the group and never become rows: a pair
    that a link of the group has already joined needs no other, so a group gives fewer links than it has
    classes.
    """
    agree = s.agree

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        if not len(left) or not len(right):
            return _pair_frame([])
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        key, stray, sets = pdf["class"].to_numpy(), pdf["stray"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        sizes = np.array([len(x) for x in sets])
        _, group = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        # an index of the right side: shingle -> classes
        index = np.concatenate([sets[k] for k in right])
        owner = np.repeat(np.arange(len(right), dtype=np.int32), sizes[right])
        order = np.argsort(index, kind="stable")
        index, owner = index[order], owner[order]
        found = []
        for k in left:
            # two strays meet once: the one with the smaller key is on the left
            look = (group[right] != group[k]) & (~stray[right] | (key[right] > key[k]))
            look &= 100 * np.minimum(sizes[right], sizes[k]) >= s.least * np.maximum(sizes[right], sizes[k])
            at = np.flatnonzero(look)
            at = at[(sketch[right[at]] == sketch[k]).sum(axis=1) >= agree] if len(at) else at
            if not len(at):
                continue
            lo, hi = np.searchsorted(index, sets[k], "left"), np.searchsorted(index, sets[k], "right")
            n = hi - lo
            places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[places], minlength=len(right))[at]
            for o in right[at[100 * both >= s.least * (sizes[k] + sizes[right[at]] - both)]]:
                if group[o] != group[k]:
                    found.append((min(key[k], key[o]), max(key[k], key[o])))
                    group[group == group[o]] = group[k]
        return _pair_frame(found)

    return _facing(members, total, s).join(sets, "class").groupBy("band", "i", "j").applyInPandas(run, "u long, v long").distinct()


def _sets(texts: DataFrame, s: Settings) -> DataFrame:
    """(class, set): the shingle hashes of each class as one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(1), s.slice):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array([x.tobytes() for x in shingle_sets(as_bytes(b.column(1).slice(at, n)), s.words)], pa.binary())], names=["class", "set"])

    return texts.select("class", "text").mapInArrow(tidy(run), "class long, set binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, text_key (a hash of its text), n_shingles, component_id, kept, class, n_class_links (verified links of its class that joined components)."""
    s = settings
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text"))
    sets = _told_apart(materialize(_prepare(read, s)))
    row = F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key")).alias("row")
    firsts = [F.first(x, ignorenulls=True).alias(x) for x in ("n_shingles", "sketch", "bands")]
    classes = materialize(sets.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), row, *firsts))
    bands = classes.select("class", F.explode("bands").alias("band"))
    buckets = materialize(_canonical(bands))
    total = int(buckets.agg(F.sum("n")).first()[0] or 0)
    # every bucket's classes but its leader
    inside = materialize(_salted(bands, buckets, "band", "n", total, s).filter("class <> leader"))
    stars = materialize(inside.select(F.col("leader").alias("u"), F.col("class").alias("v")).distinct())
    texts = _texts(read, stars, classes)  # of every class that shares a bucket, so of all candidates below
    links = materialize(_verify(stars, texts, s))
    roots = components(links)
    inside = inside.filter("n > 2").join(classes.select("class", "n_shingles"), "class")  # the star of a smaller bucket compares all

    def apart() -> DataFrame:
        """Members of buckets that links leave in several components."""
        rooted = inside.join(roots.withColumnRenamed("node", "class"), "class", "left").select("band", "n", "class", "n_shingles", F.coalesce("root", "class").alias("root"))
        split = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.first("n").alias("n_")).filter("a <> b").select("band", "n_")
        return _salted(rooted, materialize(split), "band", "n_", total, s).drop("n_")

    def add(new: DataFrame) -> None:
        nonlocal links, roots
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new))

    sketched = lambda df: df.join(classes.select("class", "sketch"), "class")
    # first a class looks around in the largest of its buckets, which connects real groups
    largest = apart().groupBy("class").agg(F.max_by(F.struct("band", "root", "n_shingles"), F.struct("n", "band")).alias("x"))
    some = materialize(_promising(sketched(materialize(largest.select("x.band", "class", "x.root", "x.n_shingles"))), total, s))
    add(materialize(_verify(some, texts, s)))
    # then all that is still apart is compared, in all of its buckets
    members = materialize(apart().drop("n"))
    if not members.isEmpty():
        sets_of = _sets(texts.join(members.select("class").distinct(), "class", "left_semi"), s)
        add(materialize(_joining(sketched(members), sets_of, total, s)))
    degree = links.select(F.explode(F.array("u", "v")).alias("class")).groupBy("class").agg(F.count("*").alias("n_class_links"))
    placed = classes.select("class", "least").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = placed.select("class", "root").join(least, "root").join(degree, "class", "left").select("class", "component_id", "n_class_links")
    out = sets.select("doc_id", "text_key", "n_shingles", "class").join(of_class, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class", F.coalesce("n_class_links", F.lit(0)).cast("long").alias("n_class_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """docs, with one row of each group of near copies: one with the group's smallest doc_id, and all wordless rows.

    A null doc_id stays only where its group has no other. Of several rows with that id and one set, the
    least by the text's hash, then by all columns, stays.
    """
    key = free_name(docs, "near_dup_key_")
    c = lambda n: F.col(f"`{n}`")
    columns = [c(x) for x in docs.columns]
    wordless = F.btrim(F.coalesce(c(text), F.lit("")), F.lit(SPACES)) == ""
    found = near_duplicates(docs, doc_id, text, settings).filter("kept AND class IS NOT NULL")
    stay = materialize(found.groupBy("doc_id", "class").agg(F.count("*").alias("n"), F.min("text_key").alias("text_key")))
    ids = stay.select(F.col("doc_id").alias(key), F.col("text_key").alias(f"{key}t"), F.col("n").alias(f"{key}n"))
    kept = docs.filter(~wordless).join(ids, c(doc_id).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(c(text)) == F.col(f"{key}t")))
    out = kept.filter(F.col(f"{key}n") == 1).select(*columns).unionByName(docs.filter(wordless))
    if stay.filter("n > 1").isEmpty():
        return out
    least = F.min(F.struct(*columns)).alias("row")
    again = kept.filter(F.col(f"{key}n") > 1).groupBy(key, f"{key}t").agg(least)
    return out.unionByName(again.select("row.*"))
