"""Packing tokenised documents into sequences by a linear grouping scheme.

Only lengths decide, and there are at most `capacity` of them, so the plan is made on the histogram of
lengths: its size does not depend on the number of documents. Large lengths, in descending order, are cut
into groups of equal cardinality and rounded up to the largest of their group; configurations of these few
sizes are chosen fullest first by a bounded-knapsack table and repeated as often as demand allows; actual
documents then take the slots of their group; small ones go best-fit, longest first, into what is left
of each sequence. Runs of equal sequences are handled as one.

Documents are matched to the plan by their rank among pieces of equal length, counted over hash buckets,
so no task holds all pieces of a length.

Defined results: a null text is empty; an empty one is the single end id; repeated rows are packed each;
ties are interchangeable; an empty table gives an empty result; other columns are not looked at.
Texts are tokenised whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.support import as_bytes, free_name, materialize, release, slices, tidy


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    #: Lengths over this are grouped; the others are best-fit.
    small: int = 128
    groups: int = 1024
    #: Bytes of text that a task tokenises at a time (about).
    slice: int = 4 << 20
    #: Slices whose distinct words are encoded together.
    window: int = 4
    #: Pieces of one length that one task ranks at a time (about).
    bucket: int = 100_000


# --- tokens ------------------------------------------------------------------------------------


#: Fixed value: how the tokenizer splits what is left of a text without white space.
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_SPACE = re.compile(rb"[ \t-\r]")
#: Words of these characters alone need no normalising but lower case, character by character; among them
#: letters and digits are the same to _RUNS and to the tokenizer.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u0148\u014a-\u024f]+")


class WordTokenizer:
    """Ids of texts under a tokenizer that drops white space, splits words into runs and marks their ends.

    As it never joins across white space, some slices of texts are split into words, each distinct word is
    encoded once, and the ids are laid out by the words' places; nothing is remembered beyond these. As it
    never joins across runs and every run's last token is marked, the distinct runs are encoded as one text
    and cut at the marks. Words with rarer characters, or the special tokens' strings, go through the whole
    tokenizer.
    """

    MARK = "</w>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.whole = Tokenizer.from_file(path)
        bytes_only = [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel"]
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *bytes_only]}}
        self.runs = Tokenizer.from_str(json.dumps(spec))
        for t in (self.whole, self.runs):
            t.model._resize_cache(0)  # every word is new to it
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.MARK)]] = True

    def _runs(self, words: list[bytes]) -> tuple[list[bytes], list[int], list[bytes | None]]:
        """Of words that are not plain: the runs of all, how many each has, and the ids of those that go through the whole tokenizer."""
        runs, counts, ids = [], [], []
        for w in words:
            t = w.decode("utf-8", "replace")
            if w and (not _PLAIN.fullmatch(t) or "<" in t and any(x in t for x in self.special)):
                ids.append(t)
                counts.append(0)
                continue
            found = [t.lower()] if t.isalpha() else _RUNS.findall(t.lower())
            runs += [r.encode() for r in found]
            counts.append(len(found))
            ids.append(None)
        odd = self._encoded([t for t in ids if t is not None])
        return runs, counts, [None if t is None else next(odd) for t in ids]

    def _encoded(self, texts: list[str], most: int = 5_000) -> Iterator[bytes]:
        """The ids of texts by the whole tokenizer, some at a time: it holds far more of a text than its ids."""
        for k in range(0, len(texts), most):
            for e in self.whole.encode_batch_fast(texts[k : k + most], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        n, text = len(words), words.type
        alpha = pc.ascii_is_alpha(words).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~alpha)
        others = words.take(pa.array(rest))
        body = pc.binary_slice(others.view(pa.binary() if text == pa.string() else pa.large_binary()), 0, -1).view(text)
        dot, comma = (pc.ends_with(others, x).to_numpy(zero_copy_only=False) for x in (".", ","))
        marked = pc.ascii_is_alpha(body).to_numpy(zero_copy_only=False) & (dot | comma)
        plain, with_mark, more = np.flatnonzero(alpha), rest[marked], rest[~marked]
        runs, counts, odd = self._runs(as_bytes(others.filter(pa.array(~marked))))
        every = pa.concat_arrays([pc.ascii_lower(words.filter(pa.array(alpha))), pc.ascii_lower(body.filter(pa.array(marked))), pa.array([*runs, b".", b","], pa.binary()).cast(text)]).dictionary_encode()
        at = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = as_bytes(every.dictionary)
        # some at a time, for the same reason
        parts = [known[k : k + 20_000] for k in range(0, len(known), 20_000)]
        run_ids = np.concatenate([np.array(self.runs.encode_batch_fast([b" ".join(x).decode()], add_special_tokens=False)[0].ids, "<u4") for x in parts])
        run_ends = np.flatnonzero(self.ends[run_ids]) + 1
        if len(run_ends) != len(known):
            raise ValueError("the tokenizer does not mark the end of every run")
        # words of the whole tokenizer count as one run each, after the others
        whole = [k for k, x in enumerate(odd) if x is not None]
        run_sizes = np.concatenate([np.diff(run_ends, prepend=0), np.array([len(odd[k]) // 4 for k in whole], np.int64)])
        run_ids = np.concatenate([run_ids, np.frombuffer(b"".join(odd[k] for k in whole), "<u4")])
        # each word's runs, in the order of words
        parts = np.ones(n, np.int64)
        parts[with_mark], parts[more] = 2, counts
        parts[more[whole]] = 1
        first = np.cumsum(parts) - parts
        of = np.empty(int(parts.sum()), np.int64)
        of[first[plain]] = at[: len(plain)]
        of[first[with_mark]] = at[len(plain) : len(plain) + len(with_mark)]
        of[first[with_mark] + 1] = np.where(dot[marked], at[-2], at[-1])
        counts = np.array(counts, np.int64)
        of[np.repeat(first[more] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())] = at[len(plain) + len(with_mark) : -2]
        of[first[more[whole]]] = len(known) + np.arange(len(whole))
        return run_ids[_laid(run_sizes, of)], np.add.reduceat(np.append(run_sizes[of], 0), first) * (parts > 0) if n else parts

    def texts(self, slices: list[pa.Array]) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each slice of texts, their ids one after another, and where each text's end. Distinct words of all slices are encoded once."""
        split = [pc.ascii_split_whitespace(x) for x in slices]
        lengths = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in split]
        coded = pa.chunked_array([x.flatten().dictionary_encode() for x in split]).unify_dictionaries()
        del split
        ids, sizes = self.words(coded.chunk(0).dictionary)
        for chunk, words in zip(coded.chunks, lengths, strict=True):
            at = chunk.indices.to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes[at])])
            yield ids[_laid(sizes, at)].tobytes(), ends[np.cumsum(words)]


def _laid(sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places, in a row of items of these sizes, of the contents of items `of`, one after another."""
    each = sizes[of]
    shift = (np.cumsum(sizes) - sizes)[of] - (np.cumsum(each) - each)
    return np.repeat(shift, each) + np.arange(int(each.sum()))


def _parts(column: pa.Array, most: int) -> Iterator[tuple[pa.Array, int, bool]]:
    """Runs of a text column of about `most` bytes: (texts, first row, whether the last of them is at its end).

    A longer text comes alone, in pieces cut at white space.
    """
    for a, n in slices(column, most):
        text = column[a].as_buffer() if n == 1 and column[a].is_valid else b""
        if len(text) <= most:
            yield column.slice(a, n), a, True
            continue
        text, at = text.to_pybytes(), 0
        while at < len(text):
            cut = at + most
            if cut < len(text):
                space = _SPACE.search(text, cut)
                cut = space.start() if space else len(text)
            yield pa.array([text[at:cut]], pa.binary()).view(pa.string()), a, cut >= len(text)
            at = cut


def _tokens(tokenizer: WordTokenizer, column: pa.Array, s: Settings) -> Iterator[tuple[tuple[bytes, np.ndarray], int, bool]]:
    """What texts() gives for each of the _parts() of a column, with the part's first row and whether it is at its text's end."""
    parts = _parts(column, s.slice)
    while held := list(itertools.islice(parts, s.window)):
        yield from zip(tokenizer.texts([x for x, _, _ in held]), [f for _, f, _ in held], [e for _, _, e in held], strict=True)


def cut(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings(), end: int = 0) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of the tokenised documents, each followed by the id `end`."""
    s, tail = settings, np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, step = WordTokenizer(path), 4 * s.capacity
        for b in batches:
            rows: list[tuple] = []
            names, left, piece = b.column(0).to_pylist(), b"", 0  # ids of an unfinished text that wait for more, and its pieces so far
            for (ids, ends), first, ended in _tokens(tokenizer, b.column(1), s):
                ids, at = memoryview(ids), 0
                for k, stop in enumerate((ends * 4).tolist()):
                    own = memoryview(left + ids[at:stop]) if left else ids[at:stop]
                    whole = ended or k + 1 < len(ends)
                    # pieces that are full; a finished text's last one, with the end id, in any case
                    for p in range(0, len(own) + 4 if whole else len(own) - step + 1, step):
                        part = own[p : p + step]
                        crc, size = zlib.crc32(part), len(part)
                        if size < step and whole:
                            crc, size = zlib.crc32(tail, crc), size + 4
                        rows.append((names[first + k], piece, piece * s.capacity, size // 4, crc))
                        piece += 1
                    left, at = b"" if whole else bytes(own[len(own) // step * step :]), stop
                    piece = 0 if whole else piece
                yield _rows(rows)
                rows = []

    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return read.mapInArrow(tidy(run), _PIECES)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


# --- the plan, on the histogram ------------------------------------------------------------------


def _fullest(capacity: int, first: int, sizes: list[int], left: np.ndarray) -> list[int]:
    """Items of each size in the fullest configuration that holds one of size index first (the largest with demand)."""
    room = capacity - sizes[first]
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by = np.full(room + 1, -1, np.int32)  # size that last made a sum reachable
    for g in range(first, len(sizes)):
        size, most = sizes[g], int(left[g]) - (g == first)
        if size > room:
            continue
        for _ in range(min(most, room // size)):
            new = np.zeros_like(reach)
            new[size:] = reach[: room + 1 - size]
            # a size only builds on sums of sizes up to itself, so walking back is well defined
            new &= ~reach
            if not new.any():
                break
            by[new] = g
            reach |= new
        if reach[room]:
            break
    use = [0] * len(sizes)
    use[first] = 1
    total = int(np.flatnonzero(reach)[-1])
    while total:
        g = int(by[total])
        use[g] += 1
        total -= sizes[g]
    return use


def plan(histogram: dict[int, int], settings: Settings = Settings()) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, count, first sequence, offset) and the number of sequences.

    histogram: number of pieces of each length below the capacity.
    """
    cap, out, runs, sequences = settings.capacity, [], [], 0
    large = sorted((x for x in histogram if x > settings.small and histogram[x]), reverse=True)
    n = sum(histogram[x] for x in large)
    ends = np.cumsum([histogram[x] for x in large]) if large else np.empty(0, np.int64)
    if n:
        m = -(-n // settings.groups)
        starts = list(range(0, n, m))
        sizes = [large[int(np.searchsorted(ends, a, side="right"))] for a in starts]
        left = np.array([min(m, n - a) for a in starts], np.int64)
        at = list(starts)
        for first in range(len(starts)):
            while left[first]:
                use = _fullest(cap, first, sizes, left)
                times = min(int(left[g]) // u for g, u in enumerate(use) if u)
                slots = []
                for g, u in enumerate(use):
                    for _ in range(u):
                        slots.append(at[g])
                        at[g] += times
                    left[g] -= u * times
                runs += _substitute(slots, times, sequences, large, ends, out, cap)
                sequences += times
    # what is left of each sequence: gap -> [(first sequence, count)]
    gaps: dict[int, list[tuple[int, int]]] = {}
    for first_sequence, count, fill in runs:
        gaps.setdefault(cap - fill, []).append((first_sequence, count))
    for length in sorted((x for x in histogram if 0 < x <= settings.small and histogram[x]), reverse=True):
        rank, todo = 0, histogram[length]

        def place(first_sequence: int, count: int, gap: int) -> None:
            """So many sequences of this gap get as many of the length as fit; best-fit fills one before the next."""
            nonlocal rank, todo
            each = gap // length
            full = min(count, todo // each)
            for n, start, items in ((full, first_sequence, each), (1, first_sequence + full, min(each, todo - full * each))):
                if n and items and start < first_sequence + count:
                    for k in range(items):
                        out.append((length, rank, n, start, cap - gap + k * length))
                        rank += n
                    todo -= n * items
                    gaps.setdefault(gap - items * length, []).append((start, n))
                    count, first_sequence = count - n, start + n
            if count:
                gaps.setdefault(gap, []).append((first_sequence, count))

        gap = length
        while todo and gap <= cap:
            if gaps.get(gap):
                place(*gaps[gap].pop(), gap)
            else:
                gap += 1
        if todo:  # new sequences
            n = -(-todo // (cap // length))
            sequences += n
            place(sequences - n, n, cap)
    return np.array(out, np.int64).reshape(-1, 5), sequences


def _substitute(slots: list[int], times: int, sequence: int, large: list[int], ends: np.ndarray, out: list, cap: int) -> list[tuple[int, int, int]]:
    """Actual lengths for `times` sequences whose k-th item has overall rank slots[k], slots[k] + 1, ...; returns (first sequence, count, fill)."""
    cuts = {0, times}
    for a in slots:
        inside = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, a + times, side="left")]
        cuts.update(int(e) - a for e in inside)
    cuts, runs = sorted(cuts), []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        offset = 0
        for a in slots:
            k = int(np.searchsorted(ends, a + lo, side="right"))
            out.append((large[k], a + lo - (int(ends[k - 1]) if k else 0), hi - lo, sequence + lo, offset))
            offset += large[k]
        runs.append((sequence + lo, hi - lo, offset))
    return runs


# --- documents onto the plan ---------------------------------------------------------------------


def pack(pieces: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """pieces (any columns, with doc_id, piece, length) with sequence_id and offset."""
    s = settings
    pieces = materialize(pieces)
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    whole = counts.pop(s.capacity, 0)
    steps, mixed = plan(counts, s)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[order]
    # whole pieces are sequences of their own, after the others
    if whole:
        steps = np.vstack([steps, [[s.capacity, 0, whole, mixed, 0]]])
    keys = (steps[:, 0] << 40) + steps[:, 1]
    given = pieces.sparkSession.sparkContext.broadcast((keys, steps[:, 3].copy(), steps[:, 4].copy()))
    del steps, order, keys
    release()
    buckets = max(1, 1 << ((sum(counts.values()) + whole) // s.bucket).bit_length())
    h, b, r, base, c, rank = (free_name(pieces, x) for x in ("h_", "b_", "r_", "base_", "c_", "rank_"))
    names = {x: free_name(pieces, x) for x in ("sequence_id", "offset")}
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn(h, key).withColumn(b, F.pmod(F.col(h), F.lit(buckets)))
    sums = dealt.groupBy("length", b).agg(F.count("*").alias(c))
    earlier = Window.partitionBy("length").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    base_of = sums.select("length", b, F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(base))
    within = F.row_number().over(Window.partitionBy("length", b).orderBy(h, "doc_id", "piece", "start"))
    ranked = dealt.withColumn(r, within).join(base_of, ["length", b]).withColumn(rank, F.col(r) - 1 + F.col(base))
    columns = [F.col(f"`{x}`") for x in pieces.columns]
    schema = T.StructType([*pieces.schema.fields, T.StructField(names["sequence_id"], T.LongType()), T.StructField(names["offset"], T.LongType())])
    at_length, width = pieces.columns.index("length"), len(pieces.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, offset = given.value
        for x in batches:
            key = (x.column(at_length).to_numpy().astype(np.int64) << 40) + x.column(width).to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*x.columns[:width], pa.array(sequence[at] + key - keys[at]), pa.array(offset[at])], names=schema.names)

    return ranked.select(*columns, rank).mapInArrow(tidy(place), schema)
