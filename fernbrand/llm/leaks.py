"""Evaluation texts in training text.

The prompts and answers of the test items (their sides) form a BM25 inverted index, which every
passage of the corpus is put to as a query. Weights are scaled by each side's own threshold: the
least score of any of its runs of ``RUN`` words. A passage that holds such a run therefore scores
at least 1 for that side, and retrieving all sides that score 1 or more loses no leak.

Block-max WAND prunes, for many passages at a time: passages without ``RUN`` successive words of
the index, or whose words' greatest weights don't add up to 1, are skipped; in the others only the
heavy words, one of which any side that scores 1 must hold, bring in blocks of sides; only
blocks whose greatest weights, with all that the light words could add, reach 1 are bounded by all
words, and only those that still reach it are scored side by side. Retrieved pairs are verified
word by word.

All lists are sparse, so an index grows with the words of its items. Items go to the tasks in
indexes of bounded size, one after another; the corpus is read once for each and never shuffled
as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Successive words that make a leak.
RUN = 20
#: Words between the starts of passages; a passage is long enough to hold any run that starts in its stride.
STRIDE = 5
#: Sides (prompts or answers) of a block of the index.
BLOCK = 8
#: Words that are searched at once, and pairs of passages and blocks.
TOGETHER, PAIRS = 100_000, 200_000
#: Characters of items in one index; more items make more indexes.
INDEX_CHARS = 64_000_000
K1, B = 1.2, 0.75
SIDES = ("prompt", "answer")

# What isn't a letter or digit of ASCII separates words; capitals count as small letters.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of A-Z, a-z and 0-9, in small letters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class _Lists:
    """Weights by (term, place), sorted, and where each term's begin."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, weights: np.ndarray, size: int, width: int) -> None:
        self.width = max(width, 1)
        keys = terms.astype(np.int64) * self.width + places
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], np.diff(keys[order]) > 0]) if len(keys) else np.zeros(0, bool)
        self.keys = keys[order][first]
        self.weights = np.maximum.reduceat(weights[order], np.flatnonzero(first)).astype(np.float32) if len(keys) else np.zeros(0, np.float32)
        self.begin = np.searchsorted(self.keys, np.arange(size + 1) * self.width)

    def at(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The weight of each term at each place; 0 where it has none."""
        if not len(self.keys):
            return np.zeros(terms.shape, np.float32)
        wanted = terms.astype(np.int64) * self.width + places
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[found] == wanted, self.weights[found], np.float32(0))


# An odd factor, so that it has an inverse modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15


def _powers(factor: int, n: int) -> np.ndarray:
    """1, ``factor``, its square and so on, modulo 2**64."""
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _run_hashes(codes: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of the ``run`` codes from each place on."""
    n = len(codes)
    if n < run:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, inverse = _powers(_FACTOR, n), _powers(pow(_FACTOR, -1, 2**64), n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power)])
        return (total[run:] - total[:-run]) * inverse[: n - run + 1]


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and members of ranges."""
    sizes = end - begin
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[owner]


class Index:
    """Block-max inverted index of test items."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], run: int = RUN) -> None:
        self.run = run
        sides = [(item, k, w) for item, *texts in items if item is not None for k, w in enumerate(map(words, texts)) if len(w) >= run]
        sides.sort(key=lambda s: (s[2][0], s[0], s[1]))
        self.items, self.kinds = np.array([s[0] for s in sides], np.int64), np.array([s[1] for s in sides], np.int8)
        self.terms: dict[bytes, int] = {}
        coded = [np.array([self.terms.setdefault(w, len(self.terms)) for w in ws], np.int32) for *_, ws in sides]
        size = len(self.terms)
        counts = [np.unique(c, return_counts=True) for c in coded]
        held = np.bincount(np.concatenate([ids for ids, _ in counts]) if counts else np.zeros(0, int), minlength=size)
        idf = np.log1p((len(sides) - held + 0.5) / (held + 0.5))
        average = np.mean([len(c) for c in coded]) if coded else 1.0
        weights = []
        for c, (ids, n) in zip(coded, counts):
            weight = idf[ids] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(c) / average))
            each = np.concatenate([[0.0], np.cumsum(weight[np.searchsorted(ids, c)])])
            # Rounded up, so that sums of 32-bit numbers stay upper bounds.
            weights.append(weight / (each[run:] - each[:-run]).min() * 1.0001)
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        terms, weight = flat([ids for ids, _ in counts], np.int32), flat(weights, np.float32)
        side = np.repeat(np.arange(len(sides)), [len(ids) for ids, _ in counts]) if sides else np.zeros(0, int)
        self.by_side = _Lists(terms, side, weight, size + 1, len(sides))
        self.by_block = _Lists(terms, side // BLOCK, weight, size + 1, -(-len(sides) // BLOCK))
        self.most = np.zeros(size + 1, np.float32)
        np.maximum.at(self.most, terms, weight)
        self.codes_, self.starts = flat(coded, np.int32), np.cumsum([0, *[len(c) for c in coded]])
        hashes = [_run_hashes(c, run) for c in coded]
        at = flat([s + np.arange(len(h)) for s, h in zip(self.starts, hashes)], np.int64)
        order = np.argsort(flat(hashes, np.uint64), kind="stable")
        #: Hashes of all runs of all sides, in order, and where each run begins.
        self.hashes, self.hash_at = flat(hashes, np.uint64)[order], at[order]

    def codes(self, text: str | None) -> np.ndarray:
        """Term numbers of the words of a text; words outside the index get the last number."""
        get, other = self.terms.get, len(self.terms)
        ws = words(text)
        return np.fromiter((get(w, other) for w in ws), np.int32, len(ws))

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages (their first words) and sides that score at least 1."""
        reach = -(-(self.run + STRIDE - 1) // STRIDE)
        padded = np.concatenate([codes, np.full(reach * STRIDE, len(self.terms), np.int32)])
        at, sides = [np.zeros(0, int)], [np.zeros(0, int)]
        if len(self.items) and len(codes) >= self.run:
            for begin in range(0, len(codes), TOGETHER):
                here = padded[begin : begin + TOGETHER + (reach - 1) * STRIDE]
                here = here[: len(here) // STRIDE * STRIDE]
                strides = self.most[here].reshape(-1, STRIDE).sum(1)
                last = len(strides) - reach + 1
                bound = sum(strides[k : k + last] for k in range(1, reach)) + strides[:last]
                # A word that no item has ends any run.
                known = np.concatenate([[0], np.cumsum(here < len(self.terms))])
                whole = np.concatenate([known[self.run :] - known[: -self.run] == self.run, np.zeros(self.run, bool)])
                able = whole[: last * STRIDE].reshape(last, STRIDE).any(1)
                starts = np.flatnonzero((bound >= 1) & able) * STRIDE
                for part in range(0, len(starts), 2_000):
                    first = starts[part : part + 2_000]
                    row, side = self._scored(here[first[:, None] + np.arange(reach * STRIDE)])
                    at.append(first[row] + begin)
                    sides.append(side)
        return np.concatenate(at), np.concatenate(sides)

    def _scored(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sides that score at least 1 of passages (a row of terms each)."""
        most = self.most[passages]
        order = np.argsort(most, axis=1)
        upto = np.cumsum(np.take_along_axis(most, order, 1), axis=1)
        light = upto < 1
        rest = np.where(light, upto, 0).max(1)
        heavy = np.zeros(passages.shape, bool)
        np.put_along_axis(heavy, order, ~light, 1)
        row, column = np.nonzero(heavy & (most > 0))
        term = passages[row, column]
        rows, sides = [np.zeros(0, int)], [np.zeros(0, int)]
        begins = self.by_block.begin
        total = np.cumsum(begins[term + 1] - begins[term])
        # Whole passages at a time, of about PAIRS entries of lists.
        edges = np.unique(row[np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS), "right")]) if len(total) else []
        splits = [0, *np.searchsorted(row, edges), len(row)]
        for begin, end in zip(splits[:-1], splits[1:]):
            owner, place = _spread(begins[term[begin:end]], begins[term[begin:end] + 1])
            pair, at = np.unique(row[begin:end][owner].astype(np.int64) * self.by_block.width + self.by_block.keys[place] % self.by_block.width, return_inverse=True)
            bound = np.bincount(at, self.by_block.weights[place], len(pair))
            r = pair // self.by_block.width
            near = bound + rest[r] >= 1 - 1e-6
            r, block = r[near], pair[near] % self.by_block.width
            enough = self.by_block.at(passages[r], block[:, None]).sum(1) >= 1
            r, block = r[enough], block[enough]
            # A word's entries for the sides of a block stand together.
            start = passages[r].astype(np.int64) * self.by_side.width
            low, high = (np.searchsorted(self.by_side.keys, start + np.minimum((block[:, None] + k) * BLOCK, self.by_side.width)).reshape(-1) for k in (0, 1))
            owner, entry = _spread(low, high)
            pair = owner // passages.shape[1]
            score = np.bincount(pair * BLOCK + self.by_side.keys[entry] % self.by_side.width - block[pair] * BLOCK, self.by_side.weights[entry], len(r) * BLOCK)
            near = np.flatnonzero(score >= 1 - 1e-6)
            rows.append(r[near // BLOCK])
            sides.append(block[near // BLOCK] * BLOCK + near % BLOCK)
        row, side = np.concatenate(rows), np.concatenate(sides)
        pair = np.unique(row.astype(np.int64) * len(self.items) + side)
        return pair // len(self.items), pair % len(self.items)

    def verified(self, codes: np.ndarray, at: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of runs, and sides, where a passage really holds a run of a retrieved side."""
        none = np.zeros(0, int)
        if not len(at):
            return none, none
        start = (at[:, None] + np.arange(STRIDE)).reshape(-1)
        side = np.repeat(sides, STRIDE)
        fits = start <= len(codes) - self.run
        start, side = start[fits], side[fits]
        places = np.unique(start)
        if not len(places):
            return none, none
        window = codes[places[:, None] + np.arange(self.run)]
        mine = _window_hashes(window)[np.searchsorted(places, start)]
        owner, found = _spread(np.searchsorted(self.hashes, mine, "left"), np.searchsorted(self.hashes, mine, "right"))
        begins = self.hash_at[found]
        same = np.searchsorted(self.starts, begins, "right") - 1 == side[owner]
        owner, begins = owner[same], begins[same]
        step = np.arange(self.run)
        equal = (codes[start[owner][:, None] + step] == self.codes_[begins[:, None] + step]).all(1)
        return start[owner[equal]], side[owner[equal]]


def _window_hashes(windows: np.ndarray) -> np.ndarray:
    """The hashes of ``_run_hashes`` of rows of codes."""
    with np.errstate(over="ignore"):
        return ((windows.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, windows.shape[1])).sum(1, dtype=np.uint64)


def _leaks(batches, shared, run: int):
    index: Index = shared.value
    gap = np.full(run + 2 * STRIDE, len(index.terms), np.int32)
    for batch in batches:
        ids, texts = (batch.column(i).to_pylist() for i in range(2))
        pieces, starts, total = [], [], 0
        for text in texts:
            code = index.codes(text)
            starts.append(total)
            pieces += [code, gap]
            total += len(code) + len(gap)
        if not pieces:
            continue
        codes = np.concatenate(pieces)
        start, side = index.verified(codes, *index.search(codes))
        owner = np.searchsorted(np.array(starts), start, "right") - 1
        pairs = np.unique(np.stack([owner, side], 1), axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[d] for d in pairs[:, 0]], pa.int64()), pa.array(index.items[pairs[:, 1]]), pa.array([SIDES[index.kinds[s]] for s in pairs[:, 1]], pa.string())],
            names=["doc_id", "item_id", "side"],
        )


def _portions(rows: Iterator, chars: int) -> Iterator[list[tuple]]:
    """Rows of items in lists of at most about ``chars`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(tuple(row))
        size += len(row[1] or "") + len(row[2] or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_sides(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", run: int = RUN, chars: int = INDEX_CHARS) -> DataFrame:
    """Distinct rows of ``passages_found``: which side of which item each document leaks."""
    return passages_found(documents, items, doc_col, text_col, run, chars).distinct()


def passages_found(documents: DataFrame, items: DataFrame, doc_col: str, text_col: str, run: int, chars: int) -> DataFrame:
    """``doc_id``, ``item_id``, ``side`` (prompt or answer) of each document that holds ``run``
    successive words of that side, in the same order without another word between.

    ``items``: ``item_id``, ``prompt``, ``answer``; those of more than ``chars`` characters make
    several indexes, each with a pass over the documents. Null and empty texts hold nothing; sides
    shorter than ``run`` can't leak; whole texts are searched, however long; items with equal
    texts are all reported; repeated rows of documents repeat their rows.
    Empty tables give no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    schema = "doc_id bigint, item_id bigint, side string"

    def one(portion: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index(portion, run))
        return texts.mapInArrow(lambda batches: _leaks(batches, shared, run), schema)

    found = [one(p) for p in _portions(items.select(F.col("item_id").cast("long"), "prompt", "answer").toLocalIterator(), chars)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def find_leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``doc_id``, ``item_id`` of ``find_sides``, whichever side leaked; a row a pair."""
    return passages_found(documents, items, doc_col, text_col, run, INDEX_CHARS).select("doc_id", "item_id").distinct()


def leaked_items(leaks: DataFrame) -> DataFrame:
    """Per item, the number of documents that leak it."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))
