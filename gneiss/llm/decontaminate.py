"""Benchmark decontamination under edit distance: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are lower-cased words without ASCII punctuation. A document leaks an item of n words if some
stretch of it is within floor(SHARE * n) word edits of the item.

* An item is embedded in pieces of PIECE to 2 * PIECE - 1 words (one of n words if it is shorter).
  The allowed edits deal over the pieces, so some piece has no more than its own share of them,
  however long the item is; a fixed number of walks over whole items would lose ever more leaks.
* Every piece-sized window of a document, where the item can stand at all, walks
  through the CGK embedding: at each step it emits the word it stands on and moves on or stays by a
  random bit of that word, so that few edits become few differing steps.
* Where an item can stand there have to be enough of its word pairs: k edits spoil at most 2k of an item's
  n - 1 pairs, so this loses nothing, and one of the pairs that all but 2k of its places have is there. Only an item's
  rarest pairs that hold 2k + 1 of its places lead to it, so that a phrase that thousands of items share leads to none of them.
* Each of REPEATS independent walks samples SAMPLED steps, hashed together; a window and a piece of an item that
  can stand there make the document and the item candidates if they agree on all of them. The tests measure the recall by
  length and kind of edit, at all allowed edits: above 0.9 each.
* Candidates are verified exactly, wherever in the document the word pairs suffice: edit_distance is
  the least number of word edits between the item and any stretch of the document, by a bit-parallel table.

The benchmark is the query set: it is taken in blocks of about BLOCK_ITEMS items, whose tables are
broadcast; documents stay where they are and nothing is shuffled. Word pairs are expanded to the items
that they lead to by runs of EXPANDED at most, and item by item where a single document has more.

Defined results: null text has no words; items of fewer than LEAST_WORDS words identify nothing and
are left out; repeated rows give repeated results; a null doc_id or item_id stays null; an empty
table on either side gives no rows. Other columns can have any name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H

SHARE, LEAST_WORDS, PIECE, REPEATS, SAMPLED = 0.2, 5, 10, 40, 4
BLOCK_ITEMS, EXPANDED, WINDOWS = 100_000, 1 << 21, 1 << 13
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def allowed(n: int) -> int:
    return int(SHARE * n)


def pieces(n: int) -> list[tuple[int, int]]:
    """First word and number of words of each piece of an item of n words."""
    cuts = np.linspace(0, n, max(1, n // PIECE) + 1).astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def word_arrays(column: pa.Array):
    """(first row, rows, word hashes, row of each word) by chunks."""
    for lo, hi, data, offsets in H.chunks(pc.utf8_lower(column)):
        data = _PLAIN[data]
        starts, ends, row = H.spans(data, offsets)
        yield lo, hi - lo, H.word_hashes(data, starts, ends), row


@lru_cache(maxsize=4096)
def _walks(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per repeat and step of the walks over n-word windows: the random multiplier, and whether the step is sampled."""
    rng = np.random.default_rng(n)
    coins = rng.integers(0, 1 << 63, size=(REPEATS, 2 * n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sampled = np.zeros((REPEATS, 2 * n), dtype=bool)
    for row in sampled:
        row[rng.choice(2 * n, size=SAMPLED, replace=False)] = True
    return coins, sampled


def walk_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """LSH keys (repeats x windows) of the windows words[start:end], of n words or less: the sampled steps of their CGK walks, hashed together."""
    coins, sampled = _walks(n)
    keys = np.repeat(((np.uint64(n) << np.uint64(16)) + np.arange(REPEATS, dtype=np.uint64))[:, None], len(starts), axis=1)
    at = np.repeat(starts[None, :], REPEATS, axis=0)
    for j in range(2 * n):
        word = np.where(at < ends, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        take = np.flatnonzero(sampled[:, j])
        if len(take):
            keys[take] = H.mix(keys[take] * np.uint64(0x9E3779B97F4A7C15) + word[take])
        at += ((word * coins[:, j : j + 1]) >> np.uint64(63)).astype(np.int64)
    return keys


def _masks(item: np.ndarray) -> dict[int, int]:
    """Word to the bits of its places in the item."""
    out: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        out[word] = out.get(word, 0) | 1 << i
    return out


def _edits(masks: dict[int, int], n: int, words: list[int]) -> int:
    """As ``edits``, for an item of n words: a column of the table at a time, its steps up and down as bits (Myers)."""
    full, top = (1 << n) - 1, 1 << (n - 1) if n else 0
    up, down, now = full, 0, n
    best = now
    for word in words:
        same = masks.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up) & full, up & across
        now += (more & top != 0) - (less & top != 0)
        best = min(best, now)
        same |= down
        more, less = more << 1 & full, less << 1 & full
        up, down = less | ~(same | more) & full, more & same
    return best


def edits(item: np.ndarray, words: np.ndarray) -> int:
    """The least number of word edits that turn ``item`` into any stretch of ``words``."""
    return _edits(_masks(item), len(item), words.tolist())


class Items:
    """Word arrays, word pairs with the items that they lead to, and LSH keys of the pieces of one block of the benchmark."""

    def __init__(self, texts: list[str]):
        self.words: list[np.ndarray] = []
        for _, rows, words, row in word_arrays(pa.array(texts, pa.string())):
            self.words += np.split(words, np.searchsorted(row, np.arange(1, rows)))
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.allowed = np.array([allowed(int(n)) for n in self.size], dtype=np.int64)
        self.need = self.size - 1 - 2 * self.allowed
        used = [i for i, n in enumerate(self.size) if n >= LEAST_WORDS]
        owner = np.concatenate([np.full(self.size[i] - 1, i) for i in used]) if used else np.empty(0, np.int64)
        pair = np.concatenate([H.window_hashes(self.words[i], 2) for i in used]) if used else np.empty(0, np.uint64)
        order = np.lexsort((owner, pair))
        first = np.ones(len(order), dtype=bool)  # an item has a pair once
        first[1:] = (pair[order][1:] != pair[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        times = np.diff(np.append(np.flatnonzero(first), len(order)))
        owner, pair = owner[order][first], pair[order][first]
        self.pairs, which, held = np.unique(pair, return_inverse=True, return_counts=True)
        self.members = np.sort(owner * len(self.pairs) + which)
        self.distinct = np.bincount(owner, minlength=len(self.size))
        rare = np.lexsort((held[which], owner))  # by item, its rarest pairs first
        upto = np.cumsum(times[rare]) - times[rare]
        begin = np.searchsorted(owner[rare], owner[rare])
        rare = rare[upto - upto[begin] <= 2 * self.allowed[owner[rare]]] if len(rare) else rare
        rare = rare[np.lexsort((owner[rare], which[rare]))]
        self.lead, self.lead_first = owner[rare], np.searchsorted(which[rare], np.arange(len(self.pairs) + 1))
        self.own_lead = which[rare][np.argsort(self.lead, kind="stable")]
        self.own_first = np.searchsorted(np.sort(self.lead), np.arange(len(self.size) + 1))
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.pairs & np.uint64(len(self.bits) - 1)] = True
        self.masks = [_masks(w) for w in self.words]
        self.piece_first = np.zeros(len(self.size) + 1, dtype=np.int64)
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(len(self.size)):
            own = pieces(int(self.size[i])) if self.size[i] >= LEAST_WORDS else []
            for j, (at, n) in enumerate(own):
                by_length.setdefault(n, []).append((i, at, int(self.piece_first[i]) + j))
            self.piece_first[i + 1] = self.piece_first[i] + len(own)
        self.keys = np.empty((REPEATS, int(self.piece_first[-1])), dtype=np.uint64)
        for n, own in by_length.items():
            joined, starts = np.concatenate([self.words[i][at : at + n] for i, at, _ in own]), np.arange(len(own)) * n
            self.keys[:, [j for _, _, j in own]] = walk_keys(joined, starts, starts + n, n)

    def runs(self, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(row, item, first, last): the runs of window starts at which the row holds enough of the item's word pairs."""
        none = np.empty((0, 4), np.int64)
        if len(words) < 2 or not len(self.pairs):
            return none
        pairs = H.window_hashes(words, 2)
        at = np.flatnonzero(self.bits[pairs & np.uint64(len(self.bits) - 1)] & (row[1:] == row[:-1]))
        place = np.minimum(np.searchsorted(self.pairs, pairs[at]), len(self.pairs) - 1)
        known = self.pairs[place] == pairs[at]
        at, place = at[known], place[known]
        if not len(at):
            return none
        held = np.full(len(words), -1, dtype=np.int64)
        held[at] = place
        times, out, lo = self.lead_first[place + 1] - self.lead_first[place], [none], 0
        at, place, times = at[times > 0], place[times > 0], times[times > 0]
        total, ends = np.cumsum(times), np.append(np.flatnonzero(np.diff(row[at])) + 1, len(at))
        while lo < len(at):
            done = total[lo - 1] if lo else 0
            k = np.searchsorted(ends, lo, side="right")
            hi = int(ends[max(k, np.searchsorted(total[ends - 1], done + EXPANDED, side="right") - 1)])
            if total[hi - 1] - done <= EXPANDED:
                inner = np.arange(total[hi - 1] - done) - np.repeat(total[lo:hi] - times[lo:hi] - done, times[lo:hi])
                item = self.lead[np.repeat(self.lead_first[place[lo:hi]], times[lo:hi]) + inner]
                out += self._around(item, np.repeat(at[lo:hi], times[lo:hi]), row, held)
            else:  # one document, item by item, for those of which it has enough pairs at all
                order = np.argsort(place[lo:hi], kind="stable")
                there, where = place[lo:hi][order], at[lo:hi][order]
                for i in self._possible(np.unique(held[np.searchsorted(row, row[at[lo]]) : np.searchsorted(row, row[at[lo]], side="right")])):
                    own = self.own_lead[self.own_first[i] : self.own_first[i + 1]]
                    left, right = np.searchsorted(there, own), np.searchsorted(there, own, side="right")
                    own = np.concatenate([where[a:b] for a, b in zip(left, right, strict=True)])
                    out += self._around(np.full(len(own), i), own, row, held) if len(own) else []
            lo = hi
        return np.concatenate(out)

    def _possible(self, place: np.ndarray) -> np.ndarray:
        """Items of which all pairs but those that the allowed edits spoil are among the distinct pairs ``place``."""
        here = np.zeros(len(self.pairs), dtype=bool)
        here[place[place >= 0]] = True
        count = np.bincount(self.members[here[self.members % len(self.pairs)]] // len(self.pairs), minlength=len(self.size))
        return np.flatnonzero((count > 0) & (count >= self.distinct - 2 * self.allowed))

    def _around(self, item: np.ndarray, at: np.ndarray, row: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
        """The runs near places that lead to items: of what stands within a window of these, all pairs of the item count."""
        order = np.lexsort((at, item, row[at]))
        item, at, reach = item[order], at[order], self.size[item[order]] - 2
        low = np.maximum(at - reach, np.searchsorted(row, row[at]))
        high = np.minimum(at + reach, np.searchsorted(row, row[at], side="right") - 1)
        new = np.ones(len(item), dtype=bool)  # stretches of one document and item that overlap are one
        new[1:] = (item[1:] != item[:-1]) | (row[at[1:]] != row[at[:-1]]) | (low[1:] > high[:-1])
        first = np.flatnonzero(new)
        item, low, high = item[first], low[first], high[np.append(first[1:], len(new)) - 1]
        apart = np.ones(len(item), dtype=bool)
        apart[1:] = (item[1:] != item[:-1]) | (row[low[1:]] != row[low[:-1]])
        groups, total, out, lo = np.append(np.flatnonzero(apart)[1:], len(item)), np.cumsum(high - low + 1), [], 0
        while lo < len(item):
            done = total[lo - 1] if lo else 0
            k = np.searchsorted(groups, lo, side="right")
            hi = int(groups[max(k, np.searchsorted(total[groups - 1], done + EXPANDED, side="right") - 1)])
            sizes = (high - low + 1)[lo:hi]
            place = np.repeat(low[lo:hi] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            whose = np.repeat(item[lo:hi], sizes)
            known = held[place] >= 0
            place, whose = place[known], whose[known]
            key = whose * len(self.pairs) + held[place]
            hit = self.members[np.minimum(np.searchsorted(self.members, key), len(self.members) - 1)] == key
            out.append(self._enough(whose[hit], place[hit], row))
            lo = hi
        return out

    def _enough(self, item: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        order = np.lexsort((at, item, row[at]))
        item, at = item[order], at[order]
        # need-th known pair from here on, of the same document and item and within a window?
        n, later = self.size[item], np.arange(len(item)) + self.need[item] - 1
        inside = later < len(item)
        later = np.minimum(later, max(0, len(item) - 1))
        inside &= (item[later] == item) & (row[at[later]] == row[at]) & (at[later] - at <= n - 2)
        item, n, low, high = item[inside], n[inside], at[later][inside] - (n[inside] - 2), at[inside]
        low = np.maximum(low, np.searchsorted(row, row[high]))
        if not len(item):
            return np.empty((0, 4), np.int64)
        # runs whose stretches can meet are one; starts ascend within a document and item
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (row[high[1:]] != row[high[:-1]]) | (low[1:] > high[:-1] + 2 * n[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(item)) - 1
        return np.stack((row[high[first]], item[first], low[first], high[last]), axis=1)

    def met(self, runs: np.ndarray, words: np.ndarray, row: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) of the runs in which a walk of a window met that of a piece of the item."""
        asked: dict[int, list[tuple[int, int, int, int]]] = {}
        for number, (r, i, first, last) in enumerate(runs.tolist()):
            begin, end = np.searchsorted(row, (r, r + 1)).tolist()
            k = int(self.allowed[i])
            for j, (at, n) in enumerate(pieces(int(self.size[i])), int(self.piece_first[i])):
                low, high = max(begin, first + at - k), min(end, last + at + k + 1)
                asked.setdefault(n, []).extend((a, min(a + WINDOWS, high), j, number) for a in range(low, high, WINDOWS))
        found = np.zeros(len(runs), dtype=bool)
        for n, parts in asked.items():
            low, high, piece, number = np.array(sorted(parts), dtype=np.int64).T
            total, lo = np.cumsum(high - low), 0
            while lo < len(low):  # by blocks of windows, those that stand together together
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + WINDOWS, side="right")))
                sizes = (high - low)[lo:hi]
                starts = np.repeat(low[lo:hi] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                own, place = np.unique(starts, return_inverse=True)
                keys = walk_keys(words, own, np.minimum(own + n, np.searchsorted(row, row[own], side="right")), n)
                same = (keys[:, place] == self.keys[:, np.repeat(piece[lo:hi], sizes)]).any(0)
                found[np.repeat(number[lo:hi], sizes)[same]] = True
                lo = hi
        return {(r, i) for r, i in runs[found, :2].tolist()}

    def leaked(self, words: np.ndarray, row: np.ndarray) -> dict[tuple[int, int], int]:
        """(row, item) of every leak, with its edit distance."""
        least: dict[tuple[int, int], int] = {}
        runs = self.runs(words, row)
        met = self.met(runs, words, row) if len(runs) else set()
        for r, i, first, last in runs.tolist():
            if (r, i) in met:
                n, k = int(self.size[i]), int(self.allowed[i])
                begin, end = np.searchsorted(row, (r, r + 1))
                distance = _edits(self.masks[i], n, words[max(begin, first - k) : min(end, last + n + k)].tolist())
                if distance <= k:
                    least[r, i] = min(distance, least.get((r, i), distance))
        return least


def _blocks(benchmark: DataFrame):
    """Item ids and tables of each block of the benchmark, broadcast."""
    blocks = -(-benchmark.count() // BLOCK_ITEMS)
    for block in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = rows.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], Items([r.text for r in rows])))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words and edit_distance of every document and item that it leaks."""
    schema = "doc_id bigint, item_id bigint, item_words bigint, edit_distance bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _blocks(benchmark):
        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_finder(shared), schema))
    return out


def _finder(shared):
    def run(batches):
        item_ids, items = shared.value
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), []
            for lo, _, words, row in word_arrays(pc.fill_null(batch.column(1), "")):
                found += [(ids[lo + r], item_ids[i], int(items.size[i]), distance) for (r, i), distance in sorted(items.leaked(words, row).items())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "item_id", "item_words", "edit_distance"])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item. Every row is judged by its own text."""
    place = docs.columns.index("text")

    def keeper(shared):
        def run(batches):
            _, items = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, _, words, row in word_arrays(pc.fill_null(batch.column(place), "")):
                    keep[[lo + r for r, _ in items.leaked(words, row)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for shared in _blocks(benchmark):
        docs = docs.mapInArrow(keeper(shared), docs.schema)
    return docs
