"""Language identification by error-correcting output codes over character n-grams.

Every learned language has a codeword of bits, and for every bit one binary classifier tells the languages
that have it from those that have not. A classifier is linear in the n-grams of one to three letters
(hashed; a word's ends count as a character): its weights are the log ratios of an n-gram's smoothed shares in both
groups, where each language weighs the same however many rows it has. A text's margin for a bit is the
mean weight of its n-grams, drawn towards 0 for short texts, then centred and scaled by the means and the variance that
training texts of both groups have. Decoding is weighted by loss: the logistic loss of each margin against a codeword's bit counts by
how far the bit's classifier beats chance on training texts; the language of the least total is
predicted, its share among the exponentials of all totals is the score, and it is ambiguous if the next
codeword's total lies within AMBIGUOUS of it, relative to what a step between the two can cost.

Two passes over all training texts sum n-grams by language and margins by language and bit. Every language is learned,
however rare and however many there are: Spark sums shares over languages by bucket and margins over languages by bit, so the
driver and a task hold buckets times bits (which grow with the logarithm of the languages), and of each language its name and codeword.

Defined results: null text, and text without letters, is ``und`` with score 0 and not ambiguous; so is
every text if nothing is learned. With one language that one is predicted, with score 1. A null doc_id
has the empty text as its number. Rows without lang are predicted but not learned from. N-grams don't cross the runs of CHUNK characters that a text is read in.
Repeated rows count and are predicted each; other columns can have any name; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix

BITS = 16
#: Weight of a smoothed n-gram, and n-grams that a text's margin is drawn to 0 by.
ALPHA, DRAWN = 0.5, 20
AMBIGUOUS = 0.25
#: Characters that are read at once, and languages whose counts a training task holds before it passes them on.
CHUNK, HELD = 1 << 18, 64
#: Losses that are held at once, and languages up to which codes are compared by all their pairs.
CELLS, COMPARED = 1 << 22, 1024
UNKNOWN = "und"


def held_out() -> Column:
    """Whether the rest of the document's number is the one that is not learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Every code point's lower-case letter, or 0 for what is none."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(len(out)):
        if chr(i).isalpha():
            out[i] = ord(chr(i).lower()[0])
    return out


def _runs(column: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and pieces of their texts, of about CHUNK characters together; empty ones are left out."""
    rows: list[int] = []
    pieces: list[str] = []
    size = 0
    for i, cell in enumerate(column):
        text = cell.as_py() or ""
        for at in range(0, len(text), CHUNK):
            piece = text[at : at + CHUNK]
            rows.append(i)
            pieces.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield rows, pieces
                rows, pieces, size = [], [], 0
    if rows:
        yield rows, pieces


def grams(column: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all n-grams of a column of texts, rows in ascending order within each pair of arrays."""
    down = np.uint64(64 - bits)
    for rows, pieces in _runs(column):
        raw = np.frombuffer(("\n" + "\n".join(pieces) + "\n").encode("utf-32-le"), dtype="<u4")
        row = np.repeat(np.array(rows), [len(p) + 1 for p in pieces])
        row = np.concatenate((row[:1], row))
        c = _letters()[raw]
        kept = np.ones(len(c), dtype=bool)  # of other characters in a row the first stays, as the end of a word
        kept[1:] = (c[1:] > 0) | (c[:-1] > 0)
        c, row = c[kept].astype(np.uint64), row[kept]
        letter = c > 0
        yield row[letter], (mix(c[letter]) >> down).astype(np.int64)
        if len(c) > 2:
            two = c[:-1] | c[1:] << np.uint64(21) | np.uint64(1 << 63)
            yield np.where(letter[1:], row[1:], row[:-1]), (mix(two) >> down).astype(np.int64)
            middle = letter[1:-1]
            three = (c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42))[middle]
            yield row[1:-1][middle], (mix(three, 1) >> down).astype(np.int64)


def gram_counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, bucket, n) over (lang, text); bucket -1 counts the rows."""
    size = 1 << bits

    def run(batches):
        counts: dict[str, np.ndarray] = {}

        def passed():
            for lang, n in counts.items():
                held = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held - 1), pa.array(n[held])], ["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            of = names.indices.to_numpy()
            for k, lang in enumerate(names.dictionary.to_pylist()):
                if lang not in counts and len(counts) >= HELD:
                    yield from passed()
                n = counts.setdefault(lang, np.zeros(size + 1, dtype=np.int64))
                own = pa.array(of == k)
                texts = batch.column(1).filter(own)
                n[0] += len(texts)
                for _, bucket in grams(texts, bits):
                    n[1:] += np.bincount(bucket, minlength=size)
        yield from passed()

    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, bucket bigint, n bigint")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(languages: int, tries: int = 200) -> np.ndarray:
    """A codeword of -1 and 1 for each language: every way to split a few languages, else the best of random codes by least distance.

    Of more than COMPARED languages it is the first random code whose words all differ.
    """
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= 6:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    rng, best, width = np.random.default_rng(0), None, 2 * int(np.ceil(np.log2(languages))) + 21
    for _ in range(tries):
        code = np.where(rng.random((languages, width)) < 0.5, 1.0, -1.0)
        if languages > COMPARED:
            if len(np.unique(np.packbits(code > 0, axis=1), axis=0)) == languages:
                return code
            continue
        apart = (width - code @ code.T) / 2 + width * np.eye(languages)
        if (np.abs(code.sum(0)) < languages).all() and (best is None or apart.min() > best[0]):
            best = (apart.min(), code)
    return best[1]


@dataclass
class Coder:
    """Languages with their codewords; weights by bucket and bit; shift, scale and trust of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    trust: np.ndarray
    bits: int

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many n-grams every text has, and its raw margin for each bit."""
        n, total = np.zeros(len(column)), np.zeros((len(column), self.code.shape[1]))
        for row, bucket in grams(column, self.bits):
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                n[row[first]] += np.diff(np.append(first, len(row)))
                total[row[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
        return n, total / (n + DRAWN)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """The weighted logistic loss of every text against every codeword."""
        scaled = (margins - self.shift) * self.scale
        has, lacks = np.logaddexp(0, -scaled) * self.trust, np.logaddexp(0, scaled) * self.trust
        return np.stack([np.where(word > 0, has, lacks).sum(1) for word in self.code], axis=1)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of every text."""
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column), dtype=bool)
        n, margins = self.margins(column)
        block = max(1, CELLS // len(self.languages))
        best, score, unsure = (np.concatenate(x) for x in zip(*(self._decoded(margins[i : i + block]) for i in range(0, max(1, len(margins)), block)), strict=True))
        some = n > 0
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0), unsure & some

    def _decoded(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's number, score and ambiguity by the losses of margins."""
        loss = self.losses(margins)
        best = loss.argmin(1)  # ties go to the language that sorts first
        least = loss[np.arange(len(loss)), best]
        score = 1 / np.exp(least[:, None] - loss).sum(1)
        unsure = np.zeros(len(loss), dtype=bool)
        if len(self.languages) > 1:
            loss[np.arange(len(loss)), best] = np.inf
            second = loss.argmin(1)
            apart = ((self.code[best] != self.code[second]) * self.trust).sum(1)
            unsure = loss.min(1) - least < AMBIGUOUS * apart
        return best, score, unsure


def learn(docs: DataFrame, bits: int = BITS, most: int | None = None) -> Coder:
    """A coder from (lang, text), for all languages or only the ``most`` frequent; rows without lang count for nothing."""
    counts = gram_counts(docs.where("lang IS NOT NULL"), bits).cache()
    try:
        sizes = counts.groupBy("lang").agg(F.sum(F.when(F.col("bucket") < 0, F.col("n"))).alias("rows"), F.sum(F.when(F.col("bucket") >= 0, F.col("n")).otherwise(0)).alias("grams"))
        got = (sizes if most is None else sizes.orderBy(F.desc("rows"), "lang").limit(most)).toArrow()  # a row for each language
        grams_of = dict(zip(got["lang"].to_pylist(), got["grams"].to_pylist(), strict=True))
        languages = sorted(grams_of)
        code = codewords(len(languages))
        weights = log_ratios(counts, languages, np.array([grams_of[x] for x in languages], dtype=float), code, bits) if len(languages) > 1 else np.zeros((1 << bits, 0))
    finally:
        counts.unpersist()
    ones = np.ones(code.shape[1])
    coder = Coder(languages, code, weights, 0 * ones, ones, ones, bits)
    return calibrated(coder, docs) if len(languages) > 1 else coder


def _numbers(names: pa.Array, place: dict[str, int]) -> np.ndarray:
    """The numbers of languages, or -1 for those that are not learned."""
    names = names.dictionary_encode("encode")
    return np.array([place.get(x, -1) for x in names.dictionary.to_pylist()], dtype=int)[names.indices.to_numpy()] if len(names) else np.zeros(0, int)


def log_ratios(counts: DataFrame, languages: list[str], grams_of: np.ndarray, code: np.ndarray, bits: int) -> np.ndarray:
    """Weights by bucket and bit: the log ratio of the mean smoothed shares in the languages that have the bit and those that have not.

    All counts of a bucket come to one task, at most one a language; what leaves it is a row for each bucket.
    """
    size, wide = 1 << bits, code.shape[1]
    whole = grams_of + ALPHA * size
    has = np.concatenate((code > 0, code < 0), axis=1)
    least, many = (has * (ALPHA / whole)[:, None]).sum(0), has.sum(0)
    place = {x: k for k, x in enumerate(languages)}

    def made(bucket: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        mean = (sums + least) / many
        ratio = np.log(mean[:, :wide] / mean[:, wide:])
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.FixedSizeListArray.from_arrays(pa.array(ratio.ravel()), wide).cast(pa.list_(pa.float64()))], ["bucket", "w"])

    def run(batches):
        last = None  # a bucket's counts may go on in the next batch
        for batch in batches:
            k = _numbers(batch.column(0), place)
            bucket, n = (batch.column(i).to_numpy()[k >= 0] for i in (1, 2))
            k = k[k >= 0]
            if not len(k):
                continue
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            sums, bucket = np.add.reduceat(has[k] * (n / whole[k])[:, None], first, axis=0), bucket[first]
            if last is not None and last[0][0] == bucket[0]:
                sums[0] += last[1][0]
            elif last is not None:
                yield made(*last)
            yield made(bucket[:-1], sums[:-1])
            last = bucket[-1:], sums[-1:]
        if last is not None:
            yield made(*last)

    rows = counts.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket", "lang")
    got = rows.mapInArrow(run, "bucket bigint, w array<double>").toArrow()  # at most 2 ** bits rows
    out = np.zeros((size, wide))
    out[got["bucket"].to_numpy()] = got["w"].combine_chunks().flatten().to_numpy().reshape(-1, wide)
    return out


def calibrated(coder: Coder, docs: DataFrame) -> Coder:
    """``coder`` with shifts and scales of its margins from all texts that are learned from, and the trust in its bits from those that they decide rightly."""
    wide = coder.code.shape[1]
    place = {x: k for k, x in enumerate(coder.languages)}

    def run(batches):
        sums = np.zeros((len(place), 1 + 2 * wide))
        for batch in batches:
            lang = _numbers(batch.column(0), place)
            n, margins = coder.margins(batch.column(1))
            some = np.flatnonzero((lang >= 0) & (n > 0))
            some = some[np.argsort(lang[some], kind="stable")]
            if len(some):
                first = np.flatnonzero(np.diff(lang[some], prepend=-1))
                sums[lang[some[first]]] += np.add.reduceat(np.column_stack((np.ones(len(some)), margins[some], margins[some] ** 2)), first, axis=0)
        k, bit = (x.ravel() for x in np.indices((len(place), wide))[:, sums[:, 0] > 0])
        cells = [k, bit, coder.code[k, bit] > 0, sums[k, 0], sums[k, 1 + bit], sums[k, 1 + wide + bit]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["k", "bit", "has", "n", "x", "xx"])

    rows = docs.where("lang IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    rows = rows.mapInArrow(run, "k bigint, bit bigint, has boolean, n double, x double, xx double").groupBy("k", "bit", "has").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx")])
    groups = rows.groupBy("bit", "has").agg(F.avg(F.col("x") / F.col("n")).alias("mean"), F.avg(F.col("xx") / F.col("n")).alias("square"))
    by = {(r.bit, r.has): (r.mean, r.square) for r in groups.collect()}  # two rows for each bit
    for b in range(wide):
        if (b, True) in by and (b, False) in by:
            (high, _), (low, _) = by[b, True], by[b, False]
            variance = np.mean([square - mean**2 for mean, square in (by[b, True], by[b, False])]) + 1e-4
            coder.shift[b] = (high + low) / 2
            coder.scale[b] = max(high - low, 0.0) / variance
            coder.trust[b] = 1 - np.exp(-((high - low) ** 2) / (8 * variance))  # how far beyond chance two such normal groups are told apart, at least
    return coder


def identify(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document, learned from those with a lang that are not held out."""
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    coder = learn(rows.where("NOT held_out").select("lang", "text"), bits)

    def run(batches):
        for batch in batches:
            lang, score, unsure = coder.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    out = rows.select(F.col("doc_id").cast("bigint"), "held_out", "text")
    return out.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")
