"""Phrases whose words keep each other's company, by exact counts of all word n-grams.

Shards of the corpus count in counting quotient filters. Words get numbers first: a shard asks
for those of its words, hash buckets total the counts and answer. An n-gram is then a packed
number of a few dozen bits; an invertible permutation of those bits spreads it evenly, its high
bits are the quotient, and the filter keeps the whole remainder beside it. Nothing is lost, so
merging the sorted filters of all shards, range by range of the quotients, gives exact counts,
and the inverse permutation gives the words back.

A phrase is at most as frequent as any part of it. Words below the limit get the number 0,
which ends an n-gram, and three and four words are only counted where all their word pairs
are frequent: what the result needs is counted in full, the rest is never sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.llm import base
from tidecast.llm.columnar import combine, hashes, mix, pack_counts, parts, spans, starts_of_runs, texts, unpack_counts
from tidecast.staging import join_salted, stage

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09]] = True
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
LONGEST = 4
ROUNDS = 4


# Words

def lowered(data: np.ndarray) -> np.ndarray:
    return data + np.uint8(32) * ((data >= 65) & (data <= 90))


def binaries(letters: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow array of the words that stand in ``letters`` one after the other."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, their documents, and whether each is the first of its piece."""
    data = lowered(data)
    stop = BREAK[data]
    inside = ~(SPACE[data] | stop)
    start, end, doc = spans(inside, offsets)
    stops = np.cumsum(stop)[start] if len(start) else start
    first = np.ones(len(start), bool)
    first[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
    return binaries(data[inside], end - start), doc, first


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 by byte planes, which compress better."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


SHARD = [("chunk", pa.int64()), ("part", pa.int32()), ("lang", pa.string()), ("bucket", pa.int32()),
         ("letters", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())]


def sharded(docs: DataFrame, n_bytes: int, n_buckets: int) -> DataFrame:
    """For each shard its token stream (0: a new piece), and a row per language and bucket with its
    distinct words and their counts. Tokens number those words through all parts, from 1."""

    def shard(chunk: int, lang: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        word, doc, first = words(data, offsets)
        coded, names = word.dictionary_encode(), lang.dictionary_encode()
        index, n = coded.indices.to_numpy(), max(len(coded.dictionary), 1)
        pair = names.indices.to_numpy().astype(np.int64)[doc] * n + index
        distinct, of, count = np.unique(pair, return_inverse=True, return_counts=True)
        code, which = distinct // n, distinct % n
        sort = lambda column: hashes(b := texts(column)[0], (o := texts(column)[1])[:-1], o[1:])
        h = combine(sort(names.dictionary)[code], sort(coded.dictionary)[which])
        bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
        order = np.lexsort((bucket, code))
        local = np.empty(len(order), np.int64)
        local[order] = np.arange(1, len(order) + 1)
        stream = np.zeros(len(of) + int(first.sum()), np.int64)
        stream[np.arange(len(of)) + np.cumsum(first)] = local[of]
        code, bucket, which, count = code[order], bucket[order].astype(np.int64), which[order], count[order]
        at = starts_of_runs(code * n_buckets + bucket)
        rows = [(chunk, -1, None, None, None, None, None, planes(stream))]
        for i, (lo, hi) in enumerate(zip(at, np.append(at, len(order))[1:], strict=True)):
            letters, ends = texts(coded.dictionary.take(pa.array(which[lo:hi])))
            rows.append((chunk, i, names.dictionary[code[lo]].as_py(), bucket[lo], letters.tobytes(),
                         planes(np.diff(ends)), pack_counts(count[lo:hi]), None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), SHARD, strict=True)],
                                          names=[name for name, _ in SHARD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, data, offsets in parts(batch["text"], base.chunk_bytes(n_bytes)):
                yield shard(chunk, batch["lang"][lo:lo + len(offsets) - 1], data, offsets)
                chunk += 1

    # written at once: a shard's number and order hold for all that follows
    return stage(docs.mapInArrow(base.tidy(run), "chunk long, part int, lang string, bucket int, letters binary, "
                                 "lengths binary, counts binary, tokens binary"), "shards")


def vocabulary(shards: DataFrame, least: int, n_buckets: int) -> DataFrame:
    """Answers for the shards (``chunk, part, ids``; 0: a rare word), frequent words (``lang, word, f,
    id``) and word totals (``lang, total``), as rows of one table."""

    def run(table: pa.Table) -> pa.Table:
        lang, bucket = np.array(table["lang"].to_pylist(), dtype=object), table["bucket"][0].as_py()
        answers, found, totals, given = [b""] * table.num_rows, [], [], 0
        lengths = [unplanes(x) for x in table["lengths"].to_pylist()]
        letters, counts = table["letters"].to_pylist(), [unpack_counts(x) for x in table["counts"].to_pylist()]
        for name in sorted(set(lang.tolist())):
            rows = np.flatnonzero(lang == name)
            size = np.concatenate([lengths[r] for r in rows])
            word = binaries(np.frombuffer(b"".join(letters[r] for r in rows), np.uint8), size).dictionary_encode()
            of = word.indices.to_numpy()
            count = np.zeros(len(word.dictionary), np.int64)
            np.add.at(count, of, np.concatenate([counts[r] for r in rows]))
            common = np.flatnonzero(count >= least)
            ids = np.zeros(len(count), np.int64)
            ids[common] = (given + np.arange(len(common))) * n_buckets + bucket + 1
            given += len(common)
            for r, part in zip(rows, np.split(ids[of], np.cumsum([len(lengths[r]) for r in rows])[:-1]), strict=True):
                answers[r] = pack_counts(part)
            found.append((name, word.dictionary.take(pa.array(common)).cast(pa.large_string()).cast(pa.string()),
                          count[common], ids[common]))
            totals.append((name, int(count.sum())))
        n, k = table.num_rows, sum(len(x[2]) for x in found)
        rows = {"chunk": table["chunk"].to_pylist() + [None] * (k + len(totals)),
                "part": table["part"].to_pylist() + [None] * (k + len(totals)),
                "ids": answers + [None] * (k + len(totals)),
                "lang": [None] * n + [x[0] for x in found for _ in x[2]] + [x[0] for x in totals],
                "word": [None] * n + [w for x in found for w in x[1].to_pylist()] + [None] * len(totals),
                "f": [None] * n + [int(c) for x in found for c in x[2]] + [None] * len(totals),
                "id": [None] * n + [int(c) for x in found for c in x[3]] + [None] * len(totals),
                "total": [None] * (n + k) + [x[1] for x in totals]}
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), VOCABULARY, strict=True)], names=list(rows))

    asked = shards.filter("part >= 0").drop("tokens")
    return stage(asked.groupBy("bucket").applyInArrow(
        base.tidy(run), "chunk long, part int, ids binary, lang string, word string, f long, id long, total long"), "vocabulary")


VOCABULARY = [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


# Packed n-grams and their permutation

def ones(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def packed(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the numbers of n-grams, n * width / 2 bits each; width is even, 32 at most."""
    w, h = np.uint64(width), np.uint64(width // 2)
    a, b, *more = ids
    if len(ids) == 2:
        return a, b
    if len(ids) == 3:
        return a << h | b >> h, (b & ones(width // 2)) << w | more[0]
    return a << w | b, more[0] << w | more[1]


def unpacked(left: np.ndarray, right: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    w, h = np.uint64(width), np.uint64(width // 2)
    if n == 2:
        return [left, right]
    if n == 3:
        return [left >> h, (left & ones(width // 2)) << h | right >> w, right & ones(width)]
    return [left >> w, left & ones(width), right >> w, right & ones(width)]


def permuted(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network: invertible, and every bit of the result depends on all bits."""
    for i in range(1, ROUNDS + 1):
        left, right = right, left ^ (mix(right + np.uint64(i)) & ones(half))
    return left, right


def restored(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for i in range(ROUNDS, 0, -1):
        left, right = right ^ (mix(left + np.uint64(i)) & ones(half)), left
    return left, right


def joined(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 64 bits (or all) of two halves, and the rest."""
    if 2 * half <= 64:
        return left << np.uint64(half) | right, np.zeros(len(left), np.uint64)
    if half == 64:
        return left, right
    rest = 2 * half - 64
    return left << np.uint64(64 - half) | right >> np.uint64(rest), right & ones(rest)


def halves(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    if 2 * half <= 64:
        return high >> np.uint64(half), high & ones(half)
    if half == 64:
        return high, low
    rest = 2 * half - 64
    return high >> np.uint64(64 - half), (high & ones(64 - half)) << np.uint64(rest) | low


def ordered(high: np.ndarray, low: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the numbers, and the first of each run of equal ones in it."""
    order = np.argsort(high, kind=kind)
    h, x = high[order], low[order]
    same = h[1:] == h[:-1]
    if (same & (x[1:] != x[:-1])).any():
        order = np.lexsort((low, high))
        h, x = high[order], low[order]
        same = (h[1:] == h[:-1]) & (x[1:] == x[:-1])
    return order, np.flatnonzero(np.concatenate([[True], ~same]))[:len(order)]


# Filters

def bits(x: np.ndarray, n: int) -> np.ndarray:
    """The lower n bits of each number, as rows of flags."""
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :n]


def unbits(flags: np.ndarray) -> np.ndarray:
    out = np.zeros((len(flags), 64), np.uint8)
    out[:, :flags.shape[1]] = flags
    return np.packbits(out, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def quotient_filter(high: np.ndarray, low: np.ndarray, count: np.ndarray, half: int, q: int) -> bytes:
    """Ascending numbers of 2 * half bits and their counts. Each quotient's run is a unary number of
    entries, then come the remainders bit by bit; a flag marks the counts above one, which follow."""
    n, top = len(high), min(2 * half, 64)
    quotient = (high >> np.uint64(top - q)).astype(np.int64)
    runs = np.zeros(n + int(quotient[-1] - quotient[0]) + 1, np.uint8)
    runs[np.arange(n) + quotient - quotient[0]] = 1
    rest = np.concatenate([bits(high, top - q), bits(low, 2 * half - top)], axis=1)
    many = count > 1
    fields = [np.packbits(runs).tobytes(), np.packbits(rest).tobytes(), np.packbits(many).tobytes(), pack_counts(count[many])]
    return np.array([n, q, quotient[0], *map(len, fields)], np.int64).tobytes() + b"".join(fields)


def entries(packed: bytes, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and counts of a filter, ascending."""
    n, q, first, *sizes = np.frombuffer(packed[:56], np.int64).tolist()
    cut = np.cumsum([56, *sizes]).tolist()
    runs, rest, many, more = (packed[a:b] for a, b in zip(cut, cut[1:], strict=False))
    top = min(2 * half, 64)
    flags = lambda x, m: np.unpackbits(np.frombuffer(x, np.uint8), count=m)
    quotient = np.flatnonzero(np.unpackbits(np.frombuffer(runs, np.uint8))) - np.arange(n) + first
    rest = flags(rest, n * (2 * half - q)).reshape(n, 2 * half - q)
    count = np.ones(n, np.int64)
    count[flags(many, n) > 0] = unpack_counts(more)
    high = quotient.astype(np.uint64) << np.uint64(top - q) if q < 64 else quotient.astype(np.uint64)
    return high | unbits(rest[:, :top - q]), unbits(rest[:, top - q:]), count


def bucketed(high: np.ndarray, half: int, n_buckets: int) -> np.ndarray:
    """The range of quotients that each number falls into."""
    top = min(2 * half, 64)
    h = high >> np.uint64(top - 32) if top >= 32 else high << np.uint64(32 - top)
    return (h * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


class Grams:
    """The distinct n-grams at some places of a token stream, ascending by their permuted numbers."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, n: int, width: int) -> None:
        self.n, self.half, self.at = n, n * width // 2, at
        number = joined(*permuted(*packed([ids[at + i] for i in range(n)], width), self.half), self.half)
        self.order, first = ordered(*number)
        self.high, self.low = (x[self.order[first]] for x in number)
        self.count = np.diff(np.append(first, len(at)))

    def filters(self, n_buckets: int) -> list[tuple[int, int, bytes]]:
        """Order, bucket and filter; the quotient has about as many values as there are entries."""
        bucket = bucketed(self.high, self.half, n_buckets)
        q = int(np.clip(len(bucket).bit_length() - 1, 1, min(2 * self.half, 32)))
        at = starts_of_runs(bucket)
        return [(self.n, int(bucket[lo]), quotient_filter(self.high[lo:hi], self.low[lo:hi], self.count[lo:hi], self.half, q))
                for lo, hi in zip(at, np.append(at, len(bucket))[1:], strict=True)]

    def where(self, distinct: np.ndarray, n_places: int) -> np.ndarray:
        """For every place of the stream whether a flagged n-gram starts there."""
        out = np.zeros(n_places, bool)
        out[self.at[self.order]] = np.repeat(distinct, self.count)
        return out


def pairs(ids: np.ndarray, width: int) -> Grams:
    return Grams(ids, np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0)), 2, width)


def stream(tokens: pa.Table, answers: pa.Table) -> np.ndarray:
    """Word numbers of a shard's tokens; 0 where a piece starts or a word is rare."""
    asked = answers.filter(answers["ids"].is_valid()).sort_by("part")
    ids = np.concatenate([np.zeros(1, np.int64), *map(unpack_counts, asked["ids"].to_pylist())])
    return ids.astype(np.uint64)[unplanes(tokens["tokens"][0].as_py())] if tokens.num_rows else ids[:0].astype(np.uint64)


FILTERS = "chunk long, n int, bucket int, filter binary"


def emitted(chunk: list[int], filters: list[tuple[int, int, bytes]]) -> pa.Table:
    n, bucket, data = zip(*filters, strict=True) if filters else ((), (), ())
    return pa.Table.from_arrays([pa.array(chunk * len(n), pa.int64()), pa.array(n, pa.int32()), pa.array(bucket, pa.int32()),
                                 pa.array(data, pa.binary())], names=["chunk", "n", "bucket", "filter"])


MERGED = [("chunk", pa.int64()), ("bucket", pa.int32()), ("frequent", pa.binary()), ("a", pa.int64()), ("b", pa.int64()),
          ("c", pa.int64()), ("d", pa.int64()), ("f", pa.int64())]


def merged(filters: DataFrame, width: int, least: int, name: str) -> DataFrame:
    """Frequent n-grams (``a, b, c, d, f``; 0 behind the last word) of the merged filters of all
    shards, and for each pair filter which of its entries are frequent (``chunk, bucket, frequent``)."""

    def run(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        half = n * width // 2
        got = [entries(x, half) for x in table["filter"].to_pylist()]
        high, low, count = (np.concatenate(x) for x in zip(*got, strict=True))
        order, first = ordered(high, low, "stable")  # a merge of sorted runs
        total = np.add.reduceat(count[order], first)
        common = total >= least
        at = order[first[common]]
        words_ = unpacked(*restored(*halves(high[at], low[at], half), half), n, width)
        k = len(at)
        back = [None] * k
        if n == 2:
            flags = np.zeros(len(high), bool)
            flags[order] = np.repeat(common, np.diff(np.append(first, len(order))))
            replies = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum([len(x[0]) for x in got])[:-1])]
            chunk, bucket = table["chunk"].to_pylist(), table["bucket"].to_pylist()
        else:
            replies, chunk, bucket = [], [], []
        ids = [pa.concat_arrays([pa.nulls(len(replies), pa.int64()), pa.array(x.astype(np.int64))])
               for x in (*words_, *[np.zeros(k)] * (LONGEST - n), total[common])]
        return pa.Table.from_arrays([pa.array(chunk + back, pa.int64()), pa.array(bucket + back, pa.int32()),
                                     pa.array(replies + back, pa.binary()), *ids], names=[x for x, _ in MERGED])

    return stage(filters.groupBy("n", "bucket").applyInArrow(
        base.tidy(run), "chunk long, bucket int, frequent binary, a long, b long, c long, d long, f long"), name)


def counted(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (``lang, word, f, id``), word totals (``lang, total``) and frequent n-grams
    (``a, b, c, d, f``) of ``lang`` and ``text``."""
    n_bytes = base.text_bytes(docs)
    n_buckets = base.buckets(n_bytes, 4 * base.chunk_bytes(n_bytes))
    shards = sharded(docs, n_bytes, n_buckets)
    known = vocabulary(shards, least, n_buckets)
    most = known.agg(F.max("id")).first()[0] or 1
    width = max(2, -(-most.bit_length() // 2) * 2)
    if width > 32:
        raise ValueError("more than 2^32 frequent words")
    tokens = shards.filter("part < 0").select("chunk", "tokens")
    answers = known.filter("ids IS NOT NULL").select("chunk", "part", "ids")

    def two(tokens: pa.Table, answers: pa.Table) -> pa.Table:
        ids = stream(tokens, answers)
        return emitted(tokens["chunk"].to_pylist(), pairs(ids, width).filters(n_buckets) if len(ids) else [])

    def more(tokens: pa.Table, answers: pa.Table) -> pa.Table:
        ids = stream(tokens, answers)
        if not len(ids):
            return emitted([], [])
        known = pairs(ids, width)
        replies = answers.filter(answers["frequent"].is_valid()).sort_by("bucket")["frequent"].to_pylist()
        size = np.diff(np.append(starts_of_runs(b := bucketed(known.high, known.half, n_buckets)), len(b)))
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) > 0 for x, n in zip(replies, size, strict=True)]
        follows = known.where(np.concatenate([np.zeros(0, bool), *flags]), len(ids))
        out = []
        for n in range(3, LONGEST + 1):
            places = np.ones(max(len(ids) - n + 1, 0), bool)
            for i in range(n - 1):
                places &= follows[i:i + len(places)]
            out += Grams(ids, np.flatnonzero(places), n, width).filters(n_buckets)
        return emitted(tokens["chunk"].to_pylist(), out)

    by_chunk = tokens.groupBy("chunk")
    bigrams = merged(by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(base.tidy(two), FILTERS), width, least, "pairs")
    both = answers.withColumns({"bucket": F.lit(None).cast("int"), "frequent": F.lit(None).cast("binary")}).unionByName(
        bigrams.filter("chunk IS NOT NULL").select(
            "chunk", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("ids"), "bucket", "frequent"))
    longer = merged(by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(base.tidy(more), FILTERS), width, least, "longer")
    grams = bigrams.filter("a IS NOT NULL").unionByName(longer.filter("a IS NOT NULL")).select("a", "b", "c", "d", "f")
    totals = known.filter("total IS NOT NULL").groupBy("lang").agg(F.sum("total").alias("total"))
    return known.filter("word IS NOT NULL").select("lang", "word", "f", "id"), totals, grams


# Scores

KEY = ["a", "b", "c", "d"]
#: Parts of phrases of 2, 3 and 4 words: side, first word, last word. Sides l and r are those of a cut.
PARTS = {n: [("l", 0, k) for k in range(1, n)] + [("r", k, n) for k in range(1, n)]
         + [("m", i, j) for i in range(1, n) for j in range(i + 2, n)] for n in range(2, LONGEST + 1)}


def scored(words_: DataFrame, grams: DataFrame) -> DataFrame:
    """``lang, a, b, c, d, f, l, r, score`` of the phrases that no longer one takes over."""
    zero = F.lit(0).cast("long")
    n = F.lit(2) + (F.col("c") > 0).cast("int") + (F.col("d") > 0).cast("int")

    def part(side: str, lo: int, hi: int) -> Column:
        ids = [F.col(KEY[lo + i]) if lo + i < hi else zero for i in range(LONGEST)]
        return F.struct(F.lit(f"{side}{hi - lo}").alias("side"), *(x.alias(f"p{k}") for x, k in zip(ids, KEY, strict=True)))

    every = F.when(n == 2, F.array(*(part(*p) for p in PARTS[2]))).when(
        n == 3, F.array(*(part(*p) for p in PARTS[3]))).otherwise(F.array(*(part(*p) for p in PARTS[4])))
    known = words_.select(F.col("id").alias("pa"), *(zero.alias(f"p{k}") for k in "bcd"), F.col("f").alias("of"), "lang")
    known = known.unionByName(grams.select(*(F.col(k).alias(f"p{k}") for k in KEY), F.col("f").alias("of"),
                                           F.lit(None).cast("string").alias("lang")))
    taken = grams.select(*KEY, "f", n.alias("n"), F.explode(every).alias("part")).select(*KEY, "f", "n", "part.*")
    taken = stage(taken.join(known, ["pa", "pb", "pc", "pd"]), "parts")
    gone = taken.filter((F.col("pb") > 0) & (F.lit(100).cast("decimal(20)") * F.col("f") >= F.lit(80).cast("decimal(20)") * F.col("of")))
    gone = gone.select(*(F.col(f"p{k}").alias(k) for k in KEY)).distinct()
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("of")))
    whole = taken.filter("side NOT LIKE 'm%'").groupBy(*KEY, "f", "n").agg(
        F.max("lang").alias("lang"), *(side(f"{s}{k}").alias(f"{s}{k}") for s in "lr" for k in range(1, LONGEST)))

    def cut(k: int) -> Column:
        def of(size: int) -> Column:
            left, right = F.col(f"l{k}"), F.col(f"r{size - k}")
            score = F.expr(f"cast(2000000 as decimal(20)) * f div (l{k} + r{size - k})")
            return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

        choice = F.when(F.col("n") == k + 1, of(k + 1))
        for size in range(k + 2, LONGEST + 1):
            choice = choice.when(F.col("n") == size, of(size))
        return choice

    lowest = F.array_min(F.array(*(cut(k) for k in range(1, LONGEST)))).alias("cut")
    return whole.join(gone, KEY, "left_anti").select("lang", *KEY, "f", lowest).select(
        "lang", *KEY, "f", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to 4 words of each language.

    Texts are lower-cased (A to Z) and cut into pieces at ``. , ; : ! ?`` and line ends, and those
    into words at blanks and tabs. ``a`` counts a phrase, ``l`` and ``r`` its two parts at the cut with
    the lowest score, floor(2000000 * a / (l + r)), ``n`` all words of the language. Phrases below
    ``least`` are left out, and those inside a longer one with at least 80 % of their occurrences.
    Order: score and ``a`` falling, then the phrase, by bytes.

    A null language is ``und``, a null text empty; every row counts, also repeated ones. Rows
    without words count nothing, and an empty table has no phrase. Keys and other columns do not
    matter. A shard holds whole texts, of any length.
    """
    base.ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words_, totals, grams = counted(docs, least)
    found = scored(words_, grams)
    # one number in the order of score and count; phrases are cut at its quantiles, so that no
    # task ranks all phrases of a language
    found = stage(found.withColumn("value", F.col("score") * (1 << 40) + F.least("f", F.lit((1 << 40) - 1))), "scored")
    steps = [i / 128 for i in range(1, 128)]
    cuts = found.groupBy("lang").agg(F.percentile_approx("value", steps, 2000).alias("cuts"))
    found = join_salted(found, cuts, "lang", "a").withColumn("range", F.size(F.filter("cuts", lambda x: x > F.col("value")))).drop("cuts")
    earlier = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("lang", "range").agg(F.count("*").alias("size")).select(
        "lang", "range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    found = found.join(sizes.filter(F.col("before") < top), ["lang", "range"])
    spelled = found.select(*KEY, F.posexplode(F.array(*KEY)).alias("at", "id")).filter("id > 0").join(
        words_.select("id", "word"), "id").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    phrase = F.array_join(F.transform("words", lambda x: x["word"]), " ")
    inside = Window.partitionBy("lang", "range").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = found.join(spelled, KEY).withColumn("phrase", phrase).withColumn(
        "rank", F.col("before") + F.row_number().over(inside)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r",
        F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


def oracle() -> str:
    """The same in DuckDB, from a row for every n-gram of the corpus."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cuts = " UNION ALL ".join(f"""
            SELECT c.lang, c.w, {k} AS k, c.f AS a, p.f AS l, s.f AS r FROM candidates c
            JOIN counts p ON p.lang = c.lang AND p.w = c.w[:{k}] JOIN counts s ON s.lang = c.lang AND s.w = c.w[{k + 1}:]
            WHERE len(c.w) > {k}""" for k in range(1, LONGEST))
    inner = " UNION ALL ".join(f"""
            SELECT lang, w[{i}:{i + k - 1}] AS w, f FROM candidates WHERE len(w) >= {max(i + k - 1, k + 1)}"""
                               for k in range(2, LONGEST) for i in range(1, LONGEST - k + 2))
    return rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        lists AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
        grams AS (
            SELECT lang, words[i:i + n - 1] AS w
            FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM lists), (VALUES (1), (2), (3), (4)) AS t(n)
            WHERE i + n - 1 <= len(words)),
        counts AS MATERIALIZED (SELECT lang, w, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
        totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM lists GROUP BY lang),
        candidates AS MATERIALIZED (SELECT * FROM counts WHERE len(w) > 1),
        cuts AS ({cuts}),
        scored AS (SELECT *, (2000000::HUGEINT * a // (l + r))::BIGINT AS score FROM cuts),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
        inner_ AS (SELECT lang, w, max(f) AS f FROM ({inner}) GROUP BY ALL),
        kept AS (SELECT s.lang, array_to_string(s.w, ' ') AS phrase, s.a, s.l, s.r, s.score FROM lowest s
                 LEFT JOIN inner_ i ON i.lang = s.lang AND i.w = s.w AND 100::HUGEINT * i.f >= 80::HUGEINT * s.a
                 WHERE i.w IS NULL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""
