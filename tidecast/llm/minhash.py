"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document becomes the set of its word shingles (64-bit hashes), a digest of that set and
   a signature of minimum hashes. Equal sets form a class and go on as one.
2. The signature is cut into bands; classes with an equal band are candidates. Each member
   of such a group is paired with the group's smallest member only.
3. A pair's signatures are compared batch by batch. After each, the posterior of the similarity
   (uniform prior) given the matches so far says how likely it is to reach the threshold; below
   ``miss`` the pair is dropped. Survivors are verified on their full shingle sets.
4. Confirmed links are joined into components. Groups that still hold several components are
   looked at again, whole: blocks of members are compared with blocks in the same two
   steps, pairs of one component left out. After that every candidate pair has been compared
   or lies within one component, so no link is lost to the pairing in 2.

Links, components and signatures stay in tables; nothing of them reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm import base
from tidecast.llm.columnar import (
    combine, hashes, mix, parts, slices, starts_of_runs, texts, words,
)
from tidecast.staging import stage

BLOCK = 256
#: Text whose shingles are hashed at once: they stay in the processor's cache.
SLICE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash), in that order.

    A shingle is ``size`` consecutive words; fewer words are one shingle, no words none.
    """
    n = len(offsets) - 1
    data = lower_ascii(data)
    start, end, doc = words(data, offsets)
    h = hashes(data, start, end)
    count = np.bincount(doc, minlength=n)
    key = h
    for k in range(1, size):
        key = combine(key[:len(h) - k], h[k:]) if len(h) > k else np.zeros(0, np.uint64)
    whole = doc[:len(key)] == doc[size - 1:] if len(key) else np.zeros(0, bool)
    out_doc, out_key = [doc[:len(key)][whole]], [key[whole]]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(doc, short)
        key = mix(count[short].astype(np.uint64))
        for k in range(size - 1):
            there = count[short] > k
            at = np.minimum(first + k, len(h) - 1)
            key = np.where(there, combine(key, h[at]), key)
        out_doc.append(short)
        out_key.append(key)
    doc, key = np.concatenate(out_doc), np.concatenate(out_key)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    if len(doc):
        first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
        doc, key = doc[first], key[first]
    return doc, key


def signatures(doc: np.ndarray, key: np.ndarray, n: int, size: int) -> np.ndarray:
    """(documents x size) minimum hashes; documents without shingles have the largest number."""
    out = np.full((n, size), np.uint32(0xFFFFFFFF))
    first = starts_of_runs(doc)
    if len(first):
        of = doc[first]
        for k in range(size):
            h = (key ^ np.uint64(mix(np.array([k + 1], np.uint64) * _STEP)[0])) * _STEP
            h ^= h >> np.uint64(29)
            out[of, k] = np.minimum.reduceat(((h * _STEP) >> np.uint64(32)).astype(np.uint32), first)
    return out


def sketch(docs: DataFrame, words_per_shingle: int, size: int, bands: int) -> DataFrame:
    """``doc_id, mark, n_shingles, high, low`` (digest of the set)``, signature, bands`` of every text."""
    rows = size // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in parts(batch["text"], SLICE):
                n = len(offsets) - 1
                doc, key = shingles(data, offsets, words_per_shingle)
                count = np.bincount(doc, minlength=n)
                digest = []
                for salt in (1, 2):
                    total = np.zeros(len(key) + 1, np.uint64)
                    np.cumsum(mix(key + np.uint64(salt)), out=total[1:])
                    edge = np.concatenate(([0], np.cumsum(count)))
                    digest.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
                sig = signatures(doc, key, n, size)
                band = [combine(*(sig[:, b * rows + r] for r in range(rows)), np.full(n, b)) for b in range(bands)]
                flat = np.column_stack(band).astype(np.uint64).view(np.int64).ravel()
                edges = np.arange(0, len(flat) + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"].slice(lo, n), "mark": batch["mark"].slice(lo, n), "n_shingles": count.astype(np.int64),
                    "high": digest[0], "low": digest[1],
                    "signature": pa.array([r.tobytes() for r in sig], pa.binary()),
                    "bands": pa.ListArray.from_arrays(edges, flat)})

    return docs.mapInArrow(base.tidy(run), "doc_id long, mark long, n_shingles long, high long, low long, "
                                "signature binary, bands array<long>")


def texts_of(nodes: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id`` (the node) and ``text`` of the chosen classes, a text for each.

    Repeated rows become one inside the tasks that read them, so a row with many copies
    arrives once per task.
    """
    chosen = firsts.join(nodes.distinct(), "node", "left_semi").select("node", "doc_id", "mark")
    once = docs.groupBy("doc_id", "mark").agg(F.first("text").alias("text"))
    return once.join(chosen, ["doc_id", "mark"]).select(F.col("node").alias("doc_id"), "text")


def prune_table(batch: int, size: int, threshold: float, miss: float) -> np.ndarray:
    """Fewest matches that keep a pair after each batch of signature values.

    With m of n equal, the similarity has a Beta(m + 1, n - m + 1) posterior; its upper tail
    beyond the threshold is the lower tail of a binomial of n + 1 draws at that probability.
    """
    from math import comb

    out = []
    for n in range(batch, size + 1, batch):
        tail, least = 0.0, n + 1
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                least = m
                break
        out.append(least)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray, batch: int) -> np.ndarray:
    """Indices of the pairs of signature rows that no batch rules out."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * batch, (k + 1) * batch)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= m]
    return alive


def _signatures_of(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, size)


def dealt(pairs: DataFrame, each: int = 512) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) with a ``salt`` for hot a, and ``a, salts`` for copying the rows of a.

    Salts are added while rows are two numbers wide, before texts or signatures join them.
    """
    salts = stage(pairs.groupBy("a").agg(F.ceil(F.count("*") / each).alias("salts")), "salts")
    salt = F.pmod(F.xxhash64("b"), F.col("salts"))
    return pairs.join(salts, "a").select("a", "b", salt.alias("salt")), salts


def with_both(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """``a, b, value_a, value_b``: the pairs with a column of ``rows`` (doc_id, column) for either side."""
    pairs, salts = dealt(pairs)
    b_side = rows.select(F.col("doc_id").alias("b"), F.col(column).alias("value_b"))
    a_side = rows.select(F.col("doc_id").alias("a"), F.col(column).alias("value_a")).join(salts, "a")
    a_side = a_side.select("a", "value_a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return pairs.join(b_side, "b").join(a_side, ["a", "salt"]).select("a", "b", "value_a", "value_b")


def likely(pairs: DataFrame, classes: DataFrame, size: int, least: np.ndarray, batch: int) -> DataFrame:
    """The pairs that sequential comparison of signatures keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            a, b = (_signatures_of(rows[x], size) for x in ("value_a", "value_b"))
            keep = pa.array(survivors(a, b, least, batch))
            yield pa.RecordBatch.from_arrays([rows["a"].take(keep), rows["b"].take(keep)], names=["a", "b"])

    return with_both(pairs, classes, "signature").mapInArrow(base.tidy(run), "a long, b long")


def similar(text_a: pa.Array, text_b: pa.Array, size: int, threshold: int) -> np.ndarray:
    """Whether the shingle sets of each row's two texts have 100 * common >= threshold * union."""
    (data_a, off_a), (data_b, off_b) = texts(text_a), texts(text_b)
    out = np.zeros(len(text_a), bool)
    for lo, hi in slices(off_a + off_b):
        n = hi - lo
        a, b = (shingles(d[o[lo]:o[hi]], o[lo:hi + 1] - o[lo], size) for d, o in ((data_a, off_a), (data_b, off_b)))
        common = np.isin(combine(a[1], a[0]), combine(b[1], b[0]))
        both = np.bincount(a[0][common], minlength=n)
        union = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n) - both
        out[lo:hi] = (union > 0) & (100 * both >= threshold * union)
    return out


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = pa.array(np.flatnonzero(similar(rows["value_a"], rows["value_b"], size, threshold)))
            yield pa.RecordBatch.from_arrays([rows["a"].take(keep), rows["b"].take(keep)], names=["a", "b"])

    return with_both(pairs, docs, "text").mapInArrow(base.tidy(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node that each node of the links (a, b) can reach.

    Each round takes the least label among the neighbours and then the label of that label, so
    rounds grow with the logarithm of a component's diameter in practice. Every round is
    written; only the number of changed labels comes back.
    """
    edges = stage(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = stage(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        near = edges.join(seen, "other").groupBy("node").agg(F.min("near").alias("near"))
        step = stage(labels.join(near, "node").select(
            "node", "label", F.least("label", "near").alias("next")), "step")
        up = step.select(F.col("node").alias("next"), F.col("next").alias("up"))
        jumped = stage(step.join(up, "next").select("node", "label", F.least("next", "up").alias("next")), "labels")
        changed = jumped.filter("label <> next").count()
        labels = jumped.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def links_between(ids: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, sig: np.ndarray,
                  doc: np.ndarray, key: np.ndarray, threshold: int, least: np.ndarray,
                  batch: int) -> list[tuple[int, int]]:
    """One confirmed link for each two components that rows ``left`` and ``right`` connect.

    Signatures are compared first; survivors are verified on their whole sets, given as (doc,
    key) in order of doc. Components joined on the way are not compared any further.
    """
    root = {int(x): int(x) for x in label}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    _, number = np.unique(key, return_inverse=True)
    edge = np.searchsorted(doc, np.arange(len(ids) + 1))
    size = np.diff(edge)
    seen = np.zeros(len(key) + 1, bool)
    out = []
    for x in left:
        now = np.array([find(int(v)) for v in label[right]])
        y = right[(now != find(int(label[x]))) & ((right > x) | (left is not right))]
        y = y[survivors(np.broadcast_to(sig[x], (len(y), sig.shape[1])), sig[y], least, batch)]
        if not len(y):
            continue
        mine = number[edge[x]:edge[x + 1]]
        seen[mine] = True
        common = np.array([np.count_nonzero(seen[number[edge[v]:edge[v + 1]]]) for v in y])
        seen[mine] = False
        for v in y[100 * common >= threshold * (size[x] + size[y] - common)]:
            r, q = find(int(label[x])), find(int(label[v]))
            if r != q:
                root[max(r, q)] = min(r, q)
                out.append((min(int(ids[x]), int(ids[v])), max(int(ids[x]), int(ids[v]))))
    return out


def remaining(bands: DataFrame, labels: DataFrame, classes: DataFrame, firsts: DataFrame, docs: DataFrame,
              words_per_shingle: int, threshold: int, size: int, least: np.ndarray, batch: int) -> DataFrame:
    """Confirmed links (a, b) among members of different components in groups that hold several.

    The members outside the component of the group's least label are compared with all
    others, block by block; groups of the same members are looked at once. Pairs are not rows:
    a block returns a link for each two components that it joins.
    """
    label = F.coalesce("label", "doc_id").alias("label")
    members = bands.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", label)
    members = stage(members, "members")
    mixed = members.groupBy("band").agg(
        F.min("label").alias("main"), F.max("label").alias("top"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("doc_id")).alias("who"), F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last")).filter("main < top")
    mixed = stage(mixed.groupBy("who", "n", "first", "last", "main").agg(F.min("band").alias("band")), "mixed")
    inside = members.join(mixed.select("band", "main"), "band").withColumn("outer", F.col("label") != F.col("main"))
    inside = stage(inside, "inside")
    blocks = inside.groupBy("band").agg(
        F.ceil(F.count_if("outer") / BLOCK).alias("outer_blocks"),
        F.ceil(F.count_if(~F.col("outer")) / BLOCK).alias("main_blocks"))
    inside = inside.join(stage(blocks, "blocks"), "band")
    own = F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.when(F.col("outer"), F.col("outer_blocks"))
                 .otherwise(F.col("main_blocks")))
    count = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    whole = inside.withColumn("own", own).select("band", "doc_id", "label", "outer", "own", F.explode(
        F.when(~F.col("outer"), F.transform(count("outer_blocks"), lambda i: F.struct(
            F.lit(0).alias("kind"), i.alias("i"), F.col("own").alias("j"))))
        .otherwise(F.concat(
            F.transform(count("main_blocks"), lambda j: F.struct(
                F.lit(0).alias("kind"), F.col("own").alias("i"), j.alias("j"))),
            F.transform(count("outer_blocks"), lambda j: F.struct(
                F.lit(1).alias("kind"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))))
    ).alias("task"))
    content = texts_of(inside.select(F.col("doc_id").alias("node")), firsts, docs)
    content = content.join(classes.select("doc_id", "signature"), "doc_id")
    rows = whole.join(stage(content, "content"), "doc_id")

    def compare(table: pa.Table) -> pa.Table:
        sig = _signatures_of(table["signature"], size)
        ids, label, outer, own = (table[c].to_numpy() for c in ("doc_id", "label", "outer", "own"))
        if table["kind"][0].as_py() == 0:
            left, right = np.flatnonzero(outer), np.flatnonzero(~outer)
        elif table["i"][0].as_py() == table["j"][0].as_py():
            left = right = np.arange(len(ids))
        else:
            left = np.flatnonzero(own == table["i"][0].as_py())
            right = np.flatnonzero(own == table["j"][0].as_py())
        doc, key = [], []
        for lo, data, offsets in parts(table["text"], SLICE):
            d, k = shingles(data, offsets, words_per_shingle)
            doc.append(d + lo)
            key.append(k)
        found = links_between(ids, label, left, right, sig, np.concatenate(doc), np.concatenate(key),
                              threshold, least, batch)
        return pa.Table.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()),
                                     "b": pa.array([b for _, b in found], pa.int64())})

    return (rows.select("band", "task.*", "doc_id", "label", "outer", "own", "signature", "text")
            .groupBy("band", "kind", "i", "j").applyInArrow(base.tidy(compare), "a long, b long").distinct())


def grouped(docs: DataFrame, by_key: bool, words_per_shingle: int, threshold: int, bands: int, rows: int, batch: int,
            miss: float) -> DataFrame:
    """Rows (doc_id, mark) with ``n_shingles`` and, if they have a key and words, the least row of
    their component, ``least.doc_id`` and ``least.mark``.

    Nodes of the graph are classes of equal sets, numbered in a written table, so a key that
    has several texts stands for none of them. ``by_key`` links the classes of such a key.
    """
    size = bands * rows
    least = prune_table(batch, size, threshold / 100, miss)
    sketches = stage(sketch(docs, words_per_shingle, size, bands), "sketches")
    sets = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = sets.groupBy("high", "low").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    firsts = stage(firsts.select(
        F.monotonically_increasing_id().alias("node"), "high", "low", "first.doc_id", "first.mark"), "firsts")
    # below, doc_id is a node
    classes = stage(sets.select("doc_id", "mark", "high", "low", "signature", "bands")
                    .join(firsts, ["doc_id", "mark", "high", "low"])
                    .select(F.col("node").alias("doc_id"), "signature", "bands").dropDuplicates(["doc_id"]), "classes")

    in_band = classes.select("doc_id", F.explode("bands").alias("band"))
    groups = stage(in_band.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
                   .filter("a < z").drop("z"), "groups")
    candidates = stage(in_band.join(groups, "band"), "candidates")
    pairs = candidates.filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    survivors_ = stage(likely(stage(pairs, "pairs"), classes, size, least, batch), "likely")
    either = survivors_.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = stage(texts_of(either, firsts, docs), "texts")
    links = stage(confirmed(survivors_, wanted, words_per_shingle, threshold), "links")

    shared = candidates.select("band", "doc_id").distinct()
    more = remaining(shared, components(links), classes, firsts, docs, words_per_shingle, threshold, size, least, batch)
    links = links.union(stage(more, "more"))
    member = stage(sketches.select("doc_id", "mark", "n_shingles", "high", "low")
                   .join(firsts.select("high", "low", "node"), ["high", "low"], "left"), "members")
    if by_key:
        several = member.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a")
        same = member.join(several, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
        links = links.union(stage(same.distinct(), "keys"))
    labels = firsts.join(components(links), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"), F.struct("doc_id", "mark").alias("row"))
    labels = stage(labels, "labels")
    least_of = labels.groupBy("label").agg(F.min("row").alias("least"))
    found = labels.join(least_of, "label").select("node", "least")
    linked = F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("least")
    return member.join(found, "node", "left").select("doc_id", "mark", "n_shingles", linked)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 5,
                    threshold: int = 80, bands: int = 28, rows: int = 4, batch: int = 16,
                    miss: float = 1e-6) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents with 100 * common >= threshold * union of their shingle sets are linked; the
    component's id is its least key, and that document is kept. At similarity 0.8, bands of
    4 x 28 miss a pair with probability 4e-7. Texts without words (null, empty) have no
    shingles and are their own component, unless their key has other texts: rows that repeat a
    key are one document with several texts, linked through any of them; ``n_shingles`` is the
    row's own. A row with a null key is linked with nothing and kept.
    """
    base.ship(docs.sparkSession)
    docs = marked(base.documents(docs, key, text))
    out = stage(grouped(docs, True, words_per_shingle, threshold, bands, rows, batch, miss), "grouped")
    # rows without words take the component of their key's other texts
    wordless = out.filter("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    others = out.filter("least IS NOT NULL").join(wordless, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min("least.doc_id").alias("other"))
    others = others.withColumn("n_shingles", F.lit(0).cast("long"))
    component = F.coalesce("least.doc_id", "other", "doc_id")
    return out.join(others, ["doc_id", "n_shingles"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def marked(docs: DataFrame) -> DataFrame:
    """With a checksum that tells the texts of a key apart."""
    return docs.withColumn("mark", F.xxhash64("text"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 5,
                 threshold: int = 80, bands: int = 28, rows: int = 4, batch: int = 16, miss: float = 1e-6) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all their columns.

    Here every row is a document of its own: of rows that are linked, the one with the least key
    stays, and no row goes for a text that only its key shares. Rows that repeat key and text
    are one. Texts without words and rows with a null key are linked with nothing and stay.
    """
    base.ship(docs.sparkSession)
    found = grouped(marked(base.documents(docs, key, text)), False, words_per_shingle, threshold, bands, rows, batch, miss)
    own = F.struct("doc_id", "mark")
    stay = found.filter(F.col("doc_id").isNotNull() & (F.col("least").isNull() | (F.col("least") == own))).select(
        "doc_id", "mark").distinct()
    rows_ = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"),
                        F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    once = rows_.filter("doc_id IS NOT NULL").groupBy("doc_id", "mark").agg(F.first("row").alias("row"))
    return once.join(stay, ["doc_id", "mark"], "left_semi").select("row.*").unionByName(
        rows_.filter("doc_id IS NULL").select("row.*"))
