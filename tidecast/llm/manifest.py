"""A Merkle manifest of a table: leaf digests, a tree per group, a root, and proofs that are checked.

Leaves of a group ascend by key, but rows are never sorted. Tasks build compressed bitmaps of
the keys they see, one container for every 4,096 keys; containers of a group are merged, get
a directory of popcounts, and their sizes are summed up in steps of 65,536 containers. A
row's place in its group is then a rank query: the sizes before its container, the directory
entry, and the bits below its own. Places address slot arrays of 4,096 nodes, each of which
reduces four levels of the tree at once; paths come down the same way.

Rows that share a key stand in the order of their leaves; equal leaves are interchangeable.
They are rare, and are ranked by the digest's first 16 bits, then within those.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.llm import base
from tidecast.staging import stage

FAN = 8
STEPS = 4
BLOCK = FAN**STEPS
LOW = 12
SPAN = 1 << LOW
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PLACE = ["grp", "absent", "high"]


def serial(c: Column) -> Column:
    """A value as its byte count, a colon and its text; null as a dash."""
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(serial, values)).cast("binary"), 256))


def leaves(docs: DataFrame, fields: tuple[str, ...], key: str, group: str, tampered: Column,
           tampering: dict[str, Column]) -> DataFrame:
    """``grp`` (sorts as the group does, nulls first), ``absent`` (no key), ``doc_id``, ``leaf``
    and ``forged``, the leaf of a tampered row."""
    g, k = F.col(group).cast("string"), F.col(key).cast("long")
    return docs.select(
        F.when(g.isNull(), "-").otherwise(F.concat(F.lit("="), g)).alias("grp"),
        k.isNull().alias("absent"), F.coalesce(k, F.lit(0)).alias("doc_id"),
        leaf([F.col(f) for f in fields]).alias("leaf"),
        F.when(tampered, leaf([tampering.get(f, F.col(f)) for f in fields])).alias("forged"))


def pack(low: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes | None]:
    """A container: few numbers as a list, many as a bitmap; repeated ones once more, with their counts.

    A list is always shorter than a bitmap: its length tells which of them it is.
    """
    if len(low) < SPAN // 16:
        bits = low.astype(np.uint16).tobytes()
    else:
        flags = np.zeros(SPAN, bool)
        flags[low] = True
        bits = np.packbits(flags, bitorder="little").tobytes()
    more = count > 1
    return bits, np.concatenate([low[more], count[more]]).astype(np.int64).tobytes() if more.any() else None


def unpack(bits: bytes, more: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a container, ascending, and how often each occurs."""
    if len(bits) == SPAN // 8:
        low = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    else:
        low = np.frombuffer(bits, np.uint16).astype(np.int64)
    count = np.ones(len(low), np.int64)
    if more:
        which, times = np.frombuffer(more, np.int64).reshape(2, -1)
        count[np.searchsorted(low, which)] = times
    return low, count


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of the keys of each batch."""
    for batch in batches:
        code = batch["grp"].dictionary_encode()
        keys = np.stack([code.indices.to_numpy(), batch["absent"].to_numpy(zero_copy_only=False),
                         batch["doc_id"].to_numpy()]).astype(np.int64)
        keys, count = np.unique(keys, axis=1, return_counts=True)
        place = np.concatenate([keys[:2], keys[2:] >> LOW])
        first = np.flatnonzero(np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(axis=0)])[:place.shape[1]])
        packed = [pack(low, n) for low, n in zip(np.split(keys[2] & (SPAN - 1), first[1:]),
                                                 np.split(count, first[1:]), strict=True)] if len(first) else []
        yield pa.RecordBatch.from_pydict({
            "grp": code.dictionary.take(pa.array(place[0, first])), "absent": pa.array(place[1, first] > 0),
            "high": pa.array(place[2, first]), "bits": pa.array([x[0] for x in packed], pa.binary()),
            "more": pa.array([x[1] for x in packed], pa.binary())})


def merge(key: tuple, table: pa.Table) -> pa.Table:
    """One container of all tasks' containers, with its size and its directory: set bits before each word."""
    total = np.zeros(SPAN, np.int64)
    for bits, more in zip(table["bits"].to_pylist(), table["more"].to_pylist(), strict=True):
        low, count = unpack(bits, more)
        total[low] += count
    low = np.flatnonzero(total)
    bits, more = pack(low, total[low])
    directory = np.concatenate([[0], np.cumsum((total > 0).reshape(-1, 64).sum(axis=1))[:-1]])
    return pa.Table.from_pydict({
        **{name: pa.array([x.as_py()]) for name, x in zip(PLACE, key, strict=True)},
        "n": pa.array([int(total.sum())]), "bits": pa.array([bits], pa.binary()), "more": pa.array([more], pa.binary()),
        "directory": pa.array([directory.astype(np.uint16).tobytes()], pa.binary())})


def rank(low: np.ndarray, bits: bytes, more: bytes | None, directory: bytes) -> np.ndarray:
    """How many rows of a container have smaller numbers."""
    if len(bits) == SPAN // 8:
        words = np.frombuffer(bits, np.uint64)
        below = words[low >> 6] & ((np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1))
        n = np.frombuffer(directory, np.uint16)[low >> 6].astype(np.int64) + np.bitwise_count(below)
    else:
        n = np.searchsorted(np.frombuffer(bits, np.uint16), low)
    if more:
        which, times = np.frombuffer(more, np.int64).reshape(2, -1)
        n = n + np.concatenate([[0], np.cumsum(times - 1)])[np.searchsorted(which, low)]
    return n.astype(np.int64)


def index(rows: DataFrame) -> DataFrame:
    """The containers of all groups, with ``first`` (rows of the group before them) and ``total``."""
    found = rows.select("grp", "absent", "doc_id").mapInArrow(
        base.tidy(bitmaps), "grp string, absent boolean, high long, bits binary, more binary")
    found = stage(found.groupBy(*PLACE).applyInArrow(
        base.tidy(merge), "grp string, absent boolean, high long, n long, bits binary, more binary, directory binary"),
        "containers")
    out = found.withColumn("first", F.lit(0).cast("long"))
    # every step sums the sizes of at most 65,536 neighbours (twice as many at the top, with and without key)
    for shift in (0, 16, 32, 48):
        at = F.expr(f"shiftright(high, {shift})").alias("at")
        sizes = found.groupBy("grp", "absent", at).agg(F.sum("n").alias("n"))
        near = ["grp", "absent", F.expr("shiftright(at, 16)")] if shift < 48 else ["grp"]
        earlier = Window.partitionBy(*near).orderBy("absent", "at").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("grp", "absent", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        out = out.withColumn("at", at).join(sizes, ["grp", "absent", "at"]).withColumn(
            "first", F.col("first") + F.col("before")).drop("at", "before")
    return stage(out.join(found.groupBy("grp").agg(F.sum("n").alias("total")), "grp"), "index")


def crowded(containers: DataFrame) -> DataFrame:
    """Keys that more than one row of a group has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = [np.frombuffer(x, np.int64).reshape(2, -1)[0] for x in batch["more"].to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in which])
            low = np.concatenate([np.zeros(0, np.int64), *which])
            yield pa.RecordBatch.from_pydict({
                "grp": batch["grp"].take(pa.array(at)), "absent": batch["absent"].take(pa.array(at)),
                "doc_id": pa.array((batch["high"].to_numpy()[at] << LOW) + low)})

    return containers.filter(F.col("more").isNotNull()).select("grp", "absent", "high", "more").mapInArrow(
        base.tidy(run), "grp string, absent boolean, doc_id long")


NODE = "grp string, n long, position long, digest binary"
LOCATED = f"{NODE}, absent boolean, doc_id long, forged binary"


def located(rows: DataFrame, containers: DataFrame) -> DataFrame:
    """Rows with the number of rows in their group that have a smaller key, from the containers."""

    def run(rows: pa.Table, container: pa.Table) -> pa.Table:
        low = rows["doc_id"].to_numpy() & (SPAN - 1)
        c = container.to_pylist()[0] if rows.num_rows else {"total": 0, "first": 0}
        place = c["first"] + rank(low, c["bits"], c["more"], c["directory"]) if rows.num_rows else low
        return pa.Table.from_pydict({
            "grp": rows["grp"], "n": pa.array(np.full(len(low), c["total"], np.int64)), "position": pa.array(place),
            "digest": rows["leaf"], "absent": rows["absent"], "doc_id": rows["doc_id"], "forged": rows["forged"]})

    high = F.expr(f"shiftright(doc_id, {LOW})").alias("high")
    return rows.select("*", high).groupBy(*PLACE).cogroup(containers.groupBy(*PLACE)).applyInArrow(base.tidy(run), LOCATED)


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Every row with its place among the leaves of its group; the size of the largest group."""
    containers = index(rows)
    most = containers.agg(F.max("total")).first()[0] or 0
    key = ["grp", "absent", "doc_id"]
    shared = stage(crowded(containers), "crowded")
    if shared.isEmpty():
        return stage(located(rows, containers), "places"), most
    marked = rows.join(shared.withColumn("shared", F.lit(True)), key, "left")
    nothing = F.lit(None).cast("binary")
    asked = marked.filter("shared IS NULL").drop("shared").unionByName(
        shared.withColumns({"leaf": nothing, "forged": nothing}))
    got = stage(located(asked, containers), "places")
    copies = marked.filter("shared").groupBy(*key, "leaf", "forged").agg(F.count("*").alias("copies")).withColumn(
        "near", F.substring(F.hex("leaf"), 1, 4))
    earlier = lambda *by: Window.partitionBy(*key, *by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("copies").over(w), F.lit(0))
    runs = copies.groupBy(*key, "near").agg(F.sum("copies").alias("copies")).select(
        *key, "near", before(earlier().orderBy("near")).alias("ahead"))
    copies = copies.withColumn("within", before(earlier("near").orderBy("leaf"))).join(runs, [*key, "near"])
    first = got.filter("digest IS NULL").select(*key, "n", F.col("position").alias("first"))
    copies = stage(copies.join(first, key), "copies")
    each = base.repeated(copies, "copies", index="copy").select(
        "grp", "n", (F.col("first") + F.col("ahead") + F.col("within") + F.col("copy")).alias("position"),
        F.col("leaf").alias("digest"), "absent", "doc_id", "forged")
    return stage(got.filter("digest IS NOT NULL").unionByName(each), "leaves"), most


def steps(n: int) -> int:
    """Levels above n nodes, of those that one block has at most."""
    levels = 0
    while n > 1 and levels < STEPS:
        n, levels = -(-n // FAN), levels + 1
    return levels


def reduced(slots: bytes, levels: int) -> list[bytes]:
    """All levels of a block, as joined digests, its nodes first."""
    out, run = [slots], FAN * DIGEST
    for _ in range(levels):
        below = out[-1]
        out.append(b"".join(sha256(below[i:i + run].hex().encode()).digest() for i in range(0, len(below), run)))
    return out


def slots(nodes: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Slot of each node in its block, and the levels of the block."""
    slot = nodes["position"].to_numpy() % BLOCK
    digests = np.zeros((len(slot), DIGEST), np.uint8)
    digests[slot] = np.frombuffer(b"".join(nodes["digest"].to_pylist()), np.uint8).reshape(-1, DIGEST)
    return slot, reduced(digests.tobytes(), steps(nodes["n"][0].as_py()))


def path(slot: int, levels: list[bytes]) -> list[tuple[int, bytes]]:
    """Slot within its run and the run's digests, level by level below the top of a block."""
    out, run = [], FAN * DIGEST
    for level in levels[:-1]:
        at = slot // FAN
        out.append((slot % FAN, level[at * run:(at + 1) * run]))
        slot = at
    return out


def folded(nodes: DataFrame) -> DataFrame:
    """One node for each block of 4,096."""

    def run(nodes: pa.Table) -> pa.Table:
        n = nodes["n"][0].as_py()
        return pa.Table.from_pydict({
            "grp": nodes["grp"][:1], "n": pa.array([-(-n // BLOCK)]),
            "position": pa.array([nodes["position"][0].as_py() // BLOCK]),
            "digest": pa.array([slots(nodes)[1][-1]], pa.binary())})

    return blocks(nodes.select("grp", "n", "position", "digest")).applyInArrow(base.tidy(run), NODE)


def blocks(nodes: DataFrame):  # noqa: ANN201
    return nodes.groupBy("grp", F.expr(f"position div {BLOCK}").alias("block"))


def climbed(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes, those of their blocks, and so on up to one node for each group."""
    out = [nodes]
    while most > 1:
        out.append(stage(folded(out[-1]), "nodes"))
        most = -(-most // BLOCK)
    return out


ABOVE = "grp string, position long, above binary, subroot binary, root binary"


def descended(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The way from each node to the root, ``above`` having that of its block."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return above.slice(0, 0).select(["grp", "position", "above", "subroot", "root"])
        slot, levels = slots(nodes)
        a = above.to_pylist()[0]
        ways = [b"".join(bytes([at, len(r) // DIGEST]) + r for at, r in path(s, levels)) + a["above"] for s in slot.tolist()]
        n = nodes.num_rows
        return pa.Table.from_pydict({
            "grp": nodes["grp"], "position": nodes["position"], "above": pa.array(ways, pa.binary()),
            "subroot": pa.array([a["subroot"]] * n, pa.binary()), "root": pa.array([a["root"]] * n, pa.binary())})

    return blocks(nodes.select("grp", "n", "position", "digest")).cogroup(of_block(above)).applyInArrow(base.tidy(run), ABOVE)


def of_block(above: DataFrame):  # noqa: ANN201
    return above.groupBy("grp", F.col("position").alias("block"))


def ways(packed: bytes) -> list[tuple[int, bytes]]:
    """The levels of a way, as ``path`` has them."""
    out, at = [], 0
    while at < len(packed):
        end = at + 2 + packed[at + 1] * DIGEST
        out.append((packed[at], packed[at + 2:end]))
        at = end
    return out


def siblings(way: list[tuple[int, bytes]]) -> bytes:
    return b"".join(r[:at * DIGEST] + r[(at + 1) * DIGEST:] for at, r in way)


def refolded(digest: bytes, way: list[tuple[int, bytes]]) -> bytes:
    """The root that follows from a leaf and the original siblings."""
    for at, r in way:
        digest = sha256((r[:at * DIGEST] + digest + r[(at + 1) * DIGEST:]).hex().encode()).digest()
    return digest


PROVEN = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def proven(rows: DataFrame, above: DataFrame) -> DataFrame:
    """The leaves' proofs, and the roots that their original or tampered leaves lead to."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            slot, levels = slots(rows)
            a = above.to_pylist()[0]
            upper = ways(a["above"])
            rest = siblings(upper)
            for s, digest, forged in zip(slot.tolist(), rows["digest"].to_pylist(), rows["forged"].to_pylist(), strict=True):
                own = path(s, levels)
                proof = sha256((siblings(own) + rest).hex().encode()).hexdigest()
                root = refolded(digest if forged is None else forged, own + upper)
                out.append((digest.hex(), a["subroot"].hex(), a["root"].hex(), proof, root.hex(), root == a["root"]))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        doc = pa.array(rows["doc_id"].to_numpy(), mask=rows["absent"].to_numpy().astype(bool))
        return pa.Table.from_arrays([doc, *(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.bool_())],
                                    names=[x.split()[0] for x in PROVEN.split(", ")])

    return blocks(rows).cogroup(of_block(above)).applyInArrow(base.tidy(run), PROVEN)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang",
             tampered: Column | None = None, tampering: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    A leaf is the digest of the ``fields``; in each group (null is one) leaves ascend by key, and every
    eight nodes become one until one is left, the subroot; subroots, ordered by group with null
    first, become the root likewise. ``tampered`` rows are checked with the values of
    ``tampering`` against the proof of the original ones: ``verified`` says whether the root follows.

    Rows without key stand behind all others of their group, rows that share a key in the order of
    their leaves; equal rows are leaves of their own. A null field differs from an empty one. An
    empty table has no row. Columns that are no fields do not matter. Groups themselves are
    numbered in one task, by one row each.
    """
    base.ship(docs.sparkSession)
    never = F.lit(False)
    rows = stage(leaves(docs, fields, key, group, never if tampered is None else tampered, tampering or {}), "digests")
    rows, most = placed(rows)
    trees = climbed(rows, most)
    everything = Window.orderBy("grp")
    top = trees[-1].filter("position = 0").select(
        F.col("grp").alias("name"), "digest", F.lit("").alias("grp"),
        (F.row_number().over(everything) - 1).cast("long").alias("position"))
    top = stage(top.withColumn("n", F.count("*").over(Window.partitionBy("grp"))), "subroots")
    upper = climbed(top, top.agg(F.max("n")).first()[0] or 0)
    nothing = F.lit(b"")
    above = upper[-1].select("grp", "position", nothing.alias("above"), nothing.alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper[:-1]):
        above = descended(nodes, above)
    above = stage(above, "above")
    names = top.select("name", "position", "digest")
    above = above.join(names, "position").select(
        F.col("name").alias("grp"), F.lit(0).cast("long").alias("position"), "above", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(trees[1:-1]):
        above = stage(descended(nodes, above), "above")
    return proven(rows, above)


def tampered_third(key: str = "doc_id") -> Column:
    """Rows whose key's checksum three divides."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def lowered(text: str = "text") -> Column:
    """The text with A to Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def oracle() -> str:
    """The same in DuckDB: numbered leaves, recursive levels, and proofs from joined runs."""
    serial = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(serial(c) for c in FIELDS[:-1])
    return f"""
        WITH RECURSIVE digests AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, lang, sha256({head} || {serial("text")}) AS leaf,
                   sha256({head} || {serial(lower)}) AS lowered,
                   xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''),
                           lambda c: ascii(c)::UBIGINT)),
                       lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT for i in range(8)]),
                           lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)),
                       4294967295::UBIGINT) AS crc
            FROM documents),
        leaves AS MATERIALIZED (
            SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf, r) - 1 AS pos,
                   count(*) OVER (PARTITION BY lang) AS n
            FROM digests),
        tree(g, level, pos, digest, n) AS (
            SELECT g, 0, pos, leaf, n FROM leaves
            UNION ALL
            SELECT g, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8
            FROM tree WHERE n > 1 GROUP BY g, level, pos // 8),
        lower_tree AS MATERIALIZED (SELECT * FROM tree),
        subroots AS MATERIALIZED (SELECT g, digest AS subroot, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
        crown(level, pos, digest, n) AS (
            SELECT 0, g, subroot, n FROM subroots
            UNION ALL
            SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8
            FROM crown WHERE n > 1 GROUP BY level, pos // 8),
        upper_tree AS MATERIALIZED (SELECT * FROM crown),
        runs AS MATERIALIZED (
            SELECT g, level, pos, digest FROM lower_tree WHERE n > 1
            UNION ALL SELECT s.g, 1000 + u.level, u.pos, u.digest FROM subroots s, upper_tree u WHERE u.n > 1),
        way AS MATERIALIZED (
            SELECT l.r, t.level, t.pos, t.digest,
                   CASE WHEN t.level < 1000 THEN l.pos // (8 ** t.level)::BIGINT
                        ELSE l.g // (8 ** (t.level - 1000))::BIGINT END AS own
            FROM leaves l JOIN runs t ON t.g = l.g AND t.pos // 8 =
                (CASE WHEN t.level < 1000 THEN l.pos // (8 ** t.level)::BIGINT
                      ELSE l.g // (8 ** (t.level - 1000))::BIGINT END) // 8),
        proofs AS (SELECT r, string_agg(digest, '' ORDER BY level, pos) AS siblings FROM way WHERE pos <> own GROUP BY r),
        numbered AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY r ORDER BY level) AS step FROM way),
        refold(r, step, digest) AS (
            SELECT r, 0, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END FROM leaves
            UNION ALL
            SELECT f.r, any_value(f.step) + 1,
                   sha256(string_agg(CASE WHEN w.pos = w.own THEN f.digest ELSE w.digest END, '' ORDER BY w.pos))
            FROM refold f JOIN numbered w ON w.r = f.r AND w.step = f.step + 1 GROUP BY f.r),
        last AS (SELECT r, arg_max(digest, step) AS folded_root FROM refold GROUP BY r)
        SELECT l.doc_id, l.leaf, s.subroot, u.digest AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
               f.folded_root, f.folded_root = u.digest AS verified
        FROM leaves l JOIN subroots s USING (g) JOIN last f USING (r) LEFT JOIN proofs p USING (r),
             upper_tree u WHERE u.n = 1"""
