"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a sequence of symbols: its words, where a run without white space that is too long
for a word counts as its characters. Of all runs of ``k`` symbols those are chosen whose least
symbol hash is at their first or last place. Both choices depend on nothing outside the run, so
an edit moves only the anchors it touches. The fingerprint holds the distinct hashes of the
chosen runs (of the single symbols where none is chosen, as in the shortest texts): all of them,
then with their places, or the ``size`` least. The likeness of two fingerprints is the
share of common hashes among all of both, or among the ``size`` least of both together, an
estimate of the former.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.staging import stage

NULL_KEY = (1 << 63) - 1
#: A run of more characters than this without white space counts as its characters.
UNSPACED = 24
SPACE = "\x20\x09\x0A\x0B\x0C\x0D"
BETWEEN = r"[\x20\x09-\x0D]+"


def long(run: Column) -> Column:
    return F.char_length(run) > UNSPACED


def symbols(text: Column, words: Column) -> Column:
    """``words`` with the long runs cut; white space that ends the text stays with a run that is cut."""
    body = F.rtrim(text, F.lit(SPACE))
    runs = F.split(body, BETWEEN)
    end = F.substring(text, F.char_length(body) + 1, F.char_length(text))
    apart = lambda x: F.when(long(x), F.split(x, "")).otherwise(F.array(x))
    after = F.when(end == "", F.array().cast("array<string>")).when(
        long(F.element_at(runs, -1)), F.split(end, "")).otherwise(F.array(F.lit("")))
    return F.when(F.exists(words, long), F.concat(F.flatten(F.transform(runs, apart)), after)).otherwise(words)


def placed(hash_: Column, place: Column) -> Column:
    """A hash and a place as one number that sorts by hash, then place."""
    return F.shiftleft(hash_.cast("long"), 32).bitwiseOR(place.cast("long"))


def anchors(hashes: Column, k: int) -> Column:
    """Closed syncmers of a sequence of symbol hashes by hash and place; none in the shortest."""
    def closed(i: Column) -> Column:
        inner = [F.get(hashes, i + j) for j in range(1, k - 1)]
        least = F.least(*inner) if len(inner) > 1 else inner[0]
        return least >= F.least(F.get(hashes, i), F.get(hashes, i + k - 1))

    starts = F.when(F.size(hashes) >= k, F.sequence(F.lit(0), F.size(hashes) - k)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(F.filter(starts, closed),
                       lambda i: placed(F.hash(*(F.get(hashes, i + j) for j in range(k))), i))


def with_sketch(df: DataFrame, text: str, to: str, k: int, size: int | None) -> DataFrame:
    """Adds ``to``, the distinct anchor hashes in ascending order (the least ``size``), and
    ``to_places``, every anchor as ``placed``; none for an empty text."""
    df = df.withColumn("_w", F.split(text, BETWEEN))
    df = df.withColumn("_h", F.transform(symbols(F.col(text), F.col("_w")), lambda w: F.hash(w)))
    df = df.withColumn("_a", anchors(F.col("_h"), k))
    found = F.when(F.size("_a") > 0, F.col("_a")).otherwise(F.transform("_h", placed))
    none = F.array().cast("array<long>")
    df = df.withColumn(f"{to}_places", F.when(F.col(text) == "", none).otherwise(F.sort_array(found)))
    least = F.array_distinct(F.transform(f"{to}_places", lambda x: F.shiftright(x, 32).cast("int")))
    return df.withColumn(to, least if size is None else F.slice(least, 1, size)).drop("_w", "_h", "_a")


def fingerprint(sketch: str) -> Column:
    """The sketch as hexadecimal text, eight digits an anchor."""
    digits = F.transform(sketch, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.lower(F.array_join(digits, ""))


def likeness(a: str, b: str, size: int | None) -> Column:
    """0 to 1; two empty sketches are alike, an empty one and another are not."""
    if size is None:
        common = F.size(F.array_intersect(a, b))
        together = F.size(a) + F.size(b) - common
    else:
        least = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
        common = F.size(F.array_intersect(F.array_intersect(a, b), least))
        together = F.size(least)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        common / F.greatest(together, F.lit(1)))


def successors(ids: DataFrame) -> DataFrame:
    """``key, mark, n_chars, next_key, next_mark``: the row that follows each in order of key and mark.

    The rows are dealt to ranges, numbered inside them, and the last of a range meets the first
    of the next one that has rows; the very last meets the very first. Only one row per range
    goes through a single task.
    """
    ranged = ids.repartitionByRange("key", "mark").withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    order = Window.partitionBy("part").orderBy("key", "mark")
    after = F.struct(F.lead("key").over(order).alias("key"), F.lead("mark").over(order).alias("mark"))
    inside = ranged.withColumn("after", after)
    heads = ranged.groupBy("part").agg(F.min(F.struct("key", "mark")).alias("head"))
    chain = Window.orderBy("part")
    heads = heads.withColumn("following", F.coalesce(
        F.lead("head").over(chain), F.first("head").over(chain))).select("part", "following")
    joined = inside.join(stage(heads, "heads"), "part")
    last = F.col("after.key").isNull()
    return joined.select(
        "key", "mark", "n_chars",
        F.when(last, F.col("following.key")).otherwise(F.col("after.key")).alias("next_key"),
        F.when(last, F.col("following.mark")).otherwise(F.col("after.mark")).alias("next_mark"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4,
                 size: int | None = 64) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Without a ``size`` fingerprints and likeness are those of all anchors, and ``anchors`` and
    ``edited_anchors`` follow: each anchor's hash in the upper and the number of its first symbol
    in the lower 32 bits, in ascending order.

    The edited text has the last quarter of the characters replaced by as many from the start
    of the next document in order of the key (after the last, the first). A null text counts
    as empty; a null key comes last. Rows that repeat a key are ordered by a hash of their
    text; rows that repeat both are one document in that order and get a row each.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"),
                       F.xxhash64(body).alias("mark"), body.alias("text"))
    ids = rows.select("key", "mark", F.char_length("text").cast("long").alias("n_chars"))
    ids = stage(ids, "ids")
    unique = ids.dropDuplicates(["key", "mark"])
    repeats = unique.count() < ids.count()
    links = stage(successors(unique), "successors")

    tail = F.floor(F.col("n_chars") / 4).cast("int")
    to_next = links.select("key", "mark", "n_chars", "next_key", "next_mark").withColumnsRenamed(
        {"key": "own_key", "mark": "own_mark", "next_key": "key", "next_mark": "mark"})
    following = rows.join(to_next, ["key", "mark"])
    if repeats:
        following = following.dropDuplicates(["own_key", "own_mark"])
    following = with_sketch(following, "text", "next_sketch", k, size).select(
        F.col("own_key").alias("key"), F.col("own_mark").alias("mark"), "n_chars", "next_sketch",
        F.left("text", tail).alias("start"))
    both = rows.join(following, ["key", "mark"])
    # cut off only where something is replaced: left(text, n) of the whole length is the text
    edited = F.concat(F.left("text", (F.col("n_chars") - tail).cast("int")), F.col("start"))
    both = with_sketch(both.withColumn("edited", edited), "text", "own", k, size)
    both = with_sketch(both, "edited", "changed", k, size)
    places = [] if size else [F.col("own_places").alias("anchors"), F.col("changed_places").alias("edited_anchors")]
    return both.select(
        F.expr(f"nullif(key, {NULL_KEY}L)").alias("doc_id"), "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"),
        likeness("own", "changed", size).alias("near_edited"),
        likeness("own", "next_sketch", size).alias("near_next"), *places)
