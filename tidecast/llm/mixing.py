"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted by cell (source, language, topic). Raking scales the cells' token
weights so that each of the three marginals meets its target in turn, round after round; the
weights then become inclusion probabilities whose expected tokens are a given share of
the corpus, and a hash of the key decides each document. Only cells take part in the rounds.
No document is kept twice, so a given share may be too large for the targets: groups that are
wholly kept then stay below theirs. A plan without a share keeps as much as meets them all, and
``achieved`` tells how far a mixture came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.staging import stage

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
#: Cells up to this number are broadcast to the documents; they are a few hundred bytes each at most.
BROADCAST_CELLS = 50_000


@dataclass(frozen=True)
class Plan:
    """What a mixture should look like.

    ``topics``: a text has the first topic one of whose substrings its lower-cased form contains,
    else ``other``. ``temper``: a marginal's target is its share to this power, so values below 1
    raise small groups. ``share``: expected part of all tokens that is kept, whether or not the
    targets can be met with it; with None, the largest part that meets them. ``targets``: for a
    marginal, weights of its groups instead of ``temper``; groups without a weight are not kept.
    The SQL of ``oracle`` knows neither ``targets`` nor a share of None.
    """

    topics: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("legal", ("licens", "copyright")), ("contact", ("@",)),
        ("secrets", ("password", "token =")), ("tables", (" | ",)))
    other: str = "prose"
    temper: tuple[tuple[str, float], ...] = (("source", 0.9), ("lang", 0.9), ("topic", 0.9))
    share: float | None = 0.9
    rounds: int = 10
    capping: int = 8
    targets: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = ()


def topic_of(text: Column, plan: Plan) -> Column:
    low = F.lower(text)
    out = None
    for name, parts in plan.topics:
        found = F.lit(False)
        for p in parts:
            found = found | F.contains(low, F.lit(p))
        out = F.when(found, name) if out is None else out.when(found, name)
    return F.lit(plan.other) if out is None else F.coalesce(out.otherwise(plan.other), F.lit(plan.other))


def with_cell(docs: DataFrame, plan: Plan, text: str = "text", source: str = "source",
              lang: str = "lang") -> DataFrame:
    """Adds ``_source, _lang, _topic`` (nulls named) and ``_tokens``, the number of words."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    return docs.withColumns({
        "_source": named(source), "_lang": named(lang), "_topic": topic_of(body, plan),
        "_tokens": F.regexp_count(body, F.lit(WORD)).cast("long")})


def count_cells(rows: DataFrame) -> DataFrame:
    """Documents and tokens per cell; cells without tokens have no part in the mixture."""
    return rows.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS)).agg(
        F.sum("_tokens").alias("tokens")).filter("tokens > 0")


def wanted(cells: DataFrame, plan: Plan, name: str, power: float) -> DataFrame | None:
    """``name`` and ``target_{name}``, the share each group of a marginal should have; None without groups."""
    part = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("_t"))
    given = dict(plan.targets).get(name)
    if given is None:
        part = part.withColumn("_t", F.pow("_t", F.lit(power)))
    else:
        weight = F.create_map(*(F.lit(x) for group, w in given for x in (group, float(w))))
        part = part.withColumn("_t", F.get(F.map_values(F.map_filter(weight, lambda k, _: k == F.col(name))), F.lit(0)))
        part = part.filter("_t > 0")
    total = part.agg(F.sum("_t")).first()[0]
    return None if total is None else part.select(name, (F.col("_t") / F.lit(total)).alias(f"target_{name}"))


def rake(cells: DataFrame, plan: Plan) -> DataFrame:
    """Cells with ``weight``, shares that meet the wanted marginals as far as the cells allow."""
    parts = [(name, wanted(cells, plan, name, power)) for name, power in plan.temper]
    for name, part in parts:
        if part is None:
            return cells.withColumn("weight", F.lit(0.0))
        cells = cells.join(part, name)
    cells = stage(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for _ in range(plan.rounds):
        for name, _power in plan.temper:
            marginal = F.sum("weight").over(Window.partitionBy(name))
            cells = cells.withColumn("weight", F.col("weight") * F.col(f"target_{name}") / marginal)
        cells = stage(cells, "raked")
    return cells


def probabilities(cells: DataFrame, plan: Plan) -> DataFrame:
    """Cells with ``probability``: min(1, scale * weight / tokens), the scale such that the
    expected tokens are the plan's share of all. Cells at 1 leave their rest to the others.
    Without a share the scale is the largest that needs no cell more than whole."""
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    ratio = F.col("weight") / F.col("tokens")
    if plan.share is None:
        most = cells.agg(F.max(ratio)).first()[0] or 0.0
        return cells.withColumn("probability", F.least(F.lit(1.0), ratio / F.lit(most)) if most else F.lit(0.0))
    scale = 0.0
    for _ in range(plan.capping):
        full = ratio * F.lit(scale) >= 1
        taken, weight = cells.agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))).cast("double"), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if weight == 0.0:
            break
        scale = (plan.share * total - taken) / weight
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(scale)))


def chance(key: str) -> Column:
    """Number in [0, 1) from the first 32 bits of the key's md5; a null key counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def decide(rows: DataFrame, cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``with_cell`` with ``probability`` and ``kept``; rows without words have 0 and go."""
    cells = stage(cells.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "probability"), "probabilities")
    if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    joined = rows.join(cells, [f"_{d}" for d in DIMENSIONS], "left")
    p = F.when(F.col("_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(0.0))
    return joined.withColumn("probability", p).withColumn("kept", chance(key) < F.col("probability"))


def mix(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text",
        source: str = "source", lang: str = "lang") -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, kept`` for every row.

    A null source or language is a group of its own. Rows that repeat a key share its fate if
    their cells do. An empty table gives an empty result.
    """
    rows = with_cell(docs, plan, text, source, lang).select(
        F.col(key).alias("doc_id"), "_source", "_lang", "_topic", "_tokens")
    rows = stage(rows, "cells_of_documents")
    cells = probabilities(rake(count_cells(rows), plan), plan)
    return decide(rows, cells).select(
        "doc_id", *(F.col(f"_{d}").alias(d) for d in DIMENSIONS), F.col("_tokens").alias("n_tokens"),
        "probability", "kept")


def achieved(mixed: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``dimension, name, natural, target, expected, kept`` of a result of ``mix``: shares of the tokens
    in the input, as planned, by the probabilities and in the documents kept."""
    cells = mixed.groupBy(*DIMENSIONS).agg(
        F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"),
        F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0)).alias("kept")).filter("tokens > 0")
    cells = stage(cells, "mixed_cells")
    sums = {c: cells.agg(F.sum(c).cast("double")).first()[0] for c in ("tokens", "expected", "kept")}
    out = None
    for name, power in plan.temper:
        part = cells.groupBy(name).agg(*((F.try_divide(F.sum(c).cast("double"), F.lit(sums[c]).cast("double"))).alias(c)
                                         for c in sums))
        target = wanted(cells, plan, name, power)
        part = part.withColumn(f"target_{name}", F.lit(0.0)) if target is None else part.join(target, name, "left")
        part = part.select(F.lit(name).alias("dimension"), F.col(name).alias("name"), F.col("tokens").alias("natural"),
                           F.coalesce(f"target_{name}", F.lit(0.0)).alias("target"), "expected", "kept")
        out = part if out is None else out.unionByName(part)
    return out


def sample(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text",
           source: str = "source", lang: str = "lang") -> DataFrame:
    """The documents that ``mix`` keeps, with all their columns; texts do not move where cells are few."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = with_cell(docs.select(F.col(key).alias("doc_id"), text, source, lang, whole), plan, text, source, lang)
    cells = stage(count_cells(rows), "cells")
    kept = decide(rows, probabilities(rake(cells, plan), plan)).filter("kept")
    return kept.select("row.*")


def oracle(plan: Plan = Plan()) -> str:
    """The same in SQL for DuckDB."""
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower(body), '{p}')" for p in parts) + f" THEN '{name}'"
                     for name, parts in plan.topics)
    steps = [f"""d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
      CASE {cases} ELSE '{plan.other}' END AS topic, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS n_tokens
      FROM (SELECT *, coalesce(text, '') AS body FROM documents) z)""",
             """c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens
      FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""]
    for name, power in plan.temper:
        steps.append(f"t_{name} AS (SELECT {name}, pow(sum(tokens), {power}) AS t FROM c GROUP BY {name})")
        steps.append(f"g_{name} AS (SELECT {name}, t / (SELECT sum(t) FROM t_{name}) AS target FROM t_{name})")
    steps.append("r AS MATERIALIZED (SELECT *, tokens AS weight FROM c)")
    last = "r"
    for i in range(plan.rounds):
        for name, _ in plan.temper:
            steps.append(f"""r{i}_{name} AS MATERIALIZED (SELECT x.* REPLACE (weight * target / sum(weight) OVER (
              PARTITION BY x.{name}) AS weight) FROM {last} x JOIN g_{name} g ON x.{name} = g.{name})""")
            last = f"r{i}_{name}"
    scale = "0.0"
    for i in range(plan.capping):
        steps.append(f"""s{i} AS MATERIALIZED (SELECT ({plan.share} * sum(tokens) - coalesce(sum(tokens) FILTER (
          weight / tokens * {scale} >= 1), 0)) / sum(weight) FILTER (weight / tokens * {scale} < 1) AS scale
          FROM {last})""")
        scale = f"(SELECT scale FROM s{i})"
    return f"""WITH {', '.join(steps)}
      SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.n_tokens AS BIGINT) AS n_tokens,
        round(p, 6) AS probability, ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8))::BIGINT
          / 4294967296.0::DOUBLE < p AS kept
      FROM (SELECT d.*, CASE WHEN n_tokens > 0 THEN least(1.0, weight / tokens * {scale}) ELSE 0 END AS p
        FROM d LEFT JOIN {last} x ON d.source = x.source AND d.lang = x.lang AND d.topic = x.topic) d"""
