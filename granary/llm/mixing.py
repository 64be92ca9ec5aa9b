"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Token counts are summed by cell (source, language, topic).  The tokens to keep are shared out to the values of each
source, language and topic by their target shares; a value can't give more than it has, so values that are asked for more
give all, and the others make up for it in proportion (targets that are feasible).  Cells of values that give all have
probability 1; the others are raked to what is left of each target in turn, cells at their bound being held there,
until all marginals fit.  Then every document is kept with the probability that brings its cell from the tokens it has
to the tokens it should have.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm._common import Scratch

DIMENSIONS = ("source", "lang", "topic")
_WORDS = r"[^\x20\x09-\x0D]+"
#: Rounds of raking in one job; the greatest relative miss that counts as fitting.
_ROUNDS, _FIT = 8, 1e-9
#: As many cells are raked as one partition: their windows then need no exchange.
_SMALL = 100_000
#: What is left of a target that cells which give all have used up: a share of the other cells' tokens.
_FLOOR = 0.01

#: Topic by the first mark that a text contains; 'prose' without any.
TOPIC_MARKS = (("licence", "icense"), ("table", " | "), ("shouting", "!!"), ("secrets", "password="), ("contacts", "@"))


def topic_of(text: Column) -> Column:
    out = F
    for topic, mark in TOPIC_MARKS:
        out = out.when(F.contains(text, F.lit(mark)), topic)
    return out.otherwise("prose")


def _added(docs: DataFrame) -> dict[str, str]:
    """Names of the columns that are added: '__' before source, lang, topic, tokens and probability, or more
    underscores where ``docs`` has such a column already."""
    start = "__"
    while any(f"{start}{x}".lower() in map(str.lower, docs.columns) for x in (*DIMENSIONS, "tokens", "probability")):
        start += "_"
    return {x: f"{start}{x}" for x in (*DIMENSIONS, "tokens", "probability")}


def _targets(cells: DataFrame, d: str, wanted: Mapping[str, float], temper: float, level: float) -> DataFrame:
    """Per value of a dimension: asked (its target share), due (the tokens it can be asked for), all (whether that is all it has)."""
    values = cells.groupBy(d).agg(F.sum("t").cast("double").alias("own")).where("own > 0").withColumn("raw", F.pow("own", F.lit(float(temper))))
    sums = values.agg(F.sum("raw").alias("raws"), F.sum("own").alias("total"))
    values = values.crossJoin(F.broadcast(sums)).withColumn("asked", F.col("raw") / F.col("raws"))  # one row beside all
    if wanted:
        given = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (str(k), float(v))])
        values = values.withColumn("asked", F.coalesce(given[F.col(d)], F.col("asked")))
        values = values.crossJoin(F.broadcast(values.agg(F.sum("asked").alias("sum")))).withColumn("asked", F.col("asked") / F.col("sum"))
    # Values by how soon they run out: with those before it giving all, a value's factor is what the rest are asked for
    # over their shares; the largest such factor is the one at which the sum is right.
    room = F.col("total") * level
    values = values.withColumn("ratio", F.when(F.col("asked") > 0, F.col("own") / (F.col("asked") * room)).otherwise(F.lit(float("inf"))))
    soon = Window.partitionBy().orderBy("ratio", d)  # the values of one dimension
    spent = F.coalesce(F.sum("own").over(soon.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("asked").over(soon.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    values = values.withColumns({"spent": spent, "rest": rest}).withColumn("factor", F.when(F.col("rest") > 0, (room - F.col("spent")) / (room * F.col("rest"))))
    factor = values.agg(F.coalesce(F.max("factor"), F.lit(0.0)).alias("best"))
    due = F.col("best") * F.col("asked") * room
    full = F.col("own") <= due * (1 + 1e-12)
    return values.crossJoin(F.broadcast(factor)).select(d, F.col("asked").alias(f"asked_{d}"), F.least("own", due).alias(f"due_{d}"), full.alias(f"all_{d}"))


def _cells(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, topic: Column | None, keep: float, temper: float, rounds: int, text_col: str, source_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the cells' columns, and the cells: their values, t, shares asked for, tokens due and p."""
    text, names = F.coalesce(F.col(text_col), F.lit("")), _added(docs)
    cells_of = {"source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "topic": topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit("")), "tokens": F.regexp_count(text, F.lit(_WORDS)).cast("long")}
    named = docs.withColumns({names[k]: c for k, c in cells_of.items()})
    scratch = Scratch(docs.sparkSession, "mixing")
    by = [F.col(names[d]).alias(d) for d in DIMENSIONS]
    cells = scratch.save(named.groupBy(*by).agg(F.sum(names["tokens"]).alias("t")), "cells")
    size, total = cells.agg(F.count(F.lit(1)), F.sum("t")).first()
    small = size <= _SMALL
    plain = cells
    for d in DIMENSIONS:
        found = _targets(plain, d, (targets or {}).get(d) or {}, temper, keep)
        cells = cells.join(found, d, "left")
    none = " or ".join(f"due_{d} = 0" for d in DIMENSIONS)
    full = " or ".join(f"all_{d}" for d in DIMENSIONS)
    cells = scratch.save(cells.withColumn("state", F.expr(f"case when t = 0 then 'empty' when {none} then 'none' when {full} then 'all' else 'open' end")), "targets")
    # What cells that give all leave of each target.
    weights = cells.coalesce(1) if small else cells
    for d in DIMENSIONS:
        own = Window.partitionBy(d)
        used, free = (F.sum(F.when(F.col("state") == s, F.col("t")).otherwise(F.lit(0))).over(own) for s in ("all", "open"))
        weights = weights.withColumns({f"left_{d}": F.greatest(F.col(f"due_{d}") - used, F.lit(_FLOOR) * free), f"part_{d}": F.when(free > 0, F.col("t") / free)})
    weights = scratch.save(weights.where("state in ('all', 'open')"), "open")
    # Floors may lift a dimension's sum: all of them share out the same tokens.
    opened = F.col("state") == "open"
    rest = F.lit(float(keep)) * F.lit(float(total or 0)) - F.sum(F.when(~opened, F.col("t")).otherwise(F.lit(0)))
    sums = weights.agg(rest.alias("rest"), *(F.sum(F.when(opened, F.col(f"left_{d}") * F.col(f"part_{d}"))).alias(f"sum_{d}") for d in DIMENSIONS))
    weights = weights.where(opened).crossJoin(F.broadcast(sums)).withColumns({f"left_{d}": F.col(f"left_{d}") * F.greatest("rest", F.lit(_FLOOR) * F.col(f"sum_{d}")) / F.col(f"sum_{d}") for d in DIMENSIONS})  # one row beside all
    weights = weights.select(*DIMENSIONS, "t", *(f"left_{d}" for d in DIMENSIONS), F.col("t").cast("double").alias("w"))
    weights, done, worst = scratch.save(weights, "raked0"), 0, None
    while done < rounds:
        weights = weights.coalesce(1) if small else weights
        for _ in range(_ROUNDS):
            off = F.lit(0.0)
            for d in DIMENSIONS:
                # A cell counts with what it can give: at its bound it stays there, and the others make up for it.
                weights = weights.withColumn("have", F.sum(F.least("w", F.col("t").cast("double"))).over(Window.partitionBy(d)))
                off = F.greatest(off, F.abs(F.col("have") / F.col(f"left_{d}") - 1))
                weights = weights.withColumns({"off": off, "w": F.col("w") * F.col(f"left_{d}") / F.col("have")}).drop("have")
                off = F.col("off")
        done += _ROUNDS
        weights = scratch.save(weights, f"raked{done}")
        scratch.drop(f"raked{done - _ROUNDS}")
        last, worst = worst, weights.agg(F.max("off")).first()[0]
        if worst is None or worst <= _FIT or (last and abs(worst - last) <= 1e-6 * last):
            break
        weights = weights.drop("off")
    if (worst or 0) > 0.005:
        warnings.warn(f"mixing: the targets can't be met together; after {done} rounds the worst marginal is off by {worst:.1%}", stacklevel=3)
    p = F.when(F.col("state") == "all", 1.0).when(F.col("state") == "none", 0.0).when(F.col("state") == "empty", float(keep)).otherwise(F.least(F.lit(1.0), F.col("w") / F.col("t")))
    return named, scratch.save(cells.join(weights.select(*DIMENSIONS, "w"), list(DIMENSIONS), "left").withColumn("p", p).drop("w"), "chances")


def probabilities(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, *, topic: Column | None = None, keep: float = 0.8, temper: float = 0.7, rounds: int = 96, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``docs`` with __source, __lang, __topic, __tokens and __probability beside its own columns.

    ``targets`` gives shares by value for any of source, lang and topic; where a dimension or value is missing,
    its tempered token share (tokens ** temper, normalised) stands in; shares are normalised to sum to 1 over the
    values that have tokens.  ``keep`` of all tokens are kept (0 to 1).  A value that is asked for more tokens than it has gives all,
    and the others are asked for more in the same proportion: these feasible targets are met (to 1e-9, in ``rounds`` at
    most), unless they contradict each other, of which a warning tells.  ``marginals`` lists both targets.

    Null sources and languages count as ''.  Texts count words (null: none); a cell without tokens keeps its
    documents with probability ``keep``; a target of 0 keeps none.  An empty table stays empty; repeated rows are drawn alike.
    Where ``docs`` has columns of the added names, the added ones begin with more underscores.  Cells, not
    documents, are shuffled; up to 100,000 of them are broadcast.
    """
    named, cells = _cells(docs, targets, topic, keep, temper, rounds, text_col, source_col, lang_col)
    names = _added(docs)
    found = cells.select(*(F.col(d).alias(names[d]) for d in DIMENSIONS), F.col("p").alias(names["probability"]))
    if cells.count() <= _SMALL:  # 10 MB at most
        found = F.broadcast(found)
    return named.join(found, [names[d] for d in DIMENSIONS]).select(*docs.columns, *(names[x] for x in (*DIMENSIONS, "tokens", "probability")))


def marginals(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, *, topic: Column | None = None, keep: float = 0.8, temper: float = 0.7, rounds: int = 96, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per value of each dimension: dimension, value, target (share asked for), feasible (share that can be
    met), share (expected, of the tokens kept), kept (expected, of all tokens)."""
    _, cells = _cells(docs, targets, topic, keep, temper, rounds, text_col, source_col, lang_col)
    mass = cells.where("t > 0").withColumn("mass", F.col("t") * F.col("p"))
    sums = mass.agg(F.sum("mass").alias("all"), F.sum("t").alias("total"))
    parts = [mass.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.max(f"asked_{d}").alias("target"), F.max(f"due_{d}").alias("due"), F.sum("mass").alias("mass")) for d in DIMENSIONS]
    return parts[0].union(parts[1]).union(parts[2]).crossJoin(F.broadcast(sums)).select("dimension", "value", "target", (F.col("due") / (F.col("total") * keep)).alias("feasible"), (F.col("mass") / F.col("all")).alias("share"), (F.col("all") / F.col("total")).alias("kept"))


def draw(id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> Column:
    """A number from 0 to 1 (not included) that depends on the seed and the id alone (a null id: on the text)."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, *, seed: int = 0, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, with their own columns; options as for ``probabilities``."""
    found = probabilities(docs, targets, **options)
    return found.where(draw(id_col, options.get("text_col", "text"), seed) < F.col(_added(docs)["probability"])).select(*docs.columns)


def oracle_sql(keep: float = 0.8, temper: float = 0.7, rounds: int = 96, seed: int = 0) -> str:
    """DuckDB SQL for the probabilities of ``documents`` and which of them are drawn, by a recursion over the rounds."""
    marks = " ".join(f"WHEN contains(text, '{mark}') THEN '{topic}'" for topic, mark in TOPIC_MARKS)
    steps = [
        f"named AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {marks} ELSE 'prose' END AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS t FROM named GROUP BY ALL)",
        f"room AS (SELECT {keep} * sum(t) AS room FROM cells)",
    ]
    for d in DIMENSIONS:
        steps += [
            f"v_{d} AS (SELECT {d}, sum(t) AS own, pow(sum(t), {temper}) / sum(pow(sum(t), {temper})) OVER () AS asked FROM cells GROUP BY {d} HAVING sum(t) > 0)",
            # The factor by which the others' shares grow, tried with each value as the first that doesn't give all.
            f"f_{d} AS (SELECT max((room - (SELECT coalesce(sum(own), 0) FROM v_{d} b WHERE b.own / b.asked < a.own / a.asked)) / (room * (SELECT sum(asked) FROM v_{d} b WHERE b.own / b.asked >= a.own / a.asked))) AS f FROM v_{d} a, room)",
            f"t_{d} AS MATERIALIZED (SELECT {d}, least(own, f * asked * room) AS due_{d}, own <= f * asked * room * (1 + 1e-12) AS all_{d} FROM v_{d}, f_{d}, room)",
        ]
    joins = " ".join(f"LEFT JOIN t_{d} USING ({d})" for d in DIMENSIONS)
    full = " OR ".join(f"all_{d}" for d in DIMENSIONS)
    left = ", ".join(f"greatest(due_{d} - sum(CASE WHEN given THEN t ELSE 0 END) OVER (PARTITION BY {d}), {_FLOOR} * sum(CASE WHEN given THEN 0 ELSE t END) OVER (PARTITION BY {d})) AS left_{d}" for d in DIMENSIONS)
    scaled = ", ".join(f"left_{d} * greatest(rest, {_FLOOR} * (SELECT sum(x) FROM (SELECT DISTINCT {d}, left_{d} AS x FROM opened))) / (SELECT sum(x) FROM (SELECT DISTINCT {d}, left_{d} AS x FROM opened)) AS left_{d}" for d in DIMENSIONS)
    steps += [
        f"placed AS MATERIALIZED (SELECT *, coalesce({full}, false) AS given FROM cells {joins})",
        f"opened AS MATERIALIZED (SELECT * FROM (SELECT source, lang, topic, t, given, {left} FROM placed) WHERE NOT given AND t > 0)",
        "rest AS (SELECT room - (SELECT coalesce(sum(t), 0) FROM placed WHERE given) AS rest FROM room)",
        f"start AS MATERIALIZED (SELECT source, lang, topic, t, {scaled} FROM opened, rest)",
    ]
    inner = "SELECT * FROM raked WHERE i < {}".format(rounds)
    for d in DIMENSIONS:
        inner = f"SELECT * REPLACE (w * left_{d} / sum(least(w, t)) OVER (PARTITION BY {d}) AS w) FROM ({inner})"
    steps.append(f"raked AS (SELECT 0 AS i, source, lang, topic, t, left_source, left_lang, left_topic, t AS w FROM start UNION ALL SELECT i + 1, source, lang, topic, t, left_source, left_lang, left_topic, w FROM ({inner}))")
    chance = f"CAST(('0x' || substr(md5('{seed}|' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"
    return f"""
    WITH RECURSIVE {", ".join(steps)}
    SELECT doc_id, source, lang, topic, n AS n_tokens, round(p, 6) AS probability, {chance} < p AS kept
    FROM (SELECT named.*, CASE WHEN placed.t = 0 THEN {keep} WHEN given THEN 1.0 ELSE least(1.0, w / placed.t) END AS p
          FROM named JOIN placed USING (source, lang, topic) LEFT JOIN (SELECT * FROM raked WHERE i = {rounds}) r USING (source, lang, topic))
    """
