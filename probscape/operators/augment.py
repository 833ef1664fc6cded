"""Bulk changes to a corpus: new problems derived from old ones, many at a time.

Entries are taken as a mapping from coordinate to value, one row per coordinate
(``unique_entries`` makes it so).  All randomness is drawn from the keys of the row.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probscape.common import DataError, cut, keep
from probscape.functions.draws import Draws, HashDraws
from probscape.functions.features import KEY, Corpus
from probscape.functions.order_stats import grouped_median

PLACE = ["mat_id", "block_id", "row", "col"]
COORD = [KEY, *PLACE]
# Spread of scale factors, of entry noise, of new values.
SCALE_STD, PERTURB_STD, NEW_STD = 0.4, 0.2, 0.3
# Most entries a child takes from its second parent (objective, constraints),
# most entries of a new constraint, range of mixing weights, attempts per wanted position.
TAKE_C, TAKE_A, NEW_ENTRIES = 6, 8, 3
MIX_LO, MIX_HI = 0.25, 0.75
ATTEMPTS = 50
#: Rows of a task, about, where nothing is combined before the shuffle.
TASK_ROWS = 1_000_000


def _k(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def unique_entries(entries: DataFrame) -> DataFrame:
    """One row per coordinate.  Tables have no file order, so the largest value is kept.

    Few coordinates repeat, so rows are dealt by their number, ``TASK_ROWS`` to a task.
    """
    parts = max(entries.sparkSession.sparkContext.defaultParallelism, math.ceil(entries.count() / TASK_ROWS))
    folded = entries.withColumns({"row": F.least("row", "col"), "col": F.greatest("row", "col")})
    return folded.repartition(parts, *COORD).groupBy(*COORD).agg(F.max("value").alias("value"))


def choose_matrix(problems: DataFrame, draws: Draws | None = None, label: str = "mat") -> DataFrame:
    """A random constraint of every problem that has one: ``(instance, mat_id)``."""
    draws = draws or HashDraws()
    return problems.where("m > 0").select(KEY, draws.integer(label, F.col("m"), F.col(KEY)).alias("mat_id"))


def objective_of(problems: DataFrame) -> DataFrame:
    return problems.select(KEY, F.lit(0).alias("mat_id"))


# ------------------------------------------------------------------------------- values


def log_factor(step: float = 1.0, draws: Draws | None = None, label: str = "factor") -> Column:
    """A log-normal factor per instance."""
    return F.exp((draws or HashDraws()).normal(label, F.col(KEY)) * (SCALE_STD * step))


def scale(corpus: Corpus, target: str, factor: Column | float) -> Corpus:
    """Multiply the objective (``C``), the constraints (``A``) or the right-hand side (``b``)."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    if target == "b":
        return replace(corpus, rhs=corpus.rhs.withColumn("b", F.col("b") * f))
    if target not in ("A", "C"):
        raise DataError(f"unknown part {target!r}")
    hit = F.col("mat_id") >= 1 if target == "A" else F.col("mat_id") == 0
    return replace(
        corpus, entries=corpus.entries.withColumn("value", F.when(hit, F.col("value") * f).otherwise(F.col("value")))
    )


def perturb(entries: DataFrame, hit: Column, std: float = PERTURB_STD, draws: Draws | None = None) -> DataFrame:
    """Multiply the selected entries by independent log-normal noise."""
    noise = F.exp((draws or HashDraws()).normal("perturb", *_k(*COORD)) * std)
    return entries.withColumn("value", F.when(hit, F.col("value") * noise).otherwise(F.col("value")))


# ------------------------------------------------------------------------------ pattern


def drop_entries(
    entries: DataFrame, chosen: DataFrame, n: int, draws: Draws | None = None, order: list[Column] | None = None
) -> DataFrame:
    """Drop ``n`` entries of every chosen ``(instance, mat_id)``; an objective keeps at least one.

    The victims are found by a ranking limited to ``n`` before its shuffle, then removed by
    an anti-join, so a matrix of any size is never gathered.
    """
    draws = draws or HashDraws()
    order = order or [draws.uniform("drop", *_k(*COORD)), *_k(*PLACE)]
    mine = entries.join(chosen, [KEY, "mat_id"], "left_semi")
    ranked = mine.withColumn("rk", F.row_number().over(Window.partitionBy(KEY, "mat_id").orderBy(*order)))
    victims = ranked.where(F.col("rk") <= n).select(*COORD, "rk")
    sizes = mine.groupBy(KEY, "mat_id").agg(F.count(F.lit(1)).alias("size"))
    allowed = F.when(F.col("mat_id") == 0, F.col("size") - 1).otherwise(F.col("size"))
    gone = victims.join(sizes, [KEY, "mat_id"]).where(F.col("rk") <= allowed).select(*COORD)
    return entries.join(gone, COORD, "left_anti")


def reference_values(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """Typical magnitude per chosen matrix: its median |value|, else that of all constraints, else 1."""
    sized = entries.where("value <> 0").withColumn("size", F.abs("value"))
    own = grouped_median(sized.join(chosen, [KEY, "mat_id"], "left_semi"), [KEY, "mat_id"], "size")
    lacking = chosen.join(own, [KEY, "mat_id"], "left_anti")
    every = grouped_median(sized.where("mat_id >= 1").join(lacking, KEY, "left_semi"), [KEY], "size")
    return (
        chosen.join(own.withColumnRenamed("median", "own"), [KEY, "mat_id"], "left")
        .join(every.withColumnRenamed("median", "every"), KEY, "left")
        .select(KEY, "mat_id", F.coalesce("own", "every", F.lit(1.0)).alias("typical"))
    )


def sample_positions(
    corpus: Corpus, chosen: DataFrame, n: int | Column, most: int, draws: Draws | None = None, fill: bool = True
) -> DataFrame:
    """``n`` (≤ ``most``) unused upper-triangle positions per chosen matrix, or all if there are fewer.

    Seeded attempts first: a random block, then a random position in it, on the diagonal for
    diagonal blocks; ``ATTEMPTS`` for each position wanted.  Matrices so full that the attempts find too
    few get the rest from their free positions, listed for these matrices alone; without ``fill`` they get fewer.
    """
    draws = draws or HashDraws()
    limit = F.lit(n) if isinstance(n, int) else n
    wanted = chosen.join(corpus.problems.select(KEY, "n_blocks"), KEY).withColumn("wanted", F.least(limit, F.lit(most)))
    tries = max(ATTEMPTS, most * ATTEMPTS)
    t = wanted.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    key = _k(KEY, "mat_id", "t")
    t = t.withColumn("block_id", draws.integer("block", F.col("n_blocks"), *key)).join(corpus.blocks, [KEY, "block_id"])
    s = F.abs("size")
    t = t.withColumn("row", draws.integer("row", s, *key))
    t = t.withColumn(
        "col", F.when(F.col("size") > 0, F.col("row") - 1 + draws.integer("col", s - F.col("row") + 1, *key)).otherwise(F.col("row"))
    )
    used = corpus.entries.join(chosen, [KEY, "mat_id"], "left_semi").select(*COORD)
    first = t.groupBy(*COORD, "wanted").agg(F.min("t").alias("t")).join(used, COORD, "left_anti")
    order = Window.partitionBy(KEY, "mat_id").orderBy("t")
    drawn = first.withColumn("rk", F.row_number().over(order)).where("rk <= wanted").select(*COORD)
    if not fill:
        return drawn

    drawn = keep(drawn)
    short = wanted.join(drawn.groupBy(KEY, "mat_id").count(), [KEY, "mat_id"], "left")
    short = short.select(KEY, "mat_id", (F.col("wanted") - F.coalesce("count", F.lit(0))).alias("lacking")).where("lacking > 0")
    if not short.take(1):
        return drawn
    # such a matrix has few free positions or few positions at all
    cells = short.join(corpus.blocks, KEY).withColumn("row", F.explode(F.sequence(F.lit(1), F.abs("size"))))
    last = F.when(F.col("size") > 0, F.col("size")).otherwise(F.col("row"))
    cells = cells.withColumn("col", F.explode(F.sequence(F.col("row"), last)))
    free = cells.join(used, COORD, "left_anti").join(drawn, COORD, "left_anti")
    order = Window.partitionBy(KEY, "mat_id").orderBy(draws.uniform("rest", *_k(*COORD)), *_k(*PLACE))
    rest = free.withColumn("rk", F.row_number().over(order)).where("rk <= lacking").select(*COORD)
    return drawn.unionByName(rest)


def new_values(positions: DataFrame, typical: DataFrame, draws: Draws | None = None) -> DataFrame:
    draws = draws or HashDraws()
    key = _k(*COORD)
    sign = F.when(draws.uniform("sign", *key) < 0.5, -1.0).otherwise(1.0)
    value = sign * F.col("typical") * F.exp(draws.normal("size", *key) * NEW_STD)
    return positions.join(typical, [KEY, "mat_id"]).select(*COORD, value.alias("value"))


def add_entries(corpus: Corpus, chosen: DataFrame, n: int, draws: Draws | None = None, fill: bool = True) -> DataFrame:
    """The entries plus ``n`` new ones per chosen matrix; without ``fill`` only those that the attempts find."""
    spots = sample_positions(corpus, chosen, n, n, draws, fill)
    fresh = new_values(spots, reference_values(corpus.entries, chosen), draws)
    return corpus.entries.select(*COORD, "value").unionByName(fresh)


def add_constraint(corpus: Corpus, draws: Draws | None = None, fill: bool = True) -> Corpus:
    """One more constraint per problem: 1–3 entries, and b ~ N(0, mean |b|)."""
    draws = draws or HashDraws()
    chosen = corpus.problems.select(KEY, (F.col("m") + 1).alias("mat_id"))
    wanted = draws.integer("count", F.lit(NEW_ENTRIES), F.col(KEY))
    fresh = new_values(
        sample_positions(corpus, chosen, wanted, NEW_ENTRIES, draws, fill), reference_values(corpus.entries, chosen), draws
    )
    spread = corpus.rhs.groupBy(KEY).agg(F.avg(F.abs("b")).alias("spread"))
    b = chosen.join(spread, KEY, "left").select(
        KEY, "mat_id",
        (draws.normal("b", F.col(KEY)) * (F.coalesce("spread", F.lit(1.0)) + 1e-10)).alias("b"),
    )
    return Corpus(
        corpus.problems.withColumn("m", F.col("m") + 1), corpus.blocks, corpus.rhs.unionByName(b),
        corpus.entries.select(*COORD, "value").unionByName(fresh),
    )


def remove_constraint(corpus: Corpus, chosen: DataFrame) -> Corpus:
    """Delete the chosen constraint and close the gap; problems with m ≤ 1 stay as they are."""
    gone = chosen.join(corpus.problems.where("m > 1").select(KEY), KEY, "left_semi").select(KEY, F.col("mat_id").alias("gone"))

    def closed(df):
        kept = df.join(gone, KEY, "left").where(F.col("gone").isNull() | (F.col("mat_id") != F.col("gone")))
        moved = F.when(F.col("mat_id") > F.col("gone"), F.col("mat_id") - 1).otherwise(F.col("mat_id"))
        return kept.withColumn("mat_id", moved).select(*df.columns)

    problems = corpus.problems.join(gone, KEY, "left").select(
        KEY, F.when(F.col("gone").isNull(), F.col("m")).otherwise(F.col("m") - 1).alias("m"), "n_blocks"
    )
    return Corpus(problems, corpus.blocks, closed(corpus.rhs), closed(corpus.entries))


# ---------------------------------------------------------------------------- crossover


def blend(corpus: Corpus, pairs: DataFrame, draws: Draws | None = None) -> Corpus:
    """Children of ``pairs(child, parent_a, parent_b)``.

    A child is its first parent; b is mixed if both have the same number of constraints, and
    then about half of the common constraint entries as well.  From the second parent it
    takes 1–6 objective entries and, with equally many constraints, 1–8 constraint entries.
    """
    draws = draws or HashDraws()
    p = corpus.problems
    couple = (
        pairs.join(p.select(F.col(KEY).alias("parent_a"), F.col("m").alias("m_a")), "parent_a")
        .join(p.select(F.col(KEY).alias("parent_b"), F.col("m").alias("m_b")), "parent_b")
        .select("child", "parent_a", "parent_b", (F.col("m_a") == F.col("m_b")).alias("same_m"))
    )

    def of(df, side, *extra):
        link = couple.select(F.col("child"), F.col(side).alias(KEY), *extra)
        return df.join(link, KEY).drop(KEY).withColumnRenamed("child", KEY)

    def weight(label, *keys):
        return MIX_LO + (MIX_HI - MIX_LO) * draws.uniform(label, *keys)

    b_a = of(corpus.rhs, "parent_a", "same_m")
    b_b = of(corpus.rhs, "parent_b").withColumnRenamed("b", "other")
    w = weight("b", F.col(KEY))
    rhs = b_a.join(b_b, [KEY, "mat_id"], "left").select(
        KEY, "mat_id",
        F.when(F.col("same_m") & F.col("other").isNotNull(), w * F.col("b") + (1 - w) * F.col("other")).otherwise(F.col("b")).alias("b"),
    )

    e_a = of(corpus.entries, "parent_a", "same_m")
    e_b = of(corpus.entries, "parent_b", "same_m")
    place = _k(*COORD)
    both = F.col("same_m") & F.col("other").isNotNull() & (F.col("mat_id") >= 1)
    v = weight("mix", *place)
    mixed = e_a.join(e_b.select(*COORD, F.col("value").alias("other")), COORD, "left").select(
        *COORD,
        F.when(both & (draws.uniform("coin", *place) < 0.5), v * F.col("value") + (1 - v) * F.col("other"))
        .otherwise(F.col("value")).alias("value"),
    )

    part = F.when(F.col("mat_id") == 0, "C").otherwise("A")
    offered = e_b.where((F.col("mat_id") == 0) | F.col("same_m")).withColumn("part", part)
    order = Window.partitionBy(KEY, "part").orderBy(draws.uniform("take", *place), *PLACE)
    most = max(TAKE_C, TAKE_A)
    top = offered.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= most)
    sizes = offered.groupBy(KEY, "part").agg(F.count(F.lit(1)).alias("size"))
    cap = F.least(F.when(F.col("part") == "C", TAKE_C).otherwise(TAKE_A), F.col("size"))
    taken = top.join(sizes, [KEY, "part"]).where(
        F.col("rk") <= draws.integer("takes", cap, F.col(KEY), F.col("part"))
    ).select(*COORD, "value")
    entries = mixed.join(taken.select(*COORD), COORD, "left_anti").unionByName(taken)
    return Corpus(of(p, "parent_a").select(KEY, "m", "n_blocks"), of(corpus.blocks, "parent_a").select(KEY, "block_id", "size"), rhs, entries)


# ------------------------------------------------------------------------------- mixture

# The mutations a child may get, most new or removed entries per unit of step.
MUTATIONS = (
    "scale_C", "scale_b", "scale_A", "perturb_C", "perturb_A", "add_C", "remove_C",
    "add_A", "remove_A", "add_constraint", "remove_constraint",
)
ADD_MOST, REMOVE_MOST = 5, 3


def restrict(corpus: Corpus, keys: DataFrame) -> Corpus:
    return Corpus(*[
        t.join(keys.select(KEY), KEY, "left_semi") for t in (corpus.problems, corpus.blocks, corpus.rhs, corpus.entries)
    ])


def union(parts: list[Corpus]) -> Corpus:
    out = parts[0]
    for p in parts[1:]:
        out = Corpus(
            out.problems.unionByName(p.problems), out.blocks.unionByName(p.blocks),
            out.rhs.unionByName(p.rhs), out.entries.unionByName(p.entries),
        )
    return out


def copies(corpus: Corpus, children: DataFrame) -> Corpus:
    """The corpus of ``children(child, parent)``: every child a copy of its parent."""
    link = children.select(F.col("child"), F.col("parent").alias(KEY))

    def of(df):
        return df.join(link, KEY).drop(KEY).withColumnRenamed("child", KEY).select(*df.columns)

    return Corpus(of(corpus.problems), of(corpus.blocks), of(corpus.rhs), of(corpus.entries))


def _mutate_values(problems, blocks, rhs, entries, step: float, draws: Draws) -> Corpus:
    """The mutations that change values only, chosen per row by its ``op``."""
    op, objective = F.col("op"), F.col("mat_id") == 0

    def factor(name):
        return log_factor(step, draws, name)

    noise = F.exp(draws.normal("perturb", *_k(*COORD)) * (PERTURB_STD * step))
    change = (
        F.when((op == "scale_C") & objective, factor("scale_C"))
        .when((op == "scale_A") & ~objective, factor("scale_A"))
        .when((op == "perturb_C") & objective, noise)
        .when((op == "perturb_A") & ~objective, noise)
        .otherwise(1.0)
    )
    b = F.when(op == "scale_b", F.col("b") * factor("scale_b")).otherwise(F.col("b"))
    return Corpus(
        problems.drop("op"), blocks.drop("op"), rhs.select(KEY, "mat_id", b.alias("b")),
        entries.select(*COORD, (F.col("value") * change).alias("value")),
    )


def mutate(corpus: Corpus, draws: Draws | None = None, step: float = 1.0, ops: DataFrame | None = None) -> Corpus:
    """One mutation per problem, drawn from the key unless ``ops(instance, op)`` names it.

    Problems are split by mutation, so each kind is one set operation over all of its
    problems.  The tagged corpus is cut first: the branches read it instead of replaying
    whatever led to it.
    """
    draws = draws or HashDraws()
    if ops is None:
        pick = F.element_at(F.array(*map(F.lit, MUTATIONS)), draws.integer("op", F.lit(len(MUTATIONS)), F.col(KEY)))
        tagged = [t.withColumn("op", pick) for t in (corpus.problems, corpus.blocks, corpus.rhs, corpus.entries)]
    else:
        tagged = [t.join(ops, KEY) for t in (corpus.problems, corpus.blocks, corpus.rhs, corpus.entries)]
    tagged = [cut(t) for t in tagged]
    present = {r["op"] for r in tagged[0].select("op").distinct().collect()}
    parts = []
    value_ops = [m for m in MUTATIONS if m.startswith(("scale_", "perturb_"))]
    if present.intersection(value_ops):  # these keep the pattern: one pass for all of them
        parts.append(_mutate_values(*[t.where(F.col("op").isin(value_ops)) for t in tagged], step, draws))
    for op in [m for m in MUTATIONS if m in present and m not in value_ops]:
        c = Corpus(*[t.where(F.col("op") == op).drop("op") for t in tagged])
        kind, _, what = op.partition("_")
        if op == "add_constraint":
            parts.append(add_constraint(c, draws))
        elif op == "remove_constraint":
            parts.append(remove_constraint(c, choose_matrix(c.problems, draws)))
        else:
            chosen = objective_of(c.problems) if what == "C" else choose_matrix(c.problems, draws)
            if kind == "add":
                parts.append(replace(c, entries=add_entries(c, chosen, ADD_MOST, draws)))
            else:
                parts.append(replace(c, entries=drop_entries(c.entries, chosen, REMOVE_MOST, draws)))
    return union(parts)
