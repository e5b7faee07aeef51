"""Mixing sources to target weights by entropy balancing.

A document may be taken 0, 1 or 2 times. With no constraint each count has its prior probability (1/4,
1/2, 1/4: once in the mean). Among all rates that give every source its target of tokens, the wanted
ones stay closest to that prior in relative entropy: they tilt it exponentially by the document's size,

    rate(x) = 2 / (1 + exp(-lambda_source * x)),    x = size / mean size of the source,

and the multipliers minimise the convex dual  sum 2 log(1 + exp(lambda x)) - lambda target, whose
gradient is the source's surplus of tokens. Newton's steps, kept in a bracket, are taken for all
sources at once by one distributed aggregation each. Rates then become whole copies: counts are fixed
per cell of equal sizes with the rounding error carried on to the next smaller size, and in a cell the
documents of the smallest hashes get the larger count.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import n_words, running_sums, unused, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Sizes up to EXACT are cells of their own; larger ones share cells a 1/512 of their size wide, which
#: bounds a source's cells by EXACT + 512 for each doubling.
EXACT = 4096
#: Rows of one cell that one task ranks.
RANKED = 100_000
#: Newton's steps; what isn't near its target after these is found by halving the bracket, as far as doubles go.
ROUNDS = 30
NEAR = 1e-7


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources(source, source_size, ...) with sid and target.

    Sources by code point, null last, weigh `weights`, repeating, and share `share` of all sizes. A
    target stops at `most` times its source's size; the excess is shared by weight among the others
    until none is above. In closed form: by ascending ratio of limit to weight a prefix of sources is at
    its limit, and the others have one level times their weight. Sources may be many: they are numbered and summed in
    ranges, and no task holds them all.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = running_sums(sources, [F.col("source").asc_nulls_last()], {"sid": F.lit(1)}).withColumn("sid", F.col("sid") - 1)
    ranked = ranked.withColumn("weight", w).withColumn("limit", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    ranked = running_sums(ranked, [F.col("ratio"), F.col("sid")], {"limits": F.col("limit"), "weights": F.col("weight")})
    size, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # the level that holds if this source and those of larger ratio are below their limits
    level = (F.lit(float(size) * share) - (F.col("limits") - F.col("limit"))) / (F.lit(weight) - F.col("weights") + F.col("weight"))
    found = ranked.withColumn("level", level).where("level * weight < limit").agg(F.min(F.struct("ratio", "sid", "level"))["level"]).first()[0]
    target = F.col("limit") if found is None else F.least(F.col("limit"), F.lit(found) * F.col("weight"))
    return ranked.withColumn("target", target).drop("weight", "limit", "ratio", "limits", "weights")


def _cell(size: Column) -> Column:
    """Equal for sizes of one cell; ascending."""
    octave = F.floor(F.log2(F.greatest(size, F.lit(1)) / F.lit(float(EXACT)))).cast("long")
    wide = F.pow(F.lit(2.0), octave) * (EXACT / 512)
    return F.when(size <= EXACT, size).otherwise(EXACT + octave * 512 + F.floor((size - F.pow(F.lit(2.0), octave) * EXACT) / wide) + 1).cast("long")


def _rate(x: Column, tilt: Column) -> Column:
    return F.lit(float(MOST)) / (1 + F.exp(F.greatest(F.least(-tilt * x, F.lit(700.0)), F.lit(-700.0))))


def tilts(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """sources(sid, source_size, target, docs) with tilt: null where all is taken as often as possible."""
    share = F.col("target") / (F.col("source_size") * MOST)
    start = F.when((F.col("source_size") > 0) & (share < 1 - NEAR) & (share > 0), F.log(share / (1 - share)))
    state = written(
        sources.select("sid", "source_size", "target", (F.col("source_size") / F.col("docs")).alias("mean"))
        .withColumn("tilt", start)
        .select("*", F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done")),
        "mix-tilts",
    )
    rounds = 0
    while True:
        rounds += 1
        x = F.col("size") / F.col("mean")
        rate = _rate(x, F.col("tilt"))
        # one Newton step of every source: its gradient and curvature over its cells
        step = (
            cells.join(state.where("tilt is not null and not done"), "sid")
            .groupBy("sid")
            .agg(F.sum(F.col("n") * x * rate).alias("got"), F.sum(F.col("n") * x * x * rate * (1 - rate / MOST)).alias("slope"))
        )
        over = F.col("got") * F.col("mean") - F.col("target")
        low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - over / F.col("mean") / F.greatest(F.col("slope"), F.lit(1e-300))
        moved = F.when((newton > low) & (newton < high) & F.lit(rounds <= ROUNDS), newton).otherwise((low + high) / 2)
        near = (F.abs(over) <= F.lit(NEAR) * F.col("target")) | (high - low <= F.lit(1e-12) * (1 + F.abs("tilt")))
        state = written(
            state.join(step, "sid", "left").select(
                "sid", "source_size", "target", "mean",
                F.when(F.col("got").isNull() | near, F.col("tilt")).otherwise(moved).alias("tilt"),
                F.when(F.col("got").isNull(), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("got").isNull(), F.col("high")).otherwise(high).alias("high"),
                (F.col("done") | F.coalesce(near, F.lit(False))).alias("done"),
            ),
            "mix-tilts",
        )
        if state.where("tilt is not null and not done").isEmpty():
            break
    return state.select("sid", "mean", "tilt")


def _rounded(cells: DataFrame) -> DataFrame:
    """cells(sid, cell, size, n, rate) with copies: the cell's, whole, all sources near their targets.

    Folds a source's cells, largest size first, and carries the tokens that rounding owes.
    """
    one = F.struct(F.col("size").alias("size"), F.col("cell").alias("cell"), F.col("n").alias("n"), F.col("rate").alias("rate"))
    listed = cells.groupBy("sid").agg(F.sort_array(F.collect_list(one), asc=False).alias("cells"))
    start = F.struct(F.lit(0.0).alias("owed"), F.expr("cast(array() as array<struct<cell:bigint,copies:bigint>>)").alias("done"))

    def fold(acc: Column, c: Column) -> Column:
        due = c["n"] * c["rate"] + F.when(c["size"] > 0, acc["owed"] / c["size"]).otherwise(0.0)
        copies = F.least(F.greatest(F.round(due), F.lit(0.0)), (c["n"] * MOST).cast("double")).cast("long")
        owed = acc["owed"] + (c["n"] * c["rate"] - copies) * c["size"]
        return F.struct(owed.alias("owed"), F.concat(acc["done"], F.array(F.struct(c["cell"].alias("cell"), copies.alias("copies")))).alias("done"))

    return listed.select("sid", F.inline(F.aggregate("cells", start, fold, lambda acc: acc["done"])))


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, size: Column | None = None) -> DataFrame:
    """A row per document(doc_id, source, text): doc_id, size, source_size, target, copies, taken.

    size: words of the text, or the column given. copies is 0, 1 or 2; taken is copies * size. Null
    sources are one source; a null or empty text has size 0 and one copy. Repeated rows count each, and
    equal ones may differ in copies. Reruns agree: ties of the hash of doc_id go by doc_id, and rows that
    share it are alike in all that is returned but the copies. A hot source or size is summed before it is
    shuffled and ranked in slices of about RANKED rows.
    """
    sizes = written(documents.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), (n_words(F.col("text")) if size is None else size).alias("size")), "mix-sizes")
    sizes = sizes.withColumn("cell", _cell(F.col("size")))
    by_cell = written(sizes.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens")), "mix-cells")
    sources = written(source_targets(by_cell.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum("n").alias("docs")), weights, share), "mix-sources")
    # from here on sources go by their number
    known = sources.select(F.col("source").alias("s"), "sid", "source_size", "target")
    cells = by_cell.join(known, F.col("source").eqNullSafe(F.col("s"))).select("sid", "cell", "n", (F.col("tokens") / F.col("n")).alias("size"))
    found = tilts(cells, sources)
    rate = F.when(F.col("tilt").isNull(), F.when(F.col("target") > 0, F.lit(float(MOST))).otherwise(1.0)).otherwise(_rate(F.col("size") / F.col("mean"), F.col("tilt")))
    rated = cells.join(found, "sid").join(known.select("sid", "target"), "sid").select("sid", "cell", "n", "size", F.when(F.col("size") == 0, 1.0).otherwise(rate).alias("rate"))
    copies = _rounded(rated)
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / RANKED))
    plan = written(
        by_cell.join(known, F.col("source").eqNullSafe(F.col("s"))).join(copies, ["sid", "cell"]).select("source", "cell", "source_size", "target", slices.alias("slices"), (F.expr("copies div n")).alias("each"), (F.col("copies") % F.col("n")).alias("more")),
        "mix-plan",
    )
    planned = _joined(sizes, plan, ["source", "cell"]).withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("slices")))
    # a document's rank in its cell: rows of earlier slices, and its rank in its own
    cell_key = ["source", "cell", "slice"]
    planned = planned.withColumn("hash", F.xxhash64("doc_id", F.lit(2)))
    in_slice = planned.where("more > 0").groupBy(*cell_key).agg(F.count(F.lit(1)).alias("rows"))
    before = in_slice.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("source", "cell").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows")
    rank = F.row_number().over(Window.partitionBy(*cell_key).orderBy("hash", "doc_id"))
    uneven = _joined(planned.where("more > 0").withColumn("rank", rank), before, cell_key)
    uneven = uneven.withColumn("copies", F.col("each") + (F.col("rank") + F.col("before") <= F.col("more")).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "copies"]
    out = uneven.select(*columns).unionByName(planned.where("more = 0").withColumn("copies", F.col("each")).select(*columns))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """documents, each row as often as mix_sources() takes it; columns as they are.

    Rows that share a doc_id, or have none, share their copies out: all get the whole part, and some
    of them one more. Rows in slices of a hot doc_id are counted before they are ranked.
    """
    columns = documents.columns
    key, copies, rows, part, place, each, at_key, at_part, first_place = unused(documents, "key", "copies", "rows", "part", "place", "each", "at_key", "at_part", "first")
    planned = mix_sources(documents, **options).groupBy("doc_id").agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    planned = written(planned.withColumnRenamed("doc_id", key), "mix-copies")
    # always a merge join: copies grow with the corpus
    joined = documents.join(planned.hint("merge"), F.col("doc_id").eqNullSafe(F.col(key)))
    if planned.where(F.col(rows) > 1).isEmpty():
        joined = joined.withColumn(each, F.col(copies))
    else:
        joined = written(joined.withColumn(part, F.spark_partition_id()), "mix-rows")
        shared = joined.groupBy(key, part).agg(F.count(F.lit(1)).alias(place))
        earlier = F.coalesce(F.sum(place).over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = shared.where(F.col(place) > 0).select(F.col(key).alias(at_key), F.col(part).alias(at_part), earlier.alias(first_place))
        own = F.row_number().over(Window.partitionBy(key, part).orderBy(F.lit(0)))
        joined = joined.withColumn(place, own).join(first.hint("merge"), F.col(key).eqNullSafe(F.col(at_key)) & (F.col(part) == F.col(at_part)))
        more = F.col(first_place) + F.col(place) <= F.col(copies) % F.col(rows)
        joined = joined.withColumn(each, F.expr(f"`{copies}` div `{rows}`") + more.cast("long"))
    return joined.where(F.col(each) > 0).select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(each))).alias(place)).drop(place)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys are equal."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(other, on).drop(*[f"__{k}" for k in keys])
