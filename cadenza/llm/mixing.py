"""Mixing sources to target weights by hierarchical budgets (operator 2).

The leaves of a tree (domain, language, source) hold documents; every node has
a weight among its siblings.  A token budget goes down the tree: a node's
children share it by weight, no child gets more than its leaves can give in
``max_epochs`` passes, and what a child can't take goes to its siblings first.
As a node's budget never exceeds what its subtree can give, a shortage reaches
the ancestors' other children only when all siblings are full.

A leaf's stream of tokens is its documents in the seeded order of one epoch
after the other; it gives the prefix of this stream that its budget covers:
some whole epochs, then documents up to a cut in the next one's order.  The cut
is found from token counts of slices of the order's keys, so no task sorts a
leaf; then each document decides for itself by its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, others
from .lines import SPLIT, WHITE

#: Leading hex digits of the order's key that make a slice, and a slice of one:
#: a task that looks for a leaf's cut reads 256 counts, twice.
SLICE_DIGITS = (2, 4)


def count_tokens(text: Column) -> Column:
    """Words of a text (long); 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPLIT))).cast("long")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget`` to nodes (cap, weight, and the parent's budget ``given``):
    the parent's budget shared by weight, no more than cap each.

    Children are taken by cap to weight; those whose part of what is left
    covers their cap are full, the others share the rest in whole tokens,
    rounded down.
    """
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = of.orderBy(F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight"))
                         .otherwise(F.lit(float("inf"))), name)
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    wide = "decimal(19,0)"
    judged = nodes.withColumn("full", (F.col("cap").cast(wide) * ahead.cast(wide)
                                       <= (F.col("given") - before).cast(wide) * F.col("weight").cast(wide)))
    rest = F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(of)
    return judged.withColumns({
        "__rest": rest, "__weights": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(of),
    }).withColumn("budget", F.when(F.col("full"), F.col("cap")).when(F.col("__weights") > 0, F.expr(
        f"cast(__rest as {wide}) * cast(weight as {wide}) div __weights")).otherwise(0).cast("long")
    ).drop("full", "__rest", "__weights", "given")


def allocate(leaves: DataFrame, levels: list[str], total: int) -> DataFrame:
    """Add ``budget`` to leaves (levels, one weight column __w<i> per level, cap)."""
    above = None
    for i, name in enumerate(levels):
        nodes = leaves.groupBy(*levels[:i + 1]).agg(F.sum("cap").alias("cap"), F.max(f"__w{i}").alias("weight"))
        nodes = nodes.withColumn("given", F.lit(total).cast("long")) if above is None else \
            nodes.join(above, levels[:i])
        shared = share(nodes, levels[:i], name)
        above = shared.select(*levels[:i + 1], F.col("budget").alias("given"))
    return leaves.join(above.withColumnRenamed("given", "budget"), levels)


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("__id").cast("string"), F.lit("")),
                             F.col("__digest")).cast("binary"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[Column], portion: tuple[int, int] = (1, 1),
        max_epochs: int = 4, seed: int = 2, id_col: str = "doc_id", text_col: str = "text",
        natural: bool = False, min_epochs: int = 0) -> DataFrame:
    """Rows of ``docs`` selected for the mix, once per epoch they are in.

    ``levels`` names the tree's levels (root first) with their columns,
    ``weights`` has a weight (whole number, null or less than 1: takes nothing)
    for each; the budget is ``portion`` of all tokens.  Adds the levels (those
    that are no columns already), ``epoch`` (from 0), ``n_tokens`` and
    ``take_tokens`` (fewer for the one document that a leaf's cut falls into);
    columns of the last three names are replaced, all others stay (names that
    begin with ``__`` are used in between).

    With ``natural`` a node's weight is its number of tokens in ``docs`` times
    the weight given, so that equal weights and all tokens as the budget select
    every document once.  A leaf with weights gets ``min_epochs`` whole passes at
    least, whatever its share: where the shares cover them but for the rounding
    down on the way to the leaf, that spends what the rounding left over.

    A null level is the node ''.  Texts without a token (null, empty) are never
    selected.  Rows that repeat id and text are each a document of their own;
    which of them a cut falls between makes no difference.  Texts are counted
    and cut whole, however long.  An empty table, or no budget, gives an empty
    result.  The children of one node of the tree are shared out in one task:
    nodes (sources and their like), not documents.
    """
    names = list(levels)
    columns = others(docs, [*names, "epoch", "n_tokens", "take_tokens"])
    inner = [f"__l{i}" for i in range(len(names))]
    based = docs.withColumns({
        **{c: F.coalesce(levels[n].cast("string"), F.lit("")) for c, n in zip(inner, names)},
        **{f"__w{i}": F.greatest(F.coalesce(w.cast("long"), F.lit(0)), F.lit(0)) for i, w in enumerate(weights)},
        "__id": F.col(id_col), "__n": count_tokens(F.col(text_col)),
        "__digest": F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")),
    }).filter("__n > 0")
    narrow = materialize(based.select(*inner, *[f"__w{i}" for i in range(len(names))], "__id", "__n", "__digest"), "mix")
    usable = F.least(*[F.min(f"__w{i}") for i in range(len(names))], F.lit(1)) > 0 if len(names) > 1 else \
        F.min("__w0") > 0
    leaves = materialize(narrow.groupBy(*inner).agg(
        F.sum("__n").alias("tokens"), *[F.max(f"__w{i}").alias(f"__w{i}") for i in range(len(names))],
        usable.alias("usable")).withColumn("cap", F.when(F.col("usable"), F.col("tokens") * max_epochs).otherwise(0)),
        "leaves")
    if natural:
        leaves = leaves.withColumns({f"__w{i}": F.col(f"__w{i}") * F.sum("tokens").over(Window.partitionBy(*inner[:i + 1]))
                                     for i in range(len(names))})
    all_tokens, most = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("cap"), F.lit(0))).first()
    total = min(all_tokens * portion[0] // portion[1], most)
    budget = F.greatest("budget", F.when(F.col("usable"), F.col("tokens") * min_epochs).otherwise(0))
    plan = materialize(allocate(leaves, inner, total).withColumn("budget", budget).select(
        *inner, F.expr("budget div tokens").alias("__whole"), (F.col("budget") % F.col("tokens")).alias("__short")), "plan")

    # the cut: the slice of keys it is in, the slice of that, then the key
    inside = narrow.join(plan.filter("__short > 0"), inner).withColumn("__key", _key(seed, F.col("__whole"))) \
        .select(*inner, "__short", "__key", "__n", F.lit(0).cast("long").alias("base"))
    upto = Window.partitionBy(*inner).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    for digits in SLICE_DIGITS:
        cut = inside.withColumn("__slice", F.substring("__key", 1, digits))
        slices = cut.groupBy(*inner, "__slice", "__short", "base").agg(F.sum("__n").alias("n")).withColumn(
            "below", F.col("base") + F.sum("n").over(upto) - F.col("n")).filter("below < __short and below + n >= __short")
        inside = cut.drop("base").join(slices.select(*inner, "__slice", F.col("below").alias("base")),
                                       [*inner, "__slice"]).drop("__slice")
    peers = Window.partitionBy(*inner).orderBy("__key").rangeBetween(Window.unboundedPreceding, 0)
    cuts = inside.groupBy(*inner, "__short", "base", "__key").agg(F.sum("__n").alias("n")).withColumn(
        "upto", F.col("base") + F.sum("n").over(peers)).filter("upto >= __short").groupBy(*inner).agg(
        F.min("__key").alias("__cut"), F.min_by(F.expr("__short - (upto - n)"), "__key").alias("__room"))
    rules = materialize(plan.join(cuts, inner, "left"), "rules")

    ruled = based.join(rules, inner).withColumn("__key", _key(seed, F.col("__whole")))
    tree = [F.col(n) if n in docs.columns else F.col(c).alias(n) for c, n in zip(inner, names)]

    def out(rows: DataFrame, epoch: Column, take: Column) -> DataFrame:
        return rows.select(*columns, *tree, epoch.cast("int").alias("epoch"), F.col("__n").alias("n_tokens"),
                           take.cast("long").alias("take_tokens"))
    # whole epochs, and the documents before the cut, need no neighbour
    last = F.col("__whole") - F.when(F.coalesce(F.col("__key") < F.col("__cut"), F.lit(False)), 0).otherwise(1)
    epochs = F.sequence(F.lit(0).cast("long"), last)
    plain = ruled.filter(last >= 0).withColumn("__epoch", F.explode(epochs))
    # rows at the cut share its room one after the other
    at_cut = ruled.filter("__key = __cut").withColumn("__before", F.col("__n") * (F.row_number().over(
        Window.partitionBy(*inner).orderBy("__key")) - 1))
    taken = F.least(F.col("__n"), F.col("__room") - F.col("__before"))
    return out(plain, F.col("__epoch"), F.col("__n")).unionByName(
        out(at_cut.filter("__before < __room"), F.col("__whole"), taken))


def cut_text(text: Column, n_tokens: Column, take: Column) -> Column:
    """The text, or its first ``take`` words joined by spaces if it has more."""
    words = F.split(F.btrim(text, F.lit(WHITE)), SPLIT)
    return F.when(take < n_tokens, F.array_join(F.slice(words, 1, take.cast("int")), " ")).otherwise(text)
