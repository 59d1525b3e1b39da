"""Mixing sources to target weights, in DataFrame functions only.

Temperature mixing: a source of token share p gets the weight p^a / sum(p^a). The exponent a, from 0
(all sources alike) to 1 (as they are), is found by bisection, six halvings a pass: the largest one
whose weights have the target entropy, raised as far as the limit on repetitions demands. With a
budget of tokens, a source of weight w is due w * budget of them: whole passes over its documents,
then a part of a pass.

Documents are dealt to blocks of their source by a hash. Each pass takes a source's blocks in another
permutation; the last, partial pass takes blocks in its permuted order while the budget lasts, and
within the block at the border documents in a permuted order, never more than is due. There are at
most MAX_BLOCKS blocks and one for each source, whatever the input, so the plan of blocks is small,
and no window runs over a whole source.

All hashes are MD5 of plain strings, so that other engines can realise the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import written

BLOCK_TOKENS, MAX_BLOCKS = 100_000, 65_536
HALVINGS, PASSES = 6, 4
#: Rows of the plan of blocks that may be broadcast.
BROADCAST_ROWS = 200_000


def tokens(text: Column) -> Column:
    """Words of a text: runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def _digits(*parts: Column) -> Column:
    """A number below 2^32 from the MD5 of the parts joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def _order(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def exponent(shares: DataFrame, entropy: float, repeats: float) -> float:
    """The exponent for shares (p > 0): see the module. entropy is a part (0 to 1) of the greatest possible.

    Each pass is a sum over (sources x 63 exponents); one row comes back.
    """
    def solve(good) -> tuple[float, float]:
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            step = (high - low) / (1 << HALVINGS)
            at = shares.select("p", F.explode(F.sequence(F.lit(1), F.lit((1 << HALVINGS) - 1))).alias("k"))
            at = at.withColumn("a", F.lit(low) + F.col("k") * F.lit(step))
            power = F.exp(F.col("a") * F.ln("p"))
            curve = at.groupBy("k", "a").agg(
                F.sum(power).alias("z"), F.sum(power * F.ln("p")).alias("s"), F.max("p").alias("most"), F.min("p").alias("least"), F.count("*").alias("n")
            )
            lower = curve.agg(F.max(F.when(good, F.col("k")))).first()[0] or 0
            low, high = low + lower * step, low + (lower + 1) * step
        return low, high

    # entropy falls as a grows: keep the largest a that reaches the target
    reached = F.ln("z") - F.col("a") * F.col("s") / F.col("z") >= F.lit(entropy) * F.ln("n")
    by_entropy, _ = solve(reached)
    # with the largest source taken once, the smallest is repeated (least / most)^(a - 1) times, which falls as a grows
    _, by_repeats = solve(F.exp((F.col("a") - 1) * (F.ln("least") - F.ln("most"))) > F.lit(repeats))
    small = shares.agg(F.min("p"), F.max("p")).first()
    if small[0] is None:
        return 1.0
    return max(by_entropy, by_repeats if small[1] > small[0] * repeats else 0.0)


def weights(sources: DataFrame, entropy: float = 0.9, repeats: float = 4.0, budget: int | None = None) -> DataFrame:
    """sources (source, tokens) with share, exponent, weight, due (tokens) and passes added.

    Without a budget it is what the weights need for the largest source to be taken once and whole,
    so that none is cut. With a budget, the largest source may be cut; repetitions are then limited
    for each source by taking no more than repeats passes of it. Sources without tokens have weight 0.
    """
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    some = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(max(1, total)))).alias("p"))
    a = exponent(some, entropy, repeats)
    share = F.col("tokens") / F.lit(float(max(1, total)))
    power = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * F.ln(share))).otherwise(0.0)
    sums = sources.select("tokens", power.alias("w")).agg(F.sum("w"), F.max("tokens"), F.max("w")).first()
    z, most, top = (float(x or 1) for x in sums)
    # due = weight * budget; without a budget the top source is due its tokens
    scale = F.lit(most / top) if budget is None else F.lit(budget / z)
    due = F.floor(power * scale + F.lit(1e-6)).cast("long")
    due = F.when(F.col("tokens") > 0, F.least(due, F.floor(F.col("tokens") * F.lit(float(repeats))))).otherwise(0)
    due = due if budget is not None else F.greatest(due, F.col("tokens"))
    return sources.select(
        "source", "tokens", share.alias("share"), F.lit(a).alias("exponent"), (power / F.lit(z)).alias("weight"), due.alias("due"),
        F.when(F.col("tokens") > 0, F.floor(due / F.col("tokens"))).otherwise(1).cast("long").alias("passes"),
    )


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    text = F.col("doc_id").cast("string")
    return docs.select(
        name(F.col("source")).alias("source"), tokens(F.col("text").cast("string")).alias("n"), _digits(F.lit(str(seed)), F.coalesce(text, F.lit(""))).alias("u"),
        _order(F.lit(f"{seed}-last"), F.coalesce(text, F.lit(""))).alias("place"),
    )


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is known to be small; else joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def plan(docs: DataFrame, entropy: float = 0.9, repeats: float = 4.0, budget: int | None = None, seed: int = 1, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks): weights() with the number of blocks; and for each (source, block) its passes and cut.

    A document of the block is taken passes times, and once more if its place (an MD5) is <= cut.
    """
    narrow = written(_keyed(docs, seed), "mixing")
    sources = narrow.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    sources = written(sources, "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    size = max(block_tokens, -(-total // MAX_BLOCKS))
    named = weights(sources.select("source", "tokens"), entropy, repeats, budget).withColumn("blocks", F.ceil(F.greatest(F.col("tokens"), F.lit(1)) / F.lit(size)).cast("long"))
    named = written(named, "weights")
    dealt = narrow.join(_small(named.select("source", "blocks", "tokens", "due", "passes")), "source").withColumn("block", F.pmod("u", "blocks"))
    blocks = written(dealt.groupBy("source", "block").agg(F.sum("n").alias("n"), F.any_value("passes").alias("passes"), F.any_value("due").alias("due"), F.any_value("tokens").alias("tokens")), "plan")
    # the partial pass: blocks in permuted order until what is left of the due tokens is met
    order = W.partitionBy("source").orderBy(_order(F.lit(str(seed)), F.col("passes").cast("string"), F.col("source"), F.col("block").cast("string")), "block")
    blocks = blocks.withColumn("rest", F.col("due") - F.col("passes") * F.col("tokens")).withColumn("end", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    blocks = blocks.withColumn("left", F.col("rest") - (F.col("end") - F.col("n")))  # of the due tokens, before this block
    border = blocks.where("left > 0 and left < n").select("source", "block", "left")
    inside = dealt.select("source", "block", "place", "n").join(border, ["source", "block"])
    upto = F.sum("n").over(W.partitionBy("source", "block").orderBy("place").rangeBetween(W.unboundedPreceding, 0))
    cuts = inside.withColumn("upto", upto).where("upto <= left").groupBy("source", "block").agg(F.max("place").alias("cut"))
    cut = F.when(F.col("left") <= 0, F.lit("")).when(F.col("left") >= F.col("n"), F.lit("~")).otherwise(F.coalesce("cut", F.lit("")))
    return named, blocks.join(cuts, ["source", "block"], "left").select("source", "block", "passes", cut.alias("cut"))


def mix(docs: DataFrame, entropy: float = 0.9, repeats: float = 4.0, budget: int | None = None, seed: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs, each row as often as the mix takes it, with the columns mix_pass, mix_block and mix_order added.

    docs has doc_id, text and source and any other columns, which are kept; the three that are added
    replace columns of those names. mix_pass counts from 0, mix_order is the place of the row's block
    in that pass's permutation of its source, as an MD5 to sort by. Null and blank texts have no tokens:
    they are taken with every whole pass, and with the partial one if their place falls into it. A null
    source is the source with the empty name. Rows that repeat a doc_id share its place: a budget takes
    them together or not at all. A source without tokens is taken once. An empty table stays empty.
    """
    named, blocks = plan(docs, entropy, repeats, budget, seed, block_tokens)
    count = _small(written(named.select(F.col("source").alias("_source"), F.col("blocks").alias("_blocks")), "counts"))
    per_block = _small(written(blocks.select(F.col("source").alias("_source"), F.col("block").alias("mix_block"), F.col("passes").alias("_passes"), F.col("cut").alias("_cut")), "cuts"))
    added = ("mix_pass", "mix_block", "mix_order")
    base = docs.drop(*added)
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = base.withColumn("_source", name(F.col("source"))).withColumn("_u", _digits(F.lit(str(seed)), text)).withColumn("_place", _order(F.lit(f"{seed}-last"), text))
    dealt = keyed.join(count, "_source").withColumn("mix_block", F.pmod("_u", "_blocks")).join(per_block, ["_source", "mix_block"])
    times = F.col("_passes") + (F.col("_place") <= F.col("_cut")).cast("long")
    # sequence(1, 0) would count down, so that rows taken never are left out first
    out = dealt.where(times > 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    out = out.withColumn("mix_order", _order(F.lit(str(seed)), F.col("mix_pass").cast("string"), F.col("_source"), F.col("mix_block").cast("string")))
    return out.select(*base.columns, *added)
