"""Temperature mixing of sources, with DataFrame functions only.

A source's share p is its part of all tokens (words and one end per document). Weights are p**a / sum(p**a).
The exponent a is bisected: in [0, 1] to the smallest (flattest) one at which no source is passed more often than
a repetition limit, or in [0, 64] to a target entropy of the weights. Each pass over the source table evaluates all
fifteen midpoints of four bisection steps in one aggregate. A limit or target that can't be met is refused with a
ValueError; the limit holds for a target entropy too.

The weights are realised as block permutations under a token budget. A source's documents are dealt by hash
into blocks of about block_tokens; each epoch orders the blocks by a hash of their own, and documents inside
a block by another. A source gets as many whole epochs as its quota holds, then the start of one more up to
the last document that fits, so no quota is passed; only a source that would be left empty has its first document
whole. Without a budget it is the least at which every source is passed once, so
that no document is dropped. `slot` orders the whole mixture: sources advance through it in proportion.

Rows with a null source form the source ''. Null and empty texts have one token. Repeated rows are dealt
alike and each kept. An empty table gives no rows. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch, columns

#: Largest ratio of a source's passes to those of the least repeated source; tokens in a block.
REPEATS, BLOCK_TOKENS, SEED = 2.0, 1 << 16, "mix1"
#: Largest exponent that a target entropy may need.
STEEPEST = 64.0
#: Low bits of a block's 60-bit hash that don't tell its slice: 4,096 slices of a pass are summed before the blocks of one.
SLICE_BITS = 48


def tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def spread(*parts: Column) -> Column:
    """A number below 2**60 from md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("long")


def bisect(sources: DataFrame, target_entropy: float | None, repeats: float, budget: float | None, steps: int = 8) -> float:
    """The exponent, to 2**-32 of its range, rounded up to six digits. sources: p, n."""
    total, least, most, k = sources.agg(F.sum("n"), F.min("p"), F.max("p"), F.count("*")).first()
    if not total:
        return 1.0
    scale = 1.0 if budget is None else budget / total
    q = F.col("p") / F.lit(most)  # relative to the largest share, so that no power vanishes from every sum

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """For each: the sum of q**a, and that of q**a * ln q."""
        row = sources.agg(*[c for a in exponents for c in (F.sum(F.pow(q, F.lit(a))), F.sum(F.pow(q, F.lit(a)) * F.log(q)))]).first()
        return [(row[2 * j], row[2 * j + 1]) for j in range(len(exponents))]

    def passes(a: float, z: float) -> float:
        """The largest number of passes; without a budget the least one is 1."""
        steep = max(1.0, (least / most) ** (a - 1))  # the largest q**(a - 1)
        return steep / min(1.0, (least / most) ** (a - 1)) if budget is None else scale * steep / (z * most)

    def entropy(a: float, z: float, dot: float) -> float:
        return math.log(z) - a * dot / z

    def reached(a: float, z: float, dot: float) -> bool:
        return entropy(a, z, dot) <= target_entropy if target_entropy is not None else passes(a, z) <= repeats

    low, high = 0.0, 1.0
    (z, dot), (steep_z, steep_dot) = sums([1.0, STEEPEST])
    if target_entropy is None:
        if passes(1.0, z) > repeats * (1 + 1e-9):
            raise ValueError(f"{budget} tokens are {scale:.3f} passes of all sources, above the repetition limit {repeats}")
    elif not entropy(STEEPEST, steep_z, steep_dot) <= target_entropy + 1e-3 or target_entropy > math.log(k) + 1e-9:
        raise ValueError(f"{k} sources can't be given an entropy of {target_entropy}")
    elif not reached(1.0, z, dot):
        low, high = 1.0, STEEPEST
    for _ in range(0 if least == most else steps):
        mids = [low + (high - low) * j / 16 for j in range(1, 16)]
        ok = [reached(a, *x) for a, x in zip(mids, sums(mids), strict=True)]
        at, width = 0, 16
        while width > 1:  # four steps of bisection
            width //= 2
            if not ok[at + width - 1]:
                at += width
        low, high = low + (high - low) * at / 16, low + (high - low) * (at + 1) / 16
    a = -(-round(high * 1e6, 3) // 1) / 1e6
    if target_entropy is not None and (most_passes := passes(a, sums([a])[0][0])) > repeats * (1 + 1e-6):
        raise ValueError(f"an entropy of {target_entropy} takes {most_passes:.3f} passes of a source, above the repetition limit {repeats}")
    return a


def plan_mix(docs: DataFrame, scratch: Scratch, target_entropy: float | None = None, repeats: float = REPEATS, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source: its weight, its passes and where the last pass ends."""
    t = scratch.keep(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens().alias("n_tokens"), spread(F.col("doc_id")).alias("h")), "tokens")
    sources = scratch.keep(t.groupBy("source").agg(F.sum("n_tokens").alias("n")), "sources")
    total = sources.agg(F.sum("n")).first()[0] or 1
    sources = sources.withColumn("p", F.col("n") / F.lit(float(total)))
    a = bisect(sources, target_entropy, repeats, budget)
    z, largest = sources.agg(F.sum(F.pow("p", F.lit(a))), F.max(F.pow("p", F.lit(1 - a)))).first()
    passes = F.pow("p", F.lit(a - 1)) * F.lit(largest or 1.0) if budget is None else F.pow("p", F.lit(a - 1)) * F.lit(budget / total / (z or 1.0))
    plan = sources.select(
        "source", "n", F.lit(a).alias("exponent"), F.round(F.pow("p", F.lit(a)) / F.lit(z or 1.0), 9).alias("weight"), F.round(passes, 6).alias("passes"), F.ceil(F.col("n") / F.lit(block_tokens)).cast("long").alias("n_blocks")
    ).withColumn("whole", F.floor("passes").cast("long")).withColumn("rest", F.floor((F.col("passes") - F.col("whole")) * F.col("n")).cast("long"))
    plan = scratch.keep(plan, "plan")
    # blocks of the last, partial pass in their order; the block, then the document, at which the quota is reached
    dealt = t.join(plan.where("rest > 0").select("source", "n_blocks", "whole", "rest"), "source").withColumn("block", F.col("h") % F.col("n_blocks"))
    sums = dealt.groupBy("source", "block", "whole", "rest").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("key", spread(F.col("source"), F.col("block"), F.col("whole") + 1))
    sums = scratch.keep(sums.withColumn("slice", F.shiftright("key", SLICE_BITS)), "blocks")
    reached = "before < rest and rest <= before + n_tokens"

    def before(*by: str) -> Column:
        return F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # the slice of the hashes first, so that no task orders all blocks of a source
    slices = sums.groupBy("source", "slice", "rest").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("before", before("slice")).where(reached)
    last = sums.join(slices.select("source", "slice", F.col("before").alias("base")), ["source", "slice"])
    last = last.withColumn("before", F.col("base") + before("key", "block")).where(reached).select("source", "block", "key", "before")
    inside = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.expr("before + n_tokens <= rest or (whole = 0 and before = 0)")
    none = F.struct(F.lit(-1).cast("long").alias("h"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"))  # before all of the block
    cut = (
        dealt.join(last, ["source", "block"])
        .withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .groupBy("source", "block", "key").agg(F.coalesce(F.max(F.when(fits, F.struct("h", "doc_id"))), none).alias("end"))
    )
    return scratch.keep(plan.join(cut.select("source", F.struct("key", "block", "end.h", "end.doc_id").alias("cut")), "source", "left"), "cuts")


def realise(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents of the mixture, once per pass, with the columns `mix` struct: source, n_tokens, epoch, block, weight, exponent, slot."""
    rows = docs.select(F.struct(*columns(docs)).alias("doc"), F.coalesce("source", F.lit("")).alias("source"), spread(F.col("doc_id")).alias("h"))
    rows = rows.join(plan, "source").withColumn("block", F.col("h") % F.col("n_blocks"))
    here = F.struct(spread(F.col("source"), F.col("block"), F.col("whole") + 1).alias("key"), "block", "h", F.col("doc.doc_id").alias("doc_id"))
    more = F.when(F.col("cut").isNotNull() & (here <= F.col("cut")), 1).otherwise(0)
    rows = rows.withColumn("times", F.col("whole").cast("int") + more).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times"))))
    key = spread(F.col("source"), F.col("block"), F.col("epoch"))
    part = F.when(F.col("epoch") > F.col("whole"), F.col("passes") - F.col("whole")).otherwise(1.0)  # of a pass that this one takes
    slot = F.round((F.col("epoch") - 1 + key / F.lit(float(1 << 60)) * part) / F.col("passes"), 9)
    return rows.select("doc", F.struct("source", F.col("epoch").cast("long").alias("epoch"), "block", "weight", "exponent", slot.alias("slot"), "h").alias("mix"))


def mix_table(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, weight, exponent, slot for each document of the mixture, once per pass."""
    plan = plan_mix(docs, Scratch(docs.sparkSession), **how)
    small = docs.select("doc_id", "source", tokens().alias("n_tokens"))
    return realise(small, plan).select("doc.doc_id", "mix.source", "doc.n_tokens", "mix.epoch", "mix.block", "mix.weight", "mix.exponent", "mix.slot")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs in the mixture, once per pass, with the columns of docs."""
    return realise(docs, plan_mix(docs, Scratch(docs.sparkSession), **how)).select("doc.*")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens,
    ('0x' || substr(md5('mix1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS n FROM t GROUP BY source),
p AS (SELECT source, n, n / (sum(n) OVER ())::DOUBLE AS p FROM s),
a AS (SELECT CASE WHEN min(p) = max(p) THEN 1.0 ELSE greatest(0, ceil(1e6 * (1 - ln(2.0) / ln(max(p) / min(p)))) / 1e6) END AS a, max(p) AS top FROM p),
w AS (
  SELECT source, n, a AS exponent, round(pow(p, a) / sum(pow(p, a)) OVER (), 9) AS weight, round(pow(p, a - 1) * pow(top, 1 - a), 6) AS passes,
    ceil(n / 65536)::BIGINT AS n_blocks FROM p, a),
x AS (SELECT *, floor(passes)::BIGINT AS whole, floor((passes - floor(passes)) * n)::BIGINT AS rest FROM w),
d AS (
  SELECT t.*, exponent, weight, passes, whole, rest, h % n_blocks AS block,
    ('0x' || substr(md5('mix1:' || t.source || ':' || (h % n_blocks) || ':' || (whole + 1)), 1, 15))::BIGINT AS k
  FROM t JOIN x USING (source)),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY k, block, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
e AS (SELECT *, unnest(range(1, (whole + 1 + CASE WHEN before + n_tokens <= rest THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM o)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, epoch::BIGINT AS epoch, block::BIGINT AS block, weight, exponent,
  round((epoch - 1 + ('0x' || substr(md5('mix1:' || source || ':' || block || ':' || epoch), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE * CASE WHEN epoch > whole THEN passes - whole ELSE 1.0 END) / passes, 9) AS slot
FROM e
"""
