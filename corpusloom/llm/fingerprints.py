"""Document fingerprints by consistent weighted sampling with gamma variates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, persist_to_shared

#: Samples of a fingerprint: so many rounds of so many.
ROUNDS, TOGETHER = 8, 8
#: Documents that stand together to find each one's neighbour.
BLOCK = 64


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _uniform(bits: Column) -> Column:
    """A number in (0, 1) from the low 32 bits."""
    return (bits.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) / F.lit(float(1 << 32))


def signatures(weights: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """``keys`` and one array of ``ROUNDS x TOGETHER`` ints for each column of ``sides``.

    ``weights`` has a row for each key and term: ``term`` (its 64-bit hash) and a count for each side, null or 0 where the
    term is absent. For each sample a term draws r and c from Gamma(2, 1) and b from [0, 1) by its hash, and with weight S
    has t = floor(ln S / r + b), ln y = r (t - b) and ln a = ln c - ln y - r. The term with the smallest a is the sample; a
    follows from term and t, so its value stands for both. Two documents agree in a sample with the probability of their
    generalised Jaccard similarity. A key without terms on a side has a null there.
    """
    rows = weights.withColumn("round", F.explode_outer(F.array(*map(F.lit, range(ROUNDS)))))
    draws = []
    for i in range(TOGETHER):
        one, two, three = (F.xxhash64("term", "round", F.lit(3 * i + k)) for k in range(3))
        draws += [
            (-F.ln(_uniform(one) * _uniform(F.shiftright(one, 32)))).alias(f"r{i}"),
            F.ln(-F.ln(_uniform(two) * _uniform(F.shiftright(two, 32)))).alias(f"c{i}"),
            _uniform(three).alias(f"b{i}"),
        ]
    logs = [F.when(F.col(s) > 0, F.ln(F.col(s).cast("double"))).alias(f"ln_{s}") for s in sides]
    drawn = rows.select(*keys, "round", *logs, *draws)
    least = []
    for s in sides:
        for i in range(TOGETHER):
            r, c, b = F.col(f"r{i}"), F.col(f"c{i}"), F.col(f"b{i}")
            t = F.floor(F.col(f"ln_{s}") / r + b)
            least.append(F.min(c - r * (t - b) - r).alias(f"{s}_{i}"))
    found = drawn.groupBy(*keys, "round").agg(*least)
    code = lambda name: F.xxhash64(name).bitwiseAND(F.lit(0xFFFFFFFF))
    found = found.select(
        *keys, "round", *[F.when(F.col(f"{s}_0").isNotNull(), F.array(*[code(f"{s}_{i}") for i in range(TOGETHER)])).alias(s) for s in sides]
    )
    return found.groupBy(*keys).agg(*[_in_order(s) for s in sides])


def _in_order(side: str) -> Column:
    """The samples of all rounds, at most ``ROUNDS`` rows a key."""
    rounds = F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("round", side))))
    return F.flatten(F.transform(rounds, lambda x: x[side])).alias(side)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two empty texts, 0 for an empty and another."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(ROUNDS * TOGETHER))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def as_text(samples: Column) -> Column:
    """Eight hex digits for each sample."""
    return F.concat_ws("", F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def _next_blocks(blocks: DataFrame, fan: int = 4096) -> DataFrame:
    """``block, next_block`` from distinct blocks: the next lower one, and the highest after the lowest.

    Neighbours are found within stretches of ``fan`` block numbers; one row of each stretch meets the others in one window.
    """
    part = F.floor(F.col("block") / fan)
    inner = blocks.withColumn("part", part).withColumn("below", F.lead("block").over(Window.partitionBy("part").orderBy(F.desc("block"))))
    tops = blocks.groupBy(part.alias("part")).agg(F.max("block").alias("top"))
    line = Window.orderBy(F.desc("part"))
    tops = tops.select("part", F.coalesce(F.lead("top").over(line), F.max("top").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_top"))
    return inner.join(tops, "part").select("block", F.coalesce("below", "next_top").alias("next_block"))


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: Callable[[Column], Column] = words) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The next document has the next lower id; after the lowest comes the highest, and a single row is its own next. The
    edited text has its last third of code points replaced by as many first ones of the next text (all, if it has fewer).
    Terms are lower-case words, weighted by how often they occur. Null text is empty; an empty text has the fingerprint "".
    A null id comes after all others, rows that repeat an id are ordered by a hash of their text. Other columns are ignored;
    an empty table gives an empty one.

    Documents are dealt by stretches of ids of about ``BLOCK`` documents. In that one layout the next text is a window
    function, and term counts and samples are aggregates without another exchange.
    """
    low, high, n = docs.agg(F.min(id_col), F.max(id_col), F.count("*")).first()
    low, high = (low or 0), (high or 0)
    width = max(1, (high - low + 1) * BLOCK // max(n, 1))
    doc_id = F.col(id_col).cast("long")
    keyed = docs.select(
        doc_id.alias("doc_id"), filled(text_col).alias("text"), F.coalesce(F.floor((doc_id.cast("double") - F.lit(float(low))) / F.lit(float(width))), F.lit(-1)).cast("long").alias("block")
    ).withColumn("mark", F.xxhash64("text"))
    blocks = persist_to_shared(_next_blocks(keyed.select("block").distinct()), "print-blocks")
    heads = keyed.groupBy("block").agg(F.max_by("text", F.struct("doc_id", "mark")).alias("donor"))
    donors = blocks.join(heads.withColumnRenamed("block", "next_block"), "next_block").select("block", "donor")
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.desc("mark"))
    seq = keyed.withColumn("place", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))
    seq = seq.join(donors, "block").withColumn("last", F.col("after").isNull()).withColumn("after", F.coalesce("after", "donor"))
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    seq = seq.withColumn("edited", F.concat(F.substring("text", F.lit(1), size - third), F.substring("after", F.lit(1), third)))
    # outer explodes: the plain ones would have the words split once more below, to test for empty arrays
    sides = seq.select("block", "place", F.posexplode_outer(F.array(terms(F.col("text")), terms(F.col("edited")))).alias("side", "words"))
    each = sides.select("block", "place", "side", F.explode_outer("words").alias("word")).where(F.col("word").isNotNull())
    weights = each.groupBy("block", "place", F.xxhash64("word").alias("term")).agg(
        F.count_if(F.col("side") == 0).alias("fingerprint"), F.count_if(F.col("side") == 1).alias("edited_fingerprint")
    )
    prints = signatures(weights, ["block", "place"], ["fingerprint", "edited_fingerprint"])
    facts = seq.select("block", "place", "doc_id", "last", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    none = F.array().cast("array<bigint>")
    made = facts.join(prints, ["block", "place"], "left")
    made = made.withColumn("fingerprint", F.coalesce("fingerprint", none)).withColumn("edited_fingerprint", F.coalesce("edited_fingerprint", none))
    made = made.withColumn("following", F.lead("fingerprint").over(Window.partitionBy("block").orderBy("place")))
    made = persist_to_shared(made, "print-rows")
    first = made.where("place = 1").select(F.col("block").alias("next_block"), F.col("fingerprint").alias("head"))
    ends = made.where("last").join(blocks, "block").join(first, "next_block").withColumn("following", F.col("head"))
    out = made.where("not last").unionByName(ends.select(*made.columns))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )
