"""Mixing sources to target weights by Pareto order sampling of whole documents.

Every source gets a target of words. Within a source a document's expected copies are its source's rate
times a damped measure of its length, at most ``most`` (so inclusion probabilities differ). The whole part
of that number is allotted with certainty; the fraction is its inclusion probability for one more copy.
Documents are ranked by random odds over inclusion odds, u/(1-u) : p/(1-p), and the least are taken until
the words still missing are found. The last document is the one that fits the gap best.

The cut along the ranking is found by counting words in ranges of rank, so no source is ever sorted whole:
ranges and the rows of the range with the cut are both about the square root of the source's rows.

Documents are taken whole, so a source comes as near its target as the sizes of its documents allow.

Random numbers are hashes of seed and doc_id, and for rows without doc_id or with a repeated one also of source, text and
a number among rows equal in these, so reruns agree and each row is drawn for itself. A null text has no words. A null source is a
source of its own, last in order. Sources without words get target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitloom.llm.tables import stored

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
#: A document 2**8 times longer has half the rate.
DAMPING = 8.0


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """``sizes`` (key, size): one row per source with its rank's weight and its target of words.

    Weights 1, 2, 3 repeat by rank. The excess over ``most`` times a source's size is reshared by weight
    until none is above; each round is one aggregate that brings two numbers back.
    """
    ranged = sizes.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)))
    before = ranged.groupBy("part").count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = stored(
        ranged.join(F.broadcast(before.select("part", "before")), "part")  # one row per partition
        .select("key", F.col("size").cast("double").alias("size"), (F.pmod(F.col("before") + F.col("at"), F.lit(3)) + 1).cast("double").alias("weight")))
    total = ranked.agg(F.sum("size")).first()[0] or 0.0
    level = 0.0
    while True:
        capped = most * F.col("size") <= level * F.col("weight")
        row = ranked.agg(F.sum(F.when(capped, most * F.col("size")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        raised = (total - row[0]) / row[1] if row[1] else level
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return ranked.select("key", "size", "weight", F.least(most * F.col("size"), F.lit(level) * F.col("weight")).alias("target"))


def _rates(classes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Per source and length class the expected copies, so that the words of a source add up to its target.

    A source has at most 40 length classes; shorter ones have higher measures, so they reach ``most`` first.
    """
    shorter = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.partitionBy("key").orderBy("class").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy("key")
    rows = (
        classes.join(targets.select("key", "target"), "key")
        .withColumn("measure", F.pow(F.lit(2.0), -F.col("class") / DAMPING))
        .withColumn("full", F.coalesce(F.sum("words").over(shorter), F.lit(0.0)) * most)
        .withColumn("open", F.sum(F.col("words") * F.col("measure")).over(longer))
        .withColumn("factor", (F.col("target") - F.col("full")) / F.col("open"))
        # classes before the first one that stays within the bound are full
        .withColumn("factor", F.min(F.when(F.col("factor") * F.col("measure") <= most, F.struct("class", "factor"))).over(whole))
    )
    copies = F.when(F.col("factor").isNull() | (F.col("class") < F.col("factor.class")), F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("factor.factor") * F.col("measure"))))
    return rows.select("key", "class", copies.alias("expected"))


#: What tells rows apart that are drawn; rows equal in these are told apart by a number.
_SAME = ["doc_id", "key", "hash"]
#: Tasks among which equal rows are numbered.
_DEALT = 64


def _identity() -> list[Column]:
    """doc_id, source key and text hash of a row."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    return [F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("hash")]


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (stored) with ``among``: null where a doc_id names one row, else a number that differs among rows equal in _SAME."""
    deal = F.pmod(F.col("row"), F.lit(_DEALT))
    several = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    dealt = several.select(F.col("doc_id").alias("_id"), F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1))).alias("_to"))
    repeated = rows.join(dealt, (F.col("doc_id") == F.col("_id")) & (deal == F.col("_to")), "left_semi").unionByName(rows.where(F.col("doc_id").isNull()))
    order = Window.partitionBy(*_SAME, "_deal").orderBy("row")
    numbers = stored(repeated.withColumn("_deal", deal).select("row", (F.row_number().over(order) * _DEALT + F.col("_deal")).alias("among")))
    return rows.join(numbers, "row", "left")


def mixed(docs: DataFrame, seed: int = 1, most: float = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken."""
    return _plan(docs, seed, most).drop("key", "hash", "certain")


def _plan(docs: DataFrame, seed: int, most: float) -> DataFrame:
    rows = stored(
        docs.select(*_identity(), word_count("text").alias("size"), F.monotonically_increasing_id().alias("row"))
        .withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(0).cast("int")))
    classes = stored(rows.groupBy("key", "class").agg(F.sum("size").cast("double").alias("words"), F.count("*").alias("n")))
    targets = stored(source_targets(classes.groupBy("key").agg(F.sum("words").alias("size")), most))
    rates = stored(_rates(classes, targets, most))
    spread = targets.join(classes.groupBy("key").agg(F.ceil(F.sqrt(F.sum("n"))).cast("long").alias("ranges")), "key")

    drawn = F.when(F.col("among").isNull(), F.xxhash64(F.lit(seed), "doc_id")).otherwise(F.xxhash64(F.lit(seed), "doc_id", "key", "hash", "among"))
    u = (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5) / float(1 << 53)
    p = F.col("expected") - F.floor("expected")
    odds = (u / (1 - u)) / (p / (1 - p))
    plan = stored(
        _numbered(rows).join(rates, ["key", "class"]).join(spread.select("key", F.col("size").alias("source_size"), "target", "ranges"), "key")
        .withColumn("certain", F.floor("expected").cast("long"))
        .withColumn("rank", F.when((p > 0) & (F.col("size") > 0), odds / (1 + odds)))
        .withColumn("range", F.floor(F.col("rank") * F.col("ranges")).cast("long"))
        .drop("class", "expected", "ranges"))

    certain = plan.groupBy("key").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("wanted"))
    ranges = plan.where(F.col("rank").isNotNull()).groupBy("key", "range").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("range"))
    cut = (
        ranges.withColumn("upto", upto).join(certain, "key")
        .groupBy("key")
        .agg(
            F.min(F.when(F.col("upto") > F.col("wanted"), F.struct("range", (F.col("upto") - F.col("words")).alias("before")))).alias("cut"),
            F.sum("words").alias("words"), F.first("wanted").alias("wanted"))
        .select("key", "wanted", F.coalesce("cut.range", F.lit(1 << 62)).alias("cut"), F.coalesce("cut.before", "words").alias("before")))
    cut = stored(cut)

    near = plan.where(F.col("rank").isNotNull()).join(cut, "key").where(F.col("range") == F.col("cut"))
    order = Window.partitionBy("key").orderBy("rank", "row")
    near = near.withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = near.where(F.col("upto") <= F.col("wanted")).groupBy("key").agg(
        F.max(F.struct("rank", "row")).alias("last"), F.max("upto").alias("reached"))
    edge = stored(cut.join(last, "key", "left").select(
        "key", "cut", "wanted", "last", F.coalesce("reached", "before").alias("reached")))

    place = F.struct("rank", "row")
    inside = F.col("rank").isNotNull() & ((F.col("range") < F.col("cut")) | ((F.col("range") == F.col("cut")) & F.coalesce(place <= F.col("last"), F.lit(False))))
    taken = plan.join(edge, "key", "left").withColumn("inside", F.coalesce(inside, F.lit(False)))
    gap = F.abs(F.col("wanted") - F.col("reached") - F.col("size"))
    fit = stored(
        taken.where(~F.col("inside") & F.col("rank").isNotNull() & (gap < F.abs(F.col("wanted") - F.col("reached"))))
        .groupBy("key").agg(F.min(F.struct(gap.alias("gap"), "rank", "row")).alias("fit")))
    extra = F.col("inside") | F.coalesce(F.col("fit.row") == F.col("row"), F.lit(False))
    copies = F.col("certain") + extra.cast("long")
    return taken.join(fit, "key", "left").select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target"),
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key", "hash", "certain")


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with its _SAME columns out of the way of a table's own names."""
    return rows.select(*[F.col(c).alias(f"__of_{c}") if c in _SAME else F.col(c).alias(f"__{c}") for c in rows.columns])


def _is_same() -> Column:
    terms = [F.col(f"__own_{c}").eqNullSafe(F.col(f"__of_{c}")) for c in _SAME]
    return terms[0] & terms[1] & terms[2]


def _allotted(held: DataFrame, several: DataFrame) -> DataFrame:
    """(__own..., __content, __times): how often each of several rows with one doc_id, source and text is taken.

    Each has its certain copies; the further ones go to the first rows by their content. Counted in buckets, so rows of one
    kind are numbered by many tasks.
    """
    own = [f"__own_{c}" for c in _SAME]
    bucket = F.pmod(F.col("__content"), F.lit(_DEALT))
    sums = held.groupBy(*own, bucket.alias("__bucket")).agg(F.sum("__m").alias("__sum"))
    until = Window.partitionBy(*own).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(until), F.lit(0))).select(*[F.col(c).alias(f"_{c}") for c in own], F.col("__bucket").alias("___bucket"), "__offset")
    inside = Window.partitionBy(*own, "__bucket").orderBy("__content").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.withColumn("__bucket", bucket).withColumn("__inside", F.coalesce(F.sum("__m").over(inside), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*own, "__bucket")]
    before = F.col("__inside") + F.col("__offset")
    further = F.col("__copies") - F.col("__n") * F.col("__certain")
    extra = F.least(F.greatest(further - before, F.lit(0)), F.col("__m"))
    return placed.join(offsets, same).join(_named(several), _is_same()).select(
        *own, "__content", (F.col("__m") * F.col("__certain") + extra).cast("int").alias("__times"))


def mix(docs: DataFrame, seed: int = 1, most: float = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    plan = stored(_plan(docs, seed, most).groupBy(*_SAME).agg(
        F.count("*").alias("n"), F.sum("copies").alias("copies"), F.max("certain").alias("certain")).where(F.col("copies") > 0))
    single, several = plan.where(F.col("n") == 1), plan.where(F.col("n") > 1)
    own = docs.select("*", *[x.alias(f"__own_{c}") for x, c in zip(_identity(), _SAME)])
    once = own.join(_named(single), _is_same()).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    # rows that share doc_id, source and text are dealt, and collapse where they are equal in all columns
    dealt = _named(several.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1)))))
    deal = own.withColumn("__own_deal", F.pmod(F.monotonically_increasing_id(), F.lit(_DEALT)))
    alike = deal.join(dealt, _is_same() & (F.col("__own_deal") == F.col("__deal")), "left_semi")
    held = alike.groupBy(*docs.columns, *[f"__own_{c}" for c in _SAME]).agg(F.count("*").alias("__m"))
    held = held.withColumn("__content", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    held = stored(held)
    times = _allotted(held.groupBy(*[f"__own_{c}" for c in _SAME], "__content").agg(F.sum("__m").alias("__m")), several)
    times = times.select(*[F.col(f"__own_{c}").alias(f"__of_{c}") for c in _SAME], F.col("__content").alias("__of_content"), "__times")
    again = held.join(times, _is_same() & (F.col("__content") == F.col("__of_content"))).where(F.col("__times") > 0)
    again = again.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))
