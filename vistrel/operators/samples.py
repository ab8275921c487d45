"""Draws of identities, images, pairs, questions and batches, all in the order of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.functions.draw import coin, draw_key, pick
from vistrel.functions.permute import permuted, round_numbers
from vistrel.operators.identity import by_thousands, eligible_identities, numbered, numbered_within


def draw_k(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, with the place at which they were drawn."""
    picked = df.orderBy(draw_key(seed, key), key).limit(k)
    return picked.withColumn("pos", F.row_number().over(W.Window.orderBy(draw_key(seed, key), key)).cast("long"))


def first_k(df: DataFrame, key: str, k: int) -> DataFrame:
    picked = df.orderBy(key).limit(k)
    return picked.withColumn("pos", F.row_number().over(W.Window.orderBy(key)).cast("long"))


def annotate(anchors: DataFrame, images: DataFrame, seed: int, cross_camera: bool = True) -> DataFrame:
    """(pos, image_idx, pid, partner_idx, outcome) of anchors (pos, image_idx) in their order.

    The first anchor of a person asks for a partner, and fails without one; every later anchor of that person is a
    duplicate, also after a failure.
    """
    asked = anchors.select("pos", "image_idx").join(images.select("image_idx", "pid", "camid"), "image_idx")
    asked = asked.withColumn("_nth", F.row_number().over(W.Window.partitionBy("pid").orderBy("pos")))
    other = images.select("pid", F.col("image_idx").alias("partner_idx"), F.col("camid").alias("_cam"))
    fits = (F.col("partner_idx") != F.col("image_idx")) & ((F.col("_cam") != F.col("camid")) if cross_camera else F.lit(True))
    options = asked.where("_nth = 1").join(other, "pid").where(fits)
    chosen = options.withColumn("_rn", F.row_number().over(W.Window.partitionBy("pos").orderBy(draw_key(seed, "image_idx", "partner_idx"), "partner_idx"))).where("_rn = 1")
    outcome = F.when(F.col("_nth") > 1, "dup").when(F.col("partner_idx").isNull(), "fail").otherwise("pair")
    return asked.join(chosen.select("pos", "partner_idx"), "pos", "left").select("pos", "image_idx", "pid", "partner_idx", outcome.alias("outcome"))


def annotation_counts(annotated: DataFrame) -> DataFrame:
    return annotated.agg(F.count("*").alias("k"), *(F.count_if(F.col("outcome") == o).alias(f"n_{name}") for o, name in (("pair", "pairs"), ("fail", "fail"), ("dup", "dup"))))


def two_camera_pairs(images: DataFrame, seed: int) -> DataFrame:
    """For each eligible identity two drawn cameras and one drawn image of each."""
    shown = images.join(eligible_identities(images).select("pid"), "pid", "left_semi")
    per_cam = W.Window.partitionBy("pid", "camid").orderBy(draw_key(seed, "image_idx"), "image_idx")
    best = shown.withColumn("_rn", F.row_number().over(per_cam)).where("_rn = 1").select("pid", "camid", "image_idx")
    cams = W.Window.partitionBy("pid").orderBy(draw_key(seed, "pid", "camid"), "camid")
    ranked = best.withColumn("_cam", F.row_number().over(cams)).where("_cam <= 2")
    return ranked.groupBy("pid").agg(F.max(F.when(F.col("_cam") == 1, F.col("image_idx"))).alias("a_idx"), F.max(F.when(F.col("_cam") == 2, F.col("image_idx"))).alias("b_idx"))


def images_per_identity(images: DataFrame, k: int, seed: int) -> DataFrame:
    """(pid, slot, image_idx): k drawn images of each identity; the first two come from two cameras where it has two."""
    order = [draw_key(seed, "image_idx"), F.col("image_idx")]
    nth = F.row_number().over(W.Window.partitionBy("pid", "camid").orderBy(*order))
    first = F.min(F.struct(draw_key(seed, "image_idx"), "image_idx")).over(W.Window.partitionBy("pid", "camid"))
    shown = images.select("pid", "camid", "image_idx").withColumn("_in_cam", nth).withColumn("_lead", first)
    cam_rank = F.dense_rank().over(W.Window.partitionBy("pid").orderBy("_lead"))
    shown = shown.withColumn("_cam", cam_rank)
    heads = (F.col("_in_cam") == 1) & (F.col("_cam") <= 2)
    slot = F.row_number().over(W.Window.partitionBy("pid").orderBy(F.when(heads, F.col("_cam")).otherwise(3), *order))
    return shown.withColumn("slot", slot.cast("long")).where(F.col("slot") <= k).select("pid", "slot", "image_idx")


def balanced_pairs(images: DataFrame, seed: int, most: int = 128) -> DataFrame:
    """(batch, a_idx, b_idx, label): of each batch equally many same-identity and other pairs, at most ``most`` of each.

    Pairs are numbered, not formed: images stand by identity, so identity by identity the numbers of its own pairs and of its pairs with
    earlier identities follow from counts. The drawn numbers are turned back into places, and only these are looked up.
    """
    placed = images.select("batch", "image_idx", "pid", (F.row_number().over(W.Window.partitionBy("batch").orderBy("pid", "image_idx")) - 1).alias("_p"))
    own, across = F.col("c") * (F.col("c") - 1) / 2, F.col("c") * F.col("start")
    earlier = W.Window.partitionBy("batch").orderBy("start").rowsBetween(W.Window.unboundedPreceding, -1)
    so_far = lambda n: F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast("long")
    people = placed.groupBy("batch", "pid").agg(F.count("*").alias("c"), F.min("_p").cast("long").alias("start"))
    people = people.select("batch", "c", "start", own.cast("long").alias("own"), across.alias("across"), so_far(own).alias("s0"), so_far(across).alias("d0"))
    listed = people.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("start", "c", "s0", "d0"))).alias("people"), F.sum("own").alias("same"), F.sum("across").alias("other"))
    numbers = {k: round_numbers(f"{seed}:{k}", "batch") for k in ("same", "other")}
    drawn = listed.where("same > 0 and other > 0").select("*", *(n.alias(f"_{k}") for k, n in numbers.items()))
    drawn = drawn.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("same", "other", F.lit(most).cast("long")) - 1)))
    drawn = drawn.select("batch", "people", *(permuted(F.col("i"), F.col(k), F.col(f"_{k}")).alias(k) for k in numbers))

    def person(first: str, number: str) -> Column:
        """The last identity whose numbers begin at or before the drawn one."""
        return F.element_at(F.filter("people", lambda q: q[first] <= F.col(number)), -1)

    found = drawn.select("batch", "same", "other", person("s0", "same").alias("x"), person("d0", "other").alias("y"))
    t, u = F.col("same") - F.col("x.s0"), F.col("other") - F.col("y.d0")
    later = F.floor((1 + F.sqrt(1 + 8 * t)) / 2)
    same = found.select("batch", (F.col("x.start") + t - later * (later - 1) / 2).cast("long").alias("p"), (F.col("x.start") + later).cast("long").alias("q"), F.lit(1).cast("long").alias("label"))
    other = found.select("batch", (u % F.col("y.start")).alias("p"), (F.col("y.start") + F.floor(u / F.col("y.start"))).cast("long").alias("q"), F.lit(0).cast("long").alias("label"))
    image = lambda at, name: placed.select("batch", F.col("_p").cast("long").alias(at), F.col("image_idx").alias(name))
    both = same.unionByName(other).join(image("p", "_a"), ["batch", "p"]).join(image("q", "_b"), ["batch", "q"])
    return both.select("batch", F.least("_a", "_b").alias("a_idx"), F.greatest("_a", "_b").alias("b_idx"), "label")


def questions(images: DataFrame, n: int, seed: int) -> DataFrame:
    """(q_idx, img_a, img_b, truth): a coin chooses between a drawn same-identity pair and two drawn images, which may coincide."""
    spark = images.sparkSession
    listed = numbered(images.select("image_idx", "pid"), "i", by_thousands("image_idx"), "image_idx")
    by = W.Window.partitionBy("pid").orderBy("image_idx")
    nth = images.select("pid", "image_idx", (F.floor((F.row_number().over(by) - 1) / 2)).alias("_pair"), ((F.row_number().over(by) - 1) % 2).alias("_side"))
    couples = nth.groupBy("pid", "_pair").agg(F.max(F.when(F.col("_side") == 0, F.col("image_idx"))).alias("img_a"), F.max(F.when(F.col("_side") == 1, F.col("image_idx"))).alias("img_b")).where("img_b is not null")
    couples = numbered(couples.select("img_a", "img_b"), "i", by_thousands("img_a"), "img_a", "img_b")
    n_images, n_couples = images.count(), couples.count()
    asked = spark.range(n).select(F.col("id").alias("q_idx"), coin(f"{seed}:coin", "id").alias("same"))
    same = asked.where("same = 1").withColumn("i", pick(n_couples, f"{seed}:pair", "q_idx")).join(couples, "i").select("q_idx", "img_a", "img_b", F.lit(1).cast("long").alias("truth"))
    a = listed.select(F.col("i").alias("ia"), F.col("image_idx").alias("img_a"), F.col("pid").alias("pa"))
    b = listed.select(F.col("i").alias("ib"), F.col("image_idx").alias("img_b"), F.col("pid").alias("pb"))
    free = asked.where("same = 0").withColumn("ia", pick(n_images, f"{seed}:a", "q_idx")).withColumn("ib", pick(n_images, f"{seed}:b", "q_idx"))
    free = free.join(a, "ia").join(b, "ib").select("q_idx", "img_a", "img_b", (F.col("pa") == F.col("pb")).cast("long").alias("truth"))
    return same.unionByName(free)


def answers(asked: DataFrame, seed: int) -> DataFrame:
    """The questions with the answers that are shown under each transform: true, shuffled, flipped, all yes, all no."""
    placed = numbered(asked, "_p", by_thousands("q_idx"), "q_idx")
    mixed = asked.withColumn("_key", draw_key(seed, "q_idx"))
    other = numbered(mixed, "_p", F.substring("_key", 1, 3), "_key", "q_idx").select("_p", F.col("truth").alias("shuffle"))
    return placed.join(other, "_p").select(
        "q_idx", "truth", "shuffle", (1 - F.col("truth")).alias("flip"), F.lit(1).cast("long").alias("all_yes"), F.lit(0).cast("long").alias("all_no")
    )


def batches(identities: DataFrame, n_batches: int, size: int, seed: int, unique: bool = False, mixed: bool = False) -> DataFrame:
    """(batch, slot, domain, pid): each batch draws a domain, then ``size`` identities of it.

    They are drawn with replacement; where ``unique``, without, unless the domain has fewer than ``size``. ``mixed`` batches draw from all
    domains together. A slot computes its identity's number, so only batches x slots rows are written, however many identities there are.
    """
    spark = identities.sparkSession
    pools = identities.select((F.lit("all") if mixed else F.col("domain")).alias("_pool"), "domain", "pid")
    listed = numbered_within(pools, "i", "_pool", by_thousands("pid"), "pid", "domain")
    sizes = pools.groupBy("_pool").agg(F.count("*").alias("n")).withColumn("d", F.row_number().over(W.Window.orderBy("_pool")) - 1)
    n_pools = sizes.count()
    drawn = spark.range(n_batches).select(F.col("id").alias("batch"), pick(n_pools, f"{seed}:domain", "id").alias("d")).join(F.broadcast(sizes), "d")  # a row per domain
    slots = drawn.withColumn("_numbers", round_numbers(f"{seed}:order", "batch")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    i = pick(F.col("n"), f"{seed}:slot", "batch", "slot")
    if unique:
        i = F.when(F.col("n") >= size, permuted(F.col("slot"), F.col("n"), F.col("_numbers"))).otherwise(i)
    return slots.withColumn("i", i).join(listed, ["_pool", "i"]).select("batch", "slot", "domain", "pid")


def anchor_partner(images: DataFrame, seed: int) -> DataFrame:
    """(image_idx, partner_idx): for each image the drawn other image of its identity, found by rank without forming pairs."""
    order = W.Window.partitionBy("pid").orderBy(draw_key(seed, "image_idx"), "image_idx")
    ring = images.select("pid", "image_idx", F.lead("image_idx").over(order).alias("_next"), F.first("image_idx").over(order).alias("_first"))
    return ring.select("image_idx", F.coalesce("_next", "_first").alias("partner_idx")).where("image_idx <> partner_idx")


def pseudo_pairs(pool: DataFrame, k: int, seed: int) -> DataFrame:
    """k drawn images, each paired with itself: the second copy is to be augmented."""
    return draw_k(pool, "image_idx", k, seed).select("pos", F.col("image_idx").alias("a_idx"), F.col("image_idx").alias("b_idx"))


def check_budget(pool: DataFrame, k: int) -> None:
    """A budget that the pool cannot meet is an error."""
    if (n := pool.limit(k).count()) < k:
        raise ValueError(f"budget {k} exceeds the pool's {n} rows")


def budget_report(pool: DataFrame, drawn: DataFrame, budget: str) -> DataFrame:
    """(budget, fits, n_distinct, valid) of the images drawn (budget, image_idx): whether the pool has enough, and whether as many
    distinct images of the pool were drawn as were asked for."""
    size = pool.count()
    known = drawn.join(pool.select("image_idx", F.lit(True).alias("_known")), "image_idx", "left")
    per = known.groupBy(budget).agg(F.count("*").alias("_n"), F.countDistinct("image_idx").alias("n_distinct"), F.count_if(F.col("_known")).alias("_in"))
    exact = (F.col("_n") == F.col(budget)) & (F.col("n_distinct") == F.col(budget)) & (F.col("_in") == F.col(budget))
    return per.select(budget, (F.lit(size) >= F.col(budget)).alias("fits"), "n_distinct", exact.alias("valid"))


def repeat_labels(labels: DataFrame, times: int) -> DataFrame:
    """Each row (i, label) ``times`` times in a row: (i, label) with new numbers."""
    copies = F.posexplode(F.array_repeat(F.col("label"), times)).alias("_n", "label")
    return labels.select("i", copies).select((F.col("i") * times + F.col("_n")).alias("i"), "label")


def paired(rows: DataFrame, value: str) -> DataFrame:
    """(pair, first, second) of the neighbouring rows (i, value) two and two."""
    side = lambda n: F.max(F.when(F.col("i") % 2 == n, F.col(value)))
    return rows.groupBy(F.floor(F.col("i") / 2).alias("pair")).agg(side(0).alias("first"), side(1).alias("second"))


def evaluation_subset(pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The rows of n drawn keys, or all rows where there are no more."""
    return pool.orderBy(draw_key(seed, key), key).limit(n)


def with_rest(pools: DataFrame, picked: DataFrame, by: list[str]) -> DataFrame:
    """(by.., selector, pos, image_idx, chosen): the picks of each pool in their order, then the pool's other images in the order of their numbers."""
    names = picked.select(*by, "selector").distinct()
    every = pools.select(*by, "image_idx").join(names, by)
    joined = every.join(picked, [*by, "selector", "image_idx"], "left")
    order = W.Window.partitionBy(*by, "selector").orderBy(F.col("pos").asc_nulls_last(), "image_idx")
    return joined.select(*by, "selector", F.row_number().over(order).cast("long").alias("place"), "image_idx", F.col("pos").isNotNull().alias("chosen")).withColumnRenamed("place", "pos")
