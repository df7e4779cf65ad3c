"""User-user similarity: neighbours of some users or of all, rows of the similarity matrix for some."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemesh.functions.numeric import RATING_DIGITS, SIM_DIGITS, quantize
from tastemesh.operators import kernels
from tastemesh.operators.history import for_users
from tastemesh.operators.ranking import top_k, whole_ranks
from tastemesh.sources.staging import stage

# Users per block. A task holds the sums of one pair of blocks, six for Pearson and two for cosine:
# at most 113 or 64 MB of doubles, and much less while the pairs are sparse.
BLOCK_USERS = {"pearson": 1536, "cosine": 2048}
# Blocks of an item on each side of one join key.
BLOCKS_PER_GROUP = 16
# Pairs of blocks that a task works through at most, one at a time.
PAIRS_PER_TASK = 8

# Users that one row of a packed matrix stands for: the bits of one of Spark's bitmaps.
BITMAP_USERS = 8 * 4096
# Rows of a bucket that one task expands at most, one at a time; the bucket's users travel to each of its tasks.
ROWS_PER_TASK = 2048

# Blocks from which on it is worth counting what pairs of them have in common.
MEETING_FROM = 32

# Blocks from which on it is worth counting whether a block is better gathered with all it meets in one task.
GATHER_FROM = 64
# Pairs of raters that a gathered block has on average, at most.
GATHERED_PAIRS = 1 << 21
# Raters of an item that travel in one row to a gathered block.
LIST_RATERS = 1024
# Different values, or pairs of value and norm, of raters that travel as numbers.
KINDS = 1 << 15
# What a row costs besides its entries, in entries.
ROW_ENTRIES = 8

VALUE = {"pearson": "rating", "cosine": "seen"}


def _comparable(cells: DataFrame, measure: str) -> DataFrame:
    """``user_id, item_id, val``: what two users are compared on; zeros are not co-ratings.

    Ratings become whole numbers of 1e-4. A correlation is the same in any unit, and moments of whole
    numbers are exact in doubles: equal in any order of addition, and with no variance exactly where
    all ratings are equal.
    """
    value = F.col(VALUE[measure])
    val = F.floor(value * float(10**RATING_DIGITS) + 0.5) if measure == "pearson" else value
    return cells.where(value > 0).select("user_id", "item_id", val.cast("double").alias("val"))


def squared_norms(cells: DataFrame) -> DataFrame:
    return cells.groupBy("user_id").agg(F.sum(F.col("val") * F.col("val")).alias("norm"))


def _strength(measure: str):
    return F.abs("sim") if measure == "pearson" else F.col("sim")


def pearson_neighbors(
    cells: DataFrame, users: Sequence | DataFrame | None = None, k: int | None = 50, block_users: int | None = None
) -> DataFrame:
    """The ``k`` users most correlated, by absolute Pearson, with each user.

    Over items both rated, two at least; undefined correlations are left out. Returns
    ``user_id, other_id, sim, n_common, rank``.
    """
    return _neighbors(cells, "pearson", users, k, block_users)


def cosine_neighbors(
    cells: DataFrame, users: Sequence | DataFrame | None = None, k: int | None = 50, block_users: int | None = None
) -> DataFrame:
    """The ``k`` users with the highest cosine of what they have seen.

    By definition a neighbour has something in common: zero cosines, which add nothing to a prediction,
    do not fill up the list.
    """
    return _neighbors(cells, "cosine", users, k, block_users)


def _neighbors(cells, measure, users, k, block_users) -> DataFrame:
    if users is None:
        if k is None:
            raise ValueError("neighbours of all users need a limit k")
        base = _comparable(cells, measure)
        norms = stage(squared_norms(base), "user-norms")
        n_blocks = max(1, -(-norms.count() // (block_users or BLOCK_USERS[measure])))
        if n_blocks >= GATHER_FROM and (gathered := _gathered_blocks(base, n_blocks)):
            return gathered_neighbors(base, norms, measure, k, gathered)
        pairs = block_pairs(base, norms, measure, k, n_blocks)
    else:
        pairs = _pairs_of(cells, measure, users)
    return top_k(pairs, ["user_id"], [_strength(measure).desc(), F.col("other_id")], k)


def _pairs_of(cells: DataFrame, measure: str, users: Sequence | DataFrame, undefined: bool = False) -> DataFrame:
    """Similarities of the given users with everyone: linear in the cells of their items.

    Pairs whose correlation is not defined are left out, or NULL with ``undefined``.

    The targets' cells are few as a rule and are then broadcast at run time; otherwise both sides
    shuffle on the item and AQE splits the hot ones.
    """
    base = _comparable(cells, measure)
    mine = for_users(base, users).select("user_id", "item_id", F.col("val").alias("x"))
    others = base.select(F.col("user_id").alias("other_id"), "item_id", F.col("val").alias("y"))
    x, y = F.col("x"), F.col("y")
    common = mine.join(others, "item_id").where(F.col("user_id") != F.col("other_id")).groupBy("user_id", "other_id")
    if measure == "pearson":
        s = common.agg(
            F.count("*").alias("n_common"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
            F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        )
        vx = F.expr("n_common * sxx - sx * sx")
        vy = F.expr("n_common * syy - sy * sy")
        ratio = F.expr("greatest(-1D, least(1D, (n_common * sxy - sx * sy) / sqrt(vx * vy)))")
        defined = (F.col("n_common") >= 2) & (F.col("vx") > 0) & (F.col("vy") > 0)
        sims = s.withColumns({"vx": vx, "vy": vy}).select(
            "user_id", "other_id", F.when(defined, quantize(ratio, SIM_DIGITS)).alias("sim"), "n_common")
        return sims if undefined else sims.where(F.col("sim").isNotNull())
    norms = squared_norms(base)
    mine_norm = for_users(norms, users).withColumnRenamed("norm", "nx")
    other_norm = norms.select(F.col("user_id").alias("other_id"), F.col("norm").alias("ny"))
    return (
        common.agg(F.count("*").alias("n_common"), F.sum(x * y).alias("sxy"))
        .join(mine_norm, "user_id").join(other_norm, "other_id")
        .withColumn("sim", quantize(F.expr("sxy / sqrt(nx * ny)"), SIM_DIGITS))
        .select("user_id", "other_id", "sim", "n_common")
    )


def _gathered_blocks(base: DataFrame, n_blocks: int) -> int | None:
    """In how many blocks ``gathered_neighbors`` would work, or None where ``block_pairs`` moves less.

    An item of r raters in b of the blocks is b rows to gathered blocks and about b * b / 2 rows to pairs of blocks, of
    r * b entries in both. So items of few raters are better gathered, and items in about all blocks are not: a gathered
    block keeps its sums of all users, and must be the smaller the more it meets.
    """
    raters = stage(base.groupBy("item_id").agg(F.count("*").cast("double").alias("r")), "raters")
    pairs = raters.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    n_gathered = max(n_blocks, int(-(-pairs // GATHERED_PAIRS)))

    def met(blocks: int):
        return F.lit(float(blocks)) * (1 - F.pow(F.lit(1 - 1 / blocks), F.col("r")))

    b, g = met(n_blocks), met(n_gathered)
    by_pairs, gathered = raters.agg(
        F.sum(F.col("r") * b + ROW_ENTRIES * b * (b + 1) / 2), F.sum(F.col("r") * g + ROW_ENTRIES * g)).first()
    return n_gathered if gathered < by_pairs else None


def gathered_neighbors(base: DataFrame, norms: DataFrame, measure: str, k: int, n_blocks: int) -> DataFrame:
    """The ``k`` nearest of all users, where items have few raters: ``user_id, other_id, sim, n_common, rank``.

    The raters of an item travel as one list to each block that has some of them. A block's task adds up its users' pairs
    with everyone and keeps the best, so nothing of a user is anywhere else and each list is one row a block instead of
    one a pair of blocks. Users are numbered by id; a block has every ``n_blocks``-th. Many items' lists travel to a block in
    one row, as compressed distances of numbers, so that a rater takes about three bytes. An item of more than ``LIST_RATERS`` raters is cut into lists of
    that size, which meet its raters of a block.
    """
    n_users = norms.count()
    code_type = "int" if n_users < 2**31 else "bigint"
    code_bytes = max(1, -(-max(1, n_users - 1).bit_length() // 8))
    users = stage(whole_ranks(norms, [], [F.col("user_id")], "pos").select(
        "user_id", "norm", (F.col("pos") - 1).cast(code_type).alias("code")), "user-codes")
    held = ["val", "norm"] if measure == "cosine" else ["val"]
    coded = base.join(users, "user_id").select("item_id", "code", *held)
    # What a rater has besides its number is one more number where few values of it are different.
    kinds = [tuple(r) for r in coded.select(*held).distinct().limit(KINDS + 1).collect()]
    kinds = sorted(kinds) if len(kinds) <= KINDS else None
    if kinds is not None:
        places = base.sparkSession.createDataFrame(
            [(i, *kind) for i, kind in enumerate(kinds)], ", ".join(["kind int", *(f"{c} double" for c in held)]))
        kind = F.col("kind").cast("tinyint" if len(kinds) <= 128 else "smallint").alias("val")
        coded = coded.join(F.broadcast(places), held).select("item_id", "code", kind)
    val_type = coded.schema["val"].dataType
    other = [c for c in coded.columns if c != "item_id"]
    block = F.pmod("code", F.lit(n_blocks)).cast("int")
    lists = F.collect_list(F.struct(*other)).alias("raters")
    no_sizes, no_bytes = F.array().cast("array<int>"), F.lit(b"")

    def entries(df: DataFrame, n_left, raters: Callable[[str], Column]) -> DataFrame:
        norm = raters("norm") if "norm" in other else F.array().cast("array<double>")
        return df.select(
            "block", F.lit(1).alias("part"), n_left.alias("n_left"), no_sizes.alias("sizes"), no_bytes.alias("packed"),
            raters("code").alias("code"), raters("val").alias("val"), norm.alias("norm"), F.array().cast(T.ArrayType(base.schema["user_id"].dataType)).alias("ids"))

    hot = stage(
        base.groupBy("item_id").agg(F.count("*").alias("r")).where(F.col("r") > LIST_RATERS)
        .select("item_id", F.ceil(F.col("r") / LIST_RATERS).cast("int").alias("slices")), "hot-items")
    n_hot = hot.count()
    light = coded.join(hot, "item_id", "left_anti") if n_hot else coded
    kept = {"val": T.ArrayType(val_type), "norm": T.ArrayType(T.DoubleType())}
    packed = T.StructType([
        T.StructField("block", T.IntegerType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("packed", T.BinaryType()),
        *(T.StructField(name, kind) for name, kind in kept.items())])
    norm = F.col("raters.norm") if "norm" in other else F.array().cast("array<double>")
    rows = (
        light.groupBy("item_id").agg(lists).select(F.col("raters.code").alias("code"), F.col("raters.val").alias("val"), norm.alias("norm"))
        .mapInArrow(kernels.packed_lists(n_blocks, code_bytes, kinds is not None), packed)
        .select(
            "block", F.lit(2).alias("part"), F.lit(0).alias("n_left"), "sizes", "packed", F.array().cast(f"array<{code_type}>").alias("code"),
            "val", "norm", F.array().cast(T.ArrayType(base.schema["user_id"].dataType)).alias("ids")))
    if n_hot:
        heavy = coded.join(hot, "item_id")
        every_slice = F.explode(F.expr("sequence(0, slices - 1)")).alias("slice")
        left = heavy.groupBy("item_id", block.alias("block"), "slices").agg(lists).select(
            "item_id", "block", every_slice, F.col("raters").alias("left"))
        right = heavy.groupBy("item_id", F.pmod(F.xxhash64("code"), F.col("slices")).cast("int").alias("slice")).agg(lists)
        rows = rows.unionByName(entries(
            left.join(right, ["item_id", "slice"]), F.size("left"), lambda c: F.concat(F.col(f"left.{c}"), F.col(f"raters.{c}"))))
    members = users.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("code", "user_id", "norm"))).alias("m"))
    heads = members.select(
        "block", F.lit(0).alias("part"), F.lit(0).alias("n_left"), no_sizes.alias("sizes"), no_bytes.alias("packed"), F.col("m.code").alias("code"),
        F.array().cast(T.ArrayType(val_type)).alias("val"), F.col("m.norm").alias("norm"), F.col("m.user_id").alias("ids"))
    # Work grows with pairs of cells, not with bytes, so the tasks are counted here and not by AQE.
    parallel = 4 * int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(n_blocks, parallel), -(-n_blocks // PAIRS_PER_TASK))
    out = T.StructType([
        T.StructField("user_id", base.schema["user_id"].dataType), T.StructField("other", users.schema["code"].dataType),
        T.StructField("sim", T.DoubleType()), T.StructField("n_common", T.LongType()), T.StructField("rank", T.IntegerType()),
    ])
    best = (
        heads.unionByName(rows).repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int"))
        .sortWithinPartitions("block", "part").mapInArrow(kernels.gathered_similarity(measure, k, SIM_DIGITS, n_blocks, kinds, code_bytes), out))
    return best.join(users.select(F.col("code").alias("other"), F.col("user_id").alias("other_id")), "other").select(
        "user_id", "other_id", "sim", "n_common", "rank")


def block_pairs(base: DataFrame, norms: DataFrame, measure: str, k: int, n_blocks: int) -> DataFrame:
    """Similarities between all users: per block pair the ``k`` best of each user, without the user itself.

    A co-rating self-join would emit every pair of raters of an item, a square of the hottest one.
    Here the raters of an item travel as arrays, one per user block, to the tasks that own a pair of
    blocks; the pair sums are formed there and only the best leave. An item of r raters in b blocks costs r * b
    array entries, never r * r rows, in join keys of bounded size. ``base`` has one row per user and item.
    """
    spark = base.sparkSession
    in_block = Window.partitionBy("block").orderBy("user_id")
    users = norms.withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(n_blocks)).cast("int")).withColumn(
        "pos", F.row_number().over(in_block) - 1
    )

    # Raters of an item in one block: at most a block of users.
    postings = stage(
        base.join(users.select("user_id", "block", "pos"), "user_id")
        .groupBy("item_id", "block")
        .agg(F.collect_list(F.struct("pos", "val")).alias("raters"))
        .select("item_id", "block", F.col("raters.pos").alias("pos"), F.col("raters.val").alias("val")),
        "postings",
    )
    # An item in many blocks is cut into groups of blocks, and each pair of groups is a join key of its own.
    groups = F.ceil(F.count("*") / BLOCKS_PER_GROUP).cast("int")
    hot = postings.groupBy("item_id").agg(groups.alias("groups")).where(F.col("groups") > 1)
    grouped = postings.join(hot, "item_id", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    own_group = F.pmod("block", "groups")
    every_group = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    left = grouped.select(
        "item_id", own_group.alias("left_group"), every_group.alias("right_group"),
        F.col("block").alias("left_block"), F.col("pos").alias("left_pos"), F.col("val").alias("left_val"),
    )
    right = grouped.select(
        "item_id", every_group.alias("left_group"), own_group.alias("right_group"),
        F.col("block").alias("right_block"), F.col("pos").alias("right_pos"), F.col("val").alias("right_val"),
    )
    id_type = base.schema["user_id"].dataType
    shared = (
        left.join(right, ["item_id", "left_group", "right_group"]).where(F.col("left_block") <= F.col("right_block"))
        .select(
            "left_block", "right_block", F.lit(1).alias("part"), F.size("left_pos").alias("n_left"),
            F.concat("left_pos", "right_pos").alias("pos"), F.concat("left_val", "right_val").alias("val"),
            F.array().cast(T.ArrayType(id_type)).alias("ids"),
        )
    )
    # Only pairs of blocks with enough items in common are worked on: others hold no pair of users to compare.
    if n_blocks < MEETING_FROM:
        meeting = spark.range(n_blocks * n_blocks).select(
            F.expr(f"CAST(id DIV {n_blocks} AS int)").alias("left_block"), F.expr(f"CAST(id % {n_blocks} AS int)").alias("right_block")
        ).where("left_block <= right_block")
    else:
        meeting = stage(_meeting_blocks(left, right, 2 if measure == "pearson" else 1), "meeting-blocks")
        shared = shared.join(meeting, ["left_block", "right_block"], "left_semi")
    # Who is in the two blocks of a pair. A block has a bounded number of users.
    members = users.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "user_id", "norm"))).alias("m"))
    lm, rm = F.col("lm"), F.col("rm")
    headers = (
        meeting.join(members.select(F.col("block").alias("left_block"), F.col("m").alias("lm")), "left_block")
        .join(members.select(F.col("block").alias("right_block"), F.col("m").alias("rm")), "right_block")
        .select(
            "left_block", "right_block", F.lit(0).alias("part"), F.size(lm).alias("n_left"),
            F.array().cast("array<int>").alias("pos"), F.concat(lm.norm, rm.norm).alias("val"),
            F.concat(lm.user_id, rm.user_id).alias("ids"),
        )
    )
    # Work grows with pairs of cells, not with bytes, so the tasks are counted here and not by AQE.
    pairs = n_blocks * (n_blocks + 1) // 2
    tasks = max(min(pairs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-pairs // PAIRS_PER_TASK))
    out = T.StructType([
        T.StructField("user_id", id_type), T.StructField("other_id", id_type),
        T.StructField("sim", T.DoubleType()), T.StructField("n_common", T.LongType()),
    ])
    # Pairs (0, 0), (0, 1) ... are numbered in order and dealt out in turn.
    pair = F.expr(f"left_block * {n_blocks}L - left_block * (left_block + 1L) div 2 + right_block")
    return (
        headers.unionByName(shared)
        .repartitionById(tasks, F.pmod(pair, F.lit(tasks)).cast("int"))
        .sortWithinPartitions("left_block", "right_block", "part")
        .mapInArrow(kernels.pair_similarity(measure, k, SIM_DIGITS), out)
    )


def _meeting_blocks(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """Pairs of blocks that have ``least`` items or more in common: ``left_block, right_block``.

    Block numbers only: no array travels for a pair that turns out to have too little in common.
    """
    keys = ["item_id", "left_group", "right_group"]
    return (
        left.select(*keys, "left_block").join(right.select(*keys, "right_block"), keys).where("left_block <= right_block")
        .groupBy("left_block", "right_block").agg(F.count("*").alias("items")).where(F.col("items") >= least)
        .select("left_block", "right_block"))


def _matrix(cells: DataFrame, measure: str, users: Sequence | DataFrame) -> DataFrame:
    own = F.count_if(F.col(VALUE[measure]) > 0).alias("n_common")
    diagonal = for_users(cells, users).groupBy("user_id").agg(own).select(
        "user_id", F.col("user_id").alias("other_id"), F.lit(1.0).alias("sim"), "n_common"
    )
    return _pairs_of(cells, measure, users, undefined=True).unionByName(diagonal)


def pearson_matrix(cells: DataFrame, users: Sequence | DataFrame) -> DataFrame:
    """Rows of the Pearson matrix: the given users with everyone they share an item with, and themselves (1).

    NULL where the correlation is undefined.
    """
    return _matrix(cells, "pearson", users)


def cosine_matrix(cells: DataFrame, users: Sequence | DataFrame) -> DataFrame:
    """Rows of the cosine matrix: the given users with everyone they share an item with, and themselves (1).

    Pairs without a common item, all 0, are not listed.
    """
    return _matrix(cells, "cosine", users)


def user_index(cells: DataFrame) -> DataFrame:
    """All users with their place in id order, from 1: ``user_id, pos``."""
    return stage(whole_ranks(cells.select("user_id").distinct(), [], [F.col("user_id")], "pos"), "user-index")


def packed_matrix(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of a similarity matrix without their empty part.

    ``rows`` are those of ``pearson_matrix`` or ``cosine_matrix``. Returns ``user_id, bucket, met, pos, sim``: for each
    bucket of ``BITMAP_USERS`` users in which the user shares an item with someone, a bitmap of whom, and the places and
    values of the defined similarities. Everyone else is the complement and takes no space.
    """
    placed = rows.join(index.select(F.col("user_id").alias("other_id"), "pos"), "other_id")
    entry = F.when(F.col("sim").isNotNull(), F.struct(F.bitmap_bit_position("pos").cast("int").alias("pos"), "sim"))
    # Dealt out before they are gathered: a bitmap is 4 KB for however few, and each task would have its own of most rows.
    dealt = placed.select("user_id", F.bitmap_bucket_number("pos").alias("bucket"), F.bitmap_bit_position("pos").alias("bit"), entry.alias("entry"))
    return dealt.repartition("user_id", "bucket").groupBy("user_id", "bucket").agg(
        F.bitmap_construct_agg("bit").alias("met"), F.sort_array(F.collect_list("entry")).alias("entries")
    ).select("user_id", "bucket", "met", F.col("entries.pos").alias("pos"), F.col("entries.sim").alias("sim"))


def dense_matrix(packed: DataFrame, index: DataFrame, users: Sequence | DataFrame, empty: float | None) -> DataFrame:
    """The whole rows of the given users: ``user_id, other_id, sim, met`` with everyone in the index.

    ``met`` tells whether the two share an item; ``empty`` is the value of pairs that do not (None for Pearson, 0 for
    cosine). A bucket's users travel once to each task that expands rows of it, not with every row.
    """
    parallel = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = for_users(index, users).select("user_id")
    top, asked = max(1, -(-index.count() // BITMAP_USERS)), max(1, wanted.count())
    slices = max(-(-asked // ROWS_PER_TASK), min(asked, -(-parallel // top)))
    ints, doubles = F.array().cast("array<int>"), F.array().cast("array<double>")
    every_slice = F.explode(F.expr(f"sequence(0, {slices - 1})")).alias("slice")
    member = F.struct(F.bitmap_bit_position("pos").alias("bit"), "user_id")
    heads = (
        index.groupBy(F.bitmap_bucket_number("pos").alias("bucket")).agg(F.sort_array(F.collect_list(member)).alias("m"))
        .select("bucket", every_slice, F.col("m.user_id").alias("others"))
        .select(
            "bucket", "slice", F.lit(0).alias("part"), F.lit(None).cast(index.schema["user_id"].dataType).alias("user_id"), "others",
            F.lit(None).cast("binary").alias("met"), ints.alias("pos"), doubles.alias("sim"))
    )
    rows = (
        wanted.select("user_id", F.explode(F.expr(f"sequence(1L, {top}L)")).alias("bucket")).join(packed, ["user_id", "bucket"], "left")
        .select(
            "bucket", F.pmod(F.xxhash64("user_id"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("part"), "user_id",
            F.lit(None).cast(heads.schema["others"].dataType).alias("others"), "met", F.coalesce("pos", ints).alias("pos"),
            F.coalesce("sim", doubles).alias("sim"))
    )
    id_type = index.schema["user_id"].dataType
    out = T.StructType([
        T.StructField("user_id", id_type), T.StructField("other_id", id_type), T.StructField("sim", T.DoubleType()),
        T.StructField("met", T.BooleanType())])
    return (
        heads.unionByName(rows)
        .repartitionById(top * slices, F.expr(f"CAST((bucket - 1) * {slices} + slice AS int)"))
        .sortWithinPartitions("part").mapInArrow(kernels.expand_rows(empty), out))
