"""Problem 9: documents, sized in tokens, packed into containers of fixed capacity by hierarchical residual packing.

Round 1 packs groups of at most GROUP items by best fit, largest first. Nearly full bins are final; the underfull
bins of FAN neighbouring groups then meet as *items* of their fill level and are packed again, up the tree until
one group is left. Best fit leaves at most one bin of half the capacity or less in a group, and two bins of more than
half can't be joined, so a group sends up that bin and its roomiest others, at most GROUP / FAN of them: no group
ever exceeds GROUP bins, whatever the table's size, and the tree always ends, after log(groups) / log(FAN) levels.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tokenizing import VOCABULARIES, token_counts
from cairn.runtime import cut
from cairn.sources.tables import table

#: Items of a group that one task packs.
GROUP = 20_000
#: A bin filled to this share is nearly full and final.
FULL = 0.98
#: Groups whose underfull bins meet in one group of the next level.
FAN = 8
_BIN = "capacity_id int, capacity int, bin string, fill int, members array<struct<item:string,part:int,n:int>>, closed boolean"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the indexes of ``sizes`` in each bin. Every size is at most ``capacity``.

    Open bins are kept by room in a bit set, so the tightest bin that still fits is one shift and one lowest bit.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[k]
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        by_room[room - size].append(b)
        open_rooms |= 1 << (room - size)
    return bins


def _pack(pdf: pd.DataFrame, keep: int) -> pd.DataFrame:
    """One group of items or underfull bins of one capacity; all bins but the ``keep`` emptiest are closed."""
    capacity_id, capacity = int(pdf["capacity_id"].iloc[0]), int(pdf["capacity"].iloc[0])
    # the order of rows in a group isn't fixed; that of names is
    pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
    fills, names, members = pdf["fill"].tolist(), pdf["bin"].tolist(), pdf["members"].tolist()
    rows = []
    for inside in best_fit(fills, capacity):
        fill = sum(fills[k] for k in inside)
        rows.append((capacity_id, capacity, names[inside[0]], fill, [m for k in inside for m in members[k]], fill >= FULL * capacity or fill == 0))
    out = pd.DataFrame(rows, columns=["capacity_id", "capacity", "bin", "fill", "members", "closed"])
    return out.assign(closed=out["closed"] | (out["fill"].rank(method="first") > keep))


def _level(keep: int):
    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(pdf, keep).assign(g=int(pdf["g"].iloc[0]))

    return level


def pack(items: DataFrame, key: str, size: str, capacities: list[tuple[int, int]], group: int = GROUP) -> DataFrame:
    """Assign every row of ``items`` to containers of each of ``capacities`` ((capacity_id, capacity > 0), a short list).

    Returns capacity_id, container, key, part, n_tokens: one row per item, but for items longer than the capacity,
    which are cut into full containers (part 0, 1, ...) and one rest. No other item is ever split. An item's name is
    its key, its size and its number among equal rows, so containers don't depend on how the table is stored.

    Defined cases: a null or negative size counts as 0; an item of size 0 takes no room and shares a container;
    repeated keys and null keys are items of their own; an empty table gives no rows; extra columns are dropped;
    a capacity below 1 raises ValueError.
    """
    if any(c < 1 for _, c in capacities):
        raise ValueError("a capacity must be at least 1")
    kind = items.schema[key].dataType.simpleString()
    sized = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int").alias("n"))
    # rows of one key and size are interchangeable: counted, then numbered
    sized = sized.groupBy("key", "n").agg(F.count(F.lit(1)).alias("copies")).select("key", "n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    sized = cut(sized.select(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), "n", "copy").alias("item"), "key", "n"))
    caps = F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in capacities]) if capacities else F.array().cast("array<struct<capacity_id:int,capacity:int>>")
    each = sized.select("item", "n", F.inline(caps))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / F.col("capacity")).cast("int") - 1))
    cutup = each.select("item", "n", "capacity_id", "capacity", F.explode(parts).alias("part"))
    n = F.least(F.col("capacity"), F.col("n") - F.col("part") * F.col("capacity")).alias("fill")
    bins = cutup.select("capacity_id", "capacity", F.concat_ws(":", "item", F.col("part").cast("string")).alias("bin"), n, "item", "part")
    bins = bins.select("capacity_id", "capacity", "bin", "fill", F.array(F.struct("item", "part", F.col("fill").alias("n"))).alias("members"), (F.col("fill") == F.col("capacity")).alias("closed"))
    final = bins.where("closed")
    groups = max(1, -(-sized.count() // group))
    open_bins = bins.where("NOT closed").withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups)))
    keep = max(1, group // FAN)
    while True:
        last = groups == 1
        packed = cut(open_bins.groupBy("capacity_id", "capacity", "g").applyInPandas(_level(0 if last else keep), f"{_BIN}, g bigint"))
        final = final.unionByName(packed.where("closed").drop("g"))
        if last:
            break
        groups = -(-groups // FAN)
        open_bins = packed.where("NOT closed").withColumn("g", F.floor(F.col("g") / FAN))
    out = final.select("capacity_id", F.concat_ws("-", F.col("capacity_id").cast("string"), "bin").alias("container"), F.inline("members"))
    keyed = out.join(sized.select("item", "key"), "item")
    return keyed.select("capacity_id", "container", F.col("key").cast(kind).alias(key), "part", F.col("n").alias("n_tokens"))


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, list[tuple[int, int]]]]:
    rows = table(spark, sf_dir, "pack_capacity").collect()  # a fixed table of three capacities
    by_name: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        by_name.setdefault(r["tokenizer"], []).append((r["capacity_id"], r["capacity_tokens"]))
    return table(spark, sf_dir, "documents", "doc_id", "text"), by_name


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capacity_id, container, doc_id, part, n_tokens of every document for every capacity."""
    docs, by_name = _sizes(spark, sf_dir)
    out = None
    for tokenizer, capacities in sorted(by_name.items()):
        sizes = token_counts(docs, "doc_id", "text", f"{VOCABULARIES}/{tokenizer}.json")
        packed = pack(sizes, "doc_id", "n_tokens", capacities)
        out = packed if out is None else out.unionByName(packed)
    return out


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of room used of each capacity."""
    packed = p9_packing(spark, sf_dir)
    capacity = table(spark, sf_dir, "pack_capacity", "capacity_id", "capacity_tokens")
    used = packed.groupBy("capacity_id", "container").agg(F.sum("n_tokens").alias("n")).groupBy("capacity_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"))
    share = F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 4).alias("filled")
    return used.join(F.broadcast(capacity), "capacity_id").select("capacity_id", "n_containers", "n_tokens", share)


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must satisfy, per capacity, counted over all documents.

    n_docs documents in it; n_lost of them whose parts don't add up to their tokens; n_overfull containers above the
    capacity; n_torn documents divided though they fit, or divided other than into full parts and one rest.
    """
    packed = cut(p9_packing(spark, sf_dir))
    docs, by_name = _sizes(spark, sf_dir)
    capacity = table(spark, sf_dir, "pack_capacity", "capacity_id", F.col("capacity_tokens").alias("capacity"), "tokenizer")
    sizes = None
    for tokenizer in sorted(by_name):
        some = token_counts(docs, "doc_id", "text", f"{VOCABULARIES}/{tokenizer}.json").withColumn("tokenizer", F.lit(tokenizer))
        sizes = some if sizes is None else sizes.unionByName(some)
    wanted = sizes.join(F.broadcast(capacity), "tokenizer").select("capacity_id", "doc_id", F.col("n_tokens").alias("size"))
    each = packed.groupBy("capacity_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("parts"), F.max("part").alias("last"))
    whole = wanted.join(each, ["capacity_id", "doc_id"], "full").join(F.broadcast(capacity.drop("tokenizer")), "capacity_id")
    fair = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity")))
    flag = lambda ok, name: F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).alias(name)
    found = whole.groupBy("capacity_id").agg(F.count("size").alias("n_docs"), flag(F.col("size") == F.col("got"), "n_lost"), flag((F.col("parts") == fair) & (F.col("last") == fair - 1), "n_torn"))
    over = packed.groupBy("capacity_id", "container").agg(F.sum("n_tokens").alias("fill")).join(F.broadcast(capacity), "capacity_id")
    over = over.groupBy("capacity_id").agg(F.sum(F.when(F.col("fill") > F.col("capacity"), 1).otherwise(0)).alias("n_overfull"))
    return found.join(over, "capacity_id").select("capacity_id", "n_docs", "n_lost", "n_overfull", "n_torn")


QUERIES = {"p9_packing": p9_packing, "p9_fill": p9_fill, "p9_check": p9_check}
ORACLES = {"p9_check": "SELECT capacity_id, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_lost, 0 AS n_overfull, 0 AS n_torn FROM pack_capacity"}
