"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

1. A row's hash of id and text names one of ``n_slots`` virtual slots, for good: neither the number of shards
   nor the other rows change it. Only narrow rows (id, size, check sum, slot) are written, no texts.
2. Bytes and rows are added up per slot, combined before the shuffle.
3. A map holds each slot's shard. Version 0 deals slots round. Every rebalance edits the version before: slots of
   the fullest shard move to, or change places with slots of, emptier ones until no such edit evens them out. The map
   has ``n_slots`` rows however large the table is, so it is edited on the driver, stored as Parquet, a
   folder a version, and sent to the tasks.
4. A row's place in its shard is the rows of the shard's slots before its own, plus its number in its slot. Slots
   are numbered each on its own, so no task sees a whole shard.

Copies of a text have ids of their own and so spread over slots. Only rows that repeat in id and text share one; a
slot that holds far more rows than the others (``hot_times``) is marked as salted, and its rows are dealt over all slots
by their row number too.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.plans.scratch import materialize, shared_dir

LAW = "bytes"
MAP = "slot int, shard int, bytes long, rows long, salted boolean, first_place long"


@dataclass(frozen=True)
class Slot:
    slot: int
    shard: int
    bytes: int = 0
    rows: int = 0
    salted: bool = False


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"), F.coalesce(text, F.lit("")))


def _slot(key: Column, n_slots: int) -> Column:
    return F.pmod(key, F.lit(n_slots)).cast("int")


def _dealt(rows: DataFrame, salted: list[int], n_slots: int) -> DataFrame:
    """Rows (key, row) with their slot; rows of salted slots (a list of ``n_slots`` numbers at most) go by their row number too."""
    own = _slot(F.col("key"), n_slots)
    return rows.withColumn("virtual_slot", F.when(own.isin(salted), _slot(F.xxhash64("key", "row"), n_slots)).otherwise(own) if salted else own)


def first_map(n_slots: int, n_shards: int) -> list[Slot]:
    """Version 0: slots dealt round."""
    return [Slot(s, s % n_shards) for s in range(n_slots)]


def _closest(sizes: list[tuple[int, int]], aim: float, below: int) -> tuple[int, int] | None:
    """Of ascending (bytes, slot) the one with bytes nearest to ``aim``, over 0 and under ``below``."""
    at = bisect_left(sizes, (aim, -1))
    near = [x for x in sizes[max(0, at - 1) : at + 1] if 0 < x[0] < below]
    return min(near, key=lambda x: abs(x[0] - aim), default=None)


def _swap(high: list[tuple[int, int]], low: list[tuple[int, int]], gap: int) -> tuple[int, tuple, tuple] | None:
    """The pair of slots whose exchange moves bytes nearest to half the gap, more than 0 and less than it."""
    best, j = None, 0
    for b in low:
        while j + 1 < len(high) and high[j][0] - b[0] < gap / 2:
            j += 1
        for a in high[max(0, j - 1) : j + 1]:
            moved = a[0] - b[0]
            if 0 < moved < gap and (best is None or abs(moved - gap / 2) < abs(best[0] - gap / 2)):
                best = (moved, a, b)
    return best


def edit(slots: list[Slot], n_shards: int, into: int | None = None, tolerance: float = 1e-5) -> list[Slot]:
    """The next version of a map: shards evened out by bytes, with few slots moved.

    ``into``: slots move to this shard alone, as for one that is new, until it holds as much as the others.
    It ends when no two shards differ by over ``tolerance`` of the mean, or none that do come nearer by a move or an exchange.
    """
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for s in slots:
        held[s.shard].append((s.bytes, s.slot))
    for h in held:
        h.sort()
    loads = [sum(b for b, _ in h) for h in held]
    home = {s.slot: s.shard for s in slots}
    enough = tolerance * sum(loads) / n_shards

    def move(x: tuple[int, int], a: int, b: int) -> None:
        held[a].remove(x)
        held[b].insert(bisect_left(held[b], x), x)
        loads[a] -= x[0]
        loads[b] += x[0]
        home[x[1]] = b

    def evened(high: int, low: int) -> bool:
        """Whether a move or an exchange between two shards brought them nearer."""
        gap = loads[high] - loads[low]
        if gap <= enough:
            return False
        excess = loads[high] - sum(loads) / n_shards
        aim = min(gap / 2, excess) if into is not None and excess > 0 else gap / 2  # a new shard takes the others' excess first
        one = _closest(held[high], aim, min(gap, 2 * aim))
        two = _swap(held[high], held[low], gap) if into is None else None
        if two and (one is None or abs(two[0] - gap / 2) < abs(one[0] - gap / 2)):
            move(two[1], high, low)
            move(two[2], low, high)
            return True
        if one:
            move(one, high, low)
        return one is not None

    for _ in range(8 * len(slots)):
        rising = sorted(range(n_shards), key=loads.__getitem__)
        if not any(evened(high, low) for high in reversed(rising) for low in (rising if into is None else [into])):
            break
    return [replace(s, shard=home[s.slot]) for s in slots]


def grow(slots: list[Slot], n_shards: int) -> list[Slot]:
    """A version with one more shard, which takes slots from the others; no slot moves between the old ones."""
    return edit(slots, n_shards + 1, into=n_shards)


def save_map(spark: SparkSession, slots: list[Slot], path: str, version: int) -> None:
    """Store a version; ``first_place`` is the number of rows of the shard's slots before this one."""
    places: dict[int, int] = {}
    rows = []
    for s in sorted(slots, key=lambda s: s.slot):
        rows.append((s.slot, s.shard, s.bytes, s.rows, s.salted, places.get(s.shard, 0)))
        places[s.shard] = places.get(s.shard, 0) + s.rows
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def load_slots(spark: SparkSession, path: str, version: int) -> list[Slot]:
    return [Slot(r["slot"], r["shard"], r["bytes"], r["rows"], r["salted"]) for r in load_map(spark, path, version).collect()]


def measured(rows: DataFrame, slots: list[Slot], hot_times: float = 4.0, hot_rows: int = 64) -> list[Slot]:
    """The map's slots with the bytes and rows of ``rows`` (key, row, size); hot slots are marked as salted."""
    n = len(slots)

    def loads(salted: list[int]) -> dict[int, tuple[int, int]]:
        found = _dealt(rows, salted, n).groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in found.collect()}  # a row a slot

    got = loads([])
    mean = sum(r for _, r in got.values()) / n
    salted = sorted(s for s, (_, r) in got.items() if r > max(hot_rows, hot_times * mean))
    got = loads(salted) if salted else got
    marked = set(salted)
    return [replace(s, bytes=got.get(s.slot, (0, 0))[0], rows=got.get(s.slot, (0, 0))[1], salted=s.slot in marked) for s in slots]


def narrow(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key, row) of every row."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        size_of(F.col(text)).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        slot_key(F.col(doc_id), F.col(text)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def shard(docs: DataFrame, n_shards: int = 16, n_slots: int = 4096, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot (place in the shard, from 0 without gaps), grown_shard, virtual_slot.

    The law is ``bytes``: shards hold nearly equal sizes. Null texts are empty; null ids are placed by their text.
    Rows with equal ids and texts share a slot unless they are so many that it is salted; then which copy goes
    where follows the order of the input's files. Other columns are ignored, whatever their names. An empty
    table gives an empty result. The map's versions (0 dealt round, 1 rebalanced) are stored under ``path``,
    which defaults to a new folder in the shared one.
    """
    spark = docs.sparkSession
    rows = materialize(narrow(docs, doc_id, text), "shard-rows")
    path = path or f"{shared_dir(spark)}/slot-map-{rows._scratch_path.rpartition('-')[2]}"
    initial = measured(rows, first_map(n_slots, n_shards))
    save_map(spark, initial, path, 0)
    save_map(spark, edit(initial, n_shards), path, 1)
    at = load_map(spark, path, 1).select(F.col("slot").alias("virtual_slot"), "shard", "first_place")
    salted = [s.slot for s in initial if s.salted]
    placed = _dealt(rows, salted, n_slots).join(F.broadcast(at), "virtual_slot")  # n_slots rows
    order = Window.partitionBy("virtual_slot").orderBy("key", "doc_id", "row")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("first_place") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def write_shards(docs: DataFrame, map_path: str, version: int, out: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write whole rows under ``out`` in a folder a shard, as a stored version of the map has it."""
    spark = docs.sparkSession
    slots = load_slots(spark, map_path, version)
    key, row, at, home = (_free(docs, x) for x in ("key", "row", "slot", "shard"))
    keyed = docs.withColumn(key, slot_key(F.col(doc_id), F.col(text))).withColumn(row, F.monotonically_increasing_id())
    own = _slot(F.col(key), len(slots))
    salted = [s.slot for s in slots if s.salted]
    keyed = keyed.withColumn(at, F.when(own.isin(salted), _slot(F.xxhash64(key, row), len(slots))).otherwise(own) if salted else own)
    shards = load_map(spark, map_path, version).select(F.col("slot").alias(at), F.col("shard").alias(home))
    placed = keyed.join(F.broadcast(shards), at).repartition(home, at).sortWithinPartitions(home, at, key)
    placed.select(*docs.columns, home).write.partitionBy(home).parquet(out)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` bears."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
