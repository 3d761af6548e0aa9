"""Sharding by balanced label propagation, in joins and aggregates alone.

Documents are vertices, links are a table of edges, labels are shards. Documents of each class (groups of about one
size) are dealt out evenly first, which gives each shard its quota of the class. In each round a document asks for the shard
that most of its neighbours of smaller number are in. What all ask for is counted per class and pair of shards, opposite wishes
are paired, so that full shards swap, and only as many are granted as keep every shard within its quota. Rounds go on
until no wish is granted. Groups too large to be moved about (a 64th of a shard or more, so that they are few) have
their places planned before; groups that did not come together are planned into the room that is left, and cut
only if they fit nowhere. Documents without links fill up.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.session import cut_lineage

RANK_BLOCK = 50_000  # rows numbered by one sort
FAR_BLOCKS = 1024  # blocks whose counts are added up by one sort
WISH_BUCKETS = 64  # of hubs, by hash; wishes are granted by whole buckets
LARGE = 64  # groups of at least this part of a shard are planned


def numbered(rows: DataFrame, keys: list[str], unique: str, total: int, name: str) -> DataFrame:
    """Gapless numbers from 0 within `keys`, without sorting a key in one task: rows are numbered inside
    hashed blocks, blocks are offset inside spans of many blocks, and spans by the counts of those before, which
    are few (a row for 51 million rows)."""
    blocks = max(16, -(-total // RANK_BLOCK))
    cut = rows.withColumn("_block", F.pmod(F.xxhash64(unique), F.lit(blocks))).withColumn("_far", F.floor(F.col("_block") / FAR_BLOCKS))
    counts = cut.groupBy(*keys, "_far", "_block").agg(F.count(F.lit(1)).alias("_n"))
    spans = counts.groupBy(*keys, "_far").agg(F.sum("_n").alias("_n"))
    if keys:
        before = Window.partitionBy(*keys).orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
        starts = spans.select(*keys, "_far", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    else:
        found = sorted((r["_far"], r["_n"]) for r in spans.collect())
        starts = rows.sparkSession.createDataFrame(
            [(far, at) for (far, _), at in zip(found, accumulate([0, *[n for _, n in found]]))], "_far long, _start long")
    near = Window.partitionBy(*keys, "_far").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(near), F.lit(0))).join(starts.hint("merge"), [*keys, "_far"])
    offsets = offsets.select(*keys, "_block", (F.col("_before") + F.col("_start")).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(unique)
    placed = cut.join(offsets.hint("merge"), [*keys, "_block"]).withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
    return placed.drop("_block", "_far", "_before")


def shard_of(boundaries: list[int], position: Column) -> Column:
    """The shard whose range holds `position`; range t begins at boundaries[t]."""
    out = F.lit(0)
    for t, low in enumerate(boundaries):
        out = F.when(position >= low, F.lit(t)).otherwise(out) if t else out
    return out.cast("int")


# ---- propagation ----

def star_edges(members: DataFrame) -> DataFrame:
    """(row, to): each document of a group linked with the group's document of smallest number."""
    hubs = members.groupBy("grp").agg(F.min("row").alias("to"))
    return members.select("row", "grp").join(hubs.hint("merge"), "grp").where("row > to").select("row", "to")


def wishes(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, kind, from, to, bucket): documents that are not where most of their neighbours of smaller number are.
    Ties go to the smaller shard. `bucket` is that of the smallest such neighbour, so that a group asks as one."""
    asked = edges.join(labels.select(F.col("row").alias("to"), F.col("shard").alias("_there")).hint("merge"), "to")
    votes = asked.groupBy("row", "_there").agg(F.count(F.lit(1)).alias("_n"), F.min("to").alias("_hub"))
    best = votes.groupBy("row").agg(F.max(F.struct("_n", (-F.col("_there")).alias("_t"), "_hub")).alias("_b"))
    best = best.select("row", (-F.col("_b._t")).cast("int").alias("to"), F.pmod(F.xxhash64("_b._hub"), F.lit(WISH_BUCKETS)).cast("int").alias("bucket"))
    return best.join(labels.withColumnRenamed("shard", "from").hint("merge"), "row").where(F.col("from") != F.col("to"))


def granted(counts: dict[tuple[int, int], list[int]], shards: int) -> dict[tuple[int, int], tuple[int, int]]:
    """How far the wishes of each pair of shards (from, to) are granted, for one class: all of so many buckets of hubs, and
    so many of the next one.

    `counts` has the wishes by bucket. All are granted at first; while a shard gets more than leaves it, it takes
    back wishes from the shard that loses most.
    """
    moved = {pair: sum(c) for pair, c in counts.items()}
    net = [0] * shards
    for (a, b), n in moved.items():
        net[a] -= n
        net[b] += n
    while max(net, default=0) > 0:
        t = net.index(max(net))
        pair = min((p for p in moved if p[1] == t and moved[p]), key=lambda p: (net[p[0]], -moved[p]))
        n = min(net[t], moved[pair], max(1, -net[pair[0]]))
        moved[pair] -= n
        net[t] -= n
        net[pair[0]] += n
    out = {}
    for pair, n in moved.items():
        upto = 0
        while n and n >= counts[pair][upto]:
            n -= counts[pair][upto]
            upto += 1
        if moved[pair]:
            out[pair] = (upto, n)
    return out


def propagate(labels: DataFrame, edges: DataFrame, shards: int) -> tuple[DataFrame, list[int]]:
    """`labels` (row, kind, shard) after rounds of granted wishes, with as many of each kind in each shard as before; and
    the wishes open before each round and at the end: for stars of edges, the edges that are cut. Rounds go on until
    no wish is granted, or as many are open as before."""
    open_: list[int] = []
    while True:
        wanted = cut_lineage(wishes(labels, edges))
        counts: dict[int, dict[tuple[int, int], list[int]]] = {}
        for r in wanted.groupBy("kind", "from", "to", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # kinds x shards^2 x WISH_BUCKETS at most
            counts.setdefault(r["kind"], {}).setdefault((r["from"], r["to"]), [0] * WISH_BUCKETS)[r["bucket"]] = r["n"]
        open_.append(sum(sum(map(sum, c.values())) for c in counts.values()))
        upto = [(k, a, b, *n) for k, c in counts.items() for (a, b), n in granted(c, shards).items()]
        if not upto or len(open_) > 1 and open_[-1] >= open_[-2]:
            return labels, open_
        bound = labels.sparkSession.createDataFrame([((k * shards + a) * shards + b, u, r) for k, a, b, u, r in upto], "_flow long, _upto int, _rest int")  # kinds x shards^2 rows
        flow = ((F.col("kind") * shards + F.col("from")) * shards + F.col("to")).cast("long")
        asking = wanted.withColumn("_flow", flow).join(F.broadcast(bound), "_flow").where(F.col("bucket") <= F.col("_upto"))
        last = numbered(asking.where((F.col("bucket") == F.col("_upto")) & (F.col("_rest") > 0)), ["_flow"], "row", open_[-1], "_turn")
        accepted = asking.where(F.col("bucket") < F.col("_upto")).select("row", F.col("to").alias("_to"))
        accepted = accepted.unionByName(last.where(F.col("_turn") < F.col("_rest")).select("row", F.col("to").alias("_to")))
        labels = cut_lineage(labels.join(accepted.hint("merge"), "row", "left").select("row", "kind", F.coalesce("_to", "shard").alias("shard")))


# ---- groups that did not come together ----

def _takes(n: int, many: int, room: list[int], tight: bool) -> list[int]:
    """How many of `many` groups of n documents each shard takes whole: the fullest shards first
    (`tight`), or each group where most room is."""
    if tight:
        takes = [0] * len(room)
        for t in sorted(range(len(room)), key=lambda t: room[t]):
            takes[t] = min(many - sum(takes), room[t] // n)
        return takes
    low, high = 0, max(room)  # the lowest level that all rooms can be brought down to
    while low < high:
        level = (low + high) // 2
        low, high = (low, level) if sum(max(0, r - level) // n for r in room) <= many else (level + 1, high)
    takes = [max(0, r - low) // n for r in room]
    for _ in range(many - sum(takes)):
        left, t = max((r - k * n, t) for t, (r, k) in enumerate(zip(room, takes)))
        if left < n:
            break
        takes[t] += 1
    return takes


def _cut(n: int, room: list[int]) -> list[tuple[int, int]]:
    """(place in the group up to which, shard) of the pieces of a group that is cut; lessens `room`."""
    pieces, done = [], 0
    while done < n:
        t = max(range(len(room)), key=lambda t: room[t])
        more = min(n - done, room[t])
        room[t] -= more
        done += more
        pieces.append((done, t))
    return pieces


def _plan(sizes: list[tuple[int, int]], quota: list[int], tight: bool):
    """For groups numbered within their size: {size: how many each shard takes}, {(size, number): pieces}
    of those that are cut, and the room that is left. `sizes` are (size, groups), largest first."""
    room, takes, cut, later = list(quota), {}, {}, []
    for n, many in sizes:
        takes[n] = _takes(n, many, room, tight)
        room = [r - k * n for r, k in zip(room, takes[n])]
        for number in range(sum(takes[n]), many):
            if n > max(quota):  # fits nowhere: whole shards first
                cut[n, number] = _cut(n, room)
            else:  # smaller groups may still fit
                later.append((n, number))
    for n, number in later:
        cut[n, number] = _cut(n, room)
    return takes, cut, room


def planned(members: DataFrame, groups: DataFrame, room: list[int], total: int) -> tuple[DataFrame, list[int]]:
    """(row, shard) of the `members` (row, grp) of `groups` (grp, n), whole where they fit; and the room left."""
    sizes = groups.groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()  # sizes add up to the rows, so that few differ
    sizes = sorted(((r["n"], r["many"]) for r in sizes), reverse=True)
    takes, cut, left = min((_plan(sizes, room, tight) for tight in (False, True)), key=lambda plan: len(plan[1]))
    spark = groups.sparkSession
    bounds = spark.createDataFrame([(n, list(accumulate(k))) for n, k in takes.items()], "n long, _bounds array<long>")
    pieces = spark.createDataFrame(
        [(n, number, p) for (n, number), p in cut.items()], "n long, _turn long, pieces array<struct<upto: long, shard: int>>"
    )
    order = numbered(groups, ["n"], "grp", total, "_turn")
    shard = F.size(F.filter("_bounds", lambda b: b <= F.col("_turn")))
    placed = order.join(F.broadcast(bounds), "n").withColumn("shard", F.when(shard < len(room), shard))  # one row per size
    placed = placed.join(pieces.hint("merge"), ["n", "_turn"], "left").select("grp", "shard", "pieces")
    named = cut_lineage(members.select("row", "grp").join(placed.hint("merge"), "grp"))
    inside = numbered(named.where("pieces is not null"), ["grp"], "row", total, "_place")
    piece = F.filter("pieces", lambda p: p["upto"] > F.col("_place"))[0]["shard"]
    return named.where("pieces is null").select("row", "shard").unionByName(inside.select("row", piece.alias("shard"))), left


# ---- all documents ----

def kind_of(n: Column) -> Column:
    """Groups of up to 8 documents are of a kind for each size, larger ones for each power of two."""
    return F.when(n <= 8, n).otherwise(8 + F.floor(F.log2(n))).cast("int")


def dealt(members: DataFrame, kinds: list[tuple[int, int, int]], room: list[int], total: int) -> DataFrame:
    """(row, kind, shard): the documents of each kind in equal parts, as far as `room` has them: parts of whole groups where all
    of a kind have one size. `kinds` are (kind, documents, size or 1), largest first."""
    left, bounds = list(room), []
    for kind, many, size in kinds:
        parts = [size * g for g in _fair(many // size, [r // size for r in left])]
        if sum(parts) < many:  # what does not go in whole
            parts = [p + q for p, q in zip(parts, _fair(many - sum(parts), [r - p for r, p in zip(left, parts)]))]
        left = [r - p for r, p in zip(left, parts)]
        bounds.append((kind, list(accumulate(parts))))
    table = members.sparkSession.createDataFrame(bounds, "kind int, _bounds array<long>")  # a row per kind
    order = numbered(members.select("row", "kind"), ["kind"], "row", total, "_turn").join(F.broadcast(table), "kind")
    return order.select("row", "kind", F.size(F.filter("_bounds", lambda b: b <= F.col("_turn"))).alias("shard"))


def linked_shards(members: DataFrame, quota: list[int], total: int, cuts: list[int] | None = None) -> tuple[DataFrame, list[int]]:
    """(row, shard) of the documents of all groups in `members` (row, grp, n), and the room that is left. `cuts` gets the
    wishes open in each round."""
    room, shards = list(quota), len(quota)
    members = cut_lineage(members.withColumn("kind", kind_of(F.col("n"))))
    large = F.col("n") * LARGE >= max(quota)
    groups = members.groupBy("grp").agg(F.first("n").alias("n"))
    planned_, room = planned(members.where(large), groups.where(large), room, total)
    small = members.where(~large)
    facts = small.groupBy("kind").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("low"), F.max("n").alias("high")).collect()  # 50 rows at most
    kinds = sorted(((r["kind"], r["many"], r["low"] if r["low"] == r["high"] else 1) for r in facts), reverse=True)
    if not kinds:
        return planned_, room
    labels, open_ = propagate(cut_lineage(dealt(small, kinds, room, total)), cut_lineage(star_edges(small)), shards)
    if cuts is not None:
        cuts.extend(open_)
    joined = cut_lineage(labels.join(small.select("row", "grp", "n").hint("merge"), "row"))
    ends = joined.groupBy("grp").agg(F.first("n").alias("n"), F.min("shard").alias("_low"), F.max("shard").alias("_high"))
    apart = cut_lineage(ends.where("_low <> _high").select("grp", "n"))
    whole = cut_lineage(joined.join(apart.select("grp").hint("merge"), "grp", "left_anti").select("row", "shard"))
    held = {r["shard"]: r["n"] for r in whole.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    room = [r - held.get(t, 0) for t, r in enumerate(room)]
    rest, room = planned(joined.drop("shard", "n"), apart, room, total)
    return cut_lineage(planned_.unionByName(whole).unionByName(rest)), room


def _fair(many: int, room: list[int]) -> list[int]:
    """`many` things dealt to the shards so that what is left of their room is as even as can be; less if it is full."""
    many = min(many, sum(room))
    low, high = 0, max(room)
    while low < high:
        level = (low + high) // 2
        low, high = (low, level) if sum(max(0, r - level) for r in room) <= many else (level + 1, high)
    deal = [max(0, r - low) for r in room]
    for t in sorted(range(len(room)), key=lambda t: deal[t] - room[t])[: many - sum(deal)]:
        deal[t] += 1
    return deal


def propagate_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; the law is "rows".

    `size` is the UTF-8 bytes of the text plus 1, `text_crc32` its checksum. Shards hold counts at most
    one apart; slots run from 0 without gaps. `grown_shard` is null, as it is under this law.

    Documents of equal text are linked; a group stays together as far as the quotas let it: it is cut if
    it is above a shard's count, or if larger and equal ones leave no shard with room for it. Null texts have size 1
    and no links, null doc_ids and repeated rows are rows like others, an empty table gives none, other columns are ignored.
    """
    body = F.coalesce("text", F.lit("")).cast("binary")
    facts = docs.select(
        "doc_id", (F.length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.sha2(body, 256)).alias("grp"), F.monotonically_increasing_id().alias("row"),
    )
    facts = cut_lineage(facts)
    total = facts.count()
    quota = [total // shards + (t < total % shards) for t in range(shards)]
    groups = facts.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = facts.where("grp is not null").select("row", "grp").join(groups.hint("merge"), "grp")
    linked, room = linked_shards(members, quota, total)
    alone = facts.select("row").join(linked.select("row").hint("merge"), "row", "left_anti")
    return _filled(facts, linked, alone, [q - r for q, r in zip(quota, room)], quota, total)


def _filled(facts: DataFrame, linked: DataFrame, alone: DataFrame, loads: list[int], quota: list[int], total: int) -> DataFrame:
    """Documents without links take the places that are left, in turn; slots follow."""
    places = [q - l for q, l in zip(quota, loads)]
    bounds = [sum(places[:t]) for t in range(len(places))]
    order = numbered(alone, [], "row", total, "_turn")
    shard = shard_of(bounds, F.col("_turn"))
    start = F.element_at(F.array(*[F.lit(l - b) for l, b in zip(loads, bounds)]), F.col("shard") + 1)
    filled = order.withColumn("shard", shard).select("row", "shard", (F.col("_turn") + start).cast("long").alias("slot"))
    kept = numbered(linked.select("row", "shard"), ["shard"], "row", total, "slot").select("row", "shard", F.col("slot").cast("long").alias("slot"))
    return facts.join(kept.unionByName(filled).hint("merge"), "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
