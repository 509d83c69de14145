"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame operations only.

The ring has ``RING`` places. Every shard owns ``vnodes`` of them; the arc that ends at such a place
belongs to the shard. A key hashes to a place and lies in the arc around it. A shard takes the keys of
its own arcs, in ring order, until it is full; the rest of an arc goes on clockwise to the next shards
that have room. With ``slack=0`` the capacities add up to the number of rows, so counts differ by one
at most; with more, fewer keys move when a shard is added.

Only counts per place (at most ``RING`` rows, whatever the input) decide the layout. The rows are
dealt by place and a hash of key, size and CRC, and repeated rows are counted before they move: neither
equal texts nor one key with a large share of all rows land in one task.

Defined cases: a null text has no bytes (size 1, CRC 0); very long texts only count with their size and CRC;
a null ``doc_id`` is a key like any other; repeated rows are separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 14
SPLITS = 64  # windows that the rows of one place are dealt to
CHUNK = 1000  # repeated rows that move as one


def ring(spark, shards: int, vnodes: int) -> DataFrame:
    """One row per place of the ring: place, arc (number of the arc, clockwise), owner (its shard)."""
    nodes = (
        spark.range(shards * vnodes)
        .select(F.floor(F.col("id") / vnodes).cast("int").alias("owner"), (F.col("id") % vnodes).alias("nth"))
        .select("owner", F.pmod(F.xxhash64(F.lit("vnode"), "owner", "nth"), F.lit(RING)).alias("end"))
        .groupBy("end")
        .agg(F.min("owner").alias("owner"))
    )
    arcs = nodes.select("end", "owner", (F.row_number().over(Window.orderBy("end")) - 1).alias("arc"))
    bounds = arcs.select("arc", "owner", "end", F.coalesce(F.lag("end").over(Window.orderBy("end")), F.lit(-1)).alias("start"))
    inner = bounds.select("arc", "owner", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("place"))
    tail = bounds.agg(F.max("end").alias("last"), F.min_by("owner", "arc").alias("owner")).where(F.col("last") < RING - 1)
    wrapped = tail.select(F.lit(0).alias("arc"), "owner", F.explode(F.sequence(F.col("last") + 1, F.lit(RING - 1).cast("long"))).alias("place"))
    return inner.unionByName(wrapped)


def place(key) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("key"), key), F.lit(RING))


def layout(counts: DataFrame, places: DataFrame, shards: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """From the rows per place: where each place starts in its arc, and which stretch of each arc goes where.

    Both results are bounded: a row per place, and at most ``shards + 1`` rows per arc.
    """
    full = places.join(F.broadcast(counts), "place", "left").select("place", "arc", "owner", F.coalesce("n", F.lit(0)).alias("n"))
    before = Window.partitionBy("arc").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = full.select("place", "arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    arcs = full.groupBy("arc").agg(F.min("owner").alias("owner"), F.sum("n").alias("n"))
    all_arcs = arcs.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("arc", "owner", "n"))).alias("arcs"))
    if slack:
        room = f"transform(sequence(0, {shards - 1}), s -> cast(ceil({1 + slack} * total / {shards}) as bigint))"
    else:
        room = f"transform(sequence(0, {shards - 1}), s -> cast(total div {shards} + if(s < total % {shards}, 1, 0) as bigint))"
    piece = "array<struct<arc:int,shard:int,lo:bigint,hi:bigint,late:int>>"
    state = f"named_struct('room', room, 'pieces', cast(array() as {piece}))"
    # First each arc at its own shard, in ring order; then what is left over, clockwise.
    home = f"""aggregate(arcs, {state}, (st, x) -> named_struct(
        'room', transform(st.room, (r, i) -> if(i = x.owner, r - least(r, x.n), r)),
        'pieces', if(least(st.room[x.owner], x.n) > 0 or x.n > 0, concat(st.pieces, array(named_struct(
            'arc', cast(x.arc as int), 'shard', cast(x.owner as int), 'lo', 0L, 'hi', least(st.room[x.owner], x.n), 'late', 0))), st.pieces)))"""
    walk = f"""aggregate(filter(over, x -> x.hi < x.n), named_struct('room', home.room, 'pieces', cast(array() as {piece})), (st, x) -> aggregate(
        x.next, named_struct('room', st.room, 'pieces', st.pieces, 'at', x.hi), (t, s) -> named_struct(
            'room', transform(t.room, (r, i) -> if(i = s, r - least(r, x.n - t.at), r)),
            'pieces', if(least(t.room[s], x.n - t.at) > 0, concat(t.pieces, array(named_struct(
                'arc', x.arc, 'shard', cast(s as int), 'lo', t.at, 'hi', t.at + least(t.room[s], x.n - t.at), 'late', 1))), t.pieces),
            'at', t.at + least(t.room[s], x.n - t.at)),
        t -> named_struct('room', t.room, 'pieces', t.pieces)))"""
    one = (
        all_arcs.withColumn("room", F.expr(room))
        .withColumn("home", F.expr(home))
        .withColumn("owners", F.expr("transform(arcs, x -> x.owner)"))
        .withColumn("counts", F.expr("map_from_entries(transform(arcs, x -> struct(cast(x.arc as int), x.n)))"))
        .withColumn("spilt", F.expr("filter(home.pieces, p -> p.hi < counts[p.arc])"))
        .withColumn(
            "over",
            F.expr("""transform(spilt, p -> named_struct('arc', p.arc, 'hi', p.hi, 'n', counts[p.arc],
                'next', array_distinct(concat(slice(owners, p.arc + 1, size(owners)), slice(owners, 1, p.arc + 1)))))"""),
        )
        .withColumn("late", F.expr(walk))
    )
    pieces = one.select(F.explode(F.expr("filter(concat(home.pieces, late.pieces), p -> p.hi > p.lo)")).alias("p")).select("p.*")
    before = Window.partitionBy("shard").orderBy("late", "arc", "lo").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(before), F.lit(0)))
    return starts, pieces


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 64, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Give every row a shard and a gapless slot in it: (key, size, text_crc32, shard, slot)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    places = ring(spark, shards, vnodes)
    counts = docs.select(place(F.col(key)).alias("place")).groupBy("place").agg(F.count("*").alias("n"))
    starts, pieces = layout(counts, places, shards, slack)
    # Repeated rows are counted first, and come back in chunks.
    same = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    same = same.groupBy("_key", "size", "text_crc32").agg(F.count("*").alias("n"))
    chunks = same.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {CHUNK} as int)")))).withColumn("n", F.least(F.lit(CHUNK), F.col("n") - F.col("chunk").cast("long") * CHUNK))
    # The rows of a place, however many, are dealt to SPLITS windows; few rows tell where each of these begins.
    mixed = F.xxhash64(F.lit("split"), "_key", "size", "text_crc32", "chunk")
    chunks = chunks.withColumn("place", place(F.col("_key"))).withColumn("mixed", mixed).withColumn("split", F.pmod("mixed", F.lit(SPLITS)).cast("int"))
    until = (Window.unboundedPreceding, -1)
    parts = chunks.groupBy("place", "split").agg(F.sum("n").alias("k"))
    parts = parts.select("place", "split", F.coalesce(F.sum("k").over(Window.partitionBy("place").orderBy("split").rowsBetween(*until)), F.lit(0)).alias("begin"))
    in_order = Window.partitionBy("place", "split").orderBy("mixed", "_key", "size", "text_crc32", "chunk").rowsBetween(*until)
    dealt = chunks.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0))).join(parts, ["place", "split"])
    dealt = dealt.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    ranked = dealt.join(F.broadcast(starts), "place").withColumn("at", F.col("offset") + F.col("begin") + F.col("before") + F.col("nth"))
    hit = (ranked["arc"] == pieces["arc"]) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
    return ranked.join(F.broadcast(pieces), hit).select(
        F.col("_key").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("at") - F.col("lo")).cast("long").alias("slot")
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``: counts at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
