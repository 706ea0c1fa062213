"""Document fingerprints by winnowing, in DataFrame functions only.

Word k-grams are hashed, the smallest hash of every window of consecutive grams is chosen (the rightmost on ties), and
its position is kept. Two texts that share a run of gram + window - 1 words share a fingerprint of it. Everything
stays inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, parts, stored


def winnow(df: DataFrame, text_col: str, prefix: str, gram: int = 3, window: int = 8) -> DataFrame:
    """Add ``{prefix}_hash`` (array<int>: the upper half of each chosen gram's 64-bit hash) and ``{prefix}_pos``
    (array<int>: its first word), in text order.

    ASCII white space separates words and case is folded. A text of fewer than ``gram`` words is one gram, one of
    fewer than ``window`` grams one window; a null text or one without words has empty arrays.
    """
    w, h, m, p = (f"_{prefix}_{x}" for x in ("w", "h", "m", "p"))
    out = df.withColumn(w, F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SPACE), lambda x: x != ""))
    grams = f"transform(sequence(0, size({w}) - {gram}), i -> xxhash64({', '.join(f'{w}[i + {k}]' for k in range(gram))}))"
    out = out.withColumn(h, F.expr(f"CASE WHEN size({w}) = 0 THEN array() WHEN size({w}) < {gram} THEN array(xxhash64(concat_ws(' ', {w}))) ELSE {grams} END")).drop(w)
    least = f"least({', '.join(f'{h}[i + {k}]' for k in range(window))})"
    out = out.withColumn(m, F.expr(f"CASE WHEN size({h}) = 0 THEN array() WHEN size({h}) < {window} THEN array(array_min({h})) ELSE transform(sequence(0, size({h}) - {window}), i -> {least}) END"))
    rightmost = "CASE " + " ".join(f"WHEN {h}[i + {k}] = x THEN i + {k}" for k in range(window - 1, -1, -1)) + " END"
    one = f"array(CAST(size({h}) - array_position(reverse({h}), {m}[0]) AS INT))"
    out = out.withColumn(p, F.expr(f"CASE WHEN size({h}) = 0 THEN array() WHEN size({h}) < {window} THEN {one} ELSE array_distinct(transform({m}, (x, i) -> {rightmost})) END")).drop(m)
    chosen = F.expr(f"transform({p}, i -> CAST(shiftright({h}[i], 32) AS INT))")
    return out.withColumn(f"{prefix}_hash", chosen).withColumn(f"{prefix}_pos", F.col(p).cast("array<int>")).drop(h, p)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fingerprint_text(hashes: Column, positions: Column) -> Column:
    """``position:hash`` pairs, comma-joined, with the hash in 8 hexadecimal digits."""
    return F.array_join(F.zip_with(positions, hashes, lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.lower(F.right(F.concat(F.lit("0000000"), F.hex(h)), F.lit(8))))), ",")


def following(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next_id): the next larger id of a table of distinct ids that are not null, the smallest after the largest.

    Ids are range-partitioned and led inside their partition; only each partition's first id crosses, so what is
    brought together is one row a partition, whatever the number of ids.
    """
    spark = ids.sparkSession
    dealt = stored(ids.select(id_col).repartitionByRange(parts(spark), id_col).withColumn("_at", F.spark_partition_id()), "order")
    firsts = dealt.groupBy("_at").agg(F.min(id_col).alias("_first"))
    ends = firsts.withColumn("_after", F.coalesce(F.lead("_first").over(Window.orderBy("_at")), F.min("_first").over(Window.partitionBy()))).drop("_first")
    led = dealt.withColumn("_next", F.lead(id_col).over(Window.partitionBy("_at").orderBy(id_col)))
    return led.join(F.broadcast(ends), "_at").select(id_col, F.coalesce("_next", "_after").alias("next_id"))


#: Documented bound: blocks that ids are cut into, whose limits pass through the driver.
MOST_BLOCKS = 4096


def _places(cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most doc_id, by halving."""
    held = f"from_json('{cuts}', 'array<bigint>')"
    half = "CAST((s.lo + s.hi) DIV 2 AS INT)"
    step = f"CASE WHEN s.lo >= s.hi THEN s WHEN element_at({held}, {half} + 1) <= doc_id THEN named_struct('lo', {half} + 1, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', {half}) END"
    return F.expr(f"aggregate(sequence(0, {len(cuts).bit_length()}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, x) -> {step}, s -> CAST(s.lo AS BIGINT))")


def fingerprint_edits(docs: DataFrame, gram: int = 3, window: int = 8, block_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row's text and of its edited text, in which the last quarter of the code points gives way
    to the first as many of the next document by id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    next_fingerprints (the size of the next document's fingerprint). A null text is empty. Rows with one id are ordered
    by their texts' hashes. A row with a null id has no next document: its tail is cut off, near_next is null. An empty
    table gives an empty one.

    Texts are shuffled once, by blocks of ids of about ``block_rows`` rows, and led inside a block; a block's last row
    takes the first text of the next block, of which there is one a block. Blocks are cut at quantiles of the ids,
    however these are spread; of tables with more than MOST_BLOCKS blocks, they get larger instead (their windows spill).
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = min(MOST_BLOCKS, -(-base.where("doc_id IS NOT NULL").count() // block_rows))
    cuts = base.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 10 * blocks)).head()[0] if blocks > 1 else None
    cuts = sorted(set(cuts or ()))
    spread = F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(4 * parts(spark)))  # null ids need no order
    blocked = base.withColumn("_block", F.when(F.col("doc_id").isNotNull(), _places(cuts)).otherwise(spread)).withColumn("_th", F.xxhash64("text"))
    heads = stored(blocked.where("doc_id IS NOT NULL").groupBy("_block").agg(F.min_by("text", F.struct("doc_id", "_th")).alias("text")), "heads")
    order = following(heads, "_block")
    tails = order.join(heads.select(F.col("_block").alias("next_id"), F.col("text").alias("tail")), "next_id").drop("next_id")
    tails = winnow(tails, "tail", "tail", gram, window)
    rows = winnow(blocked.repartition(parts(spark), "_block"), "text", "own", gram, window)
    by_id = Window.partitionBy("_block").orderBy("doc_id", "_th")
    rows = rows.withColumn("_led", F.lead(F.struct("text", "own_hash")).over(by_id)).join(tails, "_block", "left")
    known = F.col("doc_id").isNotNull()
    rows = rows.withColumn("_next", F.when(known, F.coalesce(F.col("_led")["text"], F.col("tail")))).withColumn("next_hash", F.when(known, F.coalesce(F.col("_led")["own_hash"], F.col("tail_hash"))))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, CAST(n_chars AS INT) - _cut)"), F.expr("substring(coalesce(_next, ''), 1, _cut)"))
    rows = winnow(rows.select("doc_id", "n_chars", "own_hash", "own_pos", "next_hash", edited.alias("edited")), "edited", "new", gram, window)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint_text(F.col("own_hash"), F.col("own_pos")).alias("fingerprint"), fingerprint_text(F.col("new_hash"), F.col("new_pos")).alias("edited_fingerprint"),
        likeness(F.col("own_hash"), F.col("new_hash")).alias("near_edited"), F.when(F.col("next_hash").isNotNull(), likeness(F.col("own_hash"), F.col("next_hash"))).alias("near_next"), F.size("next_hash").cast("long").alias("next_fingerprints"),
    )
