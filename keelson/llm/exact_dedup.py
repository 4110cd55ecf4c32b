"""Exact deduplication with a log-structured merge index of digests; DataFrame operations only.

Documents are dealt by a hash into memtables of about MEMTABLE rows, so their number follows the corpus. Each memtable
is flushed as one sorted run of level 0: a row per digest with the row that stays so far (most code points, then smallest
id) and the number of copies. Every run carries a filter, a bitmap of the digests that it holds. Compaction merges FANOUT
runs of a level into one run of the next, until one run is left. It looks at the filters first: a digest whose bit no
other run of the merge has set moves up as it is; the others are merged, and the best identifier stays. A digest that
ends with more than one copy is a hit, and every hit is compared byte by byte with the text of the row that stays. Rows
that differ from it although their digests agree are grouped again by their text.

Defined results: a null text counts as an empty one; null ids are allowed and sort last; of rows that are equal in all
of id and text, one stays; columns of the input other than id and text never matter, whatever their names; an empty table gives an empty
result; texts of any length are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Bits in the bitmap of one filter row, as Spark's bitmap functions fix it.
PAGE = 32_768
#: Rows of a memtable, and runs that a compaction merges.
MEMTABLE, FANOUT = 1 << 16, 8
#: Pages, at most, of the bitmap that picks the rows whose text is fetched: 16 MB are broadcast. Beyond some 8 million
#: hits it lets through more rows that aren't hits; the join that follows drops them.
HIT_PAGES = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE + "+", "")


def better(chars: Column, ident: Column) -> Column:
    """Orders rows of equal text: the smallest of these structs stays."""
    return F.struct((-chars).alias("less"), ident.isNull().alias("unnamed"), ident.alias("id"))


def bit(page: Column, offset: Column) -> Column:
    """Whether bit `offset` (from 0) of the bitmap `page` is set."""
    byte = F.conv(F.hex(F.substring(page, (offset / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), offset % 8)) % 2 == 1


def flush(rows: DataFrame, path: str, memtables: int) -> DataFrame:
    """One sorted run per memtable: the digests it has seen, each with its best row and its number of copies."""
    runs = (
        rows.withColumn("run", F.pmod(F.xxhash64("key"), F.lit(memtables)))
        .groupBy("run", "digest")
        .agg(F.min("rank").alias("best"), F.count("*").alias("copies"))
        .sortWithinPartitions("run", "digest")
    )
    return common.keep(runs, path)


def merge(runs: DataFrame, fanout: int, pages: int) -> DataFrame:
    """Each `fanout` runs become one. What no other filter of the merge claims moves up as it is."""
    at = F.pmod(F.xxhash64("digest"), F.lit(pages * PAGE))
    seen = runs.withColumn("into", F.floor(F.col("run") / fanout)).withColumn("page", F.floor(at / PAGE)).withColumn("offset", at % PAGE)
    filters = seen.groupBy("into", "run", "page").agg(F.bitmap_construct_agg("offset").alias("bits"))
    held = filters.groupBy("into", "page").agg(F.collect_list(F.struct("run", "bits")).alias("held"))
    probed = seen.join(held, ["into", "page"]).withColumn("elsewhere", F.exists("held", lambda h: (h["run"] != F.col("run")) & bit(h["bits"], F.col("offset"))))
    alone = probed.filter(~F.col("elsewhere")).select(F.col("into").alias("run"), "digest", "best", "copies")
    merged = probed.filter("elsewhere").groupBy(F.col("into").alias("run"), "digest").agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
    return alone.unionByName(merged).sortWithinPartitions("run", "digest")


def index_of(rows: DataFrame, n_rows: int, home: str, *, memtable: int = MEMTABLE, fanout: int = FANOUT) -> DataFrame:
    """rows: key, digest, rank. One row per digest: digest, best, copies."""
    left, level = max(1, -(-n_rows // memtable)), 0
    runs = flush(rows, f"{home}/level0", left)
    while left > 1:
        # about 10 bits for each digest of a run, in whole pages
        pages = max(1, -(-memtable * fanout**level * 10 // PAGE))
        left, level = -(-left // fanout), level + 1
        runs = common.keep(merge(runs, fanout, pages), f"{home}/level{level}")
    return runs.select("digest", "best", "copies")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, keys: bool = False, **how) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256; with keys also key, the row_key of id and text.

    digest_bits below 256 shortens the digests of the index (tests force collisions with it); the result is the same.
    how: memtable (rows) and fanout of the index.
    """
    spark = docs.sparkSession
    home = common.shared_dir(spark)
    text, ident = F.col(text_col), F.col(id_col)
    norm = normalised(text)
    light = common.keep(
        docs.select(common.row_key(id_col, text_col).alias("key"), ident.alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"), F.sha2(norm, 256).alias("sha")),
        f"{home}/digests",
    )
    digest = F.unhex(F.substring("sha", 1, digest_bits // 4))
    rows = light.select("key", digest.alias("digest"), better(F.col("chars"), F.col("id")).alias("rank"))
    index = index_of(rows, light.count(), home, **how)

    hits = index.filter("copies > 1").select("digest", "best")
    hit_pages = min(HIT_PAGES, -(-hits.count() * 16 // PAGE) + 1)
    at = F.pmod(F.xxhash64("digest"), F.lit(hit_pages * PAGE))
    marks = hits.groupBy(F.floor(at / PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg((at % PAGE).cast("long")).alias("bits"))
    texts = docs.select(
        ident.alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"), norm.alias("norm"),
    ).withColumn("digest", F.unhex(F.substring(F.sha2("norm", 256), 1, digest_bits // 4)))
    # HIT_PAGES rows of 4 KB at most. It lets through every hit and few others.
    likely = texts.withColumn("page", F.floor(at / PAGE).cast("int")).withColumn("offset", (at % PAGE).cast("int"))
    likely = likely.join(F.broadcast(marks), "page").filter(bit(F.col("bits"), F.col("offset"))).drop("page", "offset", "bits")
    found = common.keep(likely.join(hits, "digest"), f"{home}/hits")
    is_best = better(F.col("chars"), F.col("id")) == F.col("best")
    # tables of their own, here and below, so that the joins are between plain exchanges and Spark can split a common digest
    stays = common.keep(found.filter(is_best).groupBy("digest").agg(F.min("norm").alias("stays_norm")), f"{home}/stays")
    # distinct only after it is written: an aggregate above the join would keep Spark from splitting a common digest
    odd = common.keep(found.join(stays, "digest").filter(F.col("norm") != F.col("stays_norm")).select("digest"), f"{home}/odd").distinct()
    groups = index.select(
        "digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), F.col("copies").alias("group_size")
    )
    settled = light.withColumn("digest", digest)
    if odd.isEmpty():
        # every hit is byte for byte the text that stays, so a digest is a group
        out = settled.join(groups, "digest")
    else:
        # digests that texts share by accident: their groups are made by the whole text's hash
        mixed = odd
        plain = settled.join(mixed, "digest", "left_anti").join(groups, "digest")
        apart = settled.join(mixed, "digest", "left_semi")
        again = common.keep(apart.groupBy("sha").agg(F.min(better(F.col("chars"), F.col("id"))).alias("best"), F.count("*").alias("group_size")), f"{home}/again")
        redone = apart.join(
            again.select("sha", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), "group_size"), "sha"
        )
        out = plain.unionByName(redone)
    at_best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    # the same id and text may stand in several rows; the first of them stays
    once = F.row_number().over(W.partitionBy("sha", "id", "chars").orderBy(F.lit(1)))
    best, rest = out.filter(at_best), out.filter(~at_best)
    out = best.withColumn("kept", once == 1).unionByName(rest.withColumn("kept", F.lit(False)))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), *["key"] * keys)
