"""Merkle fixity audit of WARC replicas: trees over ordered offset ranges, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stash

#: log2 of the bytes that a range of the lowest level spans.
SPAN = 16
#: log2 of the ranges that a range of the next level holds.
FAN = 5
#: Levels of ranges below the root.
LEVELS = 4


def warc_record(record_id: Column, uri: Column, body: Column) -> Column:
    """The text of a WARC response record; nulls count as empty."""
    body, uri = F.coalesce(body, F.lit("")), F.coalesce(uri, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """``(archive, offset, length, digest, copies)`` of ``records(archive, offset, payload)``: the leaf nodes.

    Rows equal in all are one leaf with a count, folded before the shuffle. A null payload is an empty record, a
    null archive is ``''``; a null offset stays null, a place of its own. Records that come with their ``length``
    and ``digest`` (SHA-256, binary) instead of a payload are taken as they are.
    """
    if "payload" in records.columns:
        payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
        length, digest = F.octet_length(payload), F.unhex(F.sha2(payload, 256))
    else:
        length, digest = F.col("length"), F.col("digest")
    rows = records.select(F.coalesce(F.col("archive").cast("string"), F.lit("")).alias("archive"), F.col("offset").cast("long").alias("offset"), length.cast("long").alias("length"), digest.alias("digest"))
    return rows.groupBy("archive", "offset", "length", "digest").agg(F.count("*").alias("copies"))


def _range(leaf: DataFrame) -> Column:
    """The lowest range of a leaf; records without an offset lie in range -1."""
    return F.coalesce(F.shiftright("offset", SPAN), F.lit(-1).cast("long"))


def tree(leaf: DataFrame, by: tuple[str, ...] = ()) -> list[DataFrame]:
    """The levels above the leaves, lowest first: ``(*by, archive, node, digest)``; the last is the roots, node 0.

    A node of level k covers 2^(SPAN + k * FAN) bytes of offsets. The lowest ranges combine their leaves' SHA-256
    (of offset, length, digest and copies, so no two are equal) word by word by exclusive or: a partial aggregate
    that is as small for a range, or the place without offsets, with a third of all records. A higher node hashes
    its at most 2^FAN children in order, the root what is left. Each level is written once.
    """
    line = F.concat_ws(",", F.coalesce(F.col("offset").cast("string"), F.lit("none")), "length", F.hex("digest"), "copies")
    word = [F.conv(F.substring(F.sha2(line.cast("binary"), 256), 1 + 16 * k, 16), 16, -10).cast("long").alias(f"w{k}") for k in range(4)]
    words = leaf.select(*by, "archive", _range(leaf).alias("node"), *word).groupBy(*by, "archive", "node").agg(*[F.bit_xor(f"w{k}").alias(f"w{k}") for k in range(4)])
    low = words.select(*by, "archive", "node", F.unhex(F.sha2(F.concat_ws(",", *[f"w{k}" for k in range(4)]).cast("binary"), 256)).alias("digest"))
    levels = [stash(low, "fixity-level")]
    children = F.array_sort(F.collect_list(F.struct("node", "digest")))
    digest = F.unhex(F.sha2(F.concat_ws(";", F.transform(children, lambda x: F.concat_ws(",", x["node"].cast("string"), F.hex(x["digest"])))).cast("binary"), 256))
    for level in range(LEVELS):
        up = F.lit(0).cast("long") if level == LEVELS - 1 else F.shiftright("node", FAN)
        upper = levels[-1].select(*by, "archive", up.alias("up"), "node", "digest").groupBy(*by, "archive", "up").agg(digest.alias("digest"))
        levels.append(stash(upper.withColumnRenamed("up", "node"), "fixity-level"))
    return levels


def _differing(level: DataFrame) -> DataFrame:
    """Nodes of a level whose digests differ between side 0 and side 1, or that only one side has."""
    side = lambda k: F.max(F.when(F.col("side") == k, F.hex("digest")))
    return level.groupBy("archive", "node").agg(side(0).alias("a"), side(1).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node")


def audit(reference: DataFrame, replica: DataFrame) -> DataFrame:
    """The records in which ``replica`` differs from ``reference``: ``(archive, offset, status, length, digest, replica_length, replica_digest, copies)``.

    Both are ``(archive, offset, payload)``, or as :func:`leaves` takes them. Roots are compared first; at each level
    only children of differing nodes are read on, and the descent ends where nothing differs. Records equal in
    place, length and digest are one leaf; a side that holds fewer of it lacks ``copies`` of them. If at an offset
    exactly one leaf is left on each side, in equal copies, they are one ``corrupt`` row. Any other leaf left is a
    row of its own: ``missing`` (the replica lacks it) or ``extra`` (the reference does), also where the place has
    other records, and always where records have no offset (null here). Records moved to other offsets are missing
    there and extra here. Equal or empty inputs give no rows.
    """
    sides = [leaves(x).withColumn("side", F.lit(k)) for k, x in enumerate((reference, replica))]
    leaf = stash(sides[0].unionByName(sides[1]), "fixity-leaves")
    levels = tree(leaf, ("side",))
    found = stash(_differing(levels[-1]), "fixity-differing")
    for level in range(LEVELS - 1, -1, -1):
        if found.isEmpty():
            break
        up = F.lit(0).cast("long") if level == LEVELS - 1 else F.shiftright("node", FAN)
        below = levels[level].withColumn("parent", up).join(found.withColumnRenamed("node", "parent"), ["archive", "parent"], "left_semi")
        found = stash(_differing(below), "fixity-differing")
    part = leaf.withColumn("node", _range(leaf)).join(found, ["archive", "node"], "left_semi")
    held = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("copies"))), F.lit(0))
    excess = part.groupBy("archive", "offset", "length", "digest").agg((held(0) - held(1)).alias("n")).where("n <> 0")
    left = stash(excess.select("archive", "offset", "length", F.lower(F.hex("digest")).alias("digest"), F.abs("n").alias("copies"), F.when(F.col("n") > 0, 0).otherwise(1).alias("side")), "fixity-left")
    one = lambda k: F.min(F.when(F.col("side") == k, F.struct("length", "digest", "copies")))
    places = left.where("offset is not null").groupBy("archive", "offset").agg(F.count("*").alias("rows"), one(0).alias("a"), one(1).alias("b"))
    places = places.where((F.col("rows") == 2) & (F.col("a.copies") == F.col("b.copies")))
    corrupt = places.select(
        "archive", "offset", F.lit("corrupt").alias("status"), F.col("a.length").alias("length"), F.col("a.digest").alias("digest"),
        F.col("b.length").alias("replica_length"), F.col("b.digest").alias("replica_digest"), F.col("a.copies").alias("copies"),
    )
    mine, theirs = F.col("side") == 0, F.col("side") == 1
    alone = left.join(places.select("archive", "offset"), ["archive", "offset"], "left_anti").select(
        "archive", "offset", F.when(mine, "missing").otherwise("extra").alias("status"), F.when(mine, F.col("length")).alias("length"), F.when(mine, F.col("digest")).alias("digest"),
        F.when(theirs, F.col("length")).alias("replica_length"), F.when(theirs, F.col("digest")).alias("replica_digest"), "copies",
    )
    return corrupt.unionByName(alone)


def page_records(pages: DataFrame, damaged: Column | None = None, per_archive: int = 1000) -> DataFrame:
    """``(archive, offset, page_id, length, digest, damaged_digest)``: pages as WARC records, laid one after another.

    Records are hashed where they are read, so no html is moved; ``damaged`` is a second form of the record of the
    same length, given the record. ``per_archive`` ids go to an archive; pages without an id go to archives by a
    hash of what they hold. Equal rows follow each other; they are placed as one run, so that any number of them is
    one row where offsets are summed.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    content = F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    home = F.coalesce(F.expr(f"page_id div {per_archive}").cast("string"), F.concat(F.lit("none-"), F.substring(F.md5(content), 1, 3)))
    sha = lambda x: F.unhex(F.sha2(x.cast("binary"), 256))
    rows = pages.select(
        F.concat(F.lit("pages-"), home, F.lit(".warc")).alias("archive"), "page_id", F.octet_length(record).cast("long").alias("length"),
        sha(record).alias("digest"), (sha(damaged(record)) if damaged else F.lit(None).cast("binary")).alias("damaged_digest"),
    )
    runs = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    start = runs.selectExpr("*", "sum(n * length) over (partition by archive order by page_id, digest rows between unbounded preceding and current row) - n * length as start")
    placed = start.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return placed.select("archive", (F.col("start") + F.col("k") * F.col("length")).alias("offset"), "page_id", "length", "digest", "damaged_digest")
