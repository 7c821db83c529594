"""Merkle fixity audit of WARC replicas (operator 8).

Records are laid out in files, each file ordered by record id, and hashed. A
leaf stands for a record id: it hashes the records that carry the id and the
bytes they take. A node hashes the keys, the offset ranges (relative to the
node) and the hashes of up to ``FANOUT`` children, up to one root. As leaves
are keyed by id and not by place, a lost record changes its own branch only.

Every level is written once. An audit compares the roots of two replicas and
then fetches children of mismatching nodes only, level by level, down to the
records. Everything is DataFrame operations; no node gathers more than
``FANOUT`` rows, and the texts are hashed before anything is shuffled.

Ids that more than ``RECORDS_PER_FILE`` different records of a file's range
share (missing ids among them) are dealt over parts of that file by hash, the
same parts in both replicas; equal records are counted, not gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.graph import cut_lineage

FANOUT = 16
RECORDS_PER_FILE = FANOUT * FANOUT


def record(uri: Column, payload: Column, record_id: Column) -> Column:
    """A WARC/1.1 resource record as text."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """page_id, n (bytes), h (SHA-256 of the record), copies: the different records of an archive of ``pages``."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rec = p.select("page_id", record(F.col("url"), F.col("html"), F.col("page_id")).alias("r"))
    rec = rec.select("page_id", F.octet_length("r").cast("long").alias("n"), F.sha2(F.encode("r", "UTF-8"), 256).alias("h"))
    return rec.groupBy("page_id", "n", "h").agg(F.count("*").alias("copies"))


@dataclass
class Archive:
    """Records with their place, and the levels of the tree from the leaves (0) to the root."""

    rows: DataFrame
    levels: list[DataFrame]


#: Keys of a node: range of ids, part of it, place of the id in it.
_KEY = ("hi", "part", "lo")
_UP = tuple(f"up_{c}" for c in _KEY)


def layout(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both record tables with their keys, and which key each level of the trees divides."""
    keyed = [cut_lineage(x.withColumn("hi", F.coalesce(F.floor(F.col("page_id") / RECORDS_PER_FILE).cast("long"), F.lit(0).cast("long")))) for x in (a, b)]
    counts = [x.groupBy("hi").agg(F.count("*").alias("m")) for x in keyed]
    crowded = counts[0].union(counts[1]).groupBy("hi").agg(F.max("m").alias("m")).filter(F.col("m") > RECORDS_PER_FILE)
    crowded = crowded.select("hi", F.ceil(F.col("m") / RECORDS_PER_FILE).cast("long").alias("parts"))
    out = []
    for x in keyed:
        x = x.join(crowded, "hi", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("h"), F.col("parts"))).cast("long"))
        out.append(x.withColumn("lo", F.coalesce(F.pmod("page_id", F.lit(RECORDS_PER_FILE)), F.lit(0)).cast("long")).drop("parts"))
    most_parts = crowded.agg(F.max("parts")).first()[0] or 1
    most_hi = max((x.agg(F.max(F.abs("hi"))).first()[0] or 0) for x in keyed)
    return out[0], out[1], ["lo", "lo", *["part"] * _depth(most_parts - 1), *["hi"] * _depth(most_hi)]


def _depth(n: int) -> int:
    d = 0
    while n > 0:
        n //= FANOUT
        d += 1
    return d


def _places(rows: DataFrame) -> DataFrame:
    """Adds a record's place and first byte in its file. Copies of a record lie together, so they are placed as one."""
    w = Window.partitionBy("hi", "part").orderBy(F.col("page_id").asc_nulls_first(), "h").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("place", F.sum("copies").over(w) - F.col("copies")).withColumn("first", F.sum(F.col("n") * F.col("copies")).over(w) - F.col("n") * F.col("copies"))


def _leaves(rows: DataFrame) -> DataFrame:
    """A node for each id: the sum of its records' hashes, so their order and number take no room."""
    words = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    x = rows.groupBy(*_KEY).agg(F.sum(F.col("n") * F.col("copies")).alias("size"), F.sum("copies").alias("c"), *(F.sum(w * F.col("copies")).alias(f"w{i}") for i, w in enumerate(words)))
    return x.select(*_KEY, "size", _sha(F.concat_ws(",", "c", *(F.col(f"w{i}").cast("string") for i in range(4)))).alias("node"))


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _up(key: str) -> list[Column]:
    """The key of the parent."""
    return [F.floor(F.col(c) / FANOUT).cast("long").alias(c) if c == key else F.col(c) for c in _KEY]


def _parents(nodes: DataFrame, key: str) -> DataFrame:
    kid = F.struct(F.pmod(key, F.lit(FANOUT)).alias("k"), "size", "node")
    up = nodes.select(*_up(key), kid.alias("kid")).groupBy(*_KEY).agg(F.sort_array(F.collect_list("kid")).alias("kids"))
    start = F.aggregate("kids", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")), lambda s, x: F.struct((s["at"] + x["size"]).alias("at"), F.concat(s["text"], x["k"].cast("string"), F.lit(":"), s["at"].cast("string"), F.lit("+"), x["size"].cast("string"), F.lit(":"), x["node"], F.lit(",")).alias("text")))
    return up.withColumn("s", start).select(*_KEY, F.col("s.at").alias("size"), _sha(F.col("s.text")).alias("node"))


def archive(rows: DataFrame, steps: list[str]) -> Archive:
    rows = cut_lineage(_places(rows))
    levels = [cut_lineage(_leaves(rows))]
    for key in steps:
        levels.append(cut_lineage(_parents(levels[-1], key)))
    return Archive(rows, levels)


def corrupt_leaves(a: Archive, b: Archive, steps: list[str]) -> DataFrame:
    """hi, part, lo of the leaves that differ. Equal roots end the audit; else only children of differing nodes are fetched."""
    wrong: DataFrame | None = None
    for level in range(len(steps), -1, -1):
        p, q = (x.levels[level].select(*_KEY, F.col("node").alias(n)) for x, n in ((a, "h"), (b, "g")))
        if wrong is not None:
            p, q = (x.withColumns(dict(zip(_UP, _up(steps[level])))).join(wrong, list(_UP), "left_semi").drop(*_UP) for x in (p, q))
        diff = p.join(q, list(_KEY), "full").filter(~F.col("h").eqNullSafe(F.col("g")))
        if level == 0:
            return diff.select(*_KEY)
        wrong = cut_lineage(diff.select(*(F.col(c).alias(u) for c, u in zip(_KEY, _UP))))
        if wrong.isEmpty():
            break
    return a.rows.limit(0).select(*_KEY)


def compare(a: Archive, b: Archive, steps: list[str]) -> DataFrame:
    """The differing records: page_id, h, missing (copies that b lacks), extra (copies that a lacks), swapped (b has other records under the id)."""
    leaf = cut_lineage(corrupt_leaves(a, b, steps))
    x, y = (t.rows.join(leaf, list(_KEY), "left_semi").select(*_KEY, "page_id", "h", F.col("copies").alias(c)) for t, c in ((a, "ca"), (b, "cb")))
    one = x.select(*_KEY, "page_id", "h", "ca", F.lit(0).cast("long").alias("cb")).union(y.select(*_KEY, "page_id", "h", F.lit(0).cast("long").alias("ca"), "cb"))
    one = one.groupBy(*_KEY, "page_id", "h").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    one = one.withColumn("missing", F.greatest(F.col("ca") - F.col("cb"), F.lit(0))).withColumn("extra", F.greatest(F.col("cb") - F.col("ca"), F.lit(0))).filter("missing > 0 or extra > 0")
    by_id = one.groupBy("page_id").agg(F.sum("missing").alias("lost"), F.sum("extra").alias("new"))
    one = _with(one, by_id, ["page_id"], "inner")
    return cut_lineage(one.select(*_KEY, "page_id", "h", "missing", "extra", ((F.col("lost") > 0) & (F.col("new") > 0)).alias("swapped")))


def _with(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joins on keys that may be null; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right, on, how).drop(*(f"_{k}" for k in keys))


def _reported(rows: DataFrame, found: DataFrame, gone: str, status: Column) -> DataFrame:
    """Rows joined to what was found about them, a row for each copy; the last ``gone`` copies have the status."""
    x = _with(rows, found.select("page_id", "h", F.col(gone).alias("gone"), status.alias("status")), ["page_id", "h"], "left")
    x = x.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return x.select(
        "page_id", F.col("hi").alias("file_id"), F.col("part"), (F.col("place") + F.col("i")).alias("place"), (F.col("first") + F.col("i") * F.col("n")).alias("first_byte"), F.col("n").alias("n_bytes"), F.col("h").alias("record_sha256"),
        F.when(F.col("i") >= F.col("copies") - F.coalesce("gone", F.lit(0)), F.col("status")).otherwise("intact").alias("status"),
    )


def audit_pages(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of an archive of ``pages`` with its place, hash and audit status, then the replica's extra ones.

    Both have page_id, url and html. A record is ``intact``, ``changed`` (the
    replica has another one under its id), ``missing`` in the replica, or
    ``extra`` there (with its place there). Null payloads and addresses are
    empty; rows without an id are records of their own; repeated rows are
    records each, of which the lacking ones are reported; empty tables are
    archives without records; other columns are ignored.
    """
    a, b, steps = layout(records(pages), records(replica))
    a, b = archive(a, steps), archive(b, steps)
    found = compare(a, b, steps)
    mine = _reported(a.rows, found, "missing", F.when(F.col("swapped"), "changed").otherwise("missing"))
    more = found.filter("extra > 0 and not swapped")
    extra = _reported(b.rows, more, "extra", F.lit("extra")).filter("status = 'extra'")
    return mine.union(extra)
