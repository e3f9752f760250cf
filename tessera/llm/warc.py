"""WARC archives: written with Spark's text writer, read back by verified boundary chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 1000
#: A digest's keeper is sent to so many salted copies, so that pages alike in payload spread over as many tasks.
SALTS = 16


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", compression: str = "gzip") -> None:
    """Write one record per page to WARC files under `path`.

    Of pages with equal payloads of at least MIN_REVISIT bytes the largest key's is a response and the others are
    revisits without a payload; smaller payloads are all responses. Keepers are found by an aggregate on the digest and
    joined back on (digest, salt). Null payload: empty. Null url: about:blank; line breaks in a url are escaped.
    Null key: written as `null`, never a keeper. Repeated keys: a record each. Empty table: no records."""
    body = F.coalesce(F.col(payload), F.lit(""))
    p = pages.select(
        F.col(key).alias("k"), F.regexp_replace(F.coalesce(F.col(url), F.lit("about:blank")), "[\\r\\n]", "%0A").alias("u"), body.alias("body"),
        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"), F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).alias("salt"),
    )
    groups = p.where(F.col("n") >= MIN_REVISIT).groupBy("digest", "n").agg(F.max("k").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    keepers = groups.select("digest", "n", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    r = p.join(keepers, ["digest", "n", "salt"], "left")
    again = F.col("keeper").isNotNull() & ~F.col("k").eqNullSafe(F.col("keeper"))
    stored = F.when(again, F.lit("")).otherwise(F.col("body"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    record = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("k")),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("u"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("keeper")))).otherwise(F.lit("\r\n")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(stored)).cast("string"),
        F.lit(END), http, stored,
    )
    r.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each place where the version line stands: file, offset, and the bytes up to the next such place.

    Spark's text reader splits the files at the version line. The bytes that the blocks of a file hold give each block's
    offset, and the rows of a block, in order, that of each row. Lengths alone are shuffled here; the text goes along."""
    t = spark.read.option("lineSep", VERSION).text(path)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value"))
    t = t.withColumn("n", F.octet_length("value").cast("long") + len(VERSION))
    order = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    head = F.substring_index("value", END, 1)
    t = t.withColumns({"head": head, "body_at": F.octet_length(head).cast("long") + len(END)})
    field = lambda name: F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    t = t.withColumn("length", F.expr(r"try_cast(regexp_extract(head, '(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]+)', 1) as bigint)"))
    whole = F.col("length").isNotNull() & (F.octet_length("value") >= F.col("body_at") + F.col("length"))
    block = F.expr("substring(cast(value as binary), cast(body_at + 1 as int), cast(length as int))")
    light = t.select(
        "file", "block", "nth", "n", "body_at", "length", whole.alias("whole"), field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"),
        field("WARC-Refers-To").alias("refers"), field("WARC-Payload-Digest").alias("digest"), F.when(whole, block).alias("content"),
    )
    http = F.substring_index(F.col("content").cast("string"), END, 1)
    payload = F.expr("substring(content, cast(http_n + 1 as int), greatest(cast(octet_length(content) - http_n as int), 0))")
    light = light.withColumns({"http_n": F.octet_length(http).cast("long") + len(END), "declared": F.regexp_extract(http, r"(?i)\r\nContent-Length:[ \t]*([0-9]+)", 1)})
    light = light.withColumns({"sha": F.sha1(payload), "payload_n": F.octet_length(payload).cast("long")}).drop("content", "http_n")
    light = light.withColumn("off", F.coalesce(F.sum("n").over(order), F.lit(0)) - len(VERSION))
    return light.withColumn("succ", F.col("off") + len(VERSION) + F.col("body_at") + F.col("length") + len(END)).where("off >= 0")


def _reached(c: DataFrame) -> DataFrame:
    """(file, off) of the candidates that a chain of successors reaches from the start of the file.

    Where every candidate's successor is the next candidate, all are reached. In the other files pointers jump: in each
    round the reached set is joined to pointers of twice the length, so a chain of n records takes log2(n) rounds."""
    line = Window.partitionBy("file").orderBy("off")
    c = c.select("file", "off", "succ", F.lead("off").over(line).alias("next"))
    broken = c.where(F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("succ"))).select("file").distinct()
    odd = cut(c.join(broken, "file", "left_semi"))
    good = c.join(broken, "file", "left_anti").select("file", "off")
    if odd.isEmpty():
        return good
    nodes = odd.select("file", "off")
    jump = odd.select("file", "off", F.col("succ").alias("to")).join(nodes.withColumnRenamed("off", "to"), ["file", "to"], "left_semi").select("file", "off", "to")
    reached, n = nodes.where("off = 0"), 0
    while True:
        ahead = reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))
        reached = cut(reached.union(ahead).distinct())
        if (now := reached.count()) == n:
            return good.union(reached)
        n = now
        jump = cut(jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.off"))).select("a.file", "a.off", "b.to"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under `path`: record_id, record_type, refers_to (an id), payload_digest, payload_bytes.

    A version line inside a payload makes a candidate that no chain from the file's start reaches; it is rejected, and
    the record around it is put together again from its pieces. Digest and length of a response are computed from its
    payload; a revisit's are those its headers declare. Unreadable tails are left out. No files or records: no rows."""
    c = cut(_candidates(spark, path))
    kept = c.join(_reached(c), ["file", "off"], "left_semi").where("length is not null")
    split = cut(kept.where("not whole").select("file", "off", "succ", "body_at", "length"))
    if not split.isEmpty():
        text = spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
        pieces = text.join(split.select("file").distinct(), "file", "left_semi")
        pieces = pieces.withColumn("off", F.coalesce(F.sum(F.octet_length("value") + len(VERSION)).over(Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - len(VERSION))
        s = split.select("file", F.col("off").alias("at"), "succ", "body_at", "length")
        joined = pieces.join(s, "file").where((F.col("off") >= F.col("at")) & (F.col("off") < F.col("succ")))
        whole = joined.groupBy("file", "at", "body_at", "length").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("p"))
        text_of = F.array_join(F.transform("p", lambda x: x["value"]), VERSION)
        whole = whole.withColumn("text", text_of).where(F.octet_length("text") >= F.col("body_at") + F.col("length"))
        whole = whole.withColumn("content", F.expr("substring(cast(text as binary), cast(body_at + 1 as int), cast(length as int))"))
        http = F.substring_index(F.col("content").cast("string"), END, 1)
        whole = whole.withColumn("http_n", F.octet_length(http).cast("long") + len(END))
        payload = F.expr("substring(content, cast(http_n + 1 as int), greatest(cast(octet_length(content) - http_n as int), 0))")
        mended = whole.select("file", F.col("at").alias("off"), F.sha1(payload).alias("sha2"), F.octet_length(payload).cast("long").alias("payload_n2"))
        kept = kept.join(mended, ["file", "off"], "left").withColumns({"sha": F.coalesce("sha", "sha2"), "payload_n": F.coalesce("payload_n", "payload_n2")}).where("whole or sha2 is not null")
    revisit = F.col("type") == "revisit"
    return kept.where(F.col("type").isin("response", "revisit")).select(
        F.col("id").alias("record_id"), F.col("type").alias("record_type"), F.when(revisit, F.col("refers")).alias("refers_to"),
        F.when(revisit, F.regexp_replace("digest", "^sha1:", "")).otherwise(F.col("sha")).alias("payload_digest"),
        F.when(revisit, F.expr("try_cast(declared as bigint)")).otherwise(F.col("payload_n")).alias("payload_bytes"),
    )
