"""WARC archives of pages with revisit records, and an external merge of their capture index.

Records are written as text rows whose line separator is the blank line that ends a WARC record, compressed by file, so any file
system that Spark writes to holds them. Archives are cut by records and by mean bytes. Reading inflates and parses record by record, by
Content-Length; a revisit's header has the full payload's length. Each archive gives a run of captures sorted by URL key and
timestamp; runs are cut at the bounds of ranges of (key, timestamp, page, run, place), which hold about RANGE captures each whatever the
input, equal captures included, and each range is merged from its runs by a loser tree, which gives the captures of the whole collection in global order.

Cases: null html is an empty payload; a null url is an empty URL key; rows without a page_id get a record each, which revisits the page
with the largest id of an equal payload if there is one and is a response if not; rows that repeat a page_id with an equal payload
are all the response, those with another payload go by that payload; an empty table gives an empty index; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import apart, cut, shared_dir, table

CRLF = "\r\n"
#: Records of an archive file at most, and bytes of pages it holds on average at most; captures of a range that is merged by one task.
PER_FILE, FILE_BYTES, RANGE = 2000, 32 << 20, 200_000
HEX5, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURE = "url_key string, stamp string, page_id long, run string, seq long, offset long, record_type string, payload_digest string, refers_to long, payload_bytes long"


def digest(payload) -> F.Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    hexed = F.sha1(payload)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0"), HEX5, BASE32) for k in range(8)])


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, record_type, refers_to, payload_bytes, payload_digest). Of equal payloads of `least` bytes or more the largest page_id is the response."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), digest(html.cast("binary")).alias("payload_digest"))
    payload = ["payload_digest", "payload_bytes"]
    owner = pages.groupBy(*payload).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    owner = owner.select("payload_digest", apart("payload_bytes"), "refers_to")
    # identities first, so that the payloads themselves aren't shuffled twice
    other = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    repeat = pages.select("page_id", *payload).join(owner, payload).where(other & (F.col("payload_bytes") >= least)).distinct()
    joined = pages.alias("p").join(repeat.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.payload_digest") == F.col("r.payload_digest")) & (F.col("p.payload_bytes") == F.col("r.payload_bytes")), "left")
    return joined.select("p.*", "refers_to", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"))


def uuid(page_id: F.Column) -> F.Column:
    """A page's record id; records without a page share one by payload and URL."""
    h = F.md5(F.concat(F.lit("capture:"), F.coalesce(page_id.cast("string"), F.concat("payload_digest", F.lit(" "), "url"))))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-"))][:-1], F.lit(">"))


def write(rows: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """One WARC/1.1 record per row of records()."""
    revisit = F.col("record_type") == "revisit"
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"), F.when(revisit, "").otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{CRLF}{name}: "), value)
    head = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", uuid(F.col("page_id"))), line("WARC-Date", stamp),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.coalesce(line("WARC-Page", F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uuid(F.col("refers_to"))), line("WARC-Refers-To-Page", F.col("refers_to").cast("string")), line("WARC-Full-Length", F.col("payload_bytes").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF + CRLF),
    )
    rows.select(F.concat(head, block).alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """The host reversed by labels, then path and query, in lower case: keys of one site sort together."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (parts.path.rstrip("/") or "/").lower() + ("?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else "")


def parse(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of every record of an archive, one at a time; offsets are those of the plain archive."""
    at = 0
    while stream.readline():  # the version
        offset, fields, size = at, {}, len("WARC/1.1\r\n")
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().rstrip(CRLF).partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        stream.read(4)
        at += size + 2 + len(block) + 4
        yield offset, fields, block


def place(page: int | None) -> tuple[bool, int]:
    """Captures without a page come first, as Spark sorts nulls."""
    return page is not None, page or 0


def capture_run(path: str, data: bytes) -> list[tuple]:
    """The captures of one archive, sorted: a run."""
    rows = []
    for at, fields, block in parse(gzip.GzipFile(fileobj=io.BytesIO(data))):
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = fields["WARC-Type"] == "revisit"
        if not revisit and fields["WARC-Payload-Digest"] != f"sha1:{found}":
            raise ValueError(f"{path} at {at}: the payload doesn't match its digest")
        size = int(fields["WARC-Full-Length"]) if revisit else len(payload)
        page = int(fields["WARC-Page"]) if "WARC-Page" in fields else None
        rows.append((url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], page, at, fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Refers-To-Page"]) if revisit else None, size))
    rows.sort(key=lambda r: (*r[:2], *place(r[2]), r[3]))
    return [(*r[:3], path, seq, *r[3:]) for seq, r in enumerate(rows)]


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CAPTURE.split(", ")]
    for batch in batches:
        for path, data in zip(batch.path, batch.content):
            out = pd.DataFrame(capture_run(path, data), columns=names)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def loser_tree(sources: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted sources: inner nodes keep the loser of their match, and only the path of the last winner is played again."""
    k, top = len(sources), (1,)  # a source that has ended loses to all
    heads = [next(((0, x) for x in s), top) for s in sources]
    tree = [-1] * k

    def play(i: int) -> None:
        winner, node = i, (i + k) // 2
        while node:
            other = tree[node]
            if other < 0:
                tree[node] = winner  # the first to arrive waits for its opponent
                return
            if heads[other] < heads[winner]:
                tree[node], winner = winner, other
            node //= 2
        tree[0] = winner

    for i in range(k):
        play(i)
    while k and heads[tree[0]] is not top:
        i = tree[0]
        yield heads[i][1]
        heads[i] = next(((0, x) for x in sources[i]), top)
        winner, node = i, (i + k) // 2
        while node:
            if heads[tree[node]] < heads[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def merge_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of one range, merged. Its rows, about RANGE of them, come sorted by run and place in the run."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    rows = pd.concat(rows, ignore_index=True)
    keys = [(key, stamp, *place(None if pd.isna(page) else int(page)), i) for i, (key, stamp, page) in enumerate(zip(rows.url_key, rows.stamp, rows.page_id))]
    run = rows.run.to_numpy()
    starts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(rows)]
    order = [x[-1] for x in loser_tree([iter(keys[a:b]) for a, b in zip(starts, starts[1:])])]
    yield rows.iloc[order].astype({"page_id": "Int64", "refers_to": "Int64"})


def merged_index(spark: SparkSession, path: str, per_range: int = RANGE) -> DataFrame:
    """Every capture below `path`; partitions follow each other in the order of (url_key, stamp, page_id), and so do the rows of each."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = cut(found.mapInPandas(runs, CAPTURE))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // per_range + 1)
    ranged = found.repartitionByRange(ranges, "url_key", "stamp", "page_id", "run", "seq").sortWithinPartitions("run", "seq")
    return ranged.mapInPandas(merge_range, CAPTURE)


def archive(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Write `pages`, read the archives back and return the merged index.

    Partitions are put together until archives have about PER_FILE records or FILE_BYTES; a partition with more is cut by write().
    """
    rows, size = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    per_file = max(1, min(PER_FILE, rows * FILE_BYTES // size if size else PER_FILE))
    write(records(pages, least).coalesce(rows // per_file + 1), path, per_file)
    return merged_index(pages.sparkSession, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid as names

    path = f"{shared_dir(spark)}/warc-{names.uuid4().hex}"
    return archive(table(spark, sf_dir, "pages"), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(coalesce(html, '')), {a}, 5))::bigint >> {s}) & 31) + 1)::int, 1)"
WARC_SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
                  {" || ".join(_DIGIT.format(a=5 * k + 1, s=s) for k in range(8) for s in (15, 10, 5, 0))} as payload_digest from pages),
o as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as owner from p)
select page_id, payload_bytes, payload_digest, case when page_id = owner then 'response' else 'revisit' end as record_type,
       case when page_id <> owner then owner end as refers_to from o
"""
