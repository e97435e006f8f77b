"""Web archives: WARC files with revisit records, and a merged index of their captures.

Writing: the payload's SHA-1 finds equal payloads; the record with the largest page_id holds it, the others are revisit records that refer to it.
Each task sorts its records by (URL key, timestamp) and writes them as one run of plain WARC files, through Spark's own text writer
(records are separated by the two line ends that end a WARC record), so any store Spark writes to will do.

Reading: files are read whole (``RECORDS_PER_FILE`` bounds them) and cut by Content-Length; payload digests are computed anew.

Index: every file is a sorted run.  Key ranges of all runs are dealt to tasks, and each task merges its pieces of the runs with a loser
tree; (part, at) then is the global order of captures by URL key, timestamp and page.  A URL captured very often is spread over several parts.

A null payload is empty, a null URL has an empty key, null page ids sort first; rows with equal page_id and payload that hold the largest page_id are
all responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bounded, map_arrow, settle, shared_folder

RECORDS_PER_FILE = 4096
ROWS_PER_PART = 100_000
BROADCAST_ROWS = 500_000
MIN_BYTES = 0
#: seconds since 1970 of the first capture, for tables without a capture time
EPOCH = 1704067200
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = ("url_key string, ts string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
         "file string, offset long, length long")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of five hex digits, four letters each."""
    sha = F.sha1(payload)
    letters = []
    for i in range(8):
        v = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then the path, lower case."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return (",".join(reversed(rest[:cut].split("."))) + ")" + (rest[cut:] or "/")).lower()


def captures(pages: DataFrame, ts: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, ts, payload, payload_bytes, payload_digest, record_type, refers_to."""
    when = F.col(ts).cast("timestamp") if ts else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(10**9)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.date_format(F.coalesce(when, F.timestamp_seconds(F.lit(EPOCH))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    shared = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_bytes", "payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("holder"))
    shared = settle(shared.filter("n > 1").drop("n"))
    joined = rows.join(broadcast_bounded(shared, BROADCAST_ROWS), ["payload_bytes", "payload_digest"], "left")
    again = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "url", "ts", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("holder")).alias("refers_to"))


def write_archive(rows: DataFrame, path: str) -> None:
    """Captures as WARC files below path; each file is a run sorted by (URL key, timestamp, page)."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    again = F.col("record_type") == "revisit"
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    length = F.octet_length(block).cast("string")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.col("ts")),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", safe)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)),
                               line("X-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length), F.lit("\r\n"), block)
    host = F.split(F.regexp_extract("url", r"(?:://)?([^/?#]*)", 1), r"\.")
    sorted_runs = rows.select(record.alias("value"), F.reverse(host).alias("h"), "url", "ts", "page_id").sortWithinPartitions("h", "url", "ts", "page_id")
    sorted_runs.select("value").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """Header fields (lower-case names), offset, length and block of every record."""
    at, size = 0, len(data)
    while at < size:
        head = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or head < 0:
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for item in data[at:head].split(b"\r\n")[1:]:
            name, _, value = item.partition(b":")
            fields[name.decode().strip().lower()] = value.decode().strip()
        start = head + 4
        end = start + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end at byte {end}")
        yield fields, at, end + 4 - at, data[start:end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def index_rows(name: str, data: bytes) -> list[tuple]:
    out = []
    for f, offset, length, block in parse_records(data):
        url = f.get("warc-target-uri")
        if f["warc-type"] == "revisit":
            size, digest = int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:")
        else:
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != f["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"{name}: payload of the record at byte {offset} is damaged")
        out.append((url_key(url), f["warc-date"], _page(f["warc-record-id"]), url, f["warc-type"], size, digest, _page(f.get("warc-refers-to")), name, offset, length))
    out.sort(key=_order)
    return out


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[9]


_INDEX_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def read_archive(spark, path: str) -> DataFrame:
    """The index of all records below path; every file's rows are in key order."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        rows = [r for name, data in zip(batch.column("path").to_pylist(), batch.column("content")) for r in index_rows(name, data.as_py())]
        cols = list(zip(*rows)) if rows else [()] * len(_INDEX_NAMES)
        return pa.table([pa.array(c, t) for c, t in zip(cols, _INDEX_TYPES)], names=_INDEX_NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return map_arrow(files, run, INDEX)


def loser_tree_merge(runs: list[list]) -> Iterator[tuple[int, int]]:
    """(run, position) of all keys of the sorted runs, in key order; equal keys in the order of the runs.

    Node i of a tree over k leaves holds the loser of the match played there, so replacing the winner costs one comparison a level.
    """
    k = len(runs)
    if not k:
        return
    at = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an exhausted run comes last."""
        if at[a] >= len(runs[a]):
            return False
        return at[b] >= len(runs[b]) or (runs[a][at[a]], a) < (runs[b][at[b]], b)

    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (a, b) if beats(a, b) else (b, a)
        return winner

    winner = play(1) if k > 1 else 0
    while at[winner] < len(runs[winner]):
        yield winner, at[winner]
        at[winner] += 1
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def _merge_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of all runs in one key range, merged; a part holds about ``ROWS_PER_PART`` rows."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    cols = [table.column(c).to_pylist() for c in ("url_key", "ts", "page_id", "file", "offset")]
    places: dict[str, list[tuple]] = {}
    for i, (key, ts, page, file, offset) in enumerate(zip(*cols)):
        places.setdefault(file, []).append(((key, ts, page is not None, page or 0, offset), i))
    names = sorted(places)
    for name in names:  # pieces of a run normally arrive in its order
        run = places[name]
        if any(a > b for a, b in zip(run, run[1:])):
            run.sort()
    order = [places[names[r]][p][1] for r, p in loser_tree_merge([[x[0] for x in places[n]] for n in names])]
    merged = table.take(pa.array(order, pa.int64())).append_column("at", pa.array(range(len(order)), pa.int64()))
    yield from merged.combine_chunks().to_batches(max_chunksize=10_000)


def merge_index(index: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The index in global order of (URL key, timestamp, page): ``part`` and ``at`` number the rows."""
    index = settle(index)
    parts = max(1, -(-index.count() // rows_per_part))
    dealt = index.repartitionByRange(parts, "url_key", "ts", "page_id", "file", "offset")
    return dealt.mapInArrow(_merge_part, f"{INDEX}, at long").withColumn("part", F.spark_partition_id())


def archive(pages: DataFrame, path: str | None = None, ts: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages as an archive, read it back, and return its merged index."""
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_archive(captures(pages, ts, min_bytes), path)
    return merge_index(read_archive(spark, path))
