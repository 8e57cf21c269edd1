"""WARC archives of pages, and their capture index by an external merge.

Every page becomes one record, its payload the html in UTF-8. Of records with equal payloads of at least
`least` bytes the one with the largest page_id is the response, the others are revisits that refer to it. Each task writes
its records sorted by URL key and timestamp as one gzip archive, which is a sorted run of captures. Reading
back parses the archives by Content-Length. The runs' index rows are dealt to key ranges, and each range merges its part of
all runs with a loser tree, so that the ranges in order are the globally ordered capture history.

Hot payloads are aggregated by digest before they meet their pages. A key range holds (URL key, timestamp, page_id), so
captures of one url spread over several ranges if they are many.

Defined results: null html is an empty payload; null url has no target and an empty key; white space and control
characters in a url are written as %XX; a null page_id is never the response of others, but a response if its payload
has no other; rows that share page_id and payload with the response are responses; an empty table gives an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.tables import folder, release, written

EPOCH = 1_704_067_200  # pages carry no capture time: page_id seconds after this instant
CRLF = "\r\n"
CAPTURES = ("page_id long, urlkey string, timestamp string, record_type string, refers_to long, payload_bytes long, payload_digest string, declared_digest string, "
            "segment string, offset long, length long, payload binary")


def url_key(url: Column) -> Column:
    """Sort-friendly key: reversed host labels, then `)` and the rest; lower-case."""
    rest = F.regexp_replace(F.coalesce(F.lower(url), F.lit("")), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(rest == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substr(rest, F.length(host) + 1)))


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, urlkey, stamp and the record as text, without the two line ends that close it."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("body"))
    base = base.withColumn("size", F.octet_length("body")).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    tops = base.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").drop("n")
    known = base.join(tops, ["digest", "size"], "left").withColumn("revisit", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")))
    known = known.withColumn("stamp", F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), "^$", "about:blank")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("body")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), ident(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: "), F.col("stamp"),
        F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), target), F.lit("")), F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), ident(F.col("top")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return known.select("page_id", url_key(F.col("url")).alias("urlkey"), "stamp", F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, records_per_archive: int = 5000) -> None:
    """Gzip archives of at most so many records, each sorted by URL key and timestamp. Pages are dealt as their digests' join left them."""
    runs = records(pages, least).sortWithinPartitions("urlkey", "stamp", "page_id")
    writer = runs.select("value").write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive)
    writer.text(path)
    del runs, writer
    release(pages.sparkSession)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of an archive's bytes."""
    at = 0
    while at < len(data):
        if data[at:at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = data[end + 4:end + 4 + size]
        if len(block) != size or data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut")
        yield headers, block, at, end + 8 + size - at
        at = end + 8 + size


def _page(ident: str | None) -> int | None:
    value = (ident or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "none") else None


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CAPTURES.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in CAPTURES.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                raw = content.as_py()
                out = []
                for h, block, at, length in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    revisit = h["warc-type"] == "revisit"
                    payload = block[block.index(b"\r\n\r\n") + 4:]
                    out.append((_page(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-date"], h["warc-type"], _page(h.get("warc-refers-to")), None if revisit else len(payload),
                                None if revisit else hashlib.sha1(payload).hexdigest(), h["warc-payload-digest"].removeprefix("sha1:"), path, at, length, payload if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record, with size and digest of the payload itself; revisits take both (and the payload) from the response they refer to."""
    files = spark.read.format("binaryFile").load(path).where("length > 0 and (path like '%.gz' or path like '%.warc' or path like '%.txt')").select("path", "content")
    rows = files.mapInArrow(_read(with_payload), CAPTURES).withColumn("urlkey", url_key(F.col("urlkey")))
    if not with_payload:
        rows, _ = written(rows, "captures")
    full = rows.where("record_type = 'response' and page_id is not null").dropDuplicates(["page_id", "payload_digest"])
    origin = full.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest"), F.struct("payload_bytes", "payload_digest", "payload").alias("o"))
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest", "payload").join(origin, ["refers_to", "declared_digest"], "left")
    return rows.where("record_type <> 'revisit'").unionByName(revisits.select("*", "o.payload_bytes", "o.payload_digest", "o.payload").drop("o"))


class LoserTree:
    """Merges sorted runs: each replay after an item costs one comparison a level."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(runs)
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf, first=True)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head goes first; finished runs go last, equal keys by run."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        x, y = self.key(self.heads[a]), self.key(self.heads[b])
        return x < y or (x == y and a < b)

    def _play(self, leaf: int, first: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if first and self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._before(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.tree[0]] is not None:
            run = self.tree[0]
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one key range: every stretch in order is a run."""
    rows, schema = [], None
    for batch in batches:
        schema = batch.schema
        rows += batch.to_pylist()
    if schema is None:
        return
    key = lambda r: (r["urlkey"], r["timestamp"], r["page_id"] is not None, r["page_id"] or 0)
    runs: list[list] = []
    for r in rows:
        if not runs or runs[-1][-1]["segment"] != r["segment"] or key(r) < key(runs[-1][-1]):
            runs.append([])
        runs[-1].append(r)
    merged = list(LoserTree(runs, key))
    for at in range(0, len(merged), 5000):
        yield pa.RecordBatch.from_pylist(merged[at:at + 5000], schema=schema)


def capture_index(captures: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """Index rows in global order of URL key, timestamp and page_id: partitions in order, and rows in each."""
    index = captures.drop("payload")
    n = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // rows_per_range))
    return index.repartitionByRange(n, "urlkey", "timestamp", "page_id").mapInArrow(_merge, index.schema)


def archived(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the pages' archives in the shared folder, reads them back, and returns their capture index."""
    path = folder(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return capture_index(read_archives(pages.sparkSession, path, with_payload=False))
