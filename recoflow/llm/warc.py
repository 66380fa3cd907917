"""WARC archives: write, read back, and merge the capture index.

Records are written by Spark's text writer (its commit protocol survives lost
tasks): a WARC record of text payloads is UTF-8, ends with a line feed, and so
is one "line" of a gzip file; readers go by Content-Length.  Files hold at
most ``RECORDS_PER_FILE`` records, which bounds what a reading task holds.

Reading yields one locally sorted capture run per archive file: (url key,
timestamp, record).  The external merge deals the runs to ranges of the key
space and each task merges its slices of all runs with a loser tree, so
partitions in order are the globally ordered capture histories.  Ranges are
cut on (url key, timestamp, record id): a host or URL that holds a third of
all captures is cut like any other.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm.common import partitions, skew_lookup
from recoflow.session import cut_lineage, table_folder

RECORDS_PER_FILE = 4096
RUN_FIELDS = ("run string, seq long, urlkey string, ts string, record_id string, url string, record_type string, "
              "refers_to string, payload_bytes long, payload_digest string, offset long, length long")
MERGED_FIELDS = RUN_FIELDS + ", part int, pos long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 5 hex digits are 4 base-32 digits."""
    digest = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds n_bytes, digest and refers_to (the response's id; null for a
    response).  Of captures with equal payloads of at least ``min_bytes`` the
    one with the largest id is the response; rows that repeat that id are
    responses too.  A null payload counts as empty; captures with a null id
    are revisits if another capture of their payload has an id."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    d = captures.select("id", "url", "ts", payload.alias("payload"))
    d = d.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    groups = cut_lineage(d.where(F.col("n_bytes") >= min_bytes).groupBy("digest")
                         .agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    j = skew_lookup(d, groups, "digest", "n", ["response"], "id")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")) & (F.col("n_bytes") >= min_bytes)
    return j.select("id", "url", "ts", "payload", "n_bytes", "digest", F.when(revisit, F.col("response")).alias("refers_to"))


def write_archives(captures: DataFrame, path: str, min_bytes: int = 0,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write (id, url, ts, payload) as WARC 1.1 files under ``path``: response
    records with their payload, revisit records that name the response."""
    d = with_revisits(captures, min_bytes)
    urn = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    is_revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(is_revisit, head).otherwise(F.concat(head, F.col("payload")))
    length = F.octet_length(head) + F.when(is_revisit, 0).otherwise(F.col("n_bytes"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")),
        F.lit("\r\nWARC-Date: "), F.coalesce(F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")),
        F.when(url.isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), url)),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(is_revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                  "\r\nWARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"),
        F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))     # the writer adds the last line feed
    d.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\n") \
        .option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str) -> str:
    """Host labels reversed, then the lowered path and query: the sort key of captures."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + rest.lower()


def parse_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive file, by Content-Length; payloads are checked
    against their digests.  Raises on a broken record."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 16)
    at = 0

    def headers() -> dict[str, str]:
        nonlocal at
        out = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            at += len(line)
            name, _, value = line.decode("utf-8").partition(":")
            out[name.strip().lower()] = value.strip()
        at += len(line)
        return out

    while version := stream.readline():
        start = at
        at += len(version)
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {start}")
        h = headers()
        size = int(h["content-length"])
        body_at, before = at, at
        http = headers()
        payload = stream.read(size - (at - before))
        at = body_at + size
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at byte {start} has no end")
        at += 4
        want = h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != want:
            raise ValueError(f"payload of the record at byte {start} does not match its digest")
        name = re.compile(r"<urn:capture:(.*)>")
        yield {"ts": re.sub(r"\D", "", h.get("warc-date", "")), "record_id": name.fullmatch(h["warc-record-id"])[1],
               "url": h.get("warc-target-uri"), "record_type": h["warc-type"],
               "refers_to": name.fullmatch(h["warc-refers-to"])[1] if "warc-refers-to" in h else None,
               "payload_bytes": int(http["content-length"]), "payload_digest": want, "offset": start,
               "length": at - start, "payload": payload if h["warc-type"] == "response" else None}


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """One locally sorted run per archive file (columns RUN_FIELDS)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                rows = []
                for r in parse_archive(data):
                    r.pop("payload")
                    rows.append(r | {"run": name, "urlkey": url_key(r["url"] or "")})
                rows.sort(key=lambda r: (r["urlkey"], r["ts"], r["record_id"], r["offset"]))
                for i, r in enumerate(rows):
                    r["seq"] = i
                if rows:
                    yield pd.DataFrame(rows)[[f.split()[0] for f in RUN_FIELDS.split(", ")]]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, RUN_FIELDS)


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, so replacing the
    winner replays one path of ceil(log2 k) matches."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.k, self.losers = k, [0] * max(k, 1)
        winner = list(range(2 * k))
        for i in range(k):
            winner[k + i] = i
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            win, lose = (a, b) if self._less(a, b) else (b, a)
            winner[node], self.losers[node] = win, lose
        self.top = winner[1] if k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; ends come last, ties go by run."""
        ends = self.at[a] >= len(self.runs[a]), self.at[b] >= len(self.runs[b])
        if ends[0] or ends[1]:
            return not ends[0] if ends[0] != ends[1] else a < b
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator:
        while self.k and self.at[self.top] < len(self.runs[self.top]):
            yield self.runs[self.top][self.at[self.top]]
            self.at[self.top] += 1
            node, win = (self.top + self.k) // 2, self.top
            while node > 0:
                if self._less(self.losers[node], win):
                    self.losers[node], win = win, self.losers[node]
                node //= 2
            self.top = win


def merged_index(runs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """All runs as one order: rows of range ``part`` (ascending) by ``pos``.
    A range holds about rows / n_ranges index entries, which bounds a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        held = [b for b in batches if len(b)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        slices = []
        keys = list(zip(pdf["urlkey"], pdf["ts"], pdf["record_id"], pdf["offset"], range(len(pdf))))
        for _, rows in pdf.groupby("run", sort=True).indices.items():
            order = rows[pdf["seq"].to_numpy()[rows].argsort()]     # the slice of a run stays in its order
            slices.append([keys[i] for i in order])
        out = pdf.iloc[[k[-1] for k in LoserTree(slices)]].copy()
        out["part"], out["pos"] = TaskContext.get().partitionId(), range(len(out))
        yield out
    n = n_ranges or partitions(runs.sparkSession)
    return runs.repartitionByRange(n, "urlkey", "ts", "record_id", "offset").mapInPandas(run, MERGED_FIELDS)


def capture_index(captures: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``captures`` (id, url, ts, payload), read the archives back and
    merge their index.  Null payloads are empty, null urls have no target
    line, null dates sort first, null ids come back as null; repeated rows are
    separate records; an empty table gives an empty index."""
    spark = captures.sparkSession
    path = path or f"{table_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(captures, path, min_bytes)
    return merged_index(cut_lineage(capture_runs(spark, path)))


def pages_index(pages: DataFrame) -> DataFrame:
    """Capture index of (page_id, url, html); capture times follow the page id."""
    epoch = 1_704_067_200      # 2024-01-01T00:00:00Z
    ts = F.timestamp_seconds(F.lit(epoch) + F.pmod(F.col("page_id"), F.lit(1 << 30)))
    caps = pages.select(F.col("page_id").cast("long").alias("id"), "url", ts.alias("ts"), F.col("html").alias("payload"))
    m = capture_index(caps, min_bytes=0)
    as_id = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return m.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    as_id("refers_to").alias("refers_to"))
