"""Operator 3: WARC archives with a two-level capture index.

Pages are written as gzip members (one WARC record each); of equal payloads the smallest
page id becomes a ``response``, the others ``revisit`` records. The capture index sorts
reversed-host URL keys into compressed blocks, one index shard per key range, with a sparse
block directory beside each shard (first key, offset and length of every block). A lookup
picks the shard by the shards' first keys, binary-searches the directory, inflates one
block, binary-searches its lines and range-reads the one record.

Which pages are revisits is decided on (page id, digest) rows alone; the html is shuffled
once, by page id. Files are written under attempt-unique names and become visible through
the manifests that Spark commits, so lost executors leave no half-read file.

Defined cases: null html counts as empty; a null url has the key ``-`` and no target URI;
null page ids rank after all others; of rows equal in id and payload one is the response
and the others revisit it; an empty table writes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import os
import re
import uuid
import zlib
from functools import lru_cache
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.shared import cut, file_system, new_folder

CRLF = b"\r\n"
CAPTURES = "key string, page_id long, record_type string, file string, offset long, length long"
SHARDS = "shard int, first string, blocks string, directory string, captures long"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: RFC 4648


def url_key(url: str | None) -> str:
    """The reversed-host key of a URL: ``com,example,www)/path?query``."""
    if not url or not url.strip():
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
        port = parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url.strip().lower())
    host = ",".join(reversed(host.split(".")))
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", "%20", f"{host}{f':{port}' if port else ''}){path}".lower())


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id:020d}'}"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{copy}')}>"


def make_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str, copy: int) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", "-" if page_id is None else str(page_id)),
    ]
    if url and url.strip():
        fields.insert(2, ("WARC-Target-URI", re.sub(r"\s", "%20", url.strip())))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-Id", "-" if refers_to is None else str(refers_to)),
        ]
    fields.append(("Content-Length", str(len(block))))
    text = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(text + block + CRLF + CRLF) + press.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    return fields, dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:]), payload


def _archiver(folder: str, date: str):
    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        store, root = file_system(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        at, seen, copy, out = 0, None, 0, None
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to, many in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], batch["many"], strict=True):
                    page_id = None if pd.isna(page_id) else int(page_id)
                    payload = ("" if html is None else html).encode("utf-8", "surrogatepass")
                    digest = sha1_base32(payload)
                    copy = copy + 1 if (page_id, digest) == seen else 0  # rows come sorted by id and payload
                    seen = (page_id, digest)
                    target = None if pd.isna(refers_to) else int(refers_to)
                    revisit = bool(many) and (copy > 0 or target != page_id)
                    member = make_record(page_id, url, payload, digest, target, revisit, date, copy)
                    out = out or store.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                    out.write(member)
                    rows.append((capture_key(url, page_id), page_id, "revisit" if revisit else "response", name, at, len(member)))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["key", "page_id", "record_type", "file", "offset", "length"]).astype({"page_id": "Int64"})
        finally:
            if out:
                out.close()

    return write


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC records into ``folder``; returns the captures (a row per record)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    body = F.coalesce("html", F.lit(""))
    digests = cut(spark, pages.select("page_id", F.unhex(F.sha1(body)).alias("digest"), F.octet_length(body).alias("n")))
    first = digests.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    copies = digests.join(first, "digest").select(F.col("page_id").alias("of"), "digest", "refers_to").distinct()
    rows = pages.withColumn("digest", F.unhex(F.sha1(body)))
    same = rows["page_id"].eqNullSafe(copies["of"]) & (rows["digest"] == copies["digest"])
    # A merge join even where the copies are few: its exchange brings rows equal in id and payload together.
    rows = rows.join(copies.hint("merge"), same, "left").select("page_id", "url", "html", rows["digest"], "refers_to", copies["digest"].isNotNull().alias("many"))
    rows = rows.sortWithinPartitions("page_id", "digest", "url").drop("digest")
    rows.mapInPandas(_archiver(folder, date), CAPTURES).write.mode("overwrite").parquet(f"{folder}/captures")
    return spark.read.parquet(f"{folder}/captures")


def _indexer(folder: str, block_lines: int):
    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, root = file_system(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        directory, lines, first, last, at, n = [], [], None, None, 0, 0
        out = None

        def end_block():
            nonlocal at
            packed = zlib.compress("\n".join(lines).encode(), 6)
            out.write(packed)
            directory.append((lines[0].split("\t", 1)[0], at, len(packed)))
            at += len(packed)
            lines.clear()

        for batch in batches:
            for r in batch.itertuples(index=False):
                if len(lines) >= block_lines and r.key != last:  # equal keys share a block
                    end_block()
                out = out or store.open_output_stream(f"{root}/{name}.cdx", buffer_size=1 << 20)
                first, last, n = first if first is not None else r.key, r.key, n + 1
                lines.append(f"{r.key}\t{r.file}\t{r.offset}\t{r.length}")
        if out is None:
            return
        end_block()
        out.close()
        with store.open_output_stream(f"{root}/{name}.dir") as d:
            d.write("\n".join(json.dumps(x) for x in directory).encode())
        yield pd.DataFrame({"shard": [shard], "first": [first], "blocks": [f"{name}.cdx"], "directory": [f"{name}.dir"], "captures": [n]})

    return write


def build_index(spark: SparkSession, captures: DataFrame, folder: str, block_lines: int = 512) -> list:
    """Write the two-level index; returns its shards in key order (a row per key range, so few)."""
    rows = captures.select("key", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    rows.mapInPandas(_indexer(folder, block_lines), SHARDS).write.mode("overwrite").parquet(f"{folder}/shards")
    return sorted((tuple(r) for r in spark.read.parquet(f"{folder}/shards").collect()), key=lambda r: r[1].encode())


class CaptureIndex:
    """Binary search over shards, blocks and lines, then range reads of records."""

    def __init__(self, folder: str, shards: list):
        self.store, self.root = file_system(folder)
        self.shards = shards
        self.firsts = [s[1].encode() for s in shards]
        self._directory = lru_cache(8)(self._load_directory)
        self._block = lru_cache(16)(self._load_block)
        self.files: dict[str, object] = {}

    def _open(self, name: str):
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            path = f"{self.root}/{name}"
            self.files[name] = open(path, "rb") if os.path.exists(path) else self.store.open_input_file(path)
        return self.files[name]

    def _range(self, name: str, offset: int, length: int) -> bytes:
        f = self._open(name)
        f.seek(offset)
        return f.read(length)

    def _load_directory(self, shard: int):
        with self.store.open_input_file(f"{self.root}/{self.shards[shard][3]}") as f:
            entries = [json.loads(x) for x in f.read().decode().split("\n")]
        return [e[0].encode() for e in entries], entries

    def _load_block(self, shard: int, block: int):
        _, offset, length = self._directory(shard)[1][block]
        lines = [x.split("\t") for x in zlib.decompress(self._range(self.shards[shard][2], offset, length)).decode().split("\n")]
        return [x[0].encode() for x in lines], lines

    def shard_of(self, key: str) -> int:
        return max(0, bisect.bisect_right(self.firsts, key.encode()) - 1)

    def captures(self, key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture of ``key``."""
        if not self.shards:
            return []
        wanted, shard = key.encode(), self.shard_of(key)
        block = max(0, bisect.bisect_right(self._directory(shard)[0], wanted) - 1)
        keys, lines = self._block(shard, block)
        lo, hi = bisect.bisect_left(keys, wanted), bisect.bisect_right(keys, wanted)
        return [(f, int(o), int(n)) for _, f, o, n in lines[lo:hi]]

    def record(self, capture: tuple[str, int, int]):
        return parse_record(self._range(*capture))

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files.clear()


def _looker(folder: str, shards: list):
    def look(batches):
        import pandas as pd

        index = CaptureIndex(folder, shards)
        last, turn = None, 0
        for batch in batches:
            rows = []
            for key in batch["key"]:
                turn = turn + 1 if key == last else 0  # rows that share a key read its captures in turn
                last = key
                fields, http, payload = index.record(index.captures(key)[turn])
                page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id", "-")
                revisit = fields["WARC-Type"] == "revisit"
                rows.append((
                    None if page == "-" else int(page),
                    int(http["Content-Length"]) if revisit else len(payload),
                    fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else sha1_base32(payload),
                    fields["WARC-Type"],
                    None if refers == "-" else int(refers),
                ))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        index.close()

    return look


def read_back(spark: SparkSession, pages: DataFrame, folder: str, shards: list) -> DataFrame:
    """Look every page's key up in the index and read its record."""
    @F.pandas_udf("string")
    def key_of(url, page_id):
        import pandas as pd

        return pd.Series([capture_key(u, None if pd.isna(p) else int(p)) for u, p in zip(url, page_id, strict=True)], dtype=object)

    asked = pages.select(key_of(F.col("url"), F.col("page_id").cast("long")).alias("key"))
    asked = asked.repartitionByRange(max(1, len(shards)), "key").sortWithinPartitions("key")
    return asked.mapInPandas(_looker(folder, shards), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives."""
    folder = new_folder(spark, "warc")
    captures = write_archives(spark, pages, folder)
    return read_back(spark, pages, folder, build_index(spark, captures, folder))


_DIGITS = "list_transform(range(0, 8), lambda g: ('0x' || substr(h, 1 + 5 * g, 5))::BIGINT)"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda j:
        substr('{BASE32}', 1 + CAST(({_DIGITS}[1 + j // 4] >> (15 - 5 * (j % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
      min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
