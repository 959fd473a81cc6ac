"""WARC archives in seekable Zstandard bundles: independent frames, a footer seek table, an index of records."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import SALTS, fresh_path, materialise

#: Bytes of records before compression: a frame is closed past the first, a bundle past the second.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25
#: Tasks that bundles are read with at most.
MOST_TASKS = 20_000
# Fixed values of the seekable format: the skippable frame that holds the seek table, and its footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: The date of records, unless the caller gives another.
WARC_DATE = "2024-01-01T00:00:00Z"


def open_store(uri: str):
    """(file system, path) of a path or uri; any store that Arrow knows, also under Hadoop's names of S3."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    if colon and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return fs.FileSystem.from_uri(uri if colon or uri.startswith("file:") else f"file://{uri}")


#: Record names: an id of any characters, escaped, and the name of a missing one.
PAGE, NO_PAGE = "urn:page:", "urn:page-without-id"


def record_name(page_id: str | None) -> str:
    return NO_PAGE if page_id is None else PAGE + quote(page_id, safe="", errors="surrogatepass")


def page_of(name: str) -> str | None:
    return unquote(name.removeprefix(PAGE), errors="surrogatepass") if name.startswith(PAGE) else None


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer of a bundle: a skippable frame that lists the compressed and plain size of each frame."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open bundle, from its footer."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 128 else 8
    f.seek(size - 9 - n * width)
    raw, out, at = f.read(n * width), [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", raw, i * width)
        out.append((at, c, d))
        at += c
    return out


def warc_record(page_id: str | None, url: str, kind: str, digest: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, with the payload's length, and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_name(page_id)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_name(refers_to)}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a frame; raises where the bytes are no whole records."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        n = int(head["Content-Length"])
        yield head, data[cut + 4 : cut + 4 + n]
        if data[cut + 4 + n : cut + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        at = cut + 8 + n


def plan_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, url, html, kind, refers_to): of records with equal payloads of ``min_bytes`` or more, the largest id is the response.

    Equal payloads are found by SHA-1 and length. The payload moves once, salted, so that one payload that
    a third of the pages share is dealt to many tasks, also where whole rows repeat; any salt gives the same row.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "utf-8")))).withColumn("n", F.octet_length("html"))
    shared = rows.groupBy("sha", "n").agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("k")).where((F.col("k") > 1) & (F.col("n") >= min_bytes) & F.col("holder").isNotNull())
    shared = materialise(shared.select("sha", "n", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "warc-shared")
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(shared, ["sha", "n", "salt"], "left")
    revisit = F.col("holder").isNotNull() & ~F.col("id").eqNullSafe(F.col("holder"))
    return rows.select("id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("holder")).alias("refers_to"))


def write_bundles(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = WARC_DATE
) -> DataFrame:
    """Write a record per row into bundles below ``path`` (default: a new folder in the shared one); return the index.

    The index has a row per record: id, ``bundle`` (uri), ``frame`` (its number in the bundle),
    ``frame_at`` and ``frame_bytes`` (where it lies), ``record_at`` and ``record_bytes`` (within the frame,
    decompressed), ``payload_digest``, ``record_type``, ``refers_to``. A bundle of about 32 MB is a series of
    independent Zstandard frames of about 256 KB, each of whole records, then a seek table in a skippable
    frame: any Zstandard reader reads it through, a seekable one jumps.

    Each task writes bundles of its own under names that no other attempt uses, and only a task that ends
    well gives index rows, so a retried or doubled task leaves at worst a file that no row names.

    Null html is an empty payload, a null url an empty target. Ids of any characters are escaped in the headers; null
    ids have a name of their own. In a
    group of equal payloads they revisit the largest id, if there is one. Rows that repeat an id are all
    written; those that share the payload too are alike (all response, or all revisit). An empty table writes
    nothing and gives an empty index.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    kind_of_id = pages.schema[id_col].dataType.simpleString()
    planned = plan_revisits(pages, id_col, url_col, html_col, min_bytes)
    plain = planned.select(F.col("id").cast("string").alias("id"), "url", "html", "kind", F.col("refers_to").cast("string").alias("refers_to"))
    schema = "id string, bundle string, frame int, frame_at long, frame_bytes long, record_at long, record_bytes long, payload_digest string, record_type string, refers_to string"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3, write_checksum=True)
        out, frames, rows, waiting, size, at = None, [], [], [], 0, 0

        def close_frame():
            nonlocal waiting, size, at, rows
            data = b"".join(r for _, r in waiting)
            packed = zip_.compress(data)
            out.write(packed)
            inside = 0
            for meta, r in waiting:
                rows.append((meta[0], uri, len(frames), at, len(packed), inside, len(r), *meta[1:]))
                inside += len(r)
            frames.append((len(packed), len(data)))
            at += len(packed)
            waiting, size = [], 0

        def close_bundle() -> pd.DataFrame:
            nonlocal out, frames, rows, at
            if waiting:
                close_frame()
            out.write(seek_table(frames))
            out.close()
            done = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out, frames, rows, at = None, [], [], 0
            return done

        written = 0
        for b in batches:
            for i, url, html, kind, refers in zip(b["id"], b["url"], b["html"], b["kind"], b["refers_to"], strict=True):
                if out is None:
                    uri = f"{path}/{uuid.uuid4().hex}.warc.zst"
                    store, name = open_store(uri)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    out, written = store.open_output_stream(name, compression=None), 0
                payload = html.encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                refers = refers if isinstance(refers, str) else None
                record = warc_record(i if isinstance(i, str) else None, " ".join(url.split()) if isinstance(url, str) else "", kind, digest, payload, refers, date)
                waiting.append(((i if isinstance(i, str) else None, digest, kind, refers), record))
                size += len(record)
                written += len(record)
                if size >= FRAME_BYTES:
                    close_frame()
                if written >= BUNDLE_BYTES:
                    yield close_bundle()
        if out is not None:
            yield close_bundle()

    index = materialise(plain.mapInPandas(write, schema), "warc-index")
    return index.withColumn("id", F.col("id").cast(kind_of_id)).withColumn("refers_to", F.col("refers_to").cast(kind_of_id)).withColumnRenamed("id", id_col)


def _record_row(head: dict[str, str], block: bytes) -> tuple:
    ident, refers = (page_of(head.get(h, "").strip("<>")) for h in ("WARC-Record-ID", "WARC-Refers-To"))
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[: cut - 4].decode("latin-1").split("\r\n")[1:])
    digest, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
    if head["WARC-Type"] == "response":
        payload = block[cut:]
        if len(payload) != int(http["Content-Length"]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {ident}: the payload doesn't match its length or digest")
    return (ident, head["WARC-Target-URI"], int(http["Content-Length"]), digest, head["WARC-Type"], refers, payload)


RECORD = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _tasks(bundles: DataFrame) -> int:
    """How many tasks to read bundles with: rows of names are few bytes, and adaptive execution would merge them."""
    return max(1, min(MOST_TASKS, bundles.count()))


def read_bundles(spark: SparkSession, bundles: DataFrame, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """Every record of the bundles named in column ``bundle``: id, url, payload_bytes, payload_digest, record_type, refers_to.

    Frames are found by the footers' seek tables and read one at a time; payloads are checked against
    length and digest. ``with_payload`` adds ``payload`` (null for revisits).
    """
    schema = RECORD + (", payload binary" if with_payload else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for uri in b["bundle"]:
                store, name = open_store(uri)
                with store.open_input_file(name) as f:
                    for at, packed, plain in read_seek_table(f, f.size()):
                        f.seek(at)
                        data = unzip.decompress(f.read(packed), max_output_size=max(plain, 1))
                        rows = [_record_row(h, x) for h, x in parse_records(data)]
                        yield pd.DataFrame([r if with_payload else r[:6] for r in rows], columns=[c.split()[0] for c in schema.split(", ")])

    names = bundles.select("bundle").distinct()
    rows = names.repartition(_tasks(names)).mapInPandas(read, schema)  # a task a bundle
    return rows.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of chosen index rows: each needed frame is read once by its offset, nothing else is.

    ``with_payload`` gives ``payload`` (null for revisits); lengths and digests are checked either way.
    """
    key = index.columns[0]
    kind = index.schema[key].dataType.simpleString()
    wanted = index.select("bundle", "frame_at", "frame_bytes", "record_at", "record_bytes")
    schema = RECORD + (", payload binary" if with_payload else "")
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for (uri, at, n), rows in b.groupby(["bundle", "frame_at", "frame_bytes"]):
                store, name = open_store(uri)
                with store.open_input_file(name) as f:
                    f.seek(int(at))
                    data = unzip.stream_reader(io.BytesIO(f.read(int(n)))).read()
                out = [_record_row(*next(parse_records(data[p : p + k])))[: len(columns)] for p, k in zip(rows["record_at"], rows["record_bytes"], strict=True)]
                yield pd.DataFrame(out, columns=columns)

    dealt = wanted.repartition(_tasks(wanted.select("bundle").distinct()), "bundle", "frame_at").sortWithinPartitions("bundle", "frame_at")
    rows = dealt.mapInPandas(read, schema)
    return rows.withColumn("id", F.col("id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind)).withColumnRenamed("id", key)
