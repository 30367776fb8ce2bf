"""Web archives: records written with revisits for equal payloads, capture runs merged into one ordered index, records read back by it."""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import column, shared_folder, slices, written

INDEX = "run string, urlkey string, captured string, page_id long, url string, archive string, offset long, length long, record_type string, digest string"
_INDEX_FIELDS = [f.split() for f in INDEX.split(", ")]
RECORD = "urlkey string, captured string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, archive string, offset long"
_START = datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC)
#: Records after which an archive file is closed and its run of index lines sorted.
RUN_RECORDS, RUN_BYTES = 20_000, 256 << 20
#: Index lines that one merging task takes.
MERGE_LINES = 50_000


def url_key(url: str | None) -> str:
    """Host parts from the right, then path and query, in lower case: captures of a site sort together."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{f':{port}' if port and port not in (80, 443) else ''}){parts.path.lower() or '/'}{f'?{parts.query.lower()}' if parts.query else ''}"


def captured_at(page_id: int | None) -> str:
    """The tables hold no time of capture; a second for each page id stands in."""
    return (_START + datetime.timedelta(seconds=(page_id or 0) % (3 << 30))).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _safe(url: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, compressed by itself. A revisit has the head of the response only, with the length of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {captured_at(page_id)}", f"WARC-Target-URI: {_safe(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parse(member: bytes) -> dict:
    """The record in one compressed member; ValueError if its parts don't fit together."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit its block")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    full = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != full or digest_of(payload) != digest):
        raise ValueError("a payload doesn't fit its digest")
    page = lambda name: None if name is None or "none" in name else int(name.removeprefix("<urn:page:").removesuffix(">"))
    return {
        "captured": fields["WARC-Date"], "page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "refers_to": page(fields.get("WARC-Refers-To")), "payload_digest": digest, "payload_bytes": full, "payload": None if revisit else payload}


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of the match below it, so the next smallest costs one path of matches."""

    def __init__(self, runs: list[list], key):
        self._runs, self._key, self._at = runs, key, [0] * len(runs)
        self._heads = [self._head(i) for i in range(len(runs))]
        self._losers = [0] * max(len(runs), 1)
        k = len(runs)
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self._losers[node] = (a, b) if self._heads[a] <= self._heads[b] else (b, a)
        self._winner = winners[1] if k > 1 else 0

    def _head(self, run: int) -> tuple:
        at = self._at[run]
        return (0, self._key(self._runs[run][at]), run) if at < len(self._runs[run]) else (1, (), run)

    def __iter__(self) -> Iterator:
        while self._runs:
            run = self._winner
            if self._heads[run][0]:
                return
            yield self._runs[run][self._at[run]]
            self._at[run] += 1
            self._heads[run] = self._head(run)
            node = (run + len(self._runs)) // 2
            while node:
                if self._heads[self._losers[node]] < self._heads[run]:
                    run, self._losers[node] = self._losers[node], run
                node //= 2
            self._winner = run


def line_key(line: dict) -> tuple:
    """URL key, time of capture, then what tells captures of one second apart."""
    return line["urlkey"], line["captured"], line["page_id"] is not None, line["page_id"] or 0, line["archive"], line["offset"]


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Archives under `folder`, and their index lines (INDEX), sorted within each run.

    Of pages with equal payloads of `least_bytes` or more, the one with the largest id is written in full and the others are
    revisits of it. A task writes files of its own under names that no other attempt uses; only files of attempts that
    succeeded are in the index. Equal payloads are summed before they are shuffled; pages meet their sum in a join whose hot
    keys Spark can split.

    A null html is an empty payload. A null id comes before all others: it revisits a page that has one, and where no equal page
    has an id all are full. Repeated rows of the page that is written in full are all full. Other columns are not read.
    """
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest = [F.sha1(F.encode("html", "utf-8")).alias("sha1"), F.octet_length("html").alias("bytes")]
    leaders = plain.select("page_id", *digest).where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("leader"), F.count("*").alias("copies")).where("copies > 1")
    led = plain.select("*", *digest).join(leaders.select("sha1", "bytes", "leader"), ["sha1", "bytes"], "left").select("page_id", "url", "html", "leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name, file, lines, offset = "", None, [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal file
            if file:
                file.close()
                lines.sort(key=line_key)
                yield pa.RecordBatch.from_pylist(lines, pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in _INDEX_FIELDS]))
                lines.clear()
                file = None

        for piece in slices(batches, "html"):
            for page, address, text, leader in zip(*(column(piece, c).to_pylist() for c in ("page_id", "url", "html", "leader"))):
                if file is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    file = system.open_output_stream(f"{base}/{name}", compression=None)
                payload, revisit = text.encode(), leader is not None and page != leader
                member = record(page, address, payload, leader, revisit)
                file.write(member)
                lines.append({
                    "run": name, "urlkey": url_key(address), "captured": captured_at(page), "page_id": page, "url": address, "archive": name, "offset": offset, "length": len(member),
                    "record_type": "revisit" if revisit else "response", "digest": digest_of(payload)})
                offset += len(member)
                if len(lines) >= RUN_RECORDS or offset >= RUN_BYTES:
                    yield from closed()
        yield from closed()

    return written(led.mapInArrow(run, INDEX))


def merged(index: DataFrame) -> DataFrame:
    """The lines of all runs in one global order: URL key, then time, in ranges of about MERGE_LINES lines.

    Ranges are drawn over the whole key with the page's id, so a URL that is captured very often is spread over ranges too. In a
    range, each run's lines come in order, and a loser tree merges the runs.
    """
    n = max(1, -(-index.count() // MERGE_LINES))
    key = ["urlkey", "captured", F.col("page_id").asc_nulls_first(), "archive", "offset"]
    ranges = index.repartitionByRange(n, *key).sortWithinPartitions("run", *key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[dict]] = []
        for batch in batches:
            for line in batch.to_pylist():
                if not runs or runs[-1][0]["run"] != line["run"]:
                    runs.append([])
                runs[-1].append(line)
            schema = batch.schema
        lines = list(LoserTree(runs, line_key))
        for i in range(0, len(lines), 4096):
            yield pa.RecordBatch.from_pylist(lines[i : i + 4096], schema)

    return ranges.mapInArrow(run, INDEX)


def read_archives(history: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records the index names, in its order, read from the archives and checked against their lengths and digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])
        files: dict[str, object] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                for line in batch.slice(start, 256).to_pylist():
                    if line["archive"] not in files:
                        if len(files) >= 64:
                            files.pop(next(iter(files))).close()
                        files[line["archive"]] = system.open_input_file(f"{base}/{line['archive']}")
                    file = files[line["archive"]]
                    file.seek(line["offset"])
                    found = parse(file.read(line["length"]))
                    if found["page_id"] != line["page_id"] or found["payload_digest"] != line["digest"]:
                        raise ValueError("the index names another record")
                    rows.append(found | {"urlkey": line["urlkey"], "archive": line["archive"], "offset": line["offset"], "payload": found["payload"] if with_payload else None})
                yield pa.RecordBatch.from_pylist(rows, schema)
        for file in files.values():
            file.close()

    return history.mapInArrow(run, RECORD)


def archive(pages: DataFrame, folder: str | None = None, with_payload: bool = True, **options) -> DataFrame:
    """Pages written as archives, indexed, and read back: see write_archives, merged and read_archives for each step."""
    place = folder or shared_folder(pages.sparkSession)
    place = place if "://" in place or place.startswith("/") else place.replace(":", "://", 1)
    return read_archives(merged(write_archives(pages, place, **options)), place, with_payload)
