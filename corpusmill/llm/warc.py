"""WARC archives: reading, writing, and resolving revisits.

Archives have one gzip member or Zstandard frame per record, so that a record can be
read by its file and offset. Zstandard archives begin with a dictionary in a skippable
frame, trained on a bounded sample of records, which spares the text that all headers
and pages share. Files are reached by ``pyarrow.fs``, which takes local paths and
the URIs of shared file systems. A task writes under a name of its own and renames,
so a task that is run again leaves one whole file.

Plan of ``deduplicate``
1. One task per file parses headers, once; payload digests that are missing are
   computed. Only headers, with file and offset, leave the task.
2. Headers are grouped by payload digest (partial minimum, so that a hot digest is
   one row per task): the original is the first response by (date, record id).
   Revisits and repeated responses join their original.
3. Decisions (what changes, by offset) go back to their file, where one task reads it
   again and writes a new archive. No payload is ever shuffled. Records that stay are
   copied byte for byte (a response without a payload digest gets one); a new revisit
   keeps its HTTP headers and all WARC headers but those of type, lengths, digests
   and of what it refers to.

Defined results
    Response that is the first of its digest: kept with its payload. Other responses
    of the digest: rewritten as revisits. Revisits: refer to the original response;
    without one (or without a digest) kept as they came, ``resolved`` false. Other
    record types: copied. Records repeated under one id: the first by (file, offset);
    records without an id are never repeats.
    Digests of any spelling (hex or base32, any case) are one digest. What a response
    claims is verified, in its chunked form too; where it is wrong or missing, the SHA-1
    of the payload takes its place, so that a wrong claim costs no payload.
    Files: gzip or Zstandard, one member a record or many, or plain. Where a file is cut
    off or damaged, the records before stay, what follows is copied as it is, and a row of
    type ``damaged`` tells its place and length.
    Ties of date: by record id. Empty payload: a payload like any other. No file or an
    empty file: no rows. ``captures`` leaves out rows whose URL or HTML is null. A
    record is held in memory by the task that reads it; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import cut, drop_cut

RECORD = "record_id string, warc_type string, target_uri string, date string, digest string, refers_to string, refers_to_uri string, refers_to_date string, payload binary"
HEADER = "file string, offset bigint, length bigint, record_id string, warc_type string, target_uri string, date string, digest string, refers_to string, refers_to_uri string, refers_to_date string, payload_bytes bigint"
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, LEVEL = 64 << 10, 400, 64 << 10, 3
#: Digests that can be verified, and their bytes.
SIZES = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
DAMAGED = "damaged"
SKIPPABLE = b"\x5d\x2a\x4d\x18"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = (
    ("WARC-Record-ID", "record_id"), ("WARC-Type", "warc_type"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "digest"),
    ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_uri"), ("WARC-Refers-To-Date", "refers_to_date"),
)


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return "sha1:" + hashlib.sha1(payload).hexdigest()


def spelled(digest: str | None) -> str | None:
    """One spelling, in hex, for the digests that say the same; what is not understood stays."""
    name, _, value = (digest or "").strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in SIZES:
        return (digest or "").strip() or None
    value = value.strip()
    if len(value) != 2 * SIZES[name]:
        try:
            value = base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
        except ValueError:
            return digest
    return f"{name}:{value.lower()}"


def dechunked(payload: bytes) -> bytes | None:
    """What a chunked HTTP body holds; None if it is none."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        try:
            size = int(payload[at:end].partition(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(payload):
            return None
        if size == 0:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + size])
        at = end + 4 + size


def verified(claim: str | None, block: bytes, payload: bytes) -> str:
    """A response's digest: the one it claims, in one spelling, or the SHA-1 of the payload where that is wrong."""
    claim = spelled(claim)
    name = (claim or "").partition(":")[0]
    if name in SIZES:
        forms = [payload]
        if b"chunked" in block[: len(block) - len(payload)].lower() and (plain := dechunked(payload)) is not None:
            forms.append(plain)
        if any(f"{name}:{hashlib.new(name, x).hexdigest()}" == claim for x in forms):
            return claim
    return digest_of(payload)


def encode(record: dict, payload: bytes) -> bytes:
    """One record with fresh headers: lengths and digests are of what is written."""
    kind = record["warc_type"]
    block, content = payload, "application/octet-stream"
    if kind in ("response", "revisit"):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        block = http + (b"Content-Length: %d\r\n\r\n" % len(payload) + payload if kind == "response" else b"\r\n")
        content = "application/http; msgtype=response"
    lines = ["WARC/1.1", *(f"{name}: {' '.join(str(record[key]).split())}" for name, key in FIELDS if record.get(key) is not None)]
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += [f"WARC-Block-Digest: {digest_of(block)}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(raw: bytes) -> tuple[dict, bytes]:
    """Headers (lower case) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            headers[last] += " " + line.strip()
        else:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            headers[last] = value.strip()
    return headers, rest[: int(headers.get("content-length") or 0)]


def payload_of(headers: dict, block: bytes) -> bytes:
    """What follows the HTTP headers of a response; the block of other types."""
    if headers.get("warc-type") == "response" and block.startswith(b"HTTP/"):
        return block.partition(b"\r\n\r\n")[2]
    return block if headers.get("warc-type") != "revisit" else b""


def edited(raw: bytes, changes: dict[str, str | None], block: bytes) -> bytes:
    """A record with another block and some headers replaced, added or (None) left out; the others stay as they are."""
    changes = changes | {"WARC-Block-Digest": digest_of(block), "Content-Length": str(len(block))}
    first, *lines = raw.partition(b"\r\n\r\n")[0].split(b"\r\n")
    gone, out, dropped = {name.lower().encode() for name in changes}, [first], False
    for line in lines:
        if line[:1] not in (b" ", b"\t"):  # else a folded line, which goes with the one before
            dropped = line.partition(b":")[0].strip().lower() in gone
        if not dropped:
            out.append(line)
    out += [f"{name}: {' '.join(value.split())}".encode() for name, value in changes.items() if value is not None]
    return b"\r\n".join(out) + b"\r\n\r\n" + block + b"\r\n\r\n"


def rewritten_record(raw: bytes, action: str, refers: list[str | None]) -> tuple[dict, int, bytes]:
    """Fields, payload bytes and content of a record as it is written: kept, or made to refer to an original."""
    row, payload = parsed(raw)
    h, block = decode(raw)
    if action != "revisit":
        fresh = row["digest"] is not None and "warc-payload-digest" not in h
        return row, len(payload), edited(raw, {"WARC-Payload-Digest": row["digest"]}, block) if fresh else raw
    row |= {"warc_type": "revisit"} | dict(zip(("refers_to", "refers_to_uri", "refers_to_date"), refers))
    named = {name: row[key] for name, key in FIELDS if key in ("warc_type", "digest", "refers_to", "refers_to_uri", "refers_to_date")}
    if h.get("warc-type") == "response":
        block = block[: len(block) - len(payload)]  # its HTTP headers
    profile = h.get("warc-profile") if h.get("warc-type") == "revisit" else None
    return row, 0, edited(raw, named | {"WARC-Profile": profile or PROFILE}, block)


def train(records: DataFrame, sample: int = SAMPLE_RECORDS) -> bytes | None:
    """A dictionary of the first ``SAMPLE_BYTES`` of at most ``sample`` records, those of the smallest hashes; None if they are too few for one."""
    import zstandard

    h = F.xxhash64("record_id", "target_uri", "date")
    keys = [r[0] for r in records.select(h.alias("h")).distinct().orderBy("h").limit(sample).collect()]
    head = records.withColumn("payload", F.substring("payload", 1, SAMPLE_BYTES)).withColumn("h", h).where(F.col("h").isin(keys)).dropDuplicates(["h"]).orderBy("h")
    rows = [r.asDict() for r in head.drop("h").collect()]
    texts = [encode(r, bytes(r.pop("payload") or b"")) for r in rows]
    if len(texts) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # texts that share nothing
        return None


class Codec:
    """How the records of one archive are packed: plain, gzip, or Zstandard with a dictionary or none."""

    def __init__(self, kind: str = "zstd", dictionary: bytes | None = None):
        self.kind, self.dictionary = kind, dictionary
        if kind == "zstd":
            import zstandard

            shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
            self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
            self.unpacker = zstandard.ZstdDecompressor(dict_data=shared)

    @classmethod
    def of(cls, file) -> tuple[Codec, int]:
        """The codec of an open archive, and where its records begin."""
        head = file.read(8)
        if head[:2] == b"\x1f\x8b":
            return cls("gzip"), 0
        if head[:5] == b"WARC/":
            return cls("plain"), 0
        if head[:4] == SKIPPABLE:
            n = int.from_bytes(head[4:8], "little")
            return cls("zstd", file.read(n)), 8 + n
        return cls("zstd"), 0

    @property
    def head(self) -> bytes:
        return SKIPPABLE + len(self.dictionary).to_bytes(4, "little") + self.dictionary if self.dictionary else b""

    @property
    def suffix(self) -> str:
        return {"gzip": ".warc.gz", "plain": ".warc"}.get(self.kind, ".warc.zst")

    def pack(self, raw: bytes) -> bytes:
        if self.kind == "plain":
            return raw
        return gzip.compress(raw, 1, mtime=0) if self.kind == "gzip" else self.packer.compress(raw)

    def reader(self):
        return zlib.decompressobj(31) if self.kind == "gzip" else self.unpacker.decompressobj()

    def unpack(self, packed: bytes) -> bytes:
        return self.reader().decompress(packed)


def members(file, codec: Codec, at: int, size: int = 1 << 20, step: int = 1 << 13) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, length, content) of every packed member from offset ``at`` of a file, reading in steps.

    A member that is cut off or damaged has no content, and ends the file.
    """
    errors = (zlib.error, EOFError)
    if codec.kind == "zstd":
        import zstandard

        errors += (zstandard.ZstdError,)
    data, pos = b"", 0
    while True:
        unzip, out, used = codec.reader(), [], 0
        while not unzip.eof:
            if pos == len(data):
                data, pos = file.read(size), 0
                if not data:
                    if used:
                        yield at, used, None
                    return
            part = data[pos : pos + step]
            try:
                out.append(unzip.decompress(part))
            except errors:
                rest = len(data) - pos
                while data := file.read(size):
                    rest += len(data)
                yield at, used + rest, None
                return
            n = len(part) - len(unzip.unused_data)
            used, pos = used + n, pos + n
        yield at, used, b"".join(out)
        at += used


def length_of(head: bytes) -> int | None:
    """The bytes of a record that begins so, with the two line ends after it; None if its headers are not whole."""
    end = head.find(b"\r\n\r\n")
    if end < 0 or not head.startswith(b"WARC/"):
        return None
    said = re.search(rb"(?i)\ncontent-length:[ \t]*(\d+)", head[:end])
    return end + 8 + int(said.group(1)) if said else None


def plain(file, size: int = 1 << 20, most: int = 1 << 24) -> Iterator[tuple[int, int, bytes | None]]:
    """The records of a file that is not packed; as ``members`` gives them."""
    data, at = b"", 0
    while True:
        while (n := length_of(data)) is None and len(data) < most and (more := file.read(size)):
            data += more
        while n is not None and len(data) < n and (more := file.read(max(size, n - len(data)))):
            data += more
        if n is not None and len(data) >= n - 4:  # the last line ends may be missing
            n = min(n, len(data))
            yield at, n, data[:n]
            data, at = data[n:], at + n
            if data or (data := file.read(size)):
                continue
            return
        if rest := len(data):
            while data := file.read(size):
                rest += len(data)
            yield at, rest, None
        return


def opened(system, path: str):
    """The codec of an archive, then its records: (offset, length, content), content None for what is damaged.

    Records that share a member are told apart by offsets within it.
    """
    with system.open_input_stream(path, compression=None) as file:
        codec, at = Codec.of(file)
    with system.open_input_stream(path, compression=None) as file:
        yield codec
        if codec.kind == "plain":
            yield from plain(file)
            return
        file.read(at)
        for at, used, content in members(file, codec, at):
            n = length_of(content) if content is not None else None
            if n is None or n >= len(content):
                yield at, used, content
                continue
            first = 0
            for i in range(used):
                n = length_of(content[first : first + (1 << 20)])
                last = n is None or first + n >= len(content)
                yield at + i, used, content[first:] if last else content[first : first + n]
                if last:
                    break
                first += n


class Writer:
    """One archive of one task: written under a name of its own, renamed when whole."""

    def __init__(self, folder: str, name: str, codec: Codec):
        self.codec, name = codec, name + codec.suffix
        self.fs, root = file_system(folder)
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        self.path, self.partial = posixpath.join(root, name), posixpath.join(root, f"_{name}.{attempt}")
        self.out, self.at = None, 0

    def add(self, record: dict, payload: bytes) -> tuple[int, int]:
        return self.put(encode(record, payload))

    def put(self, content: bytes) -> tuple[int, int]:
        return self.copy(self.codec.pack(content))

    def copy(self, *raws: bytes) -> tuple[int, int]:
        if self.out is None:
            self.out = self.fs.open_output_stream(self.partial, compression=None)
            self.out.write(self.codec.head)
            self.at = len(self.codec.head)
        began = self.at
        for raw in raws:
            self.out.write(raw)
            self.at += len(raw)
        return began, self.at - began

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.partial, self.path)


def write(records: DataFrame, folder: str, kind: str = "zstd", dictionary: bytes | None = None) -> DataFrame:
    """Write ``records`` (schema RECORD) as one archive per partition; returns (file, offset, length, record_id)."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder, f"part-{TaskContext.get().partitionId():06d}", Codec(kind, dictionary))
        for batch in batches:
            places, ids = [], []
            for row in batch.to_pylist():
                payload = row.pop("payload") or b""
                places.append(writer.add(row, payload))
                ids.append(row["record_id"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([writer.path] * len(ids), pa.string()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64()), pa.array(ids, pa.string())],
                names=["file", "offset", "length", "record_id"],
            )
        writer.close()

    return cut(records.select(*names).mapInArrow(run, "file string, offset bigint, length bigint, record_id string"))


def files_of(folder: str) -> list[str]:
    from pyarrow import fs

    system, root = file_system(folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith("_") and f.base_name.endswith((".warc", ".warc.gz", ".warc.zst")))


def parsed(raw: bytes | None) -> tuple[dict, bytes]:
    """The fields and the payload of a record; digests in one spelling, a response's verified."""
    if raw is None:
        return {key: None for _, key in FIELDS} | {"warc_type": DAMAGED}, b""
    h, block = decode(raw)
    payload = payload_of(h, block)
    claim = h.get("warc-payload-digest")
    digest = verified(claim, block, payload) if h.get("warc-type") == "response" else spelled(claim)
    return {key: h.get(name.lower()) for name, key in FIELDS} | {"digest": digest}, payload


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of every archive in the folder (schema HEADER), one task per file."""
    paths = files_of(folder)
    if not paths:
        return spark.createDataFrame([], HEADER)
    table = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    names = [x.split(" ")[0] for x in HEADER.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(1).to_pylist():
                rows: list[dict] = []
                found = opened(system, path)
                next(found)
                for offset, length, raw in found:
                    row, payload = parsed(raw)
                    rows.append(row | {"file": path, "offset": offset, "length": length, "payload_bytes": len(payload)})
                    if len(rows) == 10000:
                        yield _table(rows, names)
                        rows = []
                yield _table(rows, names)

    return table.repartitionById(len(paths), F.col("i")).mapInArrow(run, HEADER)


def _table(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "resolved": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def resolve(found: DataFrame) -> DataFrame:
    """Headers -> decisions (file, offset, action, refers_to, refers_to_uri, refers_to_date) of the records that change.

    ``revisit``: it refers to an original. ``drop``: its id came before. Records without
    a row stay as they are.
    """
    # written, so that the planner sees its size: as a rule nothing repeats, and the join is a map
    place = F.struct("file", "offset")
    known = found.where("record_id is not null").select("record_id", "file", "offset", F.xxhash64("record_id").alias("hash"))
    # hashes are shuffled first, being short; the ids decide
    suspects = cut(known.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").drop("times"))
    repeats = cut(known.join(suspects, "hash").groupBy(F.col("record_id").alias("rid")).agg(F.min(place).alias("m"), F.count("*").alias("times")).where("times > 1").drop("times"))
    marked = found.select("file", "offset", "record_id", "warc_type", "target_uri", "date", "digest").join(repeats, F.col("record_id") == F.col("rid"), "left")
    marked = marked.withColumn("again", F.coalesce(place != F.col("m"), F.lit(False))).drop("rid", "m")
    captured = marked.where("not again and digest is not null and warc_type in ('response', 'revisit')")
    first = captured.where("warc_type = 'response'").groupBy("digest").agg(F.min(F.struct("date", "record_id", "target_uri", "file", "offset")).alias("o"))
    refers = captured.select("digest", "file", "offset").join(first, "digest").where(place != F.struct("o.file", "o.offset"))
    return refers.select("file", "offset", F.lit("revisit").alias("action"), F.col("o.record_id").alias("refers_to"), F.col("o.target_uri").alias("refers_to_uri"), F.col("o.date").alias("refers_to_date")).union(
        marked.where("again").select("file", "offset", F.lit("drop"), *(F.lit(None).cast("string") for _ in range(3)))
    )


def deduplicate(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Write the archives of ``folder`` without repeated payloads to ``out``.

    One row per record: file, offset and length in the new archive, record_id,
    old_type, warc_type, target_uri, date, digest, refers_to, refers_to_uri,
    refers_to_date, payload_bytes (as written), resolved.
    """
    fs, root = file_system(out)
    fs.create_dir(root, recursive=True)
    found = cut(headers(spark, folder))
    decided = resolve(found)
    schema = (
        "file string, offset bigint, length bigint, record_id string, old_type string, warc_type string, target_uri string, date string, digest string, "
        "refers_to string, refers_to_uri string, refers_to_date string, payload_bytes bigint, resolved boolean"
    )
    names = [x.split(" ")[0] for x in schema.split(", ")]
    # every file has a row, so that one without decisions is written too
    every = spark.createDataFrame([(p,) for p in files_of(folder)], "file string").select("file", F.lit(-1).cast("bigint").alias("offset"), *(F.lit(None).cast("string") for _ in range(4)))

    def rewritten(path: str, decisions: dict[int, list]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        source = opened(system, path)
        stem = posixpath.basename(path).rsplit(".warc", 1)[0]
        writer = Writer(out, f"dedup-{hashlib.sha1(path.encode()).hexdigest()[:8]}-{stem}", next(source))
        rows: list[dict] = []
        for at, _, raw in source:
            action, *refers = decisions.get(at, ("keep",))
            if action == "drop":
                continue
            if raw is None:
                with system.open_input_file(path) as file:
                    file.seek(at)
                    offset, length = writer.copy(*iter(lambda: file.read(1 << 20), b""))
                rows.append(parsed(None)[0] | {"old_type": DAMAGED, "file": writer.path, "offset": offset, "length": length, "payload_bytes": length, "resolved": False})
                continue
            old = decode(raw)[0].get("warc-type")
            row, size, content = rewritten_record(raw, action, refers)
            offset, length = writer.put(content)
            rows.append(row | {"old_type": old, "file": writer.path, "offset": offset, "length": length, "payload_bytes": size, "resolved": old != "revisit" or action == "revisit"})
            if len(rows) == 10000:
                yield _table(rows, names)
                rows = []
        writer.close()
        yield _table(rows, names)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, decisions = None, {}
        for batch in batches:
            for file, offset, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if file != path and path is not None:
                    yield from rewritten(path, decisions)
                    decisions = {}
                path = file
                decisions[offset] = rest
        if path is not None:
            yield from rewritten(path, decisions)

    parts = max(1, min(len(files_of(folder)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # names depend on the file only, so a task that is run again writes the same archives
    result = cut(decided.union(every).repartition(parts, "file").sortWithinPartitions("file", "offset").mapInArrow(rewrite, schema))
    drop_cut(found)
    return result


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Three visits of every page as records: a response, a revisit, and a response again."""
    rows = pages.where(F.col(url_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.encode(html_col, "utf-8").alias("p"))
    rows = rows.withColumn("digest", F.concat(F.lit("sha1:"), F.sha1("p"))).withColumn("visit", F.explode(F.array(*map(F.lit, range(3)))))
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("i").cast("string"), F.lit("")), "u", "digest", "visit"))
    uuid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))
    is_response = F.col("visit") != 1
    return rows.select(
        uuid.alias("record_id"), F.when(is_response, F.lit("response")).otherwise(F.lit("revisit")).alias("warc_type"), F.col("u").alias("target_uri"),
        F.format_string("2024-01-%02dT00:00:00Z", F.col("visit") + 1).alias("date"), "digest",
        *(F.lit(None).cast("string").alias(c) for c in ("refers_to", "refers_to_uri", "refers_to_date")), F.when(is_response, F.col("p")).alias("payload"),
    )
