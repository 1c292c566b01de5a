"""Operator 11, exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every run of rows of one input file sends the sorted 48-bit fingerprints of
   its normalised texts to their owners (owners hold fingerprint ranges),
   Golomb-coded with a power of two as divisor: about 48 - log2(hashes sent) + 2
   bits each.  A text that a run holds many times is sent once.
2. An owner decodes its messages and answers each with a bitmap of those
   fingerprints that another message holds too.
3. Each run keeps which of its rows stand behind a fingerprint, so that answers
   turn into bitmaps over the rows of files.  The second pass over the texts
   reads them by broadcast, one bounded block of files at a time (128 MB of
   bitmaps at most; each file is read in one block only).
4. Only marked rows take their texts along.  Spark groups them by the bytes of
   the normalised text, repeats within a task first.  A digest labels a group
   once it is known to stand for one text; were it to stand for two, the texts
   themselves are the labels.

Fingerprints are spread evenly and sent once per run, so no owner is hot; a
text of very many rows is one row per task in the grouping, and its rows meet
their group in a skew-split join.

Defined results: null text counts as empty, and all empty texts are one group
(a text of blanks only is one blank, another group); null ids come after all
others, so they stay only where no row of the group has an id; of repeated rows
with the least id one stays; extra columns are ignored; an empty table gives no
rows; texts of any length are compared whole.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HASH_BITS = 48
CHUNK = 1 << 16
LEDGER = "id bigint, owner int, n int, shift int, codes binary, file string, rows binary, starts binary"
ANSWERS = "id bigint, marks binary"
PLACES = "file string, chunk bigint, places binary"
BITMAPS = "file string, chunk bigint, bits array<bigint>"


@dataclass
class Settings:
    """``run_rows``: rows behind one message at most; ``owner_hashes``: what an
    owner decodes at a time; ``block_rows``: rows (bits) of a broadcast."""
    run_rows: int = 1 << 20
    least_owner_bits: int = 6
    owner_hashes: int = 1 << 24
    block_rows: int = 1 << 30


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


# ------------------------------------------------------------ Golomb codes

def encode(sorted_values: np.ndarray) -> tuple[int, bytes]:
    """Gaps of ascending integers: all quotients by 2^shift in unary, then all
    remainders in ``shift`` bits each."""
    gaps = np.diff(sorted_values, prepend=0)
    mean = int(sorted_values[-1]) // len(sorted_values) if len(sorted_values) else 0
    shift = max(0, (mean * 11 // 16).bit_length() - 1)
    quotients = gaps >> shift
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(shift)) & 1).astype(np.uint8)
    return shift, np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def decode(n: int, shift: int, codes: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(codes, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    at = int(ends[-1]) + 1 if n else 0
    rest = bits[at:at + n * shift].reshape(n, shift).astype(np.int64) << np.arange(shift)
    return np.cumsum((quotients << shift) + rest.sum(axis=1, dtype=np.int64))


# ------------------------------------------------------------ the exchange

def _runs(values: np.ndarray):
    """Bounds of the runs of equal values."""
    cut = np.flatnonzero(np.diff(values, prepend=-1))
    return zip(cut, np.append(cut[1:], len(values)), strict=True) if len(cut) else ()

def _send(cfg: Settings, owner_bits: int):
    schema = common.arrow_schema(LEDGER)
    down = HASH_BITS - owner_bits

    def messages(file, rows, hashes, serial):
        order = np.argsort(hashes, kind="stable")
        hashes, rows = hashes[order], rows[order]
        owner = (hashes >> down).astype(np.int64)
        out = {f.name: [] for f in schema}
        for a, b in _runs(owner):
            starts = np.diff(hashes[a:b], prepend=-1) != 0
            distinct = hashes[a:b][starts] - (int(owner[a]) << down)
            shift, codes = encode(distinct)
            for name, value in zip(out, (serial, int(owner[a]), len(distinct), shift, codes, file,
                                         rows[a:b].tobytes(), np.packbits(starts).tobytes()), strict=True):
                out[name].append(value)
            serial += 1
        return serial, common.arrow_batch(schema, **out)

    def run(batches):
        serial, file, rows, hashes, held = TaskContext.get().partitionId() << 32, None, [], [], 0
        for b in batches:
            names = b.column("file").dictionary_encode()
            of, at = names.indices.to_numpy(), b.column("row").to_numpy()
            h = b.column("hash").to_numpy()
            for lo, hi in _runs(of):
                name = names.dictionary[int(of[lo])].as_py()
                if held and (name != file or held + hi - lo > cfg.run_rows):
                    serial, out = messages(file, np.concatenate(rows), np.concatenate(hashes), serial)
                    yield out
                    rows, hashes, held = [], [], 0
                file, held = name, held + hi - lo
                rows.append(at[lo:hi])
                hashes.append(h[lo:hi])
        if held:
            yield messages(file, np.concatenate(rows), np.concatenate(hashes), serial)[1]

    return run


def _answer(table):
    """One owner: the bitmaps of all messages that share a fingerprint."""
    parts = [decode(n, k, c) for n, k, c in zip(table["n"].to_pylist(), table["shift"].to_pylist(),
                                                table["codes"].to_pylist(), strict=True)]
    sizes = np.array([len(p) for p in parts])
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(every), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    ends = np.cumsum(sizes)
    ids, marks = [], []
    for i, a, b in zip(table["id"].to_pylist(), ends - sizes, ends, strict=True):
        if shared[a:b].any():
            ids.append(i)
            marks.append(np.packbits(shared[a:b]).tobytes())
    return pa.table({"id": pa.array(ids, pa.int64()), "marks": pa.array(marks, pa.binary())})


def _places(schema: pa.Schema, batches):
    """Rows of files whose fingerprint occurs again, in their run or elsewhere."""
    for b in batches:
        out = {f.name: [] for f in schema}
        for file, rows, starts, n, marks in zip(*(b.column(c).to_pylist() for c in ("file", "rows", "starts", "n", "marks")),
                                                strict=True):
            rows = np.frombuffer(rows, np.int64)
            which = np.cumsum(np.unpackbits(np.frombuffer(starts, np.uint8), count=len(rows))) - 1
            hit = np.bincount(which, minlength=n) > 1
            if marks is not None:
                hit |= np.unpackbits(np.frombuffer(marks, np.uint8), count=n).astype(bool)
            rows = np.sort(rows[hit[which]])
            for lo, hi in _runs(rows // CHUNK):
                out["file"].append(file)
                out["chunk"].append(int(rows[lo]) // CHUNK)
                out["places"].append((rows[lo:hi] % CHUNK).astype(np.uint16).tobytes())
        yield common.arrow_batch(schema, **out)


def _bitmap(key, table):
    bits = np.zeros(CHUNK, np.uint8)
    for p in table["places"].to_pylist():
        bits[np.frombuffer(p, np.uint16)] = 1
    words = np.packbits(bits, bitorder="little").view("<i8")
    return pa.table({"file": pa.array([key[0].as_py()], pa.string()), "chunk": pa.array([key[1].as_py()], pa.int64()),
                     "bits": pa.array([words], pa.list_(pa.int64()))})


def _addressed(docs: DataFrame) -> DataFrame:
    """Rows with file and position; what isn't read from files is written first."""
    def rows(df):
        return df.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"),
                         F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return rows(docs)
    except AnalysisException:
        return rows(common.saved(docs.select("doc_id", "text"), "dedup-input"))


def suspects(rows: DataFrame, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """Bitmaps of the rows whose fingerprint occurs again, and the ledger."""
    total = rows.select("file").count()
    owner_bits = max(cfg.least_owner_bits, (-(-total // cfg.owner_hashes) - 1).bit_length())
    low = F.xxhash64("norm").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    ledger = common.saved(rows.select("file", "row", low.alias("hash")).mapInArrow(_send(cfg, owner_bits), LEDGER),
                          "dedup-ledger")
    answers = ledger.select("owner", "id", "n", "shift", "codes").groupBy("owner").applyInArrow(_answer, ANSWERS)
    places = ledger.select("id", "file", "rows", "starts", "n").join(answers, "id", "left").mapInArrow(
        functools.partial(_places, common.arrow_schema(PLACES)), PLACES)
    return places.groupBy("file", "chunk").applyInArrow(_bitmap, BITMAPS), ledger


def _blocks(ledger: DataFrame, total_rows: int) -> list[list[str] | None]:
    """Files in blocks of ``total_rows`` rows; [None]: all in one."""
    sizes = ledger.groupBy("file").agg((F.sum(F.octet_length("rows")) / 8).cast("long").alias("n"))
    if (sizes.agg(F.sum("n")).first()[0] or 0) <= total_rows:
        return [None]
    out, held = [[]], 0
    for file, n in sizes.orderBy("file").collect():      # one row per input file, which the driver lists anyway
        if out[-1] and held + n > total_rows:
            out.append([])
            held = 0
        out[-1].append(file)
        held += n
    return out


def exact_groups(docs: DataFrame, cfg: Settings | None = None, digest=sha256) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for each row."""
    cfg = cfg or Settings()
    spark = docs.sparkSession
    rows = _addressed(docs)
    bitmaps, ledger = suspects(rows, cfg)
    bitmaps = common.saved(bitmaps, "dedup-bitmaps")
    path = common.scratch_path(spark, "dedup-rows")
    for block, files in enumerate(_blocks(ledger, cfg.block_rows)):
        part, bits = rows, bitmaps
        if files is not None:
            part, bits = part.filter(F.col("file").isin(files)), bits.filter(F.col("file").isin(files))
        part = part.withColumn("chunk", F.floor(F.col("row") / CHUNK)).join(F.broadcast(bits), ["file", "chunk"], "left")
        place = F.col("row") % CHUNK
        word = F.element_at("bits", F.floor(place / 64).cast("int") + 1)
        again = F.coalesce(F.getbit(word, (place % 64).cast("int")) == 1, F.lit(False))
        part = part.select("doc_id", sha256(F.col("norm")).alias("sha"), digest(F.col("norm")).alias("label"),
                           again.alias("again"), "norm")
        (part.withColumn("norm", F.when(F.col("again"), F.col("norm")))
             .withColumn("place", F.struct(F.lit(block).alias("block"), F.monotonically_increasing_id().alias("at")))
             .write.mode("append").parquet(path))
    marked = spark.read.parquet(path)
    single = marked.filter(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                   F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return single.unionByName(_grouped(marked.filter("again")))


def _grouped(rows: DataFrame) -> DataFrame:
    """Byte verification of the marked rows, then their groups."""
    texts = rows.select("label", "norm").distinct()
    clash = common.saved(texts.groupBy("label").count().filter("count > 1").select("label"), "dedup-clash")
    if not clash.isEmpty():                              # a digest of two texts: their bytes are the label
        own = rows.join(clash, "label", "left_semi").withColumn("label", F.concat(F.lit("="), "norm"))
        rows = rows.join(clash, "label", "left_anti").unionByName(own)
    rows = rows.select("doc_id", "place", "sha", "label")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("place").alias("place")))
    # stored, so that the join has a shuffle of its own that can split a hot group
    groups = common.saved(rows.groupBy("label").agg(first.alias("first"), F.count("*").alias("group_size")), "dedup-groups")
    return rows.join(groups, "label").select(
        "doc_id", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("place") == F.col("first.place")).alias("kept"), F.col("sha").alias("text_sha256"))
