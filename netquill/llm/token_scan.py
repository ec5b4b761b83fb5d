"""Token counts by a separator scan of flat token files.

A token file is a run of little-endian token ids with an end-of-document id
after each document, and no index. It is kept as blocks of BLOCK tokens that
cut documents anywhere. Each block is searched for separators at once in numpy;
a prefix scan over the blocks' summaries (within chunks of blocks, then over
chunks) gives where each block begins and where the last separator before it
was, which settles documents that cross blocks.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquill.llm.common import stash

BLOCK = 1 << 16
#: Blocks scanned by one window task; their totals are scanned in turn.
CHUNK_BLOCKS = 1024
# Fixed value: how the 50k byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOD = 50256


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary, a file of fixed size."""
    rows = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(a): int(b) for a, b in rows}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("netquill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int], eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """(stream string, block long, tokens binary, ids array): the documents' tokens in flat blocks.

    A task writes one stream. ids names the documents whose separator is in the
    block, in order; it says nothing of where they are. Ids of vocabularies up to
    65,536 take two bytes, others four.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wide = np.dtype("<u2") if max(eod, max(ranks.values(), default=0)) < 1 << 16 else np.dtype("<u4")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        enc, stream, at = encoder(shared.value), f"task-{TaskContext.get().partitionId()}", 0
        held, size, ids = [], 0, []
        id_type = None

        def flush(n):
            nonlocal held, size, ids, at
            flat = np.concatenate(held) if held else np.zeros(0, wide)
            while len(flat) >= n and len(flat):
                part, flat = flat[: min(block, len(flat))], flat[min(block, len(flat)) :]
                k = int((part == eod).sum())
                yield pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([at], pa.int64()), pa.array([part.tobytes()], pa.binary()), pa.array([ids[:k]], pa.list_(id_type))], names=["stream", "block", "tokens", "ids"])
                ids = ids[k:]
                at += 1
            held, size = [flat], len(flat)

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                got = enc.encode_ordinary(t.as_py()) if t.is_valid else []
                held.append(np.array([*got, eod], wide))
                ids.append(i)
                size += len(got) + 1
                if size >= 4 * block:
                    yield from flush(block)
        if id_type is not None:
            yield from flush(1)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"stream string, block bigint, tokens binary, ids array<{kind}>")


def read_token_files(spark: SparkSession, paths: str, block_bytes: int = 2 * BLOCK) -> DataFrame:
    """The same blocks from raw flat files, each read whole by one task (so shards of up to 2 GB); no ids."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, at in enumerate(range(0, len(content), block_bytes)):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([content[at : at + block_bytes]], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["stream", "block", "tokens", "ids"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "stream string, block bigint, tokens binary, ids array<bigint>")


def token_counts(blocks: DataFrame, eod: int = EOD, width: int = 2) -> DataFrame:
    """(stream, ordinal, id, n_tokens): tokens of each document, without its separator.

    ordinal counts the documents of a stream from 0; id is null where blocks have
    no ids. Tokens after a stream's last separator count as a last document.
    Streams without any separator, empty blocks and empty tables are fine.
    """
    ids = blocks.schema["ids"].dataType

    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column(2):
                tokens = np.frombuffer(raw.as_py() or b"", f"<u{width}")
                at = np.flatnonzero(tokens == eod)
                rows.append((len(tokens), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, (np.diff(at) - 1).tolist()))
            n, seps, first, last, inner = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(seps, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64())), b.column(3)], names=["stream", "block", "n", "seps", "first", "last", "inner", "ids"])

    found = stash(blocks.select("stream", "block", "tokens", "ids").mapInArrow(run, f"stream string, block bigint, n bigint, seps bigint, first bigint, last bigint, inner array<bigint>, ids {ids.simpleString()}"), "found")
    small = found.select("stream", "block", "n", "seps", "first", "last")
    small = _scan(small, "n", "begin", F.sum)
    small = _scan(small, "seps", "ordinal", F.sum)
    small = _scan(small.withColumn("last_at", F.col("begin") + F.col("last")), "last_at", "before", F.max)
    small = small.select("stream", "block", "ordinal", (F.col("begin") + F.col("first") - F.coalesce("before", F.lit(-1)) - 1).alias("head"), (F.col("begin") + F.col("n")).alias("stop"), F.coalesce("last_at", "before", F.lit(-1)).alias("seen"), (F.col("ordinal") + F.col("seps")).alias("total"))
    small = stash(small, "scanned")
    done = found.where("seps > 0").select("stream", "block", "inner", "ids").join(small, ["stream", "block"])
    counts = F.concat(F.array("head"), F.col("inner"))
    each = done.select("stream", "ordinal", F.posexplode(F.arrays_zip(counts.alias("n"), F.coalesce("ids", F.array().cast(ids)).alias("id"))).alias("k", "x"))
    rows = each.select("stream", (F.col("ordinal") + F.col("k")).cast("long").alias("ordinal"), F.col("x.id").alias("id"), F.col("x.n").cast("long").alias("n_tokens"))
    ends = small.groupBy("stream").agg(F.max("stop").alias("stop"), F.max("seen").alias("seen"), F.max("total").alias("total"))
    tail = ends.where("stop - seen > 1").select("stream", F.col("total").cast("long").alias("ordinal"), F.lit(None).cast(ids.elementType).alias("id"), (F.col("stop") - F.col("seen") - 1).cast("long").alias("n_tokens"))
    return rows.union(tail)


def _scan(df: DataFrame, value: str, name: str, how) -> DataFrame:
    """Adds name: how(value) over all earlier blocks of the stream (0 or null before the first), by a two-level scan."""
    df = df.withColumn("chunk", F.floor(F.col("block") / CHUNK_BLOCKS))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("stream", "chunk").agg(how(value).alias("total"))
    totals = totals.select("stream", "chunk", how("total").over(earlier("stream", "chunk")).alias("outer_"))
    got = df.withColumn("inner_", how(value).over(earlier("stream", "chunk", "block"))).join(totals, ["stream", "chunk"])
    both = F.greatest("inner_", "outer_") if how is F.max else F.coalesce("inner_", F.lit(0)) + F.coalesce("outer_", F.lit(0))
    return got.withColumn(name, both).drop("chunk", "inner_", "outer_")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, eod: int = EOD) -> DataFrame:
    """(stream, ordinal, id, n_tokens) for each row of docs, through flat token blocks in the shared folder.

    Null and empty texts have no tokens. A separator's spelling in a text is
    ordinary text. Repeated rows and null ids are kept. Other columns are left
    out. An empty table gives an empty result.
    """
    ranks = load_ranks(vocabulary)
    blocks = stash(write_tokens(docs, id_col, text_col, ranks, eod), "tokens", compression="zstd")
    return token_counts(blocks, eod, 2 if max(eod, max(ranks.values())) < 1 << 16 else 4)
