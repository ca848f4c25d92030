"""What the operators of this subpackage share: words, folds, tables in the shared folder, membership filters."""

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"  # Java and RE2 syntax; bytes.split() of Python cuts at the same seven characters
FILTER_BITS = 1 << 27  # upper bound of a membership filter: 16 MB


def shared_folder(spark):
    """The folder that driver and executors share, as the cluster names it.

    Only a local session without the setting gets a temporary folder of its own.
    """
    conf = spark.sparkContext.getConf()
    place = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stored(df, name):
    """``df`` as a table in the shared folder: cuts lineage and outlives a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def apart(docs, *needed):
    """(``docs`` with every column but ``needed`` under a name that no operator uses, function that gives a result its old columns back)."""
    names = [c if c in needed else f"in_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*docs.columns)


def fold(key, parts):
    """crc32 of the id as text, modulo ``parts``; a row without an id is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(-1))


def lowered(text):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def raw_texts(column):
    """UTF-8 bytes of an Arrow text column; null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


#: DuckDB: one row with the table of CRC-32, and the checksum of a text of ASCII characters in a query that joins it, for oracles.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)),
    lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(b)))"""


def crc_sql(text):
    return ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(" + text + ", ''), lambda x: ascii(x)::BIGINT)), "
            "lambda a, x: xor(a >> 8, crc_table.t[1 + (xor(a, x) & 255)])), 4294967295)")


class Hashes(dict):
    """64-bit hash of a word, worked out once per task; emptied when it holds ``most`` words."""

    most = 250_000

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words):
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x):
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def tidy(run):
    """``run`` over the batches of a task; after it the worker gives its free memory back.

    Python workers outlive their tasks, and what an allocator keeps in one is lost to the
    executor's later stages.
    """
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def lists(values, lengths, kind):
    """Arrow list column from one flat array."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


class IdFilter:
    """Fixed-size bit table of ids for a cheap test while a table is scanned.

    It passes every id it was built from and some others, so an exact join or
    grouping has to follow. Its size is 16 bits per id, at most FILTER_BITS in
    all: beyond that it lets more rows pass and stays right.
    """

    def __init__(self, ids, column="doc_id"):
        spark = ids.sparkSession
        n = ids.count()
        self.bits = 1 << max(10, min(FILTER_BITS, 16 * n).bit_length() - 1)
        slot = F.pmod(F.xxhash64(F.col(column)), F.lit(self.bits)).alias("slot")
        words = (ids.select(slot)
                 .groupBy(F.floor(F.col("slot") / 32).alias("at"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("word")).toArrow())
        table = np.zeros(self.bits // 32, np.uint32)
        table[words["at"].to_numpy()] = words["word"].to_numpy().astype(np.uint32)
        self.shared = spark.sparkContext.broadcast(table)

    def rows(self, df, column="doc_id"):
        """The rows whose id may be a member."""
        table, bits = self.shared, self.bits
        schema = df.schema

        def keep(batches):
            for batch in batches:
                slot = batch.column(batch.num_columns - 1).to_numpy()
                hit = (table.value[slot // 32] >> (slot % 32).astype(np.uint32)) & 1
                out = batch.filter(pa.array(hit.astype(bool)))
                yield pa.RecordBatch.from_arrays(out.columns[:-1], out.schema.names[:-1])

        slot = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
        return df.withColumn("_slot_of_filter", slot).mapInArrow(keep, schema)
