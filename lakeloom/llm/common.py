"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: a worker never holds more text than this (one longer text excepted).
BATCH_ROWS, BATCH_BYTES = 500, 3 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset (tests on one machine), a temporary one, the same for the whole process."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="lakeloom-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return f"file://{_OWN_DIR[0]}"


_OWN_DIR: list[str] = []
#: Tables that stored() wrote and nobody released yet: path -> session.
_TABLES: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: lineage ends here, nothing is computed twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _TABLES[path] = df.sparkSession
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing will read again; any other DataFrame is left alone."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            _delete(path)


def tables() -> set[str]:
    """The paths of all tables that are not released; see sweep."""
    return set(_TABLES)


def sweep(keep: set[str] = frozenset()) -> None:
    """Delete all tables but these. An operator's result may read its tables until it has been written, so only the caller knows when."""
    for path in set(_TABLES) - set(keep):
        _delete(path)


def _delete(path: str) -> None:
    spark = _TABLES.pop(path, None)
    if spark is None:
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files stay on the executors' disks until the driver collects plans that nobody holds; this makes it do so now."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(name: str, *used: DataFrame) -> str:
    """A column name that none of these tables has."""
    taken = {c.lower() for df in used for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of each row, different for all rows and the same whenever it is computed.

    Rows of files are numbered by file and place, without a copy; anything else is written as a table first.
    """
    try:
        places = docs.select("*", F.col("_metadata.file_path").alias(path := fresh("path", docs)), F.col("_metadata.row_index").alias(at := fresh("row_at", docs)))
    except AnalysisException:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    files = places.select(path).distinct()
    files = stored(files.withColumn(number := fresh("file_number", docs), F.row_number().over(Window.orderBy(path)).cast("bigint")), "files")
    return places.join(files, path).withColumn(name, F.shiftleft(number, 40) + F.col(at)).drop(path, at, number)


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds (a smaller number of rows in the session stays) and send this package to the executors."""
    _send_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def _send_package(spark: SparkSession) -> None:
    """Once for each application; workers then need no path to this package."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    _SENT.add(app)
    package = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="lakeloom-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / f"{package.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(folder / f"{package.name}.zip"))


_SENT: set[str] = set()


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about this many; for narrow rows, whose batches need not be as small as those of texts."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.concat_batches(held)
            held, count = [], 0
    if held:
        yield pa.concat_batches(held)


def whole_text(batch: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8; bytes of a string that are none (Spark doesn't check) count as U+FFFD."""
    try:
        batch.validate(full=True)
        return batch.cast(pa.binary()).to_pylist()
    except pa.ArrowInvalid:
        return [t if t is None else t.decode("utf-8", "replace").encode() for t in batch.cast(pa.binary()).to_pylist()]


def text_udf(function, schema: str, raw: bool = False):
    """function(list of UTF-8 bytes or None, one per row) -> dict or tuple of columns, as an Arrow UDF that returns a struct. raw: bytes as they are.

    It is marked non-deterministic so that the optimizer never evaluates it twice for one row.
    """
    fields = [(x.split(" ", 1)[0], x) for x in _split(schema)]

    @F.arrow_udf(f"struct<{','.join(f'{n}:{x.split(' ', 1)[1]}' for n, x in fields)}>")
    def apply(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = function()
        for batch in texts:
            arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in run(batch.cast(pa.binary()).to_pylist() if raw else whole_text(batch))]
            yield pa.StructArray.from_arrays(arrays, names=[n for n, _ in fields])
        _give_back()

    return apply.asNondeterministic()


def _give_back() -> None:
    """Return freed memory to the system after a task: a worker lives on, idle, beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def keep_freed(most: int = 64 << 20) -> None:
    """Freed memory up to this stays with the process: arrays of a few MB that come and go would be mapped and cleared anew each time."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, most)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        return


def _split(schema: str) -> list[str]:
    """The parts of "a int, b array<struct<x: int, y: int>>" at the commas outside brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(schema[start:i].strip())
            start = i + 1
    return [*parts, schema[start:].strip()]


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of a column as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def share_of(df: DataFrame, rate: float, seed: int, *columns: str) -> DataFrame:
    """The rows whose hash falls into a share; the same rows each time, drawn without a shuffle."""
    most = 1 << 40
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(most)) < F.lit(int(min(1.0, rate) * most)))


def drawn(df: DataFrame, rate: float, most: int, seed: int, *columns: str) -> DataFrame:
    """At most ``most`` rows of a share, those of the least hashes: bounded also where rows repeat."""
    return share_of(df, rate, seed, *columns).orderBy(F.xxhash64(F.lit(seed), *columns)).limit(most)


def slices(text: Column, seed: Column, length: int) -> Column:
    """A piece of at most length characters that starts at a place drawn from seed, for fitting models."""
    return F.substring(text, (F.pmod(seed, F.greatest(F.length(text) - length + 1, F.lit(1)).cast("long")) + 1).cast("int"), F.lit(length))


class Adam:
    """Adam for a dict of arrays, updated in place."""

    def __init__(self, parts: dict[str, np.ndarray], rate: float):
        self.parts, self.rate, self.t = parts, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parts.items()}
        self.v = {k: np.zeros_like(v) for k, v in parts.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        rate = self.rate * scale * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.parts[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.parts[k].dtype)
