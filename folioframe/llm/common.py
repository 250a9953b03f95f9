"""What several operators share: table access, checkpoints, text pieces."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separator of the corpus contracts: ASCII white space only.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset a temporary folder on a local master, else an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` (few bytes a row) in the shared checkpoint folder and cut its lineage."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing reads any more."""
    for file in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bind(value: Column, body) -> Column:
    """``let value in body``: evaluates ``value`` once for use inside lambdas."""
    return F.transform(F.array(value), body)[0]


#: Rows, and bytes of their texts, handed on in one Arrow batch (one row at least).
ROWS_PER_BATCH, BYTES_PER_BATCH = 500, 1 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch whose last column is the text, in slices of few rows and bytes."""
    last = batch.columns[-1]
    sized = pa.types.is_string(last.type) or pa.types.is_binary(last.type) or pa.types.is_large_string(last.type)
    ends = np.cumsum([0, *(pc.fill_null(pc.binary_length(last), 0).to_numpy() if sized else np.zeros(len(last), dtype=np.int64))])
    at = 0
    while at < batch.num_rows:
        past = min(at + ROWS_PER_BATCH, batch.num_rows, max(at + 1, int(np.searchsorted(ends, ends[at] + BYTES_PER_BATCH, "right")) - 1))
        yield batch.slice(at, past - at)
        at = past


_lone: dict = {}


def lone(key, make: Callable):
    """What ``make`` gives, kept by the worker until something else is asked for.

    Workers outlive a stage; a tokenizer or table that only an earlier stage
    needed must not stay beside that of the next one.
    """
    if key not in _lone:
        _lone.clear()
        _lone[key] = make()
    return _lone[key]


def per_text(df: DataFrame, text_col: str, keep: tuple[str, ...], fields: list[tuple[str, str, pa.DataType]], row: Callable[[str | None], tuple]) -> DataFrame:
    """``keep`` columns as they are, plus ``fields`` (name, SQL type, Arrow type) that ``row`` gives for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                *kept, texts = batch.columns
                got = [row(x.as_py()) for x in texts]
                made = [pa.array([r[i] for r in got], type=t) for i, (_, _, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:-1], *(n for n, _, _ in fields)])

    own = df.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in own.dtypes[:-1]), *(f"`{n}` {t}" for n, t, _ in fields)])
    return own.mapInArrow(run, schema)
