"""Shared pieces of the corpus operators: words, row keys, staging tables, sorted streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, for Java's and RE2's regular expressions alike.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """64-bit key of a text; with doc_id it names a row up to exact repetition."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text))


def staging_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; one of our own only where it names
    none and driver and executors are one process (tests). A cluster without one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="staging-")
    return base.rstrip("/")


_own: dict[str, str] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and a lost
    executor costs no recomputation of what came before."""
    path = f"{staging_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove a staged table that no plan needs any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """(_k, _salts): keys that hold more than a task's share of df, and over how many salts to deal
    them; None if there is none.

    A frequent-items sketch names them: as many keys at most as there are shuffle partitions, so the
    result may be broadcast. What the sketch misses only stays unsalted. df is read once, so it should
    be staged.
    """
    spark = df.sparkSession
    parts = min(max(shuffle_parts(spark), 2), 4096)
    n, top = df.where(F.col(key).isNotNull()).agg(F.count("*"), F.expr(f"approx_top_k(`{key}`, {parts}, {16 * parts})")).first()
    share = max(n // (2 * parts), 64)
    hot = [(r["item"], -(-r["count"] // share)) for r in top or [] if r["count"] > 2 * share]
    return F.broadcast(spark.createDataFrame(hot, f"_k {dict(df.dtypes)[key]}, _salts long")) if hot else None


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", like: DataFrame | None = None) -> DataFrame:
    """many joined to one on key (a column of both), where `one` has a row a key at most.

    Hot keys of `many` are dealt over salts by the rest of the row, and their row of `one` is copied to
    each salt. hot_keys() reads `like`, a frame with the same keys (`many` itself if None). NULL keys
    match nothing.
    """
    salts = hot_keys(many if like is None else like, key)
    if salts is None:
        return many.join(one, key, how)
    rest = [F.col(f"`{c}`") for c in many.columns if c != key]
    dealt = many.join(salts, F.col(key) == F.col("_k"), "left").withColumn(
        "_salt", F.when(F.col("_k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rest), F.col("_salts")))
    )
    copied = one.join(salts, F.col(key) == F.col("_k"), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return dealt.drop("_k", "_salts").join(copied.drop("_k", "_salts"), [key, "_salt"], how).drop("_salt")


def sorted_stream(
    df: DataFrame,
    key: str,
    order: list[str],
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Rows of a key together and in order, seen by fn as a stream of batches."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(fn, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of batches cut so that a key never spans two of them."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        k = cols[key]
        last = int(np.searchsorted(k == k[-1], True)) if k[0] != k[-1] else 0
        if last:
            whole = {n: c[:last] for n, c in cols.items()}
            yield {n: np.concatenate([*(h[n] for h in held), whole[n]]) for n in whole} if held else whole
            held = []
        elif held and held[-1][key][-1] != k[0]:
            yield {n: np.concatenate([h[n] for h in held]) for n in cols}
            held = []
        held.append({n: c[last:] for n, c in cols.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def bounds(k: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else np.zeros(1, int)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Forest:
    """Union-find over integers seen so far; join() tells whether two trees became one."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
