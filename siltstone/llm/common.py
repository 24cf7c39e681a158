"""What the operators share: reading a table, written tables, words, joins by hot keys."""

from __future__ import annotations

import ctypes
from contextlib import suppress

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.staging import shared_dir, shared_path, staged

__all__ = ["WORD", "bound", "forget", "joined", "let_go", "memories", "range_count", "shared_dir", "shared_path", "staged", "table", "texts", "trimmed", "word_count"]

#: A word: a run of code points other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """doc_id and text of a table, dealt anew only if it has fewer partitions than there are cores."""
    df, cores = table(spark, sf_dir, name).select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, F.xxhash64("doc_id", "text"))


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bound(x: Column, f) -> Column:
    """f of x, with x computed once for each row though f names it more often or in inner functions."""
    return F.transform(F.array(x), f)[0]


#: Most keys that `joined` treats as heavy, and fewest rows of one.
MOST_HEAVY, LEAST_HEAVY = 1 << 16, 1 << 10


def joined(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows with the facts of their key; facts holds each key once, with the number n of its rows among all `total`.

    Keys of more than total / MOST_HEAVY rows are at most MOST_HEAVY, so their facts can be broadcast and
    no task gets all rows of one. The rest is dealt by key. The facts are written, so that a look shows whether there are such keys.
    """
    if total <= LEAST_HEAVY:
        return rows.join(facts, key)
    facts, heavy = staged(facts, "facts"), F.col(n) > max(total // MOST_HEAVY, LEAST_HEAVY)
    few = facts.where(heavy)
    if few.isEmpty():
        return rows.join(facts, key)
    light = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(facts.where(~heavy), key)
    return rows.join(F.broadcast(few), key).unionByName(light)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect what finished jobs hold, as Spark does every half hour, and give memory that it has freed back to the system.

    For ends of loops of many small jobs, and between stages. Jobs run on hundreds of the driver's threads, and the C library keeps what each
    of them freed; Java trims it on Linux (from 17.0.9 on). Elsewhere only the garbage is collected.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    # by reflection, since the server's own class is not public
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    asked = spark.sparkContext._gateway.new_array(jvm.Object, 4)
    asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with suppress(Py4JJavaError):
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)


#: Words that this process, a worker, remembers between tasks, a mapping for each operator.
memories: list[dict] = []


def forget(but: dict | None = None) -> None:
    """Empty the memories of words, all or all but one, and give freed memory back to the system.

    With `but`, at the beginning of a task that needs that one: nothing is done if the others are empty.
    """
    others = [memory for memory in memories if memory is not but and (memory or but is None)]
    if but is not None and not others:
        return
    for memory in others:
        memory.clear()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # the GNU C library only
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """run, a function of batches, whose worker forgets at its end what other stages left: it stays for later ones, which need their own memory."""

    def done(batches):
        yield from run(batches)
        forget()

    return done


def range_count(size: int, least: int = 4 << 20, most: int = 512 << 20) -> int:
    """Number of ranges for so many bytes of text: each has `least` bytes, from 4096 ranges on more, up to `most`."""
    return max(1, min(4096, size // least), size // most)
