"""Writers. Spark's commit protocol makes each of them all or nothing; none overwrites unless told to."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with their fields in the order of their names; NULL fields are left out."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None, sep: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    """A delimited file of the given fields (h, r, t by default); other columns are ignored."""
    df.select(*(fields or ("h", "r", "t"))).write.mode(mode).option("header", header).option("sep", sep).csv(path)


def write_patterns(split: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder of headerless TSV per pattern from (pattern, h, r, t)."""
    split.select("pattern", "h", "r", "t").write.mode(mode).partitionBy("pattern").option("sep", "\t").csv(path)


def write_by_relation(df: DataFrame, path: str, shards: int = 64, mode: str = "errorifexists") -> None:
    """Triples bucketed by relation and entity, so that a large relation is written by many tasks and read with partition pruning on r."""
    spread = F.pmod(F.xxhash64("h"), F.lit(shards))
    df.repartition("r", spread).write.mode(mode).partitionBy("r").parquet(path)


def write_graphml(edges: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """A GraphML file of a relation graph (a, b, weight), written edge by edge from an iterator. More than ``limit`` edges are refused:
    the format is one file."""
    n = edges.count()
    if n > limit:
        raise ValueError(f"{n} edges, at most {limit} fit one GraphML file")
    with Path(path).open("w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="w" for="edge" attr.name="weight" attr.type="double"/>\n<graph edgedefault="directed">\n')
        for r in edges.select(F.explode(F.array("a", "b")).alias("n")).distinct().orderBy("n").toLocalIterator():
            out.write(f"<node id={quoteattr(str(r.n))}/>\n")
        for r in edges.orderBy("a", "b").toLocalIterator():
            out.write(f'<edge source={quoteattr(str(r.a))} target={quoteattr(str(r.b))}><data key="w">{float(r.weight)}</data></edge>\n')
        out.write("</graph>\n</graphml>\n")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def merge_shards(df: DataFrame, key: str, policy: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows of several shards as one: ``append`` keeps all, ``fail`` refuses repeated keys, ``latest`` keeps the last by ``order``."""
    if policy == "append":
        return df
    if policy == "fail":
        twice = df.groupBy(key).count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"repeated {key}: {[r[key] for r in twice]}")
        return df
    if policy == "latest":
        last = F.max_by(F.struct(*df.columns), F.struct(*order))
        return df.groupBy(key).agg(last.alias("_x")).select("_x.*")
    raise ValueError(f"unknown policy: {policy}")
