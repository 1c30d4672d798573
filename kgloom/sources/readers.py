"""Readers of triples and evidence files. Schemas are declared, never inferred; what cannot be read is an error or counted, as each says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.session import cut, drop_cut

TRIPLE = "h string, r string, t string"


def _as_list(item: str) -> Column:
    """The document as an array, NULL if it isn't one (a lone object would be read as an array of one)."""
    return F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>"))


def read_triples(spark: SparkSession, path: str, h: str = "h", r: str = "r", t: str = "t") -> DataFrame:
    """(h, r, t) from ``.csv``, ``.tsv``, ``.jsonl``, ``.json`` (array, or object with ``triples`` or ``triples_out``) or ``.parquet``.

    All values become strings. A missing column, a broken line or a NULL part is an error when the rows are read; blank lines are skipped.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind in ("csv", "tsv"):
        df = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
        lacking = {h, r, t} - set(df.columns)
        if lacking:
            raise ValueError(f"{path} lacks the columns {sorted(lacking)}")
    elif kind == "jsonl":
        df = spark.read.schema(f"`{h}` string, `{r}` string, `{t}` string").option("mode", "FAILFAST").json(path)
    elif kind == "json":
        # a list is parsed element by element, however long it is
        item = f"struct<`{h}`:string,`{r}`:string,`{t}`:string>"
        rows = read_json_array(spark, path, f"`{h}` string, `{r}` string, `{t}` string, triples array<{item}>, triples_out array<{item}>")
        df = rows.select(F.explode(F.coalesce("triples", "triples_out", F.array(F.struct(h, r, t)))).alias("x")).select("x.*")
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported suffix: .{kind}")
    out = df.select(F.col(h).cast("string").alias("h"), F.col(r).cast("string").alias("r"), F.col(t).cast("string").alias("t"))
    bad = F.col("h").isNull() | F.col("r").isNull() | F.col("t").isNull()
    return out.where(F.when(bad, F.raise_error(F.lit(f"{path}: triple with a missing part")).cast("boolean")).otherwise(F.lit(True)))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of a JSON list (or a lone object as one row). The file is parsed as a stream, one element at a time, so it may be larger
    than any single value; a broken file is an error when it is read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_attempts(spark: SparkSession, path: str, attempt: int | None = None) -> DataFrame:
    """(h, r, t, attempt, first_seen) of the checkpoint documents that ``path`` matches (names ending in ``attempt`` and a number, or 0 for
    others): of each attempt the file last changed counts (ties: the last name), each triple once with its lowest attempt.

    ``attempt`` keeps a single one. The triples stand in ``triples_out`` or ``triples``, or the document is a list of them."""
    item = "struct<h:string,r:string,t:string>"
    rows = read_json_array(spark, path, f"h string, r string, t string, triples array<{item}>, triples_out array<{item}>")
    number = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_name", r"(?i)attempt[_-]?(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    rows = rows.withColumns({"attempt": number, "_file": F.struct("_metadata.file_modification_time", "_metadata.file_path")})
    # a file each, so this is small
    last = rows.groupBy(F.col("attempt").alias("_a")).agg(F.max("_file").alias("_last"))
    rows = rows.join(last, (F.col("attempt") == F.col("_a")) & (F.col("_file") == F.col("_last")))
    if attempt is not None:
        rows = rows.where(F.col("attempt") == attempt)
    k = rows.select("attempt", F.explode(F.coalesce("triples_out", "triples", F.array(F.struct("h", "r", "t")))).alias("x")).select("x.*", "attempt")
    return k.where("h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL").groupBy("h", "r", "t").agg(F.min("attempt").alias("attempt"))


_DOC = "r1 string, status string, error string, valid_r2 array<string>, failed_r2 array<string>, support_by_r2 map<string,string>, support_data map<string,struct<loop:string,nonloop:string,total:string>>, top_support array<struct<r2:string,support:string>>, topk_support array<struct<r2:string,support:string>>"


def read_discovery(spark: SparkSession, path: str) -> DataFrame:
    """Support and discovery documents, one a row, with the fields that name an r2; broken lines are dropped."""
    d = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", _DOC).alias("d")).select("d.*")
    return d.where(F.col("r1").isNotNull())


def valid_r2() -> Column:
    """The r2 of a document: those of the first of valid_r2, support_by_r2, support_data that it has, else of both lists together."""
    lists = F.concat(*[F.transform(F.coalesce(c, F.array()), lambda e: e["r2"]) for c in ("top_support", "topk_support")])
    found = F.coalesce("valid_r2", F.map_keys("support_by_r2"), F.map_keys("support_data"), lists)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))))


def filter_r2(docs: DataFrame, allowed: DataFrame) -> DataFrame:
    """``docs`` (r1, fields of :func:`read_discovery`) with every field that names an r2 cut down to what is ``allowed`` (r1, r2) for its r1; a
    document without any allowed r2 keeps empty fields, a field that is NULL stays NULL. Adds ``valid_r2_count``."""
    per = allowed.where("r1 IS NOT NULL AND r2 IS NOT NULL").groupBy(F.col("r1").alias("_r1")).agg(F.collect_set("r2").alias("_ok"))  # as many as relations
    m = docs.join(per, F.col("r1") == F.col("_r1"), "left").withColumn("_ok", F.coalesce("_ok", F.array().cast("array<string>")))
    inside = lambda x: F.array_contains(F.col("_ok"), x)
    names = {c: F.array_sort(F.filter(c, inside)) for c in ("valid_r2", "failed_r2")}
    maps = {c: F.map_filter(c, lambda k, _: inside(k)) for c in ("support_by_r2", "support_data")}
    lists = {c: F.filter(c, lambda e: inside(e["r2"])) for c in ("top_support", "topk_support")}
    return m.withColumns(names | maps | lists).withColumn("valid_r2_count", F.size("valid_r2")).drop("_r1", "_ok")


def failed_only(docs: DataFrame, failed: DataFrame) -> DataFrame:
    """The documents whose r1 is among ``failed`` (one column), to be run again."""
    return docs.join(failed.select(F.col(failed.columns[0]).alias("r1")).distinct(), "r1", "left_semi")


def to_discovery(pairs: DataFrame, states: DataFrame, min_total: float = 1) -> DataFrame:
    """(r1, status, valid_r2, valid_r2_count) from support: the r2 of ``pairs`` (r1, r2, total) with ``min_total`` or more; without any, a status
    of ERROR or NOT_FOUND in ``states`` (r1, status) stays, any other becomes NOT_FOUND. Names other than P and digits are dropped."""
    ok = pairs.where((F.col("total") >= min_total) & is_pid("r1") & is_pid("r2")).groupBy(F.col("r1").alias("_r1")).agg(F.array_sort(F.collect_set("r2")).alias("valid_r2"))  # as many as relations
    m = states.where(is_pid("r1")).groupBy("r1").agg(F.max("status").alias("_s")).join(ok, F.col("r1") == F.col("_r1"), "left")
    status = F.when(F.size(F.coalesce("valid_r2", F.array())) > 0, "SUCCESS").when(F.col("_s").isin("ERROR", "NOT_FOUND"), F.col("_s")).otherwise("NOT_FOUND")
    found = F.coalesce("valid_r2", F.array().cast("array<string>"))
    return m.select("r1", status.alias("status"), found.alias("valid_r2"), F.size(found).alias("valid_r2_count"))


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(relation, subject_type, object_type) from JSON lines or a JSON list; rows with a missing part are dropped."""
    fields = "relation string, subject_type string, object_type string"
    df = spark.read.schema(fields).json(path) if path.endswith(".jsonl") else read_json_array(spark, path, fields)
    return df.where("relation IS NOT NULL AND subject_type IS NOT NULL AND object_type IS NOT NULL").distinct()


def ontology_ok(rows: DataFrame, table: DataFrame | None) -> DataFrame:
    """``rows`` (r, subject_type, object_type, …) with ``ontology_ok``: true without a table, where a type is missing, or where the table has the
    three together."""
    if table is None:
        return rows.withColumn("ontology_ok", F.lit(True))
    t = table.select(F.col("relation").alias("_r"), F.col("subject_type").alias("_s"), F.col("object_type").alias("_o"), F.lit(True).alias("_has")).distinct()
    m = rows.join(t, (F.col("r") == F.col("_r")) & (F.col("subject_type") == F.col("_s")) & (F.col("object_type") == F.col("_o")), "left")
    return m.withColumn("ontology_ok", F.col("subject_type").isNull() | F.col("object_type").isNull() | F.col("_has").isNotNull()).drop("_r", "_s", "_o", "_has")


def read_triples_leniently(spark: SparkSession, path: str | Sequence[str], h: str = "h", r: str = "r", t: str = "t", recursive: bool = False, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(triples as a bag, one row with the number of malformed rows) from all JSON-lines files of one or more folders."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern)
    text = reader.text(path).where(F.trim("value") != "")
    x = F.from_json("value", f"`{h}` string, `{r}` string, `{t}` string")
    rows = text.select(x[h].alias("h"), x[r].alias("r"), x[t].alias("t"))
    whole = F.col("h").isNotNull() & F.col("r").isNotNull() & F.col("t").isNotNull()
    return rows.where(whole), rows.agg(F.count_if(~whole).alias("malformed"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(h, r, t, source, provenance): JSON lines in which edge_source or source names the origin; everything else is kept as a map."""
    text = spark.read.text(path).where(F.trim("value") != "")
    m = F.from_json("value", "map<string,string>")
    m = text.select(m.alias("m"))
    source = F.coalesce(F.col("m")["edge_source"], F.col("m")["source"], F.lit("canonical_observed"))
    rest = F.map_filter("m", lambda k, _: ~k.isin("h", "r", "t", "source", "edge_source"))
    return m.select(F.col("m")["h"].alias("h"), F.col("m")["r"].alias("r"), F.col("m")["t"].alias("t"), source.alias("source"), rest.alias("provenance"))


def read_candidate_shards(spark: SparkSession, path: str, relations: DataFrame | None = None) -> DataFrame:
    """(h, r, t, source_path, source_line, rest) of all shards; relation may stand in ``r`` or ``relation``; rows without h, r or t are dropped.

    Lines stay where they are read: a task reads the lines of a split one after the other, so a line's number is its place in its split plus
    the lines of the splits before, of which only the counts are shuffled. ``relations`` (one column) restricts to some relations.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"))
    splits = text.groupBy(F.col("source_path").alias("_path"), F.col("_at").alias("_start")).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    text = text.join(splits, (F.col("source_path") == F.col("_path")) & (F.col("_at") == F.col("_start"))).withColumn("source_line", F.col("_before") + F.col("_i") - F.col("_first") + 1)
    m = text.select("source_path", "source_line", F.from_json("value", "map<string,string>").alias("m"))
    out = m.select(F.col("m")["h"].alias("h"), F.coalesce(F.col("m")["r"], F.col("m")["relation"]).alias("r"), F.col("m")["t"].alias("t"), "source_path", "source_line", F.map_filter("m", lambda k, _: ~k.isin("h", "r", "t", "relation")).alias("rest"))
    out = out.where(F.col("h").isNotNull() & F.col("r").isNotNull() & F.col("t").isNotNull())
    return out if relations is None else out.join(relations.select(F.col(relations.columns[0]).alias("r")).distinct(), "r", "left_semi")


_LISTS = ("topk_support", "top_support", "support")
_COUNTS = "struct<loop:string,nonloop:string,total:string>"


def read_hop_support(spark: SparkSession, path: str, only_success: bool = True) -> DataFrame:
    """(r1, r2, loop, nonloop, total, status) from support documents, in any of their layouts.

    ``support_data`` maps r2 to counts; older documents map r2 to a number (``support_by_r2``) or list them (``topk_support``, ``top_support``,
    ``support``, in this order; of an r2 listed twice the first counts). Names other than P and digits are dropped, a total that is missing
    or 0 is loop + nonloop; broken lines are dropped.
    """
    doc = f"r1 string, status string, support_data map<string,{_COUNTS}>, support_by_r2 map<string,string>, " + ", ".join(f"{c} array<struct<r2:string,support:string>>" for c in _LISTS)
    text = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", doc).alias("d")).select("d.*")
    null = F.lit(None).cast("string")
    new = F.transform(F.map_entries("support_data"), lambda e: F.struct(e["key"].alias("r2"), e["value"]["loop"].alias("loop"), e["value"]["nonloop"].alias("nonloop"), e["value"]["total"].alias("total")))
    old = F.transform(F.map_entries("support_by_r2"), lambda e: F.struct(e["key"].alias("r2"), null.alias("loop"), null.alias("nonloop"), e["value"].alias("total")))
    listed = F.concat(*[F.coalesce(c, F.array()) for c in _LISTS])
    first = F.filter(listed, lambda e, i: F.array_position(F.transform(listed, lambda x: x["r2"]), e["r2"]) == i + 1)
    top = F.transform(F.when(F.size(listed) > 0, first), lambda e: F.struct(e["r2"].alias("r2"), null.alias("loop"), null.alias("nonloop"), e["support"].alias("total")))
    rows = text.select("r1", F.coalesce("status", F.lit("NO_STATUS")).alias("status"), F.explode(F.coalesce(new, old, top)).alias("x"))
    whole = lambda c: F.coalesce(F.col(c).try_cast("double").try_cast("long"), F.lit(0))
    rows = rows.where(is_pid("r1") & is_pid("x.r2"))
    out = rows.select("r1", F.col("x.r2").alias("r2"), whole("x.loop").alias("loop"), whole("x.nonloop").alias("nonloop"), F.coalesce(F.nullif(whole("x.total"), F.lit(0)), whole("x.loop") + whole("x.nonloop")).alias("total"), "status")
    return out.where(F.col("status") == "SUCCESS") if only_success else out


def read_compositions(spark: SparkSession, path: str, only_success: bool = True) -> DataFrame:
    """(r1, r2, r3, support, examined, shortcuts, missing, confidence) from verified composition documents."""
    rec = "struct<chain_pairs_examined:bigint,chain_pairs_with_shortcut:bigint,chain_pairs_missing_shortcut:bigint,sample_confidence:double>"
    doc = f"input_status string, r1 string, r2 string, support bigint, rule_verification struct<composition:map<string,{rec}>>"
    d = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", doc).alias("d")).select("d.*")
    if only_success:
        d = d.where(F.col("input_status") == "SUCCESS")
    rows = d.select("r1", "r2", F.coalesce("support", F.lit(0)).alias("support"), F.explode("rule_verification.composition").alias("r3", "x")).where(is_pid("r1") & is_pid("r2") & is_pid("r3"))
    n, k = F.coalesce("x.chain_pairs_examined", F.lit(0)), F.coalesce("x.chain_pairs_with_shortcut", F.lit(0))
    return rows.select("r1", "r2", "r3", "support", n.alias("examined"), k.alias("shortcuts"), F.coalesce("x.chain_pairs_missing_shortcut", F.greatest(n - k, F.lit(0))).alias("missing"), F.when(n > 0, k / n).otherwise(F.lit(0.0)).alias("confidence"))


def read_allocations(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, relation, eta) of positive budget from CSV, JSON lines, a JSON list or an object with ``allocations``; eta is the first of
    eta_integer, eta, eta_expected that is present, and may be named ``n`` or ``count`` in CSV files."""
    fields = ("pattern", "relation", "eta_integer", "eta", "eta_expected")
    if path.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        alias = {"pid": "relation", "property": "relation", "property_id": "relation", "n": "eta", "count": "eta", "quota": "eta", "group": "pattern"}
        for old, new in alias.items():
            if old in df.columns and new not in df.columns:
                df = df.withColumnRenamed(old, new)
        for f in fields:
            if f not in df.columns:
                df = df.withColumn(f, F.lit(None).cast("string"))
    else:
        row = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
        if path.endswith(".jsonl"):
            df = spark.read.schema(", ".join(f"{f} string" for f in fields)).json(path)
        else:
            text = spark.read.option("wholetext", True).text(path)
            df = text.select(F.explode(F.coalesce(_as_list(row), F.from_json("value", f"struct<allocations:array<{row}>>")["allocations"])).alias("x")).select("x.*")
    eta = F.coalesce(*[F.col(f).try_cast("double") for f in ("eta_integer", "eta", "eta_expected")])
    return df.select("pattern", "relation", eta.alias("eta")).where((F.col("eta") > 0) & F.col("relation").isNotNull())


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value), non-zero, from nested JSON ``{row: {col: value}}`` or JSON lines with these three fields."""
    if path.endswith(".jsonl"):
        df = spark.read.schema("row string, col string, value double").json(path)
    else:
        text = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,map<string,double>>").alias("m"))
        df = text.select(F.explode("m").alias("row", "cells")).select("row", F.explode("cells").alias("col", "value"))
    return df.where(F.coalesce(F.col("value") != 0, F.lit(False)))


def read_entity_types(spark: SparkSession, path: str) -> DataFrame:
    """(entity, types) from JSON lines, a JSON list of {entity, types} or an object ``{entity: [types]}``."""
    row = "struct<entity:string,types:array<string>>"
    if path.endswith(".jsonl"):
        return spark.read.schema("entity string, types array<string>").json(path)
    text = spark.read.option("wholetext", True).text(path)
    rows = _as_list(row)
    pairs = F.transform(F.map_entries(F.from_json("value", "map<string,array<string>>")), lambda e: F.struct(e["key"].alias("entity"), e["value"].alias("types")))
    return text.select(F.explode(F.coalesce(rows, pairs)).alias("x")).select("x.*")


def type_closure(direct: DataFrame, subclass: DataFrame) -> DataFrame:
    """(entity, type) through any number of subclass steps. ``direct``: entity, type; ``subclass``: type, super. Cycles are harmless, rows
    with a NULL take no part.

    The closure is taken over the types, which are few against the entities: steps of doubled length until nothing is new, so the rounds grow
    with the logarithm of the deepest chain. The entities are joined to it once."""
    known = cut(subclass.where("type IS NOT NULL AND super IS NOT NULL AND type <> super").select("type", "super").distinct())
    n, before = known.count(), -1
    while n != before:
        twice = known.join(known.select(F.col("type").alias("super"), F.col("super").alias("_up")), "super").select("type", F.col("_up").alias("super")).where("type <> super")
        wider = cut(known.unionByName(twice).distinct())
        drop_cut(known)
        known, before, n = wider, n, wider.count()
    own = direct.where("entity IS NOT NULL AND type IS NOT NULL").select("entity", "type").distinct()
    return own.unionByName(own.join(known, "type").select("entity", F.col("super").alias("type"))).distinct()


def is_pid(c: str | Column, strict: bool = False) -> Column:
    """P and digits; ``strict``: no leading zero."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike("^P[1-9][0-9]*$" if strict else "^P[0-9]+$")


def merge_folder(spark: SparkSession, path: str, relations: DataFrame | None = None, recursive: bool = True) -> DataFrame:
    """Distinct triples of all JSON-lines files below a folder, of the given relations only if there are any."""
    k, _ = read_triples_leniently(spark, path, recursive=recursive)
    if relations is not None:
        k = k.join(relations.select(F.col(relations.columns[0]).alias("r")).distinct(), "r", "left_semi")
    return k.select("h", "r", "t").distinct()
