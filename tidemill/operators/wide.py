"""Attribute rows as one typed row per entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.batches import starts_of, whole_groups
from tidemill.functions.typed import BLANKS, instant, number

#: Rows whose cells are merged at a time before the shuffle.
HELD = 200_000
READERS = {"number": number, "date": instant, "string": lambda text: text}


def attribute_name(name: Column) -> Column:
    return F.lower(F.btrim(name, F.lit(BLANKS)))


def _cells(rows: DataFrame) -> DataFrame:
    cells = rows.select("tsuid", attribute_name(F.col("name")).alias("name"), "updated_at", "value")
    return cells.where(F.col("tsuid").isNotNull() & F.col("name").isNotNull() & (F.col("name") != ""))


def _newest(table: pa.Table) -> pa.Table:
    """The first row of each entity and attribute, the newest first."""
    order = [("tsuid", "ascending"), ("name", "ascending"), ("updated_at", "descending"), ("value", "descending")]
    ranked = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_end"))
    return ranked.filter(pa.array(starts_of(ranked, ["tsuid", "name"])))


def _merged(rows: DataFrame) -> DataFrame:
    """Cells merged within each task, then laid out by entity: ``tsuid, name, updated_at, value``, sorted by entity. A hot
    entity comes with no more than its attributes from every some hundred thousand rows."""
    cells = _cells(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD:
                yield from _newest(pa.Table.from_batches(held)).to_batches()
                held, count = [], 0
        if count:
            yield from _newest(pa.Table.from_batches(held)).to_batches()

    return cells.mapInArrow(run, cells.schema).repartition("tsuid").sortWithinPartitions("tsuid")


def newest_cells(rows: DataFrame) -> DataFrame:
    """``tsuid, name, value``: the newest value of each attribute of each entity.

    The merge of two cells keeps the greater ``(updated_at, value)``; it is associative and runs before the shuffle,
    so versions and duplicates of a hot entity never meet in one task. A NULL ``updated_at`` is the oldest; of rows
    tied on it the greatest value counts, NULL below all. Rows without entity or name are left out.
    """
    kernel = lambda table, first: _newest(table).select(["tsuid", "name", "value"])
    return _merged(rows).mapInArrow(whole_groups(["tsuid"], kernel), "tsuid string, name string, value string")


def declared_types(types: DataFrame, limit: int = 2_000) -> dict[str, str]:
    """Attribute to type. They become columns, so their number is bounded: more than ``limit`` is an error."""
    rows = (
        types.select(attribute_name(F.col("name")).alias("name"), F.lower(F.btrim("data_type")).alias("data_type"))
        .where(F.col("name").isNotNull() & F.col("data_type").isin(list(READERS)))
        .groupBy("name")
        .agg(F.min("data_type").alias("data_type"))
        .orderBy("name")
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(f"more than {limit} declared attributes can't become columns")
    return {r["name"]: r["data_type"] for r in rows}


def typed_cells(rows: DataFrame, types: DataFrame) -> DataFrame:
    """``tsuid, name, value, data_type, number, instant, readable`` of the newest cells of declared attributes."""
    declared = declared_types(types)
    pairs = [x for name, kind in declared.items() for x in (F.lit(name), F.lit(kind))]
    kind = F.element_at(F.create_map(*pairs), F.col("name")) if pairs else F.lit(None).cast("string")
    cells = newest_cells(rows).withColumn("data_type", kind).where(F.col("data_type").isNotNull())
    cells = cells.withColumn("number", F.when(F.col("data_type") == "number", number(F.col("value"))))
    cells = cells.withColumn("instant", F.when(F.col("data_type") == "date", instant(F.col("value"))))
    readable = F.when(F.col("data_type") == "number", F.col("number").isNotNull()).when(
        F.col("data_type") == "date", F.col("instant").isNotNull()
    )
    return cells.withColumn("readable", F.col("value").isNotNull() & F.coalesce(readable, F.lit(True)))


def widen(rows: DataFrame, types: DataFrame) -> DataFrame:
    """One row per entity: ``tsuid``, a typed column per declared attribute (a blank in its name becomes ``_``; one
    that would clash with a column here gets a trailing ``_``), ``other`` (map of undeclared attributes to their
    newest value), ``unfilled`` (names whose newest value can't be read as the declared type) and ``absent`` (declared
    names without a row or whose newest value is NULL).

    Each entity has a register of one slot per declared attribute. Cells are merged within tasks, shuffled once by entity,
    merged again and put into the register; its texts are then read as their types. An empty table gives no rows.
    """
    declared = declared_types(types)
    names = pa.array(list(declared), pa.string())
    n = len(names)

    def kernel(table: pa.Table, first: np.ndarray) -> pa.Table:
        cells = _newest(table)
        begin = np.flatnonzero(starts_of(cells, ["tsuid"]))
        entity = np.cumsum(starts_of(cells, ["tsuid"])) - 1
        at = pc.index_in(cells.column("name").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
        known = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), dtype=bool)
        register = np.full(len(begin) * n, -1, dtype=np.int64)
        register[entity[known] * n + at[known].astype(np.int64)] = np.flatnonzero(known)
        value = cells.column("value").combine_chunks()
        slots = value.take(pa.array(register, mask=register < 0))
        rest = np.flatnonzero(~known)
        ends = np.searchsorted(entity[rest], np.arange(len(begin) + 1)).astype(np.int32)
        other = pa.MapArray.from_arrays(pa.array(ends), cells.column("name").combine_chunks().take(pa.array(rest)), value.take(pa.array(rest)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * n), slots)
        return pa.table([cells.column("tsuid").take(pa.array(begin)), lists, other], ["tsuid", "slots", "other"])

    filled = _merged(rows).mapInArrow(whole_groups(["tsuid"], kernel), "tsuid string, slots array<string>, other map<string,string>")
    taken, columns, unread, missing = {"tsuid", "other", "unfilled", "absent"}, [], [], []
    for k, (name, kind) in enumerate(declared.items()):
        column = name.replace(" ", "_")
        while column in taken:
            column += "_"
        taken.add(column)
        text = F.col("slots")[k]
        value = READERS[kind](text)
        columns.append(value.alias(column))
        unread.append(F.when(text.isNotNull() & value.isNull(), F.lit(name)))
        missing.append(F.when(text.isNull(), F.lit(name)))
    none = F.array().cast("array<string>")
    return filled.select(
        "tsuid", *columns, "other",
        (F.array_compact(F.array(*unread)) if unread else none).alias("unfilled"),
        (F.array_compact(F.array(*missing)) if missing else none).alias("absent"),
    )


def unreadable_cells(rows: DataFrame, types: DataFrame) -> DataFrame:
    """``tsuid, name`` of declared attributes whose newest value is given but not of the declared type, as reported
    by ``widen``."""
    return widen(rows, types).select("tsuid", F.explode("unfilled").alias("name"))
