"""Exact deduplication by content sort.

Sampled splitters range-partition the texts, each partition is sorted (externally, by Spark), and
neighbours are compared in full.  The sort key is (first characters, 64-bit hash, whole text,
identifier): equal texts are adjacent, splitters stay small however long the texts are, and since
the identifier, and after it the row's place in the input, are part of the splitters, a text that
fills a third of the table spreads over many partitions, even if its rows repeat.  A run that crosses a partition's border is joined to its other parts by the full text
of the border runs, of which there are two a partition.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of

#: Characters of a text that take part in the splitters.
PREFIX = 24


def _runs(names: list[str]):
    """Number the runs of equal neighbours; rows of kind 1 hold the text of a border run."""

    def run(batches):
        pid = TaskContext.get().partitionId()
        number, place, last = 0, 0, None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            kind, runs, shas, edge = [0] * len(texts), [], [], [None] * len(texts)
            for k, text in enumerate(texts):
                if last is None or text != last:
                    number += 1
                    last = text
                    sha = hashlib.sha256(text.encode()).digest()
                runs.append(number)
                shas.append(sha)
            places = list(range(place, place + len(texts)))
            place += len(texts)
            rest = [batch.column(i + 1) for i in range(len(names))]
            yield _rows([kind, [pid] * len(texts), runs, places, shas, edge], rest, names)
            if number and runs and runs[0] == 1 and places[0] == 0:
                yield _rows([[1], [pid], [1], [-1], [shas[0]], [texts[0]]], [pa.nulls(1, c.type) for c in rest], names)
                shape = [c.type for c in rest]
        if number > 1:
            yield _rows([[1], [pid], [number], [-1], [sha], [last]], [pa.nulls(1, t) for t in shape], names)

    return run


def _rows(own, rest, names):
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    arrays = [pa.array(v, t) for v, t in zip(own, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, *rest], ["_kind", "_pid", "_run", "_place", "_sha", "_edge", *names])


def content_sort(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: list[str] | None = None
) -> DataFrame:
    """Group equal texts and choose the row of each group that stays.

    keep: "smallest" or "largest" identifier.  carry: further columns of the input to return.
    Returns (doc_id, keep_id, group_size long, kept boolean, text_sha256 string, *carry), one row
    per input row.  Null text equals the empty text.  A null identifier stays only in a group that
    has no other.  Of repeated rows (same text, same identifier) exactly one has kept = true.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}, not smallest or largest")
    carry = list(carry or [])
    own = [docs[id_col].alias("_id"), *(docs[c].alias(f"_c{k}") for k, c in enumerate(carry))]
    names = ["_id", *(f"_c{k}" for k in range(len(carry)))]
    rows = docs.select(text_of(docs, text_col).alias("_text"), *own)
    rows = rows.withColumns({"_prefix": F.substring("_text", 1, PREFIX), "_hash": F.xxhash64("_text"), "_tail": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("_prefix", "_hash", "_id", "_tail").sortWithinPartitions("_prefix", "_hash", "_text", "_id").select("_text", *names)
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    found = stage(rows.mapInArrow(_runs(names), f"_kind int, _pid int, _run long, _place long, _sha binary, _edge string, {fields}"), "sorted")

    members = found.filter("_kind = 0").drop("_kind", "_edge")
    pick = F.min if keep == "smallest" else F.max
    known = F.col("_id").isNull() if keep == "smallest" else F.col("_id").isNotNull()  # a null never wins over an identifier
    best = F.struct(known.alias("known"), F.col("_id").alias("id"), F.col("_pid").alias("pid"), F.col("_place").alias("place"))
    runs = members.groupBy("_pid", "_run").agg(pick(best).alias("best"), F.count(F.lit(1)).alias("n"))
    borders = found.filter("_kind = 1").select("_pid", "_run", "_edge").join(runs, ["_pid", "_run"])
    whole = borders.groupBy("_edge").agg(pick("best").alias("best_all"), F.sum("n").alias("n_all"))
    joined = borders.select("_pid", "_run", "_edge").join(whole, "_edge").drop("_edge")
    runs = runs.join(joined, ["_pid", "_run"], "left").select(
        "_pid", "_run", F.coalesce("best_all", "best").alias("best"), F.coalesce("n_all", "n").alias("n")
    )
    return members.join(runs, ["_pid", "_run"]).select(
        F.col("_id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("_pid") == F.col("best.pid")) & (F.col("_place") == F.col("best.place"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        *(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)),
    )
