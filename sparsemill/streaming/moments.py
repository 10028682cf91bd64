"""Running means and variances of each key's cells over a stream, in keyed state.

The state has the number, mean and sum of squared deviations of each key's cells, and each cell's value, so that a part of a
cell that comes late replaces what the cell was. Keys are dealt over a fixed number of groups, and a group's state lies in
blocks of a bounded number of rows, dealt by hash, as many as it needs: a batch reads and writes the blocks that it touches,
each at once, whatever the number of cells in it. Rows travel to their group in packs, and parts of a cell in one pack are
one row.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys, part of the state's layout: the same as long as a checkpoint lives. Rows of a block, on average at most;
#: rows that a task gathers before it packs them, and that a group takes in at once.
GROUPS, BLOCK_ROWS, PACKED_ROWS = 1024, 8192, 1 << 19


def merged(a: tuple, b: tuple) -> tuple:
    """Number, mean and sum of squared deviations of two sets together; arrays of them for many pairs of sets."""
    import numpy as np

    n = a[0] + b[0]
    gap, some = b[1] - a[1], np.maximum(n, 1)
    return n, a[1] + gap * (b[0] / some), a[2] + b[2] + gap * gap * (a[0] * (b[0] / some))


def replaced(a: tuple, old, new, at=None) -> tuple:
    """The same after values have become others. at: with arrays of many sets, the set that each value is in."""
    import numpy as np

    n, mean, dev = a
    add = (lambda x: x) if at is None else (lambda x: np.bincount(at, x, len(n)))
    was = mean if at is None else mean[at]
    shift = add(new - old) / np.maximum(n, 1)
    return n, mean + shift, np.maximum(dev + add((new - old) * ((new - was) + (old - was))) - n * shift * shift, 0.0)


def of_values(x, at=None, sets: int = 0) -> tuple:
    """Of values, or with at, the set that each is in, of `sets` sets."""
    import numpy as np

    if at is None:
        mean = float(x.mean()) if len(x) else 0.0
        return len(x), mean, float(((x - mean) ** 2).sum())
    n = np.bincount(at, minlength=sets)
    mean = np.bincount(at, x, sets) / np.maximum(n, 1)
    mean = mean + np.bincount(at, x - mean[at], sets) / np.maximum(n, 1)
    return n, mean, np.bincount(at, (x - mean[at]) ** 2, sets)


def _packed(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(packs: list):
    import pyarrow as pa

    return pa.concat_tables([pa.ipc.open_stream(bytes(p)).read_all() for p in packs]).combine_chunks()


def _pieces(table, of):
    """(number, rows) of table by of, an array of whole numbers."""
    import numpy as np

    order = np.argsort(of, kind="stable")
    table, of = table.take(order), of[order]
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield int(of[lo]), table.slice(lo, hi - lo)


def _summed(table):
    """Parts of one cell as one row."""
    out = table.select(["key", "hash", "cell", "value"]).group_by(["key", "hash", "cell"], use_threads=False).aggregate([("value", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select(["key", "hash", "cell", "value"])


class Moments(StatefulProcessor):
    """Packs of rows (key, hash, cell, value) of a group of keys to (key, version, n, mean, var)."""

    def __init__(self, name: str):
        self.name = name

    def init(self, handle) -> None:
        self.sizes = handle.getValueState("sizes", "cells long, cell_bits int, keys long, key_bits int")
        self.cells = handle.getMapState("cells", "block int", "rows binary")
        self.keys = handle.getMapState("keys", "block int", "rows binary")

    @staticmethod
    def _spread(table, bits: int):
        """The block of each row: of cells by key and cell, so that one key's lie in many; of keys by key."""
        import numpy as np

        at = table.column("hash").to_numpy().astype("u8")
        if "cell" in table.column_names:
            at = at ^ (table.column("cell").to_numpy().astype("u8") * np.uint64(0x9E3779B97F4A7C15))
        at = (at ^ (at >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (at >> np.uint64(33)).astype("i8") & ((1 << bits) - 1)

    def _read(self, state, blocks) -> list:
        found = (state.getValue((int(b),)) for b in blocks)
        return [f[0] for f in found if f is not None]

    def _write(self, state, table, rest, rows: int, bits: int) -> int:
        """Write a table's blocks; where the rows of all blocks have become too many, first take in those of the others."""
        more = bits
        while rows > BLOCK_ROWS << more:
            more += 1
        if more > bits:
            others = self._read(state, rest)
            table = _table([_packed(table), *others]) if others else table
        for block, piece in _pieces(table, self._spread(table, more)):
            state.updateValue((block,), (_packed(piece),))
        return more

    def _take_in(self, new, seen):
        """Bring rows into the state; the moments of their keys. seen: keys whose version this batch has raised."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n_cells, cell_bits, n_keys, key_bits = self.sizes.get() if self.sizes.exists() else (0, 0, 0, 0)
        new = _summed(new)
        touched = np.unique(self._spread(new, cell_bits))
        old = self._read(self.cells, touched)
        old = _table(old) if old else new.slice(0, 0)
        flagged = [t.append_column("was", pc.multiply(t.column("value"), float(k))).append_column("old", pa.array(np.full(len(t), k))).append_column("new", pa.array(np.full(len(t), 1 - k))) for t, k in ((old, 1), (new, 0))]
        both = pa.concat_tables(flagged).group_by(["key", "hash", "cell"], use_threads=False).aggregate([("value", "sum"), ("was", "sum"), ("old", "sum"), ("new", "sum")])
        rows = both.select(["key", "hash", "cell", "value_sum"]).rename_columns(["key", "hash", "cell", "value"])
        n_cells += len(rows) - len(old)
        cell_bits = self._write(self.cells, rows, np.setdiff1d(np.arange(1 << cell_bits), touched), n_cells, cell_bits)

        changed = both.filter(pc.greater(both.column("new_sum"), 0))
        keys = changed.select(["key", "hash"]).group_by(["key", "hash"], use_threads=False).aggregate([]).select(["key", "hash"])
        touched = np.unique(self._spread(keys, key_bits))
        known = self._read(self.keys, touched)
        zero = np.zeros(len(keys))
        fresh = keys.append_column("version", pa.array(zero.astype("i8"))).append_column("n", pa.array(zero.astype("i8"))).append_column("mean", pa.array(zero)).append_column("dev", pa.array(zero))
        known = _table(known) if known else fresh.slice(0, 0)
        added = fresh.filter(pc.invert(pc.is_in(fresh.column("key"), value_set=known.column("key").combine_chunks())))
        known = pa.concat_tables([known, added]).combine_chunks()
        n_keys += len(added)
        whose = known.column("key").combine_chunks() if known.num_rows else known.column("key")
        at = pc.index_in(changed.column("key"), value_set=whose).to_numpy()
        value, was, late = changed.column("value_sum").to_numpy(), changed.column("was_sum").to_numpy(), changed.column("old_sum").to_numpy() > 0
        now = tuple(known.column(c).to_numpy() for c in ("n", "mean", "dev"))
        now = replaced(now, was[late], value[late], at[late])
        n, mean, dev = merged(now, of_values(value[~late], at[~late], len(known)))
        mine = np.zeros(len(known), bool)
        mine[at] = True
        raised = mine if seen is None else mine & ~pc.is_in(known.column("key"), value_set=seen).to_numpy(zero_copy_only=False)
        version = known.column("version").to_numpy() + raised
        known = pa.table({"key": known.column("key"), "hash": known.column("hash"), "version": version, "n": n, "mean": mean, "dev": dev})
        key_bits = self._write(self.keys, known, np.setdiff1d(np.arange(1 << key_bits), touched), n_keys, key_bits)
        self.sizes.update((int(n_cells), int(cell_bits), int(n_keys), int(key_bits)))
        return known.filter(pa.array(mine))

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        def portions():
            packs, n = [], 0
            for pdf in rows:
                for pack, some in zip(pdf["pack"], pdf["rows"]):
                    packs, n = [*packs, pack], n + some
                    if n >= PACKED_ROWS:
                        yield _table(packs)
                        packs, n = [], 0
            if packs:
                yield _table(packs)

        done = None
        for new in portions():
            got = self._take_in(new, None if done is None else done.column("key").combine_chunks())
            if done is not None:
                got = pa.concat_tables([done.filter(pc.invert(pc.is_in(done.column("key"), value_set=got.column("key").combine_chunks()))), got])
            done = got
        n, dev = done.column("n").to_numpy(), done.column("dev").to_numpy()
        var = np.where(n > 1, dev / np.maximum(n - 1, 1), np.nan)
        out = pd.DataFrame({self.name: done.column("key").to_pandas().to_numpy(), "version": done.column("version").to_numpy(), "n": n, "mean": done.column("mean").to_numpy(), "var": var})
        yield out

    def close(self) -> None:
        pass


def streaming_moments(cells: DataFrame, key: str = "row_id", cell: str = "col_id", value: str = "value") -> DataFrame:
    """A stream of cells(key, cell, value) to (key, version, n, mean, var): after each batch a row for each key that it
    touched, with the number, mean and sample variance (null for one) of the key's cells so far; a later version replaces an
    earlier one. Rows with a null key, cell or value do not count. Write it with output mode append or update, in a session
    whose state store is RocksDB (see state_store)."""
    kind = cells.schema[key].dataType.simpleString()

    def pack(batches):
        import pyarrow as pa

        def packs(held):
            table = pa.Table.from_batches(held)
            table = pa.table({c: table.column(c) for c in table.column_names})  # all columns may be null, as those made later
            of = table.column("hash").to_numpy() % GROUPS
            for group, piece in _pieces(table, of):
                piece = _summed(piece)
                yield pa.RecordBatch.from_pydict({"group": [group], "pack": [_packed(piece)], "rows": [len(piece)]})

        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= PACKED_ROWS:
                yield from packs(held)
                held, n = [], 0
        if n:
            yield from packs(held)

    given = cells.select(F.col(key).alias("key"), F.xxhash64(key).alias("hash"), F.col(cell).cast("long").alias("cell"), F.col(value).cast("double").alias("value"))
    given = given.where(F.col("key").isNotNull() & F.col("cell").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    parts = given.mapInArrow(pack, "group long, pack binary, rows long")
    return parts.groupBy("group").transformWithStateInPandas(statefulProcessor=Moments(key), outputStructType=f"{key} {kind}, version long, n long, mean double, var double", outputMode="append", timeMode="None")


@contextlib.contextmanager
def state_store(spark):
    """A session whose streams keep their state in RocksDB; what was set before comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def latest(versions: DataFrame, key: str = "row_id") -> DataFrame:
    """Of each key the last version."""
    return versions.groupBy(key).agg(F.max_by(F.struct("n", "mean", "var"), "version").alias("_m")).select(key, "_m.n", "_m.mean", "_m.var")
