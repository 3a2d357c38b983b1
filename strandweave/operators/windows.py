"""Windows of loops beside the pixels, in tiles: loops and pixels are shuffled once each, and no single hit leaves its task.

A tile has the distinct loops whose midpoint is in it, and all pixels that their windows reach, as one dense image a layer.
Its memory is bounded by its extent and by the distinct loops there. Rows of one pixel count together, so contacts needn't
be summed before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandweave.functions import scalars as x
from strandweave.functions.scalars import COORDS

#: Tiles stand first, as rows are sorted by the key and names of chromosomes differ late.
KEY = ["_tx", "_ty", "chr1", "chr2"]
#: Windows that a kernel holds at once.
CHUNK = 2048
#: Rows that a task packs at once.
PACK = 1 << 20

Kernel = Callable[[pa.Table, dict[int, np.ndarray], dict[int, np.ndarray], dict[int, np.ndarray]], pa.Table]


def loops_in_tiles(loops: DataFrame, identity: Sequence[str], tile: int) -> DataFrame:
    """Distinct loops in the tiles of their midpoints, with ``_x, _y``, their places there. Coordinates are shuffled as widths and distances from the tile, and the distinct is done in the tile."""
    own = loops.select(*identity).dropna(subset=COORDS)
    for s, a in ((1, "x"), (2, "y")):
        start, end = F.col(f"start{s}").cast("bigint"), F.col(f"end{s}").cast("bigint")
        own = own.withColumn(f"_t{a}", F.floor(x.mid(start, end) / tile))
        own = own.withColumns({f"_s{s}": start - F.col(f"_t{a}") * tile, f"_w{s}": end - start})
    rest = [c for c in identity if c not in COORDS]
    own = own.select(*KEY, *rest, "_s1", "_w1", "_s2", "_w2").repartition(*KEY).distinct()
    types = dict(loops.dtypes)
    for s, a in ((1, "x"), (2, "y")):
        start = F.col(f"_s{s}") + F.col(f"_t{a}") * tile
        own = own.withColumns({f"start{s}": start.cast(types[f"start{s}"]), f"end{s}": (start + F.col(f"_w{s}")).cast(types[f"end{s}"])})
        own = own.withColumn(f"_{a}", (x.mid(start, start + F.col(f"_w{s}")) - F.col(f"_t{a}") * tile).cast("int"))
    return own.drop("_s1", "_w1", "_s2", "_w2")


def pixels_in_tiles(layers: Sequence[tuple[DataFrame, int]], window: int, tile: int, pack: bool = False) -> DataFrame:
    """``_layer, _cell, counts`` of positive pixels in all tiles whose windows reach them, packed if wanted. A layer is its contacts and their resolution."""
    parts = []
    for i, (contacts, resolution) in enumerate(layers):
        n = tile // resolution
        side = n + 2 * window
        reach = lambda b: F.sequence(F.floor((F.col(b) - window) / n), F.floor((F.col(b) + window) / n))  # noqa: B023, E731
        d = contacts.filter((F.col("resolution") == resolution) & (F.col("counts") > 0)).select("chr1", "chr2", "bin_x", "bin_y", "counts")
        d = d.withColumn("_tx", F.explode(reach("bin_x"))).withColumn("_ty", F.explode(reach("bin_y")))
        cell = (F.col("bin_x") - F.col("_tx") * n + window) * side + F.col("bin_y") - F.col("_ty") * n + window
        parts.append(d.select(*KEY, F.lit(i).alias("_layer"), cell.cast("int").alias("_cell"), "counts"))
    d = reduce(DataFrame.unionByName, parts)
    return _packed(d.select(*KEY, "_layer", F.col("_cell").cast("bigint").alias("_cell"), F.col("counts").cast("double").alias("counts")), "_layer") if pack else d.repartition(*KEY)


def _packed(rows: DataFrame, *rest: str) -> DataFrame:
    """Rows by tile and ``rest`` with all other columns, of 8 bytes each, in one ``_rows``: a task packs what it has of a tile, so that keys
    are shuffled once for many rows. Bytes of equal rank stand together, as those of high rank differ little."""
    key = [*KEY, *rest]
    values = [c for c in rows.columns if c not in key]

    def emit(held: pa.Table) -> Iterator[pa.RecordBatch]:
        held = held.combine_chunks()
        codes = [held[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype("int64") if pa.types.is_string(held.schema.field(c).type) else held[c].to_numpy().astype("int64") for c in key]
        order = np.zeros(held.num_rows, "int64")
        for c in codes:
            order = order * (1 << 12 if c.max() < 1 << 12 else 1 << 21) + c  # keys that meet here only part runs
        order = np.argsort(order, kind="stable")
        codes = [c[order] for c in codes]
        first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], 0)]))
        data = np.stack([held[c].to_numpy().view("int64") for c in values], 1)[order].view("uint8")
        blobs = [data[a:b].T.tobytes() for a, b in zip(first, [*first[1:], len(order)])]
        yield from held.select(key).take(pa.array(order[first])).append_column("_rows", pa.array(blobs, pa.binary())).to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACK:
                yield from emit(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from emit(pa.Table.from_batches(held))

    types = dict(rows.dtypes)
    return rows.mapInArrow(pack, ", ".join(f"{c} {types[c]}" for c in key) + ", _rows binary").repartition(*KEY)


def _unpacked(blobs: pa.ChunkedArray, columns: int) -> np.ndarray:
    """The rows of ``_packed`` as integers, a column each."""
    parts = [np.frombuffer(b.as_py(), "uint8").reshape(8 * columns, -1).T for b in blobs]
    return np.ascontiguousarray(np.concatenate([np.empty((0, 8 * columns), "uint8"), *parts])).view("int64")


def _layers(near: pa.Table, sizes: Sequence[int]) -> dict[int, np.ndarray]:
    """Packed pixels as images of these sides."""
    layer, images = near["_layer"].to_numpy(), {}
    for i, side in enumerate(sizes):
        own = _unpacked(near["_rows"].filter(pa.array(layer == i)), 2)
        images[i] = np.bincount(own[:, 0], np.ascontiguousarray(own[:, 1]).view("float64"), side * side).reshape(side, side)
    return images


def in_packed_tiles(loops: DataFrame, layers: Sequence[tuple[DataFrame, int]], window: int, kernel: Kernel, schema: str, tile: int) -> DataFrame:
    """``in_tiles`` of loops that have nothing but coordinates, where rows are packed for the shuffle and loops made distinct in the tile."""
    if any(tile % r for _, r in layers):
        raise ValueError("a tile has whole bins of every resolution")
    own, types, steps = loops.select(*COORDS).dropna(), dict(loops.dtypes), [r for _, r in layers]
    for s, a in ((1, "x"), (2, "y")):
        start, end = F.col(f"start{s}").cast("bigint"), F.col(f"end{s}").cast("bigint")
        own = own.withColumn(f"_t{a}", F.floor(x.mid(start, end) / tile)).withColumns({f"_s{s}": start - F.col(f"_t{a}") * tile, f"_w{s}": end - start})

    def run(held: pa.Table, near: pa.Table) -> pa.Table:
        if not held.num_rows:
            return empty
        v = _unpacked(held["_rows"], 4)
        v = v[np.lexsort(v.T[::-1])]
        v = v[np.concatenate([[True], (v[1:] != v[:-1]).any(1)])]
        cols = {}
        at = []
        for s, t in ((1, "_tx"), (2, "_ty")):
            start = v[:, 2 * s - 2] + held[t][0].as_py() * tile
            cols |= {f"chr{s}": pa.array([held[f"chr{s}"][0].as_py()] * len(v), pa.string()), f"start{s}": pa.array(start), f"end{s}": pa.array(start + v[:, 2 * s - 1]), t: pa.array([held[t][0].as_py()] * len(v), pa.int64())}
            middle = 2 * start + v[:, 2 * s - 1]
            at.append(np.where(middle < 0, -(-middle // 2), middle // 2) - held[t][0].as_py() * tile)
        images = _layers(near, [tile // r + 2 * window for r in steps])
        at_x, at_y = ({i: a // r for i, r in enumerate(steps)} for a in at)
        return kernel(pa.table(cols), at_x, at_y, images).select(names).cast(arrow)

    kind = StructType.fromDDL(schema)
    arrow, names = to_arrow_schema(kind), kind.names
    empty = arrow.empty_table()
    held = _packed(own.select(*KEY, "_s1", "_w1", "_s2", "_w2"))
    return held.groupBy(*KEY).cogroup(pixels_in_tiles(layers, window, tile, pack=True).groupBy(*KEY)).applyInArrow(run, schema)


def over_pixels(layers: Sequence[tuple[DataFrame, int]], kernel: Callable[[str, str, int, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str, tile: int) -> DataFrame:
    """What ``kernel`` gives for the pixels of each layer in each tile, a pixel being in one: from both chromosomes, the layer, bins and values."""
    steps = [r for _, r in layers]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(near: pa.Table) -> pa.Table:
        out = [arrow.empty_table()]
        for i, image in _layers(near, [tile // r for r in steps]).items():
            px, py = np.nonzero(image)
            n = tile // steps[i]
            out.append(kernel(near["chr1"][0].as_py(), near["chr2"][0].as_py(), i, px + near["_tx"][0].as_py() * n, py + near["_ty"][0].as_py() * n, image[px, py]).cast(arrow))
        return pa.concat_tables(out)

    return pixels_in_tiles(layers, 0, tile, pack=True).groupBy(*KEY).applyInArrow(run, schema)


def in_tiles(loops: DataFrame, layers: Sequence[tuple[DataFrame, int]], window: int, identity: Sequence[str], kernel: Kernel, schema: str, tile: int, pixels: DataFrame | None = None) -> DataFrame:
    """What ``kernel`` gives for each tile with loops: from the loops, the first rows and columns of their windows by layer, and the images."""
    if any(tile % r for _, r in layers):
        raise ValueError("a tile has whole bins of every resolution")
    sizes = [tile // r for _, r in layers]
    steps = [r for _, r in layers]

    def run(own: pa.Table, near: pa.Table) -> pa.Table:
        if not own.num_rows:
            return empty
        layer, cell, v = (near[c].to_numpy() for c in ("_layer", "_cell", "counts"))
        images, at_x, at_y = {}, {}, {}
        px, py = own["_x"].to_numpy(), own["_y"].to_numpy()
        for i, n in enumerate(sizes):
            side, mine = n + 2 * window, layer == i
            images[i] = np.bincount(cell[mine], v[mine], side * side).reshape(side, side)
            at_x[i], at_y[i] = px // steps[i], py // steps[i]
        return kernel(own, at_x, at_y, images).select(names).cast(arrow)

    kind = StructType.fromDDL(schema)
    arrow, names = to_arrow_schema(kind), kind.names
    empty = arrow.empty_table()
    near = pixels_in_tiles(layers, window, tile) if pixels is None else pixels
    return loops_in_tiles(loops, identity, tile).groupBy(*KEY).cogroup(near.groupBy(*KEY)).applyInArrow(run, schema)


def stacks(image: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, window: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Windows as one array for some loops after the other."""
    span = 2 * window + 1
    every = np.lib.stride_tricks.sliding_window_view(image, (span, span))
    for i in range(0, len(at_x), CHUNK):
        part = slice(i, i + CHUNK)
        yield part, every[at_x[part], at_y[part]]


def box_sums(image: np.ndarray, span: int) -> np.ndarray:
    """Sums over all boxes of ``span`` rows and columns, by their first."""
    s = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    s[1:, 1:] = image.cumsum(0).cumsum(1)
    return s[span:, span:] - s[:-span, span:] - s[span:, :-span] + s[:-span, :-span]
