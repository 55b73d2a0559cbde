"""Iterations over a graph whose nodes fit into one vector: the links stay in packed blocks, only the vector travels.

Nodes are numbered by the sorted hashes of their ids. Links lie in blocks by their target, in the checkpoint folder, in
about four bytes each. A round is one pass over the blocks without any shuffle: each task reads the vector that the round
before left there, slice by slice, and writes its own slice; the driver gets sums only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import cut_lineage, ensure_checkpoint_dir

#: Links that are numbered at once, and targets of one block at most.
AT_ONCE, BLOCK_NODES = 1_000_000, 150_000
#: Tasks that count links; each writes one small number a node.
COUNTERS = 3
_CODEC = pa.Codec("zstd", compression_level=1)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by planes of bytes, compressed, after their count."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_CODEC.decompress(bytes(data[8:]), decompressed_size=4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int32)


def _pack_links(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted codes (target << 32 | source), the targets by their differences."""
    to = codes >> 32
    return _pack(np.diff(to, prepend=0)), _pack(codes & 0xFFFFFFFF)


def _unpack_links(to: bytes, source: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpack(to), dtype=np.int32), _unpack(source)


def _places(hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The number of each hash, -1 for unknown ones; asked in order, which keeps the search near."""
    order = np.argsort(asked)
    keys = asked[order]
    found = np.searchsorted(hashes, keys)
    found[found == len(hashes)] = 0
    out = np.empty(len(asked), np.int64)
    out[order] = np.where(hashes[found] == keys, found, -1)
    return out


class Folder:
    """Arrays by name in a folder that all executors share."""

    def __init__(self, uri: str):
        self.uri = uri

    def _at(self) -> tuple[fs.FileSystem, str]:
        scheme, colon, rest = self.uri.partition(":")
        return fs.FileSystem.from_uri(f"{scheme}:///{rest.lstrip('/')}" if colon and not rest.startswith("//") else self.uri)

    def put(self, name: str, array: np.ndarray) -> None:
        files, path = self._at()
        files.create_dir(f"{path}/{name.rpartition('/')[0]}")
        with files.open_output_stream(f"{path}/{name}") as out:
            out.write(pa.py_buffer(np.ascontiguousarray(array)))

    def get(self, name: str, kind: str, first: int = 0, end: int | None = None) -> np.ndarray:
        files, path = self._at()
        with files.open_input_file(f"{path}/{name}") as one:
            width = np.dtype(kind).itemsize
            one.seek(int(first) * width)
            return np.frombuffer(one.read_buffer() if end is None else one.read_buffer(int(end - first) * width), kind)

    def has(self, name: str) -> bool:
        files, path = self._at()
        return files.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound

    def drop(self, name: str) -> None:
        files, path = self._at()
        files.delete_dir(f"{path}/{name}")


class NodeVector:
    """The nodes of a graph by number, and vectors over them by slices. ``of`` gives None where two ids share a hash or the
    nodes are more than ``most``."""

    def __init__(self, ids: DataFrame, folder: Folder, ends: np.ndarray):
        self.ids, self.folder, self.ends, self.spark = ids, folder, ends, ids.sparkSession

    @classmethod
    def of(cls, nodes: DataFrame, n: int, most: int) -> NodeVector | None:
        """``n``: the rows of nodes."""
        if not 0 < n <= most:
            return None
        spark, ids = nodes.sparkSession, nodes.select("id")
        folder = Folder(f"{ensure_checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}")
        parts = max(spark.sparkContext.defaultParallelism, -(-n // BLOCK_NODES))

        def write(pdf: pd.DataFrame) -> pd.DataFrame:
            hashes, k = np.unique(pdf["h"].to_numpy()), int(pdf["k"].iloc[0])
            folder.put(f"hash/{k}", hashes)
            return pd.DataFrame({"k": [k], "n": [len(hashes)]})

        hashed = ids.select(F.xxhash64("id").alias("h"))
        # Slices are ranges of hashes, so that the slices one after the other are in order.
        sliced = hashed.select("h", F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * parts).cast("int"), F.lit(parts - 1)).alias("k"))
        sizes = np.zeros(parts, np.int64)
        for r in sliced.groupBy("k").applyInPandas(write, "k int, n long").collect():
            sizes[r.k] = r.n
        if sizes.sum() < n:  # repeated ids, or two of one hash
            ids = ids.distinct()
            if ids.count() > sizes.sum():
                return None
        return cls(ids, folder, np.concatenate([[0], np.cumsum(sizes)]))

    def __len__(self) -> int:
        return int(self.ends[-1])

    def reader(self):
        """A function that reads a whole vector, to be sent to tasks."""
        folder, ends = self.folder, self.ends

        def read(name: str, kind: str = "f8") -> np.ndarray:
            out = np.empty(ends[-1], kind)
            for k in np.flatnonzero(np.diff(ends)):
                out[ends[k] : ends[k + 1]] = folder.get(f"{name}/{k}", kind)
            return out

        return read

    def blocks(self, links: DataFrame, both: bool, once: bool) -> DataFrame:
        """``k, to, source``: links ``a, b`` of known nodes by the slice of b; both: either way; once: parallel ones count once."""
        read, ends, folder = self.reader(), self.ends, self.folder

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = read("hash", "i8")
            held: list[pa.RecordBatch] = []

            def emit() -> Iterator[pa.RecordBatch]:
                a, b = (_places(hashes, np.concatenate([x.column(k).to_numpy() for x in held])) for k in (0, 1))
                held.clear()
                real = (a >= 0) & (b >= 0)
                if not real.all():
                    folder.put("unknown/some", np.ones(1))
                a, b = a[real], b[real]
                codes = np.concatenate([b << 32 | a, a << 32 | b]) if both else b << 32 | a
                codes = np.unique(codes) if once else np.sort(codes)
                cuts = np.searchsorted(codes, ends << 32)
                rows = [(k, *_pack_links(codes[i:j] - (ends[k] << 32))) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["k", "to", "source"])

            for batch in batches:
                held.append(batch)
                if sum(x.num_rows for x in held) >= AT_ONCE:
                    yield from emit()
            if held:
                yield from emit()

        def gather(pdf: pd.DataFrame) -> pd.DataFrame:
            codes = np.concatenate([t.astype(np.int64) << 32 | s for t, s in (_unpack_links(*x) for x in zip(pdf["to"], pdf["source"]) if x[0] is not None)] or [np.zeros(0, np.int64)])
            to, source = _pack_links(np.unique(codes) if once else np.sort(codes))
            return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "to": [to], "source": [source]})

        pieces = links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).mapInArrow(number, "k int, to binary, source binary")
        slices = self.spark.createDataFrame([(int(k),) for k in np.flatnonzero(np.diff(ends))], "k int")
        pieces = pieces.unionByName(slices.select("k", F.lit(None).cast("binary").alias("to"), F.lit(None).cast("binary").alias("source")))
        return cut_lineage(pieces.groupBy("k").applyInPandas(gather, "k int, to binary, source binary"))

    def count_sources(self, blocks: DataFrame) -> list[int]:
        """Write how many links each node is the source of; the names of the parts to be summed."""
        n, folder = len(self), self.folder

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, part = np.zeros(n, np.int64), None
            for batch in batches:
                for k, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = k if part is None else part
                    total += np.bincount(_unpack(source.as_py()), minlength=n)
            if part is not None:
                folder.put(f"out/{part}", total.astype("u4"))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

        return [r.part for r in blocks.select("k", "source").coalesce(COUNTERS).mapInArrow(count, "part int").collect()]

    def put_weights(self, name: str, rows: DataFrame) -> float:
        """Write rows ``id, w`` as a vector, 0 for other nodes; unknown ids are left out. The sum of the weights."""
        folder, ends, parts = self.folder, self.ends, len(self.ends) - 1

        def write(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["k"].iloc[0])
            hashes, own = folder.get(f"hash/{k}", "i8"), pdf[pdf["h"].notna()]
            place = _places(hashes, own["h"].to_numpy(np.int64)) if len(own) else np.zeros(0, np.int64)
            out = np.bincount(place[place >= 0], own["w"].to_numpy(float)[place >= 0], len(hashes)).astype(float)
            folder.put(f"{name}/{k}", out)
            return pd.DataFrame({"total": [out.sum()]})

        place = F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * parts).cast("int"), F.lit(parts - 1))
        given = rows.where(F.col("w").isNotNull()).select(F.xxhash64("id").alias("h"), F.col("w").cast("double").alias("w")).select(place.alias("k"), F.col("h").cast("decimal(20,0)").alias("h"), "w")
        slices = self.spark.createDataFrame([(int(k), None, 0.0) for k in np.flatnonzero(np.diff(ends))], "k int, h decimal(20,0), w double")
        held = given.join(F.broadcast(slices.select("k")), "k", "left_semi").unionByName(slices)
        return float(sum(r.total for r in held.groupBy("k").applyInPandas(write, "total double").collect()))

    def named(self, vector: str, name: str, kind: str = "double") -> DataFrame:
        """``id`` and the node's number in the vector."""
        read = self.reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, values = read("hash", "i8"), read(vector, "f8" if kind == "double" else "i8")
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values[_places(hashes, batch.column(1).to_numpy())])], ["id", name])

        return self.ids.select("id", F.xxhash64("id").alias("h")).mapInArrow(run, f"id string, {name} {kind}")


def ranks(graph: NodeVector, links: DataFrame, restart: DataFrame | None, damping: float, rounds: int, epsilon: float) -> DataFrame:
    """``id, rank``: links one way and once without a restart, else either way and parallel ones counted."""
    n, folder, ends, read = len(graph), graph.folder, graph.ends, graph.reader()
    total = n if restart is None else graph.put_weights("start", restart)
    if total <= 0:
        return graph.ids.limit(0).select("id", F.lit(0.0).alias("rank"))
    personal = restart is not None
    blocks = graph.blocks(links, both=personal, once=not personal)
    counted = graph.count_sources(blocks)

    def step(k_now: int, lost: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            share = None
            for batch in batches:
                for k, to, source in zip(*(x.to_pylist() for x in batch.columns)):
                    i, j = ends[k], ends[k + 1]
                    out = sum(folder.get(f"out/{p}", "u4", i, j).astype(np.int64) for p in counted)
                    start = folder.get(f"start/{k}", "f8") / total if personal else np.full(j - i, 1.0 / n)
                    if k_now:
                        share = read(f"share{k_now - 1}") if share is None else share
                        to, source = _unpack_links(to, source)
                        flow = np.bincount(to, share[source], j - i)
                        new = (1 - damping) * start + damping * (flow + lost * start)
                        moved = np.abs(new - folder.get(f"rank{k_now - 1}/{k}", "f8")).sum()
                    else:
                        new, moved = start, np.inf
                    folder.put(f"rank{k_now}/{k}", new)
                    folder.put(f"share{k_now}/{k}", np.divide(new, out, out=np.zeros(j - i), where=out > 0))
                    yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (new[out == 0].sum(), moved)], ["lost", "moved"])

        return run

    lost = 0.0
    for k in range(rounds + 1):
        sums = blocks.mapInArrow(step(k, lost), "lost double, moved double").collect()
        if k:
            folder.drop(f"rank{k - 1}")
            folder.drop(f"share{k - 1}")
        lost = sum(r.lost for r in sums)
        if sum(r.moved for r in sums) < epsilon:
            break
    folder.drop(f"share{k}")
    return graph.named(f"rank{k}", "rank")


def components(graph: NodeVector, links: DataFrame, max_rounds: int = 50) -> DataFrame | None:
    """``id, component``: nodes that links join, either way, have the same number. None where a link has an unknown end,
    over which nodes may be joined as well.

    Each round a node takes the least number that a neighbour's forerunner has and hands it to its own forerunner, and
    forerunners are followed once: the number of rounds grows with the logarithm of the graph's size. What is handed on
    goes through files, each in order of its receivers, of which a slice's task reads its own stretches.
    """
    folder, ends, read = graph.folder, graph.ends, graph.reader()
    blocks = graph.blocks(links, both=True, once=True)
    if folder.has("unknown"):
        return None
    slices = blocks.select("k")

    def each(job):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*(x.to_pylist() for x in batch.columns)):
                    yield pa.RecordBatch.from_arrays([pa.array([int(job(*row))], pa.int64())], ["moved"])

        return run

    def begin(k: int) -> int:
        folder.put(f"old0/{k}", np.arange(ends[k], ends[k + 1]))
        return 0

    def meet(now: int):
        kept: dict[str, np.ndarray] = {}  # the vector, read once a task

        def job(k: int, to: bytes, source: bytes) -> int:
            if "old" not in kept:
                kept["old"] = read(f"old{now}", "i8")
            old, (to, source) = kept["old"], _unpack_links(to, source)
            own = old[ends[k] : ends[k + 1]].copy()
            first = np.flatnonzero(np.diff(to, prepend=-1))
            least = own.copy()
            if len(first):
                least[to[first]] = np.minimum(own[to[first]], np.minimum.reduceat(old[source], first))
            less = np.flatnonzero(least < own)
            order = np.lexsort((least[less], own[less]))
            root, value = own[less][order], least[less][order]
            once = np.flatnonzero(np.diff(root, prepend=-1))
            root, value = root[once], value[once]
            folder.put(f"new{now}/{k}", least)
            folder.put(f"hand{now}/{k}", np.concatenate([np.searchsorted(root, ends), root, value]))
            return len(root)

        return job

    def take(now: int, giving: list[int]):
        def job(k: int) -> int:
            new = folder.get(f"new{now}/{k}", "i8").copy()
            for g in giving:
                at = folder.get(f"hand{now}/{g}", "i8", 0, len(ends))
                i, j, n = int(at[k]), int(at[k + 1]), int(at[-1])
                if i < j:
                    root = folder.get(f"hand{now}/{g}", "i8", len(ends) + i, len(ends) + j) - ends[k]
                    value = folder.get(f"hand{now}/{g}", "i8", len(ends) + n + i, len(ends) + n + j)
                    new[root] = np.minimum(new[root], value)
            folder.put(f"taken{now}/{k}", new)
            return 0

        return job

    def follow(now: int):
        kept: dict[str, np.ndarray] = {}

        def job(k: int) -> int:
            if "taken" not in kept:
                kept["taken"] = read(f"taken{now}", "i8")
            new = kept["taken"][folder.get(f"taken{now}/{k}", "i8")]
            folder.put(f"old{now + 1}/{k}", new)
            return (new != folder.get(f"old{now}/{k}", "i8")).sum()

        return job

    run = lambda df, job: sum(r.moved for r in df.mapInArrow(each(job), "moved long").collect())
    run(slices, begin)
    giving = np.flatnonzero(np.diff(ends)).tolist()
    for now in range(max_rounds):
        run(blocks, meet(now))
        run(slices, take(now, giving))
        moved = run(slices, follow(now))
        for name in ("old", "new", "hand", "taken"):
            folder.drop(f"{name}{now}")
        if not moved:
            return graph.named(f"old{now + 1}", "component", "long")
    raise RuntimeError(f"components are not done after {max_rounds} rounds")
