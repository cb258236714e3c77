"""Hard negatives by branch and bound over ball trees.

Rows are sorted by label and cut into chunks; a chunk becomes one ball tree, stored as
one row. Anchors are cut into blocks; a block meets every tree as a matrix of queries
that goes down the tree together. With a node's center c and radius r the inner product
of an anchor q lies in q.c - |q|r to q.c + |q|r; a query leaves a node whose labels cannot
serve it, whose bounds lie outside its score window, or whose upper bound is strictly
beneath its current k-th score. A task keeps a block's best k over all trees that it sees,
so what is merged is tasks times k, not rows.

Two searches: the nearest positives of each anchor, then for each anchor and positive the
best rows of other labels whose score lies in the window. Scores are integers, exact to
2^53.

Cases: rows with a null label or id, a null or empty vector, or null or non-finite
components take no part; rows that repeat an id count as one, that of the smallest label
and vector; vectors of other lengths than the anchor's do not serve it; ties go to the
smaller id; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import durable, map_arrow, quoted, scratch

POSITIVES, NEGATIVES = 5, 3
#: Fixed values of the window: 50 to 95 hundredths of the positive's score.
LOW, HIGH = 50, 95
CHUNK, BLOCK, LEAF = 4096, 2048, 128
#: Blocks whose best rows a task holds at once.
HELD_BLOCKS = 8
NONE = -np.inf


@dataclass
class Tree:
    """Rows in the order of the leaves, and nodes in preorder: a node's rows are
    ``start`` to ``stop``, its left child comes next, its right child is ``right``."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    spans: np.ndarray  # start, stop, right (0 in a leaf)


def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
    """A ball tree: labels part first, then rows by their place between two far rows."""
    order = np.arange(len(ids))
    centers, radii, spans = [], [], []

    def node(start: int, stop: int) -> None:
        rows = order[start:stop]
        own = x[rows]
        center = own.mean(axis=0)
        away = np.sqrt(((own - center) ** 2).sum(axis=1))
        at = len(spans)
        centers.append(center)
        radii.append(away.max())
        spans.append([start, stop, 0])
        one = labels[rows].min() == labels[rows].max()
        if stop - start <= leaf or one and radii[at] == 0:
            return
        if one:
            a = own[away.argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            place = own @ (b - a)
            cut = (stop - start) // 2
        else:
            place = labels[rows]
            known = np.unique(place)
            cut = int((place < known[len(known) // 2]).sum())
        order[start:stop] = rows[np.argsort(place, kind="stable")]
        node(start, start + cut)
        spans[at][2] = len(spans)
        node(start + cut, stop)

    node(0, len(ids))
    for (start, stop, right) in spans:
        if not right:
            order[start:stop] = order[start:stop][np.argsort(ids[order[start:stop]], kind="stable")]
    return Tree(ids[order], labels[order], x[order], np.array(centers), np.array(radii), np.array(spans, np.int64))


class Best:
    """The k best rows (score, id) of each query and window of a block."""

    def __init__(self, queries: int, windows: int, k: int) -> None:
        self.scores = np.full((queries, windows, k), NONE)
        self.ids = np.zeros((queries, windows, k), np.int64)

    def add(self, at: np.ndarray, window: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows of ``scores`` belong to queries ``at``; what does not count is ``NONE``."""
        k = self.scores.shape[2]
        if scores.shape[1] > k:  # columns are in the order of ids, so a stable sort keeps ties right
            first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            scores, ids = np.take_along_axis(scores, first, axis=1), ids[first]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        both = np.concatenate([self.scores[at, window], scores], axis=1)
        names = np.concatenate([self.ids[at, window], ids], axis=1)
        first = np.lexsort((names, -both), axis=1)[:, :k]
        self.scores[at, window] = np.take_along_axis(both, first, axis=1)
        self.ids[at, window] = np.take_along_axis(names, first, axis=1)


def search(tree: Tree, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, best: Best) -> int:
    """Add to ``best`` the tree's rows that serve the queries: of the same label or of
    another, not the query's own row, with a score in a window (a column of ``low`` and
    ``high``). How many scores were computed."""
    lengths = np.sqrt((q * q).sum(axis=1))
    work = 0
    open_nodes = [(0, np.arange(len(ids)))]
    while open_nodes:
        at, active = open_nodes.pop()
        start, stop, right = tree.spans[at]
        held = tree.labels[start:stop]
        if held.min() == held.max():  # one label throughout
            active = active[(labels[active] == held[0]) == same]
        if not len(active):
            continue
        middle = q[active] @ tree.center[at]
        reach = lengths[active] * tree.radius[at]
        reach += 1e-9 * (np.abs(middle) + reach + 1)  # rounding never prunes
        top, bottom = (middle + reach)[:, None], (middle - reach)[:, None]
        fits = (bottom <= high[active]) & (top >= low[active]) & (top >= best.scores[active, :, -1])
        active = active[fits.any(axis=1)]
        if not len(active):
            continue
        if right:
            children = [at + 1, int(right)]
            hopes = [(q[active] @ tree.center[c]).sum() for c in children]
            if hopes[0] > hopes[1]:  # the more promising child is taken first, from the end
                children.reverse()
            open_nodes.extend((c, active) for c in children)
            continue
        scores = np.rint(q[active] @ tree.x[start:stop].T)
        work += scores.size
        serves = ((labels[active][:, None] == held[None, :]) == same) & (ids[active][:, None] != tree.ids[None, start:stop])
        for w in range(low.shape[1]):
            counts = serves & (scores >= low[active, w, None]) & (scores <= high[active, w, None]) & (scores >= best.scores[active, w, -1][:, None])
            rows = np.flatnonzero(counts.any(axis=1))
            if len(rows):
                best.add(active[rows], w, np.where(counts[rows], scores[rows], NONE), tree.ids[start:stop])
    return work


def _packed(x: np.ndarray, kind: type = np.float64) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """id, label, v (whole numbers, as doubles) of the rows that take part, one an id."""
    vector = quoted(vector_col).cast("array<double>")
    whole = lambda x: F.when(F.abs(x) < 2**52, F.floor(x).cast("double")).otherwise(x)
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all
    rows = vectors.where(quoted(id_col).isNotNull() & label.isNotNull() & (F.size(vector) > 0) & good)
    rows = rows.select(quoted(id_col).cast("long").alias("id"), label.alias("label"), F.transform(vector, lambda x: whole(x * scale)).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("one")).select("id", "one.*")


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, label codes and vectors of up to ``most`` rows of one length."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        ids, codes, column = np.array(batch.column("id")), np.array(batch.column("code")), batch.column("v")
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = flat[(offsets[at][:, None] + np.arange(size)).ravel()].reshape(len(at), size)
            parts = held.setdefault(size, [])
            parts.append((ids[at], codes[at], x))
            while sum(len(p[0]) for p in parts) >= most:
                whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield tuple(c[:most] for c in whole)
                parts[:] = [tuple(c[most:] for c in whole)]
    for parts in held.values():
        whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
        if len(whole[0]):
            yield tuple(whole)


_TREE = {"ids": np.int64, "labels": np.int64, "x": np.float64, "center": np.float64, "radius": np.float64, "spans": np.int64}


def trees(rows: DataFrame, chunk: int = CHUNK, leaf: int = LEAF) -> DataFrame:
    """One ball tree a chunk: size and packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, chunk):
            tree = build(*piece, leaf)
            yield pa.RecordBatch.from_pylist([{"size": tree.x.shape[1]} | {k: _packed(getattr(tree, k), d) for k, d in _TREE.items()}], pa.schema([("size", pa.int64()), *((k, pa.binary()) for k in _TREE)]))

    dealt = rows.repartitionByRange(F.col("code"), F.xxhash64("id")).sortWithinPartitions("code")
    return map_arrow(dealt.select("id", "code", "v"), run, "size long, " + ", ".join(f"{k} binary" for k in _TREE))


def _blocks(queries: DataFrame, windows: int, block: int) -> DataFrame:
    """One row a block of queries (id, code, v, low, high: arrays of ``windows`` doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == size))
                for start in range(0, len(at), block):
                    own = batch.take(at[start : start + block])
                    flat = lambda c: own.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    row = {"asked": size, "name": int(own.column("id")[0].as_py()), "q_ids": _packed(own.column("id"), np.int64), "q_labels": _packed(own.column("code"), np.int64)}
                    row |= {"q": _packed(flat("v")), "low": _packed(flat("low")), "high": _packed(flat("high"))}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("asked", pa.int64()), ("name", pa.int64()), *((k, pa.binary()) for k in ("q_ids", "q_labels", "q", "low", "high"))]))

    return map_arrow(queries.select("id", "code", "v", "low", "high"), run, "asked long, name long, q_ids binary, q_labels binary, q binary, low binary, high binary")


def searched(index: DataFrame, blocks: DataFrame, windows: int, k: int, same: bool) -> DataFrame:
    """anchor, slot (window, from 0), id, score: what tasks keep of each query. Merge by ``top``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, tuple[np.ndarray, Best]] = OrderedDict()

        def out(ids: np.ndarray, best: Best) -> pa.RecordBatch:
            at, w, _ = found = np.nonzero(best.scores != NONE)
            return pa.record_batch([pa.array(ids[at]), pa.array(w.astype(np.int32)), pa.array(best.ids[found]), pa.array(best.scores[found].astype(np.int64))], ["anchor", "slot", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                array = lambda c, d, i=i: np.frombuffer(batch.column(c)[i].as_buffer(), d)  # noqa: B023, E731
                size, name = batch.column("size")[i].as_py(), batch.column("name")[i].as_py()
                if batch.column("asked")[i].as_py() != size:
                    continue
                fields = {c: array(c, d) for c, d in _TREE.items()}
                fields |= {"x": fields["x"].reshape(-1, size), "center": fields["center"].reshape(-1, size), "spans": fields["spans"].reshape(-1, 3)}
                ids = array("q_ids", np.int64)
                low, high = (array(c, np.float64).reshape(-1, windows) for c in ("low", "high"))
                if name not in held:
                    while len(held) >= HELD_BLOCKS:
                        yield out(*held.popitem(last=False)[1])
                    held[name] = ids.copy(), Best(len(ids), windows, k)
                held.move_to_end(name)
                search(Tree(**fields), ids, array("q_labels", np.int64), array("q", np.float64).reshape(-1, size), low, high, same, held[name][1])
        for block in held.values():
            yield out(*block)

    pairs = blocks.crossJoin(index)  # a stated query set, block against block
    return map_arrow(pairs, run, "anchor long, slot int, id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk: int = CHUNK, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on ``id``; ``label`` the label, by default the column of
    that name."""
    with scratch() as made:
        own = prepared(vectors, id_col, vector_col, F.col("label") if label is None else label, scale)
        rows = durable(own.withColumn("code", F.xxhash64("label")), "vectors")
        index = durable(trees(rows, chunk, leaf), "ball-trees")
        asked = durable(rows.where(anchors).select("id", "code", "v"), "anchors")
        every = asked.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
        near = durable(top(searched(index, durable(_blocks(every, 1, block), "blocks"), 1, positives, True), positives), "positives")
        # 50 p <= 100 n <= 95 p, in whole scores.
        window = F.struct(F.col("rank"), (F.col("score") * low / 100).alias("low"), (F.col("score") * high / 100).alias("high"))
        windows = near.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(window)).alias("w"))
        padded = lambda c, filler: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at(F.col(f"w.{c}"), i + 1), F.lit(filler)))
        sought = asked.join(windows, "id").select("id", "code", "v", padded("low", float("inf")).alias("low"), padded("high", float("-inf")).alias("high"))
        hard = top(searched(index, durable(_blocks(sought, positives, block), "blocks"), positives, negatives, False), negatives)
        paired = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = hard.join(paired, ["anchor", "slot"])
        return made.keep(durable(joined.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives"))
