"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors are compared within their label. Equal vectors are one node with a
multiplicity. The nodes of a label are dealt by a hash into shards of at most
about `capacity` nodes; one task builds a shard's graph. Every node then queries
every shard of its label: a task takes a pair of shards, and each queries the
other's graph, so a link is found if either search finds it. A query descends
the layers and searches the ground layer with a beam; a beam that is full of
hits is widened by expanding every node close to the threshold that it reaches.
Queries are audited against all nodes of the shard, in a random order, until
AUDIT_HITS true hits other than of a node on itself or AUDIT_MOST queries are
seen. While less than `recall` of these hits are found, or where fewer were seen,
less than NEAREST of the audited queries' nearest nodes, the beam is doubled and
all queries are run again, in the end with a beam as wide as the shard. Hits are
verified by cosine in double precision.

A task returns per node its number of hits and one link to its component
within the task, not the pairs, so a group of near copies returns rows in
proportion to its size. The links are united to components afterwards.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors with a null label or vec_id, link with nothing; vectors
of different lengths, however long, don't link; rows repeating a vec_id are vectors of their
own, linked and counted each by its own vector; ties have no order to decide; an empty table gives an empty result; columns besides vec_id, embedding
and label are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, components, written

DEGREE = 16
BUILD_BEAM = 48
SEARCH_BEAM = 64
SLACK = 0.04
#: Numbers in a shard: its nodes times the vectors' length.
SHARD_NUMBERS = 1 << 19
AUDIT_HITS, AUDIT_MOST, RECALL, NEAREST = 64, 1024, 0.98, 0.9
BATCH = 256
ROUNDING = 1e-5


def select_diverse(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, degree: int) -> np.ndarray:
    """For each row of candidates, best first and -1 for none: up to `degree` that are nearer to the row's node than to one another; spare places go to the best of the rest."""
    rows, width = ids.shape
    vectors = x[np.maximum(ids, 0)]
    between = vectors @ vectors.transpose(0, 2, 1)
    chosen = np.zeros((rows, width), bool)
    nearest = np.full((rows, width), -np.inf, np.float32)
    count = np.zeros(rows, np.int64)
    for k in range(width):
        take = (ids[:, k] >= 0) & (count < degree) & (sims[:, k] > nearest[:, k])
        chosen[:, k] = take
        count += take
        nearest = np.where(take[:, None], np.maximum(nearest, between[:, k, :]), nearest)
    rank = np.where(chosen, np.arange(width), np.where(ids >= 0, width + np.arange(width), 3 * width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, order, 1)
    out[np.take_along_axis(rank, order, 1) >= 3 * width] = -1
    return np.pad(out, ((0, 0), (0, max(0, degree - width))), constant_values=-1)


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the best `beam` nodes found from the entries, best first, -1 where there are fewer."""
    q, width = len(queries), entry.shape[1]
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf, np.float32)
    open_ = np.zeros((q, beam), bool)
    seen = np.zeros((q, len(x) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    width = min(width, beam)
    first = entry[:, :width]
    s = np.einsum("qwd,qd->qw", x[np.maximum(first, 0)], queries)
    s[first < 0] = -np.inf
    order = np.argsort(-s, axis=1)
    ids[:, :width], sims[:, :width] = np.take_along_axis(first, order, 1), np.take_along_axis(s, order, 1)
    open_[:, :width] = ids[:, :width] >= 0
    np.put_along_axis(seen, first, True, 1)
    live = np.arange(q)
    while True:
        live = live[open_[live].any(1)]
        if not len(live):
            return ids, sims
        at = open_[live].argmax(1)  # rows are sorted, so the first open one is the best
        open_[live, at] = False
        near = links[ids[live, at]]
        fresh = ~np.take_along_axis(seen[live], near, 1)
        s = np.einsum("qwd,qd->qw", x[np.maximum(near, 0)], queries[live])
        s[~fresh] = -np.inf
        seen[live[:, None], near] = True
        all_s = np.concatenate([sims[live], s], 1)
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        sims[live] = np.take_along_axis(all_s, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), order, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], 1), order, 1)


class Graph:
    """Layers of links over unit vectors; layer 0 holds all nodes."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], top: int):
        self.x, self.layers, self.top = x, layers, top

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 3) -> Graph:
        n, rng = len(x), np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(DEGREE)).astype(int), 6)
        order = rng.permutation(n)
        highest = order[0]
        layers = [np.full((n, 2 * DEGREE if k == 0 else DEGREE), -1, np.int64) for k in range(int(level.max()) + 1 if n else 1)]
        graph = cls(x, layers, int(highest))
        done, size = 1, 1
        while done < n:
            batch = order[done : done + size]
            for k in range(len(layers) - 1, -1, -1):
                graph._insert(k, batch[level[batch] >= k], level, order[:done])
            done += len(batch)
            size = min(BATCH, done)
            best = batch[np.argmax(level[batch])]
            if level[best] > level[graph.top]:
                graph.top = int(best)
        return graph

    def _entry(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        entry = np.full((len(queries), 1), self.top)
        for k in range(len(self.layers) - 1, down_to, -1):
            entry = beam_search(self.x, self.layers[k], queries, entry, 4)[0]
        return entry

    def _insert(self, k: int, new: np.ndarray, level: np.ndarray, earlier: np.ndarray) -> None:
        if not len(new):
            return
        x, links = self.x, self.layers[k]
        ids, sims = beam_search(x, links, x[new], self._entry(x[new], k), BUILD_BEAM)
        ids = np.where((ids >= 0) & (level[np.maximum(ids, 0)] >= k), ids, -1)
        among = x[new] @ x[new].T
        np.fill_diagonal(among, -np.inf)
        few = min(DEGREE, len(new) - 1)
        if few > 0:
            pick = np.argpartition(-among, few - 1, axis=1)[:, :few]
            ids = np.concatenate([ids, new[pick]], 1)
            sims = np.concatenate([sims, np.take_along_axis(among, pick, 1).astype(np.float32)], 1)
        sims = np.where(ids >= 0, sims, -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        chosen = select_diverse(sims, ids, x, DEGREE)
        links[new, :DEGREE] = chosen
        back = np.stack([chosen.ravel(), np.repeat(new, chosen.shape[1])], 1)
        back = np.unique(back[back[:, 0] >= 0], axis=0)
        if not len(back):
            return
        nodes, starts, counts = np.unique(back[:, 0], return_index=True, return_counts=True)
        width, most = links.shape[1], int(counts.max())
        place = np.arange(len(back)) - np.repeat(starts, counts)
        extra = np.full((len(nodes), most), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), counts), place] = back[:, 1]
        for c in range(0, len(nodes), BATCH):
            part = nodes[c : c + BATCH]
            ids = np.concatenate([links[part], extra[c : c + BATCH]], 1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("qwd,qd->qw", x[np.maximum(ids, 0)], x[part])
            sims[ids < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            links[part] = select_diverse(sims, ids, x, width)

    def hits(self, queries: np.ndarray, threshold: float, beam: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs found at or above the threshold."""
        n, out = len(self.x), []
        beam = min(beam, n)
        for c in range(0, len(queries), BATCH):
            q = queries[c : c + BATCH]
            ids, sims = beam_search(self.x, self.layers[0], q, self._entry(q, 0), beam)
            good = (sims >= threshold) & (ids >= 0)
            full = good.all(1) & (beam < n)
            row, col = np.nonzero(good & ~full[:, None])
            out.append(np.stack([row + c, ids[row, col]], 1))
            if full.any():
                wide = np.flatnonzero(full)
                row, node = self._flood(q[wide], ids[wide], threshold, slack)
                out.append(np.stack([wide[row] + c, node], 1))
        found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return found[:, 0], found[:, 1]

    def _flood(self, q: np.ndarray, start: np.ndarray, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """The widened beam: expands every node reached that is within `slack` of the threshold."""
        n = len(self.x)
        seen = np.zeros(len(q) * n, bool)
        row, node = np.repeat(np.arange(len(q)), start.shape[1]), start.ravel()
        seen[row * n + node] = True
        hit = [row * n + node]
        while len(row):
            near = self.layers[0][node]
            flat = (np.repeat(row, near.shape[1]) * n + near.ravel())[near.ravel() >= 0]
            flat = np.unique(flat[~seen[flat]])
            seen[flat] = True
            row, node = flat // n, flat % n
            sims = np.concatenate([np.einsum("wd,wd->w", self.x[node[k : k + 65536]], q[row[k : k + 65536]]) for k in range(0, len(node), 65536)] or [np.zeros(0)])
            hit.append(flat[sims >= threshold])
            go = sims >= threshold - slack
            row, node = row[go], node[go]
        flat = np.concatenate(hit)
        return flat // n, flat % n

    def audited_hits(self, queries: np.ndarray, threshold: float, recall: float = RECALL, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hits with a beam that passes the audit: the first of SEARCH_BEAM, twice that, ... whose audited queries find enough. same: the queries are the graph's own nodes."""
        order, n, truth, first = np.random.default_rng(len(queries)).permutation(len(queries)), len(self.x), [], []
        for c in range(0, min(len(queries), AUDIT_MOST), BATCH):
            sims = queries[order[c : c + BATCH]] @ self.x.T
            if same:
                sims[np.arange(len(sims)), order[c : c + BATCH]] = -np.inf
            row, node = np.nonzero(sims >= threshold)
            truth.append(order[row + c] * n + node)
            first.append(sims.argmax(1))
            if sum(map(len, truth)) >= AUDIT_HITS:
                break
        truth, first = np.concatenate(truth), np.concatenate(first)
        audited = order[: len(first)]
        beam, slack = SEARCH_BEAM, SLACK
        while beam < n:
            if len(truth) >= AUDIT_HITS:
                row, node = self.hits(queries[audited], threshold, beam, slack)
                passed = np.isin(truth, audited[row] * n + node).sum() >= recall * len(truth)
            else:
                near = [beam_search(self.x, self.layers[0], q := queries[audited[c : c + BATCH]], self._entry(q, 0), beam)[0] for c in range(0, len(audited), BATCH)]
                row, node = self.hits(queries[audited], threshold, beam, slack)
                passed = (np.concatenate(near) == first[:, None]).any(1).sum() >= NEAREST * len(first) and np.isin(truth, audited[row] * n + node).all()
            if passed:
                return self.hits(queries, threshold, beam, slack)
            beam, slack = 2 * beam, 2 * slack
        out = [np.stack(np.nonzero(queries[c : c + BATCH] @ self.x.T >= threshold), 1) + [c, 0] for c in range(0, len(queries), BATCH)]
        found = np.concatenate(out)
        return found[:, 0], found[:, 1]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    x = unit(np.array(pdf["embedding"].tolist(), np.float64))
    graph = Graph.build(x.astype(np.float32))
    links = np.concatenate([layer.astype(np.int32).ravel() for layer in graph.layers]).tobytes()
    head = pdf.iloc[0]
    row = (head["label"], head["dim"], head["shard"], pdf["node"].to_numpy(np.int64).tobytes(), pdf["mult"].to_numpy(np.int64).tobytes(), x.tobytes(), links, len(graph.layers), graph.top)
    return pd.DataFrame([row], columns=["label", "dim", "shard", "reps", "mults", "x", "links", "n_layers", "top"])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node of their component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _graph(r: pd.Series, x: np.ndarray, side: str) -> Graph:
    flat, layers, at = np.frombuffer(r[f"links{side}"], np.int32).astype(np.int64), [], 0
    for k in range(r[f"n_layers{side}"]):
        width = 2 * DEGREE if k == 0 else DEGREE
        layers.append(flat[at : at + len(x) * width].reshape(-1, width))
        at += len(x) * width
    return Graph(x.astype(np.float32), layers, int(r[f"top{side}"]))


def _link(threshold: float):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the nodes of one shard (i) and those of another (j), or of the same."""
        r = pdf.iloc[0]
        one, same = len(r["reps_i"]) // 8, r["i"] == r["j"]
        reps_i, mults_i = np.frombuffer(r["reps_i"], np.int64), np.frombuffer(r["mults_i"], np.int64)
        reps_j, mults_j = np.frombuffer(r["reps"], np.int64), np.frombuffer(r["mults"], np.int64)
        x_i, x_j = np.frombuffer(r["x_i"]).reshape(one, -1), np.frombuffer(r["x"]).reshape(len(reps_j), -1)
        a, b = _graph(r, x_j, "").audited_hits(x_i.astype(np.float32), threshold - ROUNDING, same=same)
        if same:
            a, b = np.minimum(a, b), np.maximum(a, b)
            flat = np.unique((a * len(reps_j) + b)[a != b])
        else:
            d, c = _graph(r, x_i, "_i").audited_hits(x_j.astype(np.float32), threshold - ROUNDING)
            flat = np.unique(np.concatenate([a * len(reps_j) + b, c * len(reps_j) + d]))
        a, b = flat // len(reps_j), flat % len(reps_j)
        good = np.concatenate([np.einsum("wd,wd->w", x_i[a[k : k + 65536]], x_j[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)]) >= threshold
        a, b = a[good], b[good]
        reps = reps_i if same else np.concatenate([reps_i, reps_j])
        mults = mults_i if same else np.concatenate([mults_i, mults_j])
        b = b if same else b + one
        links = np.zeros(len(reps), np.int64)
        np.add.at(links, a, mults[b])
        np.add.at(links, b, mults[a])
        order = np.argsort(reps, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(reps))
        root = reps[order][roots(rank[a], rank[b], len(reps))[rank]]
        hit = links > 0
        return pd.DataFrame({"node": reps[hit], "links": links[hit], "root": root[hit]})

    return of


def near_vectors(embeddings: DataFrame, threshold: float = 0.93, capacity: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector.

    capacity: nodes in a shard, by default as many as make SHARD_NUMBERS numbers.
    """
    d = columns(embeddings, vec_id="vec_id", embedding="embedding", label="label")
    d = d.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    d = d.select("vec_id", F.when(usable, F.col("label")).alias("label"), F.when(usable, F.col("embedding")).alias("embedding"))
    grouped = d.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    nodes = written(grouped.withColumn("node", F.xxhash64("label", "embedding")))

    sized = nodes.select("*", F.size("embedding").alias("dim"))
    most = F.lit(capacity) if capacity else F.greatest(F.lit(64), F.floor(F.lit(SHARD_NUMBERS) / F.col("dim")))
    shards = sized.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select("label", "dim", F.ceil(F.col("n") / most).alias("shards"))
    dealt = sized.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "node"), "shards"))
    label_type = nodes.schema["label"].dataType.simpleString()
    index = written(
        dealt.select("label", "dim", "shard", "node", "mult", "embedding").groupBy("label", "dim", "shard")
        .applyInPandas(lambda pdf: _build(pdf), f"label {label_type}, dim int, shard long, reps binary, mults binary, x binary, links binary, n_layers int, top long")
    )
    # Pairs of shards are made of their names alone and dealt by both; a shard's payload goes only where a pair needs it.
    names = index.select("label", "dim", "shard")
    pairs = names.withColumnRenamed("shard", "i").join(names.withColumnRenamed("shard", "j"), ["label", "dim"]).where("i <= j")
    payload = ("reps", "mults", "x", "links", "n_layers", "top")
    one = index.select("label", "dim", F.col("shard").alias("i"), *(F.col(c).alias(f"{c}_i") for c in payload))
    other = index.select("label", "dim", F.col("shard").alias("j"), *payload)
    met = pairs.join(one, ["label", "dim", "i"]).join(other, ["label", "dim", "j"])
    found = written(met.groupBy("label", "dim", "i", "j").applyInPandas(lambda pdf: _link(threshold)(pdf), "node long, links long, root long"))

    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).toDF("node", "component")
    heads = nodes.join(comps, "node").groupBy("component").agg(F.min("rep").alias("head"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = comps.join(heads, "component").select("node", "head")
    named = nodes.join(counts, "node", "left").join(placed, "node", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("head", "rep").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return (
        d.join(named, ["label", "embedding"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
