"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt into shards and every shard builds its graph. Every vector then searches every
shard: it descends the sparse layers greedily and widens a beam over the lowest one. A shard's beam
is as wide as its recall audit demands. A beam that comes back full of links is not trusted to hold
all of them: that query scans the shard instead. Found pairs are verified by cosine in double
precision, counted, and joined to components; pairs themselves are never stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm.common import stored
from formulary.llm.components import Forest, components

COSINE = 0.9
DEGREE, BUILD_BEAM, BEAM = 16, 64, 48
SHARD_ROWS, LEAST_SHARDS = 1 << 15, 4
AUDIT, RECALL, SEED = 256, 0.995, 7
#: Slack of single precision while searching; what decides is the cosine in double precision.
SLACK = 1e-4
_LOW = np.float32(-2)


class Graph:
    """Layers of neighbour lists over unit vectors. Layer 0 holds all nodes, each further layer a random 1/DEGREE of the one below."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], entry: int) -> None:
        self.unit, self.layers, self.entry = unit, layers, entry

    @classmethod
    def built(cls, unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = SEED) -> Graph:
        n, rng = len(unit), np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 6)
        order = np.lexsort((rng.random(n), -level))
        self = cls(unit, [], int(order[0]) if n else -1)
        for layer in range(int(level.max(initial=0)), -1, -1):  # upper layers are whole before the next one starts
            nodes = order[: int((level >= layer).sum())]
            self.layers.insert(0, np.full((n, degree * (1 + (layer == 0))), -1, np.int32))
            done, step = 1, 1
            while done < len(nodes):
                batch = nodes[done : done + step]
                self._insert(batch, beam)
                done += len(batch)
                step = min(512, done)
        return self

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        q = self.unit[batch]
        ids, sims = self._beam(q, self._descend(q, skip=1), 0, beam)
        near = q @ q.T  # nodes of one batch see each other directly
        np.fill_diagonal(near, _LOW)
        k = min(len(batch), 16)
        own = np.argpartition(-near, k - 1, axis=1)[:, :k]
        own_sims = np.take_along_axis(near, own, 1)
        ids = np.concatenate((ids, np.where(own_sims > _LOW, batch[own], -1)), 1)
        sims = np.concatenate((sims, own_sims), 1)
        chosen = self._diverse(ids, sims, self.layers[0].shape[1] // 2)
        table = self.layers[0]
        table[batch, : chosen.shape[1]] = chosen
        back = np.stack((chosen.ravel(), np.repeat(batch, chosen.shape[1])), 1)
        back = back[back[:, 0] >= 0]
        back = back[np.argsort(back[:, 0], kind="stable")]
        targets, first, count = np.unique(back[:, 0], return_index=True, return_counts=True)
        width = table.shape[1]
        free = (table[targets] < 0).sum(1)
        full = count > free
        for t, s, c in zip(targets[~full], first[~full], count[~full], strict=True):
            at = width - int((table[t] < 0).sum())
            table[t, at : at + c] = back[s : s + c, 1]
        if full.any():
            most = int(count[full].max())
            ids = np.full((int(full.sum()), width + most), -1, np.int64)
            ids[:, :width] = table[targets[full]]
            for row, s, c in zip(ids, first[full], count[full], strict=True):
                row[width : width + c] = back[s : s + c, 1]
            for at in range(0, len(ids), 256):
                part, own = ids[at : at + 256], targets[full][at : at + 256]
                sims = np.where(part >= 0, np.matmul(self.unit[part], self.unit[own][:, :, None])[..., 0], _LOW)
                kept = self._diverse(part, sims, width)
                table[own] = -1
                table[own, : kept.shape[1]] = kept

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row the nearest candidates that are nearer to it than to one already chosen; free places go to the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        usable = ids >= 0
        v = self.unit[np.maximum(ids, 0)]
        among = np.matmul(v, v.transpose(0, 2, 1))
        chosen, shadow = np.zeros(ids.shape, bool), np.full(ids.shape, _LOW)
        for c in range(ids.shape[1]):
            good = usable[:, c] & (sims[:, c] > shadow[:, c]) & (chosen.sum(1) < most)
            chosen[:, c] = good
            shadow = np.where(good[:, None], np.maximum(shadow, among[:, c]), shadow)
        rank = np.argsort(np.where(chosen, 0, np.where(usable, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(usable, rank, 1), np.take_along_axis(ids, rank, 1), -1)

    def _descend(self, q: np.ndarray, skip: int) -> np.ndarray:
        at = np.full((len(q), 1), self.entry)
        for layer in range(len(self.layers) - 1, skip - 1, -1):
            at = self._beam(q, at, layer, 4)[0]
        return at

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: int, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities, best first, of the nodes that each query's beam ends with (-1 where there are fewer)."""
        table, unit, rows = self.layers[layer], self.unit, np.arange(len(q))
        seen = np.zeros((len(q), len(unit) + 1), bool)
        seen[:, -1] = True
        ids = np.full((len(q), width), -1, np.int64)
        take = min(width, entry.shape[1])
        ids[:, :take] = entry[:, :take]
        seen[rows[:, None], ids] = True
        sims = np.where(ids >= 0, np.matmul(unit[ids], q[:, :, None])[..., 0], _LOW)
        todo = ids >= 0
        live = rows
        while len(live):
            pick = np.argpartition(np.where(todo[live], -sims[live], 3), min(at_once, width) - 1, axis=1)[:, :at_once]
            valid = np.take_along_axis(todo[live], pick, 1)
            going = valid.any(1)
            live, pick, valid = live[going], pick[going], valid[going]
            if not len(live):
                break
            from_ids = np.where(valid, np.take_along_axis(ids[live], pick, 1), -1)
            todo[live[:, None], pick] = False
            near = np.where(from_ids[:, :, None] >= 0, table[np.maximum(from_ids, 0)], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where(seen[live[:, None], near], -1, near)
            seen[live[:, None], near] = True
            fresh = np.where(near >= 0, np.matmul(unit[near], q[live][:, :, None])[..., 0], _LOW)
            all_ids, all_sims = np.concatenate((ids[live], near), 1), np.concatenate((sims[live], fresh), 1)
            all_todo = np.concatenate((todo[live], near >= 0), 1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live], sims[live], todo[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_todo))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self._beam(q, self._descend(q, skip=1), 0, width)

    def audited(self, cosine: float, width: int = BEAM, sample: int = AUDIT, wanted: float = RECALL, seed: int = SEED) -> int:
        """The beam at which a sample of the shard's nodes, moved away almost to the threshold, find what a scan finds; the shard's size means scan."""
        n, rng = len(self.unit), np.random.default_rng(seed)
        x = self.unit[rng.permutation(n)[:sample]]
        noise = rng.standard_normal(x.shape).astype(np.float32)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        near = min(1.0, cosine + 0.01)
        q = near * x + np.float32(np.sqrt(1 - near * near)) * noise
        truth = (q @ self.unit.T >= cosine).sum(1)
        while width < n:
            found = (self.search(q, width)[1] >= cosine).sum(1)
            if np.minimum(found, width - 1).sum() >= wanted * np.minimum(truth, width - 1).sum():
                return width
            width *= 2
        return n


def _unit(raw: np.ndarray) -> np.ndarray:
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in rows])


def _built(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    group = group.sort_values("rep")
    raw = _matrix(group["v"])
    graph = Graph.built(_unit(raw))
    row = {c: int(group[c].iloc[0]) for c in ("dim", "shard")}
    shapes = np.array([x.shape[1] for x in graph.layers], np.int32)
    row |= {"reps": group["rep"].to_numpy(np.int64).tobytes(), "copies": group["copies"].to_numpy(np.int64).tobytes(), "raw": raw.tobytes()}
    row |= {"layers": b"".join(x.tobytes() for x in graph.layers), "widths": shapes.tobytes(), "entry": graph.entry, "beam": graph.audited(cosine)}
    return pd.DataFrame([row])


def _searched(index: pd.DataFrame, queries: pd.DataFrame, cosine: float, step: int = 512) -> pd.DataFrame:
    """For each query its links in this shard; and edges that join what the links of all of them join."""
    none = pd.DataFrame({"a": [], "b": [], "links": []}, dtype=np.int64)
    if not len(index) or not len(queries):
        return none
    row = index.iloc[0]
    reps, copies = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["copies"], np.int64)
    raw = np.frombuffer(row["raw"], np.float64).reshape(len(reps), -1)
    norm = np.linalg.norm(raw, axis=1)
    flat, layers = np.frombuffer(row["layers"], np.int32), []
    for w in np.frombuffer(row["widths"], np.int32):
        layers.append(flat[: w * len(reps)].reshape(len(reps), w))
        flat = flat[w * len(reps) :]
    graph, beam = Graph(_unit(raw), layers, int(row["entry"])), int(row["beam"])
    queries = queries.sort_values("rep")
    who, q = queries["rep"].to_numpy(np.int64), _matrix(queries["v"])
    q_norm, q_unit = np.linalg.norm(q, axis=1), _unit(q)
    links = np.zeros(len(who), np.int64)
    forest = Forest(len(reps) + len(who))  # shard members, then queries

    def link(k: int, cand: np.ndarray) -> None:
        cos = raw[cand] @ q[k] / (norm[cand] * q_norm[k])
        hit = cand[(cos >= cosine) & (reps[cand] != who[k])]
        if len(hit):
            links[k] = copies[hit].sum()
            up = forest.up[hit]
            while True:
                over = forest.up[up]
                if (over == up).all():
                    break
                up = over
            forest.up[hit] = up
            for r in np.unique(up).tolist():
                forest.join(len(reps) + k, r)

    for at in range(0, len(who), step):
        ids, sims = (None, None) if beam >= len(reps) else graph.search(q_unit[at : at + step], beam)
        scan = np.ones(len(who[at : at + step]), bool) if ids is None else sims[:, beam * 3 // 4] >= cosine - SLACK  # crowded: there may be more
        if scan.any():
            some = np.flatnonzero(scan)
            near = q_unit[at + some] @ graph.unit.T >= cosine - SLACK
            for k, hits in zip(some.tolist(), near, strict=True):
                link(at + k, np.flatnonzero(hits))
        if ids is not None:
            close = (sims >= cosine - SLACK) & (ids >= 0) & ~scan[:, None]
            for k in np.flatnonzero(close.any(1)).tolist():
                link(at + k, ids[k][close[k]])
    roots, name = forest.roots(), np.concatenate((reps, who))
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    some = np.flatnonzero(links)
    edges = pd.DataFrame({"a": name[moved], "b": name[roots[moved]], "links": 0})
    return pd.concat((edges[edges["a"] != edges["b"]], pd.DataFrame({"a": who[some], "b": who[some], "links": links[some]})))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors.

    n_links counts the other rows at a cosine of at least the threshold, component_id is the smallest
    id reachable by links, kept says that it is the row's own. Null and zero vectors and vectors with
    a null or non-finite component link with nothing, nor do rows without an id, whose component is
    null. Only vectors of the same length are compared. Equal vectors are searched once and counted
    as often as they occur, so a group of copies costs one search. Rows that share an id are vectors
    of their own, each with its own links. An empty table gives no rows; other columns aren't read.

    Shards have a bounded size; their number, and with it the searches of a vector, follows the data.
    A query in a crowd scans its shards, which costs the crowd's size times the shards' rows.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = v.isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, real) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(good, F.transform(v, lambda x: x + F.lit(0.0))))  # -0.0 becomes 0.0
    valid = rows.where("v is not null")
    # rep numbers the distinct vectors: an id may have several
    one = valid.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = stored(one.withColumns({"dim": F.size("v"), "rep": F.monotonically_increasing_id()}), "vectors")
    n = reps.count()
    shards = max(LEAST_SHARDS, -(-n // shard_rows))
    deal = lambda salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(shards)).cast("int")
    schema = "dim int, shard int, reps binary, copies binary, raw binary, layers binary, widths binary, entry int, beam int"
    index = stored(reps.withColumn("shard", deal(1)).groupBy("dim", "shard").applyInPandas(lambda g: _built(g, cosine), schema), "graphs")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = reps.select("rep", "v", "dim", deal(2).alias("block")).withColumn("shard", every)
    keys = ["dim", "shard", "block"]
    found = index.withColumn("block", every).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(lambda a, b: _searched(a, b, cosine), "a long, b long, links long")
    found = stored(found, "links")
    near = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    tree = components(found.where("a <> b").select("a", "b"))
    facts = reps.select("v", "rep", "low", "copies").join(near, F.col("rep") == F.col("a"), "left").join(tree, F.col("rep") == F.col("node"), "left")
    facts = stored(facts.select("v", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("of")), "facts")
    lowest = facts.groupBy("of").agg(F.min("low").alias("component_id"))
    facts = facts.join(lowest, "of").select("v", "n_links", "component_id")
    linked = valid.join(facts, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: What near_duplicates gives in DuckDB, for vectors of one length.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON low.a = vec_id LEFT JOIN deg ON deg.a = vec_id
"""
