"""Nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids part the vectors into cells, as many as the root of their number,
found in two levels: some top centroids, then those below each. A vector is stored
as its cell and, for the residual, one codeword number per subspace. A query probes
the cells whose centroids it meets best, reads approximate scores off a table made
for it (asymmetric distances), and all that come within a margin of the best are scored
anew on the original vectors: the margin that a sample's true neighbours need.

Quantisers are fitted on bounded samples; every vector is indexed. How many cells
are probed is set by brute force: a bounded number of queries is searched for in
all rows, and their true neighbours show how far one must look.

Cells are packed into blocks of bounded size, a large cell into several. A block
and the queries that meet it are one task's work; vectors travel as packed bytes in
the width that the table has. Copies of a vector are indexed once with their
smallest ids: no more than the neighbours asked for, and one for the query itself,
can count.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, written

NEIGHBOURS = 20
#: Vectors that the top centroids and the codebooks are fitted on, and that each top cell's centroids are, at most.
SAMPLE_ROWS = 8192
#: Sampled vectors for each cell below a top one, about.
CELL_SAMPLE = 64
SUBSPACES = 8
CODEWORDS = 256
#: Vectors of a block, and queries that meet it in one group, about; pairs that are scored in one step.
BLOCK_ROWS, BLOCK_QUERIES, STEP = 4096, 8192, 1 << 20
#: Share of the true neighbours that the probed cells must hold, and queries that set it by brute force, at most.
RECALL, TRIALS = 0.96, 128
#: Share of a sample's true neighbours whose approximate score lies within the margin of the best approximate ones.
WITHIN = 0.99


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centroids by Lloyd's rounds from ``k`` distinct rows; an empty one keeps its place."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)


@dataclass(frozen=True)
class Quantiser:
    """``tops`` and the ``centres`` below them (those of top t from ``first[t]`` on), residual ``codebooks`` per subspace."""

    tops: np.ndarray
    centres: np.ndarray
    first: np.ndarray
    spans: tuple[tuple[int, int], ...] = ()
    codebooks: tuple[np.ndarray, ...] = ()
    probes: int = 1
    margin: float = 0.0

    def cell(self, x: np.ndarray) -> np.ndarray:
        top, cells = nearest(x, self.tops), np.zeros(len(x), np.int64)
        for t in np.unique(top).tolist():
            own = top == t
            cells[own] = self.first[t] + nearest(x[own], self.centres[self.first[t] : self.first[t + 1]])
        return cells

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, codes) of vectors."""
        cells = self.cell(x)
        rest = x - self.centres[cells]
        return cells, np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.spans, self.codebooks, strict=True)], axis=1).astype(np.uint8)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The cells that each query probes, best first."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : self.probes]

    def approximate(self, q: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of queries by coded vectors: the centroid's share plus one table entry per subspace."""
        met, own = np.unique(cells, return_inverse=True)
        score = (q @ self.centres[met].T)[:, own]
        for m, ((a, b), book) in enumerate(zip(self.spans, self.codebooks, strict=True)):
            score += (q[:, a:b] @ book.T)[:, codes[:, m]]
        return score


def with_codebooks(coarse: Quantiser, sample: np.ndarray) -> Quantiser:
    """Codebooks for the residuals of a sample, and how far below the best scores its own true neighbours are scored."""
    rest = sample - coarse.centres[coarse.cell(sample)]
    cuts = [round(sample.shape[1] * i / SUBSPACES) for i in range(SUBSPACES + 1)]
    spans = tuple((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)
    model = replace(coarse, spans=spans, codebooks=tuple(k_means(rest[:, a:b], CODEWORDS, 6) for a, b in spans))
    own = np.arange(0, len(sample), max(1, len(sample) // TRIALS))[:TRIALS]
    near, exact = model.approximate(sample[own], *model.encode(sample)), sample[own] @ sample.T
    near[np.arange(len(own)), own] = exact[np.arange(len(own)), own] = -np.inf
    k = min(NEIGHBOURS, len(sample) - 1)
    if k < 1:
        return model
    true = np.take_along_axis(near, np.argpartition(-exact, k - 1, axis=1)[:, :k], axis=1)
    last = -np.partition(-near, k - 1, axis=1)[:, k - 1]
    return replace(model, margin=float(np.quantile(np.maximum(0, last[:, None] - true), WITHIN)))


def valid_vectors(table: DataFrame, length: int | None = None) -> DataFrame:
    """(vec_id, vector); null, empty, zero, and not wholly finite vectors have no part.

    Of vectors of several lengths, those of ``length`` count, or else of the
    commonest (of equals, the shortest). Of rows that repeat a vec_id with another vector, the one of the
    least vector counts.
    """
    whole = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole & F.exists("embedding", lambda x: x != 0))
    if length is None:
        common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = common["n"] if common else 0
    rows = rows.where(F.size("embedding") == length)
    rows = written(rows.select("vec_id", F.col("embedding").alias("vector")), "vectors")
    again = written(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        return rows
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.join(again, "vec_id", "left_anti").unionByName(least)


def _coarse(vectors: DataFrame, count: int, sample: np.ndarray) -> Quantiser:
    """Centroids in two levels: the top ones from the sample, those below each from a larger one, cell by cell."""
    cells = max(1, round(count**0.5))
    tops = k_means(sample, max(1, round(cells**0.5)))
    below = -(-cells // len(tops))
    share = min(1.0, 2 * CELL_SAMPLE * cells / count)

    def dealt(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"top": nearest(np.stack(b["vector"].to_numpy()).astype(float), tops), "vector": b["vector"]})

    def fitted(own: pd.DataFrame) -> pd.DataFrame:
        x = np.array(sorted(map(tuple, own["vector"])), dtype=float)
        return pd.DataFrame({"top": own["top"].iloc[0], "centre": list(k_means(x, below))})

    drawn = vectors.where(F.pmod(F.xxhash64("vector", F.lit("cells")), F.lit(1 << 30)) < share * (1 << 30)).select("vector")
    few = drawn.mapInPandas(dealt, "top int, vector array<double>")
    place = F.row_number().over(Window.partitionBy("top").orderBy(F.xxhash64("vector")))
    few = few.withColumn("_n", place).where(F.col("_n") <= SAMPLE_ROWS).drop("_n")
    rows = few.groupBy("top").applyInPandas(fitted, "top int, centre array<double>").collect()
    own: list[list] = [[] for _ in tops]
    for r in rows:
        own[r["top"]].append(r["centre"])
    own = [sorted(c) or [t.tolist()] for c, t in zip(own, tops, strict=True)]
    return Quantiser(tops, np.array([c for part in own for c in part]), np.cumsum([0, *map(len, own)]))


def _probes(index: DataFrame, asked: DataFrame, model: Quantiser, kind: str, k: int, recall: float) -> int:
    """Cells to be probed so that ``recall`` of the true neighbours of up to ``TRIALS`` queries lie in them."""
    q = np.array([r["vector"] for r in asked.orderBy(F.xxhash64("vec_id")).limit(TRIALS).collect()], dtype=float)
    if not len(q):
        return 1

    def best(batches):
        score, cell = np.full((len(q), k + 1), -np.inf), np.zeros((len(q), k + 1), np.int64)
        for b in batches:
            if len(b):
                score = np.concatenate((score, q @ np.frombuffer(b"".join(b["vector"]), kind).reshape(len(b), -1).astype(float).T), axis=1)
                cell = np.concatenate((cell, np.broadcast_to(b["cell"].to_numpy(), (len(q), len(b)))), axis=1)
                top = np.argpartition(-score, k, axis=1)[:, : k + 1]
                score, cell = np.take_along_axis(score, top, axis=1), np.take_along_axis(cell, top, axis=1)
        some = np.isfinite(score)
        yield pd.DataFrame({"q": np.nonzero(some)[0], "score": score[some], "cell": cell[some]})

    found = index.select("vector", "cell").mapInPandas(best, "q int, score double, cell int")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell"))
    found = found.withColumn("_n", place).where(F.col("_n") <= k + 1).select("q", "cell").collect()
    rank = np.argsort(np.argsort(-(q @ model.centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort([rank[r["q"], r["cell"]] for r in found]) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def search(table: DataFrame, asked: DataFrame, k: int = NEIGHBOURS, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each of ``asked``.

    ``table`` and ``asked`` have vec_id and embedding. A query's own vec_id is no
    candidate. Ties go to the smaller vec_id. Rows that repeat count once, and
    one vec_id is one vector (see ``valid_vectors``). Queries of another length
    than the table's vectors have no part. A query that meets fewer than ``k``
    candidates in its cells is searched for again in all of them. Without valid
    vectors the result is empty.
    """
    spark = table.sparkSession
    rows = valid_vectors(table)
    # copies of one vector: the ranks of its ids, so that rows that repeat take no place
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("_n", place).where(F.col("_n") <= k + 1)
    vectors = written(few.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "distinct-vectors")
    count = vectors.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count:
        return empty
    kind = "f8" if table.schema["embedding"].dataType.elementType.typeName() != "float" else "f4"
    chance = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / float(1 << 30)
    drawn = vectors.where(chance < min(1.0, 0.95 * sample_rows / count)) if count > sample_rows else vectors
    sample = np.array(sorted(r["vector"] for r in drawn.select("vector").limit(sample_rows).collect()), dtype=np.float64)
    if not len(sample):
        sample = np.array([r["vector"] for r in vectors.select("vector").limit(1).collect()], dtype=np.float64)
    model = with_codebooks(_coarse(vectors, count, sample), sample)

    def coded(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["vector"].to_numpy())
                cells, codes = model.encode(x.astype(float))
                yield pd.DataFrame({"cell": cells, "codes": [c.tobytes() for c in codes], "vector": [v.tobytes() for v in x.astype(kind)], "ids": b["ids"]})

    index = written(vectors.mapInPandas(coded, "cell int, codes binary, vector binary, ids array<long>"), "index")
    queries = written(valid_vectors(asked, sample.shape[1]).distinct(), "queries")
    model = replace(model, probes=_probes(index, queries, model, kind, k, recall))
    first, parts = _blocks(len(model.centres), {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()})
    release(vectors)
    # one row per cell: the root of the number of vectors
    cells = spark.createDataFrame(list(zip(range(len(first)), first.tolist(), parts.tolist(), strict=True)), "cell int, first int, parts int")
    index = index.join(F.broadcast(cells), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vector"), "parts")).cast("int")).drop("first", "parts")

    found = written(_ranked(_searched(index, queries, model, first, parts, kind, k), k), "nearest")
    # those whose cells hold too few candidates look into all cells
    whole = rows.select("vec_id").distinct().count()
    many = found.groupBy("query_id").count()
    short = queries.join(many.where(F.col("count") >= min(k, whole - 1)), F.col("vec_id") == F.col("query_id"), "left_anti")
    short = written(short, "short-queries")
    if model.probes >= len(model.centres) or short.isEmpty():
        return found
    again = _searched(index, short, replace(model, probes=len(model.centres)), first, parts, kind, k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(_ranked(again, k))


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(index: DataFrame, queries: DataFrame, model: Quantiser, first: np.ndarray, parts: np.ndarray, kind: str, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each block that a query meets, its ``k`` best candidates there."""

    def probed(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["vector"].to_numpy())
                own = model.probed(x.astype(float)).astype(np.int32)
                row, at = np.repeat(np.arange(len(x)), own.shape[1]), own.ravel()
                # a cell of several parts is met in the block of each
                row, at, part = (np.repeat(v, parts[at]) for v in (row, at, np.zeros(len(at), int)))
                start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])))
                part = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                block = first[at] + part
                order = np.lexsort((at, block, row))
                row, block, at = row[order], block[order], at[order].astype(np.int32)
                cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])))
                packed, i = [v.tobytes() for v in x.astype(kind)], b["vec_id"].to_numpy()
                yield pd.DataFrame({"query_id": i[row[cut]], "asked": [packed[r] for r in row[cut]], "block": block[cut], "cells": [p.tobytes() for p in np.split(at, cut[1:])]})

    probes = written(queries.mapInPandas(probed, "query_id long, asked binary, block int, cells binary"), "probes")
    groups = probes.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("groups"))
    groups = written(groups, "block-groups")
    probes = probes.join(groups, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), "groups").cast("int")).drop("groups")
    index = index.join(groups, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def scored(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(block) and len(asked):
            unpack = lambda column: np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(float)
            v, cell = unpack(block["vector"]), block["cell"].to_numpy()
            codes = np.frombuffer(b"".join(block["codes"]), np.uint8).reshape(len(v), -1)
            ids, many = np.concatenate(block["ids"].to_list()), block["ids"].map(len).to_numpy()
            start = np.cumsum(many) - many
            whole, mine = unpack(asked["asked"]), asked["query_id"].to_numpy()
            met = [np.frombuffer(c, np.int32) for c in asked["cells"]]
            for at in range(0, len(whole), max(1, STEP // len(v))):
                q, own = whole[at : at + max(1, STEP // len(v))], mine[at : at + max(1, STEP // len(v))]
                open_ = np.zeros((len(q), len(model.centres)), bool)
                for row, c in enumerate(met[at : at + len(q)]):
                    open_[row, c] = True
                near = np.where(open_[:, cell], model.approximate(q, cell, codes), -np.inf)
                last = np.partition(near, max(0, near.shape[1] - k - 1), axis=1)[:, max(0, near.shape[1] - k - 1)]
                # whatever the margin lets belong to the k best and the query itself: no fixed number
                row, col = np.nonzero((near >= (last - model.margin)[:, None]) & np.isfinite(near))
                score = np.concatenate([np.einsum("ij,ij->i", q[row[a : a + STEP // 8]], v[col[a : a + STEP // 8]]) for a in range(0, len(row), STEP // 8)] or [np.zeros(0)])
                best = _leading(row, score, col, k + 1, ties=True)
                row, col, score = row[best], col[best], score[best]
                n = many[col]
                row, score = np.repeat(row, n), np.repeat(score, n)
                found = ids[np.repeat(start[col], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                other = found != own[row]
                row, score, found = row[other], score[other], found[other]
                best = _leading(row, score, found, k, ties=False)
                out.append(pd.DataFrame({"query_id": own[row[best]], "vec_id": found[best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    return index.groupBy("block", "part").cogroup(probes.groupBy("block", "part")).applyInPandas(scored, "query_id long, vec_id long, score double")


def _leading(row: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int, ties: bool) -> np.ndarray:
    """Positions of each row's ``k`` best scores, equal ones by ``tie``; with ``ties``, of all that equal the last of them."""
    at = np.lexsort((tie, -score, row))
    row, score = row[at], score[at]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(start, len(row)))
    kept = np.arange(len(row)) - np.repeat(start, size) < k
    if ties:
        kept |= score >= np.repeat(score[start + np.minimum(size, k) - 1], size)
    return at[kept]


def _blocks(cells: int, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell: small cells share a block, large ones have several."""
    first, parts = np.zeros(cells, np.int64), np.ones(cells, np.int64)
    block, held = 0, 0
    for cell in range(cells):
        size = sizes.get(cell, 0)
        if held and held + size > BLOCK_ROWS:
            block, held = block + 1, 0
        first[cell], parts[cell] = block, max(1, -(-size // BLOCK_ROWS))
        if size > BLOCK_ROWS:
            block, held = block + int(parts[cell]), 0
        else:
            held += size
    return first, parts


def op2_ivf_pq_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all others."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(table, table.where("vec_id % 20 = 0"))
