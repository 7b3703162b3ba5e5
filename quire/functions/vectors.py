"""Scoring of Arrow batches of vectors against queries, and the arithmetic of vector cells."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# distances closer than this are treated as equal, so that copies rank by id on every machine
DISTANCE_DIGITS = 9
_PENDING_ROWS = 50_000
_SCORED_ROWS = 4096
_MATRIX_VALUES = 1 << 22  # of distances held at a time


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """List column as a float64 matrix; every list has ``width`` values."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def rows_at_a_time(width: int) -> int:
    """Rows of a matrix of ``width`` columns that are worked on at a time."""
    return max(1, min(_SCORED_ROWS, _MATRIX_VALUES // max(width, 1)))


class TopK:
    """The k nearest rows (cosine distance, then id) of each query, over batches of rows.

    Memory: one distance matrix of bounded size and the kept rows; pairs that cannot enter the k best
    are never built.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.units, self.k = unit_rows(queries), k
        self.limit = np.full(len(queries), np.inf)  # distance a row must not exceed to matter
        self.kept: pa.Table | None = None
        self.pending: list[pa.Table] = []
        self.waiting = 0

    def add(self, vectors: np.ndarray, rows: pa.Table) -> None:
        """``rows`` are carried along, one for each of ``vectors``; they have a column ``id``."""
        step = rows_at_a_time(len(self.units))
        for at in range(0, len(vectors), step):
            self._add(vectors[at : at + step], rows.slice(at, step))

    def _add(self, vectors: np.ndarray, rows: pa.Table) -> None:
        distance = np.round(1.0 - unit_rows(vectors) @ self.units.T, DISTANCE_DIGITS) + 0.0  # no negative zero
        id_place = np.empty(len(vectors), dtype=np.int64)
        id_place[pc.sort_indices(rows.column("id")).to_numpy()] = np.arange(len(vectors))
        places, numbers = [], []
        for q in np.flatnonzero(distance.min(axis=0) <= self.limit):
            found = np.flatnonzero(distance[:, q] <= self.limit[q])
            if len(found) > self.k:
                found = found[np.lexsort((id_place[found], distance[found, q]))[: self.k]]
            places.append(found)
            numbers.append(np.full(len(found), q, dtype=np.int64))
        if not places:
            return
        place, query = np.concatenate(places), np.concatenate(numbers)
        hits = rows.take(pa.array(place)).append_column("query_no", pa.array(query))
        self.pending.append(hits.append_column("distance", pa.array(distance[place, query])))
        self.waiting += len(place)
        if self.kept is None or self.waiting >= _PENDING_ROWS or not np.isfinite(self.limit).all():
            self._settle()

    def _settle(self) -> None:
        rows = pa.concat_tables(([self.kept] if self.kept is not None else []) + self.pending)
        rows = rows.sort_by([("query_no", "ascending"), ("distance", "ascending"), ("id", "ascending")])
        query = rows.column("query_no").to_numpy()
        starts = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.array([], dtype=int)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        self.kept = rows.filter(pa.array(place < self.k))
        self.pending, self.waiting = [], 0
        query, distance = self.kept.column("query_no").to_numpy(), self.kept.column("distance").to_numpy()
        full = np.bincount(query, minlength=len(self.units)) >= self.k
        worst = np.full(len(self.units), -np.inf)
        np.maximum.at(worst, query, distance)
        self.limit[full] = worst[full]

    def best(self) -> pa.Table | None:
        """The kept rows with query_no and distance; None without any row."""
        if self.pending:
            self._settle()
        return self.kept


def top_k_slots(width: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by slot and, in a slot, queries before documents: each slot's k nearest rows per query.

    Columns: slot, asked (a query's vector, else null), query_id, embedding (a document's vector, else null), and the
    columns carried for documents. A slot's queries are held, its documents pass by batch after batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, scorer = None, None
        vectors: list[np.ndarray] = []
        ids: list[pa.Array] = []

        def close() -> Iterator[pa.RecordBatch]:
            best = scorer.best() if scorer else None
            if best is not None:
                named = pa.concat_arrays(ids).take(best.column("query_no").combine_chunks())
                best = best.drop_columns(["query_no"]).append_column("query_id", named)
                yield from best.combine_chunks().to_batches()

        for batch in batches:
            numbers = batch.column("slot").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(numbers)) + 1, len(numbers)] if len(numbers) else [0]
            for begin, end in zip(edges[:-1], edges[1:]):
                if numbers[begin] != slot:
                    yield from close()
                    slot, scorer, vectors, ids = numbers[begin], None, [], []
                part = batch.slice(begin, end - begin)
                n = len(part) - part.column("asked").null_count  # queries come first
                if n:
                    vectors.append(matrix_of(part.column("asked").slice(0, n), width))
                    ids.append(part.column("query_id").slice(0, n))
                if n < len(part) and vectors:
                    scorer = scorer or TopK(np.concatenate(vectors), k)
                    docs = part.slice(n)
                    rows = pa.Table.from_batches([docs]).drop_columns(["slot", "asked", "query_id", "embedding"])
                    scorer.add(matrix_of(docs.column("embedding"), width), rows)
        yield from close()

    return run


def euclidean(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of every row to every centre."""
    squared = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squared, 0))


def centres_of(rows: np.ndarray, count: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of at most ``count`` cells by Lloyd's rounds over a bounded sample, from seeded distinct rows."""
    distinct = np.unique(rows, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:count]]
    for _ in range(rounds):
        nearest = np.concatenate([euclidean(rows[at : at + _SCORED_ROWS], centres).argmin(axis=1) for at in range(0, len(rows), _SCORED_ROWS)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        held = np.bincount(nearest, minlength=len(centres))
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres
