"""Exact top-k search by integer inner products with block-at-a-time pruning.

Components become floor(scale * x). Vectors are put in an order that keeps like
signs together and cut into blocks of consecutive rows; a block has a forward
index (the matrix of its rows) and every dimension's least and greatest value,
and so has a page of consecutive blocks. A query's bound for either sums, over its
dimensions, the larger of its component's products with the two.

Each query starts from the k-th score within its own block, which is found while
blocks are built. Batches of queries first meet sheets, small tables of pages'
bounds, never the pages. Each query then visits its best page, which raises its
k-th score, and after that only the pages whose bounds reach it, and only it
travels there. A visit takes a page's blocks by falling bound and scores them
until no bound reaches the k-th; at an equal score a larger id than the k-th's
does not count.

Vectors that are null or hold null or non-finite components take no part, nor
do those of another length than the query's. Rows that carry a query's id are the
query's own. Equal scores rank by smaller id; repeated rows are candidates each,
and a query row that repeats (with an id or without) is one query each, told
apart by its vector. A component beyond the range of doubles once scaled is held
at its ends, and a score beyond 64 bits at theirs. An empty table has no result rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galvana.llm.lsh_dedup import vectors
from galvana.shared import bounded_batches, cut

BLOCK_ROWS, PAGE_BLOCKS, BATCH_QUERIES = 256, 16, 256
#: Pages of a sheet, batches that meet a sheet in one task, and batches' parts that meet a page in one task.
SHEET_PAGES, GROUP_BATCHES, LANE_PARTS = 512, 64, 16

_PACKED = "kind string, dimension int, n int, ids binary, matrix binary, least binary, greatest binary, floor binary, floor_id binary, names array<string>"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: in double precision where that holds every sum, else in Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max())
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])  # components are finite
    return np.clip(exact(a).dot(exact(b).T), -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k greatest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores), axis=-1)[:, :k]


_LOW = np.iinfo(np.int64).min + 1
_NO_ID = np.iinfo(np.int64).max
_MOST = np.finfo(np.float64).max


def _pack(scale: int, k: int, block_rows: int, page_blocks: int):
    """Pages of blocks and batches of queries out of one partition's ordered rows."""

    def pack(kind, ids, rows, floor=None, names=None):
        floor_id = None if floor is None else np.full(len(ids), _NO_ID)
        cut_at = np.arange(0, len(ids), block_rows)
        least = np.minimum.reduceat(rows, cut_at, axis=0) if kind == "page" else None
        greatest = np.maximum.reduceat(rows, cut_at, axis=0) if kind == "page" else None
        raw = [None if x is None else x.tobytes() for x in (ids, rows, least, greatest, floor, floor_id)]
        return (kind, rows.shape[1], len(ids), *raw, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        asked: dict[int, list] = {}
        own_id, own_names = None, set()  # a query row that repeats follows at once, but for others of its id

        def batch_of(rows):
            return pack("batch", np.array([x[0] for x in rows], np.int64), np.stack([x[1] for x in rows]), np.array([x[2] for x in rows], np.int64), [x[3] for x in rows])

        def close_block(d):
            """The queries of the block that ends here get their floors from it."""
            block = held[d][-(((len(held[d]) - 1) % block_rows) + 1) :]
            queries = [x for x in block if x[2]]
            if queries:
                ids, rows = np.array([x[0] for x in block], np.int64), np.stack([x[1] for x in block])
                own = np.array([x[0] for x in queries], np.int64)
                scores = products(np.stack([x[1] for x in queries]), rows)
                scores[ids[None, :] == own[:, None]] = _LOW
                floor = np.sort(scores, axis=1)[:, -k] if len(block) >= k else np.full(len(queries), _LOW)
                asked.setdefault(d, []).extend((x[0], x[1], f, x[3]) for x, f in zip(queries, floor, strict=True))

        def close_page(d):
            page = held.pop(d)
            return pack("page", np.array([x[0] for x in page], np.int64), np.stack([x[1] for x in page]))

        def out(rows):
            return pa.RecordBatch.from_pylist(
                [dict(zip(("kind", "dimension", "n", "ids", "matrix", "least", "greatest", "floor", "floor_id", "names"), r, strict=True)) for r in rows],
                schema=pa.schema([("kind", pa.string()), ("dimension", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "matrix", "least", "greatest", "floor", "floor_id")), ("names", pa.list_(pa.string()))]),
            )

        for batch in batches:
            done = []
            found = vectors(batch.column("embedding"))
            for x, i, query in zip(found, batch.column("vec_id").to_pylist(), batch.column("is_query").to_pylist(), strict=True):
                if x is None or not len(x):
                    continue
                d, own = len(x), _NO_ID if i is None else i
                name = hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() if query else None
                if query:
                    if own != own_id:
                        own_id, own_names = own, set()
                    query = name not in own_names
                    own_names.add(name)
                with np.errstate(over="ignore"):
                    scaled = np.clip(np.floor(scale * x), -_MOST, _MOST)
                held.setdefault(d, []).append((own, scaled, bool(query), name))
                if len(held[d]) % block_rows == 0:
                    close_block(d)
                if len(held[d]) == block_rows * page_blocks:
                    done.append(close_page(d))
                while len(asked.get(d, [])) >= BATCH_QUERIES:
                    done.append(batch_of(asked[d][:BATCH_QUERIES]))
                    asked[d] = asked[d][BATCH_QUERIES:]
            if done:
                yield out(done)
        done = []
        for d in list(held):
            if len(held[d]) % block_rows:
                close_block(d)
            done.append(close_page(d))
        done += [batch_of(rows) for rows in asked.values() if rows]
        if done:
            yield out(done)

    return run


def _matrix(row, name: str) -> np.ndarray:
    return np.frombuffer(row[name], np.float64).reshape(-1, row["dimension"])


def _int64(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _bounds(queries: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """No row between ``least`` and ``greatest`` scores more with a query; a row for each query."""
    return products(np.maximum(queries, 0), greatest) + products(np.minimum(queries, 0), least)


def search_page(page: dict, batch: dict, k: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (a row for each query, k columns) of all that a page's blocks add to a batch's ranks; ``_LOW`` fills up."""
    rows, ids = _matrix(page, "matrix"), _int64(page["ids"])
    queries, own = _matrix(batch, "matrix"), _int64(batch["ids"])
    n = len(queries)
    bound = _bounds(queries, _matrix(page, "least"), _matrix(page, "greatest"))
    floor, floor_id = _int64(batch["floor"]).copy(), _int64(batch["floor_id"]).copy()
    top, top_ids = np.full((n, k), _LOW), np.full((n, k), _NO_ID)
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(bound.shape[1]):
        block = order[:, turn]
        alive = bound[np.arange(n), block] >= floor
        if not alive.any():
            break
        for b in np.unique(block[alive]).tolist():
            asks = np.flatnonzero(alive & (block == b))
            a, z = b * block_rows, min((b + 1) * block_rows, len(ids))
            scores = products(queries[asks], rows[a:z])
            scores[ids[None, a:z] == own[asks][:, None]] = _LOW
            gains = scores.max(axis=1) >= floor[asks]
            asks, scores = asks[gains], scores[gains]
            if not len(asks):
                continue
            both = np.concatenate([top[asks], scores], axis=1)
            both_ids = np.concatenate([top_ids[asks], np.broadcast_to(ids[a:z], scores.shape)], axis=1)
            keep = best(both, both_ids, k)
            top[asks], top_ids[asks] = np.take_along_axis(both, keep, 1), np.take_along_axis(both_ids, keep, 1)
            last, last_id = top[asks, -1], top_ids[asks, -1]
            better = (last > floor[asks]) | (last == floor[asks]) & (last > _LOW) & (last_id < floor_id[asks])
            floor[asks[better]], floor_id[asks[better]] = last[better], last_id[better]
    out = (top < floor[:, None]) | (top == floor[:, None]) & (top_ids > floor_id[:, None])
    top[out] = _LOW
    return top, top_ids


def _sheets(sheet_pages: int):
    """Bounds of whole pages, many in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def sheet(d: int) -> dict:
            number, least, greatest = zip(*held.pop(d), strict=True)
            return {"dimension": d, "pages": np.array(number, np.int64).tobytes(), "least": b"".join(least), "greatest": b"".join(greatest)}

        kinds = pa.schema([("dimension", pa.int32()), ("pages", pa.binary()), ("least", pa.binary()), ("greatest", pa.binary())])
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                d = row["dimension"]
                held.setdefault(d, []).append((row["page"], _matrix(row, "least").min(axis=0).tobytes(), _matrix(row, "greatest").max(axis=0).tobytes()))
                if len(held[d]) == sheet_pages:
                    done.append(sheet(d))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kinds)
        if held:
            yield pa.RecordBatch.from_pylist([sheet(d) for d in list(held)], schema=kinds)

    return run


_BOUNDS = pa.schema([("number", pa.int64()), ("page", pa.binary()), ("bound", pa.binary())])
_VISITS = pa.schema([("page", pa.int64()), ("number", pa.int64()), ("asks", pa.binary())])


def _best_pages(sheets: pa.Table, batches: pa.Table) -> pa.Table:
    """Each query's page of greatest bound in each sheet (of equal ones the first), by batches."""
    out = []
    for batch in batches.to_pylist():
        queries = _matrix(batch, "matrix")
        for sheet in sheets.to_pylist():
            bound, pages = _bounds(queries, _matrix(sheet, "least"), _matrix(sheet, "greatest")), _int64(sheet["pages"])
            at = np.lexsort((np.broadcast_to(pages, bound.shape), -bound), axis=-1)[:, 0]
            out.append({"number": batch["number"], "page": pages[at].tobytes(), "bound": bound[np.arange(len(at)), at].tobytes()})
    return pa.Table.from_pylist(out, schema=_BOUNDS)


def _visits(number: int, page: np.ndarray) -> Iterator[dict]:
    for p in np.unique(page).tolist():
        yield {"page": p, "number": number, "asks": np.flatnonzero(page == p).astype(np.uint16).tobytes()}


def _first_visits(rows: pa.Table) -> pa.Table:
    """Of one batch: the visits of its queries to their best pages."""
    bound, page = (np.stack([_int64(x) for x in rows[c].to_pylist()]) for c in ("bound", "page"))
    at = np.lexsort((page, -bound), axis=0)[0]
    return pa.Table.from_pylist(list(_visits(rows["number"][0].as_py(), page[at, np.arange(len(at))])), schema=_VISITS)


def _later_visits(sheets: pa.Table, batches: pa.Table) -> pa.Table:
    """Visits of queries to the pages whose bounds reach their k-th scores."""
    out = []
    for batch in batches.to_pylist():
        queries, floor = _matrix(batch, "matrix"), _int64(batch["floor"])
        for sheet in sheets.to_pylist():
            alive = _bounds(queries, _matrix(sheet, "least"), _matrix(sheet, "greatest")) >= floor[:, None]
            pages = _int64(sheet["pages"])
            for p in np.flatnonzero(alive.any(axis=0)).tolist():
                out.append({"page": int(pages[p]), "number": batch["number"], "asks": np.flatnonzero(alive[:, p]).astype(np.uint16).tobytes()})
    return pa.Table.from_pylist(out, schema=_VISITS)


_ASKED = "page long, number long, asks binary, dimension int, ids binary, matrix binary, floor binary, floor_id binary, names array<string>"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of a batch that visits a page."""
    for batch in batches:
        for row in batch.to_pylist():
            at = np.frombuffer(row["asks"], np.uint16)
            part = {c: _int64(row[c])[at].tobytes() for c in ("ids", "floor", "floor_id")}
            yield pa.RecordBatch.from_pylist([row | part | {"matrix": _matrix(row, "matrix")[at].tobytes(), "names": [row["names"][k] for k in at.tolist()]}], schema=batch.schema)


def _visit(pages: DataFrame, batches: DataFrame, visits: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over each page and the parts of batches that visit it; a page that many visit goes to several tasks."""
    lanes = visits.groupBy("page").agg(F.ceil(F.count("*") / F.lit(LANE_PARTS)).cast("int").alias("lanes"))
    asked = visits.join(batches, "number").select("page", "number", "asks", "dimension", "ids", "matrix", "floor", "floor_id", "names").mapInArrow(_asked, _ASKED)
    asked = asked.join(lanes, "page").withColumn("lane", F.pmod(F.xxhash64("number"), "lanes").cast("int")).drop("lanes")
    dealt = pages.join(lanes, "page").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")
    return dealt.groupBy("page", "lane").cogroup(asked.groupBy("page", "lane")).applyInArrow(run, schema)


def _floors(k: int, block_rows: int):
    """Each visiting query's k-th score and id in the page."""

    def run(pages: pa.Table, batches: pa.Table) -> pa.Table:
        out = []
        for page in pages.to_pylist():
            for batch in batches.to_pylist():
                top, ids = search_page(page, batch, k, block_rows)
                out.append({"number": batch["number"], "asks": batch["asks"], "floor": top[:, -1].tobytes(), "floor_id": ids[:, -1].tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("number", pa.int64()), ("asks", pa.binary()), ("floor", pa.binary()), ("floor_id", pa.binary())]))

    return run


def _raised(batches: pa.Table, floors: pa.Table) -> pa.Table:
    """One batch with the floors that its first visits have found."""
    floor, floor_id = _int64(batches["floor"][0].as_py()).copy(), np.full(batches["n"][0].as_py(), _NO_ID)
    for row in floors.to_pylist():
        at, own, own_id = np.frombuffer(row["asks"], np.uint16), _int64(row["floor"]), _int64(row["floor_id"])
        reached = own > _LOW  # the page had k rows at or above the floor before
        floor[at[reached]], floor_id[at[reached]] = own[reached], own_id[reached]
    out = batches.drop_columns(["floor", "floor_id", "n"])
    for column, value in (("floor", floor), ("floor_id", floor_id)):
        out = out.append_column(column, pa.array([value.tobytes()], pa.binary()))
    return out


def _found(k: int, block_rows: int):
    """All that a page adds to the ranks of the queries that visit it."""

    def run(pages: pa.Table, batches: pa.Table) -> pa.Table:
        name, query, vec, score = [], [], [], []
        for page in pages.to_pylist():
            for batch in batches.to_pylist():
                top, ids = search_page(page, batch, k, block_rows)
                q, r = np.nonzero(top > _LOW)
                own = _int64(batch["ids"])
                name += [batch["names"][x] for x in q.tolist()]
                query.append(own[q])
                vec.append(ids[q, r])
                score.append(top[q, r])
        whole = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (query, vec, score)]
        return pa.table({"name": pa.array(name, pa.string()), "query_id": whole[0], "vec_id": whole[1], "score": whole[2]})

    return run


def topk_search(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = BLOCK_ROWS, page_blocks: int = PAGE_BLOCKS, sheet_pages: int = SHEET_PAGES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``embeddings`` that is a query, against all rows."""
    bounded_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    # Signs of the first components: neighbours in this order share them.
    sign = F.transform(F.slice("embedding", 1, 12), lambda x: F.when(x > 0, "1").otherwise("0"))
    ordered = rows.withColumn("sign", F.array_join(sign, ""))
    n = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(n, "sign", "vec_id").sortWithinPartitions("sign", "vec_id").select("vec_id", "embedding", "is_query")
    packed = cut(ordered.mapInArrow(_pack(scale, k, block_rows, page_blocks), _PACKED).withColumn("number", F.monotonically_increasing_id()), "blocks")
    pages = packed.where("kind = 'page'").select("dimension", F.col("number").alias("page"), "ids", "matrix", "least", "greatest")
    batches = packed.where("kind = 'batch'").select("number", "dimension", "ids", "matrix", "names", "floor", "floor_id", "n")
    sheets = cut(pages.select("dimension", "page", "least", "greatest").mapInArrow(_sheets(sheet_pages), "dimension int, pages binary, least binary, greatest binary").withColumn("sheet", F.monotonically_increasing_id()), "sheets")

    def meet(asking: DataFrame, run, schema: str) -> DataFrame:
        """Groups of batches against each sheet of their dimension."""
        # Broadcast: a row for each length of vectors, and one for each sheet (about two million vectors).
        groups = F.broadcast(asking.groupBy("dimension").agg(F.ceil(F.count("*") / F.lit(GROUP_BATCHES)).cast("int").alias("groups")))
        dealt = asking.join(groups, "dimension").withColumn("group", F.pmod(F.xxhash64("number"), "groups").cast("int")).drop("groups")
        copies = sheets.join(groups, "dimension").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        dealt = dealt.join(F.broadcast(sheets.select("dimension", F.col("sheet").alias("_sheet"))), "dimension")
        return copies.groupBy("sheet", "group").cogroup(dealt.groupBy("_sheet", "group")).applyInArrow(run, schema)

    bounds = meet(batches, _best_pages, "number long, page binary, bound binary")
    first = cut(bounds.groupBy("number").applyInArrow(_first_visits, "page long, number long, asks binary"), "first")
    floors = _visit(pages, batches, first, _floors(k, block_rows), "number long, asks binary, floor binary, floor_id binary")
    raised = batches.groupBy("number").cogroup(floors.groupBy("number")).applyInArrow(_raised, "number long, dimension int, ids binary, matrix binary, names array<string>, floor binary, floor_id binary")
    raised = cut(raised, "raised")
    later = cut(meet(raised, _later_visits, "page long, number long, asks binary"), "later")
    found = _visit(pages, raised, later, _found(k, block_rows), "name string, query_id long, vec_id long, score long")
    ranks = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranks))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(_NO_ID)).alias("vec_id"), "score")
    )


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    return topk_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0))
WHERE rank <= 20
"""
