"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.llm.graph import components, forest, in_chunks
from boxlore.llm.store import fresh_name
from boxlore.llm.texts import U64, Slice, mix, shingle_sets, slices
from boxlore.session import Scratch

SHINGLE = 5
CHUNK = 1024


def super_minhash(doc: np.ndarray, h: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n, m) of the sets given as sorted (text number, element hash).

    Element e visits the slots in its own random order; its value in the slot it visits in step j
    lies in [j, j+1). So once every slot of a set is taken in step j, later steps cannot lower
    any value, and the set stops. Values are fixed point: step in the top bits.
    """
    bits = max((m - 1).bit_length(), 1)
    never = U64(2**64 - 1)
    flat = np.full(n * m, never, U64)
    row, e = doc, h
    order = None
    for j in range(m):
        fraction = mix(e, 2 * j + 1) >> U64(bits)
        pick = (j + (((mix(e, 2 * j + 2) >> U64(32)) * U64(m - j)) >> U64(32)).astype(np.int64)).astype(np.int64)
        at = np.arange(len(e))
        if order is None:
            slot = pick
        else:
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, j]
            order[:, j] = slot
        np.minimum.at(flat, row * m + slot, (U64(j) << U64(64 - bits)) | fraction)
        empty = (flat.reshape(n, m) == never).any(axis=1)
        going = empty[row]
        if not going.any():
            break
        if order is None:
            row, e, pick = row[going], e[going], pick[going]
            order = np.tile(np.arange(m, dtype=np.int16), (len(e), 1))
            order[:, 0] = pick
            order[np.arange(len(e)), pick] = np.where(pick == 0, pick, 0)
        elif not going.all():
            row, e, order = row[going], e[going], order[going]
    return flat.reshape(n, m)


def _signatures(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20):
            n = len(part)
            doc, h = shingle_sets(part, SHINGLE)
            size = np.bincount(doc, minlength=n)
            key = np.zeros((2, n), U64)
            np.add.at(key[0], doc, mix(h, 101))
            np.add.at(key[1], doc, mix(h, 202))
            sig = super_minhash(doc, h, n, bands * rows).reshape(n, bands, rows)
            band = np.zeros((n, bands), U64)
            for r in range(rows):
                band = mix(band + sig[:, :, r], r + 1)
            band = mix(band + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(band.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.ids), pa.array(size.astype(np.int64)), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), lists],
                names=["id", "n", "k1", "k2", "bands"],
            )

    return run


def _verify(percent: int):
    """Links within two chunks of one candidate group, by exact set sizes; a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0] if table.num_rows else None
        out = ([], [])
        if batch is not None and batch.num_rows > 1:
            batch = batch.take(pa.compute.sort_indices(batch.column("id")))
            sets = [shingle_sets(p, SHINGLE) for p in [Slice(*_whole(batch))]][0]
            doc, h = sets
            ids = batch.column("id").to_numpy()
            chunk = batch.column("c").to_numpy()
            first, second = int(batch.column("i")[0].as_py()), int(batch.column("j")[0].as_py())
            size = np.bincount(doc, minlength=len(ids))
            order = np.lexsort((doc, h))
            hs, ds = h[order], doc[order]
            begin = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
            length = np.diff(np.r_[begin, len(hs)])
            number = np.empty(len(h), np.int64)
            number[order] = np.repeat(np.arange(len(begin)), length)
            shared = length[number] > 1
            doc, number = doc[shared], number[shared]
            edge = np.searchsorted(doc, np.arange(len(ids) + 1))
            a, b = [], []
            for i in np.flatnonzero(chunk == first):
                mine = number[edge[i] : edge[i + 1]]
                if not len(mine):
                    continue
                many = length[mine]
                at = np.repeat(begin[mine] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                both = np.bincount(ds[at], minlength=len(ids))
                hit = 100 * both >= percent * (size + size[i] - both)
                hit &= both > 0
                hit &= (chunk == second) if first != second else (np.arange(len(ids)) > i)
                to = np.flatnonzero(hit)
                a.append(np.full(len(to), i))
                b.append(to)
            if a:
                label = forest(len(ids), np.concatenate(a), np.concatenate(b))
                linked = np.flatnonzero(label != np.arange(len(ids)))
                out = (ids[linked], ids[label[linked]])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = next(slices([batch], 1 << 62, "id"))
    return part.ids, part.buf, part.off


def groups(docs: DataFrame, own: Scratch, percent: int = 80, bands: int = 32, rows: int = 4, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per document: ``key, n_shingles, component_id, kept`` under 100 * shared >= ``percent`` * union.

    ``key`` is unique; other columns are ignored. Sets are the distinct five-word shingles of the
    whole lower-cased text (64-bit hashes of them). Null, empty and blank texts have an empty set
    and link with nothing. Rows with a null key get no result; rows that share a key each get one.

    Equal sets are one class from here on, so copies never meet in pairs. Classes that share a
    band are candidates; bands are chained by union-find, and inside a candidate group all full
    sets are compared, chunk against chunk, by an inverted index: no candidate is capped. With
    similarity s a linked pair shares no band with probability (1 - s**rows)**bands: at the limits,
    below 1e-7 for (80, 32, 4) and below 1e-6 for (85, 25, 5), and a group needs only one chain.
    """
    base = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    marks = own.keep(base.mapInArrow(_signatures(bands, rows), "id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"))
    classes = marks.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("head"), F.first("bands").alias("bands"))
    band = own.keep(classes.select("head", F.explode("bands").alias("band")))
    first = band.groupBy("band").agg(F.min("head").alias("a"), F.max("head").alias("z")).where("a < z").select("band", "a")
    maybe = components(band.join(first, "band").select("a", F.col("head").alias("b")), own)
    chunks = in_chunks(maybe, ["component"], "id", chunk).select("id", F.col("component").alias("g"), "_c", "_n")
    # One plan at every size: a broadcast of the candidates would give way to this merge as they grow.
    told = chunks.hint("merge").join(base, F.col("doc_id") == F.col("id")).select(
        "g", "id", "text", F.col("_c").alias("c"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("o")
    )
    told = told.select("g", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "id", "text")
    found = own.keep(told.groupBy("g", "i", "j").applyInArrow(_verify(percent), "a bigint, b bigint"))
    joined = components(found, own).select(F.col("id").alias("head"), "component")
    heads = marks.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("head")).join(joined, "head", "left")
    full = marks.drop("bands").join(heads, ["k1", "k2", "n"], "left")
    component = F.coalesce("component", "head", "id")
    return full.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def keep_first(docs: DataFrame, own: Scratch, percent: int = 80, key: str = "doc_id", **how: object) -> DataFrame:
    """The documents that open their group, and those without a key; all columns as they were."""
    name = fresh_name(docs, "later")
    later = groups(docs, own, percent, key=key, **how).where("NOT kept").select(F.col(key).alias(name))
    return docs.join(later.hint("merge"), docs[key] == later[name], "left_anti")
