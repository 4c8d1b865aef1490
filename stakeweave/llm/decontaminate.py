"""Benchmark decontamination by latent semantic retrieval.

1. Every document is written once as the numbers of its words. The document frequencies of the benchmark's words over all
   documents give their IDF.
2. The passages of all documents and all benchmark items (each item WEIGHT times for every PER documents)
   make a TF-IDF matrix A. A randomised SVD finds its leading right singular vectors: random vectors are
   multiplied by A'A, part by part on the executors, and orthonormalised, PASSES times. Items of which these
   vectors hold less than SHARE of the norm add what is missing as directions of their own, so their cosine is exact.
3. Every passage of every document (WINDOWS of blocks of STEP words) is folded into that space and compared
   with all items of a block of the benchmark: the product with the item's unit latent vector over the
   passage's whole TF-IDF norm, words outside the benchmark included. From `cosine` on it is a candidate.
4. A candidate is confirmed on the words themselves: the longest common subsequence of item and passage must
   cover `verbatim` of the item, or `paraphrase` of it with `answer` of the item's answer words (its rarest third) there.

The benchmark is a stated query set, taken in blocks of about ITEMS items (fewer where they are long), which RANK vectors can tell
apart; a scan of the documents, each fitted on and searched whole, serves BLOCKS of them.
Null and empty texts and items match nothing; documents that repeat are each reported, so rows that share a doc_id are rows of the
result as often as their texts match; rows with null ids are not
searched, having nothing to be reported by. Items that share an id are searched each and reported under it. Of equally good places in a document
the last one is given. No documents or no items give an empty result. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mapped, stored

RANK, EXTRA, PASSES, WEIGHT, PER, SHARE = 96, 8, 3, 8.0, 2048, 0.5
ITEMS, ITEM_BYTES, BLOCKS = 200, 1 << 17, 16
STEP, WINDOWS, PASSAGE, BATCH, CHUNK, FEW = 12, (2, 4), 36, 4096, 32, 512
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.18, 0.75, 0.45, 0.3
WORD, ODD = re.compile(r"\w+"), re.compile(r"[^\x00-\x7f\w]")
SPACED = bytes(c if c >= 128 or chr(c).isalnum() or c == ord("_") else 32 for c in range(256))
FOUND = "doc_id long, item_id long, lcs double, cosine double, answer double, place long, kind string"


def words(text: str | None) -> list[bytes]:
    """The runs of word characters of the lower-cased text, in UTF-8."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii() and ODD.search(low):  # separators beyond ASCII
        low = " ".join(WORD.findall(low))
    return low.encode("utf-8", "surrogatepass").translate(SPACED).split()


def ids_of(own: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Ids from 1; 0 for words that the benchmark block lacks."""
    return np.fromiter(map(known.get, own, repeat(0)), np.int32, len(own))


def numbers(known: list[bytes]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(known, 1)}


def in_numbers(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """(doc_id, ids): each document's words as numbers from 1, 0 for unknown ones, in as few bytes as the known words need."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(numbers(known)), id_type(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [ids_of(words(t), known).astype(kind).tobytes() for t in batch["text"]]})

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def id_type(known: list[bytes]) -> type:
    return np.uint16 if len(known) < 1 << 16 else np.uint32


def frequencies(numbered: DataFrame, known: list[bytes]) -> tuple[int, np.ndarray]:
    """Documents, and documents with each known word (index 0: none)."""
    size, kind = len(known) + 1, id_type(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += len(batch)
            for ids in batch["ids"]:
                total[np.unique(np.frombuffer(ids, kind))] += 1
        total[0] = n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"word": at, "n": total[at]})

    rows = mapped(numbered.select("ids"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["word"].to_numpy(int)] = rows["n"].to_numpy(int)
    return int(out[0]), out


def passages(ids: np.ndarray) -> np.ndarray:
    """Rows of the PASSAGE words of each passage, sorted; -1 fills the last."""
    rows = np.full((-(-len(ids) // PASSAGE), PASSAGE), -1, np.int32)
    rows.ravel()[: len(ids)] = ids
    rows.sort(axis=1)
    return rows


def gram(rows: np.ndarray, idf: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """Add A'A basis to out, for the unit TF-IDF vectors A of passages; words outside the benchmark (0) count in the norm only."""
    rows, basis = rows[rows[:, -1] > 0], basis.astype(np.float32, copy=False)
    number = np.zeros(len(idf), np.intp)
    for cut in range(0, len(rows), BATCH):
        part = rows[cut : cut + BATCH]
        first = np.ones(part.shape, bool)
        first[:, 1:] = part[:, 1:] != part[:, :-1]
        at = np.flatnonzero(first)
        n, w, p = np.diff(at, append=part.size), part.ravel()[at], at // PASSAGE
        x = np.where(w < 0, 0, n * idf[np.maximum(w, 0)])
        norm = np.sqrt(np.bincount(p, x * x, len(part)))
        keep = (w > 0) & (norm[p] > 0)
        w, p = w[keep], p[keep]
        x = (x[keep] / norm[p]).astype(np.float32)
        own, near = numbered_again(w, number)
        mine, total = basis[own], np.zeros((len(own), basis.shape[1]), np.float32)
        ends = np.searchsorted(p, np.arange(0, len(part) + CHUNK, CHUNK))
        for begin, low, high in zip(range(0, len(part), CHUNK), ends[:-1], ends[1:], strict=True):
            few, to = numbered_again(near[low:high], number)
            a = np.zeros((CHUNK, len(few)), np.float32)
            a[p[low:high] - begin, to] = x[low:high]
            total[few] += a.T @ (a @ mine[few])
        out[own] += total


def numbered_again(w: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in w, in order, and the place of each of w among them; number is room for as many as there can be."""
    own = np.flatnonzero(np.bincount(w, minlength=1))
    number[own] = np.arange(len(own))
    return own, number[w]


def latent_bases(numbered: DataFrame, n: int, places: list[np.ndarray], items: list[list[np.ndarray]], idfs: list[np.ndarray], kind: type, rank: int, seed: int = 11) -> list[np.ndarray]:
    """For each block (words + 1) x rank: leading right singular vectors of all n documents' and the items' passages. `places` are
    the blocks' numbers of the numbered words. One pass over the documents serves all blocks."""
    sc = numbered.sparkSession.sparkContext
    bases = []
    for idf in idfs:
        basis = np.random.default_rng(seed).standard_normal((len(idf), min(rank + EXTRA, len(idf) - 1)))
        basis[0] = 0
        bases.append(basis)
    weight = WEIGHT * max(1.0, n / PER)  # of an item against a passage
    for turn in range(PASSES):
        bases = [np.linalg.qr(basis)[0] for basis in bases]
        sent = sc.broadcast((places, idfs, bases))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            places, idfs, bases = sent.value
            totals, held, rows = [np.zeros_like(b) for b in bases], 0, []
            bases = [b.astype(np.float32) for b in bases]
            ordered = [bool((np.diff(place) >= 0).all()) for place in places]

            def count() -> None:
                every = np.concatenate(rows)
                for place, kept, idf, basis, total in zip(places, ordered, idfs, bases, totals, strict=True):
                    own = np.append(place, -1)[every]
                    # where places keeps no order among words, a passage is sorted by its numbers in the block
                    gram(own if kept else np.sort(own, axis=1), idf, basis, total)

            for batch in batches:
                for ids in batch["ids"]:
                    rows.append(passages(np.frombuffer(ids, kind)))
                    held += len(rows[-1])
                    if held > BATCH:
                        count()
                        held, rows = 0, []
            if rows:
                count()
            cuts = [(b, c) for b, total in enumerate(totals) for c in range(0, len(total), 256)]
            yield pd.DataFrame({"block": [b for b, _ in cuts], "part": [c // 256 for _, c in cuts], "rows": [totals[b][c : c + 256].tobytes() for b, c in cuts]})

        def add(group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in group["rows"])
            return pd.DataFrame({"block": group["block"][:1], "part": group["part"][:1], "rows": [total.tobytes()]})

        summed = mapped(numbered.select("ids"), run, "block int, part int, rows binary").groupBy("block", "part").applyInPandas(add, "block int, part int, rows binary").toPandas().sort_values(["block", "part"])
        sent.unpersist()
        images = []
        for b, (own, idf, basis) in enumerate(zip(items, idfs, bases, strict=True)):
            image = np.zeros_like(basis)
            gram(np.concatenate([passages(i) for i in own]), idf, basis, image)
            image *= weight
            if len(parts := summed["rows"][summed["block"] == b]):
                image += np.frombuffer(b"".join(parts)).reshape(basis.shape)
            images.append(image)
        if turn == PASSES - 1:
            out = []
            for basis, image in zip(bases, images, strict=True):
                value, vector = np.linalg.eigh(basis.T @ image)
                out.append(basis @ vector[:, np.argsort(-value)[:rank]])
            return out
        bases = images
    raise AssertionError("no passes")


def completed(basis: np.ndarray, items: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The basis, and orthonormal directions for the items of which it holds less than SHARE of the norm."""
    full = np.zeros((len(items), len(basis)))
    for row, own in zip(full, items, strict=True):
        np.add.at(row, own, idf[own])
    full /= np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-9)
    poor = full[np.linalg.norm(full @ basis, axis=1) < SHARE]
    for _ in range(2):  # twice, against rounding
        poor = poor - poor @ basis @ basis.T
    extra, value, _ = np.linalg.svd(poor.T, full_matrices=False)
    return np.hstack([basis, extra[:, value > 1e-6]])


def lcs_length(item_masks: dict[int, int], size: int, region: list[int]) -> int:
    """Longest common subsequence of an item (bit masks of its words' places) and a region, bit-parallel."""
    full = (1 << size) - 1
    v = full
    for w in region:
        m = item_masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Index:
    """The benchmark block's latent vectors and what confirms candidates."""

    def __init__(self, ids: list[int], items: list[np.ndarray], place: np.ndarray, idf: np.ndarray, basis: np.ndarray):
        self.ids, self.place = ids, place
        self.fold = np.vstack([basis * idf[:, None], np.zeros(basis.shape[1])]).astype(np.float32)
        self.mass = np.append(idf * idf, 0).astype(np.float32)
        vectors = np.array([self.fold[i].sum(0) for i in items])
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        self.items = []
        for own in items:
            rank = sorted(set(own.tolist()), key=lambda w: (-idf[w], w))
            masks: dict[int, int] = {}
            for at, w in enumerate(own.tolist()):
                masks[w] = masks.get(w, 0) | 1 << at
            self.items.append((len(own), masks, frozenset(rank[: max(3, len(rank) // 3)]), frozenset(masks), {w: m.bit_count() for w, m in masks.items()}))

    def candidates(self, texts: list[np.ndarray], cosine: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, last word + 1, cosine) of passages near an item."""
        blocks = np.array([max(1, -(-len(t) // STEP)) for t in texts])
        starts = np.concatenate([[0], np.cumsum(blocks)])
        flat = np.full(starts[-1] * STEP, -1, np.int32)  # -1: the last row of fold and mass, zero
        for t, s in zip(texts, starts, strict=False):
            flat[s * STEP : s * STEP + len(t)] = t
        grid = flat.reshape(-1, STEP)
        grid = np.ascontiguousarray(grid.T)
        again = np.zeros(grid.shape, bool)
        for lag in range(1, STEP):
            again[lag:] |= grid[lag:] == grid[:-lag]
        grid[again & (grid > 0)] = -1  # a word counts once in a block, however often it is repeated
        fold = np.zeros((starts[-1], self.fold.shape[1]), np.float32)
        mass = np.zeros(starts[-1], np.float32)
        for cut in range(0, len(fold), FEW):  # what a cut needs stays in the processor's cache
            for words_at in grid[:, cut : cut + FEW]:
                fold[cut : cut + FEW] += self.fold[words_at]
                mass[cut : cut + FEW] += self.mass[words_at]
        owner = np.repeat(np.arange(len(texts)), blocks)
        done = blocks < WINDOWS[0]  # texts too short for the least window are one passage
        for width in (1, *WINDOWS):
            n = len(fold) - width + 1
            if n <= 0:
                continue
            at = np.flatnonzero(done[owner[:n]]) if width == 1 else np.flatnonzero(owner[:n] == owner[width - 1 :])
            if width == WINDOWS[-1]:
                at = at[(at - starts[owner[at]]) % 2 == 0]
            for cut in range(0, len(at), 20_000):
                a = at[cut : cut + 20_000]
                if width == 1:
                    z, m = fold[a], mass[a]
                else:
                    low, high = a[0], a[-1] + 1
                    z, m = fold[low:high].copy(), mass[low:high].copy()
                    for j in range(1, width):
                        z += fold[low + j : high + j]
                        m += mass[low + j : high + j]
                    z, m = z[a - low], m[a - low]
                norm = np.sqrt(m)
                c = z @ self.vectors.T
                r, i = np.divmod(np.flatnonzero(c >= np.maximum(norm * cosine, 1e-6)[:, None]), len(self.vectors))
                text = owner[a[r]]
                first = (a[r] - starts[text]) * STEP
                yield from zip(text.tolist(), i.tolist(), first.tolist(), (first + width * STEP).tolist(), (c[r, i] / norm[r]).tolist(), strict=True)

    def confirm(self, text: list[int], item: int, first: int, last: int, least: float) -> tuple[float, float, int]:
        """(LCS share of the item, share of its answer words, place) of the best region of 1.5 times the item's length near the
        passage; regions that can't reach an LCS share of `least`, as too few places of the item have a word of theirs, are passed over."""
        size, masks, answer, own, places = self.items[item]
        length, best = size + size // 2 + 1, (0.0, 0.0, 0)
        low, high = max(0, first - size), min(len(text), last + size)
        reach = lambda there: sum(map(places.__getitem__, there)) >= least * size
        if not reach(own.intersection(text[low:high])):
            return best
        for at in range(low, max(low + 1, high - length + max(4, size // 4)), max(4, size // 4)):
            region = text[at : at + length]
            there = own.intersection(region)
            if reach(there):
                best = max(best, (lcs_length(masks, size, region) / size, len(there & answer) / len(answer), at))
        return best


def search(numbered: DataFrame, kind: type, indexes: list[Index], cosine: float, verbatim: float, paraphrase: float, answer: float) -> DataFrame:
    sent = numbered.sparkSession.sparkContext.broadcast(indexes)
    least = min(verbatim, paraphrase)

    def hits(own: Index, texts: list[np.ndarray]) -> dict[tuple[int, int], tuple]:
        out: dict[tuple[int, int], tuple] = {}
        ids = [own.place[t] for t in texts]
        plain: dict[int, list[int]] = {}
        for t, i, first, last, cos in own.candidates(ids, cosine):
            if (t, i) in out and out[t, i][0] == 1.0:  # nothing is closer than the whole item
                continue
            if t not in plain:
                plain[t] = ids[t].tolist()
            lcs, there, place = own.confirm(plain[t], i, first, last, least)
            if lcs >= verbatim or lcs >= paraphrase and there >= answer:
                out[t, i] = max(out.get((t, i), ()), (lcs, cos, there, place))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, chunk, names, held = [], [], [], 0
            doc_ids, texts = batch["doc_id"].tolist(), batch["ids"].tolist()
            for at in range(len(texts) + 1):
                if at < len(texts):
                    chunk.append(np.frombuffer(texts[at], kind))
                    names.append(doc_ids[at])
                    held += len(chunk[-1])
                if chunk and (held > 200_000 or at == len(texts)):
                    for own in sent.value:
                        for (t, i), (lcs, cos, there, place) in sorted(hits(own, chunk).items()):
                            rows.append((names[t], own.ids[i], lcs, cos, there, place, "verbatim" if lcs >= verbatim else "paraphrase"))
                    chunk, names, held = [], [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "lcs", "cosine", "answer", "place", "kind"])

    return mapped(numbered, run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, verbatim: float = VERBATIM, paraphrase: float = PARAPHRASE, answer: float = ANSWER, rank: int = RANK) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, lcs, cosine, answer, place, kind."""
    docs = docs.filter("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stated = benchmark.filter("item_id is not null and length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = stated.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size.n // ITEMS), -(-size.bytes // ITEM_BYTES))
    found = docs.sparkSession.createDataFrame([], FOUND)
    if not blocks:
        return found
    for begin in range(0, blocks, BLOCKS):
        place = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
        rows = stated.filter((place >= begin) & (place < begin + BLOCKS)).select("item_id", "text", place.alias("block")).distinct().orderBy("block", "item_id", "text").collect()
        by_block: dict[int, list[tuple[int, list[bytes]]]] = {}
        for r in rows:
            if own := words(r.text):
                by_block.setdefault(r.block, []).append((r.item_id, own))
        every = sorted({w for items in by_block.values() for _, own in items for w in own})
        if not every:
            continue
        numbered, kind = stored(in_numbers(docs, every), "numbers"), id_type(every)
        n, df = frequencies(numbered, every)
        weight = dict(zip(every, (np.log((n + 1) / (df[1:] + 1)) + 0.1).tolist(), strict=True))
        places, owned, idfs = [], [], []
        for items in by_block.values():
            known = numbers(sorted({w for _, own in items for w in own}))
            idf = np.array([0.0, *map(weight.__getitem__, known)])
            idf[0] = idf[1:].mean()
            places.append(np.array([0, *(known.get(w, 0) for w in every)], np.int32))
            owned.append([ids_of(own, known) for _, own in items])
            idfs.append(idf)
        bases = latent_bases(numbered, n, places, owned, idfs, kind, rank)
        indexes = [Index([i for i, _ in items], own, place, idf, completed(basis, own, idf)) for items, own, place, idf, basis in zip(by_block.values(), owned, places, idfs, bases, strict=True)]
        found = found.unionByName(stored(search(numbered, kind, indexes, cosine, verbatim, paraphrase, answer), "found"))
        dropped(numbered)
    return found
