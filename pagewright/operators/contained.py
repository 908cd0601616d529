"""Texts within other texts, found by hashes of windows and confirmed by digests of the text itself."""

from __future__ import annotations

import copy
import functools
import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import normalize_nfd

#: Window hashes are polynomials modulo 2 ** 64; equal windows have equal hashes, the rest is for the digests.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The filter of window hashes has at most so many bits (64 MB); beyond, more windows are shuffled, none are lost.
MOST_BITS = 29


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _values(most: int) -> np.ndarray:
    """A number for each code point below ``most``; 0 for what is neither letter nor number, which normalising drops."""
    keep = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(most)])
    return np.where(keep, _mix(np.arange(1, most + 1, dtype=np.uint64)) | np.uint64(1), np.uint64(0))


_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def _power(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, base))])
    return _powers[base][:n]


class Norm:
    """A text as ``normalize_nfd`` gives it, with the hashes of its windows."""

    def __init__(self, text: str):
        points = np.frombuffer(unicodedata.normalize("NFD", text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
        values = _values(1 << 16 if points.max(initial=0) < 1 << 16 else sys.maxunicode + 1)[points]
        self.points = points[values != 0]
        self.over(values[values != 0])

    def over(self, values: np.ndarray) -> Norm:
        self.values, self.n = values, len(values)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * _power(BASE, self.n), out=self.sums[1:])
        return self

    def digest(self) -> str:
        return hashlib.sha256(self.points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()

    def windows(self, size: int) -> np.ndarray:
        """The hash of each window of a size, by its start."""
        return (self.sums[size:] - self.sums[: self.n + 1 - size]) * _power(INVERSE, self.n + 1 - size)

    def at(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (self.sums[starts + sizes] - self.sums[starts]) * _power(INVERSE, self.n + 1)[starts]


@functools.lru_cache(1 << 12)
def _salt(source: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(source.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)[0]


def _key(hashes: np.ndarray, salt: np.uint64, sizes: np.ndarray) -> np.ndarray:
    """Hashes of windows told apart by their source and size as well."""
    return _mix(hashes ^ _mix(sizes.astype(np.uint64) * BASE ^ salt))


def _near(hashes: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """A first place in a filter, quickly, without the source."""
    return (hashes >> np.uint64(64 - bits)) ^ (_mix(sizes.astype(np.uint64)) >> np.uint64(64 - bits))


def _far(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [keys >> np.uint64(64 - bits), (keys << np.uint64(24)) >> np.uint64(64 - bits)]


def _known(known: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)


def _facts(least: int):
    """Length and digest of each normalised text, the hash of all of it and of a first part of over half of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, d, t in zip(pdf["source"], pdf["doc_id"], pdf["text"]):
                x = Norm(t)
                if x.n < least:
                    continue
                size = least << ((x.n // least).bit_length() - 1)
                first, full = x.at(np.zeros(2, np.int64), np.array([size, x.n])).astype(np.int64)
                out.append((s, d, x.digest(), x.n, size, first, full))
            yield pd.DataFrame(out, columns=["source", "doc_id", "digest", "n", "size", "first", "full"])

    return run


def _filter(facts: DataFrame, bits: int) -> np.ndarray:
    """A bit set of bounded size with all hashes in it, made of one bit set a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            salt = pdf["source"].map(_salt).to_numpy(np.uint64)
            first, size = pdf["first"].to_numpy(np.int64).astype(np.uint64), pdf["size"].to_numpy(np.int64)
            full, n = pdf["full"].to_numpy(np.int64).astype(np.uint64), pdf["n"].to_numpy(np.int64)
            near = _near(first, size, bits)
            at = np.unique(np.concatenate([near, *_far(_key(first, salt, size), bits), *_far(_key(full, salt, n), bits)]))
            low = (at & np.uint64(0xFFFF)).astype("<u2")
            block, begin = np.unique(at >> np.uint64(16), return_index=True)
            yield pd.DataFrame({"block": block.astype(np.int64), "low": [x.tobytes() for x in np.split(low, begin[1:])]})

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << 16, np.uint8)
        for x in pdf["low"]:
            flags[np.frombuffer(x, "<u2")] = 1
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for block, found in facts.select("source", "size", "first", "n", "full").mapInPandas(run, "block long, low binary").groupBy("block").applyInPandas(union, "block long, bits binary").toLocalIterator():
        out[block << 13 : (block + 1) << 13] = np.frombuffer(found, np.uint8)
    return out


def _hits(sizes: list[int], bits: int, shared):
    """The windows of each text that the filter knows, once a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            out, texts = [], [Norm(t) for t in pdf["text"]]
            salt = pdf["source"].map(_salt).to_numpy(np.uint64)
            part = np.cumsum([x.n for x in texts]) >> 16  # texts are searched together, some 65,536 characters at once
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
                n = np.array([texts[k].n for k in rows])
                ends = np.cumsum(n)
                x = copy.copy(texts[rows[0]]).over(np.concatenate([texts[k].values for k in rows]))
                for size in (k for k in sizes if k < n.max()):
                    h = x.windows(size)
                    at = np.flatnonzero(_known(known, _near(h, np.array([size]), bits)))
                    of = np.searchsorted(ends, at, "right")
                    within = (at + size <= ends[of]) & (n[of] > size)  # no window over two texts
                    h, of = h[at][within], of[within]
                    for k in (0, 1):
                        on = _known(known, _far(_key(h, salt[rows[of]], np.array([size])), bits)[k])
                        h, of = h[on], of[on]
                    if len(h):
                        row = rows[of]
                        out.append(pd.DataFrame({"source": pdf["source"].to_numpy()[row], "doc_id": pdf["doc_id"].to_numpy()[row], "n": n[of], "size": size, "first": h.astype(np.int64)}))
            if out:
                yield pd.concat(out).drop_duplicates()

    return run


def _spans(bits: int, shared):
    """What stands at a hit, for every length that a text with this first part has, if the filter knows it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            out = []
            for s, d, t, sizes, firsts, counts, lengths in zip(*(pdf[c] for c in ("source", "doc_id", "text", "sizes", "firsts", "counts", "lengths"))):
                x, begin = Norm(t), np.cumsum(counts) - counts
                digest, found = x.digest(), []
                for size in (k for k in np.unique(sizes) if k < x.n):
                    of = np.flatnonzero(sizes == size)
                    of = of[np.argsort(firsts[of])]
                    h = x.windows(int(size)).astype(np.int64)
                    which = np.minimum(np.searchsorted(firsts[of], h), len(of) - 1)
                    here = np.flatnonzero(firsts[of][which] == h)
                    which = of[which[here]]
                    part = np.cumsum(counts[which]) >> 21  # so many lengths at once, or those of one start
                    for cut in np.split(np.arange(len(here)), np.flatnonzero(np.diff(part)) + 1):
                        many = counts[which[cut]]
                        start = np.repeat(here[cut], many)
                        n = lengths[np.arange(many.sum()) + np.repeat(begin[which[cut]] - np.cumsum(many) + many, many)]
                        fits = (n < x.n) & (start + n <= x.n)
                        start, n = start[fits], n[fits]
                        full = x.at(start, n)
                        for k in (0, 1):
                            on = _known(known, _far(_key(full, _salt(s), n), bits)[k])
                            start, n, full = start[on], n[on], full[on]
                        found.append((n, full.astype(np.int64), start))
                if any(len(f[0]) for f in found):
                    n, full, start = (np.concatenate(v) for v in zip(*found))
                    out.append(pd.DataFrame({"source": s, "holder": digest, "doc_id": d, "n": n, "full": full, "start": start}).drop_duplicates(["n", "full"]))
            if out:
                yield pd.concat(out)

    return run


def contained_duplicates(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, duplicate_of: texts within an earlier text of the same source that is no duplicate.

    A text's first part is of ``least`` characters or a power of two times that, and more than half of it. Windows of
    those sizes that a filter of all first parts knows are a holder's hits; at a hit, the whole text is sought by its
    length and hash, and confirmed by its digest. Rows that are shuffled are hashes; copies count once from there on.
    """
    docs = docs.where("source IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("source", "doc_id", "text")
    facts = docs.mapInPandas(_facts(least), "source string, doc_id long, digest string, n long, size long, first long, full long").persist()
    try:
        sizes = sorted(r[0] for r in facts.select("size").distinct().collect())
        bits = min(MOST_BITS, max(16, int(facts.count() * 192).bit_length()))
        shared = docs.sparkSession.sparkContext.broadcast(_filter(facts, bits))
    except BaseException:
        facts.unpersist()
        raise
    heads = facts.groupBy("source", "digest", "n", "size", "first", "full").agg(F.min("doc_id").alias("doc_id"))
    groups = heads.groupBy("source", "size", "first").agg(F.collect_set("n").alias("lengths"), F.min("n").alias("shortest"))
    hits = docs.mapInPandas(_hits(sizes, bits, shared), "source string, doc_id long, n long, size long, first long")
    asked = hits.join(groups, ["source", "size", "first"]).where("shortest < n").groupBy("source", "doc_id").agg(F.collect_list(F.struct("size", "first", "lengths")).alias("asked"))
    flat = asked.select("source", "doc_id", F.col("asked.size").alias("sizes"), F.col("asked.first").alias("firsts"), F.transform("asked", lambda a: F.size(a["lengths"]).cast("long")).alias("counts"), F.flatten("asked.lengths").alias("lengths"))
    spans = docs.join(flat, ["source", "doc_id"]).mapInPandas(_spans(bits, shared), "source string, holder string, doc_id long, n long, full long, start long")
    once = spans.groupBy("source", "holder", "n", "full").agg(F.min(F.struct("doc_id", "start")).alias("h")).select("source", "holder", "n", "full", "h.doc_id", "h.start")
    met = once.join(heads.select("source", "n", "full", "digest"), ["source", "n", "full"]).where("holder <> digest")
    norm = normalize_nfd("text").alias("norm")
    texts = met.groupBy("source", "doc_id", "holder").agg(F.collect_list(F.struct("start", "n", "digest")).alias("inner"))
    whole = docs.join(texts, ["source", "doc_id"]).select("source", "holder", "inner", norm).where(F.sha2("norm", 256) == F.col("holder"))
    inner: Column = F.filter("inner", lambda x: F.sha2(F.substring(F.col("norm"), (x["start"] + 1).cast("int"), x["n"].cast("int")), 256) == x["digest"])
    pairs = whole.select("source", "holder", F.explode(F.transform(inner, lambda x: x["digest"])).alias("digest")).distinct().persist()  # met twice below
    first = heads.select("source", F.col("digest").alias("holder"), F.col("doc_id").alias("holder_id"))
    holders = first.withColumn("digest", F.col("holder")).unionByName(pairs.join(first, ["source", "holder"]))
    rows = facts.select("source", "digest", "doc_id").join(holders, ["source", "digest"]).where("holder_id < doc_id").select("source", "digest", "doc_id", "holder", "holder_id")
    flagged = rows.select("source", F.col("digest").alias("holder"), F.col("doc_id").alias("holder_id")).distinct()
    return rows.join(flagged, ["source", "holder", "holder_id"], "left_anti").groupBy("doc_id").agg(F.min("holder_id").alias("duplicate_of"))
