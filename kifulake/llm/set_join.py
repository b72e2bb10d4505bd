"""Documents with nearly the same word shingles, joined over parity sketches.

A set's sketch has a bit per hash place: the parity of the shingles that fall there. A shingle that
only one of two sets has flips one bit, so the Hamming distance of two sketches is at most the size of
the symmetric difference. Similar sets of sizes a and b differ by a bounded number k of shingles;
a sketch cut into k + 1 blocks must then agree on one block. Sets are sketched per size band, since k
grows with the size, meet where a block agrees, and are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, discard, mix, numbered, slices, stash, text_bytes, word_ids, word_spans
from .components import components
from .decontaminate import FOLD

SHINGLE = 3
#: Linked at PERCENT / 100 or more of the union.
PERCENT = 90
#: Largest set of a band over its smallest, in hundredths.
BAND = 140
WORDS = 4  # 64-bit words of a sketch block
#: Buckets of up to this many sets pair their members; larger ones go by centres.
BUCKET = 32
ROUNDS = 1
#: Sets of a block of the last comparison.
SIDE = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def most_apart(total: int, percent: int = PERCENT) -> int:
    """Greatest symmetric difference of two linked sets whose sizes add up to ``total``.

    With i shared and d apart, union (total + d) / 2 and i = (total - d) / 2.
    """
    return total * (100 - percent) // (100 + percent)


def bands(largest: int) -> list[int]:
    """Smallest size of each band, rising."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, out[-1] * BAND // 100))
    return out


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct shingles of all texts in order, sorted in each text; offsets)."""
    raw, offsets = text_bytes(texts)
    raw = FOLD[raw]
    start, end, first = word_spans(raw, offsets, ~WHITE[raw])
    rows, n = len(first) - 1, len(start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    ids, words = word_ids(raw, start, end)
    code = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))[ids]
    counts = np.diff(first)
    shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(rows), shingles)
    at = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    h = mix(code[at] + _ODD)
    for d in range(1, SHINGLE):
        # a text of fewer words is one shingle of all of them
        here = counts[row] > d
        nxt = code[np.minimum(at + d, n - 1)]
        h = np.where(here, mix(h * _ODD + nxt + np.uint64(d)), h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.searchsorted(row[keep], np.arange(rows + 1))


def sketches(h: np.ndarray, blocks: int) -> np.ndarray:
    """The parity sketch of one set in ``blocks`` blocks, as a matrix of 64-bit words."""
    bit = h >> np.uint64(32)
    word = (h % np.uint64(blocks)).astype(np.int64) * WORDS + ((bit >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64)
    out = np.zeros(blocks * WORDS, np.uint64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(blocks, WORDS)


def _blocks(high: int) -> tuple[int, int]:
    """(blocks of a band's sketches, zero blocks that a set may leave out).

    With k + 1 + z blocks two linked sets agree on z + 1 at least. A set of up to z blocks without a
    bit then has an agreeing one among the others, so that it need not meet all sets that are empty there.
    """
    k = most_apart(2 * high)
    spare = 1 + (k + 1) // 32
    return k + 1 + spare, spare


def _signatures(h: np.ndarray, at: list[int]) -> np.ndarray:
    """The block signatures of one set: of its own band, and of the next if a partner may lie there."""
    n = len(h)
    own = int(np.searchsorted(at, n, "right")) - 1
    out = []
    for b in (own, own + 1):
        # of linked sets the smaller has at least PERCENT / 100 of the larger
        if b > own and 100 * n < PERCENT * at[b]:
            break
        blocks, spare = _blocks(at[b + 1] - 1)
        s = sketches(h, blocks)
        key = mix(np.arange(blocks, dtype=np.uint64) + np.uint64(b << 32))
        for w in range(WORDS):
            key = mix(key * _ODD + s[:, w])
        held = s.any(axis=1)
        out.append(key[held] if blocks - held.sum() <= spare else key)
    return np.concatenate(out)


KEYS = ("doc_id", "text_hash")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text"))


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, k1, k2, signatures, sketch) per row: size, 128-bit identity, block signatures
    and short sketch of its set.

    Identity is two sums over the hashes; sets that agree in both and in size are one.
    """
    rows = _keyed(docs)
    longs = [T.StructField(c, T.LongType()) for c in ("text_hash", "n", "k1", "k2")]
    schema = T.StructType([rows.schema["doc_id"], *longs, *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("signatures", "sketch")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                h, first = shingle_sets(b.column("text"))
                n = np.diff(first)
                at = bands(int(n.max(initial=1)) * 2)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(f, dtype=np.uint64))) for f in (mix(h), mix(h ^ _ODD))]
                k1, k2 = (mix(s[first[1:]] - s[first[:-1]] + n.astype(np.uint64)) for s in sums)
                sig = [_signatures(h[first[i] : first[i + 1]], at) if n[i] else np.zeros(0, np.uint64) for i in range(len(n))]
                upto = np.concatenate(([0], np.cumsum([len(x) for x in sig]))).astype(np.int32)
                flat = np.concatenate(sig) if sig else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(flat.view(np.int64)))
                short = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * SMALL), pa.array(_small(h, first).view(np.int64)))
                longs = [pa.array(x) for x in (n, k1.view(np.int64), k2.view(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *longs, lists, short], schema.names)

    return rows.mapInArrow(run, schema)


def _arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, toks): the sorted shingle hashes of the sets of ``wanted`` (node, doc_id, text_hash)."""
    rows = _keyed(docs)
    mine = wanted.select("node", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    rows = rows.join(mine, rows["doc_id"].eqNullSafe(mine["_d"]) & (rows["text_hash"] == mine["_h"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                h, first = shingle_sets(b.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("node"), lists], ["node", "toks"])

    # a document said twice has its set once
    return rows.mapInArrow(run, "node long, toks array<long>").groupBy("node").agg(F.any_value("toks").alias("toks"))


def _list(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct hashes are linked."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(both) - shared)


#: Words of the short sketches that all pairs are held against; blocks tell large sets apart.
SMALL = 8


def _small(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity sketches of ``SMALL`` words of the sets that ``first`` delimits, one after the other."""
    out = np.zeros((len(first) - 1) * SMALL, np.uint64)
    at = np.repeat(np.arange(len(first) - 1), np.diff(first)) * SMALL + (h % np.uint64(SMALL)).astype(np.int64)
    np.bitwise_xor.at(out, at, np.uint64(1) << ((h >> np.uint64(20)) & np.uint64(63)))
    return out


def _near(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs whose sketches and sizes allow a link."""
    p = lambda side: prints.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    both = pairs.join(p("u"), "u").join(p("v"), "v")
    apart = F.aggregate(
        F.zip_with("s_u", "s_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda x, y: x + y
    )
    total = F.col("n_u") + F.col("n_v")
    allowed = F.floor(total * F.lit(100 - PERCENT) / F.lit(100 + PERCENT))
    return both.where((apart <= allowed) & (F.abs(F.col("n_u") - F.col("n_v")) <= allowed)).select("u", "v")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sets are linked. Only texts that stand in a pair are read into sets again."""
    pairs = stash(pairs, "near-pairs")
    wanted = stash(nodes.select("node", *KEYS).join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi"), "wanted-sets")
    toks = stash(_arrays(docs, wanted), "shingle-sets")
    p = lambda side: toks.select(F.col("node").alias(side), F.col("toks").alias(f"t_{side}"))
    # the sets grow with the input: their joins are the same at every size
    both = pairs.join(p("u").hint("merge"), "u").join(p("v").hint("merge"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            x, y = b.column(b.schema.get_field_index("t_u")), b.column(b.schema.get_field_index("t_v"))
            ok = pa.array([_linked(_list(x, i), _list(y, i)) for i in range(b.num_rows)], pa.bool_())
            yield from t.select(["u", "v"]).filter(ok).to_batches()

    found = stash(both.mapInArrow(run, "u long, v long"), "set-links")
    discard(toks)
    return found


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _remaining(family: DataFrame, roots: DataFrame) -> DataFrame:
    """(centre, node, root, stray): families with members outside their centre's component."""
    members = family.join(roots, "node").join(roots.select(F.col("node").alias("centre"), F.col("root").alias("_c")), "centre")
    members = members.withColumn("stray", F.col("root") != F.col("_c")).drop("_c")
    open_ = members.where("stray").select("centre").distinct()
    return members.join(open_, "centre", "left_semi")


def _strays(members: DataFrame, prints: DataFrame) -> DataFrame:
    """(u, v): strays and members of other components whose sketches allow a link.

    A family is dealt into blocks of ``SIDE`` sets; a task compares a block of strays with a block of
    members as two arrays and returns the pairs that pass, so no pair is made before it is compared.
    """
    sizes = members.groupBy("centre").agg(F.count_if("stray").alias("_s"), F.count(F.lit(1)).alias("_m"))
    sizes = sizes.select("centre", F.ceil(F.col("_s") / SIDE).cast("int").alias("_s"), F.ceil(F.col("_m") / SIDE).cast("int").alias("_m"))
    rows = members.join(sizes, "centre").join(prints, "node")
    deal = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["centre", "i", "j", "node", "root", "n", "sketch"]
    left = stash(rows.where("stray").withColumn("i", deal("_s", 1)).withColumn("j", every("_m")).select(*cols), "strays")
    right = stash(rows.withColumn("j", deal("_m", 2)).withColumn("i", every("_s")).select(*cols), "members")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        side = lambda t: [t[c].to_numpy() for c in ("node", "root", "n")]
        flat = lambda t: t["sketch"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SMALL)
        us, vs = [], []
        if a.num_rows and b.num_rows:
            (na, ra, ca), (nb, rb, cb), sa, sb = side(a), side(b), flat(a), flat(b)
            for i in range(a.num_rows):
                allowed = (ca[i] + cb) * (100 - PERCENT) // (100 + PERCENT)
                hit = (rb != ra[i]) & (np.abs(cb - ca[i]) <= allowed) & (np.bitwise_count(sb ^ sa[i]).sum(axis=1) <= allowed)
                us.append(np.full(int(hit.sum()), na[i]))
                vs.append(nb[hit])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        u, v = cat(us), cat(vs)
        return pa.table([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return left.groupBy("centre", "i", "j").cogroup(right.groupBy("centre", "i", "j")).applyInArrow(run, "u long, v long")


def set_roots(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the component of every node (node, doc_id, text_hash, n, sketch); ``rows`` has the signatures.

    Sets meet in the buckets of their block signatures. Buckets of up to ``BUCKET`` sets pair their
    members. A larger one is settled without pairs: its most central member, the one that lies in most
    large buckets, is compared with all; who is linked to it needs no more. The members that are not (strays)
    elect centres among themselves ``ROUNDS`` times; what then is still in another component than its centre
    is compared with all members of other components of its family, in blocks.
    """
    mine = nodes.select("node", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    said = rows.select(*KEYS, "signatures").join(mine.hint("merge"), rows["doc_id"].eqNullSafe(mine["_d"]) & (rows["text_hash"] == mine["_h"]))
    # dealt once by key: the counts and the rows they go back to read the same shuffle
    held = said.select("node", F.explode("signatures").alias("key")).repartition("key")
    shared = held.groupBy("key").agg(F.count("node").alias("m")).where("m > 1")
    members = stash(held.join(shared, "key"), "block-members")
    few = members.where(F.col("m") <= BUCKET).select("key", "node")
    other = few.select("key", F.col("node").alias("v"))
    pairs = few.withColumnRenamed("node", "u").join(other, "key").where("u > v").select("u", "v").distinct()

    dense = members.where(F.col("m") > BUCKET)
    centrality = dense.groupBy("node").agg(F.sum("m").alias("w"))
    dense = stash(dense.select("key", "node").join(centrality, "node"), "dense-blocks")
    pivot = lambda rows, by: rows.groupBy(*by).agg(F.max(F.struct("w", "node")).alias("c")).select(*by, F.col("c.node").alias("centre"))
    family = stash(dense.join(pivot(dense, ["key"]), "key").select("centre", "node").distinct(), "families")

    star = lambda f: f.where("centre <> node").select(F.greatest("centre", "node").alias("u"), F.least("centre", "node").alias("v")).distinct()
    prints, slim = nodes.select("node", "n", "sketch"), nodes.select("node")
    found = _verified(_near(pairs.union(star(family)).distinct(), prints), docs, nodes)
    roots = stash(_roots(slim, found), "set-roots")
    if family.isEmpty():
        return roots
    weight = dense.select("node", "w").distinct()
    for _ in range(ROUNDS):
        strays = stash(_remaining(family, roots).where("stray").select("centre", "node"), "strays-left")
        if strays.isEmpty():
            return roots
        strays = strays.withColumnRenamed("centre", "old").join(weight, "node")
        again = strays.join(pivot(strays, ["old"]), "old").select("centre", "node").distinct()
        more = _verified(_near(star(again), prints), docs, nodes)
        if more.isEmpty():
            break
        found = found.union(more)
        roots = stash(_roots(slim, found), "set-roots")
    rest = stash(_remaining(family, roots), "open-families")
    if rest.isEmpty():
        return roots
    last = _verified(_strays(rest, prints).distinct(), docs, nodes)
    return roots if last.isEmpty() else stash(_roots(slim, found.union(last)), "set-roots")


def linked_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, root, component_id) per row of ``docs``.

    Two documents are linked if their sets of distinct three-word shingles (ASCII letters folded; fewer words:
    the whole sequence) share ``PERCENT`` hundredths of the union. ``component_id`` is the smallest doc_id
    reachable over links, itself included; ``root`` tells components apart (null without words). Documents of
    equal sets are one node. Null and word-free texts have an empty set and are linked with nothing: each is its own component.
    A null doc_id counts only where a component has no other. An empty table gives no rows.
    """
    rows = stash(sets(docs), "sets")
    identity = ["n", "k1", "k2"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = rows.where("n > 0").groupBy(*identity).agg(least.alias("m"), F.any_value("sketch").alias("sketch"))
    nodes, _ = numbered(nodes.select("m.doc_id", "m.text_hash", *identity, "sketch"), [F.col(c) for c in ("k1", "k2", "n")], "node", "set-nodes")
    nodes = stash(nodes, "set-nodes")
    roots = set_roots(docs, rows, nodes)
    named = nodes.select("node", "doc_id", *identity).join(roots, "node")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = stash(named.join(smallest, "root").select(*identity, "root", "component_id"), "set-components")
    out = rows.select("doc_id", "text_hash", *identity).join(named, identity, "left").withColumnRenamed("n", "n_shingles")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "root", own.alias("component_id"))
