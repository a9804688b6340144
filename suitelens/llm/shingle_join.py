"""N-gram Jaccard join with prefix trees, and the classes that its links make.

Two documents link when the Jaccard similarity of their sets of ``n``-word shingles is at
least ``percent`` hundredths. Sets are globally ordered: shingles that one document alone has
first, frequent ones last, then by name. Linked sets share a shingle among their first
``size - ceil(size * percent / 100) + 1``.

1. Copies of a text take no part; they join the class of the text's smallest id.
2. Each batch of documents sends its distinct shingles, as sorted and shortened names (about
   two bytes each), to buckets, which answer with a level of frequency for each: 0 if no
   other document has it. A shortened name can only make a shingle look more frequent, and
   any order gives right results; this one keeps shared passages out of the prefixes.
3. The prefixes, without what is unique, meet by shingle. The documents that share one make a list. A list has
   a few pivots (1 up to 15 members, one more with each doubling), those that share most;
   pairs are pivots with the other members of a fitting size, n log n for a list of n.
4. Pairs are joined with the two texts. The sets of a pivot's partners are put into a prefix
   tree; the pivot's set walks down it, sets on one path share the overlap counted so far,
   and a set is left where the overlap and what remains cannot reach the threshold.
5. Links make classes. In lists that then hold several classes, all documents are compared
   with those outside the largest class, again by prefix trees, so that no link between
   classes is lost.

Defined cases: a null text or one without words has no shingles and links with nothing; a
text of fewer than ``n`` words has one shingle, all its words; A-Z are lower-cased; rows
with one id are documents of their own and share the least id of their classes; an empty
table gives an empty result; extra columns are kept out of the way.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitelens.llm.common import partitions_for, prepare, small_enough, stored
from suitelens.llm.components import components
from suitelens.llm.repeats import BROADCAST_BYTES, bucket_of, by_bucket, dealt, emit, open_batch, other_columns, pack_batches, rows_of, window_names_sliced, with_answers
from suitelens.llm.words import LOWER, NOT_SPACE, fresh_key, mix, span_names, split_words, word_names

SHINGLE, PERCENT = 5, 75
#: a shingle is on level 0 below the first of these counts of documents, on 1 below the second, and so on
LEVELS = (2, 4, 32)
#: bits of a short name beyond the number of shingles: one in 2**6 unique ones seems repeated
SPARE_BITS = 6
#: shingles that one bucket holds at about
BUCKET_SHINGLES = 1 << 19
#: members of a prefix tree, and documents that walk down it in one task
TREE_SETS, CHUNK_DOCUMENTS = 256, 2048
_BODY = ("batch", "n_bytes", "sizes", "ids", "copy", "body")
_INDEX_BITS = 22  # a batch's documents are numbered below this many bits


def shingle_sets(data: np.ndarray, sizes: np.ndarray, n: int = SHINGLE, key: int = 0) -> list[np.ndarray]:
    """The distinct shingle names of each document, sorted by name; ``key``: of the words' names."""
    low = LOWER[data]
    end = np.cumsum(sizes)
    starts, ends = split_words(low, end - sizes, NOT_SPACE)
    first, last = np.searchsorted(starts, end - sizes, "left"), np.searchsorted(starts, end, "left")
    names = word_names(low, starts, ends, key)
    grams = window_names_sliced(names, n)
    short = (last > first) & (last - first < n)
    whole = span_names(names, first[short], last[short]) + (last - first)[short].astype(np.uint64)
    out = [np.unique(grams[a:z - n + 1]) if z - a >= n else grams[:0] for a, z in zip(first.tolist(), last.tolist(), strict=True)]
    for k, w in zip(np.flatnonzero(short).tolist(), mix(whole).tolist(), strict=True):
        out[k] = np.array([w], np.uint64)
    return out


def _short(names: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of names, which are in order; so are these."""
    return names >> np.uint64(64 - bits)


def _levels(batches: DataFrame, buckets: int, bits: int, kind: tuple[int, int]) -> DataFrame:
    """For each batch and bucket the level of each distinct short name, two bits each."""
    sent, back = "bucket long, batch long, n long, body binary, many binary", "batch long, bucket long, bits binary"

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for row in rows_of(parts):
            names, count = _batch_names(*_sets(row, kind), bits)
            cut = _cuts(names, buckets, bits)
            out = []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                part = names[cut[b]:cut[b + 1]]
                # differences, byte by byte: the high bytes are nearly all zero
                body = np.diff(part, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
                out.append((b, row["batch"], len(part), pack(body), zlib.compress(np.packbits(count[cut[b]:cut[b + 1]] > 1).tobytes(), 1)))
            if out:
                yield emit(out, sent)

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b, rows in by_bucket(parts):
            names, weight = [], []
            for r in rows:
                raw = np.frombuffer(unpack.decompress(r["body"], max_output_size=8 * r["n"]), np.uint8).reshape(8, -1)
                names.append(np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64))
                weight.append(1 + np.unpackbits(np.frombuffer(zlib.decompress(r["many"]), np.uint8), count=r["n"]))
            every = np.concatenate(names)
            order = np.argsort(every, kind="stable")
            first = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
            total = np.add.reduceat(np.concatenate(weight)[order].astype(np.int64), first)
            level = np.empty(len(every), np.uint8)
            level[order] = np.repeat(np.digitize(total, LEVELS).astype(np.uint8), np.diff(np.append(first, len(every))))
            at, out = 0, []
            for r in rows:
                mine = level[at:at + r["n"]]
                at += r["n"]
                if mine.any():
                    out.append((r["batch"], b, zlib.compress(np.packbits(np.stack([mine >> 1, mine & 1])).tobytes())))
            if out:
                yield emit(out, back)

    return stored(dealt(batches.select(*_BODY).mapInArrow(send, sent), buckets).mapInArrow(answer, back), "levels")


def _sets(row: dict, kind: tuple[int, int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets of a batch's documents, which are copies, all bytes, and sizes."""
    data, sizes, _, copy = open_batch(row)
    return shingle_sets(data, sizes, *kind), copy, data, sizes


def _batch_names(sets: list[np.ndarray], copy: np.ndarray, data: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct short names of documents that are no copies, and in how many each is."""
    own = [s for s, c in zip(sets, copy.tolist(), strict=True) if not c]
    return np.unique(_short(np.concatenate([*own, np.zeros(0, np.uint64)]), bits), return_counts=True)


def _cuts(names: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    return np.searchsorted(bucket_of(names << np.uint64(64 - bits), buckets), np.arange(buckets + 1))


def prefix(names: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first names of a set in global order, one of which every linked set has; those
    of level 0, which no other set has, are left out."""
    n = len(names)
    take = n - -(-n * percent // 100) + 1
    head = np.argsort(level, kind="stable")[:take]
    return names[head[level[head] > 0]]


def _candidates(batches: DataFrame, buckets: int, bits: int, meet_buckets: int, kind: tuple[int, int], percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs and lists (kind 0: pairs ``x, y`` of documents, pivot and other; kind 1: documents
    ``y`` of ``size`` in the lists ``x`` of three and more); and by batch set sizes and digests."""
    sent = "kind long, bucket long, batch long, body binary"

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for row in rows_of(parts):
            sets, copy, data, sizes = _sets(row, kind)
            short, _ = _batch_names(sets, copy, data, sizes, bits)
            levels = np.zeros(len(short), np.uint8)
            cut = _cuts(short, buckets, bits)
            for a in row["levels"] or ():
                m = int(cut[a["bucket"] + 1] - cut[a["bucket"]])
                two = np.unpackbits(np.frombuffer(zlib.decompress(a["bits"]), np.uint8), count=2 * m).reshape(2, m)
                levels[cut[a["bucket"]]:cut[a["bucket"] + 1]] = two[0] * 2 + two[1]
            heads = [prefix(s, levels[np.searchsorted(short, _short(s, bits))], percent) if len(s) and not c else s[:0]
                     for s, c in zip(sets, copy.tolist(), strict=True)]
            names = np.concatenate([*heads, np.zeros(0, np.uint64)])
            doc = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            size = np.array([len(s) for s in sets], np.int64)
            bucket = bucket_of(names, meet_buckets)
            order = np.argsort(bucket, kind="stable")
            names, doc = names[order], doc[order]
            cut = np.searchsorted(bucket[order], np.arange(meet_buckets + 1))
            end = np.cumsum(sizes)
            digests = b"".join(hashlib.sha256(data[a:z]).digest() for a, z in zip((end - sizes).tolist(), end.tolist(), strict=True))
            out = [(1, -1, row["batch"], size.astype("<i8").tobytes() + digests)]
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own, at = doc[cut[b]:cut[b + 1]], names[cut[b]:cut[b + 1]]
                ids, count = np.unique(own, return_counts=True)
                raw = b"".join([struct.pack("<II", len(ids), len(at)), ids.astype("<u4").tobytes(), size[ids].astype("<u4").tobytes(),
                                count.astype("<u4").tobytes()])
                out.append((0, b, row["batch"], struct.pack("<I", len(z := zlib.compress(raw, 1))) + z +
                            at.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
            yield emit(out, sent)

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(parts):
            names, docs, sizes = [], [], []
            for r in rows:
                (m,) = struct.unpack_from("<I", r["body"])
                raw = zlib.decompress(r["body"][4:4 + m])
                k, total = struct.unpack_from("<II", raw)
                ids, size, count = np.frombuffer(raw, "<u4", 3 * k, 8).astype(np.int64).reshape(3, k)
                wide = np.zeros((total, 8), np.uint8)
                wide[:, :6] = np.frombuffer(r["body"], np.uint8, offset=4 + m).reshape(-1, 6)
                names.append(wide.view("<u8").ravel())
                docs.append(np.repeat((r["batch"] << _INDEX_BITS) + ids, count))
                sizes.append(np.repeat(size, count))
            yield from _lists(*(np.concatenate(x) for x in (names, docs, sizes)), percent)

    heads = stored(batches.select(*_BODY, "levels").mapInArrow(send, sent), "prefixes", "uncompressed")
    pairs = dealt(heads.filter("kind = 0").select("bucket", "batch", "body"), meet_buckets).mapInArrow(meet, "kind long, x long, y long, size long")
    return stored(pairs, "candidates"), heads.filter("kind = 1").select("batch", F.col("body").alias("info"))


def _pivots(n: np.ndarray) -> np.ndarray:
    """Pivots of a list of ``n`` members."""
    return np.maximum(1, np.log2(n).astype(np.int64) - 2)


def _lists(names: np.ndarray, docs: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    luck = mix(docs.astype(np.uint64))
    # members that share most come first: what copies were made from, if it is there
    _, back, often = np.unique(docs, return_inverse=True, return_counts=True)
    order = np.lexsort((luck, -often[back], names))
    names, docs, sizes, luck = names[order], docs[order], sizes[order], luck[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(names)))
    first, n = first[n > 1], n[n > 1]
    if not len(first):
        return
    # lists with the same members are one
    member = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    begin = np.cumsum(n) - n
    sign = mix(np.add.reduceat(luck[member], begin) + n.astype(np.uint64))
    sign, one = np.unique(sign, return_index=True)
    first, n = first[one], n[one]
    # pivots: a list's first members, more of them in longer lists
    x, y = [], []
    for k in range(int(_pivots(n).max())):
        rows = np.flatnonzero(_pivots(n) > k)
        m = n[rows] - 1 - k
        begin = np.cumsum(m) - m
        pivot = np.repeat(first[rows] + k, m)
        other = np.repeat(first[rows] + k + 1 - begin, m) + np.arange(int(m.sum()))
        fit = 100 * np.minimum(sizes[pivot], sizes[other]) >= percent * np.maximum(sizes[pivot], sizes[other])
        x.append(docs[pivot[fit]])
        y.append(docs[other[fit]])
    x, y = np.concatenate(x), np.concatenate(y)
    keep = np.unique(np.stack([x, y], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    x, y = keep[:, 0], keep[:, 1]
    long_ = n > 2
    first, n, sign = first[long_], n[long_], sign[long_]
    member = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    for kind, a, b, s in ((0, x, y, np.zeros(len(x), np.int64)), (1, np.repeat(sign.view(np.int64), n), docs[member], sizes[member])):
        for k in range(0, len(a), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[part]), kind, np.int64)), pa.array(a[part]), pa.array(b[part]), pa.array(s[part])],
                                             names=["kind", "x", "y", "size"])


class PrefixTree:
    """Sets of names as paths of a prefix tree.

    Names are ordered by how many of the sets have them, frequent ones first, so that
    near copies share long paths. Sets in the order of their paths are the leaves, met depth
    first; each adds the nodes below the path that it shares with the one before it.
    """

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        size = np.array([len(s) for s in sets], np.int64)
        self.names, code, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        self.rank = rank
        paths = [np.sort(p) for p in np.split(rank[code], np.cumsum(size)[:-1])] if len(sets) else []
        self.order = sorted(range(len(paths)), key=lambda k: paths[k].astype(">u4").tobytes())
        nodes, self.begin, self.parent, self.owner, self.shared, self.size = [], [], [], [], [], []
        before, at = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last path and its nodes
        total, owner = 0, np.zeros(0, np.int64)
        for k, i in enumerate(self.order):
            path = paths[i]
            m = min(len(path), len(before))
            differ = np.flatnonzero(path[:m] != before[:m])
            d = int(differ[0]) if len(differ) else m
            self.begin.append(total)
            self.parent.append(int(at[d - 1]) if d else -1)
            self.owner.append(int(owner[d - 1]) if d else -1)
            self.shared.append(d)
            self.size.append(len(path))
            nodes.append(path[d:])
            at = np.concatenate([at[:d], np.arange(total, total + len(path) - d)])
            owner = np.concatenate([owner[:d], np.full(len(path) - d, k)])
            before, total = path, total + len(path) - d
        self.nodes = np.concatenate([*nodes, np.zeros(0, np.int64)])

    def overlaps(self, probe: np.ndarray) -> np.ndarray:
        """Overlap of ``probe`` with each set that it links with, else -1, in the sets' order."""
        out = np.full(len(self.order), -1, np.int64)
        at = np.minimum(np.searchsorted(self.names, probe), max(0, len(self.names) - 1))
        found = at[self.names[at] == probe] if len(self.names) else at[:0]
        hit = np.zeros(len(self.names), np.int64)
        hit[self.rank[found]] = 1
        sums = np.concatenate([[0], np.cumsum(hit[self.nodes])]).tolist()
        base: list[int] = []  # overlap of the path above each set's own nodes
        n, have = len(probe), len(found)
        for k, i in enumerate(self.order):
            j = self.owner[k]
            above = base[j] + sums[self.parent[k] + 1] - sums[self.begin[j]] if j >= 0 else 0
            base.append(above)
            own = self.size[k] - self.shared[k]
            need = -(-self.percent * (self.size[k] + n) // (100 + self.percent))  # least overlap that links
            if above + min(own, have - above) < need:
                continue  # what remains cannot reach it
            total = above + sums[self.begin[k] + own] - sums[self.begin[k]]
            if total >= need:
                out[i] = total
        return out


def _with_wanted(batches: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """The batches that hold any of the documents ``d``, with their places as ``wanted``."""
    place = F.col("d").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    wanted = stored(nodes.groupBy(F.shiftright("d", _INDEX_BITS).alias("batch"))
                    .agg(F.sort_array(F.collect_list(place)).alias("wanted"))  # bounded by a batch
                    .withColumn("joined", F.array_join("wanted", " ").cast("binary")), "wanted")
    one = wanted.select("batch", "wanted")
    if small_enough(wanted, "joined", BROADCAST_BYTES):
        one = F.broadcast(one)
    return batches.select(*_BODY, *more).join(one, "batch")


def _texts(batches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``d, body``: the compressed texts of the documents ``d``."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for row in rows_of(parts):
            data, sizes, _, _ = open_batch(row)
            end = np.cumsum(sizes)
            pack = zstandard.ZstdCompressor(level=3).compress
            out = [((row["batch"] << _INDEX_BITS) + k, pack(data[end[k] - sizes[k]:end[k]].tobytes())) for k in row["wanted"]]
            for k in range(0, len(out), 1000):
                yield emit(out[k:k + 1000], "d long, body binary")

    return stored(_with_wanted(batches, nodes).mapInArrow(run, "d long, body binary"), "texts", "uncompressed")


def _unpacked_sets(bodies: list[bytes], kind: tuple[int, int]) -> list[np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    raw = [unpack(b) for b in bodies]
    return shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64), *kind)


_LINK = "a long, b long, overlap long, union long"


def _verify(pairs: DataFrame, batches: DataFrame, kind: tuple[int, int], percent: int) -> DataFrame:
    """``a, b, overlap, union`` of the pairs that link."""
    docs = _texts(batches, pairs.select(F.col("x").alias("d")).unionByName(pairs.select(F.col("y").alias("d"))).distinct())
    rows = (pairs.join(docs.select(F.col("d").alias("y"), F.col("body").alias("other")), "y")
            .join(docs.select(F.col("d").alias("x"), F.col("body").alias("pivot")), "x").select("x", "y", "pivot", "other"))

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(x, kind="stable")
            cut = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1])) if len(x) else []
            out = []
            for k, z in zip(cut, [*cut[1:], len(x)], strict=True):
                probe = _unpacked_sets([batch.column(2)[int(order[k])].as_py()], kind)[0]
                for i in range(k, z, TREE_SETS):
                    rows = order[i:min(z, i + TREE_SETS)].tolist()
                    sets = _unpacked_sets([batch.column(3)[r].as_py() for r in rows], kind)
                    for r, s, o in zip(rows, sets, PrefixTree(sets, percent).overlaps(probe).tolist(), strict=True):
                        if o >= 0:
                            out.append((int(x[r]), int(y[r]), o, len(probe) + len(s) - o))
            if out:
                yield emit(out, _LINK)

    return stored(rows.mapInArrow(compare, _LINK), "verified")


def _across(candidates: DataFrame, nodes: DataFrame, batches: DataFrame, kind: tuple[int, int], percent: int) -> DataFrame:
    """Links between different classes within lists that the pivots left apart.

    Lists with the same largest class make a cluster. Its documents outside that class are
    put into prefix trees, block by block, and all its documents walk down each of them;
    documents are dealt to (cluster, block, chunk), never as pairs. Of the links found a
    task reports those that join classes which it has not joined yet.
    """
    member = (candidates.filter("kind = 1").select("x", "y").distinct().join(nodes, F.col("y") == nodes.node, "left")
              .select("x", "y", F.coalesce("root", "y").alias("root")))
    member = stored(member, "lists")
    main = (member.groupBy("x", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("x")
            .agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("classes"))
            .filter("classes > 1").drop("classes"))
    every = stored(member.join(main, "x").select("main", "y", "root").distinct(), "clusters")
    outside = F.col("root") != F.col("main")
    plan = every.groupBy("main").agg(F.ceil(F.count_if(outside) / TREE_SETS).cast("int").alias("blocks"),
                                     F.ceil(F.count(F.lit(1)) / CHUNK_DOCUMENTS).cast("int").alias("chunks"))
    dealt_ = every.join(plan, "main")
    block, chunk = F.pmod(F.xxhash64("y"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("y", F.lit(1)), F.col("chunks")).cast("int")
    columns = ["main", "block", "chunk", "kind", "y", "root"]
    trees = dealt_.where(outside).withColumn("block", block).withColumn("kind", F.lit(0)) \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(columns)
    probes = dealt_.withColumn("chunk", chunk).withColumn("kind", F.lit(1)) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(columns)
    docs = _texts(batches, every.select(F.col("y").alias("d")).distinct())
    rows = (trees.unionByName(probes).join(docs.withColumnRenamed("d", "y"), "y").select(*columns, "body")
            .repartition("main", "block", "chunk").sortWithinPartitions("main", "block", "chunk", "kind", "y"))

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree, up = None, [], None, {}

        def top(r: int) -> int:
            while up.get(r, r) != r:
                up[r] = up.get(up[r], up[r])
                r = up[r]
            return r

        for batch in parts:
            out = []
            for r in batch.to_pylist():
                mine = (r["main"], r["block"], r["chunk"])
                if mine != key:
                    key, held, tree, up = mine, [], None, {}
                if r["kind"] == 0:
                    held.append(r)
                    continue
                if tree is None:
                    sets = _unpacked_sets([h["body"] for h in held], kind)
                    tree = PrefixTree(sets, percent)
                probe = _unpacked_sets([r["body"]], kind)[0]
                overlaps = tree.overlaps(probe)
                for k in np.flatnonzero(overlaps >= 0).tolist():
                    a, b = top(r["root"]), top(held[k]["root"])
                    if a != b:
                        up[a] = b
                        o = int(overlaps[k])
                        out.append((r["y"], held[k]["y"], o, len(probe) + len(sets[k]) - o))
            if out:
                yield emit(out, _LINK)

    return stored(rows.mapInArrow(compare, _LINK), "across")


def _link(batches: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and digests by batch, the components (``node, root``) and the verified links."""
    total = int(batches.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0) // 6 + 1  # about the number of shingles
    bits = min(56, total.bit_length() + SPARE_BITS)
    buckets = max(12, partitions_for(total, BUCKET_SHINGLES))
    kind = n, fresh_key()  # one key of names for all tasks
    levels = _levels(batches, buckets, bits, kind)
    meet_buckets = max(12, partitions_for(total * (100 - percent) // 100, BUCKET_SHINGLES))
    found, info = _candidates(with_answers(batches, levels, "levels"), buckets, bits, meet_buckets, kind, percent)
    pairs = stored(found.filter("kind = 0").select("x", "y").distinct(), "pairs")
    linked = _verify(pairs, batches, kind, percent)
    nodes = components(linked)
    more = _across(found, nodes, batches, kind, percent)
    if not more.isEmpty():
        linked = linked.unionByName(more)
        nodes = components(linked)
    return info, nodes, linked


def _documents(batches: DataFrame, info: DataFrame) -> DataFrame:
    """``node, doc_id, n_shingles, copy, digest`` (of the text) of every row."""
    each = "node long, doc_id long, n_shingles long, copy boolean, digest binary"

    def unfold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            ids = np.frombuffer(row["ids"], "<i8")
            copy = np.unpackbits(np.frombuffer(row["copy"], np.uint8), count=len(ids)).astype(bool)
            digests = [row["info"][8 * len(ids) + 32 * k:][:32] for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [pa.array((row["batch"] << _INDEX_BITS) + np.arange(len(ids))), pa.array(ids, mask=ids == np.iinfo(np.int64).min),
                 pa.array(np.frombuffer(row["info"], "<i8", len(ids))), pa.array(copy), pa.array(digests, pa.binary())],
                names=[f.split()[0] for f in each.split(", ")])

    return stored(batches.select("batch", "ids", "copy").join(info, "batch").mapInArrow(unfold, each), "documents")


def jaccard_classes(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
                    links: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles, component_id`` for every row; with ``links`` also the verified
    links ``a, b, overlap, union`` between document ids that the classes were made from."""
    prepare(docs.sparkSession)
    batches = pack_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    info, nodes, linked = _link(batches, n, percent)
    docs = _documents(batches, info)
    rooted = docs.filter("not copy").join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = stored(rooted.join(least, "root").select("doc_id", "n_shingles", "digest", "component_id"), "classes")
    of_text = known.groupBy("digest").agg(F.min("component_id").alias("component_id"))
    copies = (docs.filter("copy").join(of_text, "digest")
              .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
    out = known.select("doc_id", "n_shingles", "component_id").unionByName(copies)
    if not links:
        return out
    ids = docs.select("node", "doc_id")
    named = (linked.join(ids.select(F.col("node").alias("a"), F.col("doc_id").alias("doc_a")), "a")
             .join(ids.select(F.col("node").alias("b"), F.col("doc_id").alias("doc_b")), "b")
             .select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "overlap", "union"))
    return out, named


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, with all columns, without the documents of each class but that of the
    least id. A document without shingles is a class of its own."""
    prepare(docs.sparkSession)
    batches = pack_batches(docs.withColumn("_no_text", F.col(text).isNull()), doc_id, text)
    info, nodes, _ = _link(batches, n, percent)
    rows = _documents(batches, info)
    rooted = rows.filter("not copy and n_shingles > 0").join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "node"))["node"].alias("d")).select("d") \
        .unionByName(rows.filter("n_shingles = 0").select(F.col("node").alias("d")))
    schema = docs.schema

    def restore(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            data, sizes, _, _ = open_batch(row)
            rest = other_columns(row)
            body = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(data))
            body = pc.if_else(rest.column(rest.schema.get_field_index("_no_text")), pa.scalar(None, pa.string()), body)
            columns = [body if f.name == text else rest.column(rest.schema.get_field_index(f.name)) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).take(pa.array(row["wanted"], pa.int64()))

    return _with_wanted(batches, kept, "rest").mapInArrow(restore, schema)
