"""Operator 7: MinHash near-deduplication with HyperMinHash sketches.

A text's set is that of its distinct ``k``-word shingles (A-Z lower-cased); a
text with fewer words has one, its whole word sequence. Two documents link when
the Jaccard similarity of their sets is at least num/den, by exact integers.

1. Sketch: texts with equal word sequences form a class, known by a SHA-256
   digest of the words (where the set is so small that only an equal one can link, of the set's
   shingles in order); only class representatives (smallest ids) go on. Sets are sketched by
   REGISTERS registers of 16 bits, leading-zero count and MANTISSA mantissa bits of
   the smallest hash of a bucket. The number of buckets follows the set's size
   (2 to 4 shingles a bucket; several hash functions fill the registers of
   small sets), so registers are rarely empty. Sets just above a size class
   are sketched for the class below too, so two similar sets always share a class.
2. Bands of BAND registers are bucket keys. A pair at similarity 0.85 misses
   all 42 bands with a probability of about 2e-9. In every bucket each member is paired with its
   smallest id, so a large group is one star a band and never all pairs.
3. Pairs are tried by size, then by the similarity that their registers
   estimate, corrected for chance collisions of registers (six standard
   deviations below the threshold still pass), and then verified on the full sets of
   shingles, as words: first every member against one pivot, then the pairs that no link has
   joined yet. The members of a large star are dealt out in blocks of STAR, each with a
   copy of the pivot's text, so no task gathers a star.
4. Links become components. Buckets whose members are still in different
   components are dealt out in blocks; members of different components are
   tried against each other inside a task, in the first band that they
   share, so no link between components is lost to the choice of stars, and
   only links that join components are emitted; they are verified as words too.

Texts that are null or have no words are linked with nothing. So are rows with
a null id; their component is null and they are kept. Rows that repeat an id
are each judged, under that id. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.llm.spark import components, cut, leaving_nothing, release
from tracklens.llm.words import U64, Hasher, Words, mix, slices

SHINGLE = 5
REGISTERS, BAND, MANTISSA = 252, 6, 10
EMPTY = 0xFFFF
_LOWER = Hasher(303, True)
_MAX_P = 7
BLOCK = 1024
BROADCAST_IDS = 1_000_000
PAIR_ROWS = 250  # of an Arrow batch with two whole texts in each row
STAR = 256


def shingles(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Words]]:
    """For some documents at a time: (hashes, their documents; distinct and in order of both, sizes by document, words)."""
    for s in slices(column):
        h, at = s.windows(s.hashes(_LOWER), k, _LOWER, short=True)
        d = s.doc[at]
        o = np.lexsort((h, d))
        h, d = h[o], d[o]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        yield h[keep], d[keep], np.bincount(d[keep], minlength=len(s.first) - 1), s


def _sequences(s: Words) -> list[bytes]:
    """The words of each document, A-Z lower-cased, one space between."""
    raw = s.joined().lower() if len(s.start) else b""
    ends = np.concatenate([[0], np.cumsum(s.end - s.start + 1)])
    return [raw[i : max(i, j - 1)] for i, j in zip(ends[s.first[:-1]].tolist(), ends[s.first[1:]].tolist(), strict=True)]


def shingle_set(words: bytes, k: int) -> set[bytes]:
    """The distinct shingles of a word sequence."""
    w = words.split(b" ") if words else []
    if len(w) < k:
        return {words} if w else set()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def _level(n: np.ndarray) -> np.ndarray:
    """Size class of sets of n shingles: floor(log2(n))."""
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1


def _registers(h: np.ndarray, row: np.ndarray, rows: int, level: int) -> np.ndarray:
    """Registers of sets of one size class; row: the set that a hash belongs to."""
    p = int(np.clip(level - 1, 1, _MAX_P))
    m, out = 1 << p, []
    for t in range(-(-REGISTERS // m)):
        x = mix(h ^ U64((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        low = np.full(rows * m, np.iinfo(np.uint64).max, U64)
        np.minimum.at(low, row * m + (x >> U64(64 - p)).astype(np.int64), x << U64(p))
        zeros = 64 - np.frexp(low.astype(np.float64))[1]
        zeros = np.clip(zeros, 0, 62).astype(np.uint64)
        reg = (zeros << U64(MANTISSA)) | ((low << (zeros + U64(1))) >> U64(64 - MANTISSA))
        reg[low == np.iinfo(np.uint64).max] = EMPTY
        out.append(reg.astype(np.uint16).reshape(rows, m))
    return np.hstack(out)[:, :REGISTERS]


def least_size(num: int, den: int) -> int:
    """The smallest set that can link with a different set: n / (n + 1) >= num / den."""
    return -(-num // (den - num)) if num < den else 1 << 62


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(id, text_hash, n, words, regs, under): set size, digest of the word sequence, registers of its size class and, near its lower edge, of the class below."""
    least = least_size(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, seq, regs, under = [], [], [], []
            for h, d, n, s in shingles(b.column(1), k):
                sizes.append(n)
                seq += [hashlib.sha256(b"\n".join(sorted(shingle_set(x, k))) if m < least else x).digest() for x, m in zip(_sequences(s), n, strict=True)]
                level = _level(n)
                own: list[bytes | None] = [None] * len(n)
                below: list[bytes | None] = [None] * len(n)
                lower = (n * num < (1 << level) * den) & (level > 0)
                for out, of, chosen in ((own, level, n >= least), (below, level - 1, (n >= least) & lower)):
                    for x in np.unique(of[chosen]):
                        docs_in = np.flatnonzero(chosen & (of == x))
                        rank = np.full(len(n), -1)
                        rank[docs_in] = np.arange(len(docs_in))
                        mine = rank[d] >= 0
                        for i, r in zip(docs_in, _registers(h[mine], rank[d[mine]], len(docs_in), int(x)), strict=True):
                            out[i] = r.tobytes()
                regs += own
                under += below
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cat(sizes), pa.int64()), pa.array(seq, pa.binary()), pa.array(regs, pa.binary()), pa.array(under, pa.binary())], names=["id", "text_hash", "n", "words", "regs", "under"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    return d.mapInArrow(leaving_nothing(run), "id long, text_hash long, n long, words binary, regs binary, under binary")


def bands(reps: DataFrame) -> DataFrame:
    """(key, id, band) for each band of each sketch that has a register in it; band counts on for registers of the class below."""
    n = REGISTERS // BAND
    odd = mix(np.arange(1, BAND + 1, dtype=U64)) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            for col, less in ((2, 0), (3, 1)):
                has = b.column(col).is_valid().to_numpy(zero_copy_only=False)
                if not has.any():
                    continue
                regs = np.frombuffer(b"".join(b.column(col).drop_null().to_pylist()), np.uint16).reshape(-1, n, BAND)
                level = (_level(size[has]) - less).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = mix((mix(regs.astype(U64) + U64(1)) * odd).sum(2) + mix(np.arange(n, dtype=U64) + U64(77))[None, :] + mix(level + U64(999))[:, None])
                used = (regs != EMPTY).any(2)
                yield pa.RecordBatch.from_arrays([pa.array(key[used].view(np.int64)), pa.array(np.repeat(ids[has], used.sum(1))), pa.array((np.nonzero(used)[1] + less * n).astype(np.int32))], names=["key", "id", "band"])

    return reps.select("id", "n", "regs", "under").mapInArrow(run, "key long, id long, band int")


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity by registers, corrected for chance collisions, and how many registers had a say."""
    some = (a != EMPTY) | (b != EMPTY)
    used = np.maximum(some.sum(-1), 1)
    equal = ((a == b) & some).sum(-1)
    chance = 2.0 ** -MANTISSA / 3  # two minima share the leading-zero count a third of the time
    return np.clip((equal / used - chance) / (1 - chance), 0, 1), used


def _plausible(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that sizes and registers allow."""
    side = lambda x: reps.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "regs", "under")])
    j = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    j = j.where(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}").select("a", "b", "n_a", "n_b", "regs_a", "regs_b", "under_a", "under_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            na, nb = t.column(2).to_numpy(), t.column(3).to_numpy()
            la, lb = _level(na), _level(nb)
            x = [u if i > j else r for r, u, i, j in zip(t.column(4).to_pylist(), t.column(6).to_pylist(), la, lb, strict=True)]
            y = [u if j > i else r for r, u, i, j in zip(t.column(5).to_pylist(), t.column(7).to_pylist(), la, lb, strict=True)]
            can = np.array([p is not None and q is not None for p, q in zip(x, y, strict=True)], bool)
            if can.any():
                grid = [np.frombuffer(b"".join(v for v, c in zip(z, can, strict=True) if c), np.uint16).reshape(-1, REGISTERS) for z in (x, y)]
                est, used = estimate(*grid)
                goal = num / den
                can[can] = est >= goal - 6 * np.sqrt(goal * (1 - goal) / used) - 1e-9
            keep = pa.array(can)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    return j.mapInArrow(run, "a long, b long")


def _wanted(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the documents whose ids are in ids (id)."""
    few = ids.count() <= BROADCAST_IDS
    wanted = ids.select(F.col("id").alias("w"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("w"), "left_semi")


def _sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, s): the hashed shingle sets of the documents whose ids are in ids (id)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for h, _, n, _ in shingles(b.column(1), k):
                out += [x.tobytes() for x in np.split(h, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "s"])

    return _wanted(ids, docs, id_col, text_col).mapInArrow(sets, "id long, s binary")


def _sequence_frame(texts: DataFrame) -> DataFrame:
    """(id, words) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for s in slices(b.column(1)) for x in _sequences(s)], pa.binary())], names=["id", "words"])

    return texts.mapInArrow(run, "id long, words binary")


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Pairs (of a checkpointed table) whose full sets of shingles, as words, have den * intersection >= num * union."""
    texts = _sequence_frame(_wanted(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs, id_col, text_col))
    stars = pairs.groupBy(F.col("a").alias("hot")).agg(F.ceil(F.count("*") / STAR).cast("int").alias("blocks")).where("blocks > 1")
    stars = F.broadcast(stars) if stars.count() <= BROADCAST_IDS else stars
    dealt = pairs.join(stars, F.col("a") == F.col("hot"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    first = dealt.select("a", "block").distinct().join(texts, F.col("a") == F.col("id")).select(F.col("a").alias("pa"), F.col("block").alias("pb"), F.col("words").alias("wa"))
    second = dealt.join(texts, F.col("b") == F.col("id")).select("a", "block", "b", F.col("words").alias("wb"))
    j = second.join(first, (F.col("a") == F.col("pa")) & (F.col("block") == F.col("pb"))).select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, set()
        for t in batches:
            keep = []
            for w, v in zip(t.column(2), t.column(3), strict=True):
                w = w.as_py()
                if w != last:
                    last, x = w, shingle_set(w, k)
                y = shingle_set(v.as_py(), k)
                both = len(x & y)
                keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    return j.mapInArrow(leaving_nothing(run), "a long, b long").distinct()


def _alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _cross(open_: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join components inside the buckets open_ (key, i, band, part, main), without those that they imply.

    A large bucket is dealt out in blocks of BLOCK members, a pair of blocks
    to a task. main is the component of the bucket's star; blocks of its members meet only
    blocks of others, so a large group with a few others costs tasks in proportion to its size. A pair is tried in the first band that it shares, and only if its
    components differ, by size, registers and full sets.
    """
    ids = cut(open_.select(F.col("i").alias("id")).distinct())
    sets = _sets(ids, docs, id_col, text_col, k)
    about = reps.join(ids.select(F.col("id").alias("w")), F.col("id") == F.col("w"), "left_semi").select(F.col("id").alias("ri"), "n", "regs", "under")
    about = cut(about.join(sets, F.col("ri") == F.col("id")).drop("id"))
    release(docs.sparkSession)
    other = F.col("part") != F.col("main")
    blocks = open_.groupBy(F.col("key").alias("bk")).agg(F.count("*").alias("size"), F.ceil(F.count_if(other) / BLOCK).cast("int").alias("nr"), F.ceil(F.count_if(~other) / BLOCK).cast("int").alias("nm")).where(F.col("size") > BLOCK).drop("size")
    d = open_.join(blocks, F.col("key") == F.col("bk"), "left").withColumns({"nr": F.coalesce("nr", F.lit(1)), "nm": F.coalesce("nm", F.lit(0))})
    h = F.xxhash64("i")
    own = F.when(other | (F.col("nm") == 0), F.pmod(h, F.col("nr"))).otherwise(F.col("nr") + F.pmod(h, F.nullif(F.col("nm"), F.lit(0))))
    d = d.withColumn("own", own.cast("int"))
    d = d.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("own") < F.col("nr"), F.col("nr") + F.col("nm")).otherwise(F.col("nr")) - 1)))
    d = d.select("key", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"), "own", "i", "part", "band")
    d = d.join(about, F.col("i") == F.col("ri")).withColumn("regs", F.when(F.col("band") >= REGISTERS // BAND, F.col("under")).otherwise(F.col("regs")))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bi, bj = key[1].as_py(), key[2].as_py()
        own, ids, part, n, band = (t.column(c).to_numpy() for c in ("own", "i", "part", "n", "band"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(len(ids), REGISTERS)
        sets = [np.frombuffer(x, U64) for x in t.column("s").to_pylist()]
        first, second = (np.arange(len(ids)),) * 2 if bi == bj else (np.flatnonzero(own == bi), np.flatnonzero(own == bj))
        this, goal, out = int(band[0]) % (REGISTERS // BAND), num / den, ([], [])
        root = part.copy()
        for x in first:
            y = second[second > x] if bi == bj else second
            y = y[(root[y] != root[x]) & (np.minimum(n[y], n[x]) * den >= np.maximum(n[y], n[x]) * num)]
            if not len(y):
                continue
            earlier = (regs[y, : this * BAND] == regs[x, : this * BAND]).reshape(len(y), this, BAND).all(2)
            earlier &= (regs[x, : this * BAND] != EMPTY).reshape(this, BAND).any(1)
            y = y[~earlier.any(1)]
            est, used = estimate(regs[y], regs[x][None])
            for z in y[est >= goal - 6 * np.sqrt(goal * (1 - goal) / used) - 1e-9]:
                if root[z] != root[x] and _alike(sets[x], sets[z], num, den):
                    out[0].append(min(ids[x], ids[z]))
                    out[1].append(max(ids[x], ids[z]))
                    root[root == root[z]] = root[x]
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return d.select("key", "bi", "bj", "own", "i", "part", "n", "band", "regs", "s").groupBy("key", "bi", "bj").applyInArrow(run, "a long, b long").distinct()


def _roots(links: DataFrame) -> DataFrame:
    """(id, component_id) of links (a, b) in which every b has one smaller a: pointers are doubled until all stand at roots."""
    p = cut(links.select(F.col("b").alias("id"), F.col("a").alias("component_id")))
    while True:
        up = p.select(F.col("id").alias("u"), F.col("component_id").alias("over"))
        p = cut(p.join(up, F.col("component_id") == F.col("u"), "left").select("id", F.coalesce("over", "component_id").alias("component_id"), F.col("over").isNotNull().alias("moved")))
        if p.where("moved").isEmpty():
            break
        p = p.drop("moved")
    p = p.drop("moved")
    return p.union(p.select("component_id", "component_id").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = 85, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document."""
    return _judge(docs, id_col, text_col, k, num, den).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of docs with the smallest id of their component, with their columns.

    Rows are told apart by id and text. Of rows that repeat both, that with the smallest
    hash of all columns stays. Rows with a null id all stay.
    """
    judged = cut(_judge(docs, id_col, text_col, k, num, den).select("id", "text_hash", "kept"))
    release(docs.sparkSession)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__hash"))
    named = judged.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "kept").groupBy("__id", "__hash").agg(F.max("kept").alias("__kept"), F.count("*").alias("__n"))
    kept = docs.join(named.where("__kept").select("__id", "__hash"), same, "left_semi")
    again = cut(named.where("__kept and __n > 1 and __id is not null").select("__id", "__hash"))
    if again.isEmpty():
        return kept
    order = Window.partitionBy(id_col, text_col).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    one = kept.join(again, same, "left_semi").withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")
    return kept.join(again, same, "left_anti").unionByName(one)


def _judge(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept) of every row."""
    every = cut(sketch(docs, id_col, text_col, k, num, den))
    some = every.where("n > 0 and id is not null")
    classes = some.groupBy(F.col("words").alias("class")).agg(F.min("id").alias("rep"))
    reps = some.where("regs is not null").join(classes, (F.col("words") == F.col("class")) & (F.col("id") == F.col("rep")), "left_semi").dropDuplicates(["id", "words"])
    reps = cut(reps)
    keyed = bands(reps)
    buckets = keyed.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    member = cut(keyed.join(buckets, F.col("key") == F.col("k")).select("key", "id", "band", "pivot", "size"))
    tried = member.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    # first each member against one pivot, the smallest; then only pairs that are still in different trees
    first = tried.groupBy(F.col("b").alias("m")).agg(F.min("a").alias("p"))
    check = lambda p: cut(verify(cut(_plausible(p, reps, num, den)), docs, id_col, text_col, k, num, den), PAIR_ROWS)
    release(docs.sparkSession)
    links = check(first.select(F.col("p").alias("a"), F.col("m").alias("b")))
    found = _roots(links)
    release(docs.sparkSession)
    root = lambda x: found.select(F.col("id").alias(f"i{x}"), F.col("component_id").alias(f"c{x}"))
    rest = tried.join(first, F.col("b") == F.col("m")).where("a <> p").join(root("a"), F.col("a") == F.col("ia"), "left").join(root("b"), F.col("b") == F.col("ib"), "left")
    more = check(rest.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"))
    release(docs.sparkSession)
    if not more.isEmpty():
        links = links.union(more)
        found = cut(components(links))

    part = F.coalesce("component_id", "i").alias("part")
    left = member.where("size > 2").select("key", F.col("id").alias("i"), "band", "pivot").join(found, F.col("i") == F.col("id"), "left").select("key", "i", "band", "pivot", part)
    mixed = left.groupBy(F.col("key").alias("k")).agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.max(F.when(F.col("i") == F.col("pivot"), F.col("part"))).alias("main")).where("lo <> hi")
    open_ = cut(left.join(mixed, F.col("key") == F.col("k")).select("key", "i", "band", "part", "main"))
    del keyed, buckets, member, tried, first, rest, more, left, mixed  # else their tables and shuffles stay
    release(docs.sparkSession)
    if not open_.isEmpty():
        crossed = cut(_cross(open_, reps, docs, id_col, text_col, k, num, den))
        release(docs.sparkSession)
        if not crossed.isEmpty():
            joined = cut(verify(crossed, docs, id_col, text_col, k, num, den), PAIR_ROWS)
            release(docs.sparkSession)
            found = cut(components(links.union(joined)))

    names = classes.join(found, F.col("rep") == F.col("id"), "left").select("class", F.coalesce("component_id", "rep").alias("component_id"))
    out = every.select("id", "text_hash", "n", "words").join(names, (F.col("n") > 0) & (F.col("words") == F.col("class")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
