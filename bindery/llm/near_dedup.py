"""MinHash near-duplicate groups with sequential Bayesian verification.

Every document gets a MinHash signature of its set of word shingles. Documents that agree on all rows of a band are candidates.
Candidates' signatures are compared batch by batch; a pair goes as soon as the posterior probability that its similarity reaches
the threshold falls below the chosen miss probability. What survives is verified exactly on the full sets, and verified links
are joined to connected components.

A bucket of n documents costs n comparisons, not n squared: all members meet the bucket's most central member first. Only members
that are then in another component than the centre are compared with the bucket's other members, in blocks of bounded size
within one task, and only documents with pairs that pass the posterior test leave it. No pair of candidates from different components is lost.

Defined results: a null or empty text, or one of white space, has no shingles and links with nothing; with fewer words than a
shingle has, the whole sequence is the one shingle. Rows with a null id take part in nothing: component null, kept. Repeated
rows get equal results. Of different texts under one id, the one with the least hash stands for the id in links; a row whose own set
equals another document's shares that one's component. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import U, groups, mix, slices, word_hashes
from .scratch import Scratch
from .skew import salted_join, weighted_join


@dataclass(frozen=True)
class NearDedup:
    """shingle: words each; percent: least similarity; bands x rows: the signature; miss: probability that a posterior test
    drops a link at the threshold; batch: signature values compared at once; block: most documents of a bucket in one group."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    miss: float = 1e-6
    batch: int = 32
    block: int = 256

    @property
    def length(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(compared so far, matches needed): with a uniform prior P(J >= t | m of n) is P(Binomial(n + 1, t) <= m)."""
        out, t = [], self.percent / 100
        for n in sorted({*range(self.batch, self.length, self.batch), self.length}):
            below, m = 0.0, 0
            while m <= n and (below := below + math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < self.miss:
                m += 1
            out.append((n, m))
        return out


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    data = b" ".join(texts).lower()
    words, start, _ = word_hashes(np.frombuffer(data, np.uint8))
    ends = np.cumsum([len(x) + 1 for x in texts])
    cuts = np.searchsorted(start, ends)
    joined = words.copy()
    size = max(0, len(words) - k + 1)
    for i in range(1, k):
        joined[:size] = mix(joined[:size] * U(0xD6E8FEB86659FD93) + words[i : i + size])
    out, a = [], 0
    for b in cuts:
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            short = words[a : a + 1].copy()
            for i in range(a + 1, b):
                short = mix(short * U(0xD6E8FEB86659FD93) + words[i : i + 1])
            out.append(mix(short + U(b - a)))
        else:
            out.append(words[:0])
        a = b
    return out


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(97)).integers(0, 2**64, n, dtype=np.uint64) | U(1)


def minhash(sets: list[np.ndarray], p: NearDedup) -> np.ndarray:
    """16 bits of each of the minima; only for sets that are not empty."""
    lengths = np.array([len(s) for s in sets])
    out = np.empty((len(sets), p.length), np.uint16)
    a = 0
    multipliers = _multipliers(p.length)
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(np.cumsum(lengths[a:]), 1 << 15, side="right")) + a)
        values = np.concatenate(sets[a:b])
        offsets = np.concatenate(([0], np.cumsum(lengths[a:b])[:-1]))
        held = np.empty_like(values)
        for j, m in enumerate(multipliers):
            np.multiply(values, m, out=held)
            out[a:b, j] = mix(np.minimum.reduceat(held, offsets)) >> U(48)
        a = b
    return out


def band_keys(sig: np.ndarray, p: NearDedup) -> np.ndarray:
    """A 64-bit key for each band."""
    out = np.empty((len(sig), p.bands), np.uint64)
    for b in range(p.bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for j in range(p.rows):
            key = mix(key * U(0xD6E8FEB86659FD93) + sig[:, b * p.rows + j].astype(np.uint64))
        out[:, b] = key
    return out


_FEATURES = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>"


def keys_of(texts: list[bytes]) -> np.ndarray:
    """What F.xxhash64 gives for each text."""
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in texts], np.uint64).view(np.int64)


def _features(p: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                sets = shingle_sets(texts, p.shingle)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                a, b = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                sigs: list[bytes | None] = [None] * len(sets)
                bands: list[np.ndarray | None] = [None] * len(sets)
                if len(full):
                    held = [sets[i] for i in full]
                    at = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    values = np.concatenate(held)
                    a[full] = np.add.reduceat(mix(values), at).view(np.int64)
                    b[full] = np.bitwise_xor.reduceat(mix(values + U(0x632BE59BD9B4E019)), at).view(np.int64)
                    sig = minhash(held, p)
                    keys = band_keys(sig, p).view(np.int64)
                    for i, s, k in zip(full, sig, keys, strict=True):
                        sigs[i], bands[i] = s.tobytes(), k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array(keys_of(texts), pa.int64()), pa.array(size), pa.array(a), pa.array(b), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "sig", "bands"],
                )

    return run


def _alive(equal: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Rows of matches that pass every posterior test; each batch is counted only for those still alive."""
    alive, count, done = np.arange(len(equal)), np.zeros(len(equal), np.int64), 0
    for n, m in least:
        count = count + equal[alive, done:n].sum(axis=1)
        keep = count >= m
        alive, count, done = alive[keep], count[keep], n
    return alive


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1)


def _prune(p: NearDedup):
    """Members that pass against their pivot, whose row stands before those of its members (role 0); it may be in an earlier batch."""
    least = p.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((1, p.length), np.uint16)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.concatenate((last, _matrix(part.column("sig"))))
                role = np.concatenate(([0], part.column("role").to_numpy()))
                pivot = np.maximum.accumulate(np.where(role == 0, np.arange(len(role)), 0))
                last = sig[pivot[-1:]]
                member = np.flatnonzero(role)
                keep = pa.array(member[_alive(sig[member] == sig[pivot[member]], least)] - 1)
                yield pa.RecordBatch.from_arrays([part.column(c).take(keep) for c in ("doc_id", "b", "chunk")], names=["a", "b", "chunk"])

    return run


_INVOLVED = "key long, doc_id long, comp long, rest array<long>"


def _across(p: NearDedup):
    """Queries against one block of a bucket's members, for those in different components. Gives the documents that survive: one
    row for each member of the block that has to be verified, and one for each query, with the members to verify it with."""
    least = p.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bucket", "block", "chunk"]):
            role, ids = group.column("role").to_numpy(), group.column("doc_id").to_numpy()
            comp, odd = group.column("comp").to_numpy(), group.column("odd").to_numpy(zero_copy_only=False)
            sig, band = _matrix(group.column("sig")), group.column("band")[0].as_py()
            target = np.flatnonzero(role == 1)
            needed, asked, rest = np.zeros(len(ids), bool), [], []
            for q in np.flatnonzero(role == 0):
                t = target[(comp[target] != comp[q]) & ((ids[target] > ids[q]) | ~odd[target])]
                if not len(t):
                    continue
                equal = sig[t] == sig[q]
                shared = equal.reshape(len(t), p.bands, p.rows).all(axis=2)
                first = shared[:, band] & ~shared[:, :band].any(axis=1)  # a pair is compared in its first bucket only
                t, equal = t[first], equal[first]
                t = t[_alive(equal, least)]
                if len(t):
                    needed[t] = True
                    asked.append(q)
                    rest.append(ids[t])
            if asked:
                at = np.concatenate((np.flatnonzero(needed), asked))
                key = mix(np.array([group.column("bucket")[0].as_py()], np.int64).view(np.uint64) + mix(np.array([group.column("block")[0].as_py() << 32 | group.column("chunk")[0].as_py()], np.uint64)))
                lists = pa.array([*[None] * int(needed.sum()), *rest], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key.view(np.int64)[0])), pa.array(ids[at]), pa.array(comp[at]), lists], names=["key", "doc_id", "comp", "rest"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, p: NearDedup) -> bool:
    if 100 * min(len(x), len(y)) < p.percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= p.percent * (len(x) + len(y) - both)


def _verify_blocks(p: NearDedup):
    """Exact links of each query with what ``_across`` left; one link to a component will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key"]):
            ids, comp, rest = group.column("doc_id").to_pylist(), group.column("comp").to_pylist(), group.column("rest")
            sets = dict(zip(ids, shingle_sets([x.as_buffer().to_pybytes() for x in group.column("text")], p.shingle), strict=True))
            of, found = dict(zip(ids, comp, strict=True)), []
            for i, doc in enumerate(ids):
                done = set()
                for other in rest[i].as_py() or ():
                    if of[other] not in done and _linked(sets[doc], sets[other], p):
                        done.add(of[other])
                        found.append((doc, other))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verify(p: NearDedup):
    """Exact links of members with their pivot, whose row stands before theirs; one set is held besides the pivot's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot: np.ndarray | None = None
        for batch in batches:
            good = []
            for i, (role, text) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text"), strict=True)):
                own = shingle_sets([text.as_buffer().to_pybytes()], p.shingle)[0]
                if role == 0:
                    pivot = own
                elif _linked(own, pivot, p):
                    good.append(i)
            keep = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return run


def _stars(members: DataFrame) -> DataFrame:
    """(b, chunk, doc_id, role): members ``a`` of each chunk of a pivot b, and the pivot once for each chunk."""
    pivots = members.select("b", "chunk").distinct().select("b", "chunk", F.col("b").alias("doc_id"), F.lit(0).alias("role"))
    return members.select("b", "chunk", F.col("a").alias("doc_id"), F.lit(1).alias("role")).unionByName(pivots)


def _together(stars: DataFrame) -> DataFrame:
    return stars.repartition("b", "chunk").sortWithinPartitions("b", "chunk", "role")


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): comp is the smallest id reachable. Rounds of large-star and small-star; each is a pre-aggregated minimum
    and a join that deals a node's links over several tasks."""
    edges = scratch.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before, total = None, 2 * edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = weighted_join(both.filter("v > u"), low, ["u"], "v", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = weighted_join(large, low, ["u"], "v", "n", total)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = scratch.save(small)
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_if(F.col("v") >= F.col("u"))).first()
        scratch.drop(edges)
        edges = after
        if state == before:
            break
        before, total = state, 2 * state[0]
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDedup = NearDedup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``df``."""
    p, spark = params, df.sparkSession
    scratch = Scratch(spark, "near")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = scratch.save(docs.mapInArrow(_features(p), _FEATURES))
    # documents with equal sets: one stands for all
    sets = feats.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    sets = scratch.save(sets)
    reps = feats.join(sets, (feats.doc_id == sets.rep) & (feats.set_a == sets.set_a) & (feats.set_b == sets.set_b), "left_semi")
    reps = scratch.save(reps.groupBy("doc_id").agg(F.min_by(F.struct("text_key", "sig", "bands"), "text_key").alias("r")).select("doc_id", "r.*"))

    rows = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    rows = scratch.save(salted_join(rows, sizes, ["bucket"], "doc_id", "inner"))
    central = rows.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    pivots = rows.join(central, "doc_id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("id"))).alias("top"))
    pivots = scratch.save(pivots.select("bucket", (-F.col("top.id")).alias("pivot")))
    pairs = salted_join(rows, pivots, ["bucket"], "doc_id", "inner").filter("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    # a pivot's members meet it in chunks of bounded size, each with the pivot once: no pivot is a hot key, and no text is copied for each pair
    pairs = scratch.save(pairs)
    stars = pairs.groupBy("b").agg(F.count("*").alias("n"))
    chunk = F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / p.block)).cast("int").alias("chunk")
    members = weighted_join(pairs, stars, ["b"], "a", "n").select("a", "b", chunk)
    sig = reps.select("doc_id", "sig")
    members = scratch.save(_together(_stars(scratch.save(members)).join(sig, "doc_id")).mapInArrow(_prune(p), "a long, b long, chunk int"))
    wanted = scratch.save(rows.select("doc_id").distinct())
    texts = docs.filter("text is not null").join(wanted, "doc_id", "left_semi").join(reps.select("doc_id", "text_key"), "doc_id")
    texts = scratch.save(texts.filter(F.col("text_key") == F.xxhash64("text")).drop("text_key").dropDuplicates(["doc_id"]))
    links = scratch.save(_together(_stars(members).join(texts, "doc_id")).mapInArrow(_verify(p), "a long, b long"))
    comps = scratch.save(components(scratch, links))

    # members that the centre did not reach meet the other members
    named = rows.filter("n > 2").join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    main = pivots.join(comps.withColumnRenamed("id", "pivot"), "pivot", "left").select("bucket", "pivot", F.coalesce("comp", "pivot").alias("main"))
    named = salted_join(named, main, ["bucket"], "doc_id", "inner").select("bucket", "band", "doc_id", "comp", "n", "pivot", (F.col("comp") != F.col("main")).alias("odd"))
    named = scratch.save(named.filter("doc_id <> pivot").drop("pivot"))
    odd = named.groupBy("bucket").agg(F.count_if("odd").alias("n_odd")).filter("n_odd > 0")
    named = salted_join(named, odd, ["bucket"], "doc_id", "inner").join(sig, "doc_id")
    blocks, chunks = F.ceil(F.col("n") / p.block).cast("int"), F.ceil(F.col("n_odd") / p.block).cast("int")
    spread = lambda of: F.pmod(F.xxhash64("doc_id"), of).cast("int")
    fixed = ["bucket", "band", "doc_id", "comp", "odd", "sig"]
    target = named.select(*fixed, spread(blocks).alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(1).alias("role"))
    query = named.filter("odd").select(*fixed, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), spread(chunks).alias("chunk"), F.lit(0).alias("role"))
    met = target.unionByName(query).repartition("bucket", "block", "chunk").sortWithinPartitions("bucket", "block", "chunk")
    involved = scratch.save(met.mapInArrow(_across(p), _INVOLVED))
    times = texts.join(involved.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")  # a query comes once for each block it meets
    involved = weighted_join(involved, times, ["doc_id"], "key", "n").drop("n").repartition("key").sortWithinPartitions("key")
    more = scratch.save(involved.mapInArrow(_verify_blocks(p), "a long, b long"))
    if not more.isEmpty():
        joined = comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more)
        comps = scratch.save(components(scratch, joined))

    sets = scratch.save(sets.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("comp", "rep").alias("comp"), "n"))
    out = weighted_join(feats.select("doc_id", "n_shingles", "set_a", "set_b"), sets, ["set_a", "set_b"], "doc_id", "n", feats.count(), "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
