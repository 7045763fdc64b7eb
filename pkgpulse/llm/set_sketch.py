"""Near-duplicates by SetSketch registers.

A set of word shingles is described by ``REGISTERS`` registers. Every element
has, for each register, an exponentially distributed value of rate ``RATE``,
derived from its hash; a register keeps the minimum over the set, rounded to a
power of ``BASE`` (exponentially spaced) and truncated to 16 bits: ``floor(1 -
log_b(min))``. The register-wise maximum of two sketches is the sketch of the
union, and two registers are equal with about the probability of the sets'
Jaccard similarity J.

Bands of ``ROWS`` consecutive registers are keys; sets with a common key are
candidates. At J = 0.8 a pair shares none of the 51 bands with a probability of
2e-9. A candidate pair is estimated from its registers: how many are larger,
smaller and equal, together with both sizes, give the likelihood of every J. A
pair goes if the threshold is less likely than the best J by a factor of
exp(``DOUBT``); all others are verified on their full sets.

The values of all registers of an element are one Poisson process whose points
fall on registers at random; it is followed only as far as a point can still be
a minimum, about ``m ln m`` points a set whatever its size.

Equal sets are one vertex (64-bit fingerprint of the sorted set). Links are
needed only as far as they connect sets: members of a key are first compared
with one hub, the member that meets most others in its keys; while that still
joins sets, members outside a key's most frequent component are compared with
one member of it, another one each round; then all pairs that are still apart
are compared, each at its first common band only, but for those whose parities
prove that they differ too much (bit i says whether an odd number of elements
falls into bucket i; sets differ in at least as many elements as bits). Nothing
is capped or sampled.

For far more than 10^8 distinct sets take more rows a band (and more
registers): chance candidates grow with the square of the number of sets times
J ** rows of unrelated sets.

Nulls and special cases: a null text, or one without words, has an empty set
and is linked with nothing; a text of fewer words than the shingle has its
whole word sequence as its one shingle; rows with a null id have a null
component and a null ``kept`` but link others as all rows do; repeated rows are
answered each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgpulse.llm.components import connected_components
from pkgpulse.llm.jaccard_join import fingerprint, parity_sketch, shingle_sets
from pkgpulse.llm.shared import blocks, written
from pkgpulse.llm.text_kernel import U64, mix

#: registers of a sketch (a power of two), spacing and rate of their values
REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, 65535
#: registers of a band
ROWS = 5
#: log likelihood ratio beyond which a pair is not verified
DOUBT = 20.0
#: hub rounds go on while a round leaves at most this share of the open postings, and links more than the rest of its pairs
SHRINKS = 0.9

FACTS = "doc_id long, place long, n_shingles long, fp long, sketch binary"


def sketches(values: np.ndarray, bounds: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (uint16) of the sets ``values[bounds[i] : bounds[i + 1]]`` of
    64-bit element hashes; all zero for an empty set."""
    sizes = np.diff(bounds)
    least = np.full((len(sizes), m), np.inf)
    flat = least.reshape(-1)
    todo, reach = np.flatnonzero(sizes), np.log(m) + 4.0
    shift = U64(64 - m.bit_length() + 1)
    while len(todo):
        # a register of a set of n elements is empty beyond time ``reach`` / n with probability exp(-reach)
        row = np.repeat(todo, sizes[todo])
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes[todo]) - sizes[todo], sizes[todo]) + bounds[row]
        state, end = values[at], (reach / np.maximum(sizes, 1))[row]
        time, base = np.zeros(len(row)), row * m
        while len(state):
            state = mix(state + U64(0x9E3779B97F4A7C15))
            time = time - np.log(((state & U64((1 << 52) - 1)).astype(np.float64) + 0.5) * 2.0**-52) / m
            keep = time <= end
            state, time, end, base = state[keep], time[keep], end[keep], base[keep]
            # another mix, so that the register does not hang on the waiting time
            np.minimum.at(flat, base + (mix(state ^ U64(0xA0761D6478BD642F)) >> shift).astype(np.int64), time)
        todo, reach = todo[np.isinf(least[todo]).any(axis=1)], reach + 8.0
    with np.errstate(divide="ignore"):
        spaced = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.where(sizes[:, None] > 0, spaced, 0), 0, TOP).astype(np.uint16)


def merged(sketch_a: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(sketch_a, sketch_b)


def cardinality(registers: np.ndarray) -> np.ndarray:
    """Estimated set sizes from registers, one row a set."""
    m = registers.shape[-1]
    total = (BASE ** -registers.astype(np.float64)).sum(axis=-1)
    return np.where(registers.any(axis=-1), m * (1 - 1 / BASE) / (RATE * np.log(BASE) * total), 0.0)


def _log_likelihood(j, larger, smaller, equal, u, v):
    """Of similarity ``j``, from the numbers of registers that are larger,
    smaller and equal; u and v are the sets' shares of the sum of their sizes."""
    p_larger, p_smaller = (-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE) for x in (u - v * j, v - u * j))
    p_equal = np.maximum(1 - p_larger - p_smaller, 0)
    parts = ((larger, p_larger), (smaller, p_smaller), (equal, p_equal))
    return sum(np.where(n > 0, n * np.log(np.maximum(p, 1e-300)), 0.0) for n, p in parts)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float):
    """(similarity, doubt) of pairs of sketches: the most likely J and by how
    much its log likelihood exceeds the best one at ``threshold`` or more."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    most = np.minimum(u / v, v / u)
    low, high = np.zeros(len(a)), most.copy()
    for _ in range(48):  # the log likelihood is concave in J
        left, right = low + 0.382 * (high - low), high - 0.382 * (high - low)
        rises = _log_likelihood(left, larger, smaller, equal, u, v) < _log_likelihood(right, larger, smaller, equal, u, v)
        low, high = np.where(rises, left, low), np.where(rises, high, right)
    best = (low + high) / 2
    there = np.minimum(np.maximum(best, threshold), np.maximum(most, best))
    doubt = _log_likelihood(best, larger, smaller, equal, u, v) - _log_likelihood(there, larger, smaller, equal, u, v)
    return best, np.where(most < threshold * (1 - 1e-9), np.inf, doubt)


def _describe(k: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text"):
            sets = list(shingle_sets(frame["text"], k))
            sizes = np.array([len(s) for s in sets], np.int64)
            registers = sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "place": frame["place"],
                    "n_shingles": sizes,
                    "fp": pd.array([fingerprint(s) if len(s) else None for s in sets], "Int64"),
                    "sketch": [r.tobytes() if n else None for r, n in zip(registers, sizes, strict=True)],
                }
            )

    return run


def band_keys(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    bands = registers.shape[1] // rows
    cut = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(U64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) << U64(32), cut.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return key


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _keys(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            keys = band_keys(_registers(frame["sketch"])).view(np.int64)
            yield frame.drop(columns="sketch").assign(keys=list(keys))


def _sets(k: int, p: int, q: int):
    """Full sets, and whether an odd number of their elements falls into each
    bucket: so many buckets that linked sets differ in an eighth of them at
    most, and half as many for comparison with smaller sets."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text"):
            sets = list(shingle_sets(frame["text"], k))
            bits = [max(128, 1 << (8 * (len(s) * (q - p) // p + 1) - 1).bit_length()) for s in sets]
            yield pd.DataFrame(
                {
                    "fp": [fingerprint(s) for s in sets],
                    "items": [s.tobytes() for s in sets],
                    "own": [parity_sketch(s, b) for s, b in zip(sets, bits, strict=True)],
                    "half": [parity_sketch(s, b // 2) for s, b in zip(sets, bits, strict=True)],
                }
            )

    return run


def _likely(p: int, q: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                a, b = _registers(frame["x"]), _registers(frame["y"])
                _, doubt = estimate(a, b, frame["m"].to_numpy(float), frame["n"].to_numpy(float), p / q)
                yield frame.loc[doubt <= DOUBT, ["a", "b"]]

    return run


def _verify(p: int, q: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = np.zeros(len(frame), bool)
            for i, pair in enumerate(zip(frame["x"], frame["y"], strict=True)):
                x, y = (np.frombuffer(items, U64) for items in pair)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = q * common >= p * (len(x) + len(y) - common)
            yield frame.loc[keep, ["a", "b"]]

    return run


class _Join:
    """The candidate search over the sets that share a band with another one."""

    def __init__(self, docs: DataFrame, facts: DataFrame, shingle: int, p: int, q: int):
        self.p, self.q = p, q
        sketched = facts.where("fp is not null")
        posted = sketched.select("fp", "sketch").mapInPandas(_keys, "fp long, keys array<long>")
        posted = posted.select("fp", F.explode("keys").alias("key"))
        shared = posted.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
        shared = written(shared.select("key"), "keys")
        live = posted.join(shared, "key", "left_semi").select("fp").distinct()
        # one row a live set: the smallest place that holds it
        held = sketched.join(written(live, "live"), "fp", "left_semi").groupBy("fp").agg(
            F.min("place").alias("place"), F.max("n_shingles").alias("n"), F.any_value("sketch").alias("sketch")
        )
        self.sets = written(held, "vertices")
        texts = docs.join(self.sets.select("place"), "place", "left_semi").dropDuplicates(["place"])
        schema = "fp long, items binary, own array<long>, half array<long>"
        self.items = written(texts.select("text").mapInPandas(_sets(shingle, p, q), schema), "items")
        keyed = self.sets.select("fp", "n", "sketch").mapInPandas(_keys, "fp long, n long, keys array<long>")
        self.keyed = written(keyed, "keyed")
        members = self.keyed.select("fp", "n", F.posexplode("keys").alias("band", "key"))
        members = written(members.join(shared, "key", "left_semi"), "members")
        # a set in the middle of a crowd meets more sets in its keys than one at the edge
        crowd = members.groupBy("key").agg(F.count("*").alias("met"))
        met = members.join(crowd, "key").groupBy("fp").agg(F.sum("met").alias("met"))
        self.members = written(members.join(met, "fp"), "members")
        self.tested: DataFrame | None = None
        self.tried = 0  # pairs that were tested last

    def _alike(self, n: str, m: str) -> Column:
        """Whether the sizes allow a link."""
        return F.least(n, m) * self.q >= F.greatest(n, m) * self.p

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (fp, other) that link and were not tested before."""
        pairs = pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        self.tried = pairs.count()
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        size = self.sets.select("fp", "n", "sketch")
        sketched = pairs.join(size.select(F.col("fp").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x")), "a")
        sketched = sketched.join(size.select(F.col("fp").alias("b"), "n", F.col("sketch").alias("y")), "b")
        likely = sketched.mapInPandas(_likely(self.p, self.q), "a long, b long")
        likely = written(likely, "likely")
        full = likely.join(self.items.select(F.col("fp").alias("a"), F.col("items").alias("x")), "a")
        full = full.join(self.items.select(F.col("fp").alias("b"), F.col("items").alias("y")), "b")
        return written(full.mapInPandas(_verify(self.p, self.q), "a long, b long"), "links")

    def stars(self) -> DataFrame:
        """Each member of a key with the key's hub, the one that meets most others."""
        hubs = self.members.groupBy("key").agg(F.max(F.struct("met", "fp", "n")).alias("hub"))
        hubs = hubs.select("key", F.col("hub.fp").alias("other"), F.col("hub.n").alias("m"))
        pairs = self.members.join(hubs, "key").where(F.col("fp") != F.col("other")).where(self._alike("n", "m"))
        return pairs.select("fp", "other")

    def open(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """The members of keys that hold more than one component, with it."""
        root = roots.select(F.col("node").alias("fp"), "root")
        placed = members.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        return written(placed.join(split.select("key"), "key", "left_semi"), "open")

    def outliers(self, opened: DataFrame, turn: int) -> DataFrame:
        """Each member outside its key's most frequent component with one member of that."""
        tally = opened.groupBy("key", "root").agg(
            F.count("*").alias("times"), F.min(F.struct(F.xxhash64("fp", "key", F.lit(turn)), "fp", "n")).alias("hub")
        )
        main = tally.groupBy("key").agg(F.max(F.struct("times", "root", "hub")).alias("main"))
        main = main.select("key", F.col("main.root").alias("main"), F.col("main.hub.fp").alias("other"), F.col("main.hub.n").alias("m"))
        pairs = opened.join(main, "key").where(F.col("root") != F.col("main")).where(self._alike("n", "m"))
        return pairs.select("fp", "other")

    def _may_link(self) -> Column:
        """False only if the parities of x, not the larger, and y prove that
        they differ in more elements than linked sets of their sizes can."""
        own, other = F.col("x.own"), F.col("y.own")
        other = F.when(F.size(own) == F.size(other), other).when(F.size(own) == F.size("y.half"), F.col("y.half"))
        apart = F.aggregate(F.zip_with(own, other, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)
        most = (F.col("x.n") + F.col("y.n")) * (self.q - self.p)
        return F.coalesce(apart * (self.q + self.p) <= most, F.lit(True))

    def rest(self, opened: DataFrame) -> DataFrame:
        """All pairs of a key in different components, at their first common
        band, but for those whose parities exclude a link."""
        full = opened.join(self.keyed.select("fp", "keys"), "fp").join(self.items.select("fp", "own", "half"), "fp")
        x, y = full.alias("x"), full.alias("y")
        before = [F.slice(F.col(f"{side}.keys"), 1, F.col("x.band")) for side in "xy"]
        pairs = x.join(
            y,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.root") != F.col("y.root"))
            & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.fp") < F.col("y.fp"))))
            & self._alike("x.n", "y.n")
            & self._may_link()
            & ~F.arrays_overlap(*before),
        )
        return pairs.select(F.col("x.fp").alias("fp"), F.col("y.fp").alias("other"))

    def components(self) -> DataFrame:
        """(node, root): the components of the links, over fingerprints."""
        found = self.links(self.stars())
        roots = connected_components(found)
        opened, turn = self.open(self.members, roots), 0
        left = opened.count()
        while left:
            before, turn = left, turn + 1
            more = self.links(self.outliers(opened, turn))
            found = found.unionByName(more)
            if more.count() <= (1 - SHRINKS) * self.tried:
                break  # hardly a component was joined: all open pairs are compared, as the components were before
            roots = connected_components(found)
            opened = self.open(opened.drop("root"), roots)
            left = opened.count()
            if left > SHRINKS * before:
                break
        if left:
            roots = connected_components(found.unionByName(self.links(self.rest(opened))))
        return roots


def near_duplicates(
    docs: DataFrame, shingle: int = 5, p: int = 4, q: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``: texts link
    when q * |intersection| >= p * |union| of their ``shingle``-word sets; the
    row of each component's smallest id is kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("place", F.xxhash64("doc_id", "text"))  # the row that a set is read from again
    facts = written(docs.mapInPandas(_describe(shingle), FACTS), "sketches")
    roots = _Join(docs, facts, shingle, p, q).components()
    classes = facts.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("members"))
    placed = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    least = placed.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least"))
    named = placed.where("members > 1 or root is not null").join(least, "root", "left")
    # a set of one row that is linked with nothing needs no lookup
    named = named.select("fp", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least")).alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    joined = facts.select("doc_id", "n_shingles", "fp").join(written(named, "named"), "fp", "left")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
