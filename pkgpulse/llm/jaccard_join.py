"""N-gram Jaccard join: universe partitioning with the pigeonhole principle.

Two texts link when the Jaccard similarity of their sets of word shingles is
at least ``p / q``. The universe of shingles is dealt into segments by hash;
the number of segments follows from the size band of the smaller set. If two
sets differ in at most H shingles and segments are given allowances a_i in
{0, 1, 2} that add up to H + 1, then some segment differs in fewer than a_i
shingles: allowance 1 looks for an equal segment, allowance 2 also for one
that differs by a single shingle (one-deletion neighbourhood), allowance 0
skips the segment. Each smaller set spends its H + 1 units where the segment
values are rarest in the corpus (cost-based allocation): of all units that its
segments can take, one or (few shingles) two each, it leaves out the dearest.
Values that no other set has cost nothing, and a set with H + 1 such units has
no partner at all.

Every set larger than or equal to the prober's is indexed under the same
scheme, so no link is lost. Candidates are verified on the whole sets.

Links are needed only as far as they connect texts, so equal sets are one
vertex, and each group of sets with a common segment value is first compared
with one hub, the set that meets most others (a star); then only pairs that are
still in different components are compared, all of them, each at its first
common value, but for those whose parity sketches prove that they differ too much. Results are exact up to collisions of 64-bit
hashes (shingles, set fingerprints).

Nulls and special cases: a null text, or one without words, has an empty set
and is linked with nothing (its component is itself); a text of fewer words
than the shingle length has its whole word sequence as its one shingle; rows
with a null id come back with a null component; repeated rows with one id are
one vertex each by their set, and the id's component is the smallest id
reachable from any of them. Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgpulse.llm.components import connected_components
from pkgpulse.llm.shared import blocks, written
from pkgpulse.llm.text_kernel import U64, Words, mix, windows

#: a size band reaches from its first size to below this multiple of it
BAND = 1.37
#: segments of at most this many shingles may be given allowance 2
SMALL = 2

FACTS = "doc_id long, place long, n_shingles long, fp long, spare long, own array<long>, half array<long>"

# kinds of postings
FULL, DELETION, WIDE_PROBE = 0, 1, 2


class Scheme:
    """Integer arithmetic of the size bands for the threshold p / q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.lows = [1]

    def _reach(self, n: int) -> None:
        while self.lows[-1] <= n:
            low = self.lows[-1]
            self.lows.append(max(low + 1, int(low * BAND)))

    def band(self, n: int) -> int:
        self._reach(n)
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def units(self, n: int) -> int:
        """H + 1 for a set of n shingles against any partner not smaller."""
        largest = n * self.q // self.p
        return (n + largest) * (self.q - self.p) // (self.q + self.p) + 1

    def slices(self) -> int:
        """Into how many parts the postings are cut, which are shuffled one
        after the other: they grow with the differences allowed to a set."""
        return max(1, 18 * (self.q - self.p) // (self.q + self.p))

    @cache  # noqa: B019 - a few schemes live as long as the process
    def shape(self, band: int) -> tuple[int, int]:
        """(number of segments, spare segments) of a band."""
        self._reach(int(self.lows[-1]) if band < len(self.lows) - 1 else 10**9)
        top = self.units(self.lows[band + 1] - 1)
        spare = 1 + top // 10
        return top + spare, spare

    def used(self, n: int, band: int) -> int:
        """Segments of the band's scheme that a set of n shingles posts."""
        segments, spare = self.shape(band)
        return min(segments, self.units(min(n, self.lows[band + 1] - 1)) + spare)

    def bands(self, n: int) -> range:
        """The bands of all partners not larger, the set's own band last."""
        return range(self.band(-(-n * self.p // self.q)), self.band(n) + 1)


@cache
def _scheme(p: int, q: int) -> Scheme:
    return Scheme(p, q)


def shingle_sets(texts: pd.Series, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts.tolist(), lower=True)
    values, bounds = windows(words, words.hashes(), k)
    for i in range(len(texts)):
        yield np.unique(values[bounds[i] : bounds[i + 1]])


def fingerprint(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - 2**63


def _segments_of(values: np.ndarray, segments: int) -> np.ndarray:
    return ((values >> U64(20)) % U64(segments)).astype(np.int64)


def spare_units(scheme: Scheme, values: np.ndarray) -> int:
    """Units that a set may leave out: those that its segments can take, one
    each and small ones a second, beyond the H + 1 it needs."""
    band = scheme.band(len(values))
    used, segments = scheme.used(len(values), band), scheme.shape(band)[0]
    counts = np.bincount(_segments_of(values, segments), minlength=segments)[:used]
    return used + int((counts <= SMALL).sum()) - scheme.units(len(values))


def _segment_keys(values: np.ndarray, band: int, segments: int, used: int):
    """Postings of one set under one scheme: (key, segment, kind, small)."""
    where = _segments_of(values, segments)
    take = where < used
    where, values = where[take], mix(values[take] ^ U64(0x51ED270B27A1F39D))
    order = np.argsort(where, kind="stable")
    where, values = where[order], values[order]
    counts = np.bincount(where, minlength=used)
    edges = np.concatenate([[0], np.cumsum(counts)])
    running = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    sums = running[edges[1:]] - running[edges[:-1]]
    number = np.arange(used)
    place = mix(number.astype(U64) + U64((band + 1) << 32))

    def key(total, at, kind):
        return mix(total ^ place[at]) * U64(2) + U64(kind)

    small = counts <= SMALL
    parts = [(key(sums, number, FULL), number, np.full(used, FULL))]
    near = counts[where] <= SMALL + 1  # indexed one-deletion neighbourhood
    parts.append((key(sums[where[near]] - values[near], where[near], 1), where[near], np.full(near.sum(), DELETION)))
    # what a small segment looks up when it is given allowance 2
    parts.append((key(sums[small], number[small], 1), number[small], np.full(small.sum(), WIDE_PROBE)))
    less = counts[where] <= SMALL
    parts.append((key(sums[where[less]] - values[less], where[less], FULL), where[less], np.full(less.sum(), WIDE_PROBE)))
    keys, at, kinds = (np.concatenate(x) for x in zip(*parts, strict=True))
    return keys, at, kinds, small[at]


def parity_sketch(values: np.ndarray, bits: int) -> list[int]:
    """Bit i: whether an odd number of shingles fall into bucket i of ``bits``
    (a power of two, 64 at least). Two sets differ in at least as many
    shingles as their sketches differ in bits."""
    odd = np.bincount((values >> U64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sketch_bits(units: int) -> int:
    return max(128, 1 << (8 * units - 1).bit_length())


def _describe(k: int, p: int, q: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scheme = _scheme(p, q)
        for frame in blocks(frames, "text"):
            sizes, prints, spare, own, half = [], [], [], [], []
            for values in shingle_sets(frame["text"], k):
                sizes.append(len(values))
                prints.append(fingerprint(values) if len(values) else None)
                spare.append(spare_units(scheme, values) if len(values) else 0)
                bits = _sketch_bits(scheme.units(len(values)))
                own.append(parity_sketch(values, bits))
                half.append(parity_sketch(values, bits // 2))
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "place": frame["place"],
                    "n_shingles": np.array(sizes, np.int64),
                    "fp": pd.array(prints, "Int64"),
                    "spare": np.array(spare, np.int64),
                    "own": own,
                    "half": half,
                }
            )

    return run


def _postings(k: int, p: int, q: int, nth: int, slices: int):
    """Postings of the ``nth`` of ``slices`` parts of all keys."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scheme, seen = _scheme(p, q), set()
        for frame in blocks(frames, "text"):
            keys, prints, slots = [], [], []
            for values in shingle_sets(frame["text"], k):
                n = len(values)
                if not n or scheme.units(n) == 1 and len(scheme.bands(n)) == 1:
                    continue  # such a small set links with equal sets only
                fp = fingerprint(values)
                if fp in seen:
                    continue
                if len(seen) < 1_000_000:  # only saves repeats: equal postings are merged later
                    seen.add(fp)
                own = scheme.band(n)
                for band in scheme.bands(n):
                    key, at, kind, small = _segment_keys(values, band, scheme.shape(band)[0], scheme.used(n, band))
                    if band != own or scheme.units(n) == 1:  # larger than any prober of that band: index only
                        index = kind != WIDE_PROBE
                        key, at, kind, small = key[index], at[index], kind[index], small[index]
                    if slices > 1:
                        mine = (key >> U64(33)) % U64(slices) == nth
                        key, at, kind, small = key[mine], at[mine], kind[mine], small[mine]
                    probes = int(band == own and scheme.units(n) > 1)
                    keys.append(key.view(np.int64))
                    prints.append(np.full(len(key), fp, np.int64))
                    slots.append((at.astype(np.int64) << 4) | (probes << 3) | (small.astype(np.int64) << 2) | kind)
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "fp": np.concatenate(prints), "slot": np.concatenate(slots)})

    return run


def _sets(k: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text"):
            sets = list(shingle_sets(frame["text"], k))
            yield pd.DataFrame({"fp": np.array([fingerprint(s) for s in sets], np.int64), "items": [s.tobytes() for s in sets]})

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


def _live(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(key, fp, slot, freq): the postings whose key several sets have, one of
    them at least to be found. Each part's shuffle goes before the next begins."""
    same_key = Window.partitionBy("key")
    is_index = F.col("slot").bitwiseAND(3) != WIDE_PROBE
    parts, slices = [], _scheme(p, q).slices()
    for nth in range(slices):
        postings = docs.select("text").mapInPandas(_postings(k, p, q, nth, slices), "key long, fp long, slot long")
        live = (
            postings.withColumn("low", F.min("fp").over(same_key))
            .withColumn("high", F.max("fp").over(same_key))
            .withColumn("freq", F.sum(is_index.cast("long")).over(same_key))
            .where("low <> high and freq > 0")
            .select("key", "fp", "slot", "freq")
        )
        parts.append(written(live, "postings"))
    return reduce(DataFrame.unionByName, parts)


def _allocate(live: DataFrame, sizes: DataFrame) -> DataFrame:
    """(fp, key) to look up: each set gives its units to the segments whose
    values are rarest, all but its ``spare`` dearest units."""
    probing = live.where(F.col("slot").bitwiseAND(8) > 0).where(F.col("slot").bitwiseAND(3) != DELETION)
    wide = F.col("slot").bitwiseAND(3) == WIDE_PROBE
    segments = (
        probing.groupBy("fp", F.shiftright("slot", 4).alias("segment"))
        .agg(
            F.coalesce(F.sum(F.when(~wide, F.col("freq"))), F.lit(0)).alias("cost1"),
            F.coalesce(F.sum(F.when(wide, F.col("freq"))), F.lit(0)).alias("cost2"),
            F.collect_set(F.when(~wide, F.col("key"))).alias("keys1"),
            F.collect_set(F.when(wide, F.col("key"))).alias("keys2"),
            F.max(F.col("slot").bitwiseAND(4)).alias("small"),
        )
        .withColumn(
            "unit",
            F.explode(
                F.array_compact(
                    F.array(
                        F.struct(F.col("cost1").alias("cost"), F.lit(1).alias("nth"), F.col("keys1").alias("keys")),
                        # a second unit needs the first: it never comes before it
                        F.when(
                            F.col("small") > 0,
                            F.struct(
                                F.greatest("cost1", "cost2").alias("cost"), F.lit(2).alias("nth"), F.col("keys2").alias("keys")
                            ),
                        ),
                    )
                )
            ),
        )
        .select("fp", "segment", "unit.*")
    )
    dearest = Window.partitionBy("fp").orderBy(F.desc("cost"), F.desc("nth"), F.desc("segment"))
    ranked = segments.withColumn("nth_dearest", F.row_number().over(dearest)).join(sizes.select("fp", "spare"), "fp")
    return ranked.where("nth_dearest > spare").select("fp", F.explode("keys").alias("key")).distinct()


def jaccard_components(
    docs: DataFrame, shingle: int = 3, p: int = 9, q: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``: texts link when
    q * |intersection| >= p * |union| of their ``shingle``-word sets."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("place", F.xxhash64("doc_id", "text"))  # the row that a set is read from again
    facts = written(docs.mapInPandas(_describe(shingle, p, q), FACTS), "sets")
    classes = facts.where("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("first_id"),
        F.min("place").alias("place"),
        F.max("n_shingles").alias("n"),
        F.max("spare").alias("spare"),
        F.count("*").alias("members"),
    )

    live = _live(docs, shingle, p, q)
    lives = live.select("fp").distinct().join(classes, "fp")
    sketches = facts.where("fp is not null").select("fp", "own", "half").dropDuplicates(["fp"])
    sizes = written(lives.join(sketches, "fp"), "sizes")

    probes = written(_allocate(live, sizes), "probes")
    wanted = probes.select("key").distinct()
    index = live.where(F.col("slot").bitwiseAND(3) != WIDE_PROBE).select("key", "fp").distinct().join(wanted, "key")
    both = probes.select("key", "fp", F.lit(True).alias("prober")).unionByName(
        index.select("key", "fp", F.lit(False).alias("prober"))
    )
    members = written(both.join(sizes.select("fp", "n"), "fp"), "members")

    groups = members.select("key", "fp")
    # a key's hub is the set that meets most others in its keys: one in the middle of a crowd
    crowd = groups.groupBy("key").agg(F.count("*").alias("met"))
    met = written(groups.join(crowd, "key").groupBy("fp").agg(F.sum("met").alias("met")), "met")
    hubs = groups.join(met, "fp").groupBy("key").agg(F.max(F.struct("met", F.xxhash64("fp"), "fp"))["fp"].alias("other"))
    stars = groups.join(hubs, "key").where("fp <> other").select("fp", "other").distinct()
    stars = written(_open_pairs(stars, sizes, p, q), "stars")
    # first one hub per set, then the other hubs as far as they are still apart
    nearest = stars.groupBy("fp").agg(F.min_by("other", F.xxhash64("other")).alias("other"))
    one = written(_verified(docs, sizes, nearest, shingle, p, q), "links")
    apart = _apart(stars, connected_components(one))
    first = one.unionByName(written(_verified(docs, sizes, apart, shingle, p, q), "links"))
    roots = connected_components(first)

    placed = members.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_groups = written(placed.join(split.select("key"), "key"), "open")
    # a pair is made at its first common key only: each set comes with its sorted keys
    keyed = open_groups.groupBy("fp", "root", "n", "prober").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    # the sketches, far longer than the other columns, join the open groups only, and are not written with them
    sketched = keyed.join(sizes.select("fp", "own", "half"), "fp").select("*", F.posexplode("keys").alias("at", "key"))
    # at each key only the earlier ones travel
    sketched = sketched.withColumn("before", F.slice("keys", F.lit(1), F.col("at"))).drop("keys", "at")
    x, y = sketched.where("prober").alias("x"), sketched.where("not prober").alias("y")
    rest = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.root") != F.col("y.root"))
        & (F.col("x.n") <= F.col("y.n"))
        & (F.col("y.n") * p <= F.col("x.n") * q)
        & _may_link("x", "y", p, q)
        & ~F.arrays_overlap("x.before", "y.before"),
    ).select(F.col("x.fp").alias("fp"), F.col("y.fp").alias("other"))
    second = written(_verified(docs, sizes, rest, shingle, p, q), "links")
    components = connected_components(first.unionByName(second))

    # smallest id of each component, then of every row's set
    linked = classes.join(components.select(F.col("node").alias("fp"), "root"), "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component"))
    named = classes.join(
        linked.select("fp", "root").join(least, "root").select("fp", "component"), "fp", "left"
    ).select("fp", F.coalesce("component", "first_id").alias("component_id"), "members")
    # a set held by one row needs no lookup of its class: only shared or linked sets are joined
    known = named.join(linked.select("fp", F.lit(True).alias("linked")), "fp", "left").where("members > 1 or linked")
    return facts.join(known.select("fp", "component_id"), "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def _may_link(x: str, y: str, p: int, q: int) -> Column:
    """False only if the sketches prove that x (not the larger) and y differ
    in more shingles than linked sets of their sizes can."""
    own, other = F.col(f"{x}.own"), F.col(f"{y}.own")
    other = F.when(F.size(own) == F.size(other), other).when(F.size(own) == F.size(f"{y}.half"), F.col(f"{y}.half"))
    apart = F.aggregate(F.zip_with(own, other, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)
    return F.coalesce(apart * (q + p) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (q - p), F.lit(True))


def _open_pairs(rows: DataFrame, sizes: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (fp, other) whose sizes and sketches allow a link."""
    size = sizes.select("fp", "n", "own", "half")
    sized = rows.alias("r").join(size.alias("x"), F.col("r.fp") == F.col("x.fp"))
    sized = sized.join(size.alias("y"), F.col("r.other") == F.col("y.fp"))
    alike = F.least("x.n", "y.n") * q >= F.greatest("x.n", "y.n") * p
    may = F.when(F.col("x.n") <= F.col("y.n"), _may_link("x", "y", p, q)).otherwise(_may_link("y", "x", p, q))
    return sized.where(alike).where(may).select("r.fp", "r.other")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (fp, other) whose sets are not in one component yet."""
    placed = pairs
    for end in ("fp", "other"):
        root = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        placed = placed.join(root, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return placed.where("fp_root <> other_root").select("fp", "other")


def _verified(docs: DataFrame, sizes: DataFrame, pairs: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """Links (a, b): the pairs (fp, other) whose sets, computed anew from the
    whole texts, are similar."""
    pairs = written(pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    places = written(needed.join(sizes.select("fp", "place"), "fp").select("place"), "places")
    texts = docs.join(places, "place", "left_semi").dropDuplicates(["place"]).select("text")
    sets = texts.mapInPandas(_sets(shingle), "fp long, items binary")
    return (
        pairs.join(sets.select(F.col("fp").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("fp").alias("b"), F.col("items").alias("y")), "b")
        .mapInPandas(_verify(p, q), "a long, b long")
        .distinct()
    )
