"""Near-duplicate detection by ProbMinHash, banding and exact verification.

A text is a set of five-word shingles, each weighted ``1 + ln(times it
occurs)``. ProbMinHash lets every shingle run a Poisson process whose rate is
its weight; each arrival hits one random register, and a register keeps the
shingle that reaches it first. A shingle's process ends as soon as it lies
behind the latest first arrival of all registers. Two signatures agree in a
register with probability J_P, the probability Jaccard similarity of the
weighted sets (the Jaccard similarity itself where no shingle is repeated).

The plan, in tables of the shared folder:

1. Signatures are computed where a text is read; equal texts collapse to one
   representative, so copies cost nothing further.
2. Bands of registers form buckets. Every text of a bucket is compared with
   its leader, the text whose buckets are largest: amid a crowd of edited
   copies that is one near the original. Verified links give components.
3. Rounds: in each bucket that still holds several components, the most
   central text outside the largest becomes a leader of the others; as long as
   many of the pairs are links, further rounds take a few leaders each.
4. What is still open is settled exactly. In buckets of a few texts all
   pairs across components are compared. The texts of larger ones meet by an
   equi-join on rare shingles: if two sets reach the threshold, then each has
   in the other one of its rarest shingles, as many of them as it could do
   without given both sizes (``_prefixes``). Shingles that no other text has
   fill most of such a prefix, so a crowd around a common text, each with
   changes of its own, does not meet as a square of pairs.
5. Verification computes J_P exactly from the shingle sets, which are built
   once for all texts that share a bucket.

Recall: two texts of similarity 0.8 share a bucket with probability
1 - (1 - 0.8^6)^32 = 0.99994, more similar ones almost surely. Before pairs
of a bucket are verified, signatures that differ by more than six standard
deviations are dropped (below 1e-7 at the threshold); the prefixes are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pvtide.llm.common import orderable_columns, stored
from pvtide.llm.textkernels import freed, mix64, shingle_hashes, utf8_pieces, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 32
BAND_ROWS = 6
REGISTERS = BANDS * BAND_ROWS  # 192: three 64-bit words per bit plane
# Ids of texts to verify are broadcast up to this many rows (32 bytes each).
BROADCAST_ROWS = 500_000
# Standard deviations by which the signatures of a pair to verify may differ.
DEVIATIONS = 6
# New leaders of a bucket in a later round.
LEADERS = 4
# Share of a round's verified pairs that must be links for another round. What
# rounds leave is settled exactly, so it bears on time alone: leaders of a crowd
# that is not similar to them are compared with all of it for nothing.
PAYING = 0.05
# All pairs of components are compared in buckets of up to so many texts.
SMALL_BUCKET = 8
# Sizes of partners are told apart in classes of 3 %, mean weights in classes of 10 %.
SIZE_STEP, WEIGHT_STEP = 1.03, 1.1


# --- inside tasks ---------------------------------------------------------

def weighted_set(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) and their weights."""
    elements, times = np.unique(shingles, return_counts=True)
    return elements, 1.0 + np.log(times)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that reaches each register first.

    Arrivals are drawn for all live shingles at once, several per shingle
    while few are live; after each round a shingle whose last arrival lies
    behind the latest first arrival of all registers is out.
    """
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, np.uint64)
    live, rate, now, step = elements, weights, np.zeros(len(elements)), 0
    per_round = int(1.2 * registers * math.log(registers))
    while len(live):
        block = max(1, per_round // len(live))
        salts = mix64(np.arange(step + 1, step + block + 1, dtype=np.uint64))
        z = mix64(live[:, None] ^ salts)
        gaps = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
        times = now[:, None] + np.cumsum(gaps, axis=1) / rate[:, None]
        at = ((mix64(z) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        hit = times < first[at]
        t, r = times[hit], at[hit]
        e = np.broadcast_to(live[:, None], at.shape)[hit]
        latest_first = np.argsort(-t, kind="stable")  # so that the earliest is written last
        first[r[latest_first]] = t[latest_first]
        winner[r[latest_first]] = e[latest_first]
        now = times[:, -1]
        on = now < first.max()
        live, rate, now, step = live[on], rate[on], now[on], step + block
    return winner


def band_hashes(winner: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different bands never sharing keys by design."""
    rows = winner.reshape(BANDS, BAND_ROWS)
    total = np.zeros(BANDS, np.uint64)
    for j in range(BAND_ROWS):
        total = mix64(total * np.uint64(3) + rows[:, j])
    return mix64(total ^ mix64(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def bit_planes(winner: np.ndarray) -> np.ndarray:
    """The low byte of every register, as eight planes of one bit each."""
    bits = np.unpackbits((winner & np.uint64(255)).astype(np.uint8)[:, None], axis=1)
    return np.packbits(bits.T, axis=1).reshape(-1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        digests = batch.column(1).to_pylist()
        seen: dict[bytes, tuple] = {}  # copies inside a batch are hashed once
        for first, data, offsets in utf8_pieces(batch.column(2)):
            shingles, bounds = shingle_hashes(*word_hashes(data, offsets), SHINGLE_WORDS)
            bands, planes = [], []
            for i in range(len(offsets) - 1):
                digest = digests[first + i]
                if digest not in seen:
                    own = shingles[bounds[i]:bounds[i + 1]]
                    if len(own):
                        winner = prob_minhash(*weighted_set(own))
                        seen[digest] = (band_hashes(winner), bit_planes(winner))
                    else:
                        seen[digest] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                b, p = seen[digest]
                bands.append(b)
                planes.append(p)
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))],
                names=["id", "digest", "bands", "planes"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        for first, data, offsets in utf8_pieces(batch.column(1)):
            shingles, bounds = shingle_hashes(*word_hashes(data, offsets), SHINGLE_WORDS)
            own = [weighted_set(shingles[bounds[i]:bounds[i + 1]]) for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(own)),
                 pa.array([e.view(np.int64) for e, _ in own], pa.list_(pa.int64())),
                 pa.array([w.astype(np.float32) for _, w in own], pa.list_(pa.float32()))],
                names=["node", "elements", "weights"])


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """J_P of two weighted sets: the sum, over shared elements d, of
    ``1 / sum_e max(x_e / x_d, y_e / y_d)``. Sorted by the ratio y/x, the
    maximum takes y above d's ratio and x up to it, so prefix sums do."""
    shared, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    x_total, y_total = wa.sum(dtype=np.float64), wb.sum(dtype=np.float64)
    # Elements of a alone have ratio 0, elements of b alone ratio infinity.
    x_upto = np.cumsum(x) + (x_total - x.sum())
    y_above = y_total - (np.cumsum(y) + 0.0)
    return float(np.sum(1.0 / (x_upto / x + y_above / y)))


def _parts(lists: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column as arrays, without copying."""
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            sets = [_parts(batch.column(c)) for c in range(2, 6)]
            values = np.array([probability_jaccard(a.view(np.uint64), wa, b.view(np.uint64), wb)
                               for a, wa, b, wb in zip(*sets, strict=True)])
            linked = pa.array(values >= threshold - 1e-9) if len(values) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values, pa.float64())],
                names=["a", "b", "similarity"]).filter(linked)
    return run


def _odds(outside, mass):
    """a / (1 - a) of the share a of a mass that lies outside."""
    return outside / np.maximum(mass - outside, 1e-9)


def prefix_lengths(n: int, mass: float, weights: np.ndarray, partner_n: np.ndarray, partner_mass: np.ndarray,
                   similarity: float) -> np.ndarray:
    """How many of a set's elements (``weights`` in their order) make up its
    prefix against partners of at least ``partner_n`` elements and at most
    ``partner_mass``: a partner that has none of them is not similar.

    With shares a and b of the two masses outside the other set,
    ``J_P <= 1 / (1 + a/(1-a) + b/(1-b))``. If the first q elements are
    outside, so is their mass, and of the partner all but ``n - q`` elements
    (weights are 1 at least). An element belongs to the prefix while those
    before it alone do not bring the bound below the threshold.
    """
    before = np.concatenate([[0.0], np.cumsum(weights, dtype=np.float64)[:-1]])
    rest = np.maximum(0, partner_n[:, None] - n + np.arange(len(weights)))
    total = _odds(before, mass) + _odds(rest, partner_mass[:, None])
    return (total <= 1 / similarity - 1 + 1e-5).sum(axis=1)


def _prefixes(bounds: dict[int, tuple[int, float]], similarity: float):
    """Of every set: the elements of its prefix for each of its classes of
    partners, whose least size and largest mass are in ``bounds``. Private
    elements come first in the order; they fill the prefix, but can meet
    nothing, so only the others are returned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for i in range(batch.num_rows):
                node, own_class, n, mass, own_n, own_mass, partners = (batch.column(c)[i].as_py() for c in range(7))
                shared = batch.column(7)[i].values
                if shared is None or not partners:
                    continue
                code = np.array(partners)
                least_n, most_mass = np.array([bounds[c] for c in partners]).T
                weights = np.concatenate([np.full(own_n, own_mass / max(1, own_n)),
                                          shared.field("w").to_numpy().astype(np.float64)])
                elements = shared.field("element").to_numpy()
                lengths = prefix_lengths(n, mass, weights, least_n, most_mass, similarity) - own_n
                some = np.flatnonzero(lengths > 0)
                if not len(some):
                    continue
                counts = lengths[some]
                at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(elements[at]), pa.array(np.full(len(at), own_class)), pa.array(np.repeat(code[some], counts)),
                     pa.array(np.full(len(at), node))], names=["element", "own", "partner", "node"])
    return run


# --- on Spark ---------------------------------------------------------------

def _digest(text: Column) -> Column:
    """MD5 and a second hash of the text: rows that agree in both are copies."""
    text = F.coalesce(text, F.lit(""))
    return F.unhex(F.concat(F.md5(text.cast("binary")), F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def _md5(digest) -> Column:
    return F.lower(F.substring(F.hex(digest), 1, 32))


def _mismatches(a: Column, b: Column) -> Column:
    """Registers in which two signatures differ, from their bit planes."""
    words = REGISTERS // 64
    total = F.lit(0)
    for w in range(words):
        differ = F.lit(0).cast("long")
        for plane in range(8):
            i = plane * words + w
            differ = differ.bitwiseOR(a[i].bitwiseXOR(b[i]))
        total = total + F.bit_count(differ)
    return total


def max_mismatches(similarity: float) -> int:
    """Registers that may differ in a pair to verify: six standard
    deviations more than expected at the threshold."""
    spread = math.sqrt(similarity * (1 - similarity) / REGISTERS)
    return math.ceil(REGISTERS * (1 - similarity + DEVIATIONS * spread))


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` (the smallest node of its component) of the nodes of
    ``edges`` (a, b): least labels along edges, with pointer jumping, each
    round written to the shared folder, until no label changes."""
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
                  .union(edges.select("b", "a")), f"{name}-edges")
    labels = both.groupBy("node").agg(F.min("other").alias("m")).select(
        "node", F.least("node", "m").alias("root"))
    labels = stored(labels, f"{name}-labels")
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("root").alias("m"))
        seen = (both.join(known, "other").groupBy("node").agg(F.min("m").alias("m"))
                .join(labels, "node").select("node", F.col("root").alias("old"),
                                             F.least("root", "m").alias("via")))
        jump = known.withColumnRenamed("other", "via").withColumnRenamed("m", "next")
        # A root is a node of the same component, so its own label leads further down.
        new = stored(seen.join(jump, "via").select("node", "old", F.least("via", "next").alias("root")),
                     f"{name}-labels")
        changed = new.filter("old != root").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels


def _sets_of(texts: DataFrame, reps: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """``node, elements, weights`` of the given nodes: their weighted sets, read
    from the texts of the representatives (ids are broadcast up to a bound)."""
    needed = stored(nodes.distinct().join(reps.select("node", "digest", "rep_id"), "node"), f"{name}-nodes")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    found = (texts.join(needed, texts["digest"].eqNullSafe(needed["digest"])
                        & texts["id"].eqNullSafe(needed["rep_id"]))
             .select(needed["node"], texts["text"]))
    sets = found.mapInArrow(_sets, "node long, elements array<bigint>, weights array<float>")
    return stored(sets.dropDuplicates(["node"]), f"{name}-sets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar, with the exact value."""
    joined = (pairs.join(sets.withColumnsRenamed({"node": "a", "elements": "ea", "weights": "wa"}), "a")
              .join(sets.withColumnsRenamed({"node": "b", "elements": "eb", "weights": "wb"}), "b")
              .select("a", "b", "ea", "wa", "eb", "wb"))
    return stored(joined.mapInArrow(_verify(threshold), "a long, b long, similarity double"), f"{name}-links")


def _linked(pairs: DataFrame, labels: DataFrame, planes: DataFrame, sets: DataFrame, similarity: float,
            name: str, filtered: bool = True) -> tuple[DataFrame, bool]:
    """``labels`` (node, root) after joining the components that similar pairs
    (a, b) connect, and whether enough of the verified pairs are links. Only the links between roots
    take part in the components, each once."""
    if filtered:
        pairs = (pairs.join(planes.withColumnsRenamed({"node": "a", "planes": "pa"}), "a")
                 .join(planes.withColumnsRenamed({"node": "b", "planes": "pb"}), "b")
                 .filter(_mismatches(F.col("pa"), F.col("pb")) <= max_mismatches(similarity)).select("a", "b"))
    pairs = stored(pairs, f"{name}-pairs")
    links = _verified(pairs, sets, similarity, name)
    found = links.count()
    if not found:
        return labels, False
    edges = (links.select("a", "b").join(labels.withColumnsRenamed({"node": "a", "root": "ra"}), "a")
             .join(labels.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
             .filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    roots = connected_components(edges, name).select(F.col("node").alias("root"), F.col("root").alias("new"))
    labels = labels.join(roots, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return stored(labels, f"{name}-components"), found >= PAYING * pairs.count()


def _open(shared: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``band, node, score, root, main, n`` of buckets that hold several
    components; main is the one of most texts."""
    placed = shared.join(labels, "node")
    sizes = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = (sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"),
                                       F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"))
             .filter("roots > 1").select("band", "main", "n"))
    return stored(placed.join(mixed, "band"), name)


def _new_pairs(leaders: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs of the leaders (band, leader, its root) and the texts of other
    components in their buckets."""
    return (open_.join(leaders, "band").filter("root != leader_root")
            .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())


def _rare_pairs(open_: DataFrame, sets: DataFrame, similarity: float, name: str) -> DataFrame:
    """Pairs of texts of different components, one of them outside its
    bucket's main one, that share an element of both prefixes."""
    nodes = open_.groupBy("node").agg(F.max(F.col("root") != F.col("main")).alias("outside"), F.first("root").alias("root"))
    own = stored(sets.join(nodes, "node"), f"{name}-sets")
    items = own.select("node", F.explode(F.arrays_zip("elements", "weights")).alias("e")).select(
        "node", F.col("e.elements").alias("element"), F.col("e.weights").alias("w"))
    held = items.groupBy("element").agg(F.count(F.lit(1)).alias("df"))
    common = (items.join(held.filter("df > 1"), "element").groupBy("node")
              .agg(F.array_sort(F.collect_list(F.struct("df", "element", "w"))).alias("shared")))
    weight_of = lambda array, get: F.aggregate(array, F.lit(0.0), lambda a, x: a + get(x))
    described = own.select("node", "root", "outside", F.size("elements").cast("long").alias("n"),
                           weight_of("weights", lambda w: w.cast("double")).alias("mass"))
    size_class = F.floor(F.log("n") / math.log(SIZE_STEP)) * 1024 + F.floor(F.log(F.col("mass") / F.col("n")) / math.log(WEIGHT_STEP))
    shared_n = F.coalesce(F.size("shared"), F.lit(0))
    shared_mass = F.coalesce(weight_of("shared", lambda x: x["w"].cast("double")), F.lit(0.0))
    texts = stored(described.withColumn("class", size_class.cast("long")).join(common, "node", "left")
                   .withColumns({"own_n": (F.col("n") - shared_n).cast("int"),
                                 "own_mass": F.greatest(F.col("mass") - shared_mass, F.lit(0.0))}), f"{name}-rare")
    # Classes are bounded by their steps: some thousand rows at most.
    bounds = {r[0]: (r[1], r[2]) for r in texts.groupBy("class").agg(F.min("n"), F.max("mass")).collect()}
    # Partners of a text are those of its buckets.
    kinds = (open_.select("band", "node").join(texts.select("node", "class", "outside"), "node")
             .groupBy("band").agg(F.collect_set("class").alias("any"),
                                  F.collect_set(F.when(F.col("outside"), F.col("class"))).alias("out")))
    partners = (open_.select("band", "node").join(kinds, "band").groupBy("node")
                .agg(F.array_distinct(F.flatten(F.collect_set("any"))).alias("any"),
                     F.array_distinct(F.flatten(F.collect_set("out"))).alias("out")))
    texts = stored(texts.join(partners, "node"), f"{name}-partners")

    def prefixes(of: DataFrame, which: str) -> DataFrame:
        found = (of.select("node", "class", "n", "mass", "own_n", "own_mass", which, "shared")
                 .mapInArrow(_prefixes(bounds, similarity), "element long, own long, partner long, node long"))
        return found.join(texts.select("node", "root", "outside"), "node")

    x = prefixes(texts.filter("outside"), "any")
    y = prefixes(texts, "out").withColumnsRenamed({"own": "y_own", "partner": "y_partner", "node": "y", "root": "y_root",
                                                   "outside": "y_outside", "element": "y_element"})
    met = x.join(y, (F.col("element") == F.col("y_element")) & (F.col("own") == F.col("y_partner"))
                 & (F.col("partner") == F.col("y_own")) & (F.col("root") != F.col("y_root"))
                 & (~F.col("y_outside") | (F.col("node") < F.col("y"))))
    return met.select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY) -> DataFrame:
    """The near-duplicate class of every row of ``docs``.

    Returns ``doc_id``, ``class_id`` (smallest id of the class: texts joined
    by links of similarity 0.8 or more, and their copies), ``digest`` (MD5 of
    the text) and ``class_digest`` (that of the class's text under its
    smallest id).

    Defined cases: texts without words have no shingles and are classed by
    equality only (null and empty text are equal); a text of one to four
    words has one shingle, all of it; null ids are ignored for ``class_id``,
    which is null if the class has no id; repeated rows are rows of one
    class; an empty table gives an empty result; other columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _digest(text).alias("digest"), text.alias("text"))

    signed = texts.mapInArrow(_signatures, "id long, digest binary, bands array<bigint>, planes array<bigint>")
    reps = stored(signed.groupBy("digest").agg(
        F.min("id").alias("rep_id"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
        .withColumn("node", F.monotonically_increasing_id()), "minhash-reps")

    members = reps.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = members.join(buckets, "band")
    scores = met.groupBy("node").agg(F.sum("n").alias("score"))
    shared = stored(met.select("node", "band").join(scores, "node"), "minhash-buckets")
    labels = stored(scores.select("node", F.col("node").alias("root")), "minhash-components")
    planes = reps.select("node", "planes")
    sets = _sets_of(texts, reps, labels.select("node"), "minhash")

    central = F.struct("score", "node")
    leaders = shared.groupBy("band").agg(F.max_by("node", central).alias("leader"))
    pairs = (shared.join(leaders, "band").filter("node != leader")
             .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    labels, paying = _linked(pairs, labels, planes, sets, similarity, "minhash-first")

    round_no = 1
    while paying:  # every round joins components or is the last
        open_ = _open(shared, labels, "minhash-open")
        # The most central text outside the main component, and after a round that paid some drawn by hash.
        drawn = F.xxhash64("node", F.lit(round_no))
        outside = open_.filter("root != main")
        one = outside.groupBy("band").agg(F.max_by(F.struct("node", "root"), central).alias("l")).select("band", "l.*")
        first = Window.partitionBy("band").orderBy(drawn, "node")
        some = (outside.withColumn("place", F.row_number().over(first)).filter(F.col("place") < (LEADERS if round_no > 1 else 1))
                .select("band", "node", "root"))
        leaders = one.union(some).select("band", F.col("node").alias("leader"), F.col("root").alias("leader_root")).distinct()
        labels, paying = _linked(_new_pairs(leaders, open_), labels, planes, sets, similarity, f"minhash-round-{round_no}")
        round_no += 1

    open_ = _open(shared, labels, "minhash-rest")
    few, many = open_.filter(F.col("n") <= SMALL_BUCKET), open_.filter(F.col("n") > SMALL_BUCKET)
    leaders = few.filter("root != main").select("band", F.col("node").alias("leader"), F.col("root").alias("leader_root"))
    labels, _ = _linked(_new_pairs(leaders, few), labels, planes, sets, similarity, "minhash-few")
    roots, _ = _linked(_rare_pairs(many, sets, similarity, "minhash-many"), labels, planes, sets, similarity,
                       "minhash-many", filtered=False)

    classed = (reps.select("node", "digest", "rep_id").join(roots, "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    named = classed.groupBy("root").agg(
        F.min("rep_id").alias("class_id"),
        F.min_by("digest", F.struct(F.col("rep_id").isNull(), "rep_id", "digest")).alias("class_digest"))
    by_text = classed.join(named, "root").select("digest", "class_id", "class_digest")
    return (texts.select("id", "digest").join(by_text, "digest")
            .select(F.col("id").alias("doc_id"), "class_id", _md5("digest").alias("digest"),
                    _md5("class_digest").alias("class_digest")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stay: of each near-duplicate class the row with the
    smallest id, columns unchanged. Rows that tie on id and text are ordered
    by their other columns of orderable type (nulls first), and the first
    stays, so reruns keep the same row."""
    classes = near_duplicates(docs, id_col, text_col, similarity)
    keep = (classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest")))
            .select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("k"), F.col("doc_id").isNull().alias("k_null"),
                    F.col("digest").alias("d")))
    text, key = F.col("record").getField(text_col), F.col("record").getField(id_col)
    order = F.struct(*[F.col(f"`{c}`") for c in orderable_columns(docs)])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), order.alias("order"))
    rows = rows.select("record", "order", F.coalesce(key, F.lit(0).cast("long")).alias("k"), key.isNull().alias("k_null"),
                       _md5(_digest(text)).alias("d"))
    # Repeats of a row combine before they are shuffled.
    return (rows.join(keep, ["k", "k_null", "d"], "left_semi").groupBy("k", "k_null", "d")
            .agg(F.min_by("record", "order").alias("record")).select("record.*"))
